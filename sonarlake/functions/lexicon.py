"""Pronunciation lexicons: validation, layering, and one-pass rewriting."""

from __future__ import annotations

import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from sonarlake.functions.normalize import RESULT, results

# Tone-marked vowels, and the global entries.
TONES = "āáǎàēéěèīíǐìōóǒòūúǔùǖǘǚǜ"
GLOBAL = [
    ("重庆", None, None, "chóng qìng"), ("行长", None, None, "háng zhǎng"), ("AI", "A I", "AI", None),
    ("km", "千米", "千米", None), ("kg", "千克", "千克", None),
]
HINT = "{}: pronunciation hint {} requires listening; model has no verified phoneme input"

ENTRY = "term string, spoken string, expected string, pinyin string"
RESOLVED = T.StructType([
    T.StructField("text", T.StringType()), T.StructField("expected", T.StringType()),
    T.StructField("applied", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("term", "spoken", "expected", "pinyin")]))),
    T.StructField("warnings", T.ArrayType(T.StringType())),
])


def as_hint(spoken: Column, pinyin: Column) -> tuple[Column, Column]:
    """A bare string with tone marks and nothing but pinyin is a hint, not a replacement."""
    hint = pinyin.isNull() & spoken.rlike(f"[{TONES}]") & spoken.rlike(f"^[a-zA-Zü{TONES}\\s'-]+$")
    return F.when(~F.coalesce(hint, F.lit(False)), spoken), F.when(hint, spoken).otherwise(pinyin)


def violations(term: Column, spoken: Column, expected: Column, pinyin: Column) -> Column:
    """Why an entry can't be used; empty if it can."""
    blank = lambda c: c.isNotNull() & (F.btrim(c) == "")
    return F.array_compact(F.array(
        F.when(F.coalesce(term, F.lit("")) == "", "empty_key"), F.when(spoken.isNull() & pinyin.isNull(), "spoken_or_pinyin_required"),
        F.when(blank(spoken), "invalid_spoken"), F.when(blank(expected), "invalid_expected"), F.when(blank(pinyin), "invalid_pinyin"),
    ))


def merge_lexicons(layers: DataFrame, priority: str = "priority") -> DataFrame:
    """The entry of the highest priority for each term, as a whole entry."""
    top = Window.partitionBy("term").orderBy(F.col(priority).desc())
    spoken, pinyin = as_hint(F.col("spoken"), F.col("pinyin"))
    best = layers.withColumn("_n", F.row_number().over(top)).where("_n = 1").drop("_n")
    return best.withColumns({"spoken": spoken, "pinyin": pinyin})


class Terms:
    """Entries as an automaton in arrays: a trie whose nodes are rows, with failure links, so a text is read once however many
    terms there are. Of the terms at a place the longest that fits wins, then the text goes on behind it; ASCII terms don't
    touch letters."""

    def __init__(self, entries: dict[str, tuple[str | None, str | None, str | None]]):
        self.entries = entries
        children: list[dict[str, int]] = [{}]
        self.ends = [0]  # the length of the term that ends in a node
        for term in entries:
            at = 0
            for c in term:
                then = children[at].get(c)
                if then is None:
                    then = children[at][c] = len(children)
                    children.append({})
                    self.ends.append(0)
                at = then
            self.ends[at] = len(term)
        self.children = children
        self.fail, self.shorter = [0] * len(children), [0] * len(children)  # shorter: the next node up the links that ends a term
        queue = list(children[0].values())
        for at in queue:
            for c, then in children[at].items():
                up = self.fail[at]
                while up and c not in children[up]:
                    up = self.fail[up]
                self.fail[then] = children[up].get(c, 0) if children[up].get(c, 0) != then else 0
                queue.append(then)
            self.shorter[at] = self.fail[at] if self.ends[self.fail[at]] else self.shorter[self.fail[at]]
        # Most texts have none of the characters that terms begin with; these pass without a look at each character.
        self.starts = re.compile("[" + "".join(re.escape(c) for c in sorted({t[0] for t in entries if t})) + "]") if any(entries) else None

    def matches(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of the terms that a text is read by, from left to right."""
        if self.starts is None or not self.starts.search(text):
            return []
        best: dict[int, int] = {}  # the longest term by its start
        children, fail, ends, shorter = self.children, self.fail, self.ends, self.shorter
        at = 0
        for k, c in enumerate(text):
            while at and c not in children[at]:
                at = fail[at]
            at = children[at].get(c, 0)
            node = at if ends[at] else shorter[at]
            while node:
                start = k + 1 - ends[node]
                if fits(text, start, k + 1):
                    best[start] = k + 1  # ends come in rising order
                node = shorter[node]
        out, done = [], 0
        for start in sorted(best):
            if start >= done:
                done = best[start]
                out.append((start, done))
        return out


def _letter(c: str) -> bool:
    return "a" <= c <= "z" or "A" <= c <= "Z"


def fits(text: str, start: int, end: int) -> bool:
    """Whether a term may stand there: an ASCII one has no letter beside it."""
    return not text[start:end].isascii() or not (start and _letter(text[start - 1]) or end < len(text) and _letter(text[end]))


def resolve(text: str | None, terms: Terms) -> dict:
    """One pass over the text that writes the spoken and the expected form side by side."""
    found = [] if text is None else terms.matches(text)
    if not found:
        return {"text": text, "expected": text, "applied": [], "warnings": []}
    spoken_parts, expected_parts, applied, warnings, done = [], [], [], [], 0
    for start, end in found:
        term = text[start:end]
        spoken, expected, pinyin = terms.entries[term]
        before, done = text[done:start], end
        said = term if spoken is None else spoken
        spoken_parts += [before, said]
        expected_parts += [before, said if expected is None else expected]
        applied.append({"term": term, "spoken": spoken, "expected": expected, "pinyin": pinyin})
        if pinyin is not None and spoken is None:
            warnings.append(HINT.format(term, pinyin))
    return {"text": "".join([*spoken_parts, text[done:]]), "expected": "".join([*expected_parts, text[done:]]), "applied": applied, "warnings": warnings}


#: Entries that are shipped to every task (some 100 MB as an automaton); larger lexicons meet the texts in a join.
SHIPPED = 200_000
#: Characters of a term by which it and texts are joined.
PREFIX = 4
HEAD_BITS = 24

_ARROW_RESOLVED = to_arrow_type(RESOLVED)
_BUILT: dict = {}


def _terms_of(key: str, entries) -> Terms:
    """The automaton of a shipped lexicon, built once by a worker."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Terms(entries.value if hasattr(entries, "value") else entries)
    return _BUILT[key]


def _shipped(entries: dict):
    """Entries as tasks get them: once for each machine."""
    spark = SparkSession.getActiveSession()
    return uuid.uuid4().hex, spark.sparkContext.broadcast(entries) if spark and len(entries) > 1000 else entries


def entries_of(lexicon: DataFrame, limit: int = SHIPPED) -> dict:
    """A lexicon as a dictionary; its size is checked, as it is shipped to every task."""
    rows = lexicon.select("term", "spoken", "expected", "pinyin").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a lexicon of more than {limit} entries isn't shipped; resolve_rows joins it")
    return {r["term"]: (r["spoken"], r["expected"], r["pinyin"]) for r in rows}


def resolve_pronunciation(text: Column, entries: dict) -> Column:
    key, shipped = _shipped(entries)

    @F.arrow_udf(RESOLVED)
    def resolved(texts: pa.Array) -> pa.Array:
        terms = _terms_of(key, shipped)
        return pa.array([resolve(t, terms) for t in texts.to_pylist()], _ARROW_RESOLVED)

    return resolved.asNondeterministic()(text)


def _head_bits(heads: DataFrame) -> np.ndarray:
    """A bit for each hash of a head: 2 MB, however many heads there are."""
    at = F.crc32("_run").bitwiseAND((1 << HEAD_BITS) - 1) + 1
    parts = heads.select(F.bitmap_bucket_number(at).alias("k"), F.bitmap_bit_position(at).alias("b")).groupBy("k").agg(F.bitmap_construct_agg("b").alias("bits")).collect()
    out = np.zeros(1 << HEAD_BITS - 3, np.uint8)
    for r in parts:
        out[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def candidate_terms(texts: DataFrame, lexicon: DataFrame, id: str, text: str) -> DataFrame:
    """(id, entries): for each text the entries whose terms it has, by an equi-join on the first characters of both.

    Of a text's runs of up to PREFIX characters only those are joined that a bitmap of the terms' first characters, of fixed
    size, lets through. Neither side is broadcast, and texts move once, to be asked whether they have the whole term.
    """
    heads = lexicon.where(F.length("term") > 0).select(F.substring("term", 1, PREFIX).alias("_run"), F.struct("term", "spoken", "expected", "pinyin").alias("_entry"))
    lengths = sorted(r[0] for r in heads.select(F.length("_run")).distinct().collect())  # at most PREFIX
    bits = texts.sparkSession.sparkContext.broadcast(_head_bits(heads))

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def runs(bodies: pa.Array) -> pa.Array:
        known, mask = bits.value, (1 << HEAD_BITS) - 1

        def there(run):
            h = zlib.crc32(run.encode("utf-8", "replace")) & mask
            return known[h >> 3] >> (h & 7) & 1

        return pa.array([[r for r in {t[k : k + n] for n in lengths for k in range(len(t) - n + 1)} if there(r)] if t else [] for t in bodies.to_pylist()], pa.list_(pa.string()))

    named = texts.select(F.col(id).alias("_id"), F.col(text).alias("_text"))
    met = named.select("_id", F.explode(runs("_text")).alias("_run")).join(heads, "_run").select("_id", "_entry")
    had = met.join(named, "_id").where(F.contains("_text", F.col("_entry.term")))
    return had.groupBy("_id").agg(F.collect_set("_entry").alias("entries")).withColumnRenamed("_id", id)  # at most the terms of one text


def resolve_rows(texts: DataFrame, lexicon: DataFrame, id: str, text: str = "text", name: str = "resolved", limit: int = SHIPPED) -> DataFrame:
    """texts with the RESOLVED struct, by a lexicon of any size; ``id`` is unique. Terms are unique, as ``merge_lexicons`` leaves them."""
    if lexicon.limit(limit + 1).count() <= limit:
        return texts.withColumn(name, resolve_pronunciation(F.col(text), entries_of(lexicon, limit)))

    @F.arrow_udf(RESOLVED)
    def resolved(bodies: pa.Array, entries: pa.Array) -> pa.Array:
        own = [{e["term"]: (e["spoken"], e["expected"], e["pinyin"]) for e in es or []} for es in entries.to_pylist()]
        return pa.array([resolve(t, Terms(e)) for t, e in zip(bodies.to_pylist(), own, strict=True)], _ARROW_RESOLVED)

    found = candidate_terms(texts, lexicon, id, text)
    return texts.join(found, id, "left").withColumn(name, resolved.asNondeterministic()(F.col(text), F.col("entries"))).drop("entries")


def prepare_text(text: Column, entries: dict, profile: str = "none", global_entries: dict | None = None) -> Column:
    """Struct of normalization and pronunciation; global entries apply only with a profile."""
    used = ({} if profile == "none" else dict(global_entries or {})) | entries
    kind = T.StructType([
        T.StructField("text_original", T.StringType()), T.StructField("text_normalized", T.StringType()), T.StructField("text_spoken", T.StringType()),
        T.StructField("text_expected", T.StringType()), T.StructField("normalization", RESULT), T.StructField("pronunciation", RESOLVED),
    ])
    arrow = to_arrow_type(kind)
    key, shipped = _shipped(used)

    @F.arrow_udf(kind)
    def prepared(texts: pa.Array) -> pa.Array:
        terms = _terms_of(key, shipped)
        normal = results(texts, pa.array([profile] * len(texts), pa.string()))
        spoken = normal.field("normalized")
        said = pa.array([resolve(t, terms) for t in spoken.to_pylist()], _ARROW_RESOLVED)
        return pa.StructArray.from_arrays([texts.cast(pa.string()), spoken, said.field("text"), said.field("expected"), normal, said], fields=list(arrow))

    return prepared.asNondeterministic()(text)


def term_hits(text: Column, term: str) -> Column:
    """How often a term stands in a text on its own."""
    bound = rf"(?<![A-Za-z])\Q{term}\E(?![A-Za-z])" if term.isascii() else rf"\Q{term}\E"
    return F.regexp_count(text, F.lit(bound))
