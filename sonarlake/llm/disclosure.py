"""Personal data, and the terms that give it away: information-theoretic sanitisation by corpus co-occurrence.

Base spans (email, ip, card, phone) come from fixed patterns; each value found is a protected entity. The words within
``WINDOW`` of a mention are its context, and the words and word pairs in contexts are candidates. A term's disclosure of an
entity is the pointwise mutual information of the two, as a share of the entity's information: with q the share of all
words that stand in the entity's contexts, and p the share of the term's occurrences that do, log2(p/q) against -log2(q).
A term is disclosing if that share is at least ``DISCLOSURE``, and if chance can't explain it: ``MIN_CONTEXTS`` independent
contexts, which together carry ``EVIDENCE`` bits. Contexts are independent if the ``SIDE`` words at the far ends of
``REACH`` words before and after the mention are found in no other context of the entity, so copies and near copies of a
text count as one, and phrases that always surround a mention do no harm. A disclosing term that stands nowhere
else is removed, any other is generalised to its shape (number, name or word), wherever in the corpus it stands.

Passes over the texts: mentions with their contexts; counts of the candidates, which a bitmap of fixed size lets through;
the spans. Disclosing terms are broadcast up to ``TERMS``; above that they meet the texts in a join. Both give the same rows.

Defined cases: a null text is an empty one. Texts without words or mentions have no terms. Very long texts are read whole,
one at a time, in time linear in their length; words of over ``KEY_BYTES`` are known by their SHA-256. Copies and repeated
rows get equal spans. Overlapping spans of terms are merged. If entities tie, a term counts for the kind and value that come
first. An empty table gives no rows. All columns of the input stay, but those named like a result or a helper (_body, _hits, _salt, _text_key)
are replaced. Counts
are kept by 64-bit hashes of terms; spans by the terms themselves.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonarlake.llm.decontam import _TABLE
from sonarlake.llm.session import checkpointed, map_slices
from sonarlake.llm.text import HashMemo, mix

KINDS, TERM = ("email", "ip", "card", "phone"), "term"
WINDOW, REACH, SIDE = 10, 20, 5
MIN_CONTEXTS, DISCLOSURE, EVIDENCE = 3, 0.9, 40.0
KEY_BYTES = 64
#: Bits of the bitmap of terms (8 MB), at any size of the corpus.
BITS = 26
#: Disclosing terms that are broadcast; and copies of a term or hit that spread hot keys in the join above that.
TERMS, SALT = 200_000, 16
#: Hashes that a task counts before it hands them on.
HELD = 500_000

# The patterns of personal data.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LABEL = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
OUTPUT = [*(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("spans", T.ArrayType(SPAN)), T.StructField("sanitised", T.StringType())]
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_NOT_DIGIT = re.compile("[^0-9]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        start = done + len(text[done:at].rstrip(LOCAL))
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        done = found.end() if found else at + 1
        at = text.find("@", done)


def _addresses(text: str):
    """Four numbers at a time of each run of dotted numbers."""
    for run in DOTTED.finditer(text):
        parts = run[0].split(".")
        at = run.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, end
            at = end + 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Kind, start and end (code points) of personal data, by kind, then start."""
    out = [("email", a, b) for a, b in _emails(text)]
    if not any(d in text for d in "0123456789"):
        return out
    if "." in text:
        out += [("ip", a, b) for a, b in _addresses(text)]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def entity(kind: str, found: str) -> str:
    """What mentions of the same thing have in common."""
    return found.lower() if kind == "email" else found if kind == "ip" else _NOT_DIGIT.sub("", found)


def _key(word: bytes) -> bytes:
    return word if len(word) <= KEY_BYTES else b"#" + hashlib.sha256(word).hexdigest().encode()


class Words:
    """The words of a text outside of base spans, their hashes, and which neighbours a base span parts."""

    def __init__(self, text: str, base: list, memo: HashMemo):
        self.raw = text.encode("utf-8", "replace")
        self.folded = self.raw.translate(_TABLE)
        self.words = self.folded.split()
        self.inner = None
        self.together = np.ones(max(0, len(self.words) - 1), bool)
        if base:
            starts, ends = self._edges()
            at = np.array(sorted((a, b) for _, a, b in base))
            reach = np.maximum.accumulate(at[:, 1])
            before = np.searchsorted(at[:, 0], ends, "left")  # spans that start before a word's end
            free = (before == 0) | (reach[np.maximum(before - 1, 0)] <= starts)
            self.inner = np.flatnonzero(free)
            self.words = [self.words[i] for i in self.inner.tolist()]
            self.before = before[free]
            self.together = self.before[1:] == self.before[:-1]
        self.one = np.fromiter(map(memo.__getitem__, self.words), np.uint64, len(self.words))
        self.two = mix(self.one[:-1] * _ODD + self.one[1:]) if len(self.one) > 1 else np.zeros(0, np.uint64)

    def _edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Where words start and end, in code points."""
        inside = np.zeros(len(self.folded) + 2, np.int8)
        inside[1:-1] = np.frombuffer(self.folded, np.uint8) != 32
        turn = np.diff(inside)
        points = np.cumsum((np.frombuffer(self.raw, np.uint8) & 0xC0) != 0x80)
        return points[np.flatnonzero(turn == 1)] - 1, points[np.flatnonzero(turn == -1) - 1]

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        starts, ends = self._edges()
        return (starts, ends) if self.inner is None else (starts[self.inner], ends[self.inner])

    def pair(self, i: int) -> str:
        return (_key(self.words[i]) + b" " + _key(self.words[i + 1])).decode("utf-8", "replace")

    def word(self, i: int) -> str:
        return _key(self.words[i]).decode("utf-8", "replace")


def _contexts(text: str, memo: HashMemo):
    """Rows of a mention and a term near it; ``n`` are the term's occurrences there that no mention of the entity before had."""
    base = base_spans(text)
    if not base:
        return
    w = Words(text, base, memo)
    starts = w.edges()[0]
    done: dict = {}
    for kind, start, end in sorted(base, key=lambda s: s[1:]):
        who = (kind, entity(kind, text[start:end]))
        p = int(np.searchsorted(starts, start))
        low, high = max(0, p - WINDOW), min(len(w.words), p + WINDOW)
        if low == high:
            continue
        side = lambda a, b: int.from_bytes(hashlib.blake2b(b" ".join(w.words[a:b]), digest_size=8).digest(), "little", signed=True)
        first, last = max(0, p - REACH), min(len(w.words), p + REACH)
        left, right = side(first, min(first + SIDE, p)), side(max(last - SIDE, p), last)
        left, right = ~right if low == p else left, ~left if p == high else right  # an empty side stands for the other
        new = max(low, done.get(who, 0))
        terms: dict = {}
        for i in range(low, high):
            terms.setdefault((w.word(i), int(w.one[i])), []).append(i >= new)
        for i in range(low, high - 1):
            if w.together[i]:
                terms.setdefault((w.pair(i), int(w.two[i])), []).append(i + 1 >= new)
        done[who] = high
        for (term, h), fresh in terms.items():
            yield (*who, left, right, term, h - (1 << 64) if h >= 1 << 63 else h, sum(fresh))


_CONTEXT = [("kind", pa.string()), ("entity", pa.string()), ("left", pa.int64()), ("right", pa.int64()), ("term", pa.string()), ("h", pa.int64()), ("n", pa.int64())]


def contexts(texts: DataFrame) -> DataFrame:
    def work(batches):
        memo = HashMemo()
        for b in batches:
            rows = [r for t in b.column(0).to_pylist() for r in _contexts(t or "", memo)]
            for at in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows[at : at + 20_000], strict=True), _CONTEXT, strict=True)], [c for c, _ in _CONTEXT])

    return map_slices(texts, work, "kind string, entity string, left long, right long, term string, h long, n long")


def bitmap(terms: DataFrame) -> np.ndarray:
    """A bit for the low bits of each term's hash."""
    at = F.pmod("h", F.lit(1 << BITS)) + 1
    parts = terms.select(F.bitmap_bucket_number(at).alias("k"), F.bitmap_bit_position(at).alias("bit")).groupBy("k").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    out = np.zeros(1 << BITS - 3, np.uint8)
    for r in parts:
        out[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def _marked(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    low = (h & np.uint64((1 << BITS) - 1)).astype(np.int64)
    return (bits[low >> 3] >> (low & 7).astype(np.uint8)) & 1 == 1


def counts(texts: DataFrame, bits: np.ndarray) -> DataFrame:
    """Occurrences (h, n) of the terms that the bitmap lets through; the row without h has those of all words."""
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def work(batches):
        memo, held, words, bits = HashMemo(), Counter(), 0, shared.value

        def emit():
            h = np.fromiter(held.keys(), np.uint64, len(held)).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(list(held.values()), pa.int64())], ["h", "n"])

        for b in batches:
            found = []
            for t in b.column(0).to_pylist():
                w = Words(t or "", base_spans(t or ""), memo)
                words += len(w.words)
                found += [w.one[_marked(w.one, bits)], w.two[_marked(w.two, bits) & w.together]]
            h, n = np.unique(np.concatenate(found or [np.zeros(0, np.uint64)]), return_counts=True)
            held.update(dict(zip(h.tolist(), n.tolist(), strict=True)))
            if len(held) > HELD:
                yield emit()
                held.clear()
        yield emit()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([words], pa.int64())], ["h", "n"])

    return map_slices(texts, work, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def disclosing_terms(texts: DataFrame, min_contexts: int = MIN_CONTEXTS, disclosure: float = DISCLOSURE, evidence: float = EVIDENCE) -> DataFrame:
    """term, h, kind and entity that it discloses most, contexts, pmi and information in bits, and action (remove or generalise)."""
    who, where = ["kind", "entity"], ["kind", "entity", "left", "right"]
    seen = checkpointed(contexts(texts).groupBy(*where, "term", "h").agg(F.sum("n").alias("n")))
    # A side that one context has is unique; both tables have a row for each such context, so they meet on unique keys.
    sides = seen.select(*where).distinct()
    left = sides.groupBy(*who, "left").agg(F.count("*").alias("c"), F.min("right").alias("right")).where("c = 1").select(*where)
    right = sides.groupBy(*who, "right").agg(F.count("*").alias("c"), F.min("left").alias("left")).where("c = 1").select(*where)
    independent = left.join(right, where).withColumn("i", F.lit(1))
    pairs = seen.join(independent, where, "left").groupBy(*who, "term", "h").agg(F.sum("n").alias("joint"), F.count("i").alias("contexts"))
    candidates = checkpointed(pairs.where(F.col("contexts") >= min_contexts))
    near = seen.where(~F.col("term").contains(" ")).groupBy(*who).agg(F.sum("n").alias("near"))
    counted = checkpointed(counts(texts, bitmap(candidates)))
    words = counted.where("h IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    info = -F.log2(F.col("near") / F.lit(max(1, words)))
    rated = candidates.join(counted, "h").join(near, who).withColumns({"information": info, "pmi": F.log2(F.col("joint") / F.col("n")) + info})
    told = (F.col("pmi") >= disclosure * F.col("information")) & (F.col("contexts") * F.col("pmi") >= evidence)
    most = F.struct((-F.col("pmi")).alias("least"), "kind", "entity")
    best = rated.where(told).groupBy("term", "h").agg(F.min_by(F.struct(*who, "contexts", "pmi", "information", (F.col("joint") == F.col("n")).alias("only")), most).alias("b")).select("term", "h", "b.*")
    found = checkpointed(best.withColumn("action", F.when(F.col("only"), "remove").otherwise("generalise")).drop("only"))
    # A pair says nothing new if one of its words discloses.
    alone = found.where(~F.col("term").contains(" ")).select(F.col("term").alias("_w"))
    pair = F.split("term", " ")
    for k in (F.lit(0), F.lit(1)):
        found = found.join(alone, F.when(F.size(pair) == 2, F.get(pair, k)) == F.col("_w"), "left_anti")
    return checkpointed(found)


def _occurrences(w: Words, bits: np.ndarray):
    """(term, first word, last word) of what the bitmap lets through."""
    for i in np.flatnonzero(_marked(w.one, bits)).tolist():
        yield w.word(i), i, i
    for i in np.flatnonzero(_marked(w.two, bits) & w.together).tolist():
        yield w.pair(i), i, i + 1


def _sanitised(text: str, spans: list[tuple[str, int, int, str]]) -> str:
    """The text with a label, or nothing, for each span; of overlapping ones the first gives the label."""
    out, done = [], 0
    for kind, start, end, action in sorted(spans, key=lambda s: (s[1], s[2])):
        if start >= done:
            shape = text[start:end]
            general = "[NUMBER]" if any(c.isdigit() for c in shape) else "[NAME]" if shape[:1].isupper() else "[WORD]"
            out += [text[done:start], LABEL.get(kind) or ("" if action == "remove" else general)]
        done = max(done, end)
    return "".join([*out, text[done:]])


def _judge(text: str, bits: np.ndarray, action_of, memo: HashMemo) -> tuple:
    """Counts by kind, spans, and the sanitised text."""
    base = base_spans(text)
    w = Words(text, base, memo)
    hits = [(i, j, a) for t, i, j in _occurrences(w, bits) if (a := action_of(t))]
    terms: list = []
    if hits:
        starts, ends = w.edges()
        for i, j, a in sorted(hits):
            if terms and starts[i] < terms[-1][2]:
                terms[-1][2] = max(terms[-1][2], int(ends[j]))
            else:
                terms.append([TERM, int(starts[i]), int(ends[j]), a])
    found = [*((*s, "") for s in base), *map(tuple, terms)]
    n = Counter(k for k, _, _ in base)
    return *(n[k] for k in KINDS), [{"kind": k, "start": a, "end": b} for k, a, b, _ in found], _sanitised(text, found)


def _result(batch, kept: list[str], judged: list[tuple]):
    columns = list(zip(*judged, strict=True)) or [()] * (len(KINDS) + 2)
    kinds = [*[pa.int64()] * len(KINDS), _ARROW_SPANS, pa.string()]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [*kept, *(f.name for f in OUTPUT)])


def sanitise(docs: DataFrame, text: str = "text", broadcast_terms: int = TERMS, **options) -> DataFrame:
    """docs with n_email, n_ip, n_card, n_phone, spans (kind, start, end in code points; by kind, then start) and the sanitised text."""
    spark = docs.sparkSession
    terms = disclosing_terms(docs.select(F.col(text).cast("string")), **options)
    bits = spark.sparkContext.broadcast(bitmap(terms))
    names = {"_body", "_hits", "_salt", "_text_key", *(f.name for f in OUTPUT)}
    rows = docs.select(*(docs[c] for c in docs.columns if c not in names or c == text)).withColumn("_body", F.col(text).cast("string"))
    kept = [c for c in rows.columns if c not in names or (c == text and c != "_body")]
    schema = T.StructType([*(rows.schema[c] for c in kept), *OUTPUT])
    if terms.count() <= broadcast_terms:
        actions = spark.sparkContext.broadcast({r["term"]: r["action"] for r in terms.select("term", "action").collect()})

        def work(batches):
            memo = HashMemo()
            for b in batches:
                judged = [_judge(t or "", bits.value, actions.value.get, memo) for t in b.column("_body").to_pylist()]
                yield _result(b, kept, judged)

        return map_slices(rows, work, schema)

    def find(batches):
        memo = HashMemo()
        for b in batches:
            found = {(k, o[0]) for k, t in zip(b.column("_text_key").to_pylist(), b.column("_body").to_pylist(), strict=True) for o in _occurrences(Words(t or "", base_spans(t or ""), memo), bits.value)}
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([t for _, t in found], pa.string())], ["_text_key", "term"])

    def spread(df, by):
        """A side with hot keys, dealt to SALT places each."""
        return df.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(SALT)))

    everywhere = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long")))
    keyed = rows.withColumn("_text_key", F.sha2(F.coalesce("_body", F.lit("")), 256))
    occurring = map_slices(keyed.select("_text_key", "_body"), find, "_text_key string, term string").distinct()
    hits = spread(occurring, ["_text_key"]).join(terms.select("term", "action", everywhere.alias("_salt")), ["term", "_salt"])
    by_text = hits.groupBy("_text_key").agg(F.collect_set(F.struct("term", "action")).alias("_hits"))  # at most the terms of a text
    met = spread(keyed, kept).join(by_text.withColumn("_salt", everywhere), ["_text_key", "_salt"], "left").select(*kept, "_body", "_hits")

    def work_joined(batches):
        memo = HashMemo()
        for b in batches:
            judged = []
            for t, h in zip(b.column("_body").to_pylist(), b.column("_hits").to_pylist(), strict=True):
                own = {x["term"]: x["action"] for x in h or []}
                judged.append(_judge(t or "", bits.value, own.get, memo))
            yield _result(b, kept, judged)

    return map_slices(met, work_joined, schema)
