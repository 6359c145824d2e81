"""Benchmark decontamination by winnowing.

Texts are words of digits, a-z and non-ASCII characters. Of every window of W consecutive K-grams the
least hash is the fingerprint, so any span of W + K - 1 = 13 shared words has a shared fingerprint.
Fingerprints of documents meet those of the benchmark, and each hit is extended to the whole 13-word
window and confirmed word by word. Items of fewer words are one window; documents look them up by
grams of exactly their length, so they have the same guarantee.

The benchmark's windows are broadcast while its text is under ``BROADCAST_CHARS``; a larger one takes
part in an equi-join on fingerprints instead. Both give the same rows.

Defined cases: null and empty texts have no words, so nothing is hit and the document is not
contaminated. Items with a null id or without words have no window; rows that repeat an id are one item
with the windows of all. Repeated document rows are each returned. Very long texts are looked through whole, one at a
time. An empty table of documents gives no rows, one of items hits nothing. Input columns that clash with an
output column are replaced.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonarlake.llm.session import KEPT, checkpointed, map_slices
from sonarlake.llm.text import UPPER_TO_LOWER, HashMemo, gram_hashes, sliding_min

SPAN, K = 13, 5
W = SPAN - K + 1
BROADCAST_CHARS = 16_000_000
OUTPUT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()),
    T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType()),
])

_TABLE = bytes(UPPER_TO_LOWER.get(c, c) if c > 127 or chr(c).isalnum() else 32 for c in range(256))
_MEMO = HashMemo()
KEPT.append(_MEMO.clear)
#: Between documents of a batch; part of no item, so no window reaches over it.
_EDGE = b"\x00"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_TABLE).split()


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_MEMO.__getitem__, words), np.uint64, len(words))


def fingerprints(hashes: np.ndarray, span: int) -> np.ndarray:
    """The fingerprint of each window of ``span`` words: its least K-gram hash, or the hash of a short window."""
    return sliding_min(gram_hashes(hashes, K), W) if span == SPAN else gram_hashes(hashes, span)


def item_windows(text: str | None) -> list[tuple[int, int, bytes]]:
    """(span, fingerprint, words) of an item's windows."""
    words = words_of(text)
    span = min(SPAN, len(words))
    if not span:
        return []
    return [(span, int(f), b" ".join(words[i : i + span])) for i, f in enumerate(fingerprints(_hashes(words), span))]


class Index:
    """Windows of a benchmark by span and fingerprint."""

    def __init__(self, items: list[tuple[object, str | None]]):
        self.items: dict[bytes, set[str]] = defaultdict(set)
        prints: dict[int, set[int]] = defaultdict(set)
        for i, text in items:
            if i is not None:
                for span, f, w in item_windows(text):
                    prints[span].add(f)
                    self.items[w].add(str(i))
        self.prints = {s: np.array(sorted(p), np.uint64) for s, p in prints.items()}
        self.filters = {}
        for s, p in self.prints.items():
            bits = max(16, (32 * len(p)).bit_length())
            self.filters[s] = np.zeros(1 << bits, bool)
            self.filters[s][(p & np.uint64((1 << bits) - 1)).astype(np.int64)] = True

    def candidates(self, hashes: np.ndarray, span: int) -> np.ndarray:
        """Places of the windows of ``span`` words that have a fingerprint of the benchmark."""
        f = fingerprints(hashes, span)
        likely = np.flatnonzero(self.filters[span][(f & np.uint64(len(self.filters[span]) - 1)).astype(np.int64)])
        p = self.prints[span]
        at = np.minimum(np.searchsorted(p, f[likely]), len(p) - 1)
        return likely[p[at] == f[likely]]

    def hits(self, texts: list[str | None]) -> list[tuple[int, int, set[str]]]:
        """(words, hit words, items) of each text."""
        each = [words_of(t) for t in texts]
        words = [w for d in each for w in (*d, _EDGE)]
        hashes = _hashes(words)
        hit, found = np.zeros(len(words), bool), defaultdict(set)
        starts = np.cumsum([0, *(len(d) + 1 for d in each)])
        for span in self.prints:
            for i in self.candidates(hashes, span).tolist():
                if got := self.items.get(b" ".join(words[i : i + span])):
                    hit[i : i + span] = True
                    found[int(np.searchsorted(starts, i, "right")) - 1] |= got
        counts = np.add.reduceat(hit, starts[:-1], dtype=np.int64) if texts else []
        return [(len(d), int(n), found.get(k, set())) for k, (d, n) in enumerate(zip(each, counts, strict=True))]


def verdict(n_words: int, n_hit: int, items: set[str]) -> tuple:
    digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
    return n_words, n_hit, len(items), digest, n_hit > 0 and 20 * n_hit >= n_words


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256 and contaminated."""
    docs = docs.drop(*[f.name for f in OUTPUT if f.name in docs.columns])
    items = benchmark.select(F.col(item).alias("item_id"), F.col(item_text).alias("text"))
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if chars > broadcast_chars:
        return _joined(docs, items, text)
    index = docs.sparkSession.sparkContext.broadcast(Index([tuple(r) for r in items.collect()]))  # under the checked bound
    place = docs.columns.index(text)

    def work(batches):
        for b in batches:
            out = [verdict(*h) for h in index.value.hits(b.column(place).to_pylist())]
            cols = [pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*b.schema.names, *OUTPUT.names])

    return map_slices(docs, work, T.StructType([*docs.schema.fields, *OUTPUT.fields]))


def _joined(docs: DataFrame, items: DataFrame, text: str) -> DataFrame:
    """The same without a broadcast: fingerprints, then windows, meet in equi-joins."""

    def of_items(batches):
        for b in batches:
            out = [(i, *w) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for w in item_windows(t)]
            cols = [pa.array([str(r[0]) for r in out], pa.string()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] - (1 << 63) for r in out], pa.int64()), pa.array([r[3] for r in out], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["item_id", "span", "f", "w"])

    windows = checkpointed(map_slices(items.where("item_id IS NOT NULL"), of_items, "item_id string, span int, f long, w binary").distinct())
    spans = sorted(r[0] for r in windows.select("span").distinct().collect())  # 13 at most
    keyed = docs.select(F.xxhash64(text).alias("k"), F.sha1(F.coalesce(text, F.lit(""))).alias("k2"), F.col(text).alias("t")).distinct()

    def prints(batches):
        for b in batches:
            rows = []
            for k, k2, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                h = _hashes(words_of(t))
                rows += [(k, k2, s, int(f) - (1 << 63)) for s in spans for f in np.unique(fingerprints(h, s))]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kind) for n, kind in enumerate((pa.int64(), pa.string(), pa.int32(), pa.int64()))], ["k", "k2", "span", "f"])

    shared = map_slices(keyed, prints, "k long, k2 string, span int, f long").join(windows.select("span", "f").distinct(), ["span", "f"])
    wanted = shared.groupBy("k", "k2").agg(F.collect_list(F.struct("span", "f")).alias("p"))  # bounded by the document

    def extend(batches):
        for b in batches:
            rows = []
            for k, k2, t, p in zip(*(b.column(c).to_pylist() for c in ("k", "k2", "t", "p")), strict=True):
                words = words_of(t)
                h = _hashes(words)
                for s in {x["span"] for x in p}:
                    ours = np.array([x["f"] + (1 << 63) for x in p if x["span"] == s], np.uint64)
                    rows += [(k, k2, s, int(i), b" ".join(words[i : i + s])) for i in np.flatnonzero(np.isin(fingerprints(h, s), ours))]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kind) for n, kind in enumerate((pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary()))], ["k", "k2", "span", "i", "w"])

    hits = map_slices(keyed.join(wanted, ["k", "k2"]).select("k", "k2", "t", "p"), extend, "k long, k2 string, span int, i long, w binary").join(windows.select("item_id", "w"), "w")
    places = hits.select("k", "k2", F.explode(F.sequence("i", F.col("i") + F.col("span") - 1)).alias("at")).distinct().groupBy("k", "k2").agg(F.count("*").alias("n_hit"))
    names = hits.groupBy("k", "k2").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    found = places.join(names, ["k", "k2"])

    def count(batches):
        for b in batches:
            n = pa.array([len(words_of(t)) for t in b.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n], ["k", "k2", "n_words"])

    sizes = map_slices(keyed, count, "k long, k2 string, n_words long")
    per = sizes.join(found, ["k", "k2"], "left").select(
        "k", "k2", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")), 256).alias("items_sha256"),
    ).withColumn("n_items", F.greatest("n_items", F.lit(0).cast("long"))).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    keys = docs.withColumns({"__k": F.xxhash64(text), "__k2": F.sha1(F.coalesce(text, F.lit("")))})
    per = per.withColumnsRenamed({"k": "__p", "k2": "__p2"})
    return keys.join(per, (F.col("__k") == F.col("__p")) & (F.col("__k2") == F.col("__p2"))).select(*docs.columns, *OUTPUT.names)
