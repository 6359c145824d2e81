"""Importance resampling towards a target: hashed n-gram weights, Gumbel scores, and an exact draw by radix selection.

Features of a text are its runs of 1 to ``n`` words, counted with repeats in ``buckets`` hash buckets. Tasks count the
corpus and the target into arrays, whose sum gives each bucket a gain, the log ratio of its smoothed shares; a text's
weight is its mean gain. A seeded Gumbel value of the id is added, so the highest scores are a draw without replacement
in proportion to the weights. The last drawn key (score, id, row) is found digit by digit: each round counts the next
digit of the keys that are still in question, so what reaches the driver is at most 2**DIGIT rows a round, at any size.
Only drawn rows are sorted, by ranges; their ranks follow from the rows of each range.

Defined cases: null, empty and wordless texts have no features and weight 0; they are too short to be drawn. Very long
texts are read whole, one at a time. Ties of score go to the smaller id, a null id counts as the largest. Rows that
repeat are scored alike and drawn one by one, told apart by a row number that is part of the key, so a single key that
holds most rows is split like any other. An empty target has no features: gains then only smooth the corpus. An empty
corpus gives no rows. Only id, text and the columns in ``carry`` are read, so others can have any names; to carry a column
with the name of a result is refused. Ids are longs; text that is no number stops the query with Spark's cast error.
"""

from __future__ import annotations

import math
import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonarlake.llm.decontam import words_of
from sonarlake.llm.session import checkpointed, map_slices

BUCKETS, NGRAM, MIN_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Bits of a digit in the selection: a round returns at most 2**DIGIT counts.
DIGIT = 12
RESULT = ("n_features", "weight", "score", "rank")
_SIGN, _LAST = -(1 << 63), (1 << 63) - 1


class BucketMemo(dict):
    """Feature to bucket; emptied when it has grown to its limit, so its memory is bounded."""

    LIMIT = 400_000

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[feature] = out = zlib.crc32(feature) % self.buckets
        return out


def feature_buckets(text: str | None, n: int, memo: BucketMemo) -> np.ndarray:
    """The bucket of each feature, repeats included."""
    words = words_of(text)
    runs = [words, *(list(map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False))) for k in range(2, n + 1))]
    return np.concatenate([np.fromiter(map(memo.__getitem__, r), np.int64, len(r)) for r in runs])


def bucket_counts(texts: DataFrame, text: str = "text", n: int = NGRAM, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket. A task hands on one array; the driver gets ``buckets`` sums."""

    def work(batches):
        memo, total = BucketMemo(buckets), np.zeros(buckets, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                total += np.bincount(feature_buckets(t, n, memo), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in map_slices(texts.select(F.col(text).cast("string")), work, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed shares, rounded down."""
    b, all_s, all_t = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (all_s + b) / ((s + 1) * (all_t + b)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def with_weights(docs: DataFrame, gain: np.ndarray, text: str = "text", n: int = NGRAM) -> DataFrame:
    """Adds n_words, n_features and weight to rows."""
    place = docs.columns.index(text)

    def work(batches):
        memo = BucketMemo(len(gain))
        for b in batches:
            found = []
            for t in b.column(place).to_pylist():
                at = feature_buckets(t, n, memo)
                found.append((len(words_of(t)) if n > 1 else len(at), len(at), int(gain[at].sum()) // len(at) if len(at) else 0))
            extra = [pa.array([f[k] for f in found], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], [*b.schema.names, "n_words", "n_features", "weight"])

    return map_slices(docs, work, T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight"))]))


def gumbel_score(weight: Column, id: Column, seed: int) -> Column:
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return weight + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def kth_key(rows: DataFrame, keys: list[str], k: int, digit: int = DIGIT) -> list[int]:
    """The k-th least key (from 1) over long columns, which together are unique: a digit of one column a round."""
    found, among, left = [], F.lit(True), k
    for name in keys:
        n, low, high = rows.where(among).agg(F.count("*"), F.min(name), F.max(name)).first()
        if n == left:  # all that are in question are drawn
            return found + [_LAST] * (len(keys) - len(found))
        low, high = low - _SIGN, high - _SIGN  # as unsigned
        value = F.col(name).bitwiseXOR(F.lit(_SIGN))
        while low < high:
            shift = max(0, (low ^ high).bit_length() - digit)
            inside = rows.where(among & F.col(name).between(low + _SIGN, high + _SIGN))
            counts = sorted((r["d"] % (1 << 64 - shift), r["n"]) for r in inside.groupBy(F.shiftrightunsigned(value, shift).alias("d")).agg(F.count("*").alias("n")).collect())
            before = [0, *accumulate(n for _, n in counts)]
            i = next(i for i in range(len(counts)) if before[i + 1] >= left)
            left -= before[i]
            low, high = counts[i][0] << shift, (counts[i][0] + 1 << shift) - 1
        found.append(low + _SIGN)
        among = among & (F.col(name) == found[-1])
    return found


def ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``rank`` by the keys' order: sorted ranges, and the rows of the ranges before."""
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    ordered = checkpointed(ordered.withColumns({"_range": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND((1 << 33) - 1)}))
    sizes = sorted(tuple(r) for r in ordered.groupBy("_range").count().collect())  # a row for each range
    starts = list(zip([r for r, _ in sizes], accumulate([0, *(n for _, n in sizes)]), strict=False))
    offsets = rows.sparkSession.createDataFrame(starts, "_range int, _start long").withColumn("_range", F.col("_range").cast("long"))
    return ordered.join(F.broadcast(offsets), "_range").withColumn("rank", F.col("_start") + F.col("_at") + 1).drop("_range", "_at", "_start")


def resample(docs: DataFrame, target: DataFrame, id: str = "doc_id", text: str = "text", target_text: str = "text", carry: list[str] | None = None, n: int = NGRAM,
             buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """All rows with n_features, weight, score and, if drawn, rank; ``carry`` names further columns (also the text) to keep."""
    carry = carry or []
    if bad := set(carry) & {*RESULT, "n_words", id}:
        raise ValueError(f"a carried column has the name of a result: {sorted(bad)}")
    read = docs.select(F.col(id).cast("long").alias(id), *(docs[c].alias(c) for c in carry), F.col(text).cast("string").alias("_text"))
    gain = gains(bucket_counts(docs, text, n, buckets), bucket_counts(target, target_text, n, buckets))
    scored = with_weights(read, gain, "_text", n).drop("_text").withColumn("score", gumbel_score(F.col("weight"), F.col(id), seed).cast("long"))
    # Keys rise from the best: a greater score has a lesser complement. The row number is part of the checkpoint, so it stays.
    keyed = scored.withColumns({"_score": F.bitwise_not("score"), "_id": F.coalesce(F.col(id), F.lit(_LAST)), "_row": F.monotonically_increasing_id()})
    rows = checkpointed(keyed)
    keys, names = ["_score", "_id", "_row"], [id, *carry, "n_features", "weight", "score"]
    able = F.col("n_words") >= min_words
    k = percent * rows.where(able).count() // 100
    if not k:
        return rows.select(*names, F.lit(None).cast("long").alias("rank"))
    a, b, c = kth_key(rows.where(able), keys, k)
    s, i, r = (F.col(x) for x in keys)
    drawn = able & ((s < a) | ((s == a) & ((i < b) | ((i == b) & (r <= c)))))
    out = ranked(rows.where(drawn).select(*names, *keys), keys).select(*names, "rank")
    return out.unionByName(rows.where(~drawn).select(*names, F.lit(None).cast("long").alias("rank")))
