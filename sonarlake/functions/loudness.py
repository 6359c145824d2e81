"""Integrated loudness and true peak of mono clips, whole or in chunks.

Samples go through the K-weighting of ITU-R BS.1770: a high shelf and a high pass, two recursive filters. Their answer to an
impulse dies out within WARM samples, so it is applied as a convolution, which needs no state but the samples before a
chunk. The energy of each tenth of a second is a row; four in a row are a block of 400 ms that overlaps the next by three
quarters. Blocks over -70 LUFS count, then those over their mean less 10. True peak is the greatest value at four times the
rate, by the filter bank that also resamples.

Defined cases: less than 400 ms, or nothing over the gates, has no loudness (null). A clip without samples has no peak.
Samples that aren't finite make both null. A rate that isn't a multiple of ten has no tenths of a second, and no loudness.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonarlake.functions import signal

# Fixed values of the standard: offset, gates, and the filters' frequencies, gain and quality.
OFFSET, GATE, BELOW = -0.691, -70.0, 10.0
SHELF, SHELF_GAIN, SHELF_QUALITY = 1681.974450955533, 3.999843853973347, 0.7071752369554196
PASS, PASS_QUALITY = 38.13547087602444, 0.5003270373238773
#: Samples after which an impulse's answer is below 1e-15, at rates up to 192 kHz less than 1e-8.
WARM = 8192
#: Samples of one convolution.
STRIDE = 1 << 16
OVERSAMPLING = 4
MEASURED = T.StructType([T.StructField("lufs", T.DoubleType()), T.StructField("true_peak", T.DoubleType())])


def _recursive(x: np.ndarray, b: tuple, a: tuple) -> np.ndarray:
    """A filter of second order, step by step."""
    out, x1, x2, y1, y2 = np.empty(len(x)), 0.0, 0.0, 0.0, 0.0
    for n, v in enumerate(x.tolist()):
        y = b[0] * v + b[1] * x1 + b[2] * x2 - a[0] * y1 - a[1] * y2
        x2, x1, y2, y1 = x1, v, y1, y
        out[n] = y
    return out


@lru_cache(maxsize=8)
def weighting(rate: int) -> np.ndarray:
    """What the two filters make of an impulse."""
    k = math.tan(math.pi * SHELF / rate)
    high = 10 ** (SHELF_GAIN / 20)
    mid = high**0.4996667741545416
    base = 1 + k / SHELF_QUALITY + k * k
    shelf = ((high + mid * k / SHELF_QUALITY + k * k) / base, 2 * (k * k - high) / base, (high - mid * k / SHELF_QUALITY + k * k) / base), (2 * (k * k - 1) / base, (1 - k / SHELF_QUALITY + k * k) / base)
    k = math.tan(math.pi * PASS / rate)
    base = 1 + k / PASS_QUALITY + k * k
    high_pass = (1.0, -2.0, 1.0), (2 * (k * k - 1) / base, (1 - k / PASS_QUALITY + k * k) / base)
    impulse = np.zeros(WARM)
    impulse[0] = 1
    return _recursive(_recursive(impulse, *shelf), *high_pass)


def weighted(x: np.ndarray, rate: int, before: np.ndarray | None = None) -> np.ndarray:
    """K-weighted samples, with what was before them."""
    past = np.zeros(0) if before is None else before[-WARM:]
    whole = np.concatenate([np.zeros(WARM - len(past)), past, x])
    size = STRIDE + WARM
    answer = np.fft.rfft(weighting(rate), size)
    out = np.empty(len(x))
    for at in range(0, len(x), STRIDE):
        part = whole[at : at + size]  # WARM samples before the stride, then the stride
        out[at : at + STRIDE] = np.fft.irfft(np.fft.rfft(part, size) * answer, size)[WARM : len(part)]
    return out


def tenths(x: np.ndarray, rate: int, start: int = 0, before: np.ndarray | None = None) -> list[tuple[int, float, int]]:
    """(number, energy, samples) of the tenths of a second that samples from ``start`` on touch."""
    hop = rate // 10
    if not len(x) or rate % 10:
        return []
    y = weighted(x, rate, before) ** 2
    first = start // hop
    cuts = np.arange(first + 1, (start + len(x) - 1) // hop + 1) * hop - start
    edges = np.concatenate([[0], cuts])
    sums, ends = np.add.reduceat(y, edges), np.append(cuts, len(x))
    return list(zip(range(first, first + len(edges)), sums.tolist(), (ends - edges).tolist(), strict=True))


def peak_of(x: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None) -> float | None:
    return float(np.abs(signal.polyphase(x, OVERSAMPLING, 1, 0, before, after)).max()) if len(x) else None


def gated(blocks: np.ndarray) -> float | None:
    """Loudness of the mean squares of blocks."""
    with np.errstate(divide="ignore"):
        level = OFFSET + 10 * np.log10(blocks)
        loud = blocks[level > GATE]
        if not len(loud):
            return None
        kept = blocks[(level > GATE) & (level > OFFSET + 10 * math.log10(loud.mean()) - BELOW)]
    return OFFSET + 10 * math.log10(kept.mean())


def measure_clip(x: np.ndarray, rate: int) -> dict:
    """MEASURED of a whole clip."""
    if not np.isfinite(x).all():
        return {"lufs": None, "true_peak": None}
    full = np.array([e for _, e, n in tenths(x, rate) if n == rate // 10])
    blocks = np.convolve(full, np.ones(4), "valid") / (4 * (rate // 10)) if len(full) >= 4 else np.zeros(0)
    peak = peak_of(x)
    return {"lufs": gated(blocks) if len(blocks) else None, "true_peak": 20 * math.log10(peak) if peak else None}


@F.arrow_udf(MEASURED)
def _measured(a: pa.Array, rates: pa.Array) -> pa.Array:
    out = [None if not x.is_valid or r is None else measure_clip(x.values.to_numpy(zero_copy_only=False).astype(np.float64), r) for x, r in zip(a, rates.to_pylist(), strict=True)]
    return pa.array(out, pa.struct([("lufs", pa.float64()), ("true_peak", pa.float64())]))


def measure(a: Column, rate: Column) -> Column:
    """lufs and true_peak of clips that a row can hold."""
    return _measured(a, rate)


def clip_loudness(chunks: DataFrame, clip: list[str], rate: int, part: str = "chunk", start: str = "start", samples: str = "samples") -> DataFrame:
    """One row per clip of one rate, from chunks of which all but the last have at least WARM samples.

    A task holds a chunk and its neighbours' edges. Tenths are summed over chunks; a clip has ten rows a second from there on.
    """
    kind = T.StructType([T.StructField("tenths", T.ArrayType(T.StructType([T.StructField("t", T.LongType()), T.StructField("e", T.DoubleType()), T.StructField("n", T.LongType())]))), T.StructField("peak", T.DoubleType()),
                         T.StructField("finite", T.BooleanType())])
    arrow = pa.struct([("tenths", pa.list_(pa.struct([("t", pa.int64()), ("e", pa.float64()), ("n", pa.int64())]))), ("peak", pa.float64()), ("finite", pa.bool_())])

    @F.arrow_udf(kind)
    def reckon(a: pa.Array, before: pa.Array, after: pa.Array, starts: pa.Array) -> pa.Array:
        plain = lambda x: x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.zeros(0)
        out = []
        for x, b, f, s in zip(map(plain, a), map(plain, before), map(plain, after), starts.to_pylist(), strict=True):
            fine = bool(np.isfinite(x).all())
            known = fine and bool(np.isfinite(b).all() and np.isfinite(f).all())
            out.append({"tenths": [dict(zip("ten", r, strict=True)) for r in tenths(x, rate, s, b)] if known else [], "peak": peak_of(x, b, f) if known else None, "finite": fine})
        return pa.array(out, arrow)

    edged = signal.with_edges(chunks.select(*clip, part, start, samples), clip, WARM, part, samples)
    found = edged.select(*clip, reckon(F.col(samples), F.col("before"), F.col("after"), F.col(start).cast("long")).alias("r"))
    peaks = found.groupBy(*clip).agg(F.max("r.peak").alias("_peak"), F.every("r.finite").alias("_finite"))
    hop = rate // 10
    sums = found.select(*clip, F.explode("r.tenths").alias("t")).groupBy(*clip, F.col("t.t").alias("t")).agg(F.sum("t.e").alias("e"), F.sum("t.n").alias("n")).where(F.col("n") == hop)
    four = Window.partitionBy(*clip).orderBy("t").rowsBetween(0, 3)
    blocks = sums.select(*clip, (F.sum("e").over(four) / (4 * hop)).alias("z"), F.count("*").over(four).alias("k")).where("k = 4")
    level = F.when(F.col("z") > 0, OFFSET + 10 * F.log10("z"))
    loud = blocks.withColumn("l", level).where(F.col("l") > GATE)
    gate = loud.groupBy(*clip).agg((OFFSET + 10 * F.log10(F.avg("z")) - BELOW).alias("gate"))
    kept = loud.join(gate, clip).where("l > gate").groupBy(*clip).agg((OFFSET + 10 * F.log10(F.avg("z"))).alias("_lufs"))
    out = peaks.join(kept, clip, "left")
    return out.select(*clip, F.when(F.col("_finite"), F.col("_lufs")).alias("lufs"), F.when(F.col("_finite") & (F.col("_peak") > 0), 20 * F.log10("_peak")).alias("true_peak"))
