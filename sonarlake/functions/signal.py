"""Statistics and rules of mono sample arrays, in higher-order array functions."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Levels and the rate of a master.
SILENCE, EDGE, CLIP, TARGET_RATE = 1e-3, 1e-4, 0.999, 48_000
PAD_START, PAD_END, MAX_BOOST = 0.08, 0.12, 12.0

_ZERO = lambda: F.lit(0.0)


def _abs(a: Column) -> Column:
    return F.transform(a, lambda x: F.abs(x.cast("double")))


def mono(channels: Column) -> Column:
    """Mean of an array of channels."""
    return F.transform(F.element_at(channels, 1), lambda _, i: F.aggregate(channels, _ZERO(), lambda s, c: s + F.get(c, i)) / F.size(channels))


def peak(a: Column) -> Column:
    return F.coalesce(F.array_max(_abs(a)), _ZERO())


def rms(a: Column) -> Column:
    return F.coalesce(F.sqrt(F.aggregate(a, _ZERO(), lambda s, x: s + x.cast("double") * x.cast("double")) / F.nullif(F.size(a), F.lit(0))), _ZERO())


def dc_offset(a: Column) -> Column:
    return F.coalesce(F.aggregate(a, _ZERO(), lambda s, x: s + x.cast("double")) / F.nullif(F.size(a), F.lit(0)), _ZERO())


def duration(a: Column, rate: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(a).cast("double"), rate), _ZERO())


def clipping(a: Column, level: float = CLIP) -> Column:
    return F.exists(a, lambda x: (F.abs(x) >= level) & ~F.isnan(x))


def has_nan(a: Column) -> Column:
    return F.exists(a, lambda x: F.isnan(x))


def has_inf(a: Column) -> Column:
    return F.exists(a, lambda x: F.abs(x) == float("inf"))


def silence_ratio(a: Column, level: float = SILENCE) -> Column:
    return F.coalesce(F.size(F.filter(a, lambda x: F.abs(x) < level)) / F.nullif(F.size(a), F.lit(0)), F.lit(1.0))


def max_jump(a: Column) -> Column:
    n = F.size(a)
    steps = F.zip_with(F.slice(a, 1, F.greatest(n - 1, F.lit(0))), F.slice(a, 2, F.greatest(n - 1, F.lit(0))), lambda x, y: F.abs(y.cast("double") - x.cast("double")))
    return F.when(n > 1, F.array_max(steps)).otherwise(_ZERO())


def first_active(a: Column, level: float = EDGE) -> Column:
    """1-based place of the first sample above the level; 0 if there is none."""
    return F.array_position(F.transform(a, lambda x: F.abs(x) > level), True)


def edge_silence(a: Column, rate: Column, level: float = EDGE) -> Column:
    whole = duration(a, rate)
    side = lambda x: F.when(first_active(x, level) > 0, F.coalesce(F.try_divide((first_active(x, level) - 1).cast("double"), rate), _ZERO())).otherwise(whole)
    return F.struct(side(a).alias("start"), side(F.reverse(a)).alias("end"))


def longest_silence(a: Column, rate: Column, level: float = SILENCE) -> Column:
    """Seconds of the longest run below the level."""
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))

    def step(s, x):
        now = F.when(F.abs(x) < level, s["now"] + 1).otherwise(F.lit(0))
        return F.struct(now.alias("now"), F.greatest(s["best"], now).alias("best"))

    return F.coalesce(F.try_divide(F.aggregate(a, start, step, lambda s: s["best"]).cast("double"), rate), _ZERO())


def stats(a: Column, rate: Column, channels: Column | None = None, subtype: Column | None = None, silence: float = SILENCE, edge: float = EDGE) -> Column:
    """All statistics of a clip as a struct."""
    return F.struct(
        rate.alias("sample_rate"), (F.lit(1) if channels is None else channels).alias("channels"), F.size(a).alias("frames"), duration(a, rate).alias("duration"),
        peak(a).alias("peak"), rms(a).alias("rms"), clipping(a).alias("clipping"), has_nan(a).alias("has_nan"), has_inf(a).alias("has_inf"),
        (F.lit(None).cast("string") if subtype is None else subtype).alias("subtype"), dc_offset(a).alias("dc_offset"), silence_ratio(a, silence).alias("silence_ratio"),
        max_jump(a).alias("max_sample_jump"), edge_silence(a, rate, edge).alias("edge_silence_seconds"), longest_silence(a, rate, silence).alias("longest_silence_seconds"),
    )


def _over(value: Column, limit) -> Column:
    """value > limit where NaN is never above."""
    return F.coalesce((value > limit) & ~F.isnan(value.cast("double")), F.lit(False))


def _under(value: Column, limit) -> Column:
    return F.coalesce((value < limit) & ~F.isnan(value.cast("double")), F.lit(False))


# The limits of the quality rules.
LOW_PEAK, LOW_RMS, HIGH_PEAK, HIGH_DC, MUCH_SILENCE, LONG_SILENCE, LONG_EDGE, HIGH_JUMP = 1e-5, 0.003, 0.98, 0.02, 0.65, 2, 1, 0.5
REFERENCE_SECONDS = (5, 15)
LEAST_SECONDS, LEAST_PER_CHARACTER, MOST_SECONDS, MOST_PER_CHARACTER = 0.2, 0.035, 15.0, 1.5


def audio_qc(s: Column, text: Column | None = None, reference: bool = False, rate: int = TARGET_RATE) -> Column:
    """status, failures and warnings of a stats struct; rules fire in the order they are listed."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    text = F.lit("") if text is None else F.coalesce(text, F.lit(""))
    n, long = F.length(text), s["duration"]
    failures = [
        (yes(s["sample_rate"] != rate), "sample_rate"), (yes(s["channels"] != 1), "non_mono"), (yes(s["has_nan"]), "nan"), (yes(s["has_inf"]), "inf"),
        (yes(s["clipping"]), "clipping"), (F.coalesce(s["frames"], F.lit(0)) == 0, "empty"), (~_over(F.coalesce(s["peak"], _ZERO()), LOW_PEAK) & ~F.isnan(F.coalesce(s["peak"], _ZERO())), "silence_only"),
    ]
    if not reference:
        failures.append((~yes(s["subtype"] == "PCM_24"), "not_pcm24"))
    edges = s["edge_silence_seconds"]
    warnings = [
        (_under(F.coalesce(s["rms"], _ZERO()), LOW_RMS), "low_energy"), (_over(s["peak"], HIGH_PEAK), "near_full_scale"), (_over(F.abs(s["dc_offset"]), HIGH_DC), "dc_offset"),
        (_over(s["silence_ratio"], MUCH_SILENCE), "excessive_silence_ratio"), (_over(s["longest_silence_seconds"], LONG_SILENCE), "long_silence"), (_over(edges["start"], LONG_EDGE), "start_silence"),
        (_over(edges["end"], LONG_EDGE), "end_silence"), (_over(s["max_sample_jump"], HIGH_JUMP), "waveform_discontinuity"),
    ]
    if reference:
        warnings += [(_under(long, REFERENCE_SECONDS[0]), "reference_too_short"), (_over(long, REFERENCE_SECONDS[1]), "reference_longer_than_preferred")]
    warnings += [
        ((n > 0) & _under(long, F.greatest(F.lit(LEAST_SECONDS), n * LEAST_PER_CHARACTER)), "suspiciously_short"), ((n > 0) & _over(long, F.greatest(F.lit(MOST_SECONDS), n * MOST_PER_CHARACTER)), "suspiciously_long"),
    ]
    fired = lambda rules: F.array_compact(F.array(*(F.when(c, name) for c, name in rules)))
    bad, odd = fired(failures), fired(warnings)
    return F.struct(F.when(F.size(bad) > 0, "FAIL").when(F.size(odd) > 0, "WARN").otherwise("PASS").alias("status"), bad.alias("failures"), odd.alias("warnings"))


def writable(a: Column, rate: Column) -> Column:
    """Why samples can't be written as a master; null if they can."""
    return (
        F.when(a.isNull() | (F.size(a) == 0), "empty").when(F.exists(a, lambda x: F.isnan(x) | (F.abs(x) == float("inf"))), "not_finite")
        .when(rate != TARGET_RATE, "sample_rate").when(peak(a) >= 1, "over_full_scale")
    )


def trim(a: Column, rate: Column, level: float = EDGE, pad_start: float = PAD_START, pad_end: float = PAD_END) -> Column:
    """Outer silence cut off, with some left on either side; null if all is silent."""
    n, first, last = F.size(a), first_active(a, level), F.size(a) - first_active(F.reverse(a), level) + 1
    start = F.greatest(F.lit(1), first - F.floor(rate * pad_start)).cast("int")
    end = F.least(n, last + F.floor(rate * pad_end)).cast("int")
    return F.when(first > 0, F.slice(a, start, end - start + 1))


def gain_to_peak(a: Column, peak_dbfs: float) -> Column:
    return F.when(peak(a) > 0, F.lit(peak_dbfs) - 20 * F.log10(peak(a)))


def gain_to_loudness(lufs: Column, true_peak: Column, target: Column, ceiling: Column) -> Column:
    """Gain to a loudness target that leaves the true peak under the ceiling (default -1)."""
    return F.least(target - lufs, F.coalesce(ceiling, F.lit(-1.0)) - true_peak)


def apply_gain(a: Column, db: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") * F.pow(F.lit(10.0), db / 20))


def concat_ordered(parts: Column, rate: Column, pause: float = 0.0) -> Column:
    """Arrays of structs (pos, samples) joined in order, with a pause between them."""
    ordered = F.transform(F.array_sort(parts), lambda p: p["samples"])
    gap = F.array_repeat(F.lit(0.0), F.round(rate * pause).cast("int"))
    return F.flatten(F.transform(ordered, lambda s, i: F.when(i > 0, F.concat(gap, s.cast("array<double>"))).otherwise(s.cast("array<double>"))))


def cosine(a: Column, b: Column) -> Column:
    """Null for vectors of other lengths, without length, or not finite; cut to -1..1."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), _ZERO(), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    fine = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0) & ~F.isnan(norm) & (norm < float("inf"))
    return F.when(fine, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norm)))


#: Outputs that a filter bank makes at once, so its windows take some 20 MB.
OUTPUTS = 1 << 16


@lru_cache(maxsize=16)
def bank(up: int, down: int, lobes: int = 10, beta: float = 5.0) -> np.ndarray:
    """A Kaiser-windowed sinc, band-limited to the lower rate, as one short filter for each phase of the raised grid."""
    top = max(up, down)
    half = lobes * top
    taps = np.sinc(np.arange(-half, half + 1) / top) * np.kaiser(2 * half + 1, beta)
    taps *= up / taps.sum()
    reach = -(-half // up)
    at = np.arange(up)[:, None] - np.arange(-reach, reach + 1)[None, :] * up + half
    return np.where((at >= 0) & (at <= 2 * half), taps[np.clip(at, 0, 2 * half)], 0.0)


def ratio(rate: int, target: int = TARGET_RATE) -> tuple[int, int]:
    g = math.gcd(int(rate), target)
    return target // g, int(rate) // g


def polyphase(x: np.ndarray, up: int, down: int, start: int = 0, before: np.ndarray | None = None, after: np.ndarray | None = None) -> np.ndarray:
    """The outputs whose place lies in ``x``, samples from ``start`` on of a clip, of which some are known before and after."""
    if not len(x):
        return np.zeros(0)
    filters = bank(up, down)
    reach = filters.shape[1] // 2
    edge = lambda e, keep: np.zeros(0) if e is None else np.asarray(e, np.float64)[keep]
    left, right = edge(before, slice(-reach, None)), edge(after, slice(None, reach))
    padded = np.concatenate([np.zeros(reach - len(left)), left, x, right, np.zeros(reach - len(right))])
    windows = np.lib.stride_tricks.sliding_window_view(padded, 2 * reach + 1)
    first, last = -(-start * up // down), -(-(start + len(x)) * up // down)
    out = np.empty(last - first)
    for at in range(first, last, OUTPUTS):
        n = np.arange(at, min(at + OUTPUTS, last))
        place, phase = np.divmod(n * down, up)
        out[at - first : at - first + len(n)] = np.einsum("ij,ij->i", windows[place - start], filters[phase])
    return out


def resampled(samples, rate: int, target: int = TARGET_RATE) -> np.ndarray:
    """Band-limited change of rate by a ratio of integers."""
    up, down = ratio(rate, target)
    x = np.asarray(samples, np.float64)
    return x if up == down else polyphase(x, up, down)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _resample(a: pa.Array, rates: pa.Array) -> pa.Array:
    out = [None if not x.is_valid or not r else resampled(x.values.to_numpy(zero_copy_only=False), r) for x, r in zip(a, rates.to_pylist(), strict=True)]
    return pa.array(out, pa.list_(pa.float64()))


def resample(a: Column, rate: Column) -> Column:
    """Samples at the rate of a master."""
    return _resample(a, rate)


def with_edges(chunks: DataFrame, clip: list[str], reach: int, part: str = "chunk", samples: str = "samples") -> DataFrame:
    """Chunks with the ``before`` and ``after`` of their neighbours: up to ``reach`` samples, which all chunks but the last have."""
    rest = [c for c in chunks.columns if c not in (*clip, part, samples)]
    none, a, n = F.lit(None).cast("array<double>"), F.col(samples).cast("array<double>"), F.size(samples)
    tail, head = F.slice(a, F.greatest(n - reach + 1, F.lit(1)), reach), F.slice(a, 1, reach)
    body = chunks.select(*clip, part, a.alias(samples), none.alias("before"), none.alias("after"), F.struct(F.lit(1).alias("_"), *rest).alias("_rest"))
    edge = lambda move, before, after: chunks.select(*clip, (F.col(part) + move).alias(part), none.alias(samples), before.alias("before"), after.alias("after"), F.lit(None).cast(body.schema["_rest"].dataType).alias("_rest"))
    every = body.unionByName(edge(1, tail, none)).unionByName(edge(-1, none, head))
    met = every.groupBy(*clip, part).agg(*(F.first(c, ignorenulls=True).alias(c) for c in (samples, "before", "after", "_rest")))
    return met.where("_rest IS NOT NULL").select(*clip, part, samples, "before", "after", *(f"_rest.{c}" for c in rest))


def resample_chunks(chunks: DataFrame, clip: list[str], rate: int, part: str = "chunk", start: str = "start", samples: str = "samples", target: int = TARGET_RATE) -> DataFrame:
    """Chunks of clips of one rate as chunks at another; each task holds a chunk and its neighbours' edges."""
    up, down = ratio(rate, target)
    if up == down:
        return chunks

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def change(a: pa.Array, before: pa.Array, after: pa.Array, starts: pa.Array) -> pa.Array:
        plain = lambda x: x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.zeros(0)
        return pa.array([polyphase(plain(x), up, down, s, plain(b), plain(f)) for x, b, f, s in zip(a, before, after, starts.to_pylist(), strict=True)], pa.list_(pa.float64()))

    edged = with_edges(chunks, clip, bank(up, down).shape[1] // 2, part, samples)
    out = edged.withColumn(samples, change(F.col(samples), F.col("before"), F.col("after"), F.col(start).cast("long")))
    return out.withColumn(start, F.ceil(F.col(start) * up / down)).drop("before", "after")
