"""Sinks: append-only tables and files that are written once."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonarlake.functions import signal
from sonarlake.shared import checkpointed
from sonarlake.sources import clips


def not_finite(df: DataFrame) -> Column:
    """Whether a row holds a NaN or infinity, which JSON can't hold."""
    bad = [F.isnan(c) | (F.abs(c) == float("inf")) for c, kind in df.dtypes if kind in ("double", "float")]
    out = F.lit(False)
    for b in bad:
        out = out | F.coalesce(b, F.lit(False))
    return out


def write_json(df: DataFrame, path: str, exclusive: bool = True) -> DataFrame:
    """Writes the finite rows; the others are returned. Exclusive: refuses a path that exists. The input is worked out once."""
    rows = checkpointed(df)
    bad = not_finite(rows)
    rows.where(~bad).write.mode("errorifexists" if exclusive else "overwrite").json(path)
    return rows.where(bad)


def append_events(df: DataFrame, path: str) -> None:
    """Events as JSON lines, with their UTC time, that a stream can read."""
    df.withColumn("time", F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")).write.mode("append").json(path)


def append_lines(df: DataFrame, path: str) -> None:
    """Finished lines of a batch, by project and revision; the state of a batch is read from them."""
    df.write.mode("append").partitionBy("project", "revision").parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def selection_index(attempts: DataFrame, line: list[str]) -> DataFrame:
    """Per line the recommended attempt and all ranked ones, as a derived view."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", "candidate", "output", "qc", "cer")))
    return attempts.groupBy(*line).agg(
        F.max(F.when(F.col("recommended"), F.col("candidate"))).alias("recommended_candidate"), F.max(F.when(F.col("recommended"), F.col("output"))).alias("recommended_output"),
        F.lit(True).alias("human_review_required"), ranked.alias("candidates"),
    )


def report_json(df: DataFrame) -> DataFrame:
    """Rows as JSON text, one each."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def encode_wav(samples: list[float], rate: int) -> bytes:
    """A mono PCM_24 file; samples have passed the write gate."""
    body = clips.pcm24(samples)
    return clips.wav_header(len(body) // 3, rate) + body + b"\0" * (len(body) % 2)


@F.arrow_udf(T.BinaryType())
def _encoded(a: pa.Array, rates: pa.Array) -> pa.Array:
    return pa.array([encode_wav(x.values.to_numpy(zero_copy_only=False), r) if x.is_valid else None for x, r in zip(a, rates.to_pylist(), strict=True)], pa.binary())


def encoded(rows: DataFrame, samples: str = "samples", rate: str = "sample_rate") -> DataFrame:
    """Clips with ``wav``, for those that pass the write gate; ``error_code`` for the others."""
    out = rows.withColumn("error_code", signal.writable(F.col(samples), F.col(rate)))
    return out.withColumn("wav", _encoded(F.when(F.col("error_code").isNull(), F.col(samples)), F.col(rate)))
