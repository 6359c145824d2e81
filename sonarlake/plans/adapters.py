"""Boundaries to what a data engine can't rebuild: synthesis, recognition, embeddings, loudness.

An adapter is a function from a list of requests to a list of results, run by mapInArrow with one
instance per worker. Without an adapter every row says UNAVAILABLE; no score is made up.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonarlake import ship

RECOGNITION = [("recognized", T.StringType(), pa.string())]
SYNTHESIS = [("samples", T.ArrayType(T.FloatType()), pa.list_(pa.float32())), ("sample_rate", T.IntegerType(), pa.int32()), ("generation_seconds", T.DoubleType(), pa.float64())]
EMBEDDING = [("embedding", T.ArrayType(T.FloatType()), pa.list_(pa.float32()))]
LOUDNESS = [("lufs", T.DoubleType(), pa.float64()), ("true_peak", T.DoubleType(), pa.float64())]

#: A factory builds the adapter once per worker; the adapter answers a batch of rows.
Factory = Callable[[], Callable[[list[dict]], list[dict]]]
_BUILT: dict = {}


def apply(df: DataFrame, fields: list, factory: Factory | None, name: str) -> DataFrame:
    """df with the adapter's fields, ``{name}_status`` (OK, ERROR or UNAVAILABLE) and ``{name}_error``."""
    if factory is None:
        none = {f: F.lit(None).cast(kind) for f, kind, _ in fields}
        return df.withColumns({**none, f"{name}_status": F.lit("UNAVAILABLE"), f"{name}_error": F.lit(None).cast("string")})
    schema = T.StructType([*df.schema.fields, *(T.StructField(f, kind) for f, kind, _ in fields), T.StructField(f"{name}_status", T.StringType()), T.StructField(f"{name}_error", T.StringType())])

    def work(batches):
        adapter = _BUILT.get((name, factory)) or _BUILT.setdefault((name, factory), factory())
        for b in batches:
            rows = b.to_pylist()
            try:
                out = [r | {f"{name}_status": "OK", f"{name}_error": None} for r in adapter(rows)]
            except Exception as exc:  # one bad batch is data, not the end of the job
                out = [{f"{name}_status": "ERROR", f"{name}_error": str(exc)}] * len(rows)
            extra = [pa.array([r.get(f) for r in out], kind) for f, _, kind in fields]
            extra += [pa.array([r[f"{name}_{k}"] for r in out], pa.string()) for k in ("status", "error")]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], schema.names)

    ship(df.sparkSession)
    return df.mapInArrow(work, schema)


def synthesize(attempts: DataFrame, factory: Factory | None = None) -> DataFrame:
    return apply(attempts, SYNTHESIS, factory, "synthesis")


def recognize(clips: DataFrame, factory: Factory | None = None) -> DataFrame:
    """Only the audio is handed over, never the expected text."""
    return apply(clips, RECOGNITION, factory, "recognition")


def embed(clips: DataFrame, factory: Factory | None = None) -> DataFrame:
    return apply(clips, EMBEDDING, factory, "embedding")


def measure_loudness(clips: DataFrame, factory: Factory | None = None) -> DataFrame:
    return apply(clips, LOUDNESS, factory, "loudness")
