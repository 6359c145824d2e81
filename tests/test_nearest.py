"""The nearest vectors of other labels: candidates of cells and tiles against all pairs."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sonarlake.functions import signal
from sonarlake.operators import nearest


def vectors(n=400, size=6, seed=2):
    """Coarse vectors, so many cosines tie; copies, vectors without a cosine, ids and labels that repeat or are null."""
    rng = np.random.default_rng(seed)
    out = [(int(k), rng.integers(-2, 3, size).astype(float).tolist(), int(rng.integers(0, 4))) for k in range(n)]
    out += [(n + k, out[3][1], out[3][2]) for k in range(60)]
    odd = [None, [], [0.0] * size, [float("nan")] * size, [1.0] * (size + 1), [1.0, None] + [2.0] * (size - 2), [float("inf")] + [1.0] * (size - 1)]
    out += [(2000 + 50 * k, v, k % 4) for k, v in enumerate(odd)]
    return [*out, (50, [1.0] * size, 1), (None, [1.0] * size, 2), (150, [2.0] * size, None), (100, [1.0, 2.0], 9)]


@pytest.mark.parametrize("blocks", [{}, {"query_block": 3, "row_block": 70}])
def test_against_all_pairs(spark, blocks):
    rows = spark.createDataFrame(vectors(), "vec_id long, embedding array<float>, label int")
    queries = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"), F.col("embedding").alias("q"))
    pairs = rows.join(queries, F.col("label") != F.col("own")).select("query_id", "vec_id", F.round(signal.cosine(F.col("q"), F.col("embedding")), 6).alias("similarity"))
    best = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), F.col("vec_id").asc_nulls_last())
    want = pairs.withColumn("rank", F.row_number().over(best)).where("rank <= 3")
    got = nearest.nearest(rows, queries, 3, **blocks)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str) and want.count() > 40
    assert nearest.nearest(rows.limit(0), queries, 3).count() == nearest.nearest(rows, queries.limit(0), 3).count() == 0


def test_tiles_leave_few_pairs(monkeypatch):
    """Candidates are a handful for each query, in whatever tiles, and have the nearest of all pairs among them."""
    rng = np.random.default_rng(5)
    m, label = rng.normal(size=(900, 8)), rng.integers(0, 3, 900)
    lists = lambda x: pa.array(x.tolist(), pa.list_(pa.float32()))
    rows = pa.table({"vec_id": pa.array(np.arange(900)), "label": pa.array(label, pa.int32()), "embedding": lists(m)})
    asks = pa.table({"query_id": pa.array(np.arange(0, 900, 50)), "own": pa.array(label[::50], pa.int32()), "q": lists(m[::50])})
    unit = m / np.linalg.norm(m, axis=1)[:, None]
    for tile in (900, 37):
        monkeypatch.setattr(nearest, "TILE_ROWS", tile)
        monkeypatch.setattr(nearest, "TILE_QUERIES", 5)
        q, r = nearest._places(rows, asks, 8, 3)
        assert len(q) <= 4 * 18
        for k in range(18):
            s = np.where(label == label[50 * k], -9, unit @ unit[50 * k])
            assert set(np.argsort(-s)[:3].tolist()) <= set(r[q == k].tolist())
