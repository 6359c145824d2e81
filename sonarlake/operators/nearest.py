"""The nearest vectors of other labels, for given queries: blocks of queries meet blocks of rows, and tasks multiply matrices.

A cell is a block of queries and a block of rows. Its task finds, tile by tile, the rows that can be among a query's nearest
by rounded cosine and id, with a margin for what products in another order change; ``signal.cosine`` then decides among the few
candidates of all cells. Work is queries times rows, as every row is looked at for every query; memory is a cell's.

Defined cases: pairs without a cosine (``signal.cosine``) come after all others. Ties go by id, null ids last. Of equal vectors
with one label only the least ids can be nearest, so a cell looks at those. Rows without a label are near to none. Rows that
repeat count each; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonarlake.functions import signal

#: Queries and rows of a cell, and of a tile in it.
QUERIES, ROWS, TILE_QUERIES, TILE_ROWS = 32_768, 65_536, 512, 8_192
#: Cosines are rounded to millionths; products of matrices are right to much less than MARGIN millionths.
STEPS, MARGIN, NONE = 1e6, 1e-3, -2.0


def _matrix(column: pa.ChunkedArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of this size as doubles, and whether they have a length; other rows are zeros."""
    lists = pa.concat_arrays(column.chunks)
    out = np.zeros((len(lists), size))
    has = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False) == size
    values = pc.fill_null(lists.values.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    starts = lists.offsets.to_numpy()[:-1][has]
    out[has] = values[starts[:, None] + np.arange(size)]
    with np.errstate(invalid="ignore", over="ignore"):
        norm = np.sqrt((out * out).sum(axis=1))
    fine = np.isfinite(norm) & (norm > 0)
    out[~fine] = 0
    return out, fine


def _least_of_equals(values: np.ndarray, label: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k least ids of each vector and label, by labels."""
    whole = np.ascontiguousarray(np.column_stack([values.view(np.int64), label]))
    _, kind = np.unique(whole.view(np.dtype((np.void, whole.shape[1] * 8))).ravel(), return_inverse=True)
    order = np.lexsort((ids, kind))
    kind = kind[order]
    first = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
    place = np.arange(len(kind)) - np.repeat(first, np.diff(np.append(first, len(kind))))
    kept = order[place < k]
    return kept[np.argsort(label[kept], kind="stable")]


def _reduced(q: np.ndarray, r: np.ndarray, s: np.ndarray, ids: np.ndarray, k: int, least: np.ndarray):
    """What can still be among the k nearest of its query; ``least`` gets the product that further rows need."""
    low, high = np.rint(s * STEPS - MARGIN), np.rint(s * STEPS + MARGIN)
    order = np.lexsort((ids[r], -low, q))
    q, r, s, low, high = q[order], r[order], s[order], low[order], high[order]
    first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(q)))
    full = np.repeat(size >= k, size)
    last = np.repeat(np.minimum(first + k - 1, len(q) - 1), size)
    stays = ~full | (high > low[last]) | ((high == low[last]) & (ids[r] <= ids[r][last]))
    done = first[size >= k]
    least[q[done]] = (low[done + k - 1] - 0.5 - 2 * MARGIN) / STEPS
    return q[stays], r[stays], s[stays]


def _places(rows: pa.Table, asks: pa.Table, size: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidates (place of the query, place of the row) for queries of vectors of one size."""
    ids = pc.fill_null(rows.column("vec_id"), (1 << 63) - 1).to_numpy()
    label, own = rows.column("label").to_numpy().astype(np.int64), asks.column("own").to_numpy().astype(np.int64)
    values, fine = _matrix(rows.column("embedding"), size)
    kept = _least_of_equals(values, label, ids, k)
    values, fine, label, ids = values[kept], fine[kept], label[kept], ids[kept]
    norm = lambda m: m / np.maximum(np.sqrt((m * m).sum(axis=1)), 1e-300)[:, None]
    values = norm(values)
    asked, sound = _matrix(asks.column("q"), size)
    asked = norm(asked)
    found_q, found_r = [], []
    for a in range(0, len(asked), TILE_QUERIES):
        part, mine, ok = asked[a : a + TILE_QUERIES], own[a : a + TILE_QUERIES], sound[a : a + TILE_QUERIES]
        least = np.full(len(part), NONE - 1)
        q, r, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        of = {x: np.flatnonzero(mine == x) for x in np.unique(mine).tolist()}
        for b in range(0, len(values), TILE_ROWS):
            near = part @ values[b : b + TILE_ROWS].T
            near[:, ~fine[b : b + TILE_ROWS]] = NONE
            near[~ok] = NONE
            here = label[b : b + TILE_ROWS]
            for x, places in of.items():
                c, d = np.searchsorted(here, x, "left"), np.searchsorted(here, x, "right")
                if c < d:
                    near[places, c:d] = -np.inf
            new = np.flatnonzero(least < NONE)
            if len(new) and near.shape[1] > k:
                kth = np.partition(near[new], -k, axis=1)[:, -k]
                least[new] = np.maximum(least[new], kth - (1 + 2 * MARGIN) / STEPS)
            i, j = np.nonzero(near >= least[:, None])
            q, r, s = _reduced(np.concatenate([q, i]), np.concatenate([r, j + b]), np.concatenate([s, near[i, j]]), ids, k, least)
        found_q.append(q + a)
        found_r.append(kept[r])
    return np.concatenate(found_q), np.concatenate(found_r)


def candidates(rows: DataFrame, queries: DataFrame, k: int, query_block: int = QUERIES, row_block: int = ROWS) -> DataFrame:
    """(query_id, q, vec_id, embedding): pairs of other labels among which the k nearest of each query are."""
    rows, queries = rows.where("label IS NOT NULL"), queries.where("own IS NOT NULL")
    across = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // row_block))
    down = max(1, -(-queries.count() // query_block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = rows.withColumn("across", dealt("vec_id", across)).withColumn("down", every(down)).repartition(across * down, "across", "down")
    right = queries.withColumn("down", dealt("query_id", down)).withColumn("across", every(across)).repartition(across * down, "across", "down")

    def cell(here: pa.Table, asks: pa.Table) -> pa.Table:
        q, r = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if here.num_rows and asks.num_rows:
            sizes = pc.fill_null(pc.list_value_length(asks.column("q")), -1).to_numpy()
            for size in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == size)
                i, j = _places(here, asks.take(own), max(size, 0), k)
                q.append(own[i])
                r.append(j)
        a, b = asks.take(np.concatenate(q)), here.take(np.concatenate(r))
        return pa.table({"query_id": a.column("query_id"), "q": a.column("q"), "vec_id": b.column("vec_id"), "embedding": b.column("embedding")})

    schema = queries.select("query_id", "q").schema.fields + rows.select("vec_id", "embedding").schema.fields
    return left.groupBy("across", "down").cogroup(right.groupBy("across", "down")).applyInArrow(cell, type(rows.schema)(schema))


def nearest(rows: DataFrame, queries: DataFrame, k: int, **blocks: int) -> DataFrame:
    """(query_id, vec_id, similarity, rank): the k nearest of rows (vec_id, label, embedding) to each of queries (query_id, own, q) with another label."""
    found = candidates(rows.select("vec_id", "label", "embedding"), queries.select("query_id", "own", "q"), k, **blocks)
    scored = found.select("query_id", "vec_id", F.round(signal.cosine(F.col("q"), F.col("embedding")), 6).alias("similarity"))
    best = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), F.col("vec_id").asc_nulls_last())
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
