"""Connected components on DataFrames."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonarlake.llm.session import checkpointed, map_slices

MAX_ROUNDS = 60
#: Edges (two longs each) that one task joins by itself; the rounds for so few cost more than their work.
SMALL = 100_000


def _joined(pairs: DataFrame) -> DataFrame:
    """(node, component) of few edges, in one task."""

    def work(batches):
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = parent[up]
                x = up
            return x

        for b in batches:
            for u, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
                p, q = top(u), top(v)
                if p != q:
                    parent[max(p, q)] = min(p, q)
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], ["node", "component"])

    return map_slices(pairs.coalesce(1), work, "node long, component long")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", small: int = SMALL) -> DataFrame:
    """(node, component): the least node that each node of ``edges`` can reach.

    Defined cases: an edge from a node to itself says nothing; repeated edges count once; no edges give no rows; nulls and ties of
    nodes don't occur, as nodes are longs and components their least. Up to ``small`` edges are joined in one task, with equal rows.

    Alternating stars: a node's larger neighbours, then its smaller ones, are hung on the least of its
    neighbours, until nothing moves; the number of rounds grows with the logarithm of the longest chain.
    Minima are pre-aggregated and joins are plain equi-joins, so a node with very many neighbours is split
    like any skewed key. Each round is checkpointed; only counts and a checksum reach the driver.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    pairs = checkpointed(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if pairs.count() <= small:
        return _joined(pairs)
    state = None
    for _ in range(MAX_ROUNDS):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = pairs.select(F.col("v").alias("x"), F.col("u").alias("y")).join(least.withColumnRenamed("u", "x"), "x").select(F.col("y").alias("u"), F.col("m").alias("v"))
        # A node whose least is a neighbour keeps that link itself.
        own = least.where("m < u").select("u", F.col("m").alias("v"))
        stars = large.unionByName(own).where("u <> v").distinct()
        low = stars.groupBy("u").agg(F.min("v").alias("m"))
        small = stars.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        pairs = checkpointed(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components didn't settle in {MAX_ROUNDS} rounds")
    out = pairs.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = out.select(F.col("component").alias("node"), "component").distinct()
    return out.unionByName(roots)
