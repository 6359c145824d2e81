"""Places in a global order, and ordered documents, without bringing rows together.

Rows are dealt by ranges of their keys and sorted within them; a row's rank is its place in its range and the number of
rows in the ranges before. Only those numbers, one for each range, reach the driver. A document with ordered rows is
written as a stream of parts (``sources.store.write_files``), so no list of its rows is built.

Defined cases: rows that repeat are told apart by a row number, so equal rows are dealt and ranked like others and one key
may have most rows. Null keys come first, as in Spark's order. An empty table has no ranks.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonarlake.shared import checkpointed


def with_rank(rows: DataFrame, order: list[str | Column], rank: str = "rank") -> DataFrame:
    """Adds ``rank`` (from 1) by the order."""
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    keys = [*order, "_row"]
    sorted_ = numbered.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_row").withColumn("_at", F.monotonically_increasing_id())
    placed = checkpointed(sorted_.withColumns({"_range": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND((1 << 33) - 1)}))
    sizes = sorted(tuple(r) for r in placed.groupBy("_range").count().collect())
    starts = list(zip([r for r, _ in sizes], accumulate([0, *(n for _, n in sizes)]), strict=False))
    before = rows.sparkSession.createDataFrame(starts, "_range long, _start long")
    return placed.join(F.broadcast(before), "_range").withColumn(rank, F.col("_start") + F.col("_at") + 1).drop("_range", "_at", "_start")


def document(rows: DataFrame, name: list[str], order: list[str | Column], text: Column, head: Column | str = "", tail: Column | str = "", between: str = "") -> DataFrame:
    """Rows (name, part, content) of documents: a head, the texts of rows by ``order`` with ``between`` them, and a tail.

    The name's columns are joined by slashes; head and tail may depend on them. A document is one file, so one task writes it;
    its rows pass through a window, which sorts them on disk, and a stream.
    """
    column = lambda c: F.lit(c) if isinstance(c, str) else c
    whole = F.concat_ws("/", *(F.col(c).cast("string") for c in name)).alias("name")
    place = F.row_number().over(Window.partitionBy(*name).orderBy(*order)).cast("long")
    body = rows.select(whole, place.alias("part"), text.alias("_t")).select("name", "part", F.when(F.col("part") > 1, F.concat(F.lit(between), "_t")).otherwise(F.col("_t")).alias("content"))
    ends = rows.select(*name).distinct().select(whole, F.inline(F.array(
        F.struct(F.lit(0).cast("long").alias("part"), column(head).alias("content")), F.struct(F.lit((1 << 63) - 1).alias("part"), column(tail).alias("content")))))
    return body.unionByName(ends)
