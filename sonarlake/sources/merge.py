"""Merging rows into a table of partitions: only partitions that change are written, the latest version of a key wins.

The table is a folder of Parquet partitions by ``by``, a column that a key decides (``bucket_of`` makes one). Updates are held
against the keys of the partitions that they name; what changes is written with the rest of its partition, all other
partitions keep their files. A row whose version isn't newer than what is there, but whose content differs, is a conflict
and is returned as such, never written.

Defined cases: of updates that repeat a key the latest version counts, and of equal versions the greatest content; those
before it are ``superseded``. Rows equal to what is there are ``same`` and cause no write. Null keys and versions are refused
(``invalid``). No updates change nothing. A table that isn't there is made. Columns of updates are those of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonarlake.shared import checkpointed
from sonarlake.sources import store


def bucket_of(key: list[str], buckets: int) -> Column:
    """A partition that a key decides."""
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def _exists(path: str) -> bool:
    fs, inner = store.opened(path)
    return fs.get_file_info(f"{inner}/_SUCCESS").type.name != "NotFound"


def planned(table: DataFrame | None, updates: DataFrame, key: list[str], version: str, by: str) -> DataFrame:
    """The updates with ``action``: insert, replace, same, conflict, superseded or invalid."""
    content = F.to_json(F.struct(*sorted(c for c in updates.columns if c != version)))
    valid = ~F.greatest(*(F.col(c).isNull() for c in (*key, version, by)))
    newest = Window.partitionBy("_valid", *key).orderBy(F.col(version).desc(), F.col("_content").desc())
    rows = updates.withColumns({"_content": content, "_valid": valid})
    rows = rows.withColumn("_n", F.row_number().over(newest))
    if table is None:
        action = F.when(F.col("_n") > 1, "superseded").otherwise("insert")
        return rows.withColumn("action", F.when(~F.col("_valid"), "invalid").otherwise(action)).drop("_content", "_valid", "_n")
    # Only the partitions that updates name are read: their values prune the scan.
    touched = table.join(F.broadcast(updates.select(by).distinct()), by, "left_semi")
    there = touched.select(*(F.col(c).alias(f"_k{n}") for n, c in enumerate(key)), F.col(version).alias("_v"), F.to_json(F.struct(*sorted(c for c in updates.columns if c != version))).alias("_c"))
    same_key = [F.col(c) == F.col(f"_k{n}") for n, c in enumerate(key)]
    joined = rows.join(there, same_key, "left")
    action = (
        F.when(~F.col("_valid"), "invalid").when(F.col("_n") > 1, "superseded").when(F.col("_v").isNull(), "insert").when(F.col("_content") == F.col("_c"), "same")
        .when(F.col(version) > F.col("_v"), "replace").otherwise("conflict")
    )
    return joined.withColumn("action", action).drop("_content", "_valid", "_n", "_v", "_c", *(f"_k{n}" for n in range(len(key))))


def merge(updates: DataFrame, path: str, key: list[str], version: str, by: str, buckets: int | None = None) -> DataFrame:
    """Merges the updates into the table at ``path`` and returns them with their ``action``.

    With ``buckets`` the partition column is made of the key. Changed partitions are replaced as a whole, each at once.
    """
    spark = updates.sparkSession
    if buckets:
        updates = updates.withColumn(by, bucket_of(key, buckets))
    table = spark.read.parquet(path) if _exists(path) else None
    if table is not None:
        table = table.select(*updates.columns)
    plan = checkpointed(planned(table, updates, key, version, by))
    changes = plan.where("action IN ('insert', 'replace')").drop("action")
    if table is None:
        changes.repartition(by).write.partitionBy(by).mode("errorifexists").parquet(path)
        return plan
    parts = changes.select(by).distinct()  # at most the table's partitions
    rest = table.join(F.broadcast(parts), by, "left_semi").join(changes.select(*key), key, "left_anti").select(*updates.columns)
    # The new partitions are made before any is replaced, so they don't read what they write.
    new = checkpointed(rest.unionByName(changes))
    if not new.isEmpty():
        new.repartition(by).write.partitionBy(by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    return plan
