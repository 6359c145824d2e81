"""Registered queries against their SQL on small tables that the driver's data don't have: odd values, repeated names, many tasks."""

import duckdb
from test_queries import rows_of

from sonarlake.plans import files  # noqa: F401  registers its queries
from sonarlake.plans.queries import ORACLE_SQL, QUERIES


def same_as_sql(spark, folder, name, **tables):
    """Tables are (schema, rows); both sides read the same files."""
    con = duckdb.connect()
    for t, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got, want = QUERIES[name](spark, str(folder)).toPandas(), con.execute(ORACLE_SQL[name]).df()
    assert len(want) and rows_of(got) == rows_of(want)
    return got


def test_prices_of_any_value(spark, tmp_path):
    """A zero with a sign, more decimals than cents (some end in 5), and what isn't there."""
    values = [-0.0, 0.0, -0.004, 1.005, 0.285, -3.335, 17.0, 9999.995, 4480.835, None, 1234.5]
    rows = list(enumerate(values))
    same_as_sql(spark, tmp_path, "number_reading_price", part=("p_partkey long, p_retailprice double", rows), customer=("c_custkey long, c_acctbal double", rows))


def test_sidecars_of_many_tasks(spark, tmp_path):
    """Each clip meets its metadata, whichever task wrote it; names that repeat, and a negative key."""
    rows = [(k, f"Supplier#{k % 40:09d}", k % 25, 1.0) for k in range(-1, 60)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        same_as_sql(spark, tmp_path, "sidecar_files", supplier=("s_suppkey long, s_name string, s_nationkey int, s_acctbal double", rows))
        unique = [(k, f"Supplier#{k:09d}", k % 25, 1.0) for k in range(60)]
        got = same_as_sql(spark, tmp_path, "sidecar_files", supplier=("s_suppkey long, s_name string, s_nationkey int, s_acctbal double", unique))
        assert got["qc"].notna().sum() == 40
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
