"""URL filtering by host-suffix / path-prefix expressions and short hash prefixes.

Every distinct URL is expanded into the expressions that a rule could name: the right-most labels of
its host joined to a prefix of its path. Expressions meet the rules in an equi-join on the first 32
bits of their SHA-256; the full digest is confirmed afterwards, so a colliding prefix never decides.
Only JVM expressions are used, and only label counts and path lengths that some rule has are expanded,
so the work per URL is bounded by the rule table and not by the URL.

Defined cases: a null URL, or one without ``://``, has an empty host and path and fits no rule.
Repeated rows are each returned. A URL whose path is empty fits only rules with an empty path. Among
fitting rules the longest (host plus path) wins; between equally long ones ``block`` does. A very long URL is expanded
by the shapes that rules have only. An empty table of pages or rules gives no rows or no rule. Columns of
the input that clash with an output column are replaced; all others are kept by ``url_filter``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hex digits of the digest that the join uses.
PREFIX_HEX = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty where there is no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    empty = F.lit("")
    return F.coalesce(F.translate(host, UPPER, LOWER), empty), F.coalesce(path, empty)


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) tuples as a table whose size Spark knows."""
    values = ", ".join("({}, {}, {})".format(*("'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for x in r)) for r in rules)
    return spark.sql(f"SELECT * FROM VALUES {values or '(\"\", \"\", \"\")'} AS t(host, path, verdict)").where("host <> ''")


def _expressions(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    n = F.size(F.split(host, r"\."))
    out = []
    for k in labels:
        suffix = F.when((n >= k) & (host != ""), F.substring_index(host, ".", -k))
        out += [F.when(F.length(path) >= size, F.concat(suffix, F.substring(path, 1, size))) for size in lengths]
    return F.array_compact(F.array(*out))


def url_filter(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``."""
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("rh"), F.coalesce("path", F.lit("")).alias("rp"), F.col("verdict").alias("rv"))
    rules = rules.where("rh IS NOT NULL AND rv IS NOT NULL").withColumn("expr", F.concat("rh", "rp"))
    # One row of two small sets: the shapes that rules have.
    shapes = rules.agg(F.collect_set(F.size(F.split("rh", r"\."))), F.collect_set(F.length("rp"))).first()
    labels, lengths = sorted(shapes[0]), sorted(shapes[1])
    parts = dict(zip(("host", "path"), host_and_path(F.col(url)), strict=True))
    pages = pages.drop("rule", "verdict", "host", "path") if {"rule", "verdict", "host", "path"} & set(pages.columns) else pages
    if not labels:
        return pages.withColumns(parts).withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    digest = F.sha2(F.col("expr"), 256)
    keyed = rules.select("expr", "rv", digest.alias("rd"), F.substring(digest, 1, PREFIX_HEX).alias("rk"))
    wanted = (
        pages.select(F.col(url).alias("u")).where("u IS NOT NULL").distinct()
        .select("u", *(c.alias(n) for n, c in zip(("h", "p"), host_and_path(F.col("u")), strict=True)))
        .select("u", F.explode(_expressions(F.col("h"), F.col("p"), labels, lengths)).alias("expr"))
        .select("u", digest.alias("d"))
        .withColumn("k", F.substring("d", 1, PREFIX_HEX))
    )
    best = (
        wanted.join(keyed, F.col("k") == F.col("rk")).where("d = rd")
        .groupBy("u").agg(F.max(F.struct(F.length("expr").alias("n"), (F.col("rv") == "block").alias("b"), "expr", "rv")).alias("w"))
        .select("u", F.col("w.expr").alias("rule"), F.col("w.rv").alias("rv"))
    )
    joined = pages.join(best, F.col(url) == F.col("u"), "left")
    return joined.withColumns(parts).withColumn("verdict", F.coalesce("rv", F.lit(default))).drop("u", "rv")
