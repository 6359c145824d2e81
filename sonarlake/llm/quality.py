"""Quality rules with cross-document line frequency, in JVM expressions only.

Base rules look at one document. The cross-document rule hashes the normalised lines of a document,
counts in how many distinct documents of the same host each line stands, takes lines above the limit
out of the texts, and rejects documents that lose more than a share of their words. Repeats of a line go with it, and lines
without a word stay; the share is that of distinct lines.

Defined cases: a null text has no words and fails the base rules. A null host is a host of its own.
Exact copies on one host count as one document, so a document is not lost for having copies. Repeated
rows are judged alike and all returned. Very long texts are judged whole, in one row. An empty table gives no rows. Line order, ties and extra columns have no influence; the
result carries ``id`` and the columns below only. ``text_left`` of a null text is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
MIN_WORDS = 50
#: A line is boilerplate of a host if this many of its distinct documents have it, and more than the share.
MIN_DOCS, SHARE = 10, 0.01
#: Share of its words that a document may lose.
MAX_LOSS = 0.5


#: A window's place takes the low bits of a packed long, the hash of its words the rest.
PLACE_BITS = 21


def words_of(text: Column) -> Column:
    body = F.btrim(text, F.lit(SPACES))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, "[\\x20\\x09-\\x0D]+"))


def lines_of(text: Column) -> Column:
    """Lines that have a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))


def _normal(line: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(line, "[\\x20\\x09-\\x0D]+", " ")))


def without_lines(text: Column, hashes: Column) -> Column:
    """The text without its lines of these hashes; without hashes the text itself."""
    left = F.filter(F.split(text, "\n"), lambda x: (_normal(x) == "") | ~F.array_contains(hashes, F.xxhash64(_normal(x))))
    return F.when(hashes.isNull(), text).otherwise(F.array_join(left, "\n"))


def _line_rows(text: Column) -> Column:
    """Distinct normalised lines as (hash, words)."""
    normal = F.transform(lines_of(text), _normal)
    return F.transform(F.array_distinct(normal), lambda x: F.struct(F.xxhash64(x).alias("h"), F.size(F.split(x, " ")).cast("long").alias("w")))


def with_repeat_words(docs: DataFrame) -> DataFrame:
    """Adds n_repeat_words: the words in 3-word windows that stand twice or more in ``_words``.

    Packed longs sort by hash, so equal windows are neighbours; the words themselves confirm a pair.
    Texts of 2**21 words or more keep hash and place apart.
    """
    low = F.lit((1 << PLACE_BITS) - 1).cast("long")
    words, n = F.col("_words"), F.size("_words")
    hashed = lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))
    packed = F.transform(F.slice(words, 1, F.greatest(n - 2, F.lit(0))), lambda w, i: hashed(w, i).bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long")))
    wide = F.transform(F.slice(words, 1, F.greatest(n - 2, F.lit(0))), lambda w, i: F.struct(hashed(w, i).alias("h"), i.cast("long").alias("i")))
    small = n < (1 << PLACE_BITS)
    out = docs.withColumn("_packed", F.when(small, F.sort_array(packed))).withColumn("_wide", F.when(~small, F.sort_array(wide)))

    def same(i, j):
        return (F.get(words, i) == F.get(words, j)) & (F.get(words, i + 1) == F.get(words, j + 1)) & (F.get(words, i + 2) == F.get(words, j + 2))

    def twin(x, y):
        return y.isNotNull() & (F.shiftright(x, PLACE_BITS) == F.shiftright(y, PLACE_BITS)) & same(x.bitwiseAND(low).cast("int"), y.bitwiseAND(low).cast("int"))

    def wide_twin(x, y):
        return y.isNotNull() & (x["h"] == y["h"]) & same(x["i"].cast("int"), y["i"].cast("int"))

    def beside(column, test):
        return F.filter(F.col(column), lambda x, i: test(x, F.get(F.col(column), i + 1)) | test(x, F.get(F.col(column), i - 1)))

    starts = F.when(small, F.transform(beside("_packed", twin), lambda x: x.bitwiseAND(low))).otherwise(F.transform(beside("_wide", wide_twin), lambda x: x["i"]))
    out = out.withColumn("_starts", F.sort_array(starts))
    covered = F.aggregate(
        F.transform(F.col("_starts"), lambda x, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get(F.col("_starts"), i + 1) - x, F.lit(3).cast("long")))),
        F.lit(0).cast("long"), lambda s, x: s + x,
    )
    return out.withColumn("n_repeat_words", F.when(F.size("_starts") > 0, covered).otherwise(F.lit(0)).cast("long")).drop("_packed", "_wide", "_starts")


def base_columns(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_line_words, n_repeat_words and base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("_lines", lines_of(t)).withColumn("_words", words_of(t)).withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.regexp_replace(t, "[#*$%&|<>]", ""))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_line_words": F.aggregate(_line_rows(t), F.lit(0).cast("long"), lambda s, x: s + x["w"]),
    })
    out = with_repeat_words(out.drop("_lines"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("_words")


def quality_rules(docs: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """id, the base columns, ``n_line_words`` and ``n_removed_words`` (words of distinct lines), ``kept``, ``text_left`` (without the host's common lines)."""
    name = F.coalesce(F.col(host).cast("string"), F.lit("\x00"))
    body = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(F.col(id), name.alias("_host"), body.alias("_text"), F.xxhash64(body).alias("_fp"), F.col(text).isNull().alias("_none"))
    base = base_columns(narrow, "_text")
    # Copies of a document on a host give equal rows; these merge before the shuffle and count once.
    lines = narrow.select("_host", "_fp", F.explode(_line_rows(F.col("_text"))).alias("x")).select("_host", "_fp", "x.h", "x.w").distinct()
    sizes = narrow.select("_host", "_fp").distinct().groupBy("_host").agg(F.count("*").alias("docs"))
    counts = lines.groupBy("_host", "h").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_DOCS)
    common = counts.join(sizes, "_host").where(F.col("n") > SHARE * F.col("docs")).select("_host", "h")
    removed = lines.join(common, ["_host", "h"]).groupBy("_host", "_fp").agg(F.sum("w").alias("n_removed_words"), F.collect_set("h").alias("_common"))
    out = base.join(removed, ["_host", "_fp"], "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)).cast("long"))
    depleted = F.col("n_removed_words") > MAX_LOSS * F.col("n_line_words")
    out = out.withColumn("kept", ~F.col("base_failed") & ~depleted).withColumn("text_left", F.when(~F.col("_none"), without_lines(F.col("_text"), F.col("_common"))))
    return out.drop("_host", "_fp", "_text", "_none", "_common")
