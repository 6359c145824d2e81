"""Lossless segmentation of long texts at sentence and clause ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns and limits.
SENTENCE = r"""[^。！？!?\n]+(?:[。！？!?\n]+[”’」』"']*)?|[。！？!?\n]+[”’」』"']*"""
CLAUSE = r"[^，,；;：:]+[，,；;：:]*|[，,；;：:]+"
MIN_CHARS, MAX_CHARS, DEFAULT_CHARS = 20, 500, 120


def sentences(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))


def clauses(sentence: Column) -> Column:
    return F.regexp_extract_all(sentence, F.lit(CLAUSE), F.lit(0))


def _packed(sentence: Column, limit: int) -> Column:
    """Clauses of a sentence, joined greedily up to the limit; null if one clause is longer."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))
    each = clauses(sentence)
    step = lambda s, c: F.when(
        (s["now"] != "") & (F.length(s["now"]) + F.length(c) > limit),
        F.struct(F.array_append(s["done"], s["now"]).alias("done"), c.alias("now")),
    ).otherwise(F.struct(s["done"].alias("done"), F.concat(s["now"], c).alias("now")))
    last = lambda s: F.when(s["now"] != "", F.array_append(s["done"], s["now"])).otherwise(s["done"])
    # The clauses are found once: a transform over an array of one binds them.
    packed = lambda cs: F.when(F.exists(cs, lambda c: F.length(c) > limit), F.lit(None)).otherwise(F.aggregate(cs, empty, step, last))
    return F.element_at(F.transform(F.array(each), packed), 1)


def segments(text: Column, max_chars: int = DEFAULT_CHARS) -> Column:
    """The segments in order; null where a clause is over the limit, so the text needs a natural pause."""
    if not MIN_CHARS <= max_chars <= MAX_CHARS:
        raise ValueError(f"max_chars must be {MIN_CHARS} to {MAX_CHARS}")
    each = F.transform(sentences(text), lambda s: F.when(F.length(s) <= max_chars, F.array(s)).otherwise(_packed(s, max_chars)))
    # Flattening an array that holds a null gives null.
    return F.when(F.btrim(text) != "", F.flatten(each))


def segment_rows(df: DataFrame, text: str = "text", max_chars: int = DEFAULT_CHARS) -> DataFrame:
    """df by segment: ``segment_id``, ``pos`` and ``segment``; a text that can't be cut is one row with an error."""
    out = df.withColumn("_s", segments(F.col(text), max_chars))
    rows = out.select(*df.columns, F.posexplode_outer("_s").alias("pos", "segment"))
    # The parts must give back the text; blank and uncuttable texts are told apart.
    error = F.when(F.coalesce(F.btrim(F.col(text)), F.lit("")) == "", "empty_text").when(F.col("segment").isNull(), "clause_too_long")
    return rows.withColumns({"segment_id": F.when(F.col("pos").isNotNull(), F.format_string("segment_%04d", F.col("pos") + 1)), "error_code": error})


def preserves(text: Column, parts: Column) -> Column:
    """Whether ordered parts give back the text."""
    return F.array_join(parts, "") == text
