"""The voice catalogue: lookups with fallback, audits, upserts, enrichment and promotion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonarlake.operators.validate import contained, safe_component, split_selection_key, usable_selection

# Defaults of a voice's metadata.
VOICE_DEFAULTS = {"provenance": "unknown", "source": "unknown"}
DEFAULT_STYLE = "neutral"


def styles(voices: DataFrame) -> DataFrame:
    """One row per voice and style; ``styles`` is a map from style to its entry."""
    return voices.select("id", "name", F.coalesce("default_style", F.lit(DEFAULT_STYLE)).alias("default_style"), F.explode("styles").alias("style", "entry"))


def lookup(lines: DataFrame, voices: DataFrame, character: str = "character_id") -> DataFrame:
    """Lines with their voice's columns (prefixed ``voice_``); a line without a voice carries an error."""
    named = voices.select(*(F.col(c).alias(f"voice_{c}") for c in voices.columns))
    joined = lines.join(named, F.col(character) == F.col("voice_id"), "left")
    return joined.withColumn("error_code", F.when(~safe_component(F.coalesce(character, F.lit(""))), "invalid_character").when(F.col("voice_id").isNull(), "voice_not_found"))


def resolve_style(requests: DataFrame, style_rows: DataFrame, character: str = "character_id", style: str = "style") -> DataFrame:
    """Requests with ``selected_style`` (theirs, or the voice's default) and its entry; ``error_code`` where it fails."""
    defaults = style_rows.select(F.col("id").alias("_id"), "default_style").distinct()
    wanted = requests.join(defaults, F.col(character) == F.col("_id"), "left")
    wanted = wanted.withColumn("selected_style", F.coalesce(F.nullif(F.col(style), F.lit("")), "default_style"))
    entries = style_rows.select(F.col("id").alias("_eid"), F.col("style").alias("_style"), "entry")
    joined = wanted.join(entries, (F.col("_id") == F.col("_eid")) & (F.col("selected_style") == F.col("_style")), "left")
    error = F.when(F.col("_id").isNull(), "voice_not_found").when(F.col("entry").isNull(), "style_not_found")
    return joined.withColumn("error_code", error).drop("_id", "_eid", "_style")


def reference_error(path: Column, root: Column, transcript: Column, recorded_sha256: Column, actual_sha256: Column) -> Column:
    return (
        F.when(~contained(path, root), "reference_unsafe").when(F.coalesce(F.btrim(transcript), F.lit("")) == "", "transcript_empty")
        .when(recorded_sha256.isNotNull() & ~F.coalesce(recorded_sha256 == actual_sha256, F.lit(False)), "reference_changed")
    )


def reference_identity(requests: DataFrame, style_rows: DataFrame, clips: DataFrame, character: str = "character_id", style: str = "style") -> DataFrame:
    """What a request's results depend on: hashes of the reference, its transcript and its voice, and the clip's verdict.

    style_rows: as ``styles`` gives them, with an entry of reference, transcript_text and reference_sha256. clips: path, sha256,
    stats and qc of decoded references (``workflows.inspect_qc`` with ``reference``). ``error_code`` says why a request has none.
    """
    found = resolve_style(requests, style_rows, character, style)
    voices = style_rows.groupBy(F.col("id").alias("_vid")).agg(
        F.sha2(F.to_json(F.struct(F.first("name"), F.first("default_style"), F.array_sort(F.collect_list(F.struct("style", "entry"))))), 256).alias("voice_sha256"))
    there = clips.select(F.col("path").alias("_path"), F.col("sha256").alias("_sha"), F.col("stats").alias("reference_audio"), F.col("qc").alias("reference_qc"))
    rows = found.join(there, F.col("entry.reference") == F.col("_path"), "left").join(voices, F.col(character) == F.col("_vid"), "left")
    spoken = F.btrim("entry.transcript_text")
    error = (
        F.when(F.col("_sha").isNull(), "reference_missing").when(F.coalesce(spoken, F.lit("")) == "", "transcript_empty")
        .when(F.col("entry.reference_sha256").isNotNull() & (F.col("entry.reference_sha256") != F.col("_sha")), "reference_changed")
        .when(F.col("reference_qc.status") == "FAIL", "reference_invalid")
    )
    rows = rows.withColumn("error_code", F.coalesce("error_code", error))
    fine = F.col("error_code").isNull()
    return rows.withColumns({
        "resolved_style": F.col("selected_style"), "reference_sha256": F.when(fine, F.col("_sha")), "reference_transcript": F.when(fine, spoken),
        "reference_transcript_sha256": F.when(fine, F.sha2(spoken, 256)), "voice_sha256": F.when(fine, F.col("voice_sha256")),
    }).drop("_path", "_sha", "_vid", "entry", "default_style", "selected_style")


def audit(rows: DataFrame, rate: int, min_seconds: float = 5.0, max_peak: float = 0.98) -> DataFrame:
    """Errors and warnings of style rows that have ``transcript`` and ``stats``."""
    s = F.col("stats")
    errors = F.array_compact(F.array(
        F.when(F.coalesce(F.btrim("transcript"), F.lit("")) == "", "empty_transcript"),
        F.when((s["sample_rate"] != rate) | (s["channels"] != 1) | s["has_nan"] | s["clipping"], "invalid_audio"),
    ))
    warnings = F.array_compact(F.array(F.when(s["duration"] < min_seconds, "reference_short"), F.when((s["peak"] > max_peak) & ~F.isnan(s["peak"]), "near_full_scale")))
    return rows.withColumns({"errors": errors, "warnings": warnings})


def audit_summary(audited: DataFrame, character: str = "id") -> DataFrame:
    return audited.agg(
        F.countDistinct(character).alias("characters"), F.count("*").alias("styles"),
        F.coalesce(F.sum(F.size("errors")), F.lit(0)).alias("errors"), F.coalesce(F.sum(F.size("warnings")), F.lit(0)).alias("warnings"),
    )


def upsert_styles(existing: DataFrame, new: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused): a style that exists isn't replaced."""
    return new.join(existing.select(*key), key, "left_anti"), new.join(existing.select(*key), key, "left_semi")


def latest(records: DataFrame, key: list[str], order: str) -> DataFrame:
    top = Window.partitionBy(*key).orderBy(F.col(order).desc())
    return records.withColumn("_n", F.row_number().over(top)).where("_n = 1").drop("_n")


def enrich(voices: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Missing metadata filled in, and whether that changed the row."""
    before = F.sha2(F.to_json(F.struct(*(F.col(c) for c in defaults))), 256)
    filled = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()}
    after = F.sha2(F.to_json(F.struct(*(filled[c].alias(c) for c in defaults))), 256)
    return voices.withColumn("changed", before != after).withColumns(filled)


#: Styles of an audition suite at most.
MAX_SUITE = 1000


def audition_plan(characters: DataFrame, styles_: DataFrame | None, candidates: int) -> DataFrame:
    """Characters by styles by candidate numbers. The style table is a list of at most MAX_SUITE rows, written into the plan."""
    rows = characters
    if styles_ is not None:
        suite = styles_.limit(MAX_SUITE + 1).collect()
        if len(suite) > MAX_SUITE:
            raise ValueError(f"a suite of more than {MAX_SUITE} styles; split it")
        each = F.array(*(F.struct(*(F.lit(r[c]).cast(kind).alias(c) for c, kind in styles_.dtypes)) for r in suite)) if suite else F.array().cast(f"array<{styles_.schema.simpleString()}>")
        rows = characters.select("*", F.explode(each).alias("_style")).select(*characters.columns, "_style.*")
    return rows.withColumn("candidate", F.explode(F.sequence(F.lit(1), F.lit(candidates))))


def promote(selections: DataFrame, cast: DataFrame, key: str = "selection_key", choice: str = "choice", character: str = "id") -> DataFrame:
    """Usable selections with their cast row; a selection of an unknown character carries an error."""
    who, style = split_selection_key(F.col(key))
    chosen = selections.where(usable_selection(F.col(choice))).withColumns({"character": who, "style": F.coalesce(style, F.lit(DEFAULT_STYLE))})
    named = cast.withColumn("_known", F.lit(True))
    joined = chosen.join(named, F.col("character") == F.col(character), "left")
    return joined.withColumn("error_code", F.when(F.col("_known").isNull(), "unknown_character")).drop("_known")
