"""Reports: benchmark and calibration aggregates, audits and listening pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonarlake.functions.align import MIN_SAMPLES
from sonarlake.functions.signal import HIGH_PEAK, TARGET_RATE
from sonarlake.operators.ordered import document, with_rank
from sonarlake.operators.policy import first_occurrence


def benchmark_rows(takes: DataFrame) -> DataFrame:
    """Metadata of takes as report rows: copied metrics, a pass flag, and ratings still to be given."""
    ratings = ("naturalness", "emotion", "identity", "pronunciation", "prosody", "artifacts")
    return takes.withColumn("qc_pass", F.col("qc") == "PASS").withColumns({f"human_{r}": F.lit(None).cast("double") for r in ratings})


def by_steps(rows: DataFrame, steps: str = "steps", cer: str = "cer", seconds: str = "generation_seconds") -> DataFrame:
    return rows.groupBy(steps).agg(
        F.avg(cer).alias("mean_cer"), F.max(cer).alias("max_cer"), F.sum(seconds).alias("total_seconds"), F.count("*").alias("takes"),
        F.count_if(F.col("qc") != "FAIL").alias("qc_pass"), F.count_if(F.col("qc") == "FAIL").alias("qc_fail"),
    )


def listening_sheet(rows: DataFrame) -> DataFrame:
    """Benchmark rows as calibration samples that a person has yet to fill in."""
    blank = F.lit(None).cast("string")
    return rows.select(
        F.col("output").alias("audio"), "audio_sha256", F.col("text").alias("expected"), "recognized", "backend_id",
        blank.alias("human_transcript"), F.lit(False).alias("listened"), blank.alias("reviewer"), F.lit(None).cast("boolean").alias("tts_correct"),
    )


def calibrate(samples: DataFrame, threshold: float, cer: str = "cer", order: list[str] | None = None) -> DataFrame:
    """One row: samples after the first per audio hash, backends, least and greatest rate, and the false-retry rate."""
    once = first_occurrence(samples, ["audio_sha256"], order or ["pos"])
    out = once.agg(
        F.count("*").alias("reviewed_samples"), F.countDistinct("backend_id").alias("backends"), F.min(cer).alias("least_cer"), F.max(cer).alias("greatest_cer"),
        F.avg((F.col(cer) > threshold).cast("int")).alias("false_retry_rate"),
    ).withColumn("threshold", F.lit(float(threshold)))
    enough = (F.col("reviewed_samples") >= MIN_SAMPLES) & (F.col("backends") == 1)
    return out.withColumn("error_code", F.when(~enough, "configuration_error"))


def calibration_values(samples: DataFrame, cer: str = "cer", order: list[str] | None = None) -> DataFrame:
    """The rates of the samples that count, in order: rank and rate, a row each."""
    once = first_occurrence(samples, ["audio_sha256"], order or ["pos"])
    return with_rank(once.where(F.col(cer).isNotNull()).select(F.col(cer).alias("cer")), ["cer"])


def calibration_parts(result: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """The result of a calibration (one row) and its rates as the parts of one JSON file."""
    head = result.select(F.lit(name).alias("name"), F.lit(0).cast("long").alias("part"), F.regexp_replace(F.to_json(F.struct(*result.columns)), r"\}\z", ',"cer_values":[').alias("content"))
    tail = result.select(F.lit(name).alias("name"), F.lit((1 << 63) - 1).alias("part"), F.lit("]}").alias("content"))
    rate = F.to_json(F.array("cer"))
    rows = values.select(F.lit(name).alias("name"), F.col("rank").alias("part"), F.concat(F.when(F.col("rank") > 1, ",").otherwise(""), F.substr(rate, F.lit(2), F.length(rate) - 2)).alias("content"))
    return head.unionByName(rows).unionByName(tail)


def false_retry_rate(cer: Column, threshold: float) -> Column:
    return F.avg((cer > threshold).cast("int"))


def output_audit(audio: DataFrame, metadata: DataFrame, stem: str = "stem") -> DataFrame:
    """Audio and metadata paired by stem; what lacks its partner, or doesn't match it, is named."""
    a, m = audio.withColumn("_a", F.lit(True)), metadata.withColumn("_m", F.lit(True)).withColumnRenamed(stem, "_stem")
    joined = a.join(m, F.col(stem) == F.col("_stem"), "full")
    finding = F.when(F.col("_m").isNull(), "metadata_missing").when(F.col("_a").isNull(), "audio_missing")
    if "audio_sha256" in metadata.columns and "sha256" in audio.columns:
        finding = finding.when(F.col("audio_sha256") != F.col("sha256"), "checksum_mismatch")
    return joined.withColumn(stem, F.coalesce(stem, "_stem")).withColumn("finding", finding).drop("_a", "_m", "_stem")


def delivery_audit(audio: DataFrame, metadata: DataFrame, rate: int = TARGET_RATE) -> DataFrame:
    """Entries of the clips of a folder with ``errors`` and ``warnings`` by name; pairs meet by stem.

    audio: stem, path, sha256, stats and qc (``workflows.inspect_qc``). metadata: stem, output, audio_sha256, model_revision, mode,
    text and transcript_status. Metadata without a clip isn't an entry.
    """
    meta = metadata.select(*(F.col(c).alias(f"_{c}") for c in ("stem", "output", "audio_sha256", "model_revision")), "mode", "text", "transcript_status")
    rows = audio.join(meta, F.col("stem") == F.col("_stem"), "left")
    s, paired = F.col("stats"), F.col("_stem").isNotNull()
    yes = lambda c: F.coalesce(c, F.lit(False))
    unfit = (s["sample_rate"] != rate) | (s["channels"] != 1) | s["has_nan"] | s["has_inf"] | s["clipping"] | (F.col("qc.status") == "FAIL")
    errors = [
        (s.isNull() | yes(unfit), "invalid_audio"), (~paired, "metadata_missing"), (paired & ~yes(F.col("_output") == F.col("path")), "output_differs"),
        (paired & (F.coalesce("_audio_sha256", F.lit("")) != "") & (F.col("_audio_sha256") != F.col("sha256")), "checksum_mismatch"),
    ]
    warnings = [(yes((s["peak"] > HIGH_PEAK) & ~F.isnan(s["peak"])), "near_full_scale"), (paired & (F.coalesce("_model_revision", F.lit("")) == ""), "model_revision_missing")]
    named = lambda rules: F.array_compact(F.array(*(F.when(c, name) for c, name in rules)))
    return rows.select(
        "path", s["duration"].alias("duration"), s["peak"].alias("peak"), s["rms"].alias("rms"), "mode", "text", "qc",
        F.coalesce("transcript_status", F.lit("UNAVAILABLE")).alias("transcript_status"), named(errors).alias("errors"), named(warnings).alias("warnings"),
    )


def delivery_summary(entries: DataFrame) -> DataFrame:
    """One row: clips, errors and warnings; no clip at all is an error."""
    out = entries.agg(F.count("*").alias("files"), F.coalesce(F.sum(F.size("errors")), F.lit(0)).alias("errors"), F.coalesce(F.sum(F.size("warnings")), F.lit(0)).alias("warnings"))
    return out.withColumn("errors", F.when(F.col("files") == 0, F.lit(1).cast("long")).otherwise(F.col("errors"))).withColumn("passed", F.col("errors") == 0)


def short_references(durations: Column, least: float = 5.0) -> Column:
    return F.count_if(durations < least)


def escape_html(text: Column) -> Column:
    """Ampersands first."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def card(title: Column, note: Column, audio: Column) -> Column:
    e = escape_html
    return F.concat(F.lit("<article><h2>"), e(title), F.lit("</h2><p>"), e(note), F.lit('</p><audio controls src="'), e(audio), F.lit('"></audio></article>'))


PAGE_HEAD = '<!doctype html><meta charset="utf-8">'


def page(cards: DataFrame, group: list[str], order: str, card_column: str = "card") -> DataFrame:
    """The parts (name, part, content) of a page for each group, with its cards in order, for ``store.write_files``."""
    return document(cards, group, [order], F.col(card_column), head=PAGE_HEAD)
