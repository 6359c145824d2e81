"""Batch, review and delivery as transitions between append-only tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonarlake.functions import signal
from sonarlake.functions.identity import row_fingerprint
from sonarlake.operators.validate import mastering_error, review_error

#: Codes that stand for the kinds of errors.
ERROR_CODES = ("configuration_error", "voice_not_found", "reference_invalid", "generation_error", "audio_invalid", "transcript_qc_error", "out_of_memory")

#: Files that every model has beside its shards.
MODEL_FILES = ("config.json", "tokenizer.json", "model.safetensors.index.json")


def verify_files(recorded: DataFrame, found: DataFrame, path: str = "path", sha256: str = "sha256") -> DataFrame:
    """Recorded files with ``intact``: present, with the recorded hash."""
    there = found.select(F.col(path).alias("_p"), F.col(sha256).alias("_h"))
    joined = recorded.join(there, F.col(path) == F.col("_p"), "left")
    return joined.withColumn("intact", F.coalesce(F.col("_h") == F.col(sha256), F.lit(False))).drop("_p", "_h")


def revision_validity(files: DataFrame, keys: list[str], fingerprint: str, wanted: str) -> DataFrame:
    """A revision is reusable if its fingerprint is the wanted one and every file is intact."""
    return files.groupBy(*keys).agg(F.every(F.col("intact") & (F.col(fingerprint) == F.col(wanted))).alias("valid"))


def batch_fingerprint(*parts: Column) -> Column:
    """Identity of all that a batch's results depend on."""
    return row_fingerprint(*parts)


def record_reviews(candidates: DataFrame, reviews: DataFrame, on: str = "audio_sha256") -> DataFrame:
    """Reviews with ``error_code`` (null: recorded). A review of a candidate that isn't there, or has changed, is refused."""
    known = candidates.select(F.col(on).alias("_h"), F.col("qc").alias("_qc"), F.col("transcript").alias("_t"))
    joined = reviews.join(known, F.col(on) == F.col("_h"), "left")
    rule = review_error(F.col("decision"), F.col("reviewer"), F.col("listened"), F.col("ratings"), F.col("notes"), F.col("_qc"), F.col("_t"))
    return joined.withColumn("error_code", F.when(F.col("_h").isNull(), "candidate_changed").otherwise(rule)).drop("_h", "_qc", "_t")


def review_id(hash: Column) -> Column:
    """A stamp with a short suffix. Not deterministic, as the time is part of it."""
    return F.concat(F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyyMMdd'T'HHmmssSSSSSS'Z'"), F.lit("_"), F.substring(F.sha2(F.concat(hash, F.uuid()), 256), 1, 8))


def approved(reviews: DataFrame, audio: DataFrame, on: str = "path", sha256: str = "audio_sha256") -> DataFrame:
    """Approvals that were listened to and whose audio still has its hash."""
    there = audio.select(F.col(on), F.col(sha256).alias("_h"))
    return reviews.where("decision = 'approve' AND listened").join(there, on).where(F.col(sha256) == F.col("_h")).drop("_h")


def deliver(clips: DataFrame, samples: str, rate: str, peak_dbfs: float | None = None, target_lufs: float | None = None, cut: bool = True, edge: float = signal.EDGE) -> DataFrame:
    """Approved clips trimmed and brought to level.

    The loudness gain is reckoned from what was measured before the trim (``lufs``, ``true_peak``), the
    peak gain from the samples after it. A clip that breaks a rule has an error and no samples.
    """
    a, r = F.col(samples), F.col(rate)
    body = signal.trim(a, r, edge) if cut else a
    out = clips.withColumn("_body", body)
    none = F.lit(None).cast("double")
    peak = none if peak_dbfs is None else F.lit(float(peak_dbfs))
    target = none if target_lufs is None else F.lit(float(target_lufs))
    if target_lufs is not None:
        gain = signal.gain_to_loudness(F.col("lufs"), F.col("true_peak"), target, peak)
    else:
        gain = signal.gain_to_peak(F.col("_body"), peak_dbfs) if peak_dbfs is not None else F.lit(0.0)
    out = out.withColumn("gain_db", gain)
    error = F.when(F.col("_body").isNull(), "silent").otherwise(mastering_error(peak, target, F.col("gain_db")))
    out = out.withColumn("error_code", error)
    return out.withColumn("delivered", F.when(F.col("error_code").isNull(), signal.apply_gain(F.col("_body"), F.col("gain_db")))).drop("_body")


def target_achieved(measured: Column, target: Column) -> Column:
    return F.abs(measured - target) < 1


def join_segments(segments: DataFrame, group: list[str], pos: str, samples: str, rate: int, pause: float = 0.0) -> DataFrame:
    """Approved segments of each group as one clip, in order."""
    parts = F.collect_list(F.struct(F.col(pos).alias("pos"), F.col(samples).alias("samples")))
    return segments.groupBy(*group).agg(signal.concat_ordered(parts, F.lit(rate), pause).alias("samples"), F.count("*").alias("segments"))


def joined_chunks(segments: DataFrame, group: list[str], pos: str, samples: str, rate: int, pause: float = 0.0, chunk: str = "chunk") -> DataFrame:
    """The same clip of each group as chunks in order, a segment each, with the pause in front of all but the first.

    No list of segments is built, so a clip may be longer than a row: ``clips.parts`` makes a file of the chunks, ``partial.clip_stats``
    their statistics.
    """
    place = F.row_number().over(Window.partitionBy(*group).orderBy(pos))
    gap = F.array_repeat(F.lit(0.0), int(round(rate * pause)))
    body = F.col(samples).cast("array<double>")
    rows = segments.select(*group, place.alias(chunk), body.alias("samples"))
    return rows.withColumn("samples", F.when(F.col(chunk) > 1, F.concat(gap, "samples")).otherwise(F.col("samples")))


def split_errors(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, dead letters) by ``error_code``."""
    return rows.where("error_code IS NULL"), rows.where("error_code IS NOT NULL")


def verify_receipts(digests: DataFrame, receipts: DataFrame, path: str = "path") -> DataFrame:
    """Receipts (path, revision, etag) with ``verified`` and the file's sha256: the file is there, and its digest is the etag.

    digests: ``sources.store.digests``. An etag of 64 digits is a SHA-256, any other the SHA-1 of a blob.
    """
    there = digests.select(F.col(path).alias("_p"), F.col("sha256"), F.col("blob_sha1").alias("_b"))
    joined = receipts.join(there, F.col(path) == F.col("_p"), "left")
    right = F.when(F.length("etag") == 64, F.col("sha256") == F.col("etag")).otherwise(F.col("_b") == F.col("etag"))
    return joined.withColumn("verified", F.coalesce(right, F.lit(False))).drop("_p", "_b")


def model_files(index: DataFrame) -> DataFrame:
    """The files that a model needs: its fixed ones, and all that the weight map of ``index`` (rows of ``json``) names."""
    shards = index.select(F.explode(F.from_json(F.get_json_object("json", "$.weight_map"), "map<string,string>")).alias("weight", "path")).select("path")
    return shards.unionByName(index.select(F.explode(F.array(*(F.lit(n) for n in MODEL_FILES))).alias("path"))).distinct()


def model_identity(digests: DataFrame, receipts: DataFrame, revision: str, config: DataFrame, index: DataFrame) -> DataFrame:
    """One row: the model's files with their hashes, and why it can't be trusted (null if it can).

    The weight map decides which files there must be, so a shard that nobody lists isn't overlooked. config and index are
    one row of ``json`` each. Of several errors the first file's counts: fixed files first, then shards by name.
    """
    given = lambda key: ~F.coalesce(F.get_json_object("json", f"$.{key}"), F.lit("null")).isin("null", "false", "0", "", "{}", "[]")
    quantized = config.agg(F.coalesce(F.some(given("quantization") | given("quantization_config")), F.lit(False)).alias("_q"))
    checked = verify_receipts(digests, receipts).select("path", F.col("revision").alias("_r"), "verified")
    rows = model_files(index).join(digests.select("path", "sha256"), "path", "left").join(checked, "path", "left")
    safe = ~F.exists(F.split("path", "/"), lambda p: p.isin("", ".", ".."))
    error = F.when(~safe | F.col("sha256").isNull(), "model_file_missing").when(~F.coalesce(F.col("_r") == revision, F.lit(False)), "revision_differs").when(~F.coalesce("verified", F.lit(False)), "artifact_changed")
    order = F.struct(F.coalesce(F.array_position(F.array(*(F.lit(n) for n in MODEL_FILES)), F.col("path")) == 0, F.lit(True)), F.array_position(F.array(*(F.lit(n) for n in MODEL_FILES)), F.col("path")), "path")
    rows = rows.withColumn("_error", error)
    files = rows.agg(F.array_sort(F.collect_list(F.struct("path", "sha256"))).alias("files"), F.count("*").alias("_n"), F.min_by("_error", F.when(F.col("_error").isNotNull(), order)).alias("_error"))  # the files of one model
    row = files.join(F.broadcast(quantized), F.lit(True))  # both sides are one row
    error = F.when(F.col("_q"), "model_quantized").when(F.col("_n") == 0, "model_file_missing").otherwise(F.col("_error"))
    listed = F.array_join(F.transform("files", lambda f: F.concat_ws(":", f["path"], f["sha256"])), ",")
    return row.select("files", F.sha2(listed, 256).alias("model_sha256"), error.alias("error_code"))
