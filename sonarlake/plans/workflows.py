"""End-to-end plans: episode and long-form preparation, batches, benchmark, calibration and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarlake.functions import align, emotion, lexicon, loudness, partial, segment, signal
from sonarlake.functions.identity import row_fingerprint
from sonarlake.operators import catalog, lifecycle, policy, report, validate
from sonarlake.plans import adapters
from sonarlake.shared import checkpointed
from sonarlake.sources import clips, readers, sinks, store

# What a request takes where it says nothing.
EPISODE_DEFAULTS = {"candidates": 3, "profile": "production", "inference_timesteps": 30, "cfg_value": 2.0, "warmup_patches": 0, "max_tokens": 2000}
NORMALIZATION_DEFAULT = "dialogue"
UNKNOWN_EMOTION = "Unknown emotion %s; neutral fallback"


def prepare_episode(lines: DataFrame, voices: DataFrame, entries: dict, profile: str = NORMALIZATION_DEFAULT, global_entries: dict | None = None, exact: bool = False) -> DataFrame:
    """Lines routed to a style, checked against the catalogue, and rewritten for speech.

    With ``exact`` a style that the voice has is used as it is; else lines take the neutral style and an
    acting instruction. Errors are a column.
    """
    styles = catalog.styles(voices)
    have = styles.groupBy("id").agg(F.collect_set("style").alias("_have")).withColumnRenamed("id", "_vid")
    rows = lines.join(have, F.col("character_id") == F.col("_vid"), "left")
    asked = F.coalesce(F.nullif(F.col("style"), F.lit("")), emotion.style_of(F.col("emotion")))
    rows = rows.withColumn("_asked", asked).withColumn("_exact", F.lit(exact) & F.coalesce(F.array_contains("_have", F.col("_asked")), F.lit(False)))
    rows = rows.withColumns({
        "style": F.when(F.col("_exact"), F.col("_asked")).otherwise("neutral"),
        "mode": F.when(F.col("_exact"), "ultimate").otherwise("controllable"),
        "instruct": F.when(~F.col("_exact"), F.coalesce("instruct", emotion.instruction_of(F.col("_asked")), emotion.instruction_of(F.lit("neutral")))),
        "emotion_warning": F.when(F.col("emotion").isNotNull() & ~F.col("emotion").isin(list(emotion.STYLES)), F.format_string(UNKNOWN_EMOTION, "emotion")),
    })
    resolved = catalog.resolve_style(rows.drop("_have", "_vid", "_asked", "_exact"), styles)
    error = F.when(validate.blank(F.col("character_id")), "configuration_error").otherwise(F.col("error_code"))
    resolved = resolved.withColumn("error_code", error).drop("entry", "default_style", "selected_style")
    prepared = resolved.withColumn("preparation", lexicon.prepare_text(F.col("text"), entries, profile, global_entries))
    return prepared.withColumn("text", F.col("preparation.text_spoken")).withColumn("error_code", F.coalesce("error_code", "preparation.normalization.error_code"))


def prepare_longform(texts: DataFrame, text: str = "text", max_chars: int = segment.DEFAULT_CHARS) -> DataFrame:
    return segment.segment_rows(texts, text, max_chars)


def _scored(plan: DataFrame, synthesizer, recognizer, threshold: float | None) -> DataFrame:
    """Attempts made and judged."""
    made = adapters.recognize(adapters.synthesize(plan, synthesizer), recognizer)
    stats = signal.stats(F.col("samples"), F.col("sample_rate"), subtype=F.lit("PCM_24"))
    expected, heard = align.comparison_text(F.col("text")), align.comparison_text(F.col("recognized"))
    scored = made.withColumn("stats", F.when(F.col("samples").isNotNull(), stats)).withColumn("cer", align.cer(expected, heard))
    qc = F.when(F.col("samples").isNotNull(), signal.audio_qc(F.col("stats"), F.col("text"))["status"]).otherwise("UNAVAILABLE")
    limit = F.lit(None).cast("double") if threshold is None else F.lit(float(threshold))
    verdict = align.verdict(F.lit(recognizer is not None), F.col("recognition_error"), F.col("cer"), limit)
    return scored.withColumns({"qc": qc, "transcript": verdict, "rtf": validate.rtf(F.col("generation_seconds"), F.col("stats.duration"))})


def run_attempts(plan: DataFrame, line: list[str], synthesizer=None, recognizer=None, threshold: float | None = None) -> DataFrame:
    """Attempts made in order and ranked; a line whose profile stops early (``early_stop``) makes none after one is accepted.

    One round for each candidate number, of which a schedule has MAX_CANDIDATES at most. A round is checkpointed, so no
    attempt is made twice, and a lost executor costs its own tasks only. Attempts beyond MAX_CANDIDATES aren't made; they come
    back with an ``error_code``.
    """
    within = F.coalesce(F.col("candidate").between(1, policy.MAX_CANDIDATES), F.lit(False))
    last = plan.where(within).agg(F.max("candidate")).first()[0] or 1
    stops = F.coalesce(F.col("early_stop"), F.lit(False)) if "early_stop" in plan.columns else F.lit(False)
    made = accepted = None
    for k in range(1, last + 1):
        due = plan.where(F.col("candidate") == k)
        round_ = checkpointed(_scored(due if accepted is None else due.join(accepted, line, "left_anti"), synthesizer, recognizer, threshold))
        done = round_.where(stops & align.accepted_automatically(F.col("qc"), F.col("transcript"))).select(*line)
        made = round_ if made is None else made.unionByName(round_)
        accepted = done if accepted is None else accepted.unionByName(done)
    ranked = policy.rank_candidates(made, line, ["candidate"]).withColumn("error_code", F.lit(None).cast("string"))
    refused = plan.where(~within).withColumn("error_code", F.lit("configuration_error"))
    return ranked.unionByName(refused, allowMissingColumns=True)


def plan_batch(lines: DataFrame, completed: DataFrame, profiles: DataFrame, key: list[str]) -> DataFrame:
    """Attempts of the lines that aren't complete, each with the hash of what it depends on."""
    steps = profiles.select(F.col("name").alias("profile"), "steps", "early_stop")
    open_lines = policy.remaining(lines, completed, key).join(F.broadcast(steps), "profile")  # a row for each profile
    plan = policy.plan_attempts(open_lines)
    return plan.withColumn("attempt_hash", row_fingerprint(*(F.col(c) for c in (*key, "text", "attempt_seed", "inference_timesteps"))))


def preflight(lines: DataFrame, identities: DataFrame, settings: dict[str, str], project: str = "project", id: str = "id") -> DataFrame:
    """Per project the fingerprint of all that its results depend on: lines, references and settings (model, runtime, recognizer).

    identities: ``catalog.reference_identity`` of the lines' voices. A line whose reference can't be used makes its project's
    ``error_code``. The fingerprint doesn't depend on the order in which rows come.
    """
    known = identities.select(project, id, F.col("error_code").alias("_error"), "reference_sha256", "reference_transcript_sha256", "voice_sha256")
    rows = lines.join(known, [project, id], "left")
    columns = [c for c in rows.columns if c not in (project, "_error")]
    each = rows.select(project, "_error", row_fingerprint(*(F.col(c).cast("string") for c in sorted(columns))).alias("_line"))
    out = each.groupBy(project).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("_line")), ","), 256).alias("_all"), F.max("_error").alias("error_code"), F.count("*").alias("lines"))
    named = [F.lit(x) for k in sorted(settings) for x in (k, settings[k])]
    return out.withColumn("fingerprint", row_fingerprint(F.col("_all"), *named)).drop("_all")


def choose_revision(wanted: DataFrame, files: DataFrame, project: str = "project") -> DataFrame:
    """Per project the newest revision that can go on (same fingerprint, all files intact), else a new number.

    wanted: project and fingerprint. files: project, revision, fingerprint and intact, one row for each recorded file.
    """
    rows = files.join(wanted.select(project, F.col("fingerprint").alias("_wanted")), project)
    picked = policy.newest_valid(lifecycle.revision_validity(rows, [project, "revision"], "fingerprint", "_wanted"), [project])
    out = wanted.join(picked, project, "left")
    return out.withColumn("resumed", F.col("reusable").isNotNull()).withColumn("revision", F.coalesce("reusable", "next_revision", F.lit(1))).drop("reusable", "next_revision")


#: Lines of a batch that are made and written together: what a lost driver costs at most.
LINES_AT_ONCE = 256
_SELECTION = r"^(.*)/run_(\d+)/([^/]+)/selection\.json$"


def attempt_files(made: DataFrame) -> DataFrame:
    """The parts of a batch's files: a WAV for each take that may be written, its metadata, and a selection for each line."""
    folder = F.concat_ws("/", "project", F.format_string("run_%04d", "revision"), "id")
    rows = made.withColumns({"_folder": folder, "output": F.concat(folder, F.format_string("/candidate_%02d.wav", "candidate"))})
    sound = rows.where(F.col("samples").isNotNull() & signal.writable(F.col("samples"), F.col("sample_rate")).isNull())
    audio = clips.parts(sound.select("output", F.lit(0).alias("chunk"), "samples"), "output")
    text = lambda body, name: body.select(name.alias("name"), F.lit(0).cast("long").alias("part"), F.encode("json", "UTF-8").alias("content"))
    meta = rows.withColumn("json", F.to_json(F.struct(*(c for c in rows.columns if c not in ("samples", "_folder")))))
    chosen = sinks.selection_index(rows, ["_folder"])  # a line has MAX_CANDIDATES attempts at most
    index = chosen.withColumn("json", F.to_json(F.struct(*(c for c in chosen.columns if c != "_folder"))))
    return audio.unionByName(text(meta, F.regexp_replace("output", "wav$", "json"))).unionByName(text(index, F.concat("_folder", F.lit("/selection.json"))))


def finished_lines(spark: SparkSession, root: str) -> DataFrame:
    """project, revision, id and batch of the lines whose files are there."""
    names = store.written(spark, root).where(F.col("name").rlike(_SELECTION))
    part = lambda k: F.regexp_extract("name", _SELECTION, k)
    return names.select(part(1).alias("project"), part(2).cast("int").alias("revision"), part(3).alias("id"), "batch")


def run_plan(plan: DataFrame, root: str, run: str, synthesizer=None, recognizer=None, threshold: float | None = None, lines_at_once: int = LINES_AT_ONCE) -> None:
    """Makes a plan's attempts as a stream of micro-batches, each of whose files appear all at once.

    The plan is written once, some lines to a file; each micro-batch takes one file, and its number names its batch of files. A
    driver that is lost goes on, when it is called again with the same ``run``, behind the last batch whose manifest is there.
    """
    spark, key = plan.sparkSession, ["project", "revision", "id"]
    folder = f"{root.rstrip('/')}/plans/{run}"
    fs, inner = store.opened(f"{folder}/_SUCCESS")
    if fs.get_file_info(inner).type.name == "NotFound":
        batches = -(-plan.select(*key).distinct().count() // lines_at_once)
        plan.repartition(max(1, batches), *key).write.mode("overwrite").parquet(folder)

    def make(lines: DataFrame, number: int) -> None:
        batch = f"{run}-{number:06d}"
        if not store.finished(root, batch):
            store.write_files(attempt_files(run_attempts(lines, key, synthesizer, recognizer, threshold)), root, order="part", batch=batch, fresh=True)

    planned = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    stream = planned.writeStream.foreachBatch(make).option("checkpointLocation", f"{root.rstrip('/')}/progress/{run}").trigger(availableNow=True).start()
    stream.awaitTermination()


def run_batch(lines: DataFrame, identities: DataFrame, settings: dict[str, str], files: DataFrame, finished: DataFrame, profiles: DataFrame, root: str,
              synthesizer=None, recognizer=None, threshold: float | None = None, lines_at_once: int = LINES_AT_ONCE) -> DataFrame:
    """Preflight, choice of a revision, and the attempts that are left, whose audio and metadata are written below ``root`` as they are made.

    finished: project, revision and id of lines that a resumed revision has (``finished_lines``). Projects with an error in
    preflight make nothing. A run is known by its projects, revisions and fingerprints, so calling again goes on with it. Returns
    one row per project: fingerprint, revision, resumed, error_code and the lines that the run has made.
    """
    checked = preflight(lines, identities, settings)
    unsafe = lines.groupBy("project").agg(F.some(~validate.safe_component(F.col("project")) | ~validate.safe_component(F.col("id"))).alias("_unsafe"))
    checked = checked.join(unsafe, "project").withColumn("error_code", F.coalesce("error_code", F.when(F.col("_unsafe"), "configuration_error"))).drop("_unsafe")
    chosen = checkpointed(choose_revision(checked.where("error_code IS NULL"), files))
    mark = chosen.agg(F.coalesce(F.bit_xor(F.xxhash64("project", "revision", "fingerprint")), F.lit(0)), F.count("*")).first()
    run = f"{mark[0] & (1 << 64) - 1:016x}-{mark[1]}"
    due = lines.join(chosen.select("project", "revision"), "project")
    plan = plan_batch(due, finished.select("project", "revision", "id"), profiles, ["project", "revision", "id"])
    run_plan(plan, root, run, synthesizer, recognizer, threshold, lines_at_once)
    counts = finished_lines(lines.sparkSession, root).where(F.col("batch").startswith(run)).groupBy("project").agg(F.countDistinct("id").alias("lines_made"))
    out = checked.select("project", "fingerprint", "error_code").join(chosen.select("project", "revision", "resumed"), "project", "left")
    return out.join(counts, "project", "left").withColumn("lines_made", F.coalesce("lines_made", F.lit(0)))


# What a delivery may be made for.
MASTERING_PROFILES = ("raw_master", "drama_dialogue", "narration", "short_video")


def finalize(approved: DataFrame, root: str, batch: str, profile: str = "raw_master", cut: bool = False, peak_dbfs: float | None = None, target_lufs: float | None = None) -> DataFrame:
    """Approved clips brought to level, inspected again, and written once, each with its metadata.

    approved: project, name, audio_sha256, samples and sample_rate (``lifecycle.approved`` with decoded clips). Loudness is measured
    before, and again on what is delivered. A clip that breaks a rule isn't written; one whose delivery fails its inspection is, for
    diagnosis. Returns a row for each clip, without samples: error_code, gain_db, input and output loudness, target_achieved, qc, output.
    """
    text = lambda c: F.lit(None if c is None else float(c)).cast("double")
    source = signal.audio_qc(signal.stats(F.col("samples"), F.col("sample_rate"), subtype=F.lit("PCM_24")))["status"]
    rows = approved.withColumns({"_source": source, "_loud": loudness.measure(F.col("samples"), F.col("sample_rate")) if target_lufs is not None else F.lit(None).cast(loudness.MEASURED)})
    made = lifecycle.deliver(rows.withColumns({"lufs": F.col("_loud.lufs"), "true_peak": F.col("_loud.true_peak")}), "samples", "sample_rate", peak_dbfs, target_lufs, cut)
    early = F.when(F.lit(profile not in MASTERING_PROFILES), "configuration_error").when(F.col("_source") == "FAIL", "audio_invalid")
    unmeasured = F.when(F.lit(target_lufs is not None) & (F.col("lufs").isNull() | F.col("true_peak").isNull()), "loudness_unmeasurable")
    gate = F.when(F.col("delivered").isNotNull(), signal.writable(F.col("delivered"), F.col("sample_rate")))
    made = made.withColumn("error_code", F.coalesce(early, unmeasured, "error_code", gate))
    made = made.withColumn("delivered", F.when(F.col("error_code").isNull(), F.col("delivered")))
    after = loudness.measure(F.col("delivered"), F.col("sample_rate")) if target_lufs is not None else F.lit(None).cast(loudness.MEASURED)
    own = signal.stats(F.col("delivered"), F.col("sample_rate"), subtype=F.lit("PCM_24"))
    made = made.withColumns({"output_loudness": after, "stats": F.when(F.col("delivered").isNotNull(), own), "output": F.concat_ws("/", "project", F.lit(batch), "name")})
    made = made.withColumns({"qc": F.when(F.col("stats").isNotNull(), signal.audio_qc(F.col("stats"))), "target_achieved": lifecycle.target_achieved(F.col("output_loudness.lufs"), text(target_lufs))})
    rows = checkpointed(made.withColumn("error_code", F.coalesce("error_code", F.when(F.col("qc.status") == "FAIL", "delivery_failed"))))
    facts = rows.select("project", "name", "audio_sha256", "output", F.lit(profile).alias("profile"), F.lit(cut).alias("trim"), text(peak_dbfs).alias("peak_dbfs"), text(target_lufs).alias("target_lufs"), "gain_db",
                        F.col("_loud").alias("input_loudness"), "output_loudness", "target_achieved", "stats", "qc", "error_code")
    there = rows.where("delivered IS NOT NULL").select("output", F.lit(0).alias("chunk"), "delivered")
    meta = facts.join(there.select("output"), "output", "left_semi").select(F.concat(F.regexp_replace("output", r"\.wav$", ""), F.lit(".json")).alias("name"), F.lit(0).cast("long").alias("part"), F.encode(F.to_json(F.struct(*facts.columns)), "UTF-8").alias("content"))
    store.write_files(clips.parts(there, "output", samples="delivered").unionByName(meta), root, order="part", batch=batch)
    return facts


def verify_model(spark: SparkSession, root: str, revision: str, receipts: str = ".cache/huggingface/download") -> DataFrame:
    """Identity of the model in a folder; its files are hashed in blocks, one task for each."""
    config, index = (readers.whole_text(spark, f"{root}/{n}") for n in ("config.json", "model.safetensors.index.json"))
    names = lifecycle.model_files(index)
    found = store.digests(names.select(F.concat(F.lit(root.rstrip("/") + "/"), "path").alias("path")), length=None)
    digests = checkpointed(found.withColumn("path", F.substr("path", F.lit(len(root.rstrip("/")) + 2))))
    return lifecycle.model_identity(digests, readers.receipts(spark, f"{root}/{receipts}"), revision, config, index)


def benchmark_plan(cases: DataFrame, steps: list[int]) -> DataFrame:
    """Cases by steps."""
    return cases.withColumn("steps", F.explode(F.array(*(F.lit(s) for s in steps)))).withColumn("instruct", emotion.instruction_of(emotion.style_of(F.col("emotion"))))


def usable_samples(samples: DataFrame) -> DataFrame:
    """The samples that a calibration may count, scored."""
    c = F.col
    usable = samples.where(validate.calibration_sample(c("listened"), c("reviewer"), c("human_transcript"), c("tts_correct"), c("recognized")))
    return usable.withColumn("cer", align.cer(align.comparison_text(c("human_transcript")), align.comparison_text(c("recognized"))))


def calibration(samples: DataFrame, threshold: float, root: str | None = None, name: str = "calibration.json") -> DataFrame:
    """Usable samples, scored and summed up. With ``root`` the result and all rates in order are written there, as one file that must be new."""
    scored = usable_samples(samples)
    if root is None:
        return report.calibrate(scored, threshold)
    scored = checkpointed(scored)
    result = checkpointed(report.calibrate(scored, threshold))
    store.write_files(report.calibration_parts(result, report.calibration_values(scored), name), root, order="part", batch=name)
    return result


def system_report(styles: DataFrame) -> DataFrame:
    """Counts that a health check shows."""
    return styles.agg(F.count("*").alias("references"), report.short_references(F.col("duration")).alias("short_references"))


def inspect_qc(clips: DataFrame, reference: bool = False) -> DataFrame:
    """Decoded clips (``sources.readers.waveforms``) with ``stats`` and ``qc``. Peak and clipping see every channel."""
    known = F.col("samples").isNotNull()
    own = signal.stats(F.col("samples"), F.col("sample_rate"), F.col("channels"), F.col("subtype"))
    rows = clips.withColumn("stats", F.when(known, own.withField("peak", F.col("peak_all")).withField("clipping", F.col("peak_all") >= signal.CLIP)))
    return rows.withColumn("qc", F.when(known, signal.audio_qc(F.col("stats"), reference=reference)))


def inspect_chunks(chunks: DataFrame, reference: bool = False) -> DataFrame:
    """Clips of any length, from their chunks (``sources.clips.chunks``): path, ``stats``, ``qc`` and error_code, as of whole clips."""
    facts = ["sample_rate", "channels", "subtype"]
    known = chunks.where("error_code IS NULL")
    peaks = known.groupBy("path").agg(F.max("peak_all").alias("_peak"))
    own = partial.clip_stats(known, ["path"], *facts).join(peaks, "path")
    rows = own.select("path", F.col("stats").withField("peak", F.col("_peak")).withField("clipping", F.col("_peak") >= signal.CLIP).alias("stats"), F.lit(None).cast("string").alias("error_code"))
    judged = rows.select("path", "stats", signal.audio_qc(F.col("stats"), reference=reference).alias("qc"), "error_code")
    broken = chunks.where("error_code IS NOT NULL").select("path", F.lit(None).cast(judged.schema["stats"].dataType).alias("stats"), F.lit(None).cast(judged.schema["qc"].dataType).alias("qc"), "error_code")
    return judged.unionByName(broken)
