"""Planning, validation, catalogue, lifecycle, reports, sources, sinks and workflows."""

import json

import pytest
from pyspark.sql import functions as F

from sonarlake.functions import align
from sonarlake.operators import catalog, lifecycle, policy, report, validate
from sonarlake.plans import adapters, workflows
from sonarlake.sources import readers, sinks, store


def test_profiles_and_plan(spark, one):
    steps = {r["name"]: (r["steps"], r["early_stop"]) for r in policy.profiles(spark).collect()}
    assert steps["production"] == ([10, 20, 30], True) and steps["ultimate"] == ([30, 30, 30], False)
    rows = policy.plan_attempts(spark.createDataFrame([(1, 4294967295, [10, 20])], "id int, seed long, steps array<int>")).orderBy("candidate").collect()
    assert [(r["candidate"], r["attempt_seed"], r["inference_timesteps"]) for r in rows] == [(1, 4294967295, 10), (2, 3364, 20)]
    assert one(policy.profile_error(F.array(F.lit(101)))) and one(policy.profile_error(F.array(F.lit(10)))) is None
    assert one(policy.plan_error(F.lit(6), F.lit(1), F.lit(1))) == "configuration_error"
    assert one(policy.custom_steps(F.lit(7), F.lit(3))) == [7, 7, 7]


ATTEMPTS = [
    (1, 1, "FAIL", "PASS", 0.0), (1, 2, "WARN", "PASS", 0.2), (1, 3, "PASS", "PASS", 0.3), (1, 4, "PASS", "PASS", 0.1), (1, 5, "PASS", "PASS", 0.1),
    (2, 1, "FAIL", "FAIL", None), (2, 2, None, None, None), (3, 1, "PASS", "WARN", 1.5), (3, 2, "PASS", "WARN", None),
]


def test_rank_and_stop(spark):
    df = spark.createDataFrame(ATTEMPTS, "line int, candidate int, qc string, transcript string, cer double")
    best = {r["line"]: r["candidate"] for r in policy.select_best(df, ["line"], ["candidate"]).collect()}
    assert best == {1: 4, 3: 2}  # the first of equals; a missing rate counts as 1; nothing eligible on line 2
    kept = policy.early_stop(df, ["line"], ["candidate"]).groupBy("line").agg(F.max("candidate").alias("n")).collect()
    assert {r["line"]: r["n"] for r in kept} == {1: 3, 2: 2, 3: 2}
    index = {r["line"]: r for r in sinks.selection_index(policy.rank_candidates(df.withColumn("output", F.lit("o")), ["line"], ["candidate"]), ["line"]).collect()}
    assert index[1]["recommended_candidate"] == 4 and index[2]["recommended_candidate"] is None


def test_resume(spark):
    plan = spark.createDataFrame([("a", "h1"), ("b", "h2"), ("c", "h3"), ("d", "h4")], "output string, attempt_hash string")
    made = spark.createDataFrame([("a", "h1"), ("b", "other")], plan.schema)
    failed = spark.createDataFrame([("c", "h3"), ("d", "older")], plan.schema)
    assert {r["output"]: r["action"] for r in policy.attempts_to_run(plan, made, failed).collect()} == {"a": "reuse", "b": "conflict", "c": "skip", "d": "run"}
    revisions = spark.createDataFrame([("p", 1, True), ("p", 2, True), ("p", 10000, False)], "project string, revision int, valid boolean")
    row = policy.newest_valid(revisions, ["project"]).first()
    assert (row["reusable"], row["next_revision"]) == (2, 10001)
    firsts = policy.first_occurrence(spark.createDataFrame([("x", 2), ("x", 1)], "sha string, pos int"), ["sha"], ["pos"]).collect()
    assert [r["pos"] for r in firsts] == [1]


def test_line_rules(one):
    rule = lambda text, mode, instruct, who, id: one(validate.line_violations(*(F.lit(x).cast("string") for x in (text, mode, instruct, who, id))))
    assert rule("hi", "controllable", None, "v", "a_1") == []
    assert rule(" ", "design", " ", None, "a\n") == ["text_blank", "design_needs_instruct", "id_charset"]
    assert rule("x" * 5001, "sing", None, None, None) == ["text_too_long", "mode_unknown", "clone_needs_character", "id_charset"]


def test_ranges_and_preparation(spark, one):
    df = spark.createDataFrame([(4294967296, 1.0, None)], "seed long, cfg_value double, candidates long")
    assert df.select(validate.option_violations(df.columns)).first()[0] == ["seed_range", "cfg_value_range"]
    prep = F.struct(F.lit("a").alias("text_spoken"))
    keys = F.array(*(F.lit(k) for k in validate.PREPARATION_KEYS))
    assert one(validate.preparation_violations(prep, F.lit("a"), keys)) == []
    assert one(validate.preparation_violations(prep, F.lit("b"), F.slice(keys, 1, 2))) == ["preparation_incomplete", "preparation_text_differs"]


def test_paths(one):
    assert one(validate.contained(F.lit("/r/a/../b/x.wav"), F.lit("/r"))) is True
    assert one(validate.contained(F.lit("/r/../etc"), F.lit("/r"))) is False and one(validate.contained(F.lit("/rx/a"), F.lit("/r"))) is False
    assert [one(validate.safe_component(F.lit(x))) for x in ("a", "..", "a/b", "")] == [True, False, False, False]
    assert one(F.struct(*validate.split_selection_key(F.lit("a/b/c")))) == ("a", "b/c")
    assert one(validate.is_out_of_memory(F.lit("Metal device lost"))) is True
    assert one(validate.rtf(F.lit(1.0), F.lit(0.0))) is None


@pytest.mark.parametrize(("decision", "who", "listened", "rating", "notes", "qc", "heard", "error"), [
    ("approve", "ann", True, 5.0, None, "PASS", "PASS", None), ("maybe", None, False, 9.0, None, "FAIL", None, "decision_unknown"), ("approve", " ", True, 5.0, None, "PASS", "PASS", "reviewer_required"),
    ("approve", "ann", False, 5.0, None, "PASS", "PASS", "listening_required"), ("rate", "ann", True, 5.5, None, "PASS", "PASS", "rating_range"), ("approve", "ann", True, 5.0, "x", "FAIL", "PASS", "failed_audio"),
    ("approve", "ann", True, 5.0, "", "WARN", "PASS", "notes_required"), ("approve", "ann", True, 5.0, "ok", "WARN", None, None), ("reject", "ann", True, 1.0, None, "FAIL", "FAIL", None),
])
def test_review_rules(one, decision, who, listened, rating, notes, qc, heard, error):
    s = lambda x: F.lit(x).cast("string")
    got = one(validate.review_error(s(decision), s(who), F.lit(listened), F.create_map(F.lit("r"), F.lit(rating)), s(notes), s(qc), s(heard)))
    assert got == error


def test_review_to_delivery(spark):
    candidates = spark.createDataFrame([("h1", "PASS", "PASS"), ("h2", "FAIL", "PASS")], "audio_sha256 string, qc string, transcript string")
    reviews = spark.createDataFrame([("p1", "h1"), ("p2", "h2"), ("p3", "gone")], "path string, audio_sha256 string").withColumns(
        {"decision": F.lit("approve"), "reviewer": F.lit("ann"), "listened": F.lit(True), "ratings": F.create_map(F.lit("r"), F.lit(4.0)), "notes": F.lit("")})
    recorded = lifecycle.record_reviews(candidates, reviews)
    good, dead = lifecycle.split_errors(recorded)
    assert {r["path"]: r["error_code"] for r in dead.collect()} == {"p2": "failed_audio", "p3": "candidate_changed"}
    audio = spark.createDataFrame([("p1", "h1")], "path string, audio_sha256 string")
    assert lifecycle.approved(good, audio).count() == 1
    assert lifecycle.approved(good, audio.withColumn("audio_sha256", F.lit("x"))).count() == 0
    clips = spark.createDataFrame([("a", [0.0, 0.5, 0.25, 0.0], 10), ("b", [0.0, 0.0], 10), ("c", [0.01], 10)], "id string, s array<float>, r int")
    out = {r["id"]: r for r in lifecycle.deliver(clips, "s", "r", peak_dbfs=-6.0).collect()}
    assert max(out["a"]["delivered"]) == pytest.approx(10 ** (-6 / 20)) and out["b"]["error_code"] == "silent" and out["c"]["error_code"] == "boost_too_large"
    loud = clips.limit(1).withColumns({"lufs": F.lit(-20.0), "true_peak": F.lit(-6.0)})
    assert lifecycle.deliver(loud, "s", "r", target_lufs=-14.0).first()["gain_db"] == 5.0


def test_revision_validity(spark):
    recorded = spark.createDataFrame([("p", 1, "f", "a", "h"), ("p", 2, "f", "b", "h"), ("p", 3, "g", "a", "h")], "project string, revision int, fingerprint string, path string, sha256 string")
    found = spark.createDataFrame([("a", "h"), ("b", "other")], "path string, sha256 string")
    files = lifecycle.verify_files(recorded, found).withColumn("wanted", F.lit("f"))
    assert {r["revision"]: r["valid"] for r in lifecycle.revision_validity(files, ["project", "revision"], "fingerprint", "wanted").collect()} == {1: True, 2: False, 3: False}


def _voices(spark, tmp_path):
    for id, default, styles in (("v1", "sad", ["sad", "neutral"]), ("v2", None, ["neutral"])):
        (tmp_path / id).mkdir()
        body = {"id": id, "name": id.upper(), "styles": {s: {"reference": f"{s}.wav", "transcript": f"{s}.txt"} for s in styles}}
        (tmp_path / id / "voice.json").write_text(json.dumps(body | ({"default_style": default} if default else {})))
    return readers.voices(spark, str(tmp_path))


def test_catalogue(spark, tmp_path):
    voices = _voices(spark, tmp_path)
    assert sorted(r["id"] for r in voices.collect()) == ["v1", "v2"] and readers.voice(voices, "v2").count() == 1
    asked = spark.createDataFrame([(1, "v1", None), (2, "v2", None), (3, "v2", "sad"), (4, "v9", None)], "n int, character_id string, style string")
    got = {r["n"]: (r["selected_style"], r["error_code"]) for r in catalog.resolve_style(asked, catalog.styles(voices)).collect()}
    assert got == {1: ("sad", None), 2: ("neutral", None), 3: ("sad", "style_not_found"), 4: (None, "voice_not_found")}
    assert {r["n"]: r["error_code"] for r in catalog.lookup(asked, voices).collect()} == {1: None, 2: None, 3: None, 4: "voice_not_found"}
    new = spark.createDataFrame([("v1", "sad"), ("v1", "angry")], "id string, style string")
    accepted, refused = catalog.upsert_styles(catalog.styles(voices), new, ["id", "style"])
    assert [r["style"] for r in accepted.collect()] == ["angry"] and refused.count() == 1
    changed = {r["id"]: r["changed"] for r in catalog.enrich(voices.withColumn("source", F.when(F.col("id") == "v1", "s")), {"source": "unknown"}).collect()}
    assert changed == {"v1": False, "v2": True}
    assert catalog.audition_plan(voices.select("id"), spark.createDataFrame([("a",), ("b",)], "style string"), 3).count() == 12


def test_promotion(spark):
    picks = spark.createDataFrame([("a/sad", 1), ("a", None), ("b/x/y", 3), ("zz", 2), ("a", 4)], "selection_key string, choice int")
    cast = spark.createDataFrame([("a",), ("b",)], "id string")
    got = {r["selection_key"]: (r["character"], r["style"], r["error_code"]) for r in catalog.promote(picks, cast).collect()}
    assert got == {"a/sad": ("a", "sad", None), "b/x/y": ("b", "x/y", None), "zz": ("zz", "neutral", "unknown_character")}


def test_reports(spark, one):
    assert one(report.escape_html(F.lit("<a & 'b' \"c\">"))) == "&lt;a &amp; &#x27;b&#x27; &quot;c&quot;&gt;"
    samples = spark.createDataFrame([(i, f"h{i % 40}", "b", i / 100) for i in range(50)], "pos int, audio_sha256 string, backend_id string, cer double")
    row = report.calibrate(samples, 0.2).first()
    assert row["reviewed_samples"] == 40 and row["error_code"] is None and row["false_retry_rate"] == pytest.approx(19 / 40)
    values = [r["cer"] for r in report.calibration_values(samples).orderBy("rank").collect()]
    assert len(values) == 40 and values == sorted(values) and (row["least_cer"], row["greatest_cer"]) == (values[0], values[-1])
    assert report.calibrate(samples.limit(5), 0.2).first()["error_code"] == "configuration_error"
    audio = spark.createDataFrame([("a", "h"), ("b", "h"), ("c", "h")], "stem string, sha256 string")
    meta = spark.createDataFrame([("a", "h"), ("b", "x"), ("d", "h")], "stem string, audio_sha256 string")
    assert {r["stem"]: r["finding"] for r in report.output_audit(audio, meta).collect()} == {"a": None, "b": "checksum_mismatch", "c": "metadata_missing", "d": "audio_missing"}
    cards = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "g int, pos int, card string")
    parts = report.page(cards, ["g"], "pos").orderBy("part").collect()
    assert "".join(r["content"] for r in parts) == report.PAGE_HEAD + "ab" and "collect_list" not in report.page(cards, ["g"], "pos")._jdf.queryExecution().toString()


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "batch.json").write_text(json.dumps({"project": "p", "lines": [{"id": "a", "text": "x"}, {"id": "b", "text": "y"}]}))
    lines = readers.batch_lines(spark, str(tmp_path / "batch.json")).orderBy("pos").collect()
    assert [(r["pos"], r["line"]["id"]) for r in lines] == [(0, "a"), (1, "b")]
    (tmp_path / "lex.json").write_text(json.dumps({"AI": {"spoken": "A I", "expected": "AI"}, "行": "háng"}, ensure_ascii=False))
    lex = {r["term"]: (r["spoken"], r["pinyin"]) for r in readers.lexicon(spark, str(tmp_path / "lex.json")).collect()}
    assert lex == {"AI": ("A I", None), "行": ("háng", None)}
    (tmp_path / "r/run_0002").mkdir(parents=True)
    (tmp_path / "r/run_0002/manifest.json").write_text(json.dumps({"project": "p", "lines": [{"id": "a", "selection": {"recommended_candidate": 2}}]}))
    row = readers.manifests(spark, str(tmp_path / "r")).first()
    assert row["revision_number"] == 2 and row["line"]["selection"]["recommended_candidate"] == 2
    assert readers.total_bytes(readers.files(spark, str(tmp_path), "*.json")).first()["files"] == 3
    bad = sinks.write_json(spark.createDataFrame([(1, 1.0), (2, float("nan"))], "i int, x double"), str(tmp_path / "out"))
    assert [r["i"] for r in bad.collect()] == [2] and spark.read.json(str(tmp_path / "out")).count() == 1
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_json(spark.range(1).toDF("x"), str(tmp_path / "out"))
    for n in range(2):
        sinks.append_events(spark.createDataFrame([(f"e{n}",)], "event string"), str(tmp_path / "log"))
    assert readers.events(spark, str(tmp_path / "log")).count() == 2
    (tmp_path / "long.txt").write_text("a\nb")
    assert readers.long_text(spark, str(tmp_path / "long.txt")).first()["value"] == "a\nb"


def test_episode(spark, tmp_path):
    voices = _voices(spark, tmp_path)
    lines = spark.createDataFrame([("1", "v1", None, "失落", "¥5", None), ("2", "v2", None, "怪", "b", "mine"), ("3", "nobody", None, None, "c", None)], "id string, character_id string, style string, emotion string, text string, instruct string")
    out = {r["id"]: r for r in workflows.prepare_episode(lines, voices, {}, exact=True).collect()}
    assert (out["1"]["style"], out["1"]["mode"], out["1"]["text"]) == ("sad", "ultimate", "五块")
    assert (out["2"]["style"], out["2"]["mode"], out["2"]["error_code"]) == ("neutral", "ultimate", None) and "怪" in out["2"]["emotion_warning"]
    assert out["3"]["error_code"] == "voice_not_found"
    plain = {r["id"]: r for r in workflows.prepare_episode(lines, voices, {}).collect()}
    assert plain["1"]["style"] == "neutral" and plain["1"]["instruct"].startswith("克制") and plain["2"]["instruct"] == "mine"


def test_attempts_with_adapters(spark):
    def tone():  # the second attempt is the first that can be heard
        return lambda rows: [{"samples": [0.1, -0.1] * 24000 if r["candidate"] >= 2 else [0.0] * 48000, "sample_rate": 48000, "generation_seconds": 2.0} for r in rows]

    def echo():
        return lambda rows: [{"recognized": r["text"]} for r in rows]

    lines = spark.createDataFrame([("l", "你好", 1, "production")], "id string, text string, seed long, profile string")
    plan = workflows.plan_batch(lines, spark.createDataFrame([], "id string"), policy.profiles(spark), ["id"])
    assert plan.count() == 3 and plan.select("attempt_hash").distinct().count() == 3
    done = workflows.run_attempts(plan, ["id"], tone, echo, 0.12).collect()
    assert sorted((r["candidate"], r["qc"], r["transcript"]) for r in done) == [(1, "FAIL", "PASS"), (2, "PASS", "PASS")]
    assert [r["candidate"] for r in done if r["recommended"]] == [2]
    bare = workflows.run_attempts(plan, ["id"]).collect()
    assert {r["qc"] for r in bare} == {r["transcript"] for r in bare} == {"UNAVAILABLE"} and not any(r["recommended"] for r in bare)
    broken = adapters.recognize(plan, lambda: lambda rows: 1 / 0).first()
    assert broken["recognition_status"] == "ERROR" and "zero" in broken["recognition_error"]


def test_early_stop_obeys_the_profile(spark, tmp_path):
    """A stopped line makes no further attempt; a profile without the flag, or no profile, makes all."""
    calls = str(tmp_path)

    def tone():
        def make(rows):
            import os
            import uuid

            for r in rows:
                open(os.path.join(calls, f"{r['id']}-{r['candidate']}-{uuid.uuid4().hex}"), "w").close()
            return [{"samples": [0.1, -0.1] * 24000, "sample_rate": 48000, "generation_seconds": 2.0} for r in rows]

        return make

    lines = spark.createDataFrame([("a", "你好", 1, "quality"), ("b", "你好", 1, "ultimate"), ("c", "你好", 1, "balanced")], "id string, text string, seed long, profile string")
    plan = workflows.plan_batch(lines, lines.where("id = 'c'").select("id"), policy.profiles(spark), ["id"])
    made = workflows.run_attempts(plan, ["id"], tone, lambda: lambda rows: [{"recognized": r["text"]} for r in rows], 0.12)
    assert sorted((r["id"], r["candidate"]) for r in made.collect()) == [("a", 1), ("b", 1), ("b", 2), ("b", 3)]
    import os

    assert sorted(n[:3] for n in os.listdir(calls)) == ["a-1", "b-1", "b-2", "b-3"]
    assert workflows.run_attempts(plan.drop("early_stop"), ["id"], tone).count() == 6
    rows = spark.createDataFrame([("x", 1, True), ("x", 2, True), ("y", 1, False), ("y", 2, False), ("z", 1, None), ("z", 2, None)], "line string, candidate int, flag boolean").withColumns({"qc": F.lit("PASS"), "transcript": F.lit("PASS")})
    assert policy.early_stop(rows, ["line"], ["candidate"], enabled=F.col("flag")).groupBy("line").count().orderBy("line").collect() == [("x", 1), ("y", 2), ("z", 2)]


def test_batch_run_resumes(spark, tmp_path):
    tone = lambda: lambda rows: [{"samples": [0.1, -0.1] * 24000, "sample_rate": 48000, "generation_seconds": 2.0} for r in rows]
    echo = lambda: lambda rows: [{"recognized": r["text"]} for r in rows]
    lines = spark.createDataFrame([("p", "a", "你好", 1, "quality"), ("p", "b", "再见", 1, "quality"), ("q", "c", "你好", 1, "quality")], "project string, id string, text string, seed long, profile string")
    known = lines.select("project", "id", F.when(F.col("project") == "q", "reference_missing").alias("error_code"), *(F.lit("h").alias(c) for c in ("reference_sha256", "reference_transcript_sha256", "voice_sha256")))
    none = spark.createDataFrame([], "project string, revision int, fingerprint string, intact boolean")
    done = spark.createDataFrame([], "project string, revision int, id string")

    def run(rows, files, finished, name):
        out = workflows.run_batch(rows, known, {"model": "m"}, files, finished, policy.profiles(spark), str(tmp_path / name), tone, echo, 0.12)
        return {r["project"]: r for r in out.collect()}

    first = run(lines, none, done, "one")
    assert first["q"]["error_code"] == "reference_missing" and first["q"]["lines_made"] == 0 and first["q"]["revision"] is None
    assert (first["p"]["revision"], first["p"]["resumed"], first["p"]["lines_made"]) == (1, False, 2)
    print_ = first["p"]["fingerprint"]
    assert run(lines.repartition(3), none, done, "two")["p"]["fingerprint"] == print_
    kept = spark.createDataFrame([("p", 1, print_, True), ("p", 1, print_, True)], none.schema)
    again = run(lines, kept, spark.createDataFrame([("p", 1, "a")], done.schema), "three")["p"]
    assert (again["revision"], again["resumed"], again["lines_made"]) == (1, True, 1)
    assert {r["id"] for r in workflows.finished_lines(spark, str(tmp_path / "three")).collect()} == {"b"}
    takes = {r["name"]: r["path"] for r in store.written(spark, str(tmp_path / "three")).collect()}
    assert sorted(takes) == [f"p/run_0001/b/{n}" for n in ("candidate_01.json", "candidate_01.wav", "selection.json")]
    assert readers.decode_wav(open(takes["p/run_0001/b/candidate_01.wav"], "rb").read())["samples"][:2] == pytest.approx([0.1, -0.1], abs=1e-6)
    assert json.loads(open(takes["p/run_0001/b/selection.json"]).read())["recommended_output"] == "p/run_0001/b/candidate_01.wav"
    unsafe = run(lines.withColumn("id", F.lit("..")), none, done, "six")["p"]
    assert unsafe["error_code"] == "configuration_error" and unsafe["lines_made"] == 0
    damaged = spark.createDataFrame([("p", 1, print_, True), ("p", 1, print_, False)], none.schema)
    assert run(lines, damaged, done, "four")["p"]["revision"] == 2
    changed = run(lines.withColumn("text", F.concat("text", F.lit("。"))), kept, done, "five")["p"]
    assert changed["fingerprint"] != print_ and (changed["revision"], changed["resumed"]) == (2, False)


def test_reference_identity_and_delivery_audit(spark):
    voices = spark.createDataFrame([("v", "V", "neutral", {"neutral": ("a.wav", " 你好 ", "h1"), "sad": ("b.wav", "", None), "loud": ("c.wav", "x", "old"), "off": ("d.wav", "x", None), "gone": ("e.wav", "x", None)})],
                                   "id string, name string, default_style string, styles map<string, struct<reference: string, transcript_text: string, reference_sha256: string>>")
    clips = spark.createDataFrame([(p, f"h{k}", (48000, 1, 6.0, 0.5, 0.1, False, False, False), (s,)) for k, (p, s) in enumerate([("a.wav", "PASS"), ("b.wav", "PASS"), ("c.wav", "PASS"), ("d.wav", "FAIL")], 1)],
                                  "path string, sha256 string, stats struct<sample_rate: int, channels: int, duration: double, peak: double, rms: double, has_nan: boolean, has_inf: boolean, clipping: boolean>, qc struct<status: string>")
    asked = spark.createDataFrame([(str(k), "v", s) for k, s in enumerate([None, "sad", "loud", "off", "gone", "none"])] + [("9", "w", None)], "line string, character_id string, style string")
    got = {r["line"]: r for r in catalog.reference_identity(asked, catalog.styles(voices), clips).collect()}
    assert [got[k]["error_code"] for k in "0123459"] == [None, "transcript_empty", "reference_changed", "reference_invalid", "reference_missing", "style_not_found", "voice_not_found"]
    import hashlib

    assert got["0"]["reference_transcript"] == "你好" and got["0"]["reference_transcript_sha256"] == hashlib.sha256("你好".encode()).hexdigest()
    assert got["0"]["resolved_style"] == "neutral" and got["0"]["reference_sha256"] == "h1" and got["0"]["voice_sha256"] and got["1"]["voice_sha256"] is None
    audio = clips.withColumn("stem", F.regexp_replace("path", ".wav", ""))
    meta = spark.createDataFrame([("a", "a.wav", "h1", "r", "m", "t", "PASS"), ("b", "x.wav", "zz", None, "m", "t", None), ("zz", "", "", "", "", "", "")], "stem string, output string, audio_sha256 string, model_revision string, mode string, text string, transcript_status string")
    rows = {r["path"]: r for r in report.delivery_audit(audio, meta).collect()}
    assert rows["a.wav"]["errors"] == rows["a.wav"]["warnings"] == [] and rows["a.wav"]["transcript_status"] == "PASS"
    assert rows["b.wav"]["errors"] == ["output_differs", "checksum_mismatch"] and rows["b.wav"]["warnings"] == ["model_revision_missing"]
    assert rows["c.wav"]["errors"] == ["metadata_missing"] and rows["d.wav"]["errors"] == ["invalid_audio", "metadata_missing"] and len(rows) == 4
    total = report.delivery_summary(report.delivery_audit(audio, meta)).first()
    assert (total["files"], total["errors"], total["warnings"], total["passed"]) == (4, 5, 1, False)
    assert report.delivery_summary(report.delivery_audit(audio.limit(0), meta)).first()["errors"] == 1


def test_calibration(spark):
    rows = [(i, f"h{i}", "b", "你好", "你好" if i else "你", True, "ann", True) for i in range(31)] + [(99, "x", "b", "你好", "你好", True, "ann", None)]
    samples = spark.createDataFrame(rows, "pos int, audio_sha256 string, backend_id string, human_transcript string, recognized string, listened boolean, reviewer string, tts_correct boolean")
    row = workflows.calibration(samples, 0.12).first()
    assert row["reviewed_samples"] == 31 and row["false_retry_rate"] == pytest.approx(1 / 31)
    assert workflows.benchmark_plan(spark.createDataFrame([("c", "失落")], "id string, emotion string"), [10, 20]).count() == 2
    assert align.LIMIT == 5000


def test_model_identity(spark, tmp_path):
    import hashlib
    import json

    from sonarlake.functions.identity import runtime_versions

    revision, contents = "a" * 40, {"config.json": '{"quantization": {}}', "tokenizer.json": "{}", "s/one.bin": "1" * 100, "two.bin": "2"}
    contents["model.safetensors.index.json"] = json.dumps({"weight_map": {"a.w": "s/one.bin", "b.w": "two.bin", "c.w": "two.bin"}})

    def model(name, changed=(), without=(), unlisted=(), **other):
        root = tmp_path / name
        for n, text in (contents | other.get("files", {})).items():
            if n not in without:
                (root / n).parent.mkdir(parents=True, exist_ok=True)
                (root / n).write_text(text + ("!" if n in changed else ""))
            receipt = root / ".cache/huggingface/download" / f"{n}.metadata"
            receipt.parent.mkdir(parents=True, exist_ok=True)
            data = text.encode()
            etag = hashlib.sha256(data).hexdigest() if n.endswith(".bin") else hashlib.sha1(b"blob %d\0" % len(data) + data).hexdigest()
            if n not in unlisted:
                receipt.write_text(f"{revision}\n{etag}\n123.4\n")
        return workflows.verify_model(spark, str(root), other.get("revision", revision)).first()

    good = model("good")
    assert good["error_code"] is None
    assert [tuple(f) for f in good["files"]] == [(n, hashlib.sha256(t.encode()).hexdigest()) for n, t in sorted(contents.items())]
    assert model("old", revision="b" * 40)["error_code"] == "revision_differs"
    assert model("edited", changed=["two.bin"])["error_code"] == "artifact_changed"
    # The weight map asks for a shard that neither the folder nor the receipts have.
    assert model("lacks", without=["s/one.bin"], unlisted=["s/one.bin"])["error_code"] == "model_file_missing"
    assert model("unlisted", unlisted=["two.bin"])["error_code"] == "revision_differs"
    assert model("first", changed=["tokenizer.json"], without=["two.bin"])["error_code"] == "artifact_changed"
    for key in ("quantization", "quantization_config"):
        assert model(key, files={"config.json": json.dumps({key: {"bits": 4}})})["error_code"] == "model_quantized"
    assert model("unsafe", files={"model.safetensors.index.json": json.dumps({"weight_map": {"a": "../two.bin"}})})["error_code"] == "model_file_missing"
    assert spark.range(1).select(*(c.alias(k) for k, c in runtime_versions(("pyspark", "no-such")).items())).first()["no-such"] is None


def test_plans_of_more_candidates_are_refused(spark):
    tone = lambda: lambda rows: [{"samples": [0.1, -0.1] * 24000, "sample_rate": 48000, "generation_seconds": 2.0} for r in rows]
    plan = spark.createDataFrame([("a", k, "x") for k in range(0, 8)] + [("b", None, "x")], "id string, candidate int, text string")
    made = workflows.run_attempts(plan, ["id"], tone).collect()
    assert sorted((r["candidate"] or -1, r["error_code"], r["samples"] is None) for r in made) == [(-1, "configuration_error", True), (-1, "configuration_error", True)] + [
        (k, None, False) for k in range(1, 6)] + [(6, "configuration_error", True), (7, "configuration_error", True)]


def test_a_killed_batch_goes_on(spark, tmp_path):
    """The recognizer ends the driver's work in the third micro-batch, once; no line of the finished ones is taken again."""
    takes, broken = tmp_path / "takes", tmp_path / "broken"
    takes.mkdir()
    folder = str(takes)

    def tone():
        def make(rows):
            import os
            import uuid

            for r in rows:
                open(os.path.join(folder, f"{r['id']}-{uuid.uuid4().hex}"), "w").close()
            return [{"samples": [0.1, -0.1] * 24000, "sample_rate": 48000, "generation_seconds": 2.0} for r in rows]

        return make

    echo = lambda: lambda rows: [{"recognized": r["text"]} for r in rows]
    lines = spark.createDataFrame([("p", f"l{k}", "你好", 1, "balanced") for k in range(12)], "project string, id string, text string, seed long, profile string")
    known = lines.select("project", "id", F.lit(None).cast("string").alias("error_code"), *(F.lit("h").alias(c) for c in ("reference_sha256", "reference_transcript_sha256", "voice_sha256")))
    none = spark.createDataFrame([], "project string, revision int, fingerprint string, intact boolean")
    done = spark.createDataFrame([], "project string, revision int, id string")
    root = str(tmp_path / "out")
    written, calls = store.write_files, []

    def dies(*args, **options):
        calls.append(options["batch"])
        if len(calls) == 3:
            raise RuntimeError("the driver is lost")
        return written(*args, **options)

    run = lambda: workflows.run_batch(lines, known, {"model": "m"}, none, done, policy.profiles(spark), root, tone, echo, 0.12, lines_at_once=2).first()
    store.write_files = dies
    try:
        with pytest.raises(Exception, match="the driver is lost"):
            run()
    finally:
        store.write_files = written
    first = {r["id"] for r in workflows.finished_lines(spark, root).collect()}
    assert 0 < len(first) < 12
    assert run()["lines_made"] == 12
    import os

    count = {f"l{k}": sum(n.startswith(f"l{k}-") for n in os.listdir(folder)) for k in range(12)}
    assert all(count[k] == 1 for k in first) and all(n >= 1 for n in count.values()) and sum(n > 1 for n in count.values()) <= 6
    before = len(os.listdir(folder))
    assert run()["lines_made"] == 12 and len(os.listdir(folder)) == before
