"""More registered queries, each with its SQL: rules, readings, identities, resume and reports over the driver's tables.

As in ``queries``, the tables stand in for requests, clips and catalogues; each query runs the operator that it is
about, and its SQL says the rule in its own way.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from sonarlake.functions import align, emotion, identity, lexicon, reading, signal
from sonarlake.operators import catalog, lifecycle, policy, report, validate
from sonarlake.plans import workflows
from sonarlake.plans.queries import _A, _D, _PAIRS, _PRIORITY, RATE, SILENT, _clips, _pairs, _sql_integer, _t, _voices, query, r6
from sonarlake.shared import small_batches
from sonarlake.sources import readers, sinks

# ---- rules of requests -----------------------------------------------------------------------------


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 7 NOT BETWEEN 1 AND 5 OR o_orderkey % 120 NOT BETWEEN 1 AND 100 THEN 'configuration_error' END AS error_code FROM orders""")
def profile_check(spark, d):
    steps = policy.custom_steps((F.col("o_orderkey") % 120).cast("int"), (F.col("o_custkey") % 7).cast("int"))
    return _t(spark, d, "orders").select("o_orderkey", policy.profile_error(steps).alias("error_code"))


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 7 NOT BETWEEN 1 AND 5 OR o_orderkey < 5 OR o_orderkey - 5 + 4294967000 > 4294967295 OR o_orderkey % 110 NOT BETWEEN 1 AND 100 THEN 'configuration_error' END AS error_code FROM orders""")
def plan_check(spark, d):
    o = F.col("o_orderkey")
    return _t(spark, d, "orders").select("o_orderkey", policy.plan_error(F.col("o_custkey") % 7, F.when(o < 5, -1).otherwise(o - 5 + 4294967000), o % 110).alias("error_code"))


@query("""SELECT o_orderkey, array_to_string(list_filter([
        CASE WHEN o_orderkey - 10 < 0 THEN 'seed_range' END, CASE WHEN o_custkey % 110 NOT BETWEEN 1 AND 100 THEN 'inference_timesteps_range' END,
        CASE WHEN o_orderkey % 100 / 8.0 NOT BETWEEN 2 AND 10 THEN 'cfg_value_range' END, CASE WHEN o_custkey % 13 > 10 THEN 'warmup_patches_range' END,
        CASE WHEN o_orderkey < 2 OR o_orderkey > 10000 THEN 'max_tokens_range' END, CASE WHEN o_custkey % 8 NOT BETWEEN 1 AND 5 THEN 'candidates_range' END], lambda x: x IS NOT NULL), ',') AS violations FROM orders""")
def option_check(spark, d):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = _t(spark, d, "orders").select(
        "o_orderkey", (o - 10).alias("seed"), (c % 110).alias("inference_timesteps"), (o % 100 / 8.0).alias("cfg_value"), (c % 13).alias("warmup_patches"), o.alias("max_tokens"), (c % 8).alias("candidates"))
    return rows.select("o_orderkey", F.array_join(validate.option_violations(rows.columns), ",").alias("violations"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN '' ELSE array_to_string(list_filter([
        CASE WHEN turn % 3 = 0 THEN 'preparation_incomplete' END, CASE WHEN turn % 4 <> 1 AND text || '!' <> text THEN 'preparation_text_differs' END], lambda x: x IS NOT NULL), ',') END AS violations FROM conversations""")
def preparation_check(spark, d):
    t, text = F.col("turn"), F.col("text")
    keys = F.array(*(F.lit(k) for k in validate.PREPARATION_KEYS))
    spoken = F.struct(F.when(t % 4 == 1, text).otherwise(F.concat(text, F.lit("!"))).alias("text_spoken"))
    found = validate.preparation_violations(F.when(t % 4 != 0, spoken), text, F.when(t % 3 == 0, F.array_remove(keys, "pronunciation")).otherwise(keys))
    return _t(spark, d, "conversations").select("conv_id", "turn", F.array_join(found, ",").alias("violations"))


_PART_OF = "CASE c_custkey % 7 WHEN 0 THEN '.' WHEN 1 THEN '..' WHEN 2 THEN 'a/' || c_name WHEN 3 THEN '' WHEN 4 THEN 'a\\' || c_name WHEN 5 THEN NULL ELSE c_name END"


def _component():
    k, name = F.col("c_custkey") % 7, F.col("c_name")
    return F.when(k == 0, ".").when(k == 1, "..").when(k == 2, F.concat(F.lit("a/"), name)).when(k == 3, "").when(k == 4, F.concat(F.lit("a\\"), name)).when(k == 5, F.lit(None)).otherwise(name)


@query(f"SELECT c_custkey, coalesce(x <> '' AND x <> '.' AND x <> '..' AND NOT contains(x, '/') AND NOT contains(x, '\\'), false) AS safe FROM (SELECT c_custkey, {_PART_OF} AS x FROM customer)")
def safe_components(spark, d):
    return _t(spark, d, "customer").select("c_custkey", validate.safe_component(_component()).alias("safe"))


@query("""SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN false ELSE true END AS inside FROM customer""")
def contained_paths(spark, d):
    """Paths of six shapes: plain, escaping, dotted inside, a sibling with the same beginning, far escape, doubled slashes."""
    k, n = F.col("c_custkey") % 6, F.col("c_name")
    at = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    path = (
        F.when(k == 0, at("/root/voices/", n, "/a.wav")).when(k == 1, at("/root/voices/../", n)).when(k == 2, at("/root/voices/x/../", n, "/./b.wav"))
        .when(k == 3, at("/root/voices2/", n)).when(k == 4, at("/root/voices/a/../../../", n)).otherwise(at("/root//voices//", n))
    )
    return _t(spark, d, "customer").select("c_custkey", validate.contained(path, F.lit("/root/voices/")).alias("inside"))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 <> 0 AND NOT (lang = 'en' AND n_chars >= 30 AND quality = 1 AND doc_id % 9 / 8.0 <= 0.9) THEN 'configuration_error' END AS error_code
    FROM documents JOIN labels USING (doc_id)""")
def calibration_gate(spark, d):
    """Languages as backends, lengths as sample counts, labels as the review."""
    i, c = F.col("doc_id"), F.col
    rows = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id")
    threshold = F.when(i % 9 / 8.0 > 0.9, F.lit(float("nan"))).otherwise(i % 9 / 8.0)
    return rows.select("doc_id", align.calibration_error(F.lit("en"), F.when(i % 5 != 0, c("lang")), c("n_chars"), c("quality") == 1, F.lit("x"), threshold).alias("error_code"))


@query("""SELECT event_id, contains(lower(m), 'out of memory') OR contains(lower(m), 'insufficient memory') OR contains(lower(m), 'allocation') OR contains(lower(m), 'metal device') AS oom
    FROM (SELECT event_id, CASE user_id % 4 WHEN 0 THEN 'Out Of Memory in ' || event_type WHEN 1 THEN event_type || ': ALLOCATION failed' WHEN 2 THEN 'metal ' || event_type ELSE event_type END AS m FROM events)""")
def oom_errors(spark, d):
    u, e = F.col("user_id") % 4, F.col("event_type")
    message = F.when(u == 0, F.concat(F.lit("Out Of Memory in "), e)).when(u == 1, F.concat(e, F.lit(": ALLOCATION failed"))).when(u == 2, F.concat(F.lit("metal "), e)).otherwise(e)
    return _t(spark, d, "events").select("event_id", validate.is_out_of_memory(message).alias("oom"))


@query("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END, 'dialogue') AS profile, 3 AS candidates, coalesce(nullif(c_nationkey, 4), 7) AS seed FROM customer")
def request_defaults(spark, d):
    rows = _t(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("profile"), F.nullif(F.col("c_nationkey"), F.lit(4)).alias("seed"))
    return validate.with_defaults(rows, {"profile": "dialogue", "candidates": 3, "seed": 7})


_SOURCE = "CASE c_custkey % 4 WHEN 0 THEN '{}' WHEN 1 THEN '{\"candidates\": null}' WHEN 2 THEN '{\"profile\": \"' || c_mktsegment || '\", \"candidates\": 2}' ELSE '{\"profile\": null, \"seed\": ' || c_custkey || '}' END"


@query(f"""WITH s AS (SELECT c_custkey, {_SOURCE} AS j FROM customer)
    SELECT c_custkey, CASE WHEN list_contains(json_keys(j), 'profile') THEN json_extract_string(j, '$.profile') ELSE 'production' END AS profile,
           CASE WHEN list_contains(json_keys(j), 'candidates') THEN json_extract_string(j, '$.candidates') ELSE '3' END AS candidates FROM s""")
def source_defaults(spark, d):
    """Defaults for keys that a source lacks; explicit nulls stay."""
    rows = _t(spark, d, "customer").select("c_custkey", validate.json_defaults(F.expr(_SOURCE), {"profile": "production", "candidates": 3}).alias("s"))
    return rows.select("c_custkey", "s.profile", "s.candidates")


@query("SELECT page_id, coalesce(octet_length(encode(html)) > 1024 AND page_id % 5 <> 0, false) AS complete FROM pages")
def complete_takes(spark, d):
    return _t(spark, d, "pages").select("page_id", F.coalesce(validate.complete_take(F.octet_length("html"), F.col("page_id") % 5 != 0), F.lit(False)).alias("complete"))


@query("""SELECT term, array_to_string(list_filter([CASE WHEN coalesce(term, '') = '' THEN 'empty_key' END, CASE WHEN spoken IS NULL AND pinyin IS NULL THEN 'spoken_or_pinyin_required' END,
        CASE WHEN trim(spoken) = '' THEN 'invalid_spoken' END, CASE WHEN trim(pinyin) = '' THEN 'invalid_pinyin' END], lambda x: x IS NOT NULL), ',') AS violations
    FROM (SELECT CASE WHEN p_partkey % 11 <> 0 THEN p_name || p_partkey ELSE '' END AS term, CASE p_size % 4 WHEN 0 THEN '  ' WHEN 1 THEN p_brand END AS spoken, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN p_type END AS pinyin FROM part)""")
def lexicon_check(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    term = F.when(k % 11 != 0, F.concat("p_name", k.cast("string"))).otherwise("")
    spoken, pinyin = F.when(s % 4 == 0, "  ").when(s % 4 == 1, F.col("p_brand")), F.when(k % 3 == 0, "").when(k % 3 == 1, F.col("p_type"))
    return _t(spark, d, "part").select(term.alias("term"), F.array_join(lexicon.violations(term, spoken, F.lit(None).cast("string"), pinyin), ",").alias("violations"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 OR c_custkey % 3 = 0 THEN 'model_lock_invalid' END AS error_code FROM customer""")
def lock_check(spark, d):
    k = F.col("c_custkey")
    revision = F.when(k % 3 == 0, F.substring(F.sha1(F.col("c_name")), 1, 39)).otherwise(F.sha1(F.col("c_name")))
    return _t(spark, d, "customer").select("c_custkey", identity.lock_error(F.when(k % 4 != 0, "org/model").otherwise("org/other"), "org/model", F.lit("model"), "model", revision).alias("error_code"))


# ---- readings --------------------------------------------------------------------------------------


def _sql_digits(x: str) -> str:
    return f"translate({x}, '0123456789', '{_D}')"


@query(f"SELECT o_orderkey, {_sql_digits('CAST(year(o_orderdate) AS VARCHAR)')} || '年' AS spoken FROM orders")
def year_phrases(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", reading.year_reading(F.concat(F.lit("於"), F.date_format("o_orderdate", "yyyy"), F.lit("年底"))).alias("spoken"))


@query(f"""WITH x AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '1' || (3 + c_custkey % 7) || lpad(CAST(c_custkey AS VARCHAR), 9, '7') WHEN 1 THEN '0' || (10 + c_nationkey) || '-' || lpad(CAST(c_custkey AS VARCHAR), 8, '2') ELSE '12' || c_custkey END AS n FROM customer)
    SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN {_sql_digits('n')} WHEN 1 THEN {_sql_digits("replace(n, '-', '，')")} END AS spoken FROM x""")
def phone_readings(spark, d):
    k, s = F.col("c_custkey"), F.col("c_custkey").cast("string")
    mobile = F.concat(F.lit("1"), (3 + k % 7).cast("string"), F.lpad(s, 9, "7"))
    line = F.concat(F.lit("0"), (10 + F.col("c_nationkey")).cast("string"), F.lit("-"), F.lpad(s, 8, "2"))
    return _t(spark, d, "customer").select("c_custkey", reading.phone_reading(F.when(k % 3 == 0, mobile).when(k % 3 == 1, line).otherwise(F.concat(F.lit("12"), s))).alias("spoken"))


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, '百分之' || CASE WHEN l_linenumber % 2 = 0 THEN '负' ELSE '' END || {_sql_integer('CAST(round(l_discount * 100) AS BIGINT)')} || '点五' AS spoken FROM lineitem")
def percent_readings(spark, d):
    text = F.concat(F.when(F.col("l_linenumber") % 2 == 0, "-").otherwise(""), F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.lit(".5%"))
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", reading.percent_reading(text).alias("spoken"))


@query(f"""SELECT p_partkey, {_sql_integer('CAST(floor(p_retailprice) AS BIGINT)')} || CASE p_partkey % 3 WHEN 0 THEN '块' WHEN 1 THEN '美元' END AS dialogue,
        {_sql_integer('CAST(floor(p_retailprice) AS BIGINT)')} || CASE p_partkey % 3 WHEN 0 THEN '元' WHEN 1 THEN '美元' END AS narration FROM part""")
def money_readings(spark, d):
    k = F.col("p_partkey") % 3
    text = F.concat(F.when(k == 0, "¥").when(k == 1, "$").otherwise("£"), F.floor("p_retailprice").cast("string"))
    return _t(spark, d, "part").select("p_partkey", reading.money_reading(text, "dialogue").alias("dialogue"), reading.money_reading(text, "narration").alias("narration"))


@query("SELECT p_partkey, p_partkey || '加' || p_size || '乘以2减' || '1等于' || p_size || ' a+b 7 - x' AS spoken FROM part")
def operator_phrases(spark, d):
    text = F.concat(F.col("p_partkey").cast("string"), F.lit(" + "), F.col("p_size").cast("string"), F.lit("×2-1 ="), F.col("p_size").cast("string"), F.lit(" a+b 7 - x"))
    return _t(spark, d, "part").select("p_partkey", reading.operator_words(text).alias("spoken"))


@query("SELECT c_custkey, c_name || ' x……' || c_mktsegment || '到' || '9' AS text FROM customer")
def squeezed_text(spark, d):
    raw = F.concat(F.lit(" \t "), F.col("c_name"), F.lit("　 \n x..."), F.col("c_mktsegment"), F.lit("~9  "))
    return _t(spark, d, "customer").select("c_custkey", reading.squeeze(raw).alias("text"))


# ---- identities and files --------------------------------------------------------------------------


@query("""WITH x AS (SELECT conv_id, turn, text, CASE conv_id % 3 WHEN 0 THEN sha256(text) WHEN 1 THEN sha1('blob ' || octet_length(encode(text)) || chr(0) || text) ELSE sha1(text) END AS etag FROM conversations)
    SELECT conv_id, turn, etag, conv_id % 3 <> 2 AS verified FROM x""")
def artifact_check(spark, d):
    blob = F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length("text").cast("string")), "UTF-8"), F.unhex(F.lit("00")), F.encode("text", "UTF-8")))
    etag = F.when(F.col("conv_id") % 3 == 0, F.sha2("text", 256)).when(F.col("conv_id") % 3 == 1, blob).otherwise(F.sha1("text"))
    rows = _t(spark, d, "conversations").withColumn("etag", etag)
    return rows.select("conv_id", "turn", "etag", identity.verified_artifact(F.encode("text", "UTF-8"), F.col("etag")).alias("verified"))


@query("SELECT event_id, sha256('{\"a\":[1,\"é\"],\"k\":' || json_extract_string(props, '$.k') || '}') AS sha256 FROM events")
def json_identity(spark, d):
    """Keys in another order, blanks and escapes don't change the identity."""
    text = F.concat(F.lit('{ "k": '), F.get_json_object("props", "$.k"), F.lit(' ,  "a" : [1, "\\u00e9"] }'))
    return _t(spark, d, "events").select("event_id", identity.json_fingerprint(text).alias("sha256"))


@query("""SELECT o_orderkey, o_orderkey % 4 <> 1 AND o_orderkey % 6 <> 2 AS intact FROM orders""")
def files_verified(spark, d):
    k = F.col("o_orderkey")
    rows = _t(spark, d, "orders").select(k.alias("path"), F.sha2(k.cast("string"), 256).alias("sha256"))
    found = rows.where("path % 4 <> 1").withColumn("sha256", F.when(F.col("path") % 6 == 2, "changed").otherwise(F.col("sha256")))
    return lifecycle.verify_files(rows, found).select(F.col("path").alias("o_orderkey"), "intact")


@query("""WITH f AS (SELECT o_custkey, year(o_orderdate) AS revision, bool_and(o_orderkey % 4 <> 1 AND o_custkey % 3 <> 0) AS valid FROM orders GROUP BY ALL)
    SELECT o_custkey, CAST(max(CASE WHEN valid THEN revision END) AS INTEGER) AS reusable, CAST(max(revision) + 1 AS INTEGER) AS next_revision FROM f GROUP BY o_custkey""")
def revision_reuse(spark, d):
    """Orders as files of revisions (a customer's years): one is reusable if all its files are intact and its fingerprint is the wanted one."""
    k = F.col("o_orderkey")
    files = _t(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("revision"), (k % 4 != 1).alias("intact"), F.when(F.col("o_custkey") % 3 == 0, "old").otherwise("new").alias("fingerprint"), F.lit("new").alias("wanted"))
    return policy.newest_valid(lifecycle.revision_validity(files, ["o_custkey", "revision"], "fingerprint", "wanted"), ["o_custkey"])


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'reuse' WHEN o_orderkey % 5 = 1 THEN 'conflict' WHEN o_orderkey % 5 = 2 THEN 'skip' ELSE 'run' END AS action FROM orders""")
def resume_actions(spark, d):
    k = F.col("o_orderkey")
    plan = _t(spark, d, "orders").select(k.alias("output"), F.col("o_orderpriority").alias("attempt_hash"))
    outputs = plan.where("output % 5 < 2").withColumn("attempt_hash", F.when(F.col("output") % 5 == 1, "other").otherwise(F.col("attempt_hash")))
    errors = plan.where("output % 5 IN (2, 3)").withColumn("attempt_hash", F.when(F.col("output") % 5 == 3, "other").otherwise(F.col("attempt_hash")))
    return policy.attempts_to_run(plan, outputs, errors).select(F.col("output").alias("o_orderkey"), "action")


@query("SELECT page_id, regexp_replace(url, '[.][^./]*$', '') AS stem FROM pages")
def path_stems(spark, d):
    return _t(spark, d, "pages").select("page_id", readers.stem(F.col("url")).alias("stem"))


@query("SELECT CAST(sum(octet_length(encode(html))) AS BIGINT) AS bytes, count(*) AS files FROM pages")
def listing_totals(spark, d):
    return readers.total_bytes(_t(spark, d, "pages").select(F.col("url").alias("path"), F.octet_length("html").cast("long").alias("length")))


# ---- signal ----------------------------------------------------------------------------------------


@query(f"""SELECT vec_id, vec_id % 3 = 0 AS has_nan, vec_id % 3 = 1 AS has_inf, CASE vec_id % 3 WHEN 0 THEN 'not_finite' WHEN 1 THEN 'not_finite' ELSE 'sample_rate' END AS refused FROM embeddings""")
def broken_samples(spark, d):
    bad = F.when(F.col("vec_id") % 3 == 0, float("nan")).when(F.col("vec_id") % 3 == 1, float("-inf")).otherwise(0.0).cast("float")
    a = F.concat(F.array(bad), F.col("embedding"))
    return _clips(spark, d).select("vec_id", signal.has_nan(a).alias("has_nan"), signal.has_inf(a).alias("has_inf"), signal.writable(a, F.col("rate")).alias("refused"))


@query(f"SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN 'empty' WHEN list_max(list_transform({_A}, lambda x: abs(x))) * (vec_id % 4) >= 1 THEN 'over_full_scale' END AS refused FROM embeddings")
def write_gate(spark, d):
    a = F.when(F.col("vec_id") % 4 > 0, F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") % 4)))
    return _clips(spark, d).select("vec_id", signal.writable(a, F.lit(signal.TARGET_RATE)).alias("refused"))


@query(f"""WITH m AS (SELECT vec_id, list_transform(range(1, len(embedding) + 1), lambda i: (CAST(embedding[i] AS DOUBLE) + embedding[len(embedding) + 1 - i]) / 2) AS a FROM embeddings)
    SELECT vec_id, round(list_max(list_transform(a, lambda x: abs(x))), 6) AS peak, round(a[1], 6) AS head FROM m""")
def mono_mix(spark, d):
    both = F.array(F.col("embedding").cast("array<double>"), F.reverse("embedding").cast("array<double>"))
    return _clips(spark, d).withColumn("m", signal.mono(both)).select("vec_id", r6(signal.peak(F.col("m"))).alias("peak"), r6(F.element_at("m", 1)).alias("head"))


@query("""SELECT c_custkey, round(least(-16 - c_acctbal / 200, CASE WHEN c_custkey % 2 = 0 THEN -2.0 ELSE -1.0 END - c_acctbal / 900), 6) AS gain_db, abs(c_acctbal / 200 + 16) < 1 AS achieved FROM customer""")
def loudness_gain(spark, d):
    b, ceiling = F.col("c_acctbal"), F.when(F.col("c_custkey") % 2 == 0, -2.0)
    return _t(spark, d, "customer").select("c_custkey", r6(signal.gain_to_loudness(b / 200, b / 900, F.lit(-16.0), ceiling)).alias("gain_db"), lifecycle.target_achieved(b / 200, F.lit(-16.0)).alias("achieved"))


@query(f"""
    WITH a AS (SELECT vec_id, {_A} AS a FROM embeddings),
    s AS (SELECT vec_id, list_max(list_transform(a, lambda x: abs(x))) AS peak, list_max(list_transform(range(1, len(a)), lambda i: abs(a[i + 1] - a[i]))) AS jump,
                 len(list_filter(a, lambda x: abs(x) < {SILENT})) / CAST(len(a) AS DOUBLE) AS quiet, list_sum(a) / len(a) AS dc, sqrt(list_sum(list_transform(a, lambda x: x * x)) / len(a)) AS rms FROM a)
    SELECT vec_id, array_to_string(list_filter(['sample_rate', CASE WHEN peak >= 0.999 THEN 'clipping' END, CASE WHEN peak <= 1e-5 THEN 'silence_only' END, 'not_pcm24'], lambda x: x IS NOT NULL), ',') AS failures,
           array_to_string(list_filter([CASE WHEN rms < 0.003 THEN 'low_energy' END, CASE WHEN peak > 0.98 THEN 'near_full_scale' END, CASE WHEN abs(dc) > 0.02 THEN 'dc_offset' END,
               CASE WHEN quiet > 0.65 THEN 'excessive_silence_ratio' END, CASE WHEN jump > 0.5 THEN 'waveform_discontinuity' END, 'suspiciously_short'], lambda x: x IS NOT NULL), ',') AS warnings FROM s""")
def qc_rules(spark, d):
    """Failures and warnings by name; clips of four seconds for a text of two hundred characters."""
    s = signal.stats(F.col("embedding"), F.col("rate"), silence=SILENT, edge=-1.0).withField("longest_silence_seconds", F.lit(0.0))
    verdict = signal.audio_qc(s, F.lit("x" * 200))
    return _clips(spark, d).withColumn("v", verdict).select("vec_id", F.array_join("v.failures", ",").alias("failures"), F.array_join("v.warnings", ",").alias("warnings"))


@query(f"""WITH a AS (SELECT vec_id, list_max(list_transform({_A}, lambda x: abs(x))) AS peak FROM embeddings)
    SELECT vec_id, CASE WHEN peak >= 0.999 THEN 'clipping' ELSE '' END AS refused, 'duration,sample_rate' AS advice FROM a""")
def reference_check(spark, d):
    s = signal.stats(F.col("embedding"), F.col("rate"), silence=-1.0)
    refused, advice = validate.reference_rules(F.col("s"))
    return _clips(spark, d).withColumn("s", s).select("vec_id", F.array_join(refused, ",").alias("refused"), F.array_join(advice, ",").alias("advice"))


# ---- catalogue, reviews, reports -------------------------------------------------------------------


@query(f"""WITH a AS (SELECT label, vec_id, list_max(list_transform({_A}, lambda x: abs(x))) AS peak FROM embeddings)
    SELECT count(DISTINCT label) AS characters, count(*) AS styles, CAST(sum(CASE WHEN vec_id % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN peak >= 0.999 THEN 1 ELSE 0 END) AS BIGINT) AS errors,
           CAST(sum(1 + CASE WHEN peak > 0.4 THEN 1 ELSE 0 END) AS BIGINT) AS warnings FROM a""")
def library_summary(spark, d):
    rows = _clips(spark, d).select(F.col("label").alias("id"), F.when(F.col("vec_id") % 7 != 0, "x").otherwise(" ").alias("transcript"), signal.stats(F.col("embedding"), F.col("rate")).alias("stats"))
    return catalog.audit_summary(catalog.audit(rows, RATE, 5.0, 0.4))


@query("SELECT c_mktsegment, count(*) FILTER (c_acctbal < 5) AS short FROM customer GROUP BY c_mktsegment")
def short_references(spark, d):
    return _t(spark, d, "customer").groupBy("c_mktsegment").agg(report.short_references(F.col("c_acctbal")).alias("short"))


@query(f"""SELECT c_custkey, n_name AS voice_name, CASE WHEN NOT coalesce(x <> '' AND x <> '.' AND x <> '..' AND NOT contains(x, '/') AND NOT contains(x, '\\'), false) THEN 'invalid_character' WHEN n_name IS NULL THEN 'voice_not_found' END AS error_code
    FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_nationkey + 3 AS VARCHAR) ELSE {_PART_OF} END AS x FROM customer) LEFT JOIN nation ON x = CAST(n_nationkey AS VARCHAR)""")
def voice_lookup(spark, d):
    asked = F.when(F.col("c_custkey") % 2 == 0, (F.col("c_nationkey") + 3).cast("string")).otherwise(_component())
    voices = _t(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"))
    return catalog.lookup(_t(spark, d, "customer").select("c_custkey", asked.alias("character_id")), voices).select("c_custkey", "voice_name", "error_code")


@query("""SELECT p_partkey, CASE WHEN p_size > 25 THEN 'refused' ELSE 'accepted' END AS outcome FROM part""")
def style_upsert(spark, d):
    p = _t(spark, d, "part")
    accepted, refused = catalog.upsert_styles(p.where("p_size > 25"), p, ["p_partkey"])
    return accepted.select("p_partkey", F.lit("accepted").alias("outcome")).unionByName(refused.select("p_partkey", F.lit("refused").alias("outcome")))


_RANKED = """SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, l_tax, l_suppkey, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'R' THEN 1 ELSE 0 END,
                CASE l_returnflag WHEN 'N' THEN 0 ELSE 1 END, l_tax, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem"""


@query(f"""SELECT l_orderkey, max(CASE WHEN n = 1 AND l_returnflag <> 'R' THEN l_linenumber END) AS recommended_candidate, CAST(count(*) AS INTEGER) AS ranked FROM ({_RANKED}) GROUP BY l_orderkey""")
def selection_rows(spark, d):
    """The selection index of each order's attempts."""
    qc = F.when(F.col("l_returnflag") == "R", "FAIL").when(F.col("l_returnflag") == "A", "WARN").otherwise("PASS")
    rows = _t(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("candidate"), F.col("l_partkey").alias("output"), "l_suppkey", "l_extendedprice", qc.alias("qc"), F.lit("PASS").alias("transcript"), F.col("l_tax").alias("cer"))
    ranked = policy.rank_candidates(rows, ["l_orderkey"], ["candidate", "output", "l_suppkey", "l_extendedprice"])
    return sinks.selection_index(ranked, ["l_orderkey"]).select("l_orderkey", "recommended_candidate", F.size("candidates").alias("ranked"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag = 'N' AS qc_pass, true AS unrated FROM lineitem""")
def benchmark_takes(spark, d):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = report.benchmark_rows(_t(spark, d, "lineitem").withColumn("qc", F.when(F.col("l_returnflag") == "N", "PASS").otherwise("WARN")))
    return rows.select(*keys, "qc_pass", F.coalesce(*(F.col(c) for c in rows.columns if c.startswith("human_"))).isNull().alias("unrated"))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'candidate_changed' WHEN doc_id % 7 = 2 THEN 'reviewer_required' WHEN quality = 1 AND toxic = 1 THEN 'failed_audio' END AS error_code FROM documents JOIN labels USING (doc_id)""")
def review_ledger(spark, d):
    i = F.col("doc_id")
    rows = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id")
    reviews = rows.select(
        "doc_id", F.when(i % 4 == 1, F.lit("gone")).otherwise(i.cast("string")).alias("audio_sha256"), F.when(F.col("quality") == 1, "approve").otherwise("reject").alias("decision"),
        F.when(i % 7 != 2, "ann").alias("reviewer"), F.lit(True).alias("listened"), F.create_map(F.lit("prosody"), F.lit(3.0)).alias("ratings"), F.lit("").alias("notes"))
    candidates = rows.select(i.cast("string").alias("audio_sha256"), F.when(F.col("toxic") == 1, "FAIL").otherwise("PASS").alias("qc"), F.lit("PASS").alias("transcript"))
    return lifecycle.record_reviews(candidates, reviews).select("doc_id", "error_code")


_SAD = emotion.INSTRUCTIONS["sad"]


@query(f"SELECT doc_id, CAST(steps AS INTEGER) AS steps, CASE WHEN doc_id % 2 = 0 THEN '{_SAD}' ELSE '{emotion.INSTRUCTIONS['neutral']}' END AS instruct FROM documents, (SELECT unnest([10, 20, 30]) AS steps)")
def benchmark_schedule(spark, d):
    cases = _t(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "失落").otherwise("?").alias("emotion"))
    return workflows.benchmark_plan(cases, [10, 20, 30]).select("doc_id", "steps", "instruct")


@query("SELECT conv_id, turn, CASE WHEN turn % 3 <> 0 THEN turn / 10.0 <= 0.5 END AS pass FROM conversations")
def pass_flag(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", align.passed(F.col("turn") / 10.0, F.when(F.col("turn") % 3 != 0, F.lit(0.5))).alias("pass"))


_STEPS = {"fast": 1, "balanced": 2, "production": 3, "quality": 3, "ultimate": 3}


@query(f"""SELECT profile, count(*) AS lines, CAST(sum(n) AS BIGINT) AS attempts FROM (
        SELECT o_orderkey, CASE o_orderpriority {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _PRIORITY.items())} END AS profile, CASE o_orderpriority {" ".join(f"WHEN '{k}' THEN {_STEPS[v]}" for k, v in _PRIORITY.items())} END AS n
        FROM orders WHERE o_orderstatus <> 'F') GROUP BY profile""")
def batch_schedule(spark, d):
    """Attempts of the lines that a batch hasn't finished."""
    names = F.create_map(*(F.lit(x) for p in _PRIORITY.items() for x in p))
    o = _t(spark, d, "orders")
    lines = o.select(F.col("o_orderkey").alias("id"), F.lit("text").alias("text"), F.col("o_orderkey").alias("seed"), names[F.col("o_orderpriority")].alias("profile"))
    plan = workflows.plan_batch(lines, o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id")), policy.profiles(spark), ["id"])
    return plan.groupBy("profile").agg(F.countDistinct("id").alias("lines"), F.count("attempt_hash").alias("attempts"))


@query("""WITH o AS (SELECT o_custkey AS project, o_orderdate AS made, o_orderkey FROM orders), n AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY made DESC, o_orderkey DESC) AS k FROM o)
    SELECT project, o_orderkey FROM n WHERE k = 1""")
def latest_records(spark, d):
    rows = _t(spark, d, "orders").select(F.col("o_custkey").alias("project"), "o_orderkey", F.struct("o_orderdate", "o_orderkey").alias("made"))
    return catalog.latest(rows, ["project"], "made").select("project", "o_orderkey")


@query("SELECT r.n_nationkey AS id, r.takes, r.first FROM (SELECT c_nationkey AS n_nationkey, count(*) AS takes, min(c_custkey) AS first FROM customer GROUP BY c_nationkey) r")
def first_takes(spark, d):
    rows = _t(spark, d, "customer").withColumn("takes", F.count("*").over(Window.partitionBy("c_nationkey")))
    return policy.first_occurrence(rows, ["c_nationkey"], ["c_custkey"]).select(F.col("c_nationkey").alias("id"), "takes", F.col("c_custkey").alias("first"))


_CLIP = "SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 'FAIL' ELSE 'PASS' END AS qc, list_max(list_transform(" + _A + ", lambda x: abs(x))) AS peak FROM embeddings"


def _library(spark, d):
    qc = F.struct(F.when(F.col("vec_id") % 5 == 0, "FAIL").otherwise("PASS").alias("status"))
    name = F.col("vec_id").cast("string")
    return _clips(spark, d).select("vec_id", F.concat(name, F.lit(".wav")).alias("path"), name.alias("stem"), F.sha2(name, 256).alias("sha256"), signal.stats(F.col("embedding"), F.col("rate")).alias("stats"), qc.alias("qc"))


@query(f"""WITH c AS ({_CLIP}) SELECT vec_id, array_to_string(list_filter([CASE WHEN qc = 'FAIL' OR peak >= 0.999 THEN 'invalid_audio' END, CASE WHEN vec_id % 4 = 1 THEN 'metadata_missing' END, CASE WHEN vec_id % 4 = 2 THEN 'output_differs' END,
        CASE WHEN vec_id % 4 <> 1 AND vec_id % 3 = 0 THEN 'checksum_mismatch' END], lambda x: x IS NOT NULL), ',') AS errors,
        array_to_string(list_filter([CASE WHEN peak > 0.98 THEN 'near_full_scale' END, CASE WHEN vec_id % 4 = 3 THEN 'model_revision_missing' END], lambda x: x IS NOT NULL), ',') AS warnings FROM c""")
def delivery_entries(spark, d):
    audio, k = _library(spark, d), F.col("vec_id")
    meta = audio.where("vec_id % 4 <> 1").select(
        "stem", F.when(k % 4 == 2, "elsewhere").otherwise(F.col("path")).alias("output"), F.when(k % 3 == 0, "other").otherwise(F.col("sha256")).alias("audio_sha256"),
        F.when(k % 4 != 3, "r1").alias("model_revision"), F.lit("ultimate").alias("mode"), F.lit("t").alias("text"), F.lit(None).cast("string").alias("transcript_status"))
    entries = report.delivery_audit(audio, meta, RATE)
    return entries.select(F.regexp_extract("path", r"^\d+", 0).cast("long").alias("vec_id"), F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"))


@query(f"""WITH c AS ({_CLIP}) SELECT vec_id, CASE WHEN vec_id % 7 = 6 THEN 'style_not_found' WHEN vec_id % 7 = 5 THEN 'reference_missing' WHEN vec_id % 7 = 4 THEN 'transcript_empty' WHEN vec_id % 7 = 3 THEN 'reference_changed' WHEN qc = 'FAIL' THEN 'reference_invalid' END AS error_code,
        CASE WHEN vec_id % 7 < 3 AND qc <> 'FAIL' THEN sha256('words ' || vec_id) END AS reference_transcript_sha256 FROM c""")
def reference_rows(spark, d):
    clips, k = _library(spark, d), F.col("vec_id")
    entry = F.struct(
        F.when(k % 7 == 5, "nowhere").otherwise(F.col("path")).alias("reference"), F.when(k % 7 == 4, " ").otherwise(F.concat(F.lit(" words "), F.col("stem"))).alias("transcript_text"),
        F.when(k % 7 == 3, "other").when(k % 2 == 0, F.col("sha256")).alias("reference_sha256"))
    voices = clips.select(F.col("stem").alias("id"), F.lit("n").alias("name"), F.lit("neutral").alias("default_style"), F.create_map(F.lit("neutral"), entry).alias("styles"))
    asked = clips.select("vec_id", F.col("stem").alias("character_id"), F.when(k % 7 == 6, "sad").alias("style"))
    return catalog.reference_identity(asked, catalog.styles(voices), clips.drop("vec_id")).select("vec_id", "error_code", "reference_transcript_sha256")


@query("""WITH p AS (SELECT o_custkey AS project, count(*) AS lines, max(CASE WHEN o_orderkey % 97 = 0 THEN 'reference_missing' END) AS error_code FROM orders GROUP BY o_custkey)
    SELECT project, lines, error_code, CASE WHEN error_code IS NULL THEN project % 3 = 0 END AS resumed, CASE WHEN error_code IS NULL THEN CASE project % 3 WHEN 0 THEN 4 WHEN 1 THEN 5 ELSE 1 END END AS revision FROM p""")
def batch_preflight(spark, d):
    """Customers as projects: of every third the recorded revision 4 has the fingerprint, of the next it is damaged, the others have none."""
    o = _t(spark, d, "orders")
    lines = o.select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("text"))
    known = lines.select("project", "id", F.when(F.col("id") % 97 == 0, "reference_missing").alias("error_code"), *(F.lit("h").alias(c) for c in ("reference_sha256", "reference_transcript_sha256", "voice_sha256")))
    checked = workflows.preflight(lines, known, {"model": "m", "runtime": "r"})
    files = checked.where("project % 3 < 2").select("project", F.lit(4).alias("revision"), "fingerprint", (F.col("project") % 3 == 0).alias("intact"))
    chosen = workflows.choose_revision(checked.where("error_code IS NULL"), files).select("project", "resumed", "revision")
    return checked.select("project", "lines", "error_code").join(chosen, "project", "left")


# ---- alignment and lexicons --------------------------------------------------------------------------


@query(f"""WITH p AS ({_PAIRS}) SELECT conv_id, turn, sha256(y) AS rebuilt, CAST(levenshtein(x, y) AS INTEGER) AS steps, CAST(length(x) - length(y) AS INTEGER) AS shorter FROM p
    WHERE greatest(length(x), length(y)) <= 5000""")
def edit_scripts_applied(spark, d):
    """A script makes one text into the other, in as many steps as they are apart."""
    small_batches(spark)
    # A pair takes milliseconds, so tasks are made by pairs instead of by bytes.
    tasks = max(spark.sparkContext.defaultParallelism, -(-_t(spark, d, "conversations").count() // 2048))
    pairs = _pairs(spark, d).where(F.greatest(F.length("x"), F.length("y")) <= align.LIMIT).repartition(tasks, "conv_id", "turn")
    s = pairs.select("conv_id", "turn", "x", align.edit_script(F.col("x"), F.col("y")).alias("s"))
    dels, ins = F.size("s.deletions"), F.size("s.insertions")
    return s.select("conv_id", "turn", F.sha2(align.apply_script(F.col("x"), F.col("s")), 256).alias("rebuilt"), (F.size("s.substitutions") + dels + ins).alias("steps"), (dels - ins).alias("shorter"))


@query("""
    WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS term FROM benchmark),
    l AS (SELECT conv_id, turn, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]+') AS l FROM conversations),
    w AS (SELECT conv_id, turn, unnest(l) AS w, unnest(range(1, len(l) + 1)) AS n FROM l)
    SELECT conv_id, turn, sha256(string_agg(CASE WHEN t.term IS NULL THEN w.w ELSE '<' || w.w || '>' END, '' ORDER BY w.n)) AS spoken, count(t.term) AS applied
    FROM w LEFT JOIN t ON w.w = t.term GROUP BY conv_id, turn""")
def lexicon_joined(spark, d):
    """A lexicon that meets the texts in a join, as if it were too large to ship: the benchmark's words, each a term."""
    terms = _t(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("term")).distinct()
    none = F.lit(None).cast("string")
    entries = terms.select("term", F.concat(F.lit("<"), "term", F.lit(">")).alias("spoken"), none.alias("expected"), none.alias("pinyin"))
    turns = _t(spark, d, "conversations").select("conv_id", "turn", F.struct("conv_id", "turn").alias("place"), "text")
    out = lexicon.resolve_rows(turns, entries, "place", limit=0)
    return out.select("conv_id", "turn", F.sha2("resolved.text", 256).alias("spoken"), F.size("resolved.applied").cast("long").alias("applied"))


# ---- rates of samples --------------------------------------------------------------------------------


def _half_band() -> str:
    """The sinc filters that double a rate, by phase, as SQL lists: from the formula, not from the filter bank."""
    half = np.arange(-20, 21)
    taps = np.sinc(half / 2) * np.kaiser(41, 5.0)
    taps *= 2 / taps.sum()
    tap = lambda i: float(taps[i]) if 0 <= i <= 40 else 0.0
    return "[" + ", ".join("[" + ", ".join(repr(tap(p - 2 * j + 20)) for j in range(-10, 11)) + "]" for p in (0, 1)) + "]"


@query(f"""
    WITH a AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a FROM embeddings),
    b AS (SELECT vec_id, list_transform(range(0, 2 * len(a)), lambda n: list_sum(list_transform(range(-10, 11), lambda j:
              CASE WHEN n // 2 + j BETWEEN 0 AND len(a) - 1 THEN a[n // 2 + j + 1] ELSE 0 END * ({_half_band()})[n % 2 + 1][j + 11]))) AS b FROM a)
    SELECT vec_id, CAST(len(b) AS INTEGER) AS samples, round(list_max(list_transform(b, lambda x: abs(x))), 6) AS peak, round(list_sum(list_transform(b, lambda x: x * x)), 6) AS energy FROM b""")
def wave_resampled(spark, d):
    b = signal.resample(F.col("embedding").cast("array<double>"), F.lit(24_000))
    rows = _t(spark, d, "embeddings").select("vec_id", b.alias("b"))
    energy = F.aggregate("b", F.lit(0.0), lambda s, x: s + x * x)
    return rows.select("vec_id", F.size("b").alias("samples"), r6(signal.peak(F.col("b"))).alias("peak"), r6(energy).alias("energy"))


# ---- episodes ----------------------------------------------------------------------------------------


@query(f"""
    WITH l AS (SELECT *, conv_id || '-' || turn AS id, conv_id % 27 AS voice, CASE turn % 3 WHEN 0 THEN '失落' WHEN 1 THEN '怪' END AS emotion FROM conversations),
    x AS (SELECT *, CASE WHEN turn % 3 = 0 THEN 'sad' ELSE 'neutral' END AS asked, voice < 25 AS there FROM l)
    SELECT id, CASE WHEN there THEN asked ELSE 'neutral' END AS style, CASE WHEN there THEN 'ultimate' ELSE 'controllable' END AS mode,
           CASE WHEN there THEN NULL WHEN turn % 4 = 0 THEN 'mine' WHEN turn % 3 = 0 THEN '{_SAD}' ELSE '{emotion.INSTRUCTIONS['neutral']}' END AS instruct,
           CASE WHEN turn % 3 = 1 THEN 'Unknown emotion 怪; neutral fallback' END AS emotion_warning,
           array_to_string(list_transform(regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]+'), lambda w: CASE w WHEN 'the' THEN 'ze' WHEN 'la' THEN 'lah' ELSE w END), '') AS text,
           CASE WHEN NOT there THEN 'voice_not_found' END AS error_code FROM x""")
def episode_lines(spark, d):
    """Lines routed to styles of the catalogue and rewritten by a project's lexicon."""
    t = F.col("turn")
    lines = _t(spark, d, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), (F.col("conv_id") % 27).cast("string").alias("character_id"), F.lit(None).cast("string").alias("style"),
        F.when(t % 3 == 0, "失落").when(t % 3 == 1, "怪").alias("emotion"), "text", F.when((t % 4 == 0) & (F.col("conv_id") % 27 >= 25), "mine").alias("instruct"))
    voices = _voices(spark, d).withColumn("id", F.col("id").cast("string"))
    entries = {"the": ("ze", None, None), "la": ("lah", None, None)}
    return workflows.prepare_episode(lines, voices, entries, profile="none", exact=True).select("id", "style", "mode", "instruct", "emotion_warning", "text", "error_code")


@query("""SELECT event_type, coalesce(CASE WHEN event_type <> 'view' THEN event_type END, 'unconfigured') AS backend_id, sha256('{"k": ' || json_extract_string(props, '$.k') || '}') AS config_sha256, count(*) AS events FROM events GROUP BY ALL""")
def verifier_rows(spark, d):
    config = F.concat(F.lit('{"k": '), F.get_json_object("props", "$.k"), F.lit("}"))
    who = align.verifier_identity(F.when(F.col("event_type") != "view", F.col("event_type")), config)
    return _t(spark, d, "events").select("event_type", who.alias("w")).select("event_type", "w.*").groupBy("event_type", "backend_id", "config_sha256").agg(F.count("*").alias("events"))
