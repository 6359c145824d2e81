"""Registered queries over the driver's tables, each with the SQL that gives the same rows.

The tables hold no audio, so vectors stand for clips, order lines for attempts, and so on; the operator
applied is the one that its docstring names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonarlake.functions import align, emotion, identity, lexicon, normalize, reading, segment, signal
from sonarlake.operators import catalog, lifecycle, nearest, policy, report, validate
from sonarlake.streaming import events as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# Vectors as clips: nominal rate, and levels that suit their values.
RATE, SILENT, ACTIVE = 16, 0.05, 0.02


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _clips(spark, d):
    return _t(spark, d, "embeddings").withColumn("rate", F.lit(RATE))


def r6(c):
    return F.round(c, 6)


# ---- signal ----------------------------------------------------------------------------------------

_A = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"


@query(f"""
    WITH a AS (SELECT vec_id, {_A} AS a FROM embeddings)
    SELECT vec_id, round(list_max(list_transform(a, lambda x: abs(x))), 6) AS peak, round(sqrt(list_sum(list_transform(a, lambda x: x * x)) / len(a)), 6) AS rms,
           round(list_sum(a) / len(a), 6) AS dc, CAST(len(a) AS DOUBLE) / {RATE} AS duration,
           len(list_filter(a, lambda x: abs(x) < {SILENT})) / CAST(len(a) AS DOUBLE) AS silence,
           round(list_max(list_transform(range(1, len(a)), lambda i: abs(a[i + 1] - a[i]))), 6) AS jump FROM a""")
def wave_stats(spark, d):
    a = F.col("embedding")
    return _clips(spark, d).select(
        "vec_id", r6(signal.peak(a)).alias("peak"), r6(signal.rms(a)).alias("rms"), r6(signal.dc_offset(a)).alias("dc"), signal.duration(a, F.col("rate")).alias("duration"),
        signal.silence_ratio(a, SILENT).alias("silence"), r6(signal.max_jump(a)).alias("jump"),
    )


@query(f"""
    WITH x AS (SELECT vec_id, i, abs(embedding[i]) < CAST({SILENT} AS FLOAT) AS quiet FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)),
    g AS (SELECT vec_id, i - row_number() OVER (PARTITION BY vec_id ORDER BY i) AS island FROM x WHERE quiet),
    r AS (SELECT vec_id, island, count(*) AS n FROM g GROUP BY vec_id, island)
    SELECT e.vec_id, coalesce(max(r.n), 0) / CAST({RATE} AS DOUBLE) AS seconds FROM embeddings e LEFT JOIN r ON e.vec_id = r.vec_id GROUP BY e.vec_id""")
def wave_longest_silence(spark, d):
    return _clips(spark, d).select("vec_id", signal.longest_silence(F.col("embedding"), F.col("rate"), SILENT).alias("seconds"))


@query(f"""
    WITH x AS (SELECT vec_id, embedding, list_filter(range(1, len(embedding) + 1), lambda i: abs(embedding[i]) > {ACTIVE}) AS act FROM embeddings)
    SELECT vec_id, CASE WHEN len(act) > 0 THEN (list_min(act) - 1) / CAST({RATE} AS DOUBLE) ELSE len(embedding) / CAST({RATE} AS DOUBLE) END AS start_seconds,
           CASE WHEN len(act) > 0 THEN (len(embedding) - list_max(act)) / CAST({RATE} AS DOUBLE) ELSE len(embedding) / CAST({RATE} AS DOUBLE) END AS end_seconds FROM x""")
def wave_edge_silence(spark, d):
    edges = signal.edge_silence(F.col("embedding"), F.col("rate"), ACTIVE)
    return _clips(spark, d).select("vec_id", edges["start"].alias("start_seconds"), edges["end"].alias("end_seconds"))


@query("""
    WITH x AS (SELECT vec_id, i, CAST(embedding[i] AS DOUBLE) AS s FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)),
    j AS (SELECT vec_id, abs(s - lag(s) OVER (PARTITION BY vec_id ORDER BY i)) AS jump FROM x)
    SELECT vec_id, round(max(jump), 6) AS jump FROM j GROUP BY vec_id""")
def wave_jump_lag(spark, d):
    """The lag within an array needs no shuffle."""
    return _clips(spark, d).select("vec_id", r6(signal.max_jump(F.col("embedding"))).alias("jump"))


@query(f"""
    WITH a AS (SELECT vec_id, label, {_A} AS a FROM embeddings),
    s AS (SELECT *, list_max(list_transform(a, lambda x: abs(x))) AS peak, sqrt(list_sum(list_transform(a, lambda x: x * x)) / len(a)) AS rms, list_sum(a) / len(a) AS dc,
                 len(list_filter(a, lambda x: abs(x) < {SILENT})) / CAST(len(a) AS DOUBLE) AS quiet,
                 list_max(list_transform(range(1, len(a)), lambda i: abs(a[i + 1] - a[i]))) AS jump,
                 (list_min(list_filter(range(1, len(a) + 1), lambda i: abs(a[i]) > {ACTIVE})) - 1) / {RATE}.0 AS s1,
                 (len(a) - list_max(list_filter(range(1, len(a) + 1), lambda i: abs(a[i]) > {ACTIVE}))) / {RATE}.0 AS s2 FROM a),
    i AS (SELECT vec_id, p, p - row_number() OVER (PARTITION BY vec_id ORDER BY p) AS island
          FROM (SELECT vec_id, a, unnest(range(1, len(a) + 1)) AS p FROM a) WHERE abs(a[p]) < {SILENT}),
    runs AS (SELECT vec_id, max(n) / {RATE}.0 AS longest FROM (SELECT vec_id, island, count(*) AS n FROM i GROUP BY vec_id, island) GROUP BY vec_id),
    q AS (SELECT label, CASE WHEN peak >= 0.999 OR peak <= 1e-5 THEN 'FAIL'
                 WHEN rms < 0.003 OR peak > 0.98 OR abs(dc) > 0.02 OR quiet > 0.65 OR coalesce(longest, 0) > 2 OR s1 > 1 OR s2 > 1 OR jump > 0.5 THEN 'WARN' ELSE 'PASS' END AS status
          FROM s LEFT JOIN runs USING (vec_id))
    SELECT label, status, count(*) AS clips FROM q GROUP BY label, status""")
def wave_qc_status(spark, d):
    s = signal.stats(F.col("embedding"), F.col("rate"), subtype=F.lit("PCM_24"), silence=SILENT, edge=ACTIVE)
    judged = _clips(spark, d).withColumn("s", s).select("label", signal.audio_qc(F.col("s"), rate=RATE)["status"].alias("status"))
    return judged.groupBy("label", "status").agg(F.count("*").alias("clips"))


@query(f"""
    WITH x AS (SELECT vec_id, embedding, list_filter(range(1, len(embedding) + 1), lambda i: abs(embedding[i]) > {ACTIVE}) AS act FROM embeddings),
    c AS (SELECT vec_id, embedding, greatest(1, list_min(act) - 1) AS first, least(len(embedding), list_max(act) + 1) AS last FROM x WHERE len(act) > 0)
    SELECT vec_id, CAST(last - first + 1 AS INTEGER) AS frames, round(CAST(embedding[first] AS DOUBLE), 6) AS first_sample, round(CAST(embedding[last] AS DOUBLE), 6) AS last_sample FROM c""")
def wave_trim(spark, d):
    cut = signal.trim(F.col("embedding"), F.col("rate"), ACTIVE)
    rows = _clips(spark, d).withColumn("cut", cut).where("cut IS NOT NULL")
    return rows.select("vec_id", F.size("cut").alias("frames"), r6(F.element_at("cut", 1).cast("double")).alias("first_sample"), r6(F.element_at("cut", -1).cast("double")).alias("last_sample"))


@query(f"""
    WITH a AS (SELECT vec_id, list_max(list_transform({_A}, lambda x: abs(x))) AS peak FROM embeddings),
    g AS (SELECT vec_id, peak, -3 - 20 * log10(peak) AS gain FROM a)
    SELECT vec_id, round(gain, 6) AS gain_db, CASE WHEN gain > 12 THEN 'boost_too_large' END AS error_code, CASE WHEN gain <= 12 THEN round(peak * pow(10, gain / 20), 6) END AS new_peak FROM g""")
def wave_gain_peak(spark, d):
    out = lifecycle.deliver(_clips(spark, d), "embedding", "rate", peak_dbfs=-3.0, cut=False)
    return out.select("vec_id", r6("gain_db").alias("gain_db"), "error_code", F.when(F.col("delivered").isNotNull(), r6(signal.peak(F.col("delivered")))).alias("new_peak"))


@query(f"""
    WITH j AS (SELECT label, flatten(list({_A} ORDER BY vec_id)) AS a, count(*) AS n FROM embeddings GROUP BY label)
    SELECT label, CAST(len(a) + (n - 1) * {RATE // 2} AS INTEGER) AS frames, n AS segments, round(list_max(list_transform(a, lambda x: abs(x))), 6) AS peak, round(a[1], 6) AS head, round(a[len(a)], 6) AS tail FROM j""")
def wave_join_segments(spark, d):
    joined = lifecycle.join_segments(_t(spark, d, "embeddings"), ["label"], "vec_id", "embedding", RATE, pause=0.5)
    return joined.select("label", F.size("samples").alias("frames"), "segments", r6(signal.peak(F.col("samples"))).alias("peak"), r6(F.element_at("samples", 1)).alias("head"), r6(F.element_at("samples", -1)).alias("tail"))


@query(f"""
    WITH a AS (SELECT vec_id, label, {_A} AS a, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings),
    p AS (SELECT x.vec_id, x.a AS a, f.a AS b FROM a x JOIN a f ON x.label = f.label AND f.n = 1)
    SELECT vec_id, round(greatest(-1, least(1, list_sum(list_transform(range(1, len(a) + 1), lambda i: a[i] * b[i]))
           / (sqrt(list_sum(list_transform(a, lambda x: x * x))) * sqrt(list_sum(list_transform(b, lambda x: x * x)))))), 6) AS similarity FROM p""")
def speaker_cosine(spark, d):
    v = _t(spark, d, "embeddings")
    first = v.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("reference"))
    return v.join(first, "label").select("vec_id", r6(signal.cosine(F.col("embedding"), F.col("reference"))).alias("similarity"))


@query(f"""
    WITH a AS (SELECT vec_id, label, {_A} AS a FROM embeddings),
    r AS (SELECT * FROM a WHERE vec_id % 50 = 0),
    p AS (SELECT r.vec_id AS query_id, a.vec_id, round(list_sum(list_transform(range(1, len(r.a) + 1), lambda i: r.a[i] * a.a[i]))
             / (sqrt(list_sum(list_transform(r.a, lambda x: x * x))) * sqrt(list_sum(list_transform(a.a, lambda x: x * x)))), 6) AS similarity FROM r JOIN a ON r.label <> a.label)
    SELECT * FROM (SELECT query_id, vec_id, similarity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS INTEGER) AS rank FROM p) WHERE rank <= 3""")
def speaker_topk(spark, d):
    """Extension: the three nearest vectors of other labels, for the stated queries."""
    v = _t(spark, d, "embeddings")
    queries = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"), F.col("embedding").alias("q"))
    return nearest.nearest(v, queries, 3)


# ---- attempts --------------------------------------------------------------------------------------

_PROFILES = "(VALUES ('production', [10, 20, 30]), ('fast', [10]), ('balanced', [10, 20]), ('quality', [10, 20, 30]), ('ultimate', [30, 30, 30])) p(name, steps)"
_PRIORITY = {"1-URGENT": "fast", "2-HIGH": "balanced", "3-MEDIUM": "production", "4-NOT SPECIFIED": "quality", "5-LOW": "ultimate"}


@query(f"""
    WITH o AS (SELECT o_orderkey, CASE o_orderpriority {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _PRIORITY.items())} END AS profile FROM orders),
    x AS (SELECT o_orderkey, profile, steps, unnest(range(1, len(steps) + 1)) AS c FROM o JOIN {_PROFILES} ON profile = name)
    SELECT o_orderkey, profile, CAST(c AS INTEGER) AS candidate, CAST((4294967290 + o_orderkey + (c - 1) * 3365) % 4294967296 AS BIGINT) AS attempt_seed, CAST(steps[c] AS INTEGER) AS inference_timesteps FROM x""")
def attempt_plan(spark, d):
    names = F.create_map(*(F.lit(x) for p in _PRIORITY.items() for x in p))
    lines = _t(spark, d, "orders").select("o_orderkey", names[F.col("o_orderpriority")].alias("profile"), (F.lit(4294967290) + F.col("o_orderkey")).alias("seed"))
    steps = policy.profiles(spark).select(F.col("name").alias("profile"), "steps")
    return policy.plan_attempts(lines.join(F.broadcast(steps), "profile")).select("o_orderkey", "profile", "candidate", "attempt_seed", "inference_timesteps")


def _attempts(spark, d):
    qc = F.when(F.col("l_returnflag") == "R", "FAIL").when(F.col("l_returnflag") == "A", "WARN").otherwise("PASS")
    heard = F.when(F.col("l_linestatus") == "F", "FAIL").otherwise("PASS")
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", qc.alias("qc"), heard.alias("transcript"), F.col("l_tax").alias("cer"))


_ATT = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, CASE l_returnflag WHEN 'R' THEN 'FAIL' WHEN 'A' THEN 'WARN' ELSE 'PASS' END AS qc,
          CASE l_linestatus WHEN 'F' THEN 'FAIL' ELSE 'PASS' END AS transcript, l_tax AS cer FROM lineitem"""
_POS = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


@query(f"""
    WITH a AS ({_ATT}), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN qc IN ('PASS', 'WARN') THEN 0 ELSE 1 END, CASE WHEN qc = 'FAIL' THEN 1 ELSE 0 END,
        CASE WHEN transcript = 'FAIL' THEN 1 ELSE 0 END, CASE WHEN qc = 'PASS' THEN 0 ELSE 1 END, coalesce(cer, 1), {", ".join(_POS)}) AS n FROM a)
    SELECT l_orderkey, l_linenumber, l_partkey, qc, transcript, cer FROM r WHERE n = 1 AND qc IN ('PASS', 'WARN')""")
def candidate_rank(spark, d):
    return policy.select_best(_attempts(spark, d), ["l_orderkey"], _POS).select("l_orderkey", "l_linenumber", "l_partkey", "qc", "transcript", "cer")


@query(f"""
    WITH a AS ({_ATT}), e AS (SELECT a.*, o_orderpriority <> '5-LOW' AND o_orderkey IS NOT NULL AS stops, max(CASE WHEN qc = 'PASS' AND transcript = 'PASS' THEN 1 ELSE 0 END) OVER
        (PARTITION BY l_orderkey ORDER BY {", ".join(_POS)} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS done FROM a LEFT JOIN orders ON l_orderkey = o_orderkey)
    SELECT l_orderkey, l_linenumber, l_partkey, qc, transcript FROM e WHERE coalesce(done, 0) = 0 OR NOT stops""")
def candidate_early_stop(spark, d):
    """Each order's priority names its profile; the one for low priority doesn't stop early."""
    names = F.create_map(*(F.lit(x) for p in _PRIORITY.items() for x in p))
    flags = policy.profiles(spark).select(F.col("name").alias("profile"), "early_stop")
    lines = _t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), names[F.col("o_orderpriority")].alias("profile")).join(F.broadcast(flags), "profile")
    attempts = _attempts(spark, d).join(lines, "l_orderkey", "left")
    return policy.early_stop(attempts, ["l_orderkey"], _POS, enabled=F.col("early_stop")).select("l_orderkey", "l_linenumber", "l_partkey", "qc", "transcript")


@query(f"""
    WITH a AS ({_ATT}) SELECT CASE WHEN transcript = 'FAIL' THEN 'transcript_mismatch' WHEN qc = 'FAIL' THEN 'audio_failure' ELSE 'review_required' END AS code,
        CASE WHEN transcript = 'FAIL' THEN 'review_normalization_or_lexicon' WHEN qc = 'FAIL' THEN 'next_seed_and_scheduled_steps' ELSE 'retain_candidates_for_listening' END AS action,
        count(*) AS attempts FROM a GROUP BY ALL""")
def retry_reasons(spark, d):
    return _attempts(spark, d).select(align.retry_reason(F.col("qc"), F.col("transcript")).alias("r")).select("r.*").groupBy("code", "action").agg(F.count("*").alias("attempts"))


@query(f"""
    WITH a AS ({_ATT}) SELECT l_linenumber AS steps, round(avg(cer), 6) AS mean_cer, max(cer) AS max_cer, round(sum(l_quantity), 3) AS total_seconds, count(*) AS takes,
        count(*) FILTER (qc <> 'FAIL') AS qc_pass, count(*) FILTER (qc = 'FAIL') AS qc_fail FROM a GROUP BY l_linenumber""")
def benchmark_by_steps(spark, d):
    out = report.by_steps(_attempts(spark, d), "l_linenumber", "cer", "l_quantity")
    return out.withColumnRenamed("l_linenumber", "steps").withColumns({"mean_cer": r6("mean_cer"), "total_seconds": F.round("total_seconds", 3)})


@query(f"WITH a AS ({_ATT}) SELECT count(*) AS reviewed, count(DISTINCT transcript) AS backends, round(avg(CASE WHEN cer > 0.06 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM a")
def false_retry_rate(spark, d):
    return _attempts(spark, d).agg(F.count("*").alias("reviewed"), F.countDistinct("transcript").alias("backends"), r6(report.false_retry_rate(F.col("cer"), 0.06)).alias("rate"))


@query("""
    WITH s AS (SELECT d.doc_id, sha256(d.text) AS audio_sha256 FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1 AND trim(d.lang) <> '' AND trim(d.text) <> '')
    SELECT audio_sha256, min(doc_id) AS doc_id, count(*) AS copies FROM s GROUP BY audio_sha256""")
def calibration_samples(spark, d):
    s = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id")
    usable = validate.calibration_sample(F.col("quality") == 1, F.col("lang"), F.col("text"), F.col("quality") == 1, F.col("text"))
    rows = s.where(usable).select("doc_id", F.sha2("text", 256).alias("audio_sha256"))
    return rows.groupBy("audio_sha256").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query(f"""
    WITH a AS ({_ATT}), t AS (SELECT unnest([0.0, 0.02, 0.04, 0.06, 0.08]) AS threshold)
    SELECT CAST(threshold AS DOUBLE) AS threshold, count(*) FILTER (cer > threshold) AS retried, round(avg(CASE WHEN cer > threshold THEN 1.0 ELSE 0.0 END), 6) AS rate FROM a JOIN t ON true GROUP BY threshold""")
def calibration_threshold_sweep(spark, d):
    thresholds = F.array(*(F.lit(x) for x in (0.0, 0.02, 0.04, 0.06, 0.08)))
    rows = _attempts(spark, d).groupBy("cer").agg(F.count("*").alias("n")).withColumn("threshold", F.explode(thresholds))
    over = F.when(F.col("cer") > F.col("threshold"), F.col("n")).otherwise(0)
    return rows.groupBy("threshold").agg(F.sum(over).alias("retried"), r6(F.sum(over) / F.sum("n")).alias("rate"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity - 1 = 0 THEN NULL ELSE l_extendedprice / (l_quantity - 1) END AS rtf FROM lineitem")
def rtf_report(spark, d):
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", validate.rtf(F.col("l_extendedprice"), F.col("l_quantity") - 1).alias("rtf"))


# ---- readings --------------------------------------------------------------------------------------

_D = "零一二三四五六七八九"


def _sql_group(n: str) -> str:
    """A number of up to four digits by naming all places and closing up zeros."""
    places = " || ".join(f"substr('{_D}', CAST(({n}) // {10**k} % 10 + 1 AS BIGINT), 1) || '{u}'" for k, u in ((3, "千"), (2, "百"), (1, "十"), (0, "")))
    closed = f"regexp_replace(regexp_replace(regexp_replace({places}, '零[千百十]', '零', 'g'), '零+', '零', 'g'), '^零|零$', '', 'g')"
    return f"regexp_replace({closed}, '^一十', '十')"


def _sql_integer(n: str) -> str:
    """Below 100 million."""
    low = f"CASE WHEN ({n}) % 10000 = 0 THEN '' WHEN ({n}) % 10000 < 1000 THEN '零' || {_sql_group(f'({n}) % 10000')} ELSE {_sql_group(f'({n}) % 10000')} END"
    return f"CASE WHEN ({n}) = 0 THEN '零' WHEN ({n}) < 10000 THEN {_sql_group(n)} ELSE {_sql_group(f'({n}) // 10000')} || '万' || {low} END"


@query(f"SELECT o_orderkey, translate(CAST(o_orderkey AS VARCHAR), '0123456789', '{_D}') AS spoken FROM orders")
def digit_reading(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", reading.digit_reading(F.col("o_orderkey").cast("string")).alias("spoken"))


@query(f"SELECT o_orderkey, {_sql_integer('o_orderkey')} AS spoken FROM orders")
def integer_reading(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", reading.integer_reading(F.col("o_orderkey")).alias("spoken"))


_CENTS = "CAST(round(abs(v) * 100) AS BIGINT)"


@query(f"""
    WITH x AS (SELECT 'part' AS kind, p_partkey AS k, p_retailprice AS v FROM part UNION ALL SELECT 'customer', c_custkey, c_acctbal FROM customer)
    SELECT kind, k, CASE WHEN v < 0 THEN '负' ELSE '' END || {_sql_integer(f'{_CENTS} // 100')} || '点' || translate(lpad(CAST({_CENTS} % 100 AS VARCHAR), 2, '0'), '0123456789', '{_D}') AS spoken FROM x""")
def number_reading_price(spark, d):
    rows = _t(spark, d, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("v"))
    rows = rows.unionByName(_t(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v")))
    # Whole cents first, as the SQL has them: a format would round other values' decimals, and give a zero its sign.
    rows = rows.withColumn("cents", F.round(F.abs("v") * 100).cast("long"))
    price = F.concat(F.when(F.col("v") < 0, "-").otherwise(""), F.expr("cents div 100").cast("string"), F.lit("."), F.lpad((F.col("cents") % 100).cast("string"), 2, "0"))
    return rows.select("kind", "k", reading.number_reading(price).alias("spoken"))


@query(f"""
    SELECT o_orderkey, translate(CAST(year(o_orderdate) AS VARCHAR), '0123456789', '{_D}') || '年' || {_sql_integer('month(o_orderdate)')} || '月' || {_sql_integer('day(o_orderdate)')} || '日' AS spoken FROM orders""")
def date_reading(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", reading.checked_date_reading(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("spoken"))


@query(f"""
    WITH t AS (SELECT event_id, CAST(hour(ts) AS BIGINT) AS h, CAST(minute(ts) AS BIGINT) AS m, CAST(second(ts) AS BIGINT) AS s FROM events)
    SELECT event_id, {_sql_integer('h')} || '点' || CASE WHEN m = 0 THEN '整' ELSE CASE WHEN m < 10 THEN '零' ELSE '' END || {_sql_integer('m')} || '分' END || {_sql_integer('s')} || '秒' AS spoken FROM t""")
def time_reading(spark, d):
    t = F.col("ts")
    return _t(spark, d, "events").select("event_id", reading.time_reading(F.hour(t), F.minute(t), F.second(t)).alias("spoken"))


# ---- text ------------------------------------------------------------------------------------------


@query()
def normalize_documents(spark, d):
    out = _t(spark, d, "documents").select("doc_id", normalize.normalize_text(F.col("text"), "dialogue").alias("n"))
    return out.select("doc_id", F.length("n.normalized").alias("chars"), F.size("n.warnings").alias("warnings"), "n.changed", "n.error_code")


_WORD = r"[\pL\pM\p{Nd}\p{Pc}]"


@query(rf"""WITH x AS (SELECT doc_id, regexp_extract_all(text, 'https?://[^\s\pZ\x0B\x85\x1c-\x1f，。！？；]+|(?:{_WORD}|[.+-])+@(?:{_WORD}|[.-])+\.[A-Za-z]{{2,}}|[A-Za-z][A-Za-z0-9_.-]*') AS t FROM documents)
    SELECT doc_id, CAST(len(t) AS INTEGER) AS identifiers, sha256(array_to_string(t, ' ')) AS sha256 FROM x""")
def protected_tokens(spark, d):
    tokens = normalize.protected_tokens(F.col("text"))
    return _t(spark, d, "documents").withColumn("t", tokens).select("doc_id", F.size("t").alias("identifiers"), F.sha2(F.array_join("t", " "), 256).alias("sha256"))


@query()
def normalize_digits_docs(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", normalize.normalize_text(F.col("text"), "narration").alias("n"))
    return rows.select("doc_id", F.sha2("n.normalized", 256).alias("sha256"), F.size("n.warnings").alias("warnings"))


_LAYERS = """SELECT n_name AS term, 'global ' || lower(n_name) AS spoken, 0 AS priority FROM nation
             UNION ALL SELECT n_name, 'project ' || lower(n_name), 1 FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_name, 'episode ' || lower(n_name), 2 FROM nation WHERE n_nationkey % 3 = 0"""


@query(f"SELECT term, spoken, CAST(priority AS INTEGER) AS priority FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY priority DESC) AS n FROM ({_LAYERS})) WHERE n = 1")
def lexicon_merge(spark, d):
    n, none = _t(spark, d, "nation"), F.lit(None).cast("string")
    layer = lambda rows, name, p: rows.select(F.col("n_name").alias("term"), F.concat(F.lit(f"{name} "), F.lower("n_name")).alias("spoken"), none.alias("expected"), none.alias("pinyin"), F.lit(p).alias("priority"))
    layers = layer(n, "global", 0).unionByName(layer(n.where("n_nationkey % 2 = 0"), "project", 1)).unionByName(layer(n.where("n_nationkey % 3 = 0"), "episode", 2))
    return lexicon.merge_lexicons(layers).select("term", "spoken", "priority")


_LEXICON = {"the": ("thee", "the", None), "and": ("an", None, None), "de": (None, None, "dé"), "que la": ("kela", None, None)}


_TOKEN = "CASE WHEN t[i] = 'que' AND t[i + 1] = ' ' AND t[i + 2] = 'la' THEN 1 WHEN i > 1 AND t[i] = ' ' AND t[i - 1] = 'que' AND t[i + 1] = 'la' THEN 2 WHEN i > 2 AND t[i] = 'la' AND t[i - 1] = ' ' AND t[i - 2] = 'que' THEN 2 ELSE 0 END"


@query(f"""WITH x AS (SELECT conv_id, turn, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z ]+| ') AS t FROM conversations),
    k AS (SELECT *, list_transform(range(1, len(t) + 1), lambda i: {_TOKEN}) AS k FROM x),
    r AS (SELECT conv_id, turn, t, k, list_transform(range(1, len(t) + 1), lambda i: CASE WHEN k[i] = 1 THEN 'kela' WHEN k[i] = 2 THEN '' WHEN t[i] = 'the' THEN 'thee' WHEN t[i] = 'and' THEN 'an' ELSE t[i] END) AS s,
          list_transform(range(1, len(t) + 1), lambda i: CASE WHEN k[i] = 1 THEN 'kela' WHEN k[i] = 2 THEN '' WHEN t[i] = 'and' THEN 'an' ELSE t[i] END) AS e FROM k)
    SELECT conv_id, turn, sha256(array_to_string(s, '')) AS spoken, sha256(array_to_string(e, '')) AS expected,
           CAST(len(list_filter(range(1, len(t) + 1), lambda i: k[i] = 1 OR t[i] IN ('the', 'and', 'de'))) AS INTEGER) AS applied, CAST(len(list_filter(t, lambda x: x = 'de')) AS INTEGER) AS warnings FROM r""")
def lexicon_apply(spark, d):
    out = _t(spark, d, "conversations").select("conv_id", "turn", lexicon.resolve_pronunciation(F.col("text"), _LEXICON).alias("r"))
    return out.select("conv_id", "turn", F.sha2("r.text", 256).alias("spoken"), F.sha2("r.expected", 256).alias("expected"), F.size("r.applied").alias("applied"), F.size("r.warnings").alias("warnings"))


@query(r"""SELECT conv_id, turn, CAST(len(regexp_extract_all(' ' || regexp_replace(text, '[^A-Za-z]+', '  ', 'g') || ' ', ' the ')) AS INTEGER) AS the FROM conversations""")
def lexicon_hits(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", lexicon.term_hits(F.col("text"), "the").alias("the"))


_EVENT_MOODS = {"click": "平静", "view": "温柔", "error": "惊恐", "purchase": "耳语", "login": "生气", "logout": "失落"}
_STYLES = {"平静": "neutral", "温柔": "gentle", "惊恐": "panic", "耳语": "whisper", "生气": "angry", "失落": "sad"}


@query(f"""
    WITH e AS (SELECT event_type, CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _EVENT_MOODS.items())} END AS emotion FROM events),
    s AS (SELECT event_type, coalesce(CASE emotion {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _STYLES.items())} END, 'neutral') AS style FROM e)
    SELECT event_type, style, CASE style {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in emotion.INSTRUCTIONS.items())} END AS instruct, count(*) AS events FROM s GROUP BY event_type, style""")
def emotion_route(spark, d):
    moods = F.create_map(*(F.lit(x) for p in _EVENT_MOODS.items() for x in p))
    rows = _t(spark, d, "events").withColumn("style", emotion.style_of(F.try_element_at(moods, F.col("event_type"))))
    return rows.groupBy("event_type", "style").agg(F.count("*").alias("events")).withColumn("instruct", emotion.instruction_of(F.col("style")))


_ASCII = "regexp_replace(lower({}), '[^a-z0-9]+', '', 'g')"


@query(f"SELECT doc_id, {_ASCII.format('text')} AS comparable FROM documents")
def comparison_text_ascii(spark, d):
    return _t(spark, d, "documents").select("doc_id", align.comparison_text_ascii(F.col("text")).alias("comparable"))


_PAIRS = f"""SELECT a.conv_id, a.turn, {_ASCII.format('a.text')} AS x, {_ASCII.format('b.text')} AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"""


def _pairs(spark, d):
    c = _t(spark, d, "conversations").select("conv_id", "turn", align.comparison_text_ascii(F.col("text")).alias("x"))
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("x").alias("y"))
    return c.join(after, ["conv_id", "turn"])


@query(f"""WITH p AS ({_PAIRS}) SELECT conv_id, turn, CASE WHEN greatest(length(x), length(y)) <= 5000 THEN CAST(levenshtein(x, y) AS INTEGER) END AS distance,
    CASE WHEN greatest(length(x), length(y)) <= 5000 THEN round(levenshtein(x, y) / CAST(nullif(length(x), 0) AS DOUBLE), 6) END AS cer FROM p""")
def cer_pairs(spark, d):
    x, y = F.col("x"), F.col("y")
    return _pairs(spark, d).select("conv_id", "turn", align.edit_distance(x, y).alias("distance"), r6(align.cer(x, y)).alias("cer"))


@query()
def cer_edit_ops(spark, d):
    s = _pairs(spark, d).select("conv_id", "turn", align.edit_script(F.col("x"), F.col("y")).alias("s"))
    return s.select("conv_id", "turn", *(F.size(f"s.{k}").alias(k) for k in ("substitutions", "deletions", "insertions")), "s.edit_distance")


@query(f"""
    WITH p AS ({_PAIRS}), r AS (SELECT conv_id, turn, CASE WHEN greatest(length(x), length(y)) <= 5000 THEN levenshtein(x, y) / CAST(nullif(length(x), 0) AS DOUBLE) END AS cer FROM p)
    SELECT CASE WHEN turn % 5 = 4 THEN 'UNAVAILABLE' WHEN cer IS NULL THEN 'ERROR' WHEN turn % 5 = 3 THEN 'WARN' WHEN cer <= 0.85 THEN 'PASS' ELSE 'FAIL' END AS status, count(*) AS turns FROM r GROUP BY ALL""")
def asr_status(spark, d):
    x, y, t = F.col("x"), F.col("y"), F.col("turn") % 5
    rows = _pairs(spark, d).select(align.verdict(t != 4, F.lit(None).cast("string"), align.cer(x, y), F.when(t != 3, F.lit(0.85))).alias("status"))
    return rows.groupBy("status").agg(F.count("*").alias("turns"))


_SENT = r"""[^。！？!?\n]+(?:[。！？!?\n]+[”’」』"'']*)?|[。！？!?\n]+[”’」』"'']*"""


@query(f"""WITH s AS (SELECT doc_id, regexp_extract_all(text, '{_SENT}') AS s FROM documents)
    SELECT doc_id, CAST(len(s) AS INTEGER) AS sentences, CAST(coalesce(list_max(list_transform(s, lambda x: length(x))), 0) AS INTEGER) AS longest FROM s""")
def segment_sentences(spark, d):
    s = segment.sentences(F.col("text"))
    return _t(spark, d, "documents").select("doc_id", F.size(s).alias("sentences"), F.coalesce(F.array_max(F.transform(s, F.length)), F.lit(0)).alias("longest"))


_CLAUSE = "[^，,；;：:]+[，,；;：:]*|[，,；;：:]+"


@query(f"""WITH s AS (SELECT doc_id, text, unnest(regexp_extract_all(text, '{_SENT}')) AS s, generate_subscripts(regexp_extract_all(text, '{_SENT}'), 1) AS n FROM documents),
    c AS (SELECT doc_id, n, s, regexp_extract_all(s, '{_CLAUSE}') AS c FROM s),
    p AS (SELECT doc_id, n, CASE WHEN length(s) <= 500 THEN [s] WHEN list_max(list_transform(c, lambda x: length(x))) > 500 THEN NULL
              ELSE list_reduce(list_transform(c, lambda x: [x]), lambda a, x: CASE WHEN length(a[len(a)]) + length(x[1]) <= 500 THEN list_concat(a[1:len(a) - 1], [a[len(a)] || x[1]]) ELSE list_concat(a, x) END) END AS p FROM c),
    g AS (SELECT doc_id, CASE WHEN bool_or(p IS NULL) THEN NULL ELSE flatten(list(p ORDER BY n)) END AS g FROM p GROUP BY doc_id),
    d AS (SELECT documents.doc_id, CASE WHEN trim(coalesce(text, ''), ' ') = '' THEN NULL ELSE g END AS g, CASE WHEN trim(coalesce(text, ''), ' ') = '' THEN 'empty_text' WHEN g IS NULL THEN 'clause_too_long' END AS e FROM documents LEFT JOIN g ON documents.doc_id = g.doc_id)
    SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, 'segment_' || lpad(CAST(i AS VARCHAR), 4, '0') AS segment_id, CAST(length(g[i]) AS INTEGER) AS chars, e AS error_code FROM (SELECT doc_id, g, e, unnest(range(1, len(g) + 1)) AS i FROM d WHERE g IS NOT NULL)
    UNION ALL SELECT doc_id, NULL, NULL, NULL, e FROM d WHERE g IS NULL""")
def segment_pack(spark, d):
    rows = segment.segment_rows(_t(spark, d, "documents").select("doc_id", "text"), max_chars=500)
    return rows.select("doc_id", "pos", "segment_id", F.length("segment").alias("chars"), "error_code")


@query(f"""WITH s AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_SENT}')) AS s FROM documents),
    bad AS (SELECT DISTINCT doc_id FROM s WHERE length(s) > 500 AND list_max(list_transform(regexp_extract_all(s, '{_CLAUSE}'), lambda x: length(x))) > 500)
    SELECT d.doc_id, CASE WHEN trim(text, ' ') <> '' AND bad.doc_id IS NULL THEN d.doc_id % 3 <> 1 END AS preserved FROM documents d LEFT JOIN bad ON d.doc_id = bad.doc_id""")
def segment_roundtrip(spark, d):
    """Segments of at most 500 characters; of every third text the first is left out, so it isn't given back. Blank and uncuttable texts have none."""
    whole = segment.segments(F.col("text"), 500)
    parts = F.when(F.col("doc_id") % 3 == 1, F.slice("s", 2, F.size("s"))).otherwise(F.col("s"))
    return _t(spark, d, "documents").withColumn("s", whole).select("doc_id", segment.preserves(F.col("text"), parts).alias("preserved"))


# ---- validation, identity, resume ------------------------------------------------------------------


@query(r"""
    WITH l AS (SELECT conv_id, turn, text, 'line_' || (turn // 2) || CASE WHEN turn % 7 = 6 THEN ' ' ELSE '' END AS id, CASE WHEN role = 'user' THEN 'design' WHEN turn % 5 = 1 THEN 'sing' ELSE 'controllable' END AS mode,
               CASE WHEN turn % 3 = 0 THEN 'softly' END AS instruct, CASE WHEN turn % 4 <> 3 THEN 'voice' END AS character FROM conversations),
    v AS (SELECT conv_id, turn, list_filter([CASE WHEN trim(text) = '' THEN 'text_blank' END, CASE WHEN length(text) > 5000 THEN 'text_too_long' END, CASE WHEN mode NOT IN ('design', 'controllable', 'ultimate') THEN 'mode_unknown' END,
               CASE WHEN mode = 'design' AND instruct IS NULL THEN 'design_needs_instruct' END, CASE WHEN mode <> 'design' AND character IS NULL THEN 'clone_needs_character' END,
               CASE WHEN NOT regexp_full_match(id, '[A-Za-z0-9_-]+') THEN 'id_charset' END], lambda x: x IS NOT NULL) AS v, count(*) OVER (PARTITION BY conv_id, id) > 1 AS rep FROM l)
    SELECT conv_id, turn, array_to_string(v, ',') AS violations, rep AS id_repeated FROM v""")
def batch_validate(spark, d):
    t = F.col("turn")
    lines = _t(spark, d, "conversations").select(
        "conv_id", "turn", "text", F.concat(F.lit("line_"), F.floor(t / 2).cast("string"), F.when(t % 7 == 6, " ").otherwise("")).alias("id"),
        F.when(F.col("role") == "user", "design").when(t % 5 == 1, "sing").otherwise("controllable").alias("mode"), F.when(t % 3 == 0, "softly").alias("instruct"), F.when(t % 4 != 3, "voice").alias("character"),
    )
    rows = validate.repeated_ids(lines, ["conv_id"], "id")
    found = validate.line_violations(F.col("text"), F.col("mode"), F.col("instruct"), F.col("character"), F.col("id"))
    return rows.select("conv_id", "turn", F.array_join(found, ",").alias("violations"), "id_repeated")


@query("SELECT DISTINCT conv_id, turn FROM conversations WHERE turn % 2 = 0")
def batch_resume(spark, d):
    c = _t(spark, d, "conversations")
    return policy.remaining(c, c.where("turn % 2 = 1"), ["conv_id", "turn"]).select("conv_id", "turn").distinct()


@query("""
    WITH r AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS revision, o_orderstatus = 'F' AS valid FROM orders)
    SELECT o_custkey, CAST(max(CASE WHEN valid THEN revision END) AS INTEGER) AS reusable, CAST(max(revision) + 1 AS INTEGER) AS next_revision FROM r GROUP BY o_custkey""")
def revision_pick(spark, d):
    from pyspark.sql import Window

    rows = _t(spark, d, "orders").withColumn("revision", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).withColumn("valid", F.col("o_orderstatus") == "F")
    return policy.newest_valid(rows, ["o_custkey"])


_CANON = " || ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("c_custkey", "c_name", "c_nationkey", "c_mktsegment"))


@query(f"SELECT c_custkey, sha256({_CANON}) AS fingerprint FROM customer")
def fingerprint_rows(spark, d):
    parts = [F.col(c) for c in ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")]
    return _t(spark, d, "customer").select("c_custkey", identity.row_fingerprint(*parts).alias("fingerprint"))


@query("SELECT doc_id, sha256 FROM (SELECT doc_id, sha256(text) AS sha256, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def file_hash_dedupe(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", identity.file_sha256(F.col("text")).alias("sha256"))
    return rows.groupBy("sha256").agg(F.min("doc_id").alias("doc_id"))


# ---- catalogue, audits, lifecycle ------------------------------------------------------------------


@query("SELECT r_name, n_name, CAST(c AS INTEGER) AS candidate FROM region, nation, (SELECT unnest([1, 2, 3]) AS c)")
def cross_suite(spark, d):
    return catalog.audition_plan(_t(spark, d, "region").select("r_name"), _t(spark, d, "nation").select("n_name"), 3)


_SEG = ("AUTOMOBILE", "BUILDING", "HOUSEHOLD")


def _voices(spark, d):
    entry = lambda style: F.struct(F.concat(F.col("n_name"), F.lit(f"/{style}.wav")).alias("reference"))
    base = F.create_map(F.lit("neutral"), entry("neutral"), F.lit("sad"), entry("sad"))
    styles = F.when(F.col("n_nationkey") % 2 == 0, F.map_concat(base, F.create_map(F.lit("angry"), entry("angry")))).otherwise(base)
    return _t(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 3 == 0, "sad").alias("default_style"), styles.alias("styles"))


@query("""
    WITH r AS (SELECT c_custkey, c_nationkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'angry' WHEN 'BUILDING' THEN 'sad' END AS style FROM customer),
    s AS (SELECT c_custkey, coalesce(style, CASE WHEN n_nationkey % 3 = 0 THEN 'sad' ELSE 'neutral' END) AS selected_style, n_name, n_nationkey FROM r LEFT JOIN nation ON c_nationkey = n_nationkey)
    SELECT c_custkey, selected_style, CASE WHEN selected_style <> 'angry' OR n_nationkey % 2 = 0 THEN n_name || '/' || selected_style || '.wav' END AS reference,
           CASE WHEN n_nationkey IS NULL THEN 'voice_not_found' WHEN selected_style = 'angry' AND n_nationkey % 2 = 1 THEN 'style_not_found' END AS error_code FROM s""")
def voice_default_style(spark, d):
    style = F.when(F.col("c_mktsegment") == "AUTOMOBILE", "angry").when(F.col("c_mktsegment") == "BUILDING", "sad")
    asked = _t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("character_id"), style.alias("style"))
    return catalog.resolve_style(asked, catalog.styles(_voices(spark, d))).select("c_custkey", "selected_style", "entry.reference", "error_code")


@query(f"""
    WITH a AS (SELECT label, len(embedding) / {RATE}.0 AS duration, list_max(list_transform({_A}, lambda x: abs(x))) AS peak FROM embeddings)
    SELECT label, count(*) AS clips, count(*) FILTER (duration < 5) AS short, count(*) FILTER (peak > 0.4) AS loud, round(avg(peak), 6) AS mean_peak FROM a GROUP BY label""")
def library_audit(spark, d):
    s = signal.stats(F.col("embedding"), F.col("rate"))
    audited = catalog.audit(_clips(spark, d).withColumn("transcript", F.lit("x")).withColumn("stats", s), RATE, 5.0, 0.4)
    return audited.groupBy("label").agg(
        F.count("*").alias("clips"), F.count_if(F.array_contains("warnings", "reference_short")).alias("short"),
        F.count_if(F.array_contains("warnings", "near_full_scale")).alias("loud"), r6(F.avg("stats.peak")).alias("mean_peak"),
    )


@query("""
    WITH p AS (SELECT d.doc_id AS a, l.doc_id AS b FROM documents d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id)
    SELECT CASE WHEN b IS NULL THEN 'metadata_missing' WHEN a IS NULL THEN 'audio_missing' ELSE 'paired' END AS finding, count(*) AS files FROM p GROUP BY ALL""")
def output_audit_pairing(spark, d):
    audio, meta = _t(spark, d, "documents").select(F.col("doc_id").alias("stem")), _t(spark, d, "labels").select(F.col("doc_id").alias("stem")).distinct()
    return report.output_audit(audio, meta).groupBy(F.coalesce("finding", F.lit("paired")).alias("finding")).agg(F.count("*").alias("files"))


_REVIEW = """SELECT d.doc_id, CASE WHEN d.doc_id % 11 = 3 THEN 'maybe' WHEN l.quality = 1 THEN 'approve' ELSE 'reject' END AS decision, CASE WHEN d.doc_id % 7 <> 2 THEN d.source END AS reviewer, d.doc_id % 5 <> 1 AS listened,
                    d.doc_id % 8 AS rating, CASE WHEN d.doc_id % 2 = 0 THEN 'fine' END AS notes, CASE WHEN l.toxic = 1 THEN 'FAIL' WHEN d.n_chars < 300 THEN 'WARN' ELSE 'PASS' END AS qc,
                    CASE WHEN d.lang = 'en' THEN 'PASS' ELSE 'WARN' END AS transcript, sha256(d.text) AS h FROM documents d JOIN labels l USING (doc_id)"""
_RULES = """CASE WHEN decision = 'maybe' THEN 'decision_unknown' WHEN reviewer IS NULL THEN 'reviewer_required' WHEN NOT listened THEN 'listening_required' WHEN rating < 1 OR rating > 5 THEN 'rating_range'
            WHEN decision = 'approve' AND qc = 'FAIL' THEN 'failed_audio' WHEN decision = 'approve' AND (qc = 'WARN' OR transcript <> 'PASS') AND notes IS NULL THEN 'notes_required' END"""


def _reviews(spark, d):
    i = F.col("doc_id")
    return _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id").select(
        "doc_id", F.when(i % 11 == 3, "maybe").when(F.col("quality") == 1, "approve").otherwise("reject").alias("decision"), F.when(i % 7 != 2, F.col("source")).alias("reviewer"), (i % 5 != 1).alias("listened"),
        F.create_map(F.lit("naturalness"), (i % 8).cast("double")).alias("ratings"), F.when(i % 2 == 0, "fine").alias("notes"),
        F.when(F.col("toxic") == 1, "FAIL").when(F.col("n_chars") < 300, "WARN").otherwise("PASS").alias("qc"), F.when(F.col("lang") == "en", "PASS").otherwise("WARN").alias("transcript"), F.sha2("text", 256).alias("h"),
    )


def _judged(spark, d):
    c = F.col
    return _reviews(spark, d).withColumn("error_code", validate.review_error(c("decision"), c("reviewer"), c("listened"), c("ratings"), c("notes"), c("qc"), c("transcript")))


@query(f"WITH r AS ({_REVIEW}) SELECT doc_id, decision, {_RULES} AS error_code FROM r")
def review_gate(spark, d):
    return _judged(spark, d).select("doc_id", "decision", "error_code")


@query(f"WITH r AS ({_REVIEW}), g AS (SELECT *, {_RULES} AS error_code FROM r) SELECT doc_id, h AS audio_sha256 FROM g WHERE error_code IS NULL AND decision = 'approve' AND doc_id % 13 <> 4")
def approved_delivery(spark, d):
    recorded, _ = lifecycle.split_errors(_judged(spark, d))
    reviews = recorded.withColumnRenamed("h", "audio_sha256").withColumnRenamed("doc_id", "path")
    # Every thirteenth audio has changed since its review.
    audio = _t(spark, d, "documents").select(F.col("doc_id").alias("path"), F.when(F.col("doc_id") % 13 == 4, F.lit("changed")).otherwise(F.sha2("text", 256)).alias("audio_sha256"))
    return lifecycle.approved(reviews, audio).select(F.col("path").alias("doc_id"), "audio_sha256")


@query("""
    WITH v AS (SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS source, CASE WHEN c_custkey % 4 <> 0 THEN c_name END AS provenance FROM customer)
    SELECT c_custkey, coalesce(provenance, 'unknown') AS provenance, coalesce(source, 'unknown') AS source, provenance IS NULL OR source IS NULL AS changed FROM v""")
def metadata_enrich(spark, d):
    rows = _t(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("source"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_name")).alias("provenance"))
    return catalog.enrich(rows, catalog.VOICE_DEFAULTS).select("c_custkey", "provenance", "source", "changed")


@query("""
    WITH s AS (SELECT p_partkey, p_brand AS character, replace(p_name, ' ', '/') AS style, p_size % 6 AS choice FROM part),
    b AS (SELECT DISTINCT p_brand FROM part WHERE p_size > 25)
    SELECT p_partkey, character, style, CAST(choice AS INTEGER) AS choice, CASE WHEN b.p_brand IS NULL THEN 'unknown_character' END AS error_code FROM s LEFT JOIN b ON character = b.p_brand WHERE choice IN (1, 2, 3)""")
def cast_promotion(spark, d):
    p = _t(spark, d, "part")
    picks = p.select("p_partkey", F.concat("p_brand", F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("/"))).alias("selection_key"), (F.col("p_size") % 6).alias("choice"))
    cast = p.where("p_size > 25").select(F.col("p_brand").alias("id")).distinct()
    return catalog.promote(picks, cast).select("p_partkey", "character", "style", "choice", "error_code")


def _sql_escape(c: str) -> str:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        c = f"replace({c}, '{raw}', '{safe}')"
    return c


@query(f"""SELECT page_id, sha256('<article><h2>' || page_id || '</h2><p>' || {_sql_escape('url')} || '</p><audio controls src="' || {_sql_escape('html')} || '"></audio></article>') AS card FROM pages""")
def html_cards(spark, d):
    c = report.card(F.col("page_id").cast("string"), F.col("url"), F.col("html"))
    return _t(spark, d, "pages").select("page_id", F.sha2(c, 256).alias("card"))


@query("""
    SELECT event_type, count(*) AS events, count(DISTINCT user_id) AS users, round(sum(value), 2) AS total, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS max_k FROM events GROUP BY event_type""")
def event_log_summary(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return _t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 2).alias("total"), F.max(k).alias("max_k"))


@query("""
    WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events),
    s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
    SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS events FROM s GROUP BY user_id, n""")
def event_session(spark, d):
    """Extension: sessions with a gap of thirty minutes."""
    out = stream.sessions(_t(spark, d, "events"))
    return out.select("user_id", F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), F.col("n").alias("events"))


@query("SELECT epoch_us(date_trunc('hour', ts)) AS start_us, event_type, count(*) AS events, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def event_hourly(spark, d):
    """Extension: tumbling hours."""
    out = stream.hourly(_t(spark, d, "events"))
    return out.select(F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), "event_type", F.col("n").alias("events"), F.round("total", 2).alias("total"))
