"""Registered queries of readers and sinks: tables go to files in the shared folder, and come back through the readers.

Each run writes to a folder of its own. Documents (JSON, pages, texts, clips) are written as ordered parts, so none is built
in a row; the SQL says what the files must hold from the tables alone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from sonarlake.functions import partial, signal
from sonarlake.operators import lifecycle, ordered, report
from sonarlake.plans import workflows
from sonarlake.plans.queries import _A, ACTIVE, RATE, SILENT, _clips, _t, _voices, query, r6
from sonarlake.shared import checkpointed, shared_dir
from sonarlake.sources import clips, merge, readers, sinks, store
from sonarlake.streaming import reviews


def _folder(spark, name):
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _documents(spark, name, parts):
    """Writes the parts; returns where the files are, as a pattern that readers take."""
    root = _folder(spark, name)
    store.write_files(parts, root, order="part")
    return f"{root}/data/*/*/files"


def _stem_of(path):
    return F.regexp_extract(path, r"/([^/]*)\.[^./]*$", 1)


# ---- documents of requests, voices and manifests -----------------------------------------------------


@query("""SELECT 'p' || conv_id % 20 AS project, CAST(row_number() OVER (PARTITION BY conv_id % 20 ORDER BY conv_id, turn) - 1 AS INTEGER) AS pos, conv_id || '-' || turn AS id, role AS character_id, text,
        CASE WHEN turn % 2 = 0 THEN 'design' END AS mode, 3 AS candidates, turn AS seed FROM conversations""")
def request_lines(spark, d):
    line = F.to_json(F.struct(
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("role").alias("character_id"), "text", F.when(F.col("turn") % 2 == 0, "design").alias("mode"), F.col("turn").alias("seed")))
    rows = _t(spark, d, "conversations").withColumn("file", F.concat(F.lit("p"), F.col("conv_id") % 20, F.lit(".json")))
    head = F.concat(F.lit('{"candidates": 3, "project": "'), F.regexp_replace("file", r"\.json$", ""), F.lit('", "lines": ['))
    where = _documents(spark, "requests", ordered.document(rows, ["file"], ["conv_id", "turn"], line, head=head, tail="]}", between=",\n"))
    got = readers.batch_lines(spark, f"{where}/*.json")
    return got.select("project", "pos", "line.id", "line.character_id", "line.text", "line.mode", "candidates", "line.seed")


@query("""
    WITH v AS (SELECT n_nationkey, n_name, unnest(CASE WHEN n_nationkey % 2 = 0 THEN ['angry', 'neutral', 'sad'] ELSE ['neutral', 'sad'] END) AS style FROM nation)
    SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, CASE WHEN n_nationkey % 3 = 0 THEN 'sad' END AS default_style, style, n_name || '/' || style || '.wav' AS reference FROM v""")
def voice_files(spark, d):
    voices = _voices(spark, d).select(F.concat_ws("/", "id", F.lit("voice.json")).alias("file"), F.to_json(F.struct(F.col("id").cast("string").alias("id"), "name", "default_style", "styles")).alias("body"))
    where = _documents(spark, "voices", ordered.document(voices, ["file"], ["file"], F.col("body")))
    return readers.voices(spark, where).select("id", "name", "default_style", F.explode("styles").alias("style", "entry")).select("id", "name", "default_style", "style", "entry.reference")


@query("""
    SELECT CAST(o_custkey % 20 AS VARCHAR) AS project, CAST(year(o_orderdate) AS INTEGER) AS revision_number, CAST(row_number() OVER (PARTITION BY o_custkey % 20, year(o_orderdate) ORDER BY o_orderkey) - 1 AS INTEGER) AS pos,
           CAST(o_orderkey AS VARCHAR) AS id, o_orderkey % 5 AS recommended_candidate FROM orders""")
def manifest_lines(spark, d):
    rows = _t(spark, d, "orders").select(
        (F.col("o_custkey") % 20).cast("string").alias("project"), F.format_string("run_%04d", F.year("o_orderdate")).alias("run"), F.lit("manifest.json").alias("file"), "o_orderkey")
    line = F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("id"), F.struct((F.col("o_orderkey") % 5).alias("recommended_candidate")).alias("selection")))
    head = F.concat(F.lit('{"project": "'), "project", F.lit('", "status": "running", "lines": ['))
    where = _documents(spark, "manifests", ordered.document(rows, ["project", "run", "file"], ["o_orderkey"], line, head=head, tail="]}", between=","))
    return readers.manifests(spark, f"{where}/*").select("project", "revision_number", "pos", "line.id", "line.selection.recommended_candidate")


@query("""SELECT p_name AS term, CASE WHEN min(p_partkey) % 2 = 0 THEN 'part ' || min(p_partkey) ELSE 'n' || min(p_partkey) END AS spoken, CASE WHEN min(p_partkey) % 2 = 0 THEN p_name || '!' END AS expected FROM part GROUP BY p_name""")
def lexicon_file(spark, d):
    rows = _t(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("k"))
    entry = F.to_json(F.struct(F.concat(F.lit("part "), "k").alias("spoken"), F.concat("p_name", F.lit("!")).alias("expected")))
    bare = F.concat(F.lit('"n'), "k", F.lit('"'))
    key = F.to_json(F.create_map("p_name", F.lit(0)))  # a JSON string, with escapes, before the colon
    line = F.concat(F.regexp_extract(key, r"^\{(.*):0\}$", 1), F.lit(": "), F.when(F.col("k") % 2 == 0, entry).otherwise(bare))
    where = _documents(spark, "lexicon", ordered.document(rows.withColumn("file", F.lit("lexicon.json")), ["file"], ["p_name"], line, head="{", tail="}", between=",\n"))
    return readers.lexicon(spark, f"{where}/lexicon.json").select("term", "spoken", "expected")


@query("""SELECT CAST(item_id AS VARCHAR) AS id, CASE item_id % 3 WHEN 0 THEN 'sad' WHEN 1 THEN 'angry' END AS emotion, text FROM benchmark""")
def benchmark_suite(spark, d):
    rows = _t(spark, d, "benchmark").withColumn("file", F.lit("suite.json"))
    case = F.to_json(F.struct(F.col("item_id").cast("string").alias("id"), F.when(F.col("item_id") % 3 == 0, "sad").when(F.col("item_id") % 3 == 1, "angry").alias("emotion"), "text"))
    where = _documents(spark, "suite", ordered.document(rows, ["file"], ["item_id"], case, head='{"cases": [', tail="]}", between=","))
    return readers.benchmark_cases(spark, f"{where}/suite.json")


@query("""SELECT source AS file, sha256(string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id)) AS sha256, CAST(sum(length(coalesce(text, ''))) + count(*) - 1 AS BIGINT) AS chars FROM documents GROUP BY source""")
def long_text_files(spark, d):
    rows = _t(spark, d, "documents").withColumn("file", F.concat("source", F.lit(".txt")))
    where = _documents(spark, "texts", ordered.document(rows, ["file"], ["doc_id"], F.coalesce("text", F.lit("")), between="\n"))
    texts = readers.long_text(spark, f"{where}/*.txt")
    return texts.select(_stem_of(F.col("path")).alias("file"), F.sha2("value", 256).alias("sha256"), F.length("value").cast("long").alias("chars"))


@query("""SELECT s_name AS stem, CAST(octet_length(encode(s_name || s_nationkey)) AS BIGINT) AS length, CASE s_suppkey % 3 WHEN 0 THEN 'PASS' WHEN 1 THEN 'WARN' END AS qc FROM supplier""")
def sidecar_files(spark, d):
    """Clips and the metadata beside them meet by the path without its ending; every third clip has none. Names that repeat go to folders of their own."""
    take = F.row_number().over(Window.partitionBy("s_name").orderBy("s_suppkey"))
    rows = _t(spark, d, "supplier").withColumn("take", take)
    clip = rows.select("take", F.concat("s_name", F.lit(".wav")).alias("file"), F.concat("s_name", "s_nationkey").alias("body"))
    side = rows.where("s_suppkey % 3 IN (0, 1)").select("take", F.concat("s_name", F.lit(".json")).alias("file"), F.to_json(F.struct(F.col("s_name").alias("output"), F.struct(F.when(F.col("s_suppkey") % 3 == 0, "PASS").otherwise("WARN").alias("status")).alias("qc"))).alias("body"))
    where = _documents(spark, "takes", ordered.document(clip.unionByName(side), ["take", "file"], ["file"], F.col("body"))).partition("/data/")[0]
    found = readers.files(spark, where).select(readers.stem(F.col("path")).alias("stem"), "length")
    meta = readers.candidates(spark, where).select("stem", "qc.status")
    return found.join(meta, "stem", "left").select(F.regexp_extract("stem", "([^/]*)$", 1).alias("stem"), "length", F.col("status").alias("qc"))


# ---- sinks -------------------------------------------------------------------------------------------


@query("""SELECT event_type AS event, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS events FROM events GROUP BY ALL""")
def event_file(spark, d):
    """Two appends, then one log."""
    path = _folder(spark, "events")
    rows = _t(spark, d, "events").select(F.col("event_type").alias("event"), F.create_map(F.lit("k"), F.get_json_object("props", "$.k")).alias("properties"), "event_id")
    for part in (F.col("event_id") % 2 == 0, F.coalesce(F.col("event_id") % 2 != 0, F.lit(True))):
        sinks.append_events(rows.where(part).drop("event_id"), path)
    log = readers.events(spark, path).where(F.col("time").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$"))
    return log.groupBy("event", F.col("properties")["k"].cast("long").alias("k")).agg(F.count("*").alias("events"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 OR p_partkey % 13 = 0 THEN NULL ELSE p_retailprice END AS price, p_partkey % 11 = 0 OR p_partkey % 13 = 0 AS refused FROM part""")
def json_sink(spark, d):
    k = F.col("p_partkey")
    price = F.when(k % 11 == 0, float("nan")).when(k % 13 == 0, float("-inf")).otherwise(F.col("p_retailprice").cast("double"))
    path = _folder(spark, "json")
    bad = sinks.write_json(_t(spark, d, "part").select("p_partkey", price.alias("price")), path)
    good = spark.read.schema("p_partkey long, price double").json(path).withColumn("refused", F.lit(False))
    return good.unionByName(bad.select("p_partkey", F.lit(None).cast("double").alias("price"), F.lit(True).alias("refused")))


@query("""SELECT o_custkey % 20 AS project, CAST(year(o_orderdate) AS INTEGER) AS revision, count(*) AS lines, CAST(sum(o_orderkey) AS BIGINT) AS total FROM orders GROUP BY ALL""")
def lines_appended(spark, d):
    path = _folder(spark, "lines")
    rows = _t(spark, d, "orders").select((F.col("o_custkey") % 20).alias("project"), F.year("o_orderdate").alias("revision"), "o_orderkey")
    for odd in (0, 1):
        sinks.append_lines(rows.where(F.col("o_orderkey") % 2 == odd), path)
    return spark.read.parquet(path).groupBy(F.col("project").cast("long").alias("project"), "revision").agg(F.count("*").alias("lines"), F.sum("o_orderkey").alias("total"))


@query("""SELECT page_id % 16 AS file, CAST(sum(octet_length(encode(coalesce(html, '')))) AS BIGINT) AS length, sha256(string_agg(coalesce(html, ''), '' ORDER BY page_id)) AS sha256,
        sha1('blob ' || sum(octet_length(encode(coalesce(html, '')))) || chr(0) || string_agg(coalesce(html, ''), '' ORDER BY page_id)) AS blob_sha1, page_id % 16 <> 3 AS verified FROM pages GROUP BY page_id % 16""")
def artifact_digests(spark, d):
    """Files hashed in blocks, and held against receipts of which one is wrong."""
    rows = _t(spark, d, "pages").withColumn("file", F.col("page_id") % 16)
    listed = store.write_files(ordered.document(rows, ["file"], ["page_id"], F.coalesce("html", F.lit(""))), _folder(spark, "artifacts"), order="part")
    found = checkpointed(store.digests(listed).join(listed.select("path", "name", F.col("sha256").alias("_written")), "path").select(F.col("name").alias("path"), "length", "sha256", "blob_sha1", "_written"))
    receipts = found.select("path", F.lit("r1").alias("revision"), F.when(F.col("path") == "3", "0" * 40).when(F.col("path") % 2 == 0, F.col("_written")).otherwise(F.col("blob_sha1")).alias("etag"))
    checked = lifecycle.verify_receipts(found, receipts).select("path", "verified")
    return found.join(checked, "path").select(F.col("path").cast("long").alias("file"), "length", "sha256", "blob_sha1", "verified")


@query("""
    WITH c AS (SELECT label, '<article><h2>' || vec_id || '</h2><p>' || label || '</p><audio controls src="' || vec_id || '.wav"></audio></article>' AS card, vec_id FROM embeddings)
    SELECT CAST(label AS VARCHAR) AS file, sha256('<!doctype html><meta charset="utf-8">' || string_agg(card, '' ORDER BY vec_id)) AS sha256 FROM c GROUP BY label""")
def listening_pages(spark, d):
    v = F.col("vec_id").cast("string")
    cards = _t(spark, d, "embeddings").select("label", "vec_id", report.card(v, F.col("label").cast("string"), F.concat(v, F.lit(".wav"))).alias("card"))
    return store.write_files(report.page(cards, ["label"], "vec_id"), _folder(spark, "pages"), order="part").select(F.col("name").alias("file"), "sha256")


@query("""SELECT row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber) AS rank, l_orderkey, l_linenumber FROM lineitem""")
def ranked_lines(spark, d):
    """Places in an order over all rows, without a window over all rows."""
    rows = _t(spark, d, "lineitem").select("l_extendedprice", "l_orderkey", "l_linenumber")
    return ordered.with_rank(rows, ["l_extendedprice", "l_orderkey", "l_linenumber"]).select("rank", "l_orderkey", "l_linenumber")


# ---- clips in parts ----------------------------------------------------------------------------------

_CUT = 7


def _stat_columns(s):
    edge = s["edge_silence_seconds"]
    return [
        s["frames"].alias("frames"), r6(s["peak"]).alias("peak"), r6(s["rms"]).alias("rms"), r6(s["dc_offset"]).alias("dc"), r6(s["silence_ratio"]).alias("silence"), r6(s["max_sample_jump"]).alias("jump"),
        r6(edge["start"]).alias("start_seconds"), r6(edge["end"]).alias("end_seconds"), r6(s["longest_silence_seconds"]).alias("longest"),
    ]


_WHOLE = f"""
    i AS (SELECT k, p, p - row_number() OVER (PARTITION BY k ORDER BY p) AS island FROM (SELECT k, a, unnest(range(1, len(a) + 1)) AS p FROM c) WHERE abs(a[p]) < {SILENT}),
    runs AS (SELECT k, max(n) / {{rate}}.0 AS longest FROM (SELECT k, island, count(*) AS n FROM i GROUP BY k, island) GROUP BY k),
    act AS (SELECT k, list_filter(range(1, len(a) + 1), lambda i: abs(a[i]) > {ACTIVE}) AS act FROM c)
    SELECT c.k AS clip, len(a) AS frames, round(list_max(list_transform(a, lambda x: abs(x))), 6) AS peak, round(sqrt(list_sum(list_transform(a, lambda x: x * x)) / len(a)), 6) AS rms,
           round(list_sum(a) / len(a), 6) AS dc, round(len(list_filter(a, lambda x: abs(x) < {SILENT})) / CAST(len(a) AS DOUBLE), 6) AS silence,
           round(list_max(list_transform(range(1, len(a)), lambda i: abs(a[i + 1] - a[i]))), 6) AS jump,
           round(CASE WHEN len(act) > 0 THEN list_min(act) - 1 ELSE len(a) END / {{rate}}.0, 6) AS start_seconds, round(CASE WHEN len(act) > 0 THEN len(a) - list_max(act) ELSE len(a) END / {{rate}}.0, 6) AS end_seconds,
           round(coalesce(longest, 0), 6) AS longest FROM c JOIN act ON c.k = act.k LEFT JOIN runs ON c.k = runs.k"""


@query(f"WITH c AS (SELECT vec_id AS k, {_A} AS a FROM embeddings), " + _WHOLE.replace("{rate}", str(RATE)))
def wave_stats_in_parts(spark, d):
    """Vectors cut into pieces of seven samples have the statistics of whole ones."""
    at = F.sequence(F.lit(0), F.greatest(F.size("embedding") - 1, F.lit(0)), F.lit(_CUT))
    cut = _clips(spark, d).select(F.col("vec_id").alias("clip"), F.posexplode(F.transform(at, lambda i: F.slice("embedding", i + 1, _CUT))).alias("chunk", "samples"), F.col("rate").alias("sample_rate"))
    return partial.clip_stats(cut, ["clip"], silence=SILENT, edge=ACTIVE).select("clip", *_stat_columns(F.col("stats")))


@query(f"""
    WITH c AS (SELECT label AS k, list(CAST(CAST(round(CAST(x AS DOUBLE) * 8388607) / 8388608 AS FLOAT) AS DOUBLE) ORDER BY vec_id, p) AS a
               FROM (SELECT label, vec_id, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS p FROM embeddings) GROUP BY label), """ + _WHOLE.replace("{rate}", str(signal.TARGET_RATE)))
def wave_file_round_trip(spark, d):
    """All vectors of a label as one PCM_24 file, written in chunks and read in other ones."""
    rows = _t(spark, d, "embeddings").select(F.concat("label", F.lit(".wav")).alias("name"), F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).alias("chunk"), F.col("embedding").alias("samples"))
    listed = store.write_files(clips.parts(rows, "name"), _folder(spark, "clips"), order="part")
    stats = partial.clip_stats(clips.chunks(listed, frames=1000), ["path"], channels="channels", subtype="subtype", silence=SILENT, edge=ACTIVE)
    return stats.where("stats.subtype = 'PCM_24' AND stats.channels = 1").select(_stem_of(F.col("path")).cast("int").alias("clip"), *_stat_columns(F.col("stats")))


@query(f"""
    WITH c AS (SELECT label, flatten(list(list_transform(embedding, lambda x: round(CAST(x AS DOUBLE) * 8388607) / 8388608) ORDER BY vec_id)) AS a FROM embeddings GROUP BY label)
    SELECT CAST(label AS VARCHAR) AS clip, len(a) AS frames, CASE WHEN list_max(list_transform(a, lambda x: abs(x))) >= 0.999 THEN 'FAIL' ELSE 'PASS' END AS failed,
           list_max(list_transform(range(1, len(a)), lambda i: abs(a[i + 1] - a[i]))) > 0.5 AS discontinuous FROM c""")
def clip_files_inspected(spark, d):
    """The quality rules over files that are read in ranges."""
    rows = _t(spark, d, "embeddings").select(F.concat("label", F.lit(".wav")).alias("name"), F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).alias("chunk"), F.col("embedding").alias("samples"))
    listed = store.write_files(clips.parts(rows, "name"), _folder(spark, "clips"), order="part")
    judged = workflows.inspect_chunks(clips.chunks(listed, frames=5000))
    return judged.select(_stem_of(F.col("path")).alias("clip"), F.col("stats.frames").alias("frames"), F.when(F.col("qc.status") == "FAIL", "FAIL").otherwise("PASS").alias("failed"),
                         F.array_contains("qc.warnings", "waveform_discontinuity").alias("discontinuous"))


@query(f"""
    WITH v AS (SELECT label, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings),
    c AS (SELECT label AS k, flatten(list(CASE WHEN n > 1 THEN list_transform(range(0, 8), lambda i: 0.0::DOUBLE) || a ELSE a END ORDER BY vec_id)) AS a FROM v GROUP BY label), """ + _WHOLE.replace("{rate}", str(RATE)))
def wave_join_parts(spark, d):
    """Clips of all vectors of a label, with half a second between them, as chunks and never as a list."""
    chunks = lifecycle.joined_chunks(_t(spark, d, "embeddings"), ["label"], "vec_id", "embedding", RATE, 0.5).withColumn("sample_rate", F.lit(RATE))
    return partial.clip_stats(chunks, ["label"], silence=SILENT, edge=ACTIVE).select(F.col("label").alias("clip"), *_stat_columns(F.col("stats")))


# ---- merges and ledgers ------------------------------------------------------------------------------

_CHANGE = "CASE WHEN c_custkey % 5 = 0 THEN 'replace' WHEN c_custkey % 7 = 1 THEN 'same' WHEN c_custkey % 11 = 2 THEN 'conflict' WHEN c_custkey % 13 = 3 THEN 'insert' END"


@query(f"""
    WITH c AS (SELECT *, {_CHANGE} AS change FROM customer),
    u AS (SELECT CASE WHEN change = 'insert' THEN c_custkey + 1000000000 ELSE c_custkey END AS id, change FROM c WHERE change IS NOT NULL)
    SELECT coalesce(b.c_custkey, u.id) AS id, CASE WHEN change = 'replace' THEN 2 ELSE 1 END AS version,
           CASE WHEN change = 'replace' THEN b.c_name || ' again' WHEN change = 'insert' THEN 'new' ELSE b.c_name END AS text, change AS action FROM customer b FULL JOIN u ON b.c_custkey = u.id""")
def registry_merge(spark, d):
    """A registry and updates of it: what each update did, and what the table holds then."""
    path, change = _folder(spark, "registry"), F.expr(_CHANGE)
    base = _t(spark, d, "customer").select("c_custkey", F.col("c_custkey").alias("id"), F.lit(1).alias("version"), F.col("c_name").alias("text"))
    merge.merge(base.drop("c_custkey"), path, ["id"], "version", "bucket", buckets=16)
    text = F.when(change == "replace", F.concat("text", F.lit(" again"))).when(change == "conflict", "other").when(change == "insert", "new").otherwise(F.col("text"))
    updates = base.where(change.isNotNull()).select(
        F.when(change == "insert", F.col("id") + 1_000_000_000).otherwise(F.col("id")).alias("id"), F.when(change == "replace", 2).otherwise(1).alias("version"), text.alias("text"))
    done = merge.merge(updates, path, ["id"], "version", "bucket", buckets=16)
    return spark.read.parquet(path).select("id", "version", "text").join(done.select("id", "action"), "id", "left")


@query("""
    SELECT doc_id, n AS review, CASE
        WHEN n = 3 THEN 'review_repeated' WHEN doc_id % 9 = 4 THEN 'candidate_changed' WHEN n = 4 THEN 'review_late'
        WHEN n = 1 THEN CASE WHEN doc_id % 7 = 2 THEN 'reviewer_required' WHEN quality = 1 AND toxic = 1 THEN 'failed_audio' END
        WHEN doc_id % 7 = 2 OR (quality = 1 AND toxic = 1) THEN NULL ELSE 'already_decided' END AS error_code
    FROM (SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id), (SELECT unnest([1, 2, 3, 4]) AS n)""")
def review_order(spark, d):
    """Four reviews of each candidate in the order of their time: one by the rules, one more, one that repeats an id, and a late one."""
    rows = _t(spark, d, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    hour = lambda n: F.timestamp_seconds(F.lit(1_700_000_000) + 3600 * n)
    none = F.lit(None).cast("string")
    key, i = F.col("doc_id").cast("string").alias("audio_sha256"), F.col("doc_id")
    candidate = rows.where("doc_id % 9 <> 4").select(
        F.lit("candidate").alias("kind"), key, hour(F.lit(0)).alias("time"), none.alias("review_id"), none.alias("decision"), none.alias("reviewer"), F.lit(None).cast("boolean").alias("listened"),
        F.lit(None).cast("map<string,double>").alias("ratings"), none.alias("notes"), F.when(F.col("toxic") == 1, "FAIL").otherwise("PASS").alias("qc"), F.lit("PASS").alias("transcript"))
    n = F.col("n")
    reviews_ = rows.withColumn("n", F.explode(F.array(*(F.lit(k) for k in (1, 2, 3, 4))))).select(
        F.lit("review").alias("kind"), key, hour(F.when(n == 4, 200).otherwise(n)).alias("time"), F.when(n == 3, "1").otherwise(n.cast("string")).alias("review_id"),
        F.when((n == 1) & (F.col("quality") == 1), "approve").otherwise("reject").alias("decision"), F.when((n > 1) | (i % 7 != 2), "ann").alias("reviewer"), F.lit(True).alias("listened"),
        F.create_map(F.lit("prosody"), F.lit(3.0)).alias("ratings"), F.lit("").alias("notes"), none.alias("qc"), none.alias("transcript"))
    taken = reviews.ledger(candidate.unionByName(reviews_))
    place = F.when(F.col("error_code") == "review_repeated", 3).otherwise(F.col("review_id").cast("int"))
    return taken.select(F.col("audio_sha256").cast("long").alias("doc_id"), place.alias("review"), "error_code")
