"""The registered queries of the training-corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarlake.llm import convrepair, decontam, disclosure, importance, packing, quality, simhash, suffixdedup, tokencount, toxicity, urlfilter, warc, wordlm

#: The rules that op2 judges by.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(_read(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.url_filter(pages, urlfilter.rules_table(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_read(spark, sf_dir, "documents")).drop("text_left")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return wordlm.corpus_likelihood(docs)


def learnable(doc_id):
    """Rows that labels may be learned from. A null id has no remainder: such a row isn't held out, and has no label."""
    return F.crc32(doc_id.cast("string")) % 3 != 1


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _read(spark, sf_dir, "labels"), learnable)
    scored = toxicity.with_scores(docs, model)
    return scored.select("doc_id", F.coalesce(~learnable(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.repeats(_read(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = lambda c: F.regexp_extract(c, r"^<urn:x-page:(-?\d+)>$", 1).try_cast("long")
    records = warc.round_trip(_read(spark, sf_dir, "pages"))
    return records.select(page(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page(F.col("refers_to")).alias("refers_to"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.suffix_sums(tokencount.length_histogram(_read(spark, sf_dir, "documents")))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.decontaminate(docs, _read(spark, sf_dir, "benchmark")).drop("text")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    repaired = convrepair.repair(convrepair.damage(_read(spark, sf_dir, "conversations")), there=F.col("there"))
    body = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return repaired.select("conv_id", *convrepair.COUNTS, "audit", F.sha2(body, 256).alias("repaired_sha256"))


def op12_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = disclosure.sanitise(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    place = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("spans", lambda s: s["kind"] != disclosure.TERM)
    joined = lambda spans: F.array_join(F.transform(spans, place), ",")
    return found.select("doc_id", *(f"n_{k}" for k in disclosure.KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_url_filter": op2_url_filter,
    "op3_quality_rules": op3_quality_rules,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_toxicity": op5_toxicity,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_warc": op7_warc,
    "op8_token_counts": op8_token_counts,
    "op9_decontamination": op9_decontamination,
    "op10_packing": op10_packing,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_disclosure": op12_disclosure,
    "op13_importance_resampling": op13_importance_resampling,
}

# CRC-32 of a text in DuckDB: the table of its byte steps, and the fold of a text's bytes over it.
_CRC_TABLE = """tab AS (SELECT list(list_reduce([n] || range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS steps
                        FROM (SELECT unnest(range(0, 256)) AS n))"""
_CRC = """xor(list_reduce([4294967295] || list_transform(range(0, length(hex({0})) // 2), lambda i: CAST('0x' || substr(hex({0}), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)),
              lambda c, x: xor(c >> 8, steps[1 + (xor(c, x) & 255)])), 4294967295)"""


def _repair_sql() -> str:
    """op11 as a walk over turns that keeps, for each state, the least (cost, edits) so far with its repaired turns."""

    def then(s, letter, cost, turn=None):
        turns = f"{s}.t" if turn is None else f"list_append({s}.t, {turn})"
        return f"CASE WHEN {s} IS NOT NULL THEN {{'c': {s}.c + {cost}, 'a': {s}.a || '{letter}', 't': {turns}}} END"

    def used(s, letter, cost, turn, when="true"):
        return f"CASE WHEN fault NOT IN (1, 2) AND {when} THEN {then(s, letter, f'{cost} + extra', turn)} END"

    least = lambda *ways: f"list_min([{', '.join(ways)}])"
    kept = "role || ':' || text"
    # States: nothing, a system turn, a user turn last, an assistant turn last. First what may be inserted, then the turn itself.
    open_u = least("s2", *(then(s, "I", 2, "'user:'") for s in ("s0", "s1", "s3")))
    steps = [
        then("s0", "D", 3), least(then("s1", "D", 3), used("s0", "K", 0, kept, "first = 's'")),
        least(then("i2", "D", 3), *(used(s, "K", 0, kept, "first = 'u'") for s in ("s0", "s1", "s3")), *(used(s, "R", 2, "'user:' || text") for s in ("s0", "s1", "s3"))),
        least(then("i3", "D", 3), used("i2", "K", 0, kept, "first = 'a'"), used("i2", "R", 2, "'assistant:' || text")),
    ]
    # A kept or rewritten user turn may also follow an inserted assistant turn, of which i3 is the least.
    steps[2] = least(steps[2], used("i3", "K", 0, kept, "first = 'u'"), used("i3", "R", 2, "'user:' || text"))
    return rf"""
        WITH RECURSIVE {_CRC_TABLE},
        raw AS (SELECT row_number() OVER () AS r, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                       coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
        kinds AS (SELECT raw.*, {_CRC.format('k')} % 20 AS kind FROM raw, tab),
        damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                           CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, r, c
                    FROM kinds, (SELECT unnest([1, 2]) AS c) WHERE kind <> 0 AND (c = 1 OR kind = 3)),
        placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, r, c) AS i, substr(role, 1, 1) AS first,
                          regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) AS final FROM damaged),
        rows AS (SELECT *, CASE WHEN final = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN final NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
                        lag(first) OVER (PARTITION BY conv_id ORDER BY i) || first AS pair FROM placed),
        turns AS (SELECT *, CASE WHEN fault = 3 THEN 1 ELSE 0 END AS extra FROM rows),
        facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
                         count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM turns GROUP BY conv_id),
        walk AS (
            SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 'a': '', 't': CAST([] AS VARCHAR[])}} AS s0, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR[])) AS s1,
                   CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR[])) AS s2, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR[])) AS s3 FROM facts
            UNION ALL
            SELECT conv_id, i, {', '.join(steps)}
            FROM (SELECT *, {least('s3', then('i2', 'I', 2, "'assistant:'"))} AS i3
                  FROM (SELECT w.s0, w.s1, w.s2, w.s3, t.*, {open_u} AS i2 FROM walk w JOIN turns t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.i = w.i + 1))),
        ended AS (SELECT w.conv_id, {least('s0', 's3', then('i2', 'I', 2, "'assistant:'"))} AS best
                  FROM (SELECT *, {open_u} AS i2 FROM walk) w JOIN facts f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.n = w.i)
        SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(best.t, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM c.conv_id"""


ORACLE_SQL: dict[str, str] = {
    "op11_conversation_repair": _repair_sql(),
    "op2_url_filter": r"""
        WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        split AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM cut),
        parts AS (
            SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM split),
        judged AS (
            SELECT *, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                           WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                           WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                           WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM parts)
        SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM judged""",
    "op7_warc": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS hex, max(page_id) OVER (PARTITION BY h) AS last FROM p)
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   CAST(1 + ((CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) AS BIGINT), 1)), '') AS payload_digest,
               CASE WHEN last = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN last <> page_id THEN last END AS refers_to FROM d""",
    "op3_quality_rules": r"""
        WITH d AS (SELECT doc_id, coalesce(source, chr(1)) AS host, coalesce(text, '') AS t FROM documents),
        w AS (SELECT doc_id, host, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
                     list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
        win AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
                FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
        rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
        cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
        ln AS (SELECT DISTINCT doc_id, host, md5(t) AS fp, lower(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'))) AS x
               FROM (SELECT doc_id, host, t, unnest(lines) AS x FROM w)),
        size AS (SELECT host, count(DISTINCT md5(t)) AS docs FROM d GROUP BY host),
        common AS (SELECT host, x FROM (SELECT host, x, count(DISTINCT fp) AS n FROM ln GROUP BY host, x) JOIN size USING (host)
                   WHERE n >= 10 AND n > 0.01 * docs),
        lost AS (SELECT doc_id, sum(len(string_split(x, ' '))) AS n, sum(CASE WHEN c.x2 IS NOT NULL THEN len(string_split(x, ' ')) ELSE 0 END) AS gone
                 FROM ln LEFT JOIN (SELECT host AS h2, x AS x2 FROM common) c ON ln.host = c.h2 AND ln.x = c.x2 GROUP BY doc_id),
        base AS (
            SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
                   CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                   CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_line_words,
                   CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost.gone, 0) AS BIGINT) AS n_removed_words
            FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id LEFT JOIN lost ON w.doc_id = lost.doc_id)
        SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
               NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT n_removed_words > 0.5 * n_line_words AS kept FROM base""",
    "op9_decontamination": r"""
        WITH b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
                   FROM benchmark WHERE item_id IS NOT NULL),
        bw AS (SELECT DISTINCT item_id, s, array_to_string(w[i : i + s - 1], ' ') AS g
               FROM (SELECT item_id, w, least(13, len(w)) AS s, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
        d AS (SELECT row_number() OVER () AS r, doc_id,
                     regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        dw AS (SELECT r, s, i, array_to_string(w[i : i + s - 1], ' ') AS g
               FROM (SELECT r, w, s, unnest(range(1, len(w) - s + 2)) AS i FROM d, (SELECT DISTINCT s FROM bw) WHERE len(w) >= s)),
        hits AS (SELECT r, i, s, item_id FROM dw JOIN bw USING (s, g)),
        hit AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + s)) AS p FROM hits) GROUP BY r),
        named AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
               coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated FROM d LEFT JOIN hit USING (r) LEFT JOIN named USING (r)""",
    "op13_importance_resampling": r"""
        WITH tab AS (
            SELECT list(list_reduce([n] || range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS steps
            FROM (SELECT unnest(range(0, 256)) AS n)),
        d AS (SELECT row_number() OVER () AS r, doc_id,
                     regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
              FROM documents),
        b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
              FROM benchmark),
        dw AS (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(words) AS w FROM d) GROUP BY ALL),
        bw AS (SELECT w, count(*) AS n FROM (SELECT unnest(words) AS w FROM b) GROUP BY ALL),
        crc AS (SELECT w, xor(list_reduce([4294967295] || list_transform(range(0, length(hex(w)) // 2), lambda i: CAST('0x' || substr(hex(w), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)),
                                          lambda c, x: xor(c >> 8, steps[1 + (xor(c, x) & 255)])), 4294967295) % 10000 AS bucket
                FROM (SELECT w FROM dw UNION SELECT w FROM bw), tab),
        s AS (SELECT bucket, sum(n) AS n FROM dw JOIN crc USING (w) GROUP BY bucket),
        t AS (SELECT bucket, sum(n) AS n FROM bw JOIN crc USING (w) GROUP BY bucket),
        gain AS (SELECT k.bucket, CAST(floor(1000 * ln(CAST((coalesce(t.n, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM s) + 10000) AS DOUBLE)
                                                       / CAST((coalesce(s.n, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM t) + 10000) AS DOUBLE))) AS BIGINT) AS g
                 FROM (SELECT unnest(range(0, 10000)) AS bucket) k LEFT JOIN s ON s.bucket = k.bucket LEFT JOIN t ON t.bucket = k.bucket),
        sums AS (SELECT r, sum(n * g) AS total FROM dw JOIN crc USING (w) JOIN gain USING (bucket) GROUP BY r),
        weighed AS (SELECT r, doc_id, CAST(len(words) AS BIGINT) AS n_features,
                           CAST(CASE WHEN total IS NULL THEN 0 WHEN total < 0 THEN -((-total + len(words) - 1) // len(words)) ELSE total // len(words) END AS BIGINT) AS weight,
                           CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
                    FROM d LEFT JOIN sums USING (r)),
        scored AS (SELECT r, doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM weighed),
        placed AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
        SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM scored LEFT JOIN placed USING (r)""",
}
