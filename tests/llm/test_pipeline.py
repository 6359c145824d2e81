import random

import corpus_pipeline
from llm_helpers import prose

from sonarlake.llm import queries


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(8)
    item = prose(rng, 40)
    passage = prose(rng, 60)
    rows, labels = [], []
    for i in range(400):
        words = prose(rng, rng.randrange(60, 120)).split()
        toxic = i % 5 == 0
        for _ in range(5 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["idiot", "scum", "moron"]))
        rows.append((i, " ".join(words), "en", f"src{i % 3}"))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, rows[1][1], "en", "s"), (1001, rows[1][1] + " more", "en", "s"), (1002, item + " " + prose(rng, 20), "en", "s"), (1003, prose(rng, 50) + " " + passage, "en", "s"), (1004, passage + " " + prose(rng, 50), "en", "s"), (1005, None, "en", "s")]
    d = str(tmp_path)
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    left = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, d)
        docs.write.parquet(f"{d}/{k}")
        docs = spark.read.parquet(f"{d}/{k}")
        if k < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
        left.append({r["doc_id"] for r in docs.select("doc_id").distinct().collect()})
    toxic = {i for i in range(400) if i % 5 == 0}
    assert len(toxic & left[0]) < 4 and {i for i, *_ in rows} - left[0] <= toxic
    assert left[0] - left[1] == {1000, 1001} or left[0] - left[1] == {1000}
    assert left[2] == left[1] and left[2] - left[3] == {1002} and left[4] == left[3]
    cut = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/2").collect()}
    assert passage in cut[1003] and passage not in cut[1004]
    got = {tuple(r) for r in corpus_pipeline.run(spark, d).select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect()}
    assert got and {g[0] for g in got} == left[4]
    assert corpus_pipeline.ORACLE_SQL is None and all(n in queries.QUERIES for n in queries.ORACLE_SQL)


def test_empty_tables(spark, tmp_path):
    d = str(tmp_path)
    for name, columns in (("documents", "doc_id long, text string, lang string, source string, n_chars long, __key long, band string"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], columns).write.parquet(f"{d}/{name}.parquet")
    packed = corpus_pipeline.run(spark, d)
    assert packed.count() == 0 and {"doc_id", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(packed.columns)
