import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sonarlake.sources import merge
from sonarlake.streaming import reviews


def files_of(path):
    return {f"{os.path.basename(d)}/{n}" for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def test_merge_rewrites_touched_partitions_only(spark, tmp_path):
    path = str(tmp_path / "voices")
    rows = spark.createDataFrame([(f"v{k}", k % 3, 1, f"text {k}", k % 5) for k in range(40)], "id string, style int, version int, text string, part int")
    first = merge.merge(rows, path, ["id"], "version", "part")
    assert {r["action"] for r in first.collect()} == {"insert"} and spark.read.parquet(path).count() == 40
    before = files_of(path)
    updates = spark.createDataFrame(
        [("v1", 1, 2, "new", 1), ("v1", 1, 3, "newer", 1), ("v6", 0, 1, "other", 1), ("v11", 2, 1, "text 11", 1), ("v2", 2, 1, "text 2", 2), ("new", 9, 1, "x", 3), (None, 1, 1, "x", 3), ("v3", 0, None, "x", 3), ("v8", 2, 0, "older", 3)],
        "id string, style int, version int, text string, part int")
    plan = {(r["id"], r["version"]): r["action"] for r in merge.merge(updates, path, ["id"], "version", "part").collect()}
    assert plan == {("v1", 2): "superseded", ("v1", 3): "replace", ("v6", 1): "conflict", ("v11", 1): "same", ("v2", 1): "same", ("new", 1): "insert", (None, 1): "invalid", ("v3", None): "invalid", ("v8", 0): "conflict"}
    after = files_of(path)
    kept = lambda files, k: {f for f in files if f.startswith(f"part={k}/")}
    assert all(kept(before, k) == kept(after, k) for k in (0, 2, 4)) and all(not kept(before, k) & kept(after, k) for k in (1, 3))
    table = {r["id"]: r["text"] for r in spark.read.parquet(path).collect()}
    assert len(table) == 41 and table["v1"] == "newer" and table["new"] == "x" and table["v6"] == "text 6"
    assert merge.merge(updates.limit(0), path, ["id"], "version", "part").count() == 0 and files_of(path) == after


def test_merge_in_any_order_ends_alike(spark, tmp_path):
    rng = random.Random(5)
    updates = [(f"k{rng.randrange(12)}", v, f"{v}") for v in range(60)]
    ends = []
    for n in range(2):
        rng.shuffle(updates)
        path = str(tmp_path / f"t{n}")
        for at in range(0, 60, 20):
            merge.merge(spark.createDataFrame(updates[at : at + 20], "id string, version int, text string"), path, ["id"], "version", "bucket", buckets=4)
        ends.append(sorted((r["id"], r["version"], r["text"]) for r in spark.read.parquet(path).collect()))
    best = {}
    for k, v, t in updates:
        best[k] = max(best.get(k, (0, "")), (v, t))
    assert ends[0] == ends[1] == sorted((k, *v) for k, v in best.items())


NOON = datetime(2024, 5, 1, 12)


def events_at_random(rng, n):
    out = []
    for k in range(n):
        key = f"h{rng.randrange(n // 5)}"
        at = NOON + timedelta(minutes=rng.randrange(600))
        if rng.random() < 0.3:
            out.append(("candidate", key, at, None, None, None, None, None, None, rng.choice(["PASS", "WARN", "FAIL", None]), rng.choice(["PASS", "FAIL", None])))
        else:
            out.append(("review", key, at, f"r{rng.randrange(n)}", rng.choice(["approve", "reject", "rate", "what"]), rng.choice(["ann", "ann", " "]), rng.random() < 0.9, rng.choice([{}, {"prosody": 3.0}, {"prosody": 9.0}]), rng.choice(["", "fine"]), None, None))
    return out


def by_hand(events, open_seconds):
    """The ledger as a person would keep it, event by event."""
    out, since, decided, seen = [], {}, set(), set()
    for kind, key, at, review, decision, reviewer, listened, ratings, notes, qc, transcript in sorted(events, key=lambda e: (e[2], e[0] != "candidate", (e[9] or "") + "/" + (e[10] if e[10] == "PASS" else ""), e[3] or "")):
        if kind == "candidate":
            since.setdefault(key, (at, qc, transcript))
            continue
        error = None
        if (key, review) in seen:
            error = "review_repeated"
        elif key not in since:
            error = "candidate_changed"
        elif at > since[key][0] + timedelta(seconds=open_seconds):
            error = "review_late"
        elif key in decided:
            error = "already_decided"
        elif decision not in ("approve", "reject", "rate"):
            error = "decision_unknown"
        elif not reviewer.strip():
            error = "reviewer_required"
        elif not listened:
            error = "listening_required"
        elif any(not 1 <= r <= 5 for r in ratings.values()):
            error = "rating_range"
        elif decision == "approve" and since[key][1] == "FAIL":
            error = "failed_audio"
        elif decision == "approve" and (since[key][1] == "WARN" or since[key][2] != "PASS") and not notes.strip():
            error = "notes_required"
        elif decision in ("approve", "reject"):
            decided.add(key)
        seen.add((key, review))
        out.append((key, review, decision, error))
    return sorted(out, key=str)


def test_ledger_of_a_table(spark):
    rng = random.Random(6)
    for _ in range(2):
        events = events_at_random(rng, 250)
        got = reviews.ledger(spark.createDataFrame(events, reviews.EVENT).repartition(3), 3 * 3600)
        assert sorted(map(tuple, got.collect()), key=str) == by_hand(events, 3 * 3600)
    odd = reviews.ledger(spark.createDataFrame([("review", None, NOON, "r", "rate", "a", True, {}, "", None, None), ("review", "k", NOON, None, "rate", "a", True, {}, "", None, None)], reviews.EVENT))
    assert [r["error_code"] for r in odd.collect()] == ["event_invalid"] * 2


def test_ledger_stream_equals_the_table(spark, tmp_path):
    rng = random.Random(7)
    events = events_at_random(rng, 120)
    want = by_hand(events, 3 * 3600)
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rng.shuffle(events)
        folder = str(tmp_path / "in")
        for at in range(0, len(events), 60):  # two files in any order of time, and a late end that moves the watermark
            spark.createDataFrame(events[at : at + 60], reviews.EVENT).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)
        start = lambda: reviews.ledger_stream(stream, 3 * 3600, "24 hours").writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        start().awaitTermination()
        end = ("candidate", "end", NOON + timedelta(days=9), None, None, None, None, None, None, "PASS", "PASS")
        spark.createDataFrame([end], reviews.EVENT).coalesce(1).write.mode("append").parquet(folder)
        start().awaitTermination()
        got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("audio_sha256", "review_id", "decision", "error_code").collect()), key=str)
        assert got == want
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
