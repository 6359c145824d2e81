from sonarlake.streaming import events


def test_stream_equals_batch(spark, tmp_path):
    source = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(source)
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = events.hourly(events.read_events(spark, str(tmp_path / "in")), late="10000 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("hourly").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda rows: sorted((str(r["start"]), r["event_type"], r["n"], round(r["total"], 4)) for r in rows)
    assert key(spark.table("hourly").collect()) == key(events.hourly(batch).collect())


def test_once_and_sessions(spark):
    rows = spark.createDataFrame([(1, 5, "2024-01-01 00:00:00"), (1, 5, "2024-01-01 00:00:00"), (2, 5, "2024-01-01 00:29:00"), (3, 5, "2024-01-01 02:00:00")], "event_id int, user_id int, t string").selectExpr("event_id", "user_id", "timestamp(t) AS ts")
    assert events.once(rows).count() == 3
    assert sorted(r["n"] for r in events.sessions(events.once(rows)).collect()) == [1, 2]
