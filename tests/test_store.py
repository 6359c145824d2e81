import hashlib
import os
import resource
import subprocess
import sys
import textwrap

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sonarlake.operators import lifecycle
from sonarlake.sources import readers, store


def blob(data):
    return hashlib.sha1(b"blob %d\0" % len(data) + data).hexdigest()


def test_digests_in_blocks(spark, tmp_path):
    contents = {"a b": b"", "c": b"x" * (store.BLOCK - 1), "d/é": os.urandom(2 * store.BLOCK + 3)}
    for n, data in contents.items():
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_bytes(data)
    found = spark.createDataFrame([(f"file:{tmp_path}/{n}",) for n in contents], "path string")
    assert store.digests(readers.files(spark, str(tmp_path), "*")).count() == 2  # Spark doesn't list empty files
    got = {r["path"].partition(str(tmp_path) + "/")[2]: tuple(r)[1:] for r in store.digests(found, length=None).collect()}
    assert got == {n: (len(d), hashlib.sha256(d).hexdigest(), blob(d), None) for n, d in contents.items()}
    odd = spark.createDataFrame([(str(tmp_path / "c"), 5), (str(tmp_path / "none"), 5)], "path string, length long")
    assert sorted(r["error_code"] for r in store.digests(odd).collect()) == ["file_changed", "file_unreadable"]


def test_file_of_over_two_gigabytes_in_little_memory(tmp_path):
    """A sparse file: binaryFile can't hold it in a row, and neither may the process that hashes it."""
    size = (2 << 30) + 12_345
    path = tmp_path / "large"
    with open(path, "wb") as f:
        f.truncate(size)
    want, block = hashlib.sha256(), bytes(1 << 24)
    for at in range(0, size, len(block)):
        want.update(block[: size - at])
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert store.digest(f"file:{path}", size)[:2] == (size, want.hexdigest())
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200 * 1024


def test_large_file_through_spark(spark, tmp_path):
    with open(tmp_path / "large", "wb") as f:
        f.truncate((2 << 30) + 1)
    row = store.digests(readers.files(spark, str(tmp_path), "*")).first()
    assert row["length"] == (2 << 30) + 1 and row["error_code"] is None and len(row["sha256"]) == 64


def test_files_appear_once(spark, tmp_path):
    root = str(tmp_path / "out")
    parts = [(f"d{k % 3}/f{k % 7}", k, f"part {k};") for k in range(40)]
    rows = spark.createDataFrame(parts, "name string, at int, content string").repartition(5)
    assert store.written(spark, root).count() == 0
    got = store.write_files(rows, root, order="at")
    want = {}
    for n, _, c in parts:
        want[n] = want.get(n, "") + c
    for r in got.collect():
        data = open(r["path"], "rb").read()
        assert data.decode() == want[r["name"]] and r["sha256"] == hashlib.sha256(data).hexdigest() and r["length"] == len(data)
    assert got.count() == len(want)
    with pytest.raises(FileExistsError):
        store.write_files(rows.limit(3), root, batch="1")
    with pytest.raises(Exception, match="already written"):
        store.write_files(spark.createDataFrame([("new", "x")], "name string, content string"), root, batch="0")
    store.write_files(spark.createDataFrame([("new", "x"), ("none", None)], "name string, content string"), root, batch="1")
    assert store.written(spark, root).count() == len(want) + 2
    assert store.write_files(rows.limit(0), root, order="at", batch="2").count() == 0
    with pytest.raises(Exception, match="not the name"):
        store.write_files(spark.createDataFrame([("../x", "x")], "name string, content string"), root, batch="3")
    assert store.written(spark, root).where("batch = '3'").count() == 0


def test_only_counted_attempts_are_read(tmp_path):
    """A task that ran twice, and a straggler: the manifest names one attempt of each."""
    root = str(tmp_path)
    w = store.FileWriter(root, "0", ["name", "content"])
    batch = pa.RecordBatch.from_pydict({"name": ["a", "a", "b"], "content": [b"1", b"2", b"3"]})
    first, second = w.write(iter([batch])), w.write(iter([batch]))
    assert store.FileReader(root).partitions() == [store.Attempt("", "")]
    w.commit([second, None])
    listed = [r for p in store.FileReader(root).partitions() for r in store.FileReader(root).read(p)]
    assert [(r[0], r[2]) for r in listed] == [("a", 2), ("b", 1)] and all(r[1].startswith(second.attempt) for r in listed)
    assert not os.path.exists(first.attempt)
    with pytest.raises(FileExistsError):
        store.FileWriter(root, "0", ["name", "content"])
    late = store.FileWriter(root, "1", ["name", "content"])
    open(late.manifest, "w").close()
    with pytest.raises(FileExistsError):  # another job was faster
        late.commit([late.write(iter([batch]))])
    late.abort([])
    assert not os.listdir(f"{root}/data/{late.job}")


def test_failed_tasks_and_jobs(tmp_path):
    """A real job whose tasks fail once and are run again, and one that fails for good."""
    script = textwrap.dedent("""
        import os, sys
        from pyspark import TaskContext
        from pyspark.sql import SparkSession
        from sonarlake.sources import store
        spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "3").getOrCreate()
        def fails(times):
            def work(batches):
                for b in batches:
                    yield b
                    if TaskContext.get().attemptNumber() < times:
                        raise RuntimeError("lost")
            return work
        rows = spark.range(60).selectExpr("concat('f', id % 9) AS name", "cast(concat(id, ';') AS binary) AS content")
        store.written(spark, sys.argv[1])
        for batch, times in (("once", 1), ("never", 9)):
            dealt = rows.selectExpr(f"concat('{batch}/', name) AS name", "content").repartition("name").sortWithinPartitions("name")
            try:
                dealt.mapInArrow(fails(times), dealt.schema).write.format(store.FORMAT).option("batch", batch).mode("append").save(sys.argv[1])
            except Exception as e:
                print("FAILED", batch)
        out = store.written(spark, sys.argv[1])
        print("FOUND", out.count(), out.selectExpr("sum(length)").first()[0], out.selectExpr("max(batch)").first()[0])
    """)
    root = str(tmp_path / "out")
    run = subprocess.run([sys.executable, "-c", script, root], capture_output=True, text=True, timeout=240, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    lines = [x for x in run.stdout.splitlines() if x.startswith(("FAILED", "FOUND"))]
    assert lines == ["FAILED never", f"FOUND 9 {sum(len(f'{k};') for k in range(60))} once"], run.stderr[-2000:]
    # A task that is still running when its job is given up may leave a folder; no manifest names it.
    assert os.listdir(f"{root}/manifests") == ["once.json"]
