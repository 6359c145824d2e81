"""Files beside tables: where a path leads, digests in blocks, and a sink whose files appear all at once and only once.

``digests`` streams each file through a task in blocks, so a file of any size is hashed in the memory of one block; no row
ever holds a content. Listing is Spark's, reading is that of ``pyarrow.fs``, which knows the usual stores.

The format ``sonarlake_files`` writes rows (name, content) to files; rows of a name that follow each other are parts of one
file. Each attempt of a task writes below a folder of its own and lists its files with their hashes. When all tasks are
through, the driver writes one manifest that names the attempts that count; only what it names is ever read. A failed job,
a repeated task or a straggler thus leaves nothing visible, and a batch that has a manifest is refused. ``write_files`` also
refuses a name that an earlier batch has, and deals each name to one task, in order.
"""

from __future__ import annotations

import errno
import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from sonarlake import ship

#: Bytes that are read, hashed or copied at once.
BLOCK = 1 << 20
FORMAT = "sonarlake_files"
DIGESTS = "path string, length long, sha256 string, blob_sha1 string, error_code string"


def opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The store of a path, and the path there; a path without a scheme is local."""
    if path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), re.sub("^file:/+", "/", path)
    if "://" in path:
        return pyarrow.fs.FileSystem.from_uri(path)
    return pyarrow.fs.LocalFileSystem(), os.path.abspath(path)


def blocks(path: str, start: int = 0, length: int | None = None, block: int = BLOCK) -> Iterator[bytes]:
    """A file's bytes from ``start``, a block at a time."""
    fs, inner = opened(path)
    with fs.open_input_file(inner) as file:
        file.seek(start)
        while length is None or length > 0:
            got = file.read(block if length is None else min(block, length))
            if not got:
                return
            length = None if length is None else length - len(got)
            yield got


def digest(path: str, length: int | None = None, block: int = BLOCK) -> tuple[int | None, str | None, str | None, str | None]:
    """Length, SHA-256, the SHA-1 of the blob with its header, and an error (a file that isn't there, or hasn't the given length)."""
    try:
        fs, inner = opened(path)
        expected = fs.get_file_info(inner).size if length is None else length
        sha256, blob, seen = hashlib.sha256(), hashlib.sha1(b"blob %d\0" % (expected or 0)), 0
        for got in blocks(path, block=block):
            sha256.update(got)
            blob.update(got)
            seen += len(got)
    except OSError:
        return length, None, None, "file_unreadable"
    if seen != expected:
        return length, None, None, "file_changed"
    return seen, sha256.hexdigest(), blob.hexdigest(), None


def digests(files: DataFrame, path: str = "path", length: str | None = "length") -> DataFrame:
    """Files with their hashes; each is one task item, however long it is. Without a length column a file may have any."""

    def work(batches):
        for b in batches:
            for p, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                yield pa.RecordBatch.from_pylist([dict(zip(("path", "length", "sha256", "blob_sha1", "error_code"), (p, *digest(p, n)), strict=True))], pa.schema([
                    ("path", pa.string()), ("length", pa.int64()), *((c, pa.string()) for c in ("sha256", "blob_sha1", "error_code"))]))

    ship(files.sparkSession)
    named = files.select(F.col(path).alias("path"), (F.lit(None) if length is None else F.col(length)).cast("long").alias("length"))
    return named.repartition("path").mapInArrow(work, DIGESTS)


@dataclass
class Written(WriterCommitMessage):
    """What a finished attempt says: its folder, and how much it wrote."""

    attempt: str
    files: int
    length: int


def _put(path: str, data: bytes) -> None:
    """Writes a small file that must not be there yet, whole or not at all."""
    fs, inner = opened(path)
    if fs.get_file_info(inner).type != pyarrow.fs.FileType.NotFound:
        raise FileExistsError(errno.EEXIST, "already written", path)
    waiting = f"{inner}.{uuid.uuid4().hex}"
    with fs.open_output_stream(waiting) as out:
        out.write(data)
    if isinstance(fs, pyarrow.fs.LocalFileSystem):
        os.link(waiting, inner)  # fails where a rename would replace
        os.unlink(waiting)
    else:
        fs.move(waiting, inner)


class FileWriter(DataSourceArrowWriter):
    def __init__(self, root: str, batch: str, names: list[str]):
        self.root, self.batch, self.job = root.rstrip("/"), batch, uuid.uuid4().hex
        self.at = [names.index("name"), names.index("content")]
        fs, inner = opened(self.manifest)
        if fs.get_file_info(inner).type != pyarrow.fs.FileType.NotFound:
            raise FileExistsError(errno.EEXIST, "the batch is already written", self.manifest)

    @property
    def manifest(self) -> str:
        return f"{self.root}/manifests/{self.batch}.json"

    def write(self, iterator) -> Written:
        attempt = f"{self.root}/data/{self.job}/{uuid.uuid4().hex}"
        fs, folder = opened(attempt)
        fs.create_dir(folder, recursive=True)
        out = name = None
        done, total = {}, 0
        receipts = fs.open_output_stream(f"{folder}/receipts.jsonl", compression=None)

        def close():
            out.close()
            receipts.write((json.dumps({"name": name, "path": f"{attempt}/files/{name}", "length": size, "sha256": sha.hexdigest()}) + "\n").encode())

        for b in iterator:
            for n, content in zip(*(b.column(k).to_pylist() for k in self.at), strict=True):
                if n != name:
                    if out is not None:
                        close()
                    if not n or any(p in ("", ".", "..") for p in n.split("/")):
                        raise ValueError(f"not the name of a file: {n!r}")
                    if n in done:
                        raise FileExistsError(errno.EEXIST, "the parts of a file must follow each other", n)
                    done[n], name, size, sha = None, n, 0, hashlib.sha256()
                    fs.create_dir(f"{folder}/files/{n}".rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(f"{folder}/files/{n}", compression=None)
                out.write(content or b"")
                sha.update(content or b"")
                size, total = size + len(content or b""), total + len(content or b"")
        if out is not None:
            close()
        receipts.close()
        return Written(attempt, len(done), total)

    def _clear(self, keep: set[str]) -> None:
        fs, top = opened(f"{self.root}/data/{self.job}")
        if fs.get_file_info(top).type == pyarrow.fs.FileType.Directory:
            for found in fs.get_file_info(pyarrow.fs.FileSelector(top)):
                if found.base_name not in keep:
                    fs.delete_dir(found.path)

    def commit(self, messages) -> None:
        counted = [m for m in messages if m]
        fs, folder = opened(f"{self.root}/manifests")
        fs.create_dir(folder, recursive=True)
        body = {"batch": self.batch, "attempts": sorted(m.attempt for m in counted if m.files), "files": sum(m.files for m in counted), "length": sum(m.length for m in counted)}
        _put(self.manifest, json.dumps(body).encode())
        self._clear({m.attempt.rpartition("/")[2] for m in counted})

    def abort(self, messages) -> None:
        self._clear(set())


@dataclass
class Attempt(InputPartition):
    batch: str
    path: str


class FileReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root.rstrip("/")

    def partitions(self) -> list[Attempt]:
        fs, folder = opened(f"{self.root}/manifests")
        found = fs.get_file_info(pyarrow.fs.FileSelector(folder, allow_not_found=True))
        out = []
        for f in sorted(found, key=lambda f: f.path):
            if f.path.endswith(".json"):
                with fs.open_input_stream(f.path) as file:
                    body = json.loads(file.read())
                out += [Attempt(body["batch"], a) for a in body["attempts"]]
        return out or [Attempt("", "")]

    def read(self, partition: Attempt):
        if partition.path:
            fs, folder = opened(partition.path)
            with fs.open_input_stream(f"{folder}/receipts.jsonl") as file:
                for line in file.read().decode().splitlines():
                    r = json.loads(line)
                    yield r["name"], r["path"], r["length"], r["sha256"], partition.batch


class Files(DataSource):
    """Files with their names, written once; read as (name, path, length, sha256, batch)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, path string, length long, sha256 string, batch string"

    def reader(self, schema) -> FileReader:
        return FileReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> FileWriter:
        if overwrite:
            raise ValueError("files are written once; overwriting them is refused")
        return FileWriter(self.options["path"], self.options.get("batch", "0"), schema.names)


def written(spark: SparkSession, root: str) -> DataFrame:
    """The files of all finished batches: name, path, length, sha256, batch."""
    ship(spark)
    spark.dataSource.register(Files)
    return spark.read.format(FORMAT).load(root)


def finished(root: str, batch: str) -> bool:
    """Whether a batch has its manifest."""
    fs, inner = opened(f"{root.rstrip('/')}/manifests/{batch}.json")
    return fs.get_file_info(inner).type != pyarrow.fs.FileType.NotFound


def write_files(rows: DataFrame, root: str, name: str = "name", content: str = "content", order: str | None = None, batch: str = "0", fresh: bool = False) -> DataFrame:
    """Writes rows as files and returns the batch's list of them; the rows of a name are its parts, by ``order``.

    Names that differ in their ending only are one task's, so such files lie in one folder, as readers of a clip and the metadata
    beside it expect. fresh: the caller knows that no earlier batch has these names, so they aren't looked up.
    """
    spark = rows.sparkSession
    there = written(spark, root).select("name")
    named = rows.select(F.col(name).alias("name"), F.col(content).cast("binary").alias("content"), (F.lit(0) if order is None else F.col(order)).alias("_order"))
    clash = named.select("name").distinct().join(there, "name", "left_semi").first() if not fresh and there.head(1) else None
    if clash:
        raise FileExistsError(errno.EEXIST, "already written", clash["name"])
    beside = F.regexp_replace("name", r"\.[^./]*$", "")
    dealt = named.repartition(beside).sortWithinPartitions("name", "_order").select("name", "content")
    dealt.write.format(FORMAT).option("batch", batch).mode("append").save(root)
    return written(spark, root).where(F.col("batch") == batch)
