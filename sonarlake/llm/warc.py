"""WARC archives of gzip members: a writer, and a reader that splits archives at any byte.

Writer: each task writes its records to archives of its own, one gzip member per record, under names that
hold the number of the attempt. An attempt's archives are never replaced: only those that a finished
attempt lists are read, and ``round_trip`` keeps that list in a checkpoint, so a task that runs again
after an executor was lost can't change what a reader sees. Of records with equal payloads of at least ``min_payload`` bytes the one with the largest id is a response, and the
others are revisits that name it and carry no payload.

Reader: archives are cut into byte ranges, one task item each. A task looks for the gzip magic in its
range, and takes a candidate for a member only if its start inflates to a WARC version line; it owns the
records that start inside its range and reads on past the end of the range to finish the last.

Archives go through ``pyarrow.fs`` to the session's shared folder, which may be any store it knows.

Defined cases: a null payload is an empty one. A null URL gives no Target-URI. Rows with a null id are
responses to themselves, and never referred to. Rows that repeat an id and payload are each written with
the same type. Equal payloads of equal ids are all responses (a tie has no later one to name). A very long
payload is held by one task at a time, and compressed as one member that a range's owner reads to its end.
An empty table gives no archive and no row. Columns but id, URL and payload are not read. Ids are longs;
text that is no number stops the query with Spark's cast error.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonarlake.llm.session import checkpointed, fresh_dir, map_slices

MAGIC = b"\x1f\x8b\x08"
#: Bytes of an archive before the writer starts another, of a range, and of one read.
ARCHIVE_BYTES, RANGE_BYTES, READ_BYTES = 64 << 20, 4 << 20, 1 << 20
#: Fixed values of the format.
VERSION = b"WARC/1."
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "path string, offset long, record_type string, record_id string, url string, refers_to string, payload_digest string, payload_bytes long, payload binary"
_DATE = "2024-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(id: object, url: str | None, payload: bytes, refers_to: object = None) -> bytes:
    """One uncompressed record; a revisit where refers_to is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{id}>", f"WARC-Date: {_DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > "\x20" and c != "\x7f" else f"%{ord(c):02X}" for c in url))
    head.append(f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:x-page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse(data: bytes) -> dict:
    """Fields of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
    kind = fields["WARC-Type"]
    digest = fields.get("WARC-Payload-Digest", "").removeprefix("sha1:")
    if kind == "response" and digest and base32_sha1(payload) != digest:
        raise ValueError(f"payload of {fields.get('WARC-Record-ID')} doesn't have its digest")
    return {
        "record_type": kind, "record_id": fields.get("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "refers_to": fields.get("WARC-Refers-To"),
        "payload_digest": digest or base32_sha1(payload), "payload_bytes": length, "payload": payload if kind == "response" else None,
    }


def read_range(file, start: int, end: int, size: int, read_bytes: int = READ_BYTES):
    """(offset, record bytes) of the records that start in [start, end)."""
    held, base = b"", start  # bytes from ``base`` on

    def more() -> bool:
        nonlocal held
        at = base + len(held)
        got = file.read_at(min(read_bytes, size - at), at) if at < size else b""
        held += got
        return bool(got)

    at = start
    while at < end:
        found = held.find(MAGIC, at - base)
        if found < 0:
            at = max(at, base + len(held) - len(MAGIC) + 1)
            held, base = held[at - base :], at
            if not more():
                return
            continue
        at = base + found
        if at >= end:
            return
        held, base = held[found:], at
        z, out, fed = zlib.decompressobj(31), bytearray(), 0
        try:
            while not z.eof:
                if fed == len(held) and not more():
                    break
                out += z.decompress(held[fed:])
                fed = len(held)
                if len(out) >= len(VERSION) and not out.startswith(VERSION):
                    break
        except zlib.error:
            pass
        if z.eof and out.startswith(VERSION):
            yield at, bytes(out)
            at += fed - len(z.unused_data)
        else:
            at += 1


def write_archives(pages: DataFrame, folder: str, id: str = "page_id", url: str = "url", payload: str = "html", min_payload: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the archives when it is run; one row (path, bytes, records) for each."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(id).cast("long").alias("id"), F.col(url).cast("string").alias("url"), body.alias("payload"))
    key = F.when(F.octet_length("payload") >= min_payload, F.sha2("payload", 256))
    # Only payloads that two rows share meet the pages again.
    shared = (
        pages.select(F.col(id).cast("long").alias("id"), body.alias("payload")).select("id", key.alias("k")).where("k IS NOT NULL AND id IS NOT NULL")
        .groupBy("k").agg(F.max("id").alias("first"), F.min("id").alias("least")).where("first <> least").select("k", "first")
    )
    joined = rows.withColumn("_k", key).join(shared, F.col("_k") == F.col("k"), "left")
    typed = joined.select("id", "url", "payload", F.when(F.col("first") != F.col("id"), F.col("first")).alias("refers_to"))

    def work(batches):
        fs, top = pyarrow.fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        fs.create_dir(top, recursive=True)
        out = path = None
        seq = size = n = 0

        def close():
            nonlocal out, seq
            out.close()
            out, seq = None, seq + 1
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], ["path", "bytes", "records"])

        for b in batches:
            for i, u, p, r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    path = f"{top}/part-{part:06d}-{seq:04d}-{attempt}.warc.gz"
                    out, size, n = fs.open_output_stream(path, compression=None), 0, 0
                data = member(record(i, u, p, r))
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= archive_bytes:
                    yield close()
        if out is not None:
            yield close()

    return map_slices(typed, work, "path string, bytes long, records long")


def read_archives(archives: DataFrame, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of archives given as (path, bytes); ``folder`` is a URI of their store."""
    spark = archives.sparkSession
    ranges = archives.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))).alias("start"))
    ranges = ranges.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "start")
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def work(batches):
        fs, _ = pyarrow.fs.FileSystem.from_uri(folder)
        rows, held = [], 0

        def emit():
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)

        for b in batches:
            for path, size, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with fs.open_input_file(path) as file:
                    for offset, data in read_range(file, start, min(start + range_bytes, size), size):
                        rows.append({"path": path, "offset": offset, **parse(data)})
                        held += len(data)
                        if held > 8 << 20 or len(rows) >= 1000:
                            yield emit()
                            rows, held = [], 0
        yield emit()

    return map_slices(ranges, work, RECORDS)


def round_trip(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Writes pages to archives and reads back those that the finished attempts list."""
    folder = folder or fresh_dir(pages.sparkSession, "warc")
    return read_archives(checkpointed(write_archives(pages, folder, **options)), folder)
