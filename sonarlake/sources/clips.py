"""WAV files in frame ranges: a file is as many tasks as its length asks for, and no row holds more than a chunk.

``headers`` walks the chunks of a file without reading its samples; ``chunks`` cuts the samples into ranges of frames, and
each task item reads the bytes of one range. RIFF, and RF64 for files of over 4 GB, with PCM of 16, 24 and 32 bits and
floats. Statistics over the chunks of a clip are in ``functions.partial``; ``parts`` goes the way back, from chunks of
samples to the parts of a PCM_24 file for ``store.write_files``.

Defined cases: what is no WAV file, or can't be read, is one row with an error_code and no chunk. A file without frames is
one empty chunk. A size that the header doesn't know (none, or as large as it goes) reaches to the file's end, and so does
one beyond it. Frames that are cut off at the end don't count.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonarlake import ship
from sonarlake.functions.signal import TARGET_RATE
from sonarlake.sources import store
from sonarlake.sources.readers import SUBTYPES, decode_pcm

#: Frames of a chunk.
FRAMES = 1 << 20
HEADER = "path string, sample_rate int, channels int, code int, bits int, offset long, frames long, error_code string"
_UNKNOWN = 0xFFFFFFFF
#: Bytes that a RIFF header can tell; a longer file takes RF64.
_RIFF_LIMIT = _UNKNOWN - 1024


def header(path: str) -> dict:
    """Where a file's samples are, and what they are."""
    bad = {"path": path, "error_code": "audio_invalid"}
    try:
        fs, inner = store.opened(path)
        with fs.open_input_file(inner) as file:
            size, head = file.size(), file.read(12)
            if len(head) < 12 or head[:4] not in (b"RIFF", b"RF64") or head[8:] != b"WAVE":
                return bad
            at, form, wide, body = 12, None, None, None
            while at + 8 <= size and body is None:
                file.seek(at)
                name, length = struct.unpack("<4sI", file.read(8))
                at += 8
                if name == b"data":
                    length = wide if wide is not None and length == _UNKNOWN else length
                    body = (at, size - at if length in (0, _UNKNOWN) else min(length, size - at))
                elif name in (b"fmt ", b"ds64"):
                    found = file.read(min(length, 64))
                    if name == b"fmt ":
                        form = found
                    elif len(found) >= 16:
                        wide = struct.unpack("<Q", found[8:16])[0]
                at += length + length % 2
    except OSError:
        return {"path": path, "error_code": "file_unreadable"}
    if form is None or body is None or len(form) < 16:
        return bad
    code, channels, rate, _, _, bits = struct.unpack("<HHIIHH", form[:16])
    if code == 0xFFFE and len(form) >= 26:
        code = struct.unpack("<H", form[24:26])[0]
    if not channels or (code, bits) not in SUBTYPES:
        return bad
    return {"path": path, "sample_rate": rate, "channels": channels, "code": code, "bits": bits, "offset": body[0], "frames": body[1] // (bits // 8 * channels), "error_code": None}


_HEADER_TYPE = pa.schema([("path", pa.string()), ("sample_rate", pa.int32()), ("channels", pa.int32()), ("code", pa.int32()), ("bits", pa.int32()), ("offset", pa.int64()), ("frames", pa.int64()), ("error_code", pa.string())])
CHUNK = T.StructType([T.StructField("path", T.StringType()), T.StructField("chunk", T.LongType()), T.StructField("start", T.LongType()), T.StructField("samples", T.ArrayType(T.FloatType())),
                      T.StructField("peak_all", T.DoubleType()), T.StructField("sample_rate", T.IntegerType()), T.StructField("channels", T.IntegerType()), T.StructField("subtype", T.StringType()),
                      T.StructField("frames", T.LongType()), T.StructField("error_code", T.StringType())])


def headers(files: DataFrame, path: str = "path") -> DataFrame:
    def work(batches):
        for b in batches:
            yield pa.RecordBatch.from_pylist([{c: None for c in _HEADER_TYPE.names} | header(p) for p in b.column(0).to_pylist()], _HEADER_TYPE)

    ship(files.sparkSession)
    return files.select(F.col(path).cast("string")).mapInArrow(work, HEADER)


def chunks(files: DataFrame, path: str = "path", frames: int = FRAMES) -> DataFrame:
    """One row per range of frames: path, chunk, start, mono samples, peak_all (of every channel), and the clip's facts."""
    known = headers(files, path)
    last = F.greatest(F.coalesce(F.col("frames"), F.lit(0)) - 1, F.lit(0))
    ranges = known.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(frames).cast("long"))))
    dealt = ranges.select("path", F.floor(F.col("start") / frames).alias("chunk"), "start", "sample_rate", "channels", "code", "bits", "offset", "frames", "error_code").repartition("path", "start")

    def work(batches):
        for b in batches:
            for r in b.to_pylist():
                out = {"path": r["path"], "chunk": None, "error_code": r["error_code"]}
                if not r["error_code"]:
                    step = r["bits"] // 8 * r["channels"]
                    body = b"".join(store.blocks(r["path"], r["offset"] + r["start"] * step, min(frames, r["frames"] - r["start"]) * step))
                    x = decode_pcm(body[: len(body) // step * step], r["code"], r["bits"], r["channels"])
                    out |= {"chunk": r["chunk"], "start": r["start"], "samples": x.mean(axis=1).astype(np.float32), "peak_all": float(np.abs(x).max()) if x.size else 0.0, "sample_rate": r["sample_rate"],
                            "channels": r["channels"], "subtype": SUBTYPES[r["code"], r["bits"]], "frames": r["frames"]}
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.float32()), pa.float64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([out.get(f.name)], k) for f, k in zip(CHUNK.fields, kinds, strict=True)], CHUNK.names)

    return dealt.mapInArrow(work, CHUNK)


def pcm24(samples) -> bytes:
    """Samples as PCM_24, without a header."""
    x = np.round(np.asarray(samples, np.float64) * (2**23 - 1)).astype("<i4")
    return x.view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def wav_header(frames: int, rate: int) -> bytes:
    """The header of a mono PCM_24 file; RF64 where RIFF can't tell the length."""
    size = frames * 3
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate * 3, 3, 24)
    if size <= _RIFF_LIMIT:
        return struct.pack("<4sI4s", b"RIFF", 36 + size, b"WAVE") + form + struct.pack("<4sI", b"data", size)
    wide = struct.pack("<4sIQQQI", b"ds64", 28, 72 + size, size, frames, 0)
    return struct.pack("<4sI4s", b"RF64", _UNKNOWN, b"WAVE") + wide + form + struct.pack("<4sI", b"data", _UNKNOWN)


def parts(chunks: DataFrame, name: str, part: str = "chunk", samples: str = "samples", rate: int = TARGET_RATE) -> DataFrame:
    """Rows (name, part, content) of PCM_24 files, one for each chunk and one for each header: what ``store.write_files`` takes, by ``part``.

    Samples have passed the write gate (``signal.writable``).
    """
    names = ["name", "part", "content"]

    def encode(batches):
        for b in batches:
            at, flat = b.column(2).offsets.to_pylist(), np.asarray(b.column(2).values)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([pcm24(flat[i:j]) for i, j in zip(at, at[1:], strict=False)], pa.binary())], names)

    def head(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([-1] * b.num_rows, pa.int64()), pa.array([wav_header(n, rate) for n in b.column(1).to_pylist()], pa.binary())], names)

    ship(chunks.sparkSession)
    rows = chunks.select(F.col(name).cast("string").alias("name"), F.col(part).cast("long").alias("part"), F.coalesce(F.col(samples).cast("array<double>"), F.array().cast("array<double>")).alias("a"))
    sizes = chunks.groupBy(F.col(name).cast("string").alias("name")).agg(F.sum(F.coalesce(F.size(samples), F.lit(0))).alias("frames"))
    schema = "name string, part long, content binary"
    pad = sizes.where("frames % 2 = 1").select("name", F.lit((1 << 63) - 1).alias("part"), F.unhex(F.lit("00")).alias("content"))
    return rows.mapInArrow(encode, schema).unionByName(sizes.mapInArrow(head, schema)).unionByName(pad)
