"""Sources: explicit schemas, and readers that return DataFrames."""

from __future__ import annotations

import io
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonarlake import ship

S, D, L, B = T.StringType(), T.DoubleType(), T.LongType(), T.BooleanType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


LEXICON_ENTRY = _struct(spoken=S, expected=S, pinyin=S, note=S)
NORMALIZATION = _struct(original=S, normalized=S, profile=S, version=S, warnings=T.ArrayType(S), changed=B)
PREPARATION = _struct(text_original=S, text_normalized=S, text_spoken=S, text_expected=S, normalization=NORMALIZATION)
OPTIONS = {"seed": L, "inference_timesteps": L, "cfg_value": D, "warmup_patches": L, "max_tokens": L, "candidates": L, "profile": S, "normalization_profile": S,
           "project_lexicon": T.MapType(S, LEXICON_ENTRY), "episode_lexicon": T.MapType(S, LEXICON_ENTRY)}
LINE = _struct(id=S, character_id=S, style=S, text=S, mode=S, instruct=S, emotion=S, seed=L, preparation=PREPARATION)
BATCH = _struct(**OPTIONS, project=S, lines=T.ArrayType(LINE))
STYLE = _struct(reference=S, transcript=S, reference_sha256=S, transcript_text=S)
VOICE = _struct(id=S, name=S, language=S, description=S, default_style=S, styles=T.MapType(S, STYLE), provenance=S, source=S, commercial_use=B, created_at=S, tags=T.ArrayType(S), model_repo=S, model_revision=S)
CASES = _struct(cases=T.ArrayType(_struct(id=S, emotion=S, text=S)))
MANIFEST = _struct(project=S, revision=S, fingerprint=S, status=S, lines=T.ArrayType(_struct(id=S, selection=_struct(recommended_candidate=L, recommended_output=S))))
CANDIDATE = _struct(output=S, audio_sha256=S, mode=S, text=S, model_revision=S, generation_seconds=D, audio_duration=D, qc=_struct(status=S), transcript_qc=_struct(status=S, cer=D))
EVENT = _struct(event=S, time=S, properties=T.MapType(S, S))
STATS_FIELDS = _struct(sample_rate=T.IntegerType(), channels=T.IntegerType(), subtype=S, samples=T.ArrayType(T.FloatType()), peak_all=D, error_code=S)


def _json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def file_path() -> Column:
    """The path of a row's file as ``files`` has it: not encoded, and local ones with one slash."""
    return F.regexp_replace(F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/")


def batch_lines(spark: SparkSession, path: str) -> DataFrame:
    """Requests by line, with the position that gives their order."""
    return _json(spark, path, BATCH).select("*", F.posexplode("lines").alias("pos", "line")).drop("lines")


def voices(spark: SparkSession, root: str) -> DataFrame:
    return _json(spark, f"{root}/*/voice.json", VOICE)


def voice(catalogue: DataFrame, id: str) -> DataFrame:
    return catalogue.where(F.col("id") == id)


def long_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).withColumn("path", file_path())


def files(spark: SparkSession, root: str, pattern: str = "*.wav") -> DataFrame:
    """Paths and sizes below a folder; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return found.select("path", "length")


def contents(spark: SparkSession, root: str, pattern: str = "*.wav") -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "length", "content")


def whole_text(spark: SparkSession, path: str) -> DataFrame:
    """One row of ``json`` for each file."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "json")


def receipts(spark: SparkSession, folder: str) -> DataFrame:
    """Download receipts (path, revision, etag): a file of two lines beside each artifact's name."""
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.metadata").text(folder, wholetext=True).withColumn("_p", file_path())
    lines = F.split("value", r"\r?\n")
    name = F.regexp_extract("_p", "/" + re.escape(folder.rstrip("/").rpartition("/")[2]) + r"/(.*)\.metadata$", 1)
    return found.select(name.alias("path"), F.get(lines, F.lit(0)).alias("revision"), F.get(lines, F.lit(1)).alias("etag"))


def total_bytes(found: DataFrame) -> DataFrame:
    return found.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.count("*").alias("files"))


def stem(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", "")


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """Lines of all manifests with their revision's number, by which callers sort where they need to; numbers go on above 9999."""
    rows = _json(spark, f"{root}/run_*/manifest.json", MANIFEST).withColumn("path", file_path())
    numbered = rows.withColumn("revision_number", F.regexp_extract("path", r"run_(\d+)/", 1).cast("int"))
    return numbered.select("*", F.posexplode_outer("lines").alias("pos", "line")).drop("lines")


def candidates(spark: SparkSession, root: str) -> DataFrame:
    rows = spark.read.schema(CANDIDATE).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(root)
    return rows.withColumn("stem", stem(file_path()))


def benchmark_cases(spark: SparkSession, path: str, only: list[str] | None = None) -> DataFrame:
    rows = _json(spark, path, CASES).select(F.explode("cases").alias("c")).select("c.*")
    return rows.where(F.col("id").isin(only)) if only else rows


def events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENT).json(path)


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """A lexicon file as rows. An entry may be a bare string or an object; both become the same columns."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("term", "raw"))
    entry = F.when(F.col("raw").startswith("{"), F.from_json("raw", LEXICON_ENTRY))
    return raw.select("term", F.coalesce(entry["spoken"], F.when(entry.isNull(), F.col("raw"))).alias("spoken"), entry["expected"].alias("expected"), entry["pinyin"].alias("pinyin"))


#: Formats (code, bits) that are decoded.
SUBTYPES = {(1, 16): "PCM_16", (1, 24): "PCM_24", (1, 32): "PCM_32", (3, 32): "FLOAT", (3, 64): "DOUBLE"}


def decode_pcm(body: bytes, code: int, bits: int, channels: int) -> np.ndarray:
    """Frames by channels."""
    if code == 3:
        x = np.frombuffer(body, f"<f{bits // 8}").astype(np.float32)
    elif bits == 24:
        wide = np.zeros((len(body) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(body, np.uint8).reshape(-1, 3)
        x = (wide.view("<i4").ravel() / 2.0**31).astype(np.float32)
    else:
        x = (np.frombuffer(body, f"<i{bits // 8}") / 2.0 ** (bits - 1)).astype(np.float32)
    return x.reshape(-1, channels)


def decode_wav(data: bytes) -> dict:
    """Samples of a PCM or float WAV file, mixed to mono."""
    bad = {"sample_rate": None, "channels": None, "subtype": None, "samples": None, "peak_all": None, "error_code": "audio_invalid"}
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return bad
    file, form, body = io.BytesIO(data[12:]), None, None
    while len(head := file.read(8)) == 8:
        name, size = struct.unpack("<4sI", head)
        chunk = file.read(size + size % 2)[:size]
        form, body = (chunk, body) if name == b"fmt " else (form, chunk) if name == b"data" else (form, body)
    if form is None or body is None or len(form) < 16:
        return bad
    code, channels, rate, _, _, bits = struct.unpack("<HHIIHH", form[:16])
    if code == 0xFFFE and len(form) >= 26:
        code = struct.unpack("<H", form[24:26])[0]
    if not channels or (code, bits) not in SUBTYPES:
        return bad
    step = bits // 8 * channels
    x = decode_pcm(body[: len(body) // step * step], code, bits, channels)
    return {"sample_rate": rate, "channels": channels, "subtype": SUBTYPES[code, bits], "samples": x.mean(axis=1).tolist(), "peak_all": float(np.abs(x).max()) if x.size else 0.0, "error_code": None}


def waveforms(spark: SparkSession, root: str, pattern: str = "*.wav") -> DataFrame:
    """path, sha256 and decoded samples of each file; a file that can't be decoded carries an error."""
    found = contents(spark, root, pattern).select("path", "length", F.sha2("content", 256).alias("sha256"), "content")

    def decode(batches):
        for b in batches:
            rows = [decode_wav(c) for c in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_struct_array(pa.array([dict(zip(("path", "length", "sha256"), v, strict=True)) | r for v, r in zip(zip(*(b.column(k).to_pylist() for k in range(3)), strict=True), rows, strict=True)], pa.struct([
                ("path", pa.string()), ("length", pa.int64()), ("sha256", pa.string()), ("sample_rate", pa.int32()), ("channels", pa.int32()), ("subtype", pa.string()),
                ("samples", pa.list_(pa.float32())), ("peak_all", pa.float64()), ("error_code", pa.string())])))

    ship(spark)
    return found.mapInArrow(decode, T.StructType([T.StructField("path", S), T.StructField("length", L), T.StructField("sha256", S), *STATS_FIELDS.fields]))
