"""Clips in parts against whole clips."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonarlake.functions import partial, signal
from sonarlake.plans import workflows
from sonarlake.sources import clips, readers, store


def odd_clips(rng, n):
    """Silence at ends and inside, NaN, infinities, single samples."""
    out = [[], [0.0], [0.5], [0.0] * 40, [1.0] * 3, [float("nan"), 0.2], [0.1, float("inf"), -0.1, 0.0]]
    for _ in range(n):
        a = []
        for _ in range(rng.randrange(1, 6)):
            a += [rng.choice([0.0, 0.0005, 0.00005])] * rng.randrange(0, 12) if rng.random() < 0.5 else [rng.uniform(-1, 1) for _ in range(rng.randrange(0, 9))]
        out.append(a)
    return out


def test_random_cuts_give_the_whole(spark, monkeypatch):
    monkeypatch.setattr(partial, "FAN", 3)
    rng = random.Random(1)
    whole, cut = [], []
    for k, a in enumerate(odd_clips(rng, 120)):
        whole.append((k, a))
        at = sorted({0, len(a), *(rng.randrange(0, len(a) + 1) for _ in range(rng.randrange(0, 14)))})
        pieces = [a[i:j] for i, j in zip(at, at[1:], strict=False)] or [a]
        if rng.random() < 0.3:
            pieces.insert(rng.randrange(len(pieces) + 1), [])
        cut += [(k, i, p) for i, p in enumerate(pieces)]
    rng.shuffle(cut)
    want = {r["k"]: r["s"] for r in spark.createDataFrame(whole, "k int, a array<float>").select("k", signal.stats(F.col("a"), F.lit(100)).alias("s")).collect()}
    parts = spark.createDataFrame(cut, "k int, chunk int, samples array<float>").withColumn("sample_rate", F.lit(100))
    got = {r["k"]: r["stats"] for r in partial.clip_stats(parts, ["k"]).collect()}
    assert got.keys() == want.keys()
    same = lambda x, y: x == y or (isinstance(x, float) and (math.isnan(x) and math.isnan(y) or x == pytest.approx(y, rel=1e-9, abs=1e-12)))
    for k, s in want.items():
        for name, value in s.asDict(recursive=True).items():
            mine = got[k].asDict(recursive=True)[name]
            pairs = zip(value.values(), mine.values(), strict=True) if isinstance(value, dict) else [(value, mine)]
            assert all(same(x, y) for x, y in pairs), (k, name, value, mine)


def wav(code, bits, channels, rate, body, extra=b"", size=None, tag=b"RIFF"):
    form = struct.pack("<HHIIHH", code, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    return tag + struct.pack("<I4s", 36 + len(body), b"WAVE") + extra + struct.pack("<4sI", b"fmt ", 16) + form + struct.pack("<4sI", b"data", len(body) if size is None else size) + body


def test_files_in_ranges_equal_whole_files(spark, tmp_path):
    rng = np.random.default_rng(2)
    bodies = {
        "a16": wav(1, 16, 2, 48000, (rng.uniform(-1, 1, 2000) * 32767).astype("<i2").tobytes()), "b24": wav(1, 24, 1, 48000, rng.bytes(3 * 777)), "c32": wav(1, 32, 3, 44100, rng.bytes(12 * 50)),
        "f32": wav(3, 32, 1, 48000, rng.uniform(-1, 1, 1001).astype("<f4").tobytes(), extra=struct.pack("<4sI", b"LIST", 5) + b"12345\0"), "none": wav(1, 16, 1, 48000, b""),
        "open": wav(1, 16, 1, 48000, rng.bytes(500), size=0xFFFFFFFF), "bad": b"RIFFxxxxWAVE", "odd": wav(1, 8, 1, 8000, b"123"), "text": b"no sound",
    }
    for n, data in bodies.items():
        (tmp_path / f"{n}.wav").write_bytes(data)
    found = readers.files(spark, str(tmp_path))
    stem = lambda p: p.rpartition("/")[2].partition(".")[0]
    whole = {stem(r["path"]): r for r in workflows.inspect_qc(readers.waveforms(spark, str(tmp_path))).collect()}
    for frames in (64, 1 << 20):
        got = {stem(r["path"]): r for r in workflows.inspect_chunks(clips.chunks(found, frames=frames)).collect()}
        assert got.keys() == whole.keys() == bodies.keys()
        for n, r in got.items():
            assert r["error_code"] == whole[n]["error_code"], n
            if n == "open":  # the whole-file reader believes no such size either
                assert r["stats"]["frames"] == 250
            if r["error_code"] is None:
                a, b = r["stats"].asDict(True), whole[n]["stats"].asDict(True)
                assert a == {k: pytest.approx(v, rel=1e-6) if isinstance(v, (float, dict)) else v for k, v in b.items()}, n
                assert r["qc"] == whole[n]["qc"]
    missing = clips.chunks(spark.createDataFrame([(str(tmp_path / "no.wav"),)], "path string")).first()
    assert missing["error_code"] == "file_unreadable" and missing["chunk"] is None


def test_long_file_without_its_samples_in_memory(spark, tmp_path):
    """RF64: more bytes than RIFF can tell, as a sparse file; ranges are read where they are."""
    frames = (1 << 31) // 3 + 1_500_000_000 // 3 * 2
    path = tmp_path / "long.wav"
    head = clips.wav_header(frames, 48000)
    with open(path, "wb") as f:
        f.write(head)
        f.seek(len(head) + 3 * (frames - 1))
        f.write(clips.pcm24([0.5]))
    h = clips.header(str(path))
    assert head[:4] == b"RF64" and h["frames"] == frames and h["offset"] == len(head) and h["error_code"] is None
    last = b"".join(store.blocks(str(path), h["offset"] + 3 * (frames - 4), 12))
    assert readers.decode_pcm(last, 1, 24, 1)[:, 0].tolist() == pytest.approx([0, 0, 0, 0.5])


def test_chunks_to_files_and_back(spark, tmp_path):
    rng = random.Random(3)
    whole = {f"take/{k}.wav": [rng.uniform(-0.9, 0.9) for _ in range(rng.randrange(0, 300))] for k in range(6)}
    rows = [(n, c, a[c * 50 : c * 50 + 50]) for n, a in whole.items() for c in range(max(1, -(-len(a) // 50)))]
    rng.shuffle(rows)
    chunked = spark.createDataFrame(rows, "name string, chunk int, samples array<double>").repartition(4)
    listed = store.write_files(clips.parts(chunked, "name"), str(tmp_path / "out"), order="part")
    for r in listed.collect():
        back = readers.decode_wav(open(r["path"], "rb").read())
        assert back["subtype"] == "PCM_24" and back["samples"] == pytest.approx(whole[r["name"]], abs=2e-7) and r["length"] % 2 == 0
    assert listed.count() == len(whole)
