import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonarlake.functions import loudness, signal


def plain_resample(x, rate, target):
    """Every output by its own sum over all samples."""
    g = math.gcd(rate, target)
    up, down = target // g, rate // g
    top = max(up, down)
    half = 10 * top
    taps = np.sinc(np.arange(-half, half + 1) / top) * np.kaiser(2 * half + 1, 5.0)
    taps *= up / taps.sum()
    out = []
    for n in range(-(-len(x) * up // down)):
        at = n * down - np.arange(len(x)) * up + half
        good = (at >= 0) & (at <= 2 * half)
        out.append(float((x[good] * taps[at[good]]).sum()))
    return np.array(out)


@pytest.mark.parametrize("rate,target", [(44100, 48000), (96000, 48000), (24000, 48000), (48000, 44100), (8000, 48000), (11025, 48000)])
def test_filter_banks_equal_the_sum(rate, target, monkeypatch):
    x = np.random.default_rng(1).uniform(-1, 1, 700)
    want = plain_resample(x, rate, target)
    assert np.abs(signal.resampled(x, rate, target) - want).max() < 1e-12
    monkeypatch.setattr(signal, "OUTPUTS", 100)
    assert np.abs(signal.resampled(x, rate, target) - want).max() < 1e-12
    assert len(signal.resampled([], rate, target)) == 0


def test_resampled_chunks_equal_the_whole(spark):
    rng = np.random.default_rng(2)
    clips = {f"c{k}": rng.uniform(-1, 1, n) for k, n in enumerate((1000, 257, 64, 30, 1))}
    rows = [(c, i, i * 64, x[i * 64 : i * 64 + 64].tolist()) for c, x in clips.items() for i in range(-(-len(x) // 64))]
    chunks = spark.createDataFrame(rows, "clip string, chunk int, start int, samples array<double>").repartition(4)
    for rate in (44100, 96000):
        got = signal.resample_chunks(chunks, ["clip"], rate).orderBy("clip", "chunk").collect()
        for c, x in clips.items():
            mine = [r for r in got if r["clip"] == c]
            whole = signal.resampled(x, rate)
            assert np.abs(np.concatenate([r["samples"] for r in mine]) - whole).max() < 1e-9
            assert [r["start"] for r in mine] == np.cumsum([0, *(len(r["samples"]) for r in mine)])[:-1].tolist()
    assert signal.resample_chunks(chunks, ["clip"], 48000).count() == len(rows)


def sine(level, seconds, rate=48000, f=1000.0):
    return 10 ** (level / 20) * np.sin(2 * np.pi * f * np.arange(int(seconds * rate)) / rate)


def test_published_references():
    """The standard: a full-scale sine of 997 Hz is -3.01 LUFS. Gating: quiet ends don't count."""
    assert loudness.measure_clip(sine(0, 5, f=997), 48000)["lufs"] == pytest.approx(-3.01, abs=0.02)
    for rate in (48000, 44100):
        assert loudness.measure_clip(sine(-23, 20, rate), rate)["lufs"] == pytest.approx(-26.01, abs=0.1)
        assert loudness.measure_clip(sine(-33, 20, rate), rate)["lufs"] == pytest.approx(-36.01, abs=0.1)
        steps = np.concatenate([sine(-36, 10, rate), sine(-23, 60, rate), sine(-36, 10, rate)])
        assert loudness.measure_clip(steps, rate)["lufs"] == pytest.approx(-26.01, abs=0.1)
        steps = np.concatenate([sine(-72, 10, rate), sine(-36, 10, rate), sine(-23, 60, rate), sine(-36, 10, rate), sine(-72, 10, rate)])
        assert loudness.measure_clip(steps, rate)["lufs"] == pytest.approx(-26.01, abs=0.1)
    # Between samples of a quarter of the rate the wave is higher than any of them.
    quarter = np.sin(np.pi / 2 * np.arange(48000) + np.pi / 4) * 0.5
    assert loudness.measure_clip(quarter, 48000)["true_peak"] == pytest.approx(20 * math.log10(0.5), abs=0.2)
    for x in (np.zeros(48000), np.zeros(0), sine(-20, 0.3), np.array([np.nan] * 48000)):
        assert loudness.measure_clip(x, 48000)["lufs"] is None
    assert loudness.measure_clip(sine(-20, 1, 8001), 8001)["lufs"] is None


def test_weighting_is_the_recursion():
    x = np.random.default_rng(3).uniform(-1, 1, 70_000)
    whole = loudness.weighted(x, 48000)
    cut = np.concatenate([loudness.weighted(x[:30_000], 48000), loudness.weighted(x[30_000:], 48000, x[:30_000])])
    assert np.abs(cut - whole).max() < 1e-9
    assert np.abs(whole[:500] - np.convolve(x[:500], loudness.weighting(48000)[:500])[:500]).max() < 1e-9
    assert np.abs(loudness.weighting(48000)[-100:]).max() < 1e-15
    # The standard's table of coefficients: the first values of the shelf, then the pass.
    assert loudness.weighting(48000)[0] == pytest.approx(1.53512485958697, rel=1e-9)


def test_chunks_equal_whole_clips(spark):
    rng = np.random.default_rng(4)
    clips = {"a": np.concatenate([sine(-30, 1), rng.uniform(-0.3, 0.3, 60_000), np.zeros(30_000)]), "b": sine(-18, 0.9), "short": sine(-18, 0.2), "still": np.zeros(60_000)}
    clips["nan"] = clips["b"].copy()
    clips["nan"][100] = np.nan
    size = 10_000
    rows = [(c, i, i * size, x[i * size : (i + 1) * size].tolist()) for c, x in clips.items() for i in range(-(-len(x) // size))]
    random.Random(1).shuffle(rows)
    chunks = spark.createDataFrame(rows, "clip string, chunk int, start int, samples array<double>").repartition(3)
    got = {r["clip"]: (r["lufs"], r["true_peak"]) for r in loudness.clip_loudness(chunks, ["clip"], 48000).collect()}
    whole = spark.createDataFrame([(c, x.tolist()) for c, x in clips.items()], "clip string, a array<double>").select("clip", loudness.measure(F.col("a"), F.lit(48000)).alias("m")).collect()
    for r in whole:
        for mine, want in zip(got[r["clip"]], r["m"], strict=True):
            assert mine == (want if want is None else pytest.approx(want, abs=1e-6)), r["clip"]


def test_delivery_is_inspected_measured_and_written_once(spark, tmp_path):
    import json

    from sonarlake.plans import workflows
    from sonarlake.sources import readers, store

    quiet = np.concatenate([np.zeros(9600), sine(-30, 3), np.zeros(9600)])
    clips = {"a.wav": quiet, "low.wav": sine(-60, 3), "still.wav": np.zeros(48000), "short.wav": sine(-30, 0.25), "clipped.wav": np.ones(48000)}
    rows = spark.createDataFrame([("p", n, "h", x.tolist(), 48000) for n, x in clips.items()], "project string, name string, audio_sha256 string, samples array<double>, sample_rate int")
    root = str(tmp_path)
    out = {r["name"]: r for r in workflows.finalize(rows, root, "one", cut=True, target_lufs=-23.0).collect()}
    assert {n: r["error_code"] for n, r in out.items()} == {"a.wav": None, "low.wav": "boost_too_large", "still.wav": "audio_invalid", "short.wav": "loudness_unmeasurable", "clipped.wav": "audio_invalid"}
    a = out["a.wav"]
    assert a["gain_db"] == pytest.approx(-23 - a["input_loudness"]["lufs"]) and a["output_loudness"]["lufs"] == pytest.approx(-23, abs=0.2) and a["target_achieved"]
    written = {r["name"]: r["path"] for r in store.written(spark, root).collect()}
    assert sorted(written) == ["p/one/a.json", "p/one/a.wav"]
    back = np.array(readers.decode_wav(open(written["p/one/a.wav"], "rb").read())["samples"])
    assert len(back) == 143_999 + 3840 + 5760 and np.abs(back).max() == pytest.approx(10 ** (-30 / 20) * 10 ** (a["gain_db"] / 20), rel=1e-3)
    assert json.loads(open(written["p/one/a.json"]).read())["target_achieved"] is True
    with pytest.raises(FileExistsError):
        workflows.finalize(rows, root, "one", cut=True, target_lufs=-23.0)
    peak = {r["name"]: (r["error_code"], r["gain_db"]) for r in workflows.finalize(rows.where("name = 'a.wav'"), root, "two", peak_dbfs=-20.0).collect()}
    assert peak["a.wav"][0] is None and peak["a.wav"][1] == pytest.approx(10, abs=1e-3)
    assert workflows.finalize(rows, root, "three", profile="note").where("error_code <> 'configuration_error'").count() == 0
