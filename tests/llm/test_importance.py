import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from llm_helpers import LOWER, edge_texts, mixed, prose

from sonarlake.llm import importance


def plain(rows, target, n=1, buckets=10_000, min_words=20, percent=10, seed=2024):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    features = lambda w: [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in features(find(x))) for texts in ([x for _, x in rows], target))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out, able = [], []
    for i, x in rows:
        w = find(x)
        f = features(w)
        weight = sum(map(gain, map(bucket, f))) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if len(w) >= min_words:
            able.append(out[-1])
    able.sort(key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("options", [{}, {"n": 2, "buckets": 50, "percent": 60, "seed": 5}, {"percent": 100, "min_words": 0}, {"percent": 0}])
def test_against_brute_force(spark, docs, options):
    rng = random.Random(4)
    rows, target = mixed(21, 150), [prose(rng, 60), None, "", "É über-café! 12 Ää", prose(rng, 9)]
    rows += [(None, prose(rng, 30)), (-5, prose(rng, 40)), (2**63 - 1, prose(rng, 25)), (-(2**63), prose(rng, 25))]
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(docs(rows).repartition(5), bench, **options)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows, target, **options)


def test_repeated_rows_are_drawn_one_by_one(spark, docs):
    """A third of all rows has one key, which the last drawn one falls into."""
    rng = random.Random(5)
    text = prose(rng, 40)
    rows = [(7, text)] * 60 + [(k, prose(rng, 40)) for k in range(100, 220)]
    bench = spark.createDataFrame([(text,)], "text string")
    got = [r.asDict() for r in importance.resample(docs(rows).repartition(4), bench, percent=20, carry=["lang"]).collect()]
    drawn = sorted(r["rank"] for r in got if r["rank"])
    assert len(got) == 180 and drawn == list(range(1, 37))
    best = sorted(got, key=lambda r: (-r["score"], r["doc_id"]))[:36]
    assert Counter(r["doc_id"] for r in got if r["rank"]) == Counter(r["doc_id"] for r in best)
    assert {r["lang"] for r in got} == {"en"} and any(r["doc_id"] == 7 and r["rank"] is None for r in got)


def test_kth_key_by_small_digits(spark):
    rng = random.Random(6)
    ends = [-(2**63), 2**63 - 1, 0, -1, 1]
    rows = [(rng.choice([*ends, rng.randrange(-50, 50)]), rng.choice([*ends, rng.randrange(-(2**40), 2**40)]), k) for k in range(300)]
    table = spark.createDataFrame(rows, "a long, b long, c long").repartition(3).cache()
    for k in (1, 2, 77, 150, 299, 300):
        for digit in (1, 7, 16) if k == 77 else (9,):
            assert tuple(importance.kth_key(table, ["a", "b", "c"], k, digit)) >= sorted(rows)[k - 1]
            a, b, c = importance.kth_key(table, ["a", "b", "c"], k, digit)
            assert sum(r <= (a, b, c) for r in rows) == k


def test_gains_and_edges(spark, docs):
    none = spark.createDataFrame([], "text string")
    rows = list(enumerate(edge_texts()))
    got = importance.resample(docs(rows), none)
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows, [])
    assert importance.resample(docs([]), none).count() == 0
    with pytest.raises(ValueError, match="name of a result"):
        importance.resample(docs(rows), none, carry=["score"])
