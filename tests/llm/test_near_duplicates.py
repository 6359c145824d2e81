import random

import numpy as np
import xxhash
from llm_helpers import mixed, spaced

from sonarlake.llm import graph, simhash


def plain_fingerprint(text):
    w = spaced(text)
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), seed=42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(pairs, fps, radius=4):
    up = {i: i for i in range(len(pairs))}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(pairs)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [pairs[root(i)][0] for i in range(len(pairs))]


def test_components_against_brute_force(spark, docs):
    rows = mixed(1)
    fps = [plain_fingerprint(t) for _, t in rows]
    want = {(i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, plain_components(rows, fps), strict=True)}
    got = simhash.components(docs(rows).repartition(5))
    assert {tuple(r) for r in got.select("doc_id", "fingerprint", "component_id").collect()} == want


def test_null_ids_repeats_and_empty(spark, docs):
    got = simhash.components(docs([(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (None, None)])).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got if r["doc_id"]) == [(7, 7), (7, 7)]
    assert sorted(str(r["component_id"]) for r in got if r["doc_id"] is None) == ["7", "None"]
    assert simhash.components(docs([])).count() == 0 and simhash.keep_first(docs([])).count() == 0


def test_keep_first(docs):
    rows = [(5, "one two three four five six"), (3, "one two three four five six"), (9, "something else entirely than the others here"), (3, "one two three four five six")]
    kept = simhash.keep_first(docs(rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 9] and kept.columns == docs(rows).columns


def _plain_links(x, radius):
    up = list(range(len(x)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x[:i] ^ x[i]) <= radius):
            a, b = root(i), root(int(j))
            up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(x))]


def _clustered(seed, n):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64)
    out = [x]
    for c in x[: n // 20]:
        for flips in (1, 3, 4, 5, 8):
            y = c
            for b in rng.choice(64, flips, replace=False):
                y ^= np.uint64(1 << int(b))
            out.append(np.array([y], np.uint64))
    dense = x[0]
    for _ in range(200):  # a chain of near copies
        dense = dense ^ np.uint64(1 << int(rng.integers(64)))
        out.append(np.array([dense], np.uint64))
    return np.unique(np.concatenate(out))


def test_tree_descends_exactly(monkeypatch):
    monkeypatch.setattr(simhash, "LEAF_PAIRS", 64)  # so that all levels of the tree are used
    x = _clustered(1, 600)
    a, b = simhash.shard_forest(x, np.zeros(0, np.uint64), int(x[5]), 4)
    at = {int(v): i for i, v in enumerate(x)}
    up = list(range(len(x)))
    for i, j in zip(a, b, strict=True):
        up[at[int(i)]] = at[int(j)]

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    want = _plain_links(x, 4)
    assert len({(root(i), want[i]) for i in range(len(x))}) == len(set(want)) == len({root(i) for i in range(len(x))})


def test_shards_split_and_fine(spark, monkeypatch):
    x = _clustered(2, 300)
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    want = _plain_links(x, 4)
    names = {int(v): i for i, v in enumerate(x.view(np.int64))}
    for fine, shard in ((1 << 60, 20_000), (1 << 60, 3), (0, 20_000)):
        monkeypatch.setattr(simhash, "FINE_FROM", fine)
        found = graph.connected_components(simhash.link_fingerprints(df, shard=shard)).collect()
        got = list(range(len(x)))
        for r in found:
            got[names[r["node"]]] = ("c", r["component"])
        assert len(set(got)) == len(set(want)) == len(set(zip(got, want, strict=True)))


def test_component_chains(spark):
    rng = random.Random(2)
    n = 300
    order = list(range(n))
    rng.shuffle(order)
    edges = [(order[i], order[i + 1]) for i in range(n - 1) if i % 50] + [(1000, 1000 + k) for k in range(1, 80)]
    found = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    for a, b in edges:
        assert found[a] == found[b] <= min(a, b)
    assert len(set(found.values())) == 6 + 1 and graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_offsets_cover_half_the_ball():
    for blocks, size in ((2, 41), (4, 321)):
        assert len(simhash._offsets(blocks, 4)) == (size - 1) // 2
