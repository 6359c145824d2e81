import random

import corpus_pipeline
from llm_helpers import prose

from sonarlake.llm import neardup, simhash
from sonarlake.llm.text import HashMemo


def _changed(rng, text, share):
    return " ".join(prose(rng, 1) + "x" if rng.random() < share else w for w in text.split())


def test_stage_takes_near_copies_of_all_lengths(spark, docs):
    """Over 0.97 of the pairs of similarity 0.8 or more go, with one word appended all of them; no others go."""
    rng = random.Random(3)
    texts = [prose(rng, rng.randrange(60, 400)) for _ in range(400)]
    copies = [_changed(rng, t, rng.choice([0.005, 0.01, 0.02, 0.03, 0.04])) for t in texts] + [t + " more" for t in texts[:50]]
    like = [neardup.similarity(neardup.shingles(a), neardup.shingles(b)) for a, b in zip(texts + texts[:50], copies, strict=True)]
    d = docs(list(enumerate(texts + copies))).select(*corpus_pipeline.COLUMNS)
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, d, "").collect()}
    gone = [i + 400 not in kept for i in range(450)]
    near = [g for g, x in zip(gone, like, strict=True) if x >= neardup.LEAST]
    assert set(range(400)) <= kept and len(near) > 250 and sum(near) / len(near) > 0.97 and all(gone[400:])
    edge = [g for g, x in zip(gone, like, strict=True) if 0.8 <= x < 0.85]
    assert len(edge) > 15 and sum(edge) / len(edge) > 0.9
    assert not any(g for g, x in zip(gone, like, strict=True) if x < neardup.LEAST)
    old = {r["doc_id"] for r in simhash.keep_first(d).collect()}
    assert sum(i + 400 not in old for i, x in enumerate(like) if x >= neardup.LEAST) / len(near) < 0.8
    print("recall", sum(near) / len(near), "of", len(near), "; at 0.80-0.85", sum(edge) / len(edge), "of", len(edge), "; before", sum(i + 400 not in old for i, x in enumerate(like) if x >= neardup.LEAST) / len(near))


def test_large_blocks(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    fp = rng.integers(0, 1 << 63, dtype=np.uint64) ^ (np.uint64(1) << rng.integers(0, 64, 9000).astype(np.uint64))
    pairs, whole = neardup.block_pairs(fp, np.full(9000, 50))
    assert not whole and len(pairs) < 8 * 9000 and {j for _, j in pairs} == set(range(1, 9000))


def test_pipeline_stage_drops_appended_copy(spark, docs):
    text = prose(random.Random(1), 70)
    d = docs([(1, text), (1000, text), (1001, text + " more"), (1005, None)]).select(*corpus_pipeline.COLUMNS)
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, d, "").collect()} == {1, 1005}


def test_one_row_of_each_group_stays(spark, docs):
    """Rows that repeat an id with another text, whose group has a smaller id, or that have none."""
    rng = random.Random(9)
    a, b, c, e = (prose(rng, 80) for _ in range(4))
    rows = [(7, a), (7, a + " more"), (3, a + " still more"), (7, b), (None, c), (None, c), (None, c + " more"), (None, e), (9, e), (9, e), (None, None), (None, "")]
    kept = corpus_pipeline.drop_near_duplicates(spark, docs(rows).select(*corpus_pipeline.COLUMNS), "").collect()
    ids = sorted((str(r["doc_id"]), (r["text"] or "")[:40]) for r in kept)
    assert ids == sorted([("3", a[:40]), ("7", b[:40]), ("None", c[:40]), ("9", e[:40]), ("None", "")])
    assert neardup.keep_first(docs([])).count() == 0


def _all_candidates(rows):
    """Components of all pairs that share a band, lie within the radius and are similar: no cap, no rounds."""
    texts = sorted(set(rows))
    memo = HashMemo()
    like, up = [neardup.sketch(t, memo) for t in texts], list(range(len(texts)))
    cut = [neardup.shingles(t) for t in texts]

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if set(like[i][2].tolist()) & set(like[j][2].tolist()) and bin(like[i][1] ^ like[j][1]).count("1") <= neardup.RADIUS and neardup.similarity(cut[i], cut[j]) >= neardup.LEAST:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {frozenset(t for k, t in enumerate(texts) if root(k) == r) for r in {root(i) for i in range(len(texts))}}


def test_no_candidate_is_left_out(spark, docs):
    """Groups that stand near each other in the same blocks, with tiny caps and parts: components as of all candidates."""
    rng = random.Random(5)
    texts = []
    for _ in range(6):
        seed = prose(rng, 60)
        for share in (0.005, 0.01, 0.02, 0.03, 0.05):
            texts += [_changed(rng, seed, share) for _ in range(12)]
    want = _all_candidates(texts)
    assert 20 < len(want) < len(set(texts)) - 50
    d = docs(list(enumerate(texts)))
    rows = neardup._rows(d, "doc_id", "text").dropDuplicates(["key"])
    key = {r["__key"]: r["text"] for r in neardup._keyed(d, "text").collect()}
    for nearest, block, load in ((3, 4096, neardup.GRAMS), (1, 4096, 2000), (1, 8, 600)):
        found = {r["node"]: r["component"] for r in neardup.similar_components(d, rows, "text", nearest, block, load).collect()}
        got = {}
        for k, t in key.items():
            got.setdefault(found.get(k, k), set()).add(t)
        assert {frozenset(g) for g in got.values()} == want


def test_names_of_the_plan_are_refused(docs):
    import pytest
    from pyspark.sql import functions as F

    with pytest.raises(ValueError, match="__key"):
        neardup.keep_first(docs([(1, "a b c")]).withColumn("__key", F.lit(1)))
    kept = neardup.keep_first(docs([(1, "a b c"), (2, "a b c"), (3, "d")]).withColumns({"key": F.lit(1), "fp": F.lit(2), "node": F.lit(3), "band": F.lit(4)}))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3] and {"key", "fp", "node", "band"} <= set(kept.columns)


def _in_a_tree(a, b):
    """Whether a tree links two rows of fp, words: at most NEAR of its bits and WIDE of the 96 others differ."""
    halves = [(x >> s) & 0x0F0F0F0F0F0F0F0F for x in (int(p ^ q) for p, q in zip(a[1:], b[1:], strict=True)) for s in (0, 4)]
    d, fp = [x.bit_count() for x in halves], int(a[0] ^ b[0]).bit_count()
    return any(d[t] <= neardup.NEAR and fp + d[t ^ 1] <= neardup.WIDE for t in range(neardup.TREES))


def test_trees_link_what_all_pairs_link(spark, docs):
    """Components of the trees' links, with whole and split cells of one or two distances, are those of all pairs."""
    import numpy as np

    rng, memo = random.Random(17), HashMemo()
    seeds = [prose(rng, rng.randrange(1, 90)) for _ in range(60)]
    texts = sorted({_changed(rng, rng.choice(seeds), rng.choice([0, 0.01, 0.02, 0.05])) for _ in range(500)} | {"", "one"})
    got = np.array([neardup.prints(t, memo)[1] for t in texts])
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if _in_a_tree(got[i], got[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    want = {frozenset(k for k in range(len(texts)) if root(k) == r) for r in {root(i) for i in range(len(texts))}}
    assert 20 < sum(len(w) > 1 for w in want) and 60 < len(want) < len(texts) - 50
    rows = spark.createDataFrame([(k, 9, int(g[0].view(np.int64)), g[1:].view(np.int64).tolist()) for k, g in enumerate(got)], "key long, size long, fp long, words array<long>")
    for cell, fine_from in ((neardup.CELL, neardup.FINE_FROM), (20, neardup.FINE_FROM), (5, 1)):
        up[:] = range(len(texts))
        for r in neardup.tree_links(rows, cell, fine_from).collect():
            a, b = root(r["a"]), root(r["b"])
            up[max(a, b)] = min(a, b)
        assert {frozenset(k for k in range(len(texts)) if root(k) == r) for r in {root(i) for i in range(len(texts))}} == want


def test_candidates_come_from_the_trees(spark, docs):
    """Copies of similarity 0.8 or more that share no band of minima with their texts go; the trees link nearly all copies."""
    rng, memo = random.Random(23), HashMemo()
    tried, linked, found = 0, 0, []
    while len(found) < 12:
        text = prose(rng, 80).split()
        copy = list(text)
        for at in (35, rng.choice([0, 1, 2, 3, 77, 78, 79])):
            copy[at] += "x"
        pair = " ".join(text), " ".join(copy)
        if neardup.similarity(*map(neardup.shingles, pair)) < neardup.LEAST:
            continue
        one, two = (neardup.prints(t, memo)[1] for t in pair)
        near = _in_a_tree(one, two)
        tried, linked = tried + 1, linked + near
        bands = [set(neardup.sketch(t, memo)[2].tolist()) for t in pair]
        if near and int(one[0] ^ two[0]).bit_count() <= neardup.RADIUS and not bands[0] & bands[1]:
            found.append(pair)
    assert tried > 500 and linked / tried > 0.985
    d = docs([(2 * k + h, t) for k, p in enumerate(found) for h, t in enumerate(p)]).select(*corpus_pipeline.COLUMNS)
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, d, "").collect()} == set(range(0, 24, 2))
    print("linked", linked, "of", tried)
