import math
import random
from collections import Counter

from llm_helpers import edge_texts, prose
from pyspark.sql import functions as F

from sonarlake.llm import queries, toxicity


def plain_segments(scores):
    """All maximal-scoring segments by their definition: take the best, then look on both sides of it."""
    if not scores:
        return []
    best = max(((sum(scores[i:j]), -(j - i), -i, i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=None)
    if best[0] <= 0:
        return []
    i, j = best[3], best[4]
    right = [(a + j, b + j, s) for a, b, s in plain_segments(scores[j:])]
    return [*plain_segments(scores[:i]), (i, j - 1, best[0]), *right]


def test_segments_against_definition():
    rng = random.Random(1)
    for _ in range(300):
        scores = [rng.choice([4, 3, 2, 1, None, None, None]) for _ in range(rng.randrange(18))]
        full = [-1.25 if s is None else s + 0.01 * rng.random() for s in scores]
        hits = [(i, s) for i, s in enumerate(full) if s > 0]
        got = [(a, b, round(s, 6)) for a, b, s in toxicity.segments(hits, 1.25)]
        assert got == [(a, b, round(s, 6)) for a, b, s in plain_segments(full)]


def _labelled(spark, n=900, seed=4):
    rng = random.Random(seed)
    bad = ["idiot", "scum", "moron", "trashy"]
    rows, labels = [], []
    for i in range(n):
        t, y = prose(rng, rng.randrange(30, 120)).split(), rng.random() < 0.2
        for _ in range(rng.randrange(2, 6) if y else 0):
            t.insert(rng.randrange(len(t)), rng.choice(bad))
        rows.append((i, " ".join(t)))
        labels.append((i, int(y)))
    return rows, spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_held_out(spark, docs):
    rows, labels = _labelled(spark)
    d = docs(rows)
    model = toxicity.train(d, labels, queries.learnable)
    held = toxicity.with_scores(d, model).join(labels, "doc_id").where(~queries.learnable(F.col("doc_id"))).collect()
    good = sum((r["score"] >= toxicity.THRESHOLD) == (r["toxic"] == 1) for r in held)
    assert good / len(held) > 0.97 and set(model.weights) >= {"idio-", "scum-"}
    again = toxicity.with_scores(d, model)
    assert again.columns == [*(c for c in d.columns if c != "score"), "score"]  # a clashing column is replaced
    spots = toxicity.passages(d, model).collect()
    assert spots and all(0 <= r["first_token"] <= r["last_token"] for r in spots)


def test_toxicity_edges(spark, docs):
    rows, labels = _labelled(spark, 300)
    model = toxicity.train(docs(rows), labels)
    for t in edge_texts():
        assert 0 <= model.score(t) <= 1
    assert model.score(None) == model.score("") < toxicity.THRESHOLD
    assert toxicity.with_scores(docs([]), model).count() == 0
    nobody = toxicity.train(docs(rows), labels.where("toxic = 0"))
    assert nobody.score("idiot scum") == 0.0 and toxicity.train(docs([]), labels).score("x") == 0.0
    odd = labels.unionByName(spark.createDataFrame([(None, 1), (3, None), (10**9, 1), (5, 7)], labels.schema))
    assert toxicity.train(docs(rows), odd).weights == model.weights


def test_labels_of_held_out_rows_are_not_read(spark, docs):
    rows, labels = _labelled(spark, 400)
    flipped = labels.withColumn("toxic", F.when(queries.learnable(F.col("doc_id")), F.col("toxic")).otherwise(1 - F.col("toxic")))
    a, b = (toxicity.train(docs(rows), x, queries.learnable) for x in (labels, flipped))
    assert a.weights == b.weights and (a.a, a.b) == (b.a, b.b)


def plain_training(rows, labels):
    """Weights, own words, gap, lambda, K by their definitions."""
    texts = dict(rows)
    docs = {0: [], 1: []}
    for i, y in labels:
        docs[y].append(toxicity.tokens_of(texts[i]))
    df = {y: Counter(w for d in docs[y] for w in set(d)) for y in docs}
    words = set(df[0]) | set(df[1])
    stems = {y: Counter() for y in docs}
    for y in docs:
        for w, n in df[y].items():
            stems[y][w[:4]] += n
    own = set()
    for w in words:
        t, c, st, sc = df[1][w], df[0][w], stems[1][w[:4]], stems[0][w[:4]]
        if st + sc > t + c:
            a, b, e, f = t + 0.5, c + 0.5, st - t + 0.5, sc - c + 0.5
            if abs((math.log(a / b) - math.log(e / f)) / math.sqrt(1 / a + 1 / b + 1 / e + 1 / f)) >= toxicity.MIN_Z:
                own.add(w)
    kind = lambda w: w if w in own else w[:4] + "-"

    def judged(t, c, nt, nc):
        prior = 0.5 + toxicity.PRIOR * (t + c) / (nt + nc)
        o = math.log((t + prior) / max(0.5, nt + toxicity.PRIOR - t - prior)) - math.log((c + prior) / max(0.5, nc + toxicity.PRIOR - c - prior))
        return o, o / math.sqrt(1 / (t + prior) + 1 / (c + prior))

    by_class = {y: Counter() for y in docs}
    for y in docs:
        for w, n in df[y].items():
            by_class[y][kind(w)] += n
    n = {y: sum(df[y].values()) for y in docs}
    likely = {k for k in set(by_class[0]) | set(by_class[1]) if abs(judged(by_class[1][k], by_class[0][k], n[1], n[0])[1]) >= toxicity.LIKELY_Z}
    around = {y: {(d[i - 1] if i else "", w, d[i + 1] if i + 1 < len(d) else "") for d in docs[y] for i, w in enumerate(d)} for y in docs}
    counts = {y: Counter(kind(w) for _, w, _ in around[y]) for y in docs}
    nt, nc = len(around[1]), len(around[0])
    got = []
    for k in sorted(likely):
        o, z = judged(counts[1][k], counts[0][k], nt, nc)
        if counts[1][k] + counts[0][k] and abs(z) >= toxicity.MIN_Z and abs(o) >= toxicity.MIN_ODDS:
            got.append((k, counts[1][k], counts[0][k], o))
    gap = math.log(1 - sum(g[2] for g in got) / nc) - math.log(1 - sum(g[1] for g in got) / nt)
    dist = [(o, (c + toxicity.PRIOR * (t + c) / (nt + nc)) / (nc + toxicity.PRIOR)) for _, t, c, o in got]
    dist.append((-gap, 1 - sum(p for _, p in dist)))
    return got, own, gap, dist


def test_training_against_definition(spark, docs, monkeypatch):
    monkeypatch.setattr(toxicity, "TOTALS", 1)
    rows, labels = _labelled(spark, 500, 7)
    # Words of one stem that say different things, copies, and a toxic word with endings.
    rng = random.Random(8)
    more = [(1000 + i, f"vequ{rng.choice(['ing', 'ed', 's'])} {prose(rng, 30)} pathetic" if i % 2 else prose(rng, 30) + " pathway") for i in range(200)]
    more += [(2000 + i, more[1][1]) for i in range(40)]
    pairs = [tuple(r) for r in labels.collect()] + [(i, i % 2 if i < 2000 else 1) for i, _ in more]
    rows += more
    got, own, gap, dist = plain_training(rows, pairs)
    model = toxicity.train(docs(rows), spark.createDataFrame(pairs, "doc_id long, toxic int"))
    assert {"pathetic", "pathway"} & own and model.own == own and "vequ-" in model.weights
    assert set(model.weights) == {g[0] for g in got} and all(math.isclose(model.weights[k], o, rel_tol=1e-9) for k, _, _, o in got)
    assert math.isclose(model.gap, gap, rel_tol=1e-6) and sum(p * s for s, p in dist) < 0  # clean text drifts down
    assert math.isclose(sum(p * math.exp(model.lam * s) for s, p in dist), 1, abs_tol=1e-6)
    gain = sum(p * s * math.exp(model.lam * s) for s, p in dist)
    assert math.isclose(model.k, sum(p * s for s, p in dist) ** 2 / gain * model.lam, rel_tol=1e-6)
    for t in [rows[k][1] for k in (0, 5, 9, 600, 601)]:
        toks = toxicity.tokens_of(t)
        scores = [model.weights.get(w if w in own else w[:4] + "-", -gap) for w in toks]
        total = 0.0
        for _, _, s in plain_segments(scores) if len(scores) < 120 else []:
            normal = model.lam * s - math.log(model.k * len(toks))
            if normal > 0:
                total += -math.log(-math.expm1(-math.exp(-normal)))
        if len(scores) < 120:
            assert math.isclose(model.evidence(t), total, rel_tol=1e-6, abs_tol=1e-9)
            assert math.isclose(model.score(t), 1 / (1 + math.exp(-(model.a * math.log1p(total) + model.b))), rel_tol=1e-6)


def test_tokens_of_scripts_without_spaces():
    assert toxicity.tokens_of("Ab ça-va") == ["ab", "ça", "va"] and toxicity.tokens_of("日本語 x") == ["日本", "本語", "x"] and toxicity.tokens_of("語") == ["語"]
    classes = toxicity.Classes({"pathetic"})
    assert [classes[w] for w in ("pathetic", "path", "paths", "a")] == ["pathetic", "path-", "path-", "a-"]


def test_query_with_null_ids_and_repeats(spark, tmp_path):
    rows, labels = _labelled(spark, 300)
    rows += [(None, "idiot scum moron"), (None, None), rows[0], rows[0]]
    d = str(tmp_path)
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string").write.parquet(f"{d}/documents.parquet")
    labels.unionByName(labels.limit(1)).write.parquet(f"{d}/labels.parquet")
    got = queries.op5_toxicity(spark, d).collect()
    assert len(got) == len(rows) and {r["held_out"] for r in got if r["doc_id"] is None} == {False}
    assert len({(r["score"], r["held_out"]) for r in got if r["doc_id"] == rows[0][0]}) == 1 and all(r["predicted"] == (r["score"] >= 0.7) for r in got)
