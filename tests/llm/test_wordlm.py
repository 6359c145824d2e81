import random
from collections import Counter
from math import exp, log

import numpy as np
import pytest
from llm_helpers import mixed, prose

from sonarlake.llm import lm, wordlm


def plain_step(table, squares, seq, shifts):
    """One step by its definition, place by place."""
    h_of = lambda i: np.tanh(table[seq[i - 1], : lm.HIDDEN] + table[seq[i + 1], lm.HIDDEN : 2 * lm.HIDDEN] + 0.5 * (table[seq[i - 2], : lm.HIDDEN] + table[seq[i + 2], lm.HIDDEN : 2 * lm.HIDDEN]))
    grad = np.zeros_like(table)
    sigma = lambda x: 1 / (1 + exp(-x))
    for i in range(2, len(seq) - 2):
        if not seq[i]:
            continue
        h, dh = h_of(i), np.zeros(lm.HIDDEN)
        for j, right in [(i, True), *((i + s, False) for s in shifts)]:
            if j >= len(seq) - 2 or not seq[j]:
                continue
            out = table[seq[j], 2 * lm.HIDDEN :]
            error = sigma(h @ out[:-1] + out[-1] - log(lm.NOISE)) - right
            grad[seq[j], 2 * lm.HIDDEN :] += np.append(error * h, error)
            dh += error * out[:-1]
        dh *= 1 - h * h
        for k, weight in ((1, 1.0), (2, 0.5)):
            grad[seq[i - k], : lm.HIDDEN] += weight * dh
            grad[seq[i + k], lm.HIDDEN : 2 * lm.HIDDEN] += weight * dh
    squares = squares + (grad**2).sum(axis=1)
    return table - (lm.RATE / np.sqrt(squares))[:, None] * grad


def test_step_against_definition():
    rng = np.random.default_rng(3)
    trainer = lm.Trainer(1)
    trainer.table = rng.normal(0, 0.4, trainer.table.shape).astype(np.float32)
    seq = rng.integers(1, 40, 60).astype(np.uint16)
    seq[[0, 1, 30, 31, -2, -1]] = 0
    shifts = np.random.default_rng([lm.SEED, 1]).integers(1, max(2, 56 // 4), lm.NOISE).tolist()
    want = plain_step(trainer.table.astype(np.float64), trainer.squares.astype(np.float64), seq.astype(int), shifts)
    trainer.step(seq)
    assert np.allclose(trainer.table, want, atol=2e-4)
    assert trainer.seen.sum() == 56 and trainer.seen[0] == 2


def test_network_learns_from_both_sides(monkeypatch):
    monkeypatch.setattr(lm, "BATCH", 512)
    rng = np.random.default_rng(1)
    left, right = rng.integers(1, 5, 40_000), rng.integers(1, 5, 40_000)
    word = 10 + (left + right) % 4  # neither side alone can tell
    seq = np.zeros((40_000, 5), np.uint16)
    seq[:, 1], seq[:, 2], seq[:, 3] = left, word, right + 4
    seq = np.concatenate([[0], seq.ravel(), [0, 0]]).astype(np.uint16)
    trainer = lm.Trainer(0)
    for _ in range(6):
        trainer.train(seq)
    h = lm.hidden(trainer.table[seq])[1::5][:2000]
    out = trainer.table[10:14, 2 * lm.HIDDEN :]
    assert np.mean((h @ out[:, :-1].T + out[:, -1]).argmax(axis=1) == (word[:2000] - 10)) > 0.8


def test_network_is_nearly_normalised_and_prefers_order(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    vocab = lm.vocabulary(d)
    model = lm.Model.fit(d, vocab)
    memo, rng = lm.Tokens(model.frequent), random.Random(1)
    texts = [r["text"] for r in d.where("lang = 'en' AND n_chars > 800").limit(60).collect()]

    def mean(ts, alone=False):
        seqs = [lm.index_of(np.concatenate([lm._EDGE, memo.of(t), lm._EDGE])) for t in ts]
        return np.concatenate([((model.log_shares - model.spread)[s] if alone else model.logs(s))[2:-2] for s in seqs]).mean()

    assert mean(texts) > mean([" ".join(rng.sample(t.split(), len(t.split()))) for t in texts]) and mean(texts) > mean(texts, alone=True)
    seq = lm.index_of(np.concatenate([lm._EDGE, memo.of(texts[0]), lm._EDGE]))
    out = model.table[1:, 2 * lm.HIDDEN :]
    total = np.exp(model.log_shares[1:] + lm.hidden(model.table[seq])[:100] @ out[:, :-1].T + out[:, -1]).sum(axis=1)
    assert 0.7 < total.mean() < 1.4


def test_vocabulary_against_plain(spark, docs, monkeypatch):
    rows = mixed(7, 40)
    counts = Counter(w for _, t in rows for w in lm.words_lower(t))
    for words in (50, 16_384):
        monkeypatch.setattr(lm, "WORDS", words)
        monkeypatch.setattr(lm, "V", 1 + words + lm.BUCKETS)
        vocab = lm.vocabulary(docs(rows).repartition(3))
        assert vocab.frequent == [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:words]]
        n, distinct = np.zeros(lm.V, int), np.zeros(lm.V, int)
        for w, c in counts.items():
            at = 1 + vocab.frequent.index(w) if w in vocab.frequent else lm.bucket_of(w)
            n[at] += c
            distinct[at] += 1
        assert (vocab.counts == n).all() and (vocab.distinct == distinct).all() and vocab.tokens == sum(counts.values())


def plain_scores(rows, model, often):
    """The definition, with words instead of hashes."""
    memo = lm.Tokens(model.frequent)
    seqs = [[b"", b"", *lm.words_lower(t), b"", b""] for _, t in rows]
    windows = [tuple(s[i - 1 : i + 2]) for s in seqs for i in range(2, len(s) - 2)]
    pair, word = Counter((a, c) for a, _, c in windows), Counter(windows)
    out = []
    for s in seqs:
        base = model.logs(np.array([memo[w] & 0xFFFF if w else 0 for w in s], np.uint16))
        total = 0.0
        for i in range(2, len(s) - 2):
            a, b, c = s[i - 1 : i + 2]
            p = float(base[i])
            if a not in often or c not in often:
                rough = -int(wordlm.coarse(base[i : i + 1])[0]) / wordlm.STEP
                p += log((word[a, b, c] - 1 + wordlm.NEAR * exp(rough)) / (pair[a, c] - 1 + wordlm.NEAR)) - rough if pair[a, c] > 1 else 0
            total += p
        out.append(total)
    return out


@pytest.mark.parametrize("frequent, chunk", [(4096, 1_500_000), (60, 2_000)])
def test_scores_against_definition(spark, docs, monkeypatch, frequent, chunk):
    monkeypatch.setattr(wordlm, "FREQUENT", frequent)
    monkeypatch.setattr(wordlm, "CHUNK", chunk)
    rows = mixed(7, 40)
    rows += [(None, "no id here"), rows[3]]
    d = docs(rows).repartition(3)
    vocab = lm.vocabulary(d)
    model = lm.Model.fit(d, vocab)
    monkeypatch.setattr(lm.Model, "fit", lambda *a: model)
    counts = Counter(w for _, t in rows for w in lm.words_lower(t))
    often = {b"", *(w for w, n in counts.items() if n >= frequent)}
    want = sorted(((i, len(lm.words_lower(t)), x) for (i, t), x in zip(rows, plain_scores(rows, model, often), strict=True)), key=str)
    got = sorted(wordlm.corpus_likelihood(d).collect(), key=lambda r: str(tuple(r)))
    assert len(got) == len(rows)
    for (i, n, x), r in zip(sorted(want, key=lambda r: str(r[0])), sorted(got, key=lambda r: str(r["doc_id"])), strict=True):
        assert r["doc_id"] == i and r["n_tokens"] == n and r["remembered_log_likelihood"] == pytest.approx(x, rel=1e-3, abs=1e-2)
        text = next(t for k, t in rows if k == i)
        own = model.logs(lm.index_of(np.concatenate([lm._EDGE, lm.Tokens(model.frequent).of(text), lm._EDGE])))[2:-2]
        assert r["log_likelihood"] == pytest.approx(float(own.astype(float).sum()), rel=1e-4, abs=1e-3)
        assert r["mean_log_likelihood"] == (pytest.approx(r["log_likelihood"] / n) if n else None)
    assert wordlm.corpus_likelihood(d.limit(0)).count() == 0


def test_repeated_documents_and_rare_words_count(docs):
    """A text's second copy makes it likelier; rare words and those of other scripts are told apart."""
    rng = random.Random(5)
    rows = [(i, prose(rng, 80)) for i in range(200)]
    alone = {r["doc_id"]: r["remembered_log_likelihood"] / r["n_tokens"] for r in wordlm.corpus_likelihood(docs(rows)).collect()}
    twice = {r["doc_id"]: r["remembered_log_likelihood"] / r["n_tokens"] for r in wordlm.corpus_likelihood(docs([*rows, (500, rows[3][1])])).collect()}
    assert twice[500] == twice[3] > alone[3] + 0.5 and abs(twice[4] - alone[4]) < 0.1
    known = "ключ замок дверь" + " zzkalo zzbiru zzmeno zzfadu" * 3
    rows += [(1000 + i, prose(rng, 20) + " " + known) for i in range(8)]
    rows += [(2000, rows[0][1] + " " + known), (2001, rows[0][1] + " " + "дверь слово ключи" + " zzbiru zzfadu zzkalo zzmoni" * 3)]
    got = {r["doc_id"]: r["remembered_log_likelihood"] for r in wordlm.corpus_likelihood(docs(rows)).collect()}
    assert got[2000] > got[2001] + 5


def test_scores_dont_depend_on_partitions(spark, docs, monkeypatch):
    """The same rows in one and in eight partitions, in another order, over several shards and chunks."""
    monkeypatch.setattr(lm, "SHARD_TOKENS", 4_000)
    monkeypatch.setattr(wordlm, "CHUNK", 1_500)
    rows = mixed(9, 120) + [(None, "no id"), (3, "a b c")]
    one = sorted(map(tuple, wordlm.corpus_likelihood(docs(rows).coalesce(1)).collect()), key=str)
    eight = sorted(map(tuple, wordlm.corpus_likelihood(docs(rows[::-1]).repartition(8)).collect()), key=str)
    assert one == eight and len(one) == len(rows)


def test_averages_against_definition(spark, docs, monkeypatch):
    """Shards trained one by one, here, and averaged by how often each saw a word."""
    monkeypatch.setattr(lm, "SHARD_TOKENS", 3_000)
    monkeypatch.setattr(lm, "FAN", 2)
    d = docs(mixed(10, 80))
    vocab = lm.vocabulary(d)
    shards = lm.shards_of(vocab.tokens)
    assert shards > 4
    total, sums, memo = np.zeros(lm.V), 0.0, lm.Tokens(vocab.frequent)
    rows = lm.sharded(d, shards, id="doc_id").collect()
    for s in range(shards):
        trainer, parts, held = lm.Trainer(s), [lm._EDGE], 0
        for t in (r["text"] for r in rows if r["shard"] == s):
            tokens = memo.of(t)
            parts += [tokens, lm._EDGE] if len(tokens) else []
            held += len(tokens) + 2 if len(tokens) else 0
            if held >= 8 * lm.BATCH:
                trainer.train(lm.index_of(np.concatenate(parts)))
                parts, held = [lm._EDGE], 0
        if held:
            trainer.train(lm.index_of(np.concatenate(parts)))
        total += trainer.seen
        sums = sums + trainer.seen[:, None] * trainer.table.astype(np.float64)
    want = np.where(total[:, None] > 0, sums / np.maximum(total, 1)[:, None], lm.start())
    assert np.abs(lm.train(d, vocab, id="doc_id") - want).max() < 5e-3  # vectors travel as halves
