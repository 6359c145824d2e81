from collections import Counter
from math import exp, log

import numpy as np
import pytest
from llm_helpers import mixed

from sonarlake.llm import lm, wordlm


@pytest.mark.parametrize("frequent, chunk", [(4096, 1_500_000), (60, 2_000), (2, 700)])
def test_all_windows_count(spark, docs, monkeypatch, frequent, chunk):
    """Sums by their definition, over every window: of rare neighbours and of frequent ones."""
    monkeypatch.setattr(wordlm, "FREQUENT", frequent)
    monkeypatch.setattr(wordlm, "CHUNK", chunk)
    rows = [*mixed(7, 40), (None, "no id here"), mixed(7, 40)[3]]
    d = docs(rows).repartition(3)
    model = lm.Model.fit(d, lm.vocabulary(d))
    monkeypatch.setattr(lm.Model, "fit", lambda *a: model)
    memo = lm.Tokens(model.frequent)
    seqs = [[b"", b"", *lm.words_lower(t), b"", b""] for _, t in rows]
    windows = [tuple(s[i - 1 : i + 2]) for s in seqs for i in range(2, len(s) - 2)]
    pair, word = Counter((a, c) for a, _, c in windows), Counter(windows)
    want = []
    for (i, _), s in zip(rows, seqs, strict=True):
        base, total = model.logs(np.array([memo[w] & 0xFFFF if w else 0 for w in s], np.uint16)), 0.0
        for k in range(2, len(s) - 2):
            a, b, c = s[k - 1 : k + 2]
            rough = -int(wordlm.coarse(base[k : k + 1])[0]) / wordlm.STEP
            total += float(base[k]) + log((word[a, b, c] - 1 + wordlm.NEAR * exp(rough)) / (pair[a, c] - 1 + wordlm.NEAR)) - rough
        want.append((str(i), total))
    got = sorted((str(r["doc_id"]), r["counted_log_likelihood"]) for r in wordlm.corpus_likelihood(d).collect())
    assert [g[0] for g in got] == [w[0] for w in sorted(want)]
    assert [g[1] for g in got] == pytest.approx([w[1] for w in sorted(want)], rel=1e-3, abs=1e-2)
