"""Runs that share a K-gram and nothing else hardly ask for each other's text."""

import numpy as np

from sonarlake.llm import suffixdedup


def test_runs_that_share_a_gram_only_ask_little():
    rng = np.random.default_rng(5)
    n, room = 3000, 16 + 2 * 60
    many = rng.integers(97, 123, 200_000).astype(np.uint8)
    least = int(suffixdedup.gram_values(many).argmin())  # whose windows all pick it
    text = rng.integers(97, 123, n * room).astype(np.uint8)
    for k in range(n):
        text[k * room + 60 : k * room + 76] = many[least : least + 16]
    gram, run, sides, _, _ = suffixdedup.runs_of(text, np.ones(len(text) - suffixdedup.SPAN + 1, bool))
    common, count = np.unique(gram, return_counts=True)
    mine = gram == common[count.argmax()]
    assert count.max() > 1500  # the anchor of all windows, or of most, is the same K-gram
    kind = run[mine] << np.uint64(2 * 16) | sides[mine].astype(np.uint64)
    names, _, asks, _ = suffixdedup._decide(gram[mine], kind, np.arange(int(mine.sum())))
    assert (names < 0).all() and asks.mean() < 0.1, asks.mean()
