"""Large cells of the trees are joined by sorted blocks: the same components, of few comparisons."""

import numpy as np

from sonarlake.llm import neardup


def _cell(seed, n, copies):
    """Words and SimHashes of texts that are far apart, of pairs of near copies, and of a large group of them."""
    rng = np.random.default_rng(seed)
    word, fp = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for _ in range(2))

    def near(x, most):
        out = x.copy()
        for _ in range(most):
            out ^= np.uint64(1) << rng.integers(0, 64, len(out)).astype(np.uint64)
        return out

    some = np.concatenate([rng.integers(0, n, n // 5), np.full(copies, 7)])
    word, fp = np.concatenate([word, near(word[some], 5)]), np.concatenate([fp, near(fp[some], 6)])
    return word, fp, rng.random(len(word)) < 0.5


def _components(moved, root, n):
    up = np.arange(n)
    up[moved] = root
    return up


def _plain(word, fp, lives, tree):
    """All pairs, one by one."""
    low, high = word & np.uint64(neardup._LOW), (word >> np.uint64(4)) & np.uint64(neardup._LOW)
    short, other = (high, low) if tree % 2 else (low, high)
    up = list(range(len(word)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in np.flatnonzero(lives).tolist():
        near = np.bitwise_count(short[i] ^ short) <= neardup.NEAR
        near &= np.bitwise_count(fp[i] ^ fp) + np.bitwise_count(other[i] ^ other) <= neardup.WIDE
        for j in np.flatnonzero(near).tolist():
            a, b = root(i), root(j)
            up[max(a, b)] = min(a, b)
    return np.array([root(i) for i in range(len(up))])


def test_sorted_cells_have_the_components_of_all_pairs(monkeypatch):
    monkeypatch.setattr(neardup, "SORTED", 1)
    for seed, dense, pairs in ((1, 1 << 16, 1 << 20), (2, 20, 64)):  # also where groups are large, and where little is compared at once
        monkeypatch.setattr(neardup, "DENSE", dense)
        monkeypatch.setattr(neardup, "PAIRS", pairs)
        word, fp, lives = _cell(seed, 1500, 600)
        for tree in (0, 1):
            got = _components(*neardup.cell_forest(word, fp, lives, tree, int(word[3])), len(word))
            want = _plain(word, fp, lives, tree)
            assert (got == want).all() and len(set(want)) < 0.9 * len(want)
    for n in (0, 1, 2):  # guests alone link nothing
        word, fp, lives = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, bool)
        assert len(neardup.cell_forest(word, fp, lives, 0, 0)[0]) == 0
        assert len(neardup.cell_forest(word, fp, ~lives, 0, 0)[0]) == max(0, n - 1)


def test_large_cells_compare_few_pairs(monkeypatch):
    """Of a large cell with its guests, one of which is a group of many near copies, under a tenth of the pairs is looked at."""
    looked, count = [], np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda x, *a, **k: (looked.append(np.size(x)), count(x, *a, **k))[1])
    word, fp, lives = _cell(3, 15_000, 4_000)
    moved, _ = neardup.cell_forest(word, fp, lives, 0, int(word[3]))
    assert len(moved) > 5_000
    assert sum(looked) < lives.sum() * len(lives) / 10, sum(looked) / (lives.sum() * len(lives))
