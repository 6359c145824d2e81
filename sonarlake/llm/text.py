"""Word helpers that several operators share."""

from __future__ import annotations

import hashlib

import numpy as np

UPPER_TO_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Bytes that part words, as bytes.translate wants them: all white space becomes a blank, A-Z lower case.
BLANK_AND_LOWER = bytes(32 if c in b"\x20\x09\x0a\x0b\x0c\x0d" else UPPER_TO_LOWER.get(c, c) for c in range(256))


def words_lower(text: str | None) -> list[bytes]:
    """Words parted by ASCII white space, A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "replace").translate(BLANK_AND_LOWER).split()


def stable_hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


class HashMemo(dict):
    """Word to 64-bit hash; emptied when it has grown to its limit, so its memory is bounded."""

    LIMIT = 400_000

    def __missing__(self, word) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = out = stable_hash(word if isinstance(word, bytes) else word.encode("utf-8", "replace"))
        return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of uint64 values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k word hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    return mix(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every window of w values, by doubling."""
    if len(x) < w:
        return x[:0]
    have, size = x, 1
    while size * 2 <= w:
        have = np.minimum(have[:-size], have[size:])
        size *= 2
    rest = w - size
    return np.minimum(have[: len(have) - rest], have[rest:]) if rest else have
