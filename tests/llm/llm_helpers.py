"""Plain versions of what the operators must return."""

import itertools
import random
import re

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORDS = [a + b for a, b in itertools.product("ba de fi go hu ka le mi no pu ra se ti vo wu".split(), "bas den fil gor hum kan let mir nok pul".split())]


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edge_texts():
    """Null, empty, blank, one word, ties, other scripts, very long, repeated lines."""
    rng = random.Random(3)
    long = prose(rng, 30_000)
    return [None, "", " \n\t ", "one", "a b c", "日本語 テキスト é ß", "x" * 70_000, long, long, long[: len(long) // 2], "line one is here\n" * 40, "\x00\x1f odd \x85 chars", "A B C", "🙂 " * 60]


def mixed(seed, n=120):
    """Documents with exact and near copies, shared passages, and edge cases."""
    rng = random.Random(seed)
    passage = prose(rng, 30)
    base = [prose(rng, rng.randrange(5, 160)) for _ in range(n)]
    out = list(base)
    for t in base[:30]:
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        out += [t, " ".join(w), t + " " + prose(rng, 2)]
    out += [prose(rng, 20) + " " + passage + " " + prose(rng, 20) for _ in range(25)]
    out += edge_texts()
    rng.shuffle(out)
    return list(enumerate(out))
