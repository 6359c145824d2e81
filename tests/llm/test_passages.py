import hashlib
import random
import sys

import numpy as np
import pyarrow as pa
import pytest
from llm_helpers import mixed, prose

from sonarlake.llm import suffixdedup, suffixes


def plain(rows):
    docs = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, t in docs:
        for p in range(len(t) - 49):
            g = t[p : p + 50]
            if i is not None and (g not in first or i < first[g]):
                first[g] = i
    out = []
    for i, t in docs:
        cover = bytearray(len(t))
        for p in range(len(t) - 49):
            f = first.get(t[p : p + 50])
            if f is not None and (i is None or f < i):
                cover[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, m in zip(t, cover, strict=True) if not m)
        spans = sum(1 for k in range(len(t)) if cover[k] and (not k or not cover[k - 1]))
        out.append((i, len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(docs, monkeypatch, seed):
    rows = mixed(seed, 60)
    rows += [(None, rows[3][1]), (None, rows[3][1]), (rows[5][0], rows[4][1]), rows[6], (1000, "ab" * 400), (1001, "ab" * 300), (1002, "é" * 100), (1003, "aé" + "é" * 90)]
    if seed == 2:
        monkeypatch.setattr(suffixdedup, "BUCKET_BYTES", 20_000)
    got = sorted((tuple(r) for r in suffixdedup.repeats(docs(rows).repartition(6)).collect()), key=str)
    assert got == plain(rows)


def local(rows, buckets, flush_docs):
    """All stages without Spark: rows of (id, text), several emissions."""
    texts = {k: ((suffixdedup.NO_ID if i is None else i), (t or "").encode()) for k, (i, t) in enumerate(rows)}
    flush, emitted = suffixdedup._Flush(buckets), []
    for k, (i, t) in enumerate(rows):
        flush.add(i, k, (t or "").encode())
        if k % flush_docs == flush_docs - 1:
            emitted += list(flush.emit())
    emitted += list(flush.emit())
    found = []
    for b in range(buckets):
        if mine := [e for e in emitted if e[0] == b]:
            found += suffixdedup._meet(None, pa.table({"anchors": pa.array([e[1] for e in mine], pa.binary()), "repeats": pa.array([e[2] for e in mine], pa.binary())})).to_pylist()
    spans, asks, roles = {}, {}, set()
    for r in found:
        roles.add(r["role"])
        if r["role"] == suffixdedup.REPEATS:
            spans.setdefault(r["k"], []).append((r["start"], r["end"]))
        else:
            asks.setdefault(r["k"], []).append([r[c] for c in ("start", "end", "role", "g", "ask", "rk", "rs", "fan")])
    rows_ = []
    for k, a in asks.items():
        rows_ += suffixdedup._asked_rows(2, texts[k][0], k, texts[k][1], *(np.array(c) for c in zip(*a, strict=True)))
    for body in suffixdedup._pack(rows_).column("body") if rows_ else []:
        for r in suffixdedup._sort_texts(None, pa.table({"body": pa.array([body.as_py()], pa.binary())})).to_pylist():
            spans.setdefault(r["k"], []).extend(map(tuple, np.frombuffer(r["dups"], "<i8").reshape(-1, 2).tolist()))
    out = []
    for k, (i, t) in enumerate(rows):
        t = (t or "").encode()
        have = np.array(spans.get(k, []), np.int64).reshape(-1, 2)
        s, e = suffixdedup.merge(have[:, 0], have[:, 1])
        kept = b"".join(t[x:y] for x, y in zip([0, *e.tolist()], [*s.tolist(), len(t)], strict=True))
        out.append((i, len(t), len(t) - len(kept), len(s), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str), roles


def test_small_pieces_against_brute_force(monkeypatch):
    """Long texts in pieces, many emissions, small blocks that several shares meet."""
    for name, n in (("CHUNK", 300), ("BLOCK", 200), ("FAN", 2)):
        monkeypatch.setattr(suffixdedup, name, n)
    rng = random.Random(4)
    passage = prose(rng, 60)
    rows = [(i, prose(rng, rng.randrange(1, 150)) + " " + passage[rng.randrange(80) : -rng.randrange(1, 80)] + " " + prose(rng, 5)) for i in range(25)]
    got, roles = local(rows, 3, 7)
    assert got == plain(rows) and roles == {suffixdedup.REPEATS, suffixdedup.PART, suffixdedup.WHOLE, suffixdedup.NAMED}


def test_random_corpora_against_brute_force(monkeypatch):
    for seed in range(150):
        rng = random.Random(seed)
        for name, n in (("CHUNK", rng.choice([120, 1 << 18])), ("BLOCK", rng.choice([64, 500, 1 << 15])), ("FAN", rng.choice([1, 2, 256]))):
            monkeypatch.setattr(suffixdedup, name, n)
        letters = rng.choice(["a", "ab", "abc ", "abcdefgh é"])
        stock = ["".join(rng.choice(letters) for _ in range(rng.randrange(20, 400))) for _ in range(4)]
        rows = []
        for i in range(rng.randrange(2, 14)):
            t = "".join(rng.choice([rng.choice(stock), rng.choice(stock)[rng.randrange(15) : -rng.randrange(1, 15)], "".join(rng.choice(letters) for _ in range(rng.randrange(80)))]) for _ in range(rng.randrange(5)))
            rows.append((rng.choice([i, i, i, rng.randrange(5), None]), t))
        got, _ = local(rows, rng.choice([1, 3]), rng.randrange(1, 6))
        assert got == plain(rows), seed


def test_removal_keeps_columns_and_characters(docs):
    a = "日本語のとても長い一節がここにあります、それは繰り返されます。" * 2
    rows = [(1, a), (2, "前 " + a + " 後"), (3, None), (4, "short"), (5, a)]
    out = {r["doc_id"]: r["text"] for r in suffixdedup.remove_repeats(docs(rows)).collect()}
    assert out[1] == a and out[2].startswith("前") and out[2].endswith("後") and "�" not in out[2] and len(out[2]) < 8
    assert out[3] is None and out[4] == "short" and out[5] == ""
    assert suffixdedup.remove_repeats(docs(rows)).columns == docs(rows).columns
    assert suffixdedup.repeats(docs([])).count() == 0


def test_deep_shallow_order():
    rng = random.Random(1)
    text = "".join(rng.choice("ab") for _ in range(3000)) + "x" * 200 + "ab" * 150
    text += text[500:900]
    raw = np.frombuffer(text.encode(), np.uint8)
    places = np.arange(len(raw) - 50)
    got = [sorted(g) for g in suffixes.equal_strings(raw, places, 50)]
    seen = {}
    for p in places.tolist():
        seen.setdefault(text[p : p + 50], []).append(p)
    assert got == [seen[w] for w in sorted(seen) if len(seen[w]) > 1]
    order = [p for g in suffixes.shallow_groups(raw, places, 24) for p in g]
    assert [text[p : p + 24] for p in order] == sorted(text[p : p + 24] for p in places.tolist())
    sizes = np.array([rng.randrange(24, 400) for _ in places])
    sizes = np.minimum(sizes, len(raw) - places)
    seen = {}
    for p, n in zip(places.tolist(), sizes.tolist()):
        seen.setdefault(text[p : p + n], []).append(p)
    assert [sorted(g) for g in suffixes.equal_strings(raw, places, sizes)] == [seen[w] for w in sorted(seen) if len(seen[w]) > 1]
    trie = suffixes.BlindTrie()
    for v, s in enumerate((b"abcd", b"abce", b"aacd", b"abcd", b"zbcd", b"abxd", b"ab", b"abcdef", b"ab")):
        trie.insert(s, v)
    assert list(trie.leaves()) == [[2], [6, 8], [0, 3], [7], [1], [5], [4]]
    for _ in range(200):
        a = bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 300)))
        b = a[: rng.randrange(len(a) + 1)] + bytes(rng.choice(b"ab") for _ in range(rng.randrange(5)))
        n = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert suffixes.common_prefix(a, b) == n


def test_python_steps_only_where_strings_agree():
    """Strings that stand alone after the multikey sort, and documents with spans, take no steps of Python of their own."""
    rng = np.random.default_rng(3)
    text = rng.integers(0, 256, 20_050, dtype=np.uint8)
    text[15_000:15_100] = text[2_000:2_100]
    doc = np.repeat(np.arange(2_000), 3)
    starts = rng.integers(0, 300, len(doc))
    ends = starts + rng.integers(50, 120, len(doc))
    steps = 0

    def count(frame, event, arg):
        nonlocal steps
        steps += 1

    sys.setprofile(count)
    try:
        found = list(suffixes.equal_strings(text, np.arange(20_000), 50))
        sorting, steps = steps, 0
        spans = list(suffixdedup._spans_of_docs(doc, starts, ends))
    finally:
        sys.setprofile(None)
    assert sorted(found) == [[p, p + 13_000] for p in range(2_000, 2_051)]
    assert sorting < 10_000 and steps < 10_000
    for d, packed in spans:
        want = suffixdedup.merge(starts[doc == d], ends[doc == d])
        assert np.frombuffer(packed, "<i8").reshape(-1, 2).T.tolist() == [x.tolist() for x in want]
    assert [d for d, _ in spans] == list(range(2_000))
    assert not list(suffixdedup._spans_of_docs(doc[:0], starts[:0], ends[:0]))


@pytest.mark.parametrize("shallow", [1, 5, 8, 13, 16, 24, 31])
def test_shallow_parts_of_any_depth(shallow):
    rng = random.Random(shallow)
    text = "".join(rng.choice("ab\x00\x7f") if rng.random() < 0.9 else rng.choice("xyzé") for _ in range(1500)) + "abab" * 50
    raw = np.frombuffer(text.encode(), np.uint8)
    whole, places = raw.tobytes(), np.arange(len(raw) - shallow + 1)
    got = list(suffixes.shallow_groups(raw, places, shallow))
    keys = [whole[g[0] : g[0] + shallow] for g in got]
    assert keys == sorted(set(keys)) and sorted(p for g in got for p in g) == places.tolist()
    assert all(whole[p : p + shallow] == key for g, key in zip(got, keys, strict=True) for p in g)
    assert all(g == sorted(g) for g in got)


def test_hashes_remove_nothing(docs, monkeypatch):
    """Where all hashes agree by chance, texts are compared and stay."""
    monkeypatch.setattr(suffixdedup, "_decide", lambda gram, run, id: (np.where(id > id.min(), id.argmin(), -1), np.full(len(id), len(id)), np.zeros(len(id), bool), np.zeros(len(id), bool)))
    rng = random.Random(9)
    rows = [(i, prose(rng, 60)) for i in range(12)]
    texts = {i: t.encode() for i, t in rows}
    flush = suffixdedup._Flush(1)
    for i, t in texts.items():
        flush.add(i, i, t)
    out = list(flush.emit())
    found = suffixdedup._meet(None, pa.table({"anchors": pa.array([e[1] for e in out], pa.binary()), "repeats": pa.array([e[2] for e in out], pa.binary())})).to_pylist()
    assert sum(r["role"] == suffixdedup.WHOLE for r in found) > 50
    rows = [{"b": 0, "role": r["role"], "id": r["k"], "k": r["k"], "pos": r["start"], "ask": True, "rk": r["rk"], "rs": r["rs"], "x": texts[r["k"]][r["start"] : r["end"]]} for r in found]
    assert suffixdedup._sorted(pa.Table.from_pylist(rows)).num_rows == 0


def test_names_of_the_plan_are_refused(docs):
    with pytest.raises(ValueError, match="underscores"):
        suffixdedup.repeats(docs([(1, "a")]).withColumnRenamed("k", "__k"))
