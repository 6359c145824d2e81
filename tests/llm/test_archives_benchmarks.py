import gzip
import hashlib
import io
import random
import re

import pytest
from llm_helpers import LOWER, WORDS, edge_texts, prose

from sonarlake.llm import decontam, warc


def plain_decontaminate(rows, items):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    grams = {}
    for i, t in items:
        w = find(t)
        n = min(13, len(w))
        for a in range(len(w) - n + 1 if n and i is not None else 0):
            grams.setdefault((n, tuple(w[a : a + n])), set()).add(str(i))
    out = []
    for i, t in rows:
        w, hit, names = find(t), set(), set()
        for n in {k[0] for k in grams}:
            for a in range(len(w) - n + 1):
                if g := grams.get((n, tuple(w[a : a + n]))):
                    hit.update(range(a, a + n))
                    names |= g
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [decontam.BROADCAST_CHARS, 0])
def test_decontamination_against_brute_force(spark, docs, limit):
    rng = random.Random(6)
    items = [(i, prose(rng, n)) for i, n in enumerate([1, 2, 3, 5, 12, 13, 14, 40, 40, 90])] + [(3, prose(rng, 20)), (50, ""), (51, None), (None, prose(rng, 20)), (52, "É über-café! 12 Ää"), (53, prose(rng, 40))]
    items.append((54, items[-1][1]))
    rows = [(k, t) for k, t in enumerate(edge_texts())]
    for k in range(60):
        w = prose(rng, rng.randrange(0, 150)).split()
        if k % 2:
            source = items[rng.randrange(len(items))][1] or ""
            v = source.split()
            a = rng.randrange(max(1, len(v) - 8))
            w[len(w) // 2 : len(w) // 2] = v[a : a + rng.randrange(1, 50)]
        rows.append((100 + k, rng.choice([" ", ", ", "\n"]).join(w).upper() if k % 3 == 0 else " ".join(w)))
    rows += [(500, items[7][1]), (500, items[7][1]), (501, items[-3][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.decontaminate(docs(rows).repartition(3), bench, broadcast_chars=limit)
    assert got.columns[-5:] == decontam.OUTPUT.names and got.columns.count("n_words") == 1
    have = sorted((tuple(r) for r in got.select("doc_id", *decontam.OUTPUT.names).collect()), key=str)
    assert have == plain_decontaminate(rows, items)
    none = decontam.decontaminate(docs(rows), bench.limit(0), broadcast_chars=limit)
    assert none.where("n_hit > 0 OR contaminated OR n_items > 0").count() == 0 and none.count() == len(rows)
    assert decontam.decontaminate(docs([]), bench, broadcast_chars=limit).count() == 0


def test_every_long_span_has_a_shared_fingerprint():
    rng = random.Random(2)
    for _ in range(200):
        span = [rng.choice(WORDS).encode() for _ in range(13)]
        a, b = ([rng.choice(WORDS).encode() for _ in range(20)] + span + [rng.choice(WORDS).encode() for _ in range(20)] for _ in range(2))
        fa, fb = (set(decontam.fingerprints(decontam._hashes(x), 13).tolist()) for x in (a, b))
        assert fa & fb


class _File:
    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at : at + n]


def _archive(rng, n=60):
    parts, offsets, records = [], [], []
    for i in range(n):
        payload = bytes(rng.randrange(256) for _ in range(rng.randrange(400))) if i % 3 else b"\x1f\x8b\x08" * rng.randrange(30)
        if i % 7 == 3:
            payload = warc.member(b"not a record")[: rng.randrange(40)] + payload  # magic inside a record
        data = warc.record(i, f"http://x/{i}", payload)
        offsets.append(sum(map(len, parts)))
        parts.append(warc.member(data))
        records.append(data)
    return b"".join(parts), offsets, records


def test_ranges_own_each_record_once():
    rng = random.Random(1)
    data, offsets, records = _archive(rng)
    assert gzip.GzipFile(fileobj=io.BytesIO(data)).read() == b"".join(records)
    for size in (1, 2, 3, 50, 777, 5000, len(data)):
        for read in (1, 64, 1 << 20) if size > 40 else (64,):
            got = [r for at in range(0, len(data), size) for r in warc.read_range(_File(data), at, min(at + size, len(data)), len(data), read)]
            assert [g[0] for g in got] == offsets and [g[1] for g in got] == records


def test_stored_members_and_damage():
    rng = random.Random(2)
    data, offsets, records = _archive(rng, 20)
    broken = bytearray(data)
    broken[offsets[5] + 12] ^= 0xFF
    got = [r[0] for r in warc.read_range(_File(bytes(broken)), 0, len(broken), len(broken))]
    assert set(offsets) - {offsets[5]} == set(got)
    cut = [r[0] for r in warc.read_range(_File(data[:-5]), 0, len(data) - 5, len(data) - 5)]
    assert cut == offsets[:-1] and list(warc.read_range(_File(b""), 0, 0, 0)) == []


def test_round_trip(spark, tmp_path):
    rng = random.Random(3)
    shared = prose(rng, 50)
    rows = [(i, f"http://h/{i}?\r\nx y", shared if i % 3 == 0 else prose(rng, rng.randrange(100))) for i in range(50)]
    rows += [(50, None, None), (51, "u", ""), (None, "n", shared), (0, "again", shared), (52, "é", "日本 " * 9000), (48, rows[48][1], shared)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_type string")
    got = warc.read_archives(warc.write_archives(pages.repartition(5), str(tmp_path), archive_bytes=3000), str(tmp_path), range_bytes=701).collect()
    last = {}
    for i, _, h in rows:
        if i is not None:
            last[h or ""] = max(last.get(h or "", i), i)
    id_of = lambda r: r["record_id"].removeprefix("<urn:x-page:").rstrip(">")
    want = []
    for i, _, h in rows:
        p = (h or "").encode()
        first = last.get(h or "")
        revisit = first is not None and first != i and i is not None
        want.append((str(i), len(p), warc.base32_sha1(p), "revisit" if revisit else "response", f"<urn:x-page:{first}>" if revisit else None))
    assert sorted(((id_of(r), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == sorted(want, key=str)
    assert {r["payload"] for r in got if r["record_type"] == "response"} >= {(h or "").encode() for i, _, h in rows}
    whole = b"".join(p.read_bytes() for p in sorted(tmp_path.glob("*.warc.gz")))
    assert gzip.decompress(whole).count(b"WARC/1.1\r\n") == len(rows) and not list(tmp_path.glob(".*-*"))
    small = warc.round_trip(pages, str(tmp_path / "b"), min_payload=100_000)
    assert small.where("record_type = 'revisit'").count() == 0 and warc.round_trip(pages.limit(0), str(tmp_path / "c")).count() == 0
