import math
import random
import zlib

import numpy as np
import public_tokenizers
from llm_helpers import edge_texts, mixed, prose
from tokenizers import Tokenizer

from sonarlake.llm import packing, tokencount
from sonarlake.llm.tokens import Encoder, _Memo


def _library():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_ids_equal_the_library():
    rng = random.Random(1)
    alphabet = list("abcXYZ éßñçØŁ 012²½ .,;!?'\"-_ \n\t\r\x0b\x0c\x1c\x85\xa0 ’“”… €日本語🙂é") + ["'s", "'ll", "  ", "\n\n", "<|endoftext|>", " n't"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(1500)] + [t or "" for t in edge_texts()]
    want = [e.ids for e in _library().encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in Encoder().ids(texts)] == want


def test_memo_stays_bounded(monkeypatch):
    monkeypatch.setattr(_Memo, "LIMIT", 50)
    texts = [prose(random.Random(2), 400)] * 2
    e = Encoder()
    assert e.ids(texts)[0].tolist() == _library().encode(texts[0], add_special_tokens=False).ids and len(e.memo) <= 50


def test_tournament_is_first_fit():
    rng = random.Random(3)
    for _ in range(60):
        lengths = [rng.randrange(1, 101) for _ in range(rng.randrange(1, 60))]
        free, want = [], []
        for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            b = next((k for k, f in enumerate(free) if f >= lengths[i]), len(free))
            if b == len(free):
                free.append(100)
                want.append([])
            free[b] -= lengths[i]
            want[b].append(i)
        assert packing.first_fit_decreasing(lengths, 100) == want
    assert packing.first_fit_decreasing([], 100) == []


def test_pack_wastes_nothing():
    rng = random.Random(4)
    for _ in range(100):
        totals = [rng.choice([1, 5, 99, 100, 101, 350, rng.randrange(1, 500)]) for _ in range(rng.randrange(30))]
        seen = {}
        for seq in packing.pack(totals, 128):
            n = sum(p[2] for p in seq)
            assert n == 128 or n & (n - 1) == 0
            for d, at, k in seq:
                assert k > 0
                seen.setdefault(d, []).append((at, k))
        for d, n in enumerate(totals):
            at = 0
            for a, k in sorted(seen[d]):
                assert a == at
                at += k
            assert at == n


def test_pieces_round_trip(spark, docs):
    rows = mixed(9, 60)
    rows += [rows[5]]
    enc = _library()
    got = packing.pack_documents(docs(rows).repartition(4)).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    texts = dict(rows)
    copies = {i: sum(1 for j, _ in rows if j == i) for i, _ in rows}
    for i, pieces in by_doc.items():
        ids = np.array([*enc.encode(texts[i] or "", add_special_tokens=False).ids, 1], np.uint32)
        assert sum(p["length"] for p in pieces) == len(ids) * copies[i]
        for p in pieces:
            assert p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].astype("<u4").tobytes())
        if copies[i] == 1:
            assert [p["start"] for p in sorted(pieces, key=lambda p: p["start"])] == np.cumsum([0, *[p["length"] for p in sorted(pieces, key=lambda p: p["start"])]])[:-1].tolist()
    assert set(by_doc) == set(texts)
    pad = 0
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048
        pad += 0 if at & (at - 1) == 0 else 2048 - at
    assert pad == 0 and packing.pack_documents(docs([])).count() == 0


def test_histogram_and_limits(spark, docs):
    rows = mixed(11, 50)
    enc = _library()
    lengths = [len(enc.encode(t or "", add_special_tokens=False).ids) for _, t in rows]
    sums = tokencount.suffix_sums(tokencount.length_histogram(docs(rows).repartition(3)))
    for r in sums.collect():
        n = r["n_tokens"]
        assert r["n_docs"] == lengths.count(n) and r["docs_longer"] == sum(x > n for x in lengths) and r["tokens_longer"] == sum(x for x in lengths if x > n)
        assert r["total_docs"] == len(lengths) and r["total_tokens"] == sum(lengths) and r["tokens_truncated"] == sum(min(x, n) for x in lengths)
        assert math.isclose(r["share_at_most"], sum(x <= n for x in lengths) / len(lengths))
    limits = [1, 2, 100, 512, 10**9]
    for r in tokencount.at_limits(sums, limits).collect():
        n = r["context_limit"]
        assert (r["docs_whole"], r["docs_cut"], r["tokens_kept"]) == (sum(x <= n for x in lengths), sum(x > n for x in lengths), sum(min(x, n) for x in lengths))
    ordered = sorted(lengths)
    got = {r["share"]: r["n_tokens"] for r in tokencount.quantiles(sums, [0.0, 0.1, 0.5, 0.9, 1.0]).collect()}
    assert got == {q: ordered[max(0, math.ceil(q * len(ordered)) - 1)] for q in (0.0, 0.1, 0.5, 0.9, 1.0)}
    none = tokencount.suffix_sums(tokencount.length_histogram(docs([])))
    assert none.count() == 0 and tokencount.quantiles(none, [0.5]).count() == 0
    assert [tuple(r) for r in tokencount.at_limits(none, [4]).collect()] == [(4, 0, 0, 0)]


def test_texts_are_encoded_once(docs, monkeypatch):
    seen = []
    real = tokencount.checkpointed
    monkeypatch.setattr(tokencount, "checkpointed", lambda df: seen.append(df._jdf.queryExecution().toString().count("MapInArrow")) or real(df))
    sums = tokencount.suffix_sums(tokencount.length_histogram(docs(mixed(1, 5))))
    assert seen and seen[0] and "MapInArrow" not in sums._jdf.queryExecution().toString()


def test_groups_do_not_follow_the_order_of_rows(docs, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_DOCS", 20)
    rows = mixed(12, 40) + [(None, "a b"), (None, None), (3, "again"), (3, "again")]
    backwards = docs(rows[::-1]).repartition(7)
    a, b = (sorted(map(tuple, packing.pack_documents(d).collect()), key=str) for d in (docs(rows), backwards))
    assert a == b and len({r[5] >> packing.GROUP_BITS for r in a}) > 3
