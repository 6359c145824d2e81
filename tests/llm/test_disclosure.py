import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import LOWER, edge_texts, prose

from sonarlake.llm import disclosure
from sonarlake.llm.queries import op12_disclosure
from sonarlake.llm.text import HashMemo

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text, re.ASCII):
            digits = [int(c) for c in m[0] if c.isdigit()]
            luhn = sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits))) % 10 == 0
            if {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 13 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((kind, *m.span()))
    return out


def plain_terms(texts, min_contexts=3, disclosure_share=0.9, evidence=40.0):
    """Terms by their definition, over occurrences kept as places."""
    total, occurrences, near, sides = 0, defaultdict(set), defaultdict(set), defaultdict(lambda: defaultdict(set))
    for n, text in enumerate(texts):
        base = plain_base(text)
        words = [(m[0], *m.span()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))]
        words = [w for w in words if not any(a < w[2] and w[1] < b for _, a, b in base)]
        pair = lambda i: i + 1 < len(words) and not any(words[i][1] < a < words[i + 1][2] for _, a, _ in base)
        total += len(words)
        for i, (w, _, _) in enumerate(words):
            occurrences[w].add((n, i))
            if pair(i):
                occurrences[f"{w} {words[i + 1][0]}"].add((n, i))
        for kind, a, b in base:
            who = (kind, disclosure.entity(kind, text[a:b]))
            p = sum(w[1] < a for w in words)
            window = range(max(0, p - 10), min(len(words), p + 10))
            if not window:
                continue
            reach = [w[0] for w in words[max(0, p - 20) : p]], [w[0] for w in words[p : p + 20]]
            left, right = tuple(reach[0][:5]), tuple(reach[1][-5:])
            key = (left or ("?", right), right or ("?", left))
            near[who] |= {(n, i) for i in window}
            for i in window:
                sides[who][words[i][0]].add(key)
                near[who, words[i][0]].add((n, i))
                if i + 1 in window and pair(i):
                    sides[who][f"{words[i][0]} {words[i + 1][0]}"].add(key)
                    near[who, f"{words[i][0]} {words[i + 1][0]}"].add((n, i))
    out = {}
    for who, by_term in sides.items():
        every = set().union(*by_term.values())
        lefts, rights = Counter(x for x, _ in every), Counter(y for _, y in every)
        for term, keys in by_term.items():
            contexts = sum(lefts[x] == rights[y] == 1 for x, y in keys)
            joint, n = len(near[who, term]), len(occurrences[term])
            info = -math.log2(len(near[who]) / total)
            pmi = math.log2(joint / n) + info
            if contexts >= min_contexts and pmi >= disclosure_share * info and contexts * pmi >= evidence:
                out[term] = min(out.get(term, (math.inf,)), (-pmi, *who, "remove" if joint == n else "generalise"))
    return {t: v[3] for t, v in out.items() if " " not in t or not any(w in out for w in t.split())}


def plain_spans(text, terms):
    base = plain_base(text)
    words = [(m[0], *m.span()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))]
    words = [w for w in words if not any(a < w[2] and w[1] < b for _, a, b in base)]
    marked = [[a, b] for w, a, b in words if w in terms]
    marked += [[x[1], y[2]] for x, y in zip(words, words[1:], strict=False) if f"{x[0]} {y[0]}" in terms and not any(x[1] < a < y[2] for _, a, _ in base)]
    merged = []
    for a, b in sorted(marked):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return base + [("term", a, b) for a, b in merged]


def planted(rng):
    """Zorvax goes with one address, the pair 'mi quint' with a card; both also alone. Copies and near copies give nothing away."""
    texts = [prose(rng, rng.randrange(40, 90)) for _ in range(150)]
    for k in range(6):
        w = prose(rng, 60).split()
        w[30:30] = ["Zorvax", "zv@mail.example.com"]
        texts.append(" ".join(w))
        w = prose(rng, 60).split()
        w[20:20] = [rng.choice(["mibas", "mifil"]), "MI", "quint,", "4111 1111 1111 1111"]
        texts.append(" ".join(w))
    texts += [f"{prose(rng, 25)} zorvax {prose(rng, 25)}", f"{prose(rng, 25)} mi, quint. {prose(rng, 25)}"] + [f"{prose(rng, 20)} mi {prose(rng, 9)} quint {prose(rng, 20)}" for _ in range(40)]
    copy = f"{prose(rng, 40)} hapaxone +49 (30) 1234-567 hapaxtwo {prose(rng, 40)}"
    texts += [copy] * 30
    for _ in range(30):
        w = copy.split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += ["a@b.c_d@e.f 1.2.3.4.5.6.7.8 300.1.1.1", "ü 1.1.1.1 é x@y.zz", "5555555555554444-", "+1 (132) 555-1352 x@y.zz 1.1.1.1", "9" * 4000 + ".1.1.1", *[t or "" for t in edge_texts()]]
    return texts


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="aZ09.@+-_ ()%,é1234\n", max_size=60))
def test_base_spans_are_those_of_the_patterns(text):
    assert disclosure.base_spans(text) == plain_base(text)


def test_base_spans_take_linear_time():
    for t in ("x" * 300_000 + "@", "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1" + " " * 300_000, "+" * 300_000, "1 " * 150_000, "x." * 150_000 + "@b.c"):
        disclosure.base_spans(t)
        disclosure.Words(t, disclosure.base_spans(t), HashMemo())


@pytest.mark.parametrize("limit", [disclosure.TERMS, 0])
def test_against_brute_force(spark, docs, limit):
    texts = planted(random.Random(12))
    terms = plain_terms(texts)
    assert terms["zorvax"] == "generalise" and terms["mi quint"] == "generalise" and not {"mi", "quint", "hapaxone", "hapaxtwo"} & set(terms)
    rows = list(enumerate(texts)) + [(900, None), (3, texts[3])]
    table = docs(rows).withColumn("n_email", disclosure.F.lit("old")).withColumn("_hits", disclosure.F.lit(1)).repartition(4)
    got = disclosure.sanitise(table, broadcast_terms=limit)
    assert got.columns[-6:] == [f.name for f in disclosure.OUTPUT] and got.columns.count("n_email") == 1 and "score" in got.columns
    found = got.select("doc_id", "text", *[f.name for f in disclosure.OUTPUT]).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(i for i, _ in rows)
    for r in found:
        want = plain_spans(r["text"] or "", terms)
        assert [tuple(s) for s in r["spans"]] == want
        assert [r[f"n_{k}"] for k in disclosure.KINDS] == [sum(w[0] == k for w in want) for k in disclosure.KINDS]
        assert "Zorvax" not in r["sanitised"] and "zv@mail" not in r["sanitised"] and "4111" not in r["sanitised"]
        if not want:
            assert r["sanitised"] == (r["text"] or "")
    assert any("[NAME] [EMAIL]" in r["sanitised"] for r in found)


def test_terms_that_stand_nowhere_else_are_removed(spark, docs):
    rng = random.Random(13)
    texts = [prose(rng, 80) for _ in range(100)] + [f"{prose(rng, 30)} onlyhere 10.0.0.{1} {prose(rng, 30)}" for _ in range(12)]
    assert plain_terms(texts) == {"onlyhere": "remove"}
    r = [r["sanitised"] for r in disclosure.sanitise(docs(list(enumerate(texts)))).where("n_ip > 0").collect()]
    assert len(r) == 12 and all("onlyhere" not in t and "[IP]" in t for t in r)


def test_query(spark, docs, tmp_path):
    texts = planted(random.Random(14))
    docs([*enumerate(texts), (999, None)]).write.parquet(f"{tmp_path}/documents.parquet")
    terms = plain_terms(texts)
    joined = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    want = {}
    for i, t in [*enumerate(texts), (999, "")]:
        base = plain_base(t)
        want[i] = (*(sum(s[0] == k for s in base) for k in disclosure.KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(plain_spans(t, terms)))
    got = op12_disclosure(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    assert {r["doc_id"]: tuple(r)[1:] for r in got.collect()} == want


def test_empty_tables(spark, docs):
    for limit in (disclosure.TERMS, 0):
        assert disclosure.sanitise(docs([]), broadcast_terms=limit).count() == 0
    assert [r["spans"] for r in disclosure.sanitise(docs([(1, ""), (2, None), (3, "a@b.cc")])).orderBy("doc_id").collect()] == [[], [], [("email", 0, 6)]]
