import random

import duckdb
import pandas as pd
import pytest
from llm_helpers import mixed, prose

from sonarlake.llm import queries, quality, urlfilter

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["op2_url_filter", "op3_quality_rules", "op7_warc"])
def test_against_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, DIR).toPandas(), duck.execute(queries.ORACLE_SQL[name]).df()
    flat = lambda f: sorted(str([None if pd.isna(v) else v for v in r]) for r in f[sorted(f.columns)].astype(object).itertuples(index=False))
    assert flat(got) == flat(want)


URLS = {
    "http://A.Example.NET/en/1?x#y": ("a.example.net", "/en/1", "example.net/en/", "allow"), "https://example.net/fr": ("example.net", "/fr", "net/", "block"), "x://notexample.com/de/": ("notexample.com", "/de/", None, "allow"),
    "http://example.com/de/x": ("example.com", "/de/x", "example.com/de/", "block"), "http://org": ("org", "", None, "allow"), "http://a.org/fr/?": ("a.org", "/fr/", "org/fr/", "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"),
    "no scheme": ("", "", None, "allow"), "://net/": ("net", "/", "net/", "block"), "http://net?/": ("net", "", None, "allow"), "http://a.net/" + "p" * 100_000: ("a.net", "/" + "p" * 100_000, "net/", "block"), "http://net:80/": ("net:80", "/", None, "allow"),
}


def test_urls(spark):
    rows = [(i, u, "old") for i, u in enumerate(URLS)] * 2
    pages = spark.createDataFrame(rows, "page_id int, url string, rule string")
    got = urlfilter.url_filter(pages, urlfilter.rules_table(spark, queries.URL_RULES)).collect()
    assert len(got) == 2 * len(URLS) and all((r["host"], r["path"], r["rule"], r["verdict"]) == URLS[r["url"]] for r in got)


def test_many_rules_against_brute_force(spark):
    rng = random.Random(1)
    names = ["a", "b", "co", "net", "org"]
    host = lambda: ".".join(rng.choice(names) for _ in range(rng.randrange(1, 4)))
    path = lambda: "/" + "".join(rng.choice("xy/") for _ in range(rng.randrange(5)))
    rules = list({(h, p): (h, p, rng.choice(["block", "allow"])) for h, p in ((host(), rng.choice(["", path()])) for _ in range(150))}.values())
    urls = [f"http://{host()}{rng.choice(['', path()])}" for _ in range(400)]
    got = {r["url"]: (r["rule"], r["verdict"]) for r in urlfilter.url_filter(spark.createDataFrame([(u,) for u in urls], "url string"), urlfilter.rules_table(spark, rules), default="none").collect()}
    for u in urls:
        rest = u[7:]
        h, p = rest.split("/", 1)[0], rest[len(rest.split("/", 1)[0]) :]
        fit = [(len(a) + len(b), v == "block", a + b, v) for a, b, v in rules if (h == a or h.endswith("." + a)) and p.startswith(b)]
        assert got[u] == ((max(fit)[2], max(fit)[3]) if fit else (None, "none"))
    assert urlfilter.url_filter(spark.createDataFrame([(u,) for u in urls[:3]], "url string"), urlfilter.rules_table(spark, [])).where("verdict = 'allow'").count() == 3


def plain_quality(text):
    import re

    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = {}
    for i in range(len(w) - 2):
        grams.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + k for p in grams.values() if len(p) > 1 for i in p for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
    return (*n, n[0] < 50 or 100 * n[4] > 50 * n[0])


def test_base_rules_against_brute_force(docs, monkeypatch):
    rows = mixed(5, 40) + [(900, "a b c a b c a b"), (901, "x x x x"), (902, "# | <b> && $%"), (903, "a\n \na\nb\na")]
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    for bits in (21, 3):  # three bits of place: most texts take the way of very long ones
        monkeypatch.setattr(quality, "PLACE_BITS", bits)
        got = {r["doc_id"]: tuple(r[c] for c in columns) for r in quality.quality_rules(docs(rows)).collect()}
        assert got == {i: plain_quality(t) for i, t in rows}


def test_common_lines(spark):
    rng = random.Random(2)
    foot = prose(rng, 60)
    rows = [(i, prose(rng, 70) + "\n" + foot.upper() + "\n" + prose(rng, 5), "h") for i in range(20)] + [(100 + i, foot + "\n" + prose(rng, 20), "h") for i in range(5)]
    rows += [(200 + i, rows[0][1], None) for i in range(30)] + [(300, None, "h"), (301, foot + "\n" + prose(rng, 20), None)]
    got = {r["doc_id"]: r["kept"] for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i] for i in range(20)) and not any(got[100 + i] for i in range(5))
    assert all(got[200 + i] for i in range(30)) and got[301] and not got[300]  # copies count once, and a host without a name is its own
    assert quality.quality_rules(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_native(spark):
    for name in ("op2_url_filter", "op3_quality_rules"):
        plan = queries.QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow")) and "Cartesian" not in plan
