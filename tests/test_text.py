"""Readings, normalization, lexicons, routing and segmentation on fixed examples."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sonarlake.functions import emotion, lexicon, normalize, reading, segment

READINGS = [
    ("0", "零"), ("7", "七"), ("10", "十"), ("19", "十九"), ("20", "二十"), ("101", "一百零一"), ("110", "一百一十"), ("1010", "一千零一十"), ("10001", "一万零一"), ("10010", "一万零十"),
    ("100000001", "一亿零一"), ("10010000", "一千零一万"), ("1000000000", "十亿"), ("-15", "负十五"), ("007", "七"), ("1000000000000", "一零零零零零零零零零零零零"), ("120003400", "一亿二千万三千四百"), ("100010000", "一亿零一万"),
]


@pytest.mark.parametrize(("value", "spoken"), READINGS)
def test_integer_reading(value, spoken):
    assert normalize.integer(value) == spoken


def test_integer_reading_column(spark):
    rows = spark.createDataFrame([(v, s) for v, s in READINGS], "v string, s string")
    assert [r["v"] for r in rows.where(~reading.integer_reading(F.col("v")).eqNullSafe(F.col("s"))).collect()] == []


def test_column_and_udf_agree(spark):
    rows = spark.range(0, 30_000_000, 91_003).select((F.col("id") * 7919 % 987654321).alias("n"))
    py = F.udf(lambda n: normalize.integer(str(n)), "string")
    assert rows.where(reading.integer_reading(F.col("n")) != py("n")).count() == 0


@pytest.mark.parametrize(("text", "spoken"), [
    ("今天是2026年9月8日，价格是199.9元。", "今天是二零二六年九月八日,价格是一百九十九点九元。"), ("¥19.9", "十九点九块"), ("15%", "百分之十五"), ("$20", "二十美元"), ("08:05", "八点零五分"),
    ("13800138000", "一三八零零一三八零零零"), ("2+3=5", "二加三等于五"), ("10001", "一万零一"), ("你昨天为什么没有告诉我？", "你昨天为什么没有告诉我?"), ("  等一下，  我有话要说。  ", "等一下, 我有话要说。"),
    ("发给test@example.com", "发给test@example.com"), ("https://example.com/42", "https://example.com/42"), ("3-5", "三减五"), ("12:00:07", "十二点整七秒"), ("1999年", "一九九九年"), ("010-12345678", "零一零，一二三四五六七八"),
    ("等...~", "等……到"), ("50%-60%", "百分之五十百分之负六十"), ("25:00", "25:00"),
])
def test_normalize(text, spoken):
    assert normalize.normalize(text, "dialogue")["normalized"] == spoken


def test_normalize_profiles_and_warnings():
    assert normalize.normalize("¥19.9", "narration")["normalized"] == "十九点九元"
    assert normalize.normalize("¥19.9", "none")["changed"] is False
    bad = normalize.normalize("2026-02-30", "dialogue")
    assert bad["normalized"] == "2026-02-30" and len(bad["warnings"]) == 2
    assert len(normalize.normalize("25:00", "dialogue")["warnings"]) == 1
    for text, profile in (("", "dialogue"), ("  ", "dialogue"), ("a", "other"), (None, "dialogue")):
        assert normalize.normalize(text, profile)["error_code"] == "configuration_error"


def test_normalize_column(spark):
    rows = spark.createDataFrame([(1, "¥3 abc"), (2, None), (3, "")], "i int, t string")
    out = {r["i"]: r["n"] for r in rows.select("i", normalize.normalize_text(F.col("t")).alias("n")).where("n.error_code IS NULL OR i > 1").collect()}
    assert out[1]["normalized"] == "三块 abc" and out[1]["warnings"] == ["Review spoken form of identifier: abc"]
    assert out[2]["error_code"] == out[3]["error_code"] == "configuration_error"


def test_reading_columns(one):
    lit = F.lit
    assert one(reading.checked_date_reading(lit("2026-02-30"))) is None
    assert one(reading.checked_date_reading(lit("2026年9月8日"))) == "二零二六年九月八日"
    assert one(reading.time_reading(lit(24), lit(0))) is None
    assert one(reading.phone_reading(lit("0755-1234567"))) == "零七五五，一二三四五六七"
    assert one(reading.percent_reading(lit("-2.5%"))) == "百分之负二点五"
    assert one(reading.money_reading(lit("¥19.9"), "narration")) == "十九点九元"
    assert one(reading.operator_words(lit("2+3 = 5, 7-1"))) == "2加3等于5, 7减1"
    assert one(reading.squeeze(lit("  a 　 b...~ "))) == "a b……到"
    assert one(normalize.nfkc(lit("ＡＢ①"))) == "AB1"
    assert one(reading.year_reading(lit("在1999年"))) == "一九九九年"


def test_lexicon_layers_and_matching(spark):
    layers = spark.createDataFrame([("重庆", "甲", None, None, 0), ("重庆", "丙", None, None, 1), ("重庆", "丁", None, None, 2), ("行", "háng", None, None, 0), ("重庆银行", "乙", None, None, 0)], "term string, spoken string, expected string, pinyin string, priority int")
    merged = lexicon.merge_lexicons(layers)
    entries = lexicon.entries_of(merged)
    assert entries["重庆"][0] == "丁" and entries["行"] == (None, None, "háng")
    assert lexicon.resolve("重庆银行重庆", lexicon.Terms(entries))["text"] == "乙丁"
    said = lexicon.resolve("行AI", lexicon.Terms(entries | {"AI": ("A I", "AI", None)}))
    assert said["text"] == "行A I" and said["expected"] == "行AI" and len(said["warnings"]) == 1
    assert lexicon.resolve("KAI AI3", lexicon.Terms({"AI": ("x", None, None)}))["text"] == "KAI x3"


def by_pattern(text, terms):
    """The places of terms by one alternation, longest first."""
    one = lambda t: rf"(?<![A-Za-z]){re.escape(t)}(?![A-Za-z])" if t.isascii() else re.escape(t)
    return [m.span() for m in re.finditer("|".join(one(t) for t in sorted(terms, key=lambda t: (-len(t), t))), text)] if terms else []


def test_automaton_equals_the_alternation():
    rng = random.Random(3)
    for _ in range(1500):
        terms = {"".join(rng.choice("abA一二 1") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(0, 9))}
        text = "".join(rng.choice("abA一二 1é") for _ in range(rng.randrange(0, 30)))
        assert lexicon.Terms(dict.fromkeys(terms, ("x", None, None))).matches(text) == by_pattern(text, terms)


def test_large_lexicons_shipped_and_joined(spark):
    """200,000 terms; texts of sampled terms are compared with the alternation of the terms that they have."""
    rng = random.Random(4)
    terms = list({"".join(rng.choice("abcdefghij一二三四五六七八") for _ in range(rng.randrange(2, 9))) for _ in range(205_000)})[:200_000]
    texts = [(k, "".join(rng.choice([rng.choice(terms), " ", "x", rng.choice("abc一二")]) for _ in range(12))) for k in range(60)] + [(97, None), (98, ""), (99, "z")]
    rows = spark.createDataFrame(texts, "id int, text string")
    layer = spark.createDataFrame([(t, t.upper(), None, None) for t in terms], "term string, spoken string, expected string, pinyin string")
    shipped, joined = ({r["id"]: r["resolved"] for r in lexicon.resolve_rows(rows, layer, "id", limit=n).collect()} for n in (lexicon.SHIPPED, 1000))
    assert shipped == joined and len(shipped) == 63
    for k, text in texts:
        own = [t for t in terms if text and t in text]
        want = by_pattern(text, own) if text else []
        assert [a["term"] for a in shipped[k]["applied"]] == [text[a:b] for a, b in want]
        assert shipped[k]["text"] == (text if not want else "".join(text[a:b].upper() if hit else text[a:b] for a, b, hit in pieces(text, want)))
    with pytest.raises(ValueError, match="isn't shipped"):
        lexicon.entries_of(layer, 1000)


def pieces(text, hits):
    at = 0
    for a, b in hits:
        yield from ((at, a, False), (a, b, True))
        at = b
    yield at, len(text), False


def test_lexicon_violations(one):
    n = F.lit(None).cast("string")
    assert one(lexicon.violations(F.lit(""), n, n, F.lit(" "))) == ["empty_key", "invalid_pinyin"]
    assert one(lexicon.violations(F.lit("a"), n, n, n)) == ["spoken_or_pinyin_required"]


def test_prepare_keeps_layers_apart(spark):
    row = spark.createDataFrame([("¥5 AI",)], "t string").select(lexicon.prepare_text(F.col("t"), {}, "dialogue", {"AI": ("A I", "AI", None)}).alias("p")).first()["p"]
    assert (row["text_original"], row["text_normalized"], row["text_spoken"], row["text_expected"]) == ("¥5 AI", "五块 AI", "五块 A I", "五块 AI")


def test_emotions(one):
    for label, style in (("压怒", "angry"), ("耳语", "whisper"), ("失落", "sad"), ("?", "neutral")):
        assert one(emotion.style_of(F.lit(label))) == style
    assert one(emotion.instruction_of(emotion.style_of(F.lit(None).cast("string")))) == emotion.INSTRUCTIONS["neutral"]


def test_segments(spark):
    text = "他说：“走吧！”然后离开了。\n" + "很长的一句，" * 20 + "结束。"
    rows = segment.segment_rows(spark.createDataFrame([(1, text), (2, "长" * 200), (3, " ")], "i int, text string"), max_chars=40).orderBy("i", "pos").collect()
    parts = [r["segment"] for r in rows if r["i"] == 1]
    assert "".join(parts) == text and max(map(len, parts)) <= 40 and parts[0] == "他说：“走吧！”"
    assert [r["error_code"] for r in rows if r["i"] > 1] == ["clause_too_long", "empty_text"]
    assert rows[0]["segment_id"] == "segment_0001"
    with pytest.raises(ValueError):
        segment.segments(F.col("text"), 10)
