"""Spoken-text normalization with warnings, over Arrow batches.

A text is a list of spans, plain or protected. A rule rewrites plain spans only; what it can't read
becomes a protected span and splits its neighbours. No placeholder characters are used.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from datetime import date

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from sonarlake.functions.reading import CURRENCY, DAY, DIGITS, DOLLAR, HOUR, HUNDRED, LONGEST, MINUS, MINUTE, MONTH, MYRIAD, OPERATORS, PERCENT, POINT, SECOND, SHARP, TEN, THOUSAND, YEAR, YI

# Version, profiles, warnings and patterns.
VERSION = "1"
PROFILES = ("none", "dialogue", "narration")
REVIEW, BAD_DATE = "Review spoken form of identifier: {}", "Invalid date requires correction: {}"
IDENTIFIERS = r"https?://[^\s，。！？；]+|[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}|[A-Za-z][A-Za-z0-9_.-]*"
DATE = r"(\d{4})[-/年](\d{1,2})[-/月](\d{1,2})日?"
TIME = r"(?<!\d)(\d{1,2}):(\d{2})(?::(\d{2}))?(?!\d)"
MOBILE, LANDLINE = r"(?<!\d)(1[3-9]\d{9})(?!\d)", r"(?<!\d)(0\d{2,3})-(\d{7,8})(?!\d)"
NUMBER = r"-?\d+(?:\.\d+)?"

RESULT = T.StructType([
    T.StructField("original", T.StringType()), T.StructField("normalized", T.StringType()), T.StructField("profile", T.StringType()),
    T.StructField("version", T.StringType()), T.StructField("warnings", T.ArrayType(T.StringType())), T.StructField("changed", T.BooleanType()),
    T.StructField("error_code", T.StringType()),
])

_NAMES = str.maketrans("0123456789", DIGITS)


def digits(value: str) -> str:
    return value.translate(_NAMES)


def _small(n: int) -> str:
    """1 to 9999: name every place, then close up the zeros."""
    places = "".join((DIGITS[int(c)] + unit) if c != "0" else "零" for c, unit in zip(f"{n:04d}", (THOUSAND, HUNDRED, TEN, ""), strict=True))
    return re.sub("^一十", TEN, re.sub("零+", "零", places).strip("零"))


def integer(value: str) -> str:
    n = int(value)
    if n < 0:
        return MINUS + integer(str(-n))
    if n == 0:
        return "零"
    if n >= 10**LONGEST:
        return digits(value)
    out, rest = "", n
    for size, unit in ((10**8, YI), (10**4, MYRIAD)):
        head, tail = divmod(rest, size)
        if head:
            out += ("零" if out and rest < size * 1000 else "") + _small(head) + unit
            rest = tail
    if rest:
        out += ("零" if out and rest < 1000 else "") + _small(rest)
    return out


def number(value: str) -> str:
    whole, dot, fraction = value.lstrip("+-").partition(".")
    return (MINUS if value[0] == "-" else "") + integer(whole) + (POINT + digits(fraction) if dot else "")


def _date(m: re.Match, warnings: list[str]) -> str | None:
    y, mo, d = (int(x) for x in m.groups())
    try:
        date(y, mo, d)
    except ValueError:
        warnings.append(BAD_DATE.format(m[0]))
        return None
    return digits(str(y)) + YEAR + integer(str(mo)) + MONTH + integer(str(d)) + DAY


def _time(m: re.Match, warnings: list[str]) -> str | None:
    h, mi, s = (int(x) if x else None for x in m.groups())
    if h > 23 or mi > 59 or (s or 0) > 59:
        return None
    minutes = SHARP if not mi else ("零" if mi < 10 else "") + integer(str(mi)) + MINUTE
    return integer(str(h)) + HOUR + minutes + ("" if s is None else integer(m[3]) + SECOND)


Read = Callable[[re.Match, list[str]], str | None]


def _rules(profile: str) -> list[tuple[re.Pattern, Read]]:
    """Patterns in order, with what reads a match; None protects it."""
    rules: list[tuple[str, Read]] = [
        (DATE, _date),
        (r"(?<!\d)(\d{4})年", lambda m, w: digits(m[1]) + YEAR),
        (TIME, _time),
        (MOBILE, lambda m, w: digits(m[1])),
        (LANDLINE, lambda m, w: digits(m[1]) + "，" + digits(m[2])),
        (rf"({NUMBER})%", lambda m, w: PERCENT + number(m[1])),
        (rf"[¥￥]({NUMBER})", lambda m, w: number(m[1]) + CURRENCY[profile]),
        (rf"\$({NUMBER})", lambda m, w: number(m[1]) + DOLLAR),
        (r"(?<=\d)\s*([+×÷=−])\s*(?=-?\d)", lambda m, w: OPERATORS[m[1]]),
        (r"(?<=\d)-(?=\d)", lambda m, w: OPERATORS["−"]),
        (NUMBER, lambda m, w: number(m[0])),
    ]
    return [(re.compile(p), read) for p, read in rules]


_PROFILE_RULES = {p: _rules(p) for p in ("dialogue", "narration")}
_IDENTIFIERS, _DIGIT, _SPACES = re.compile(IDENTIFIERS), re.compile(r"\d"), re.compile(r"\s+")
#: What a rule may change, besides white space.
_RULED = re.compile(r"\d|\.\.\.|~")


def _apply(spans: list[tuple[str, bool]], pattern: re.Pattern, read: Read, warnings: list[str]) -> list[tuple[str, bool]]:
    out: list[tuple[str, bool]] = []
    for text, kept in spans:
        if kept:
            out.append((text, True))
            continue
        done, plain = 0, ""
        for m in pattern.finditer(text):
            plain += text[done : m.start()]
            done = m.end()
            spoken = read(m, warnings)
            if spoken is None:
                warnings.append(REVIEW.format(m[0]))
                out += [(plain, False), (m[0], True)]
                plain = ""
            else:
                plain += spoken
        out.append((plain + text[done:], False))
    return out


def _tidy(plain: str) -> str:
    return _SPACES.sub(" ", plain)


def _spoken(text: str, profile: str) -> tuple[str, list[str]]:
    """The spoken form and the warnings, in the order of the rules that gave them.

    Identifiers cut the text into plain parts. Most are a blank or have no digit, which only one rule or none concerns.
    """
    text = text if text.isascii() else unicodedata.normalize("NFKC", text)
    names = _IDENTIFIERS.findall(text)
    first = [REVIEW.format(n) for n in names]
    if not _RULED.search(text):  # identifiers have no white space, so all of it is plain
        return " ".join(text.split()), first
    rules = _PROFILE_RULES[profile]
    warnings: list[list[str]] = [[] for _ in rules]
    spans: list[tuple[str, bool]] = []
    for k, plain in enumerate(_IDENTIFIERS.split(text)):
        part = [(plain, False)]
        if _DIGIT.search(plain):  # all rules need a digit
            for w, (pattern, read) in zip(warnings, rules, strict=True):
                part = _apply(part, pattern, read, w)
        spans += part
        if k < len(names):
            spans.append((names[k], True))
    out = [t if kept or t == " " else _tidy(t) for t, kept in spans]
    filled = [i for i, t in enumerate(out) if t]
    for ends, strip in ((filled, str.lstrip), (filled[::-1], str.rstrip)):
        for i in ends:
            if spans[i][1]:
                break
            out[i] = strip(out[i])
            if out[i]:
                break
    read = "".join(t if kept or t == " " else t.replace("...", "……").replace("~", "到") for t, (_, kept) in zip(out, spans, strict=True))
    return read, [*first, *(w for each in warnings for w in each)]


def normalize(text: str | None, profile: str | None) -> dict:
    """All fields of RESULT; ``error_code`` is set for an unknown profile or a blank text."""
    blank = {"original": text, "normalized": None, "profile": profile, "version": VERSION, "warnings": [], "changed": None, "error_code": "configuration_error"}
    if profile not in PROFILES or not text or not text.strip():
        return blank
    if profile == "none":
        return blank | {"normalized": text, "changed": False, "error_code": None}
    spoken, warnings = _spoken(text, profile)
    return blank | {"normalized": spoken, "warnings": warnings, "changed": spoken != text, "error_code": None}


_ARROW_RESULT = to_arrow_type(RESULT)


def results(texts: pa.Array, profiles: pa.Array) -> pa.StructArray:
    """RESULT of a batch, column by column; the texts themselves are handed through."""
    found = [normalize(t, p) for t, p in zip(texts.to_pylist(), profiles.to_pylist(), strict=True)]
    column = lambda f: texts if f.name == "original" else profiles if f.name == "profile" else pa.array([r[f.name] for r in found], f.type)
    return pa.StructArray.from_arrays([column(f).cast(f.type) for f in _ARROW_RESULT], fields=list(_ARROW_RESULT))


@F.arrow_udf(RESULT)
def _results(texts: pa.Array, profiles: pa.Array) -> pa.Array:
    return results(texts, profiles)


_normalize = _results.asNondeterministic()


@F.arrow_udf(T.StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    return pc.utf8_normalize(texts, "NFKC")


def normalize_text(text: Column, profile: Column | str = "dialogue") -> Column:
    """The RESULT struct. Marked non-deterministic so that a filter on a field doesn't run it twice."""
    return _normalize(text, F.lit(profile) if isinstance(profile, str) else profile)


def nfkc(text: Column) -> Column:
    return _nfkc(text)


def protected_tokens(text: Column) -> Column:
    """The identifiers that normalization would protect, in order."""
    return F.regexp_extract_all(text, F.lit(r"(?U)" + IDENTIFIERS), F.lit(0))
