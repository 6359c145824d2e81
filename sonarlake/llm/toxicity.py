"""Toxic passages by maximum-scoring segment search over token log-odds.

Training counts in how many different surroundings (the words on both sides) each token stands in toxic and in clean
labelled documents, so a text that was copied often, also with small changes, counts once. Tokens whose log-odds under
a Dirichlet prior (the pooled distribution) are significant and large keep them, whichever side they speak for; all others
are one class with the log-odds of that class. Scores are thus log-likelihood ratios of one distribution against
another, and clean text drifts down. A linear-time scan finds every maximal-scoring segment of a text (all of them, not
the best only); a segment's score is made comparable between texts by extreme-value statistics: under the clean
distribution the best of a text of m tokens follows a Gumbel law with parameters lambda (the root of
E[exp(lambda s)] = 1) and K, both from the same counts. A text's segments add up as the log of the survival of their
normalised scores, and a logistic curve fitted to the training rows maps that sum to 0..1.

A token is a lower-cased run of letters; in scripts that are written without spaces, each pair of letters of a run.
Its class is its stem (the first STEM letters), so the inflected forms of a rare word meet, unless the whole word
stands in toxic documents significantly more or less often than the other words of its stem: then it is a class of its
own. So a word isn't diluted by others that begin alike, and each token counts for one class only.
The labelled sample is bounded by ``max_labelled`` rows, taken in the order of a hash of the id, and the classifier by
its MAX_TOKENS most significant tokens; the scan covers every whole text. Totals of surroundings are estimated from
those whose hash falls in one of TOTALS parts.

Defined cases: null and empty texts have no segment and get the score of a text without evidence. Very long texts are
scanned whole, in linear time. Segments of equal scores are all found; tokens of equal significance are ranked by
their letters. Rows that repeat are each scored; in training a repeated labelled row adds no surroundings. Labels that
are null, or whose document is missing, are left out; a document with both labels counts for both. A null id is never
learned from, and its document is scored like any other. Without toxic or clean rows to learn from, every score is 0.
An empty table gives no rows. A column named like the score is replaced; all others are kept.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonarlake.llm.session import checkpointed, map_slices
from sonarlake.llm.text import stable_hash

#: Labelled rows that training reads at most, the classifier's tokens, the least z of a kept token, and of one that is looked at.
MAX_LABELLED, MAX_TOKENS, MIN_Z, LIKELY_Z = 30_000, 100_000, 3.3, 2.0
#: Least log-odds of a kept class: with many counts a difference is significant long before it tells toxic from clean.
MIN_ODDS = 1.0
TOTALS, STEM = 16, 4
#: Words whose weight a task knows at once.
MEMO = 400_000
PRIOR = 200.0
#: Segments count from this normalised score on.
MIN_NORMALISED = 0.0
THRESHOLD = 0.7

_LETTERS = re.compile(r"[^\W\d_]+")
#: Letters of scripts without spaces: Thai, Lao, Khmer, Myanmar, kana and Han.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")


def hash_of(text: str) -> int:
    return stable_hash(text.encode("utf-8", "replace")) - (1 << 63)


def tokens_of(text: str | None) -> list[str]:
    words = _LETTERS.findall((text or "").lower())
    if text is None or text.isascii() or not _UNSPACED.search(text):
        return words
    out = []
    for w in words:
        out += [w[k : k + 2] for k in range(max(1, len(w) - 1))] if _UNSPACED.search(w) else [w]
    return out


class Classes(dict):
    """Word to its class, in a bounded memo; ``own``: words that are a class of their own."""

    def __init__(self, own: set[str]):
        super().__init__()
        self.own = own

    def __missing__(self, word: str) -> str:
        if len(self) > MEMO:
            self.clear()
        self[word] = out = word if word in self.own else word[:STEM] + "-"
        return out


def segments(scores: Iterable[tuple[int, float]], gap: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last, score), in linear time.

    scores: the (place, score) of tokens that differ from the background, by place; each token between
    them costs ``gap``. Each candidate keeps the totals before and after it and merges with earlier ones
    while that raises the sum.
    """
    total, at = 0.0, -1
    found: list[list[float]] = []  # first, last, total before, total after
    for place, s in scores:
        total -= gap * (place - at - 1)
        at = place
        before, total = total, total + s
        if s <= 0:
            continue
        new = [place, place, before, total]
        while found:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = int(found[j][4])
            if j < 0 or found[j][3] >= new[3]:
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
        else:
            j = -1
        found.append([*new, j])
    return [(int(f[0]), int(f[1]), f[3] - f[2]) for f in found]


@dataclass
class ToxicityModel:
    weights: dict[str, float] = field(default_factory=dict)
    own: set[str] = field(default_factory=set)
    gap: float = 1.0
    lam: float = 1.0
    k: float = 0.1
    a: float = 0.0
    b: float = 0.0
    fitted: bool = False

    def __post_init__(self):
        self.classes = Classes(self.own)

    def __reduce__(self):
        return ToxicityModel, (self.weights, self.own, self.gap, self.lam, self.k, self.a, self.b, self.fitted)

    def passages(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """Tokens of the text, and its significant segments with their normalised scores."""
        toks = tokens_of(text)
        get, classes = self.weights.get, self.classes
        hits = [(i, w) for i, t in enumerate(toks) if (w := get(classes[t])) is not None]
        m = max(len(toks), 1)
        found = [(i, j, self.lam * s - math.log(self.k * m)) for i, j, s in segments(hits, self.gap)] if hits else []
        return len(toks), [f for f in found if f[2] > MIN_NORMALISED]

    def evidence(self, text: str | None) -> float:
        """Sum over significant segments of -log P(best segment of background >= score)."""
        return sum(-math.log(max(-math.expm1(-math.exp(-s)), 1e-300)) if s < 600 else s for _, _, s in self.passages(text)[1])

    def score(self, text: str | None) -> float:
        if not self.fitted:
            return 0.0
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.a * math.log1p(self.evidence(text)) + self.b))))


def _gumbel(dist: list[tuple[float, float]]) -> tuple[float, float]:
    """lambda and a K for a score distribution [(score, probability)] with negative mean."""
    value = lambda x: sum(p * math.exp(min(x * s, 700)) for s, p in dist) - 1
    low, high = 1e-6, 1e-3
    while value(high) < 0 and high < 1e3:
        low, high = high, high * 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    drift = -sum(p * s for s, p in dist)
    gain = sum(p * s * math.exp(min(high * s, 700)) for s, p in dist)
    return high, max(1e-9, min(1.0, drift * drift / max(gain, 1e-12) * high))


def train(docs: DataFrame, labels: DataFrame, usable=None, id: str = "doc_id", text: str = "text", label: str = "toxic", max_labelled: int = MAX_LABELLED) -> ToxicityModel:
    """usable: a predicate over the id that says which labelled rows may be learned from."""
    rows = labels.select(F.col(id).alias("_id"), F.col(label).cast("int").alias("_y")).where("_id IS NOT NULL AND _y IN (0, 1)")
    if usable is not None:
        rows = rows.where(usable(F.col("_id")))
    # A bounded sample: the documented bound applies to labelled rows only.
    rows = rows.orderBy(F.xxhash64("_id"), "_id", "_y").limit(max_labelled)
    sample = F.broadcast(rows).join(docs.select(F.col(id).alias("_id"), F.col(text).alias("_t")), "_id").select("_y", "_t")

    def count(batches):
        for b in batches:
            counts = {0: Counter(), 1: Counter()}
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts[y].update(set(tokens_of(t)))
            out = [(y, w, n) for y in (0, 1) for w, n in counts[y].items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.string()), pa.array([r[2] for r in out], pa.int64())], ["y", "w", "n"])

    # Documents of each token tell which words part from their stem and which classes are worth a look; their surroundings decide.
    per = map_slices(sample, count, "y int, w string, n long").groupBy("w").agg(
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("c")
    )
    per = checkpointed(per)
    totals = per.agg(F.sum("t"), F.sum("c")).first()
    if not totals[0] or not totals[1]:
        return ToxicityModel()
    nt, nc = float(totals[0]), float(totals[1])
    own = {r["w"] for r in _apart(per).orderBy(F.abs("z").desc(), "w").limit(MAX_TOKENS).collect()}
    mine = per.join(F.broadcast(docs.sparkSession.createDataFrame([(w,) for w in sorted(own)], "o string")), F.col("w") == F.col("o"), "left")
    classes = mine.groupBy(F.coalesce("o", F.concat(F.substring("w", 1, STEM), F.lit("-"))).alias("w")).agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    likely = {r["w"] for r in _significant(classes, nt, nc, LIKELY_Z).orderBy(F.abs("z").desc(), "w").limit(MAX_TOKENS).collect()}
    seen = checkpointed(_contexts(sample, likely, own))
    nt, nc = (TOTALS * float(x or 0) for x in seen.where("w IS NULL").select("t", "c").first() or (0, 0))
    got = _significant(seen.where("w IS NOT NULL"), nt, nc, MIN_Z).orderBy("w").where(F.abs("o") >= MIN_ODDS).collect() if nt and nc else []
    if not any(r["o"] > 0 for r in got):
        return ToxicityModel()
    model = replace(weigh([(r["w"], r["t"], r["c"], r["o"]) for r in got], nt, nc), own=own)
    # Calibration on the same bounded sample, as a histogram of evidence: no text reaches the driver.
    scored = model

    def measure(batches):
        for b in batches:
            c = Counter((y, round(math.log1p(scored.evidence(t)), 1)) for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            keys = list(c)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.float64()), pa.array([c[k] for k in keys], pa.int64())], ["y", "e", "n"])

    bins = map_slices(sample, measure, "y int, e double, n long").groupBy("y", "e").agg(F.sum("n").alias("n")).collect()
    model.a, model.b = _logistic([(r["e"], r["y"], r["n"]) for r in bins])
    model.fitted = True
    return model


def weigh(got: list[tuple[str, int, int, float]], nt: float, nc: float) -> ToxicityModel:
    """The model of tokens (token, toxic count, clean count, log-odds) out of ``nt`` toxic and ``nc`` clean counts in all."""
    model = ToxicityModel({w: o for w, _, _, o in got})
    share = lambda n, total: min(max(n / total, 1e-9), 1 - 1e-9)
    toxic, clean = share(sum(t for _, t, _, _ in got), nt), share(sum(c for _, _, c, _ in got), nc)
    model.gap = max(1e-3, math.log(1 - clean) - math.log(1 - toxic))
    # The clean distribution of scores; a token that clean text lacks has the prior's share of it.
    dist = [(o, share(c + PRIOR * (t + c) / (nt + nc), nc + PRIOR)) for _, t, c, o in got]
    dist.append((-model.gap, max(1e-9, 1 - sum(p for _, p in dist))))
    model.lam, model.k = _gumbel(dist)
    return model


def _apart(per: DataFrame) -> DataFrame:
    """Words (w, z) whose odds of toxic against clean documents differ from those of the other words of their stem."""
    stem = F.substring("w", 1, STEM)
    whole = per.groupBy(stem.alias("stem")).agg(F.sum("t").alias("st"), F.sum("c").alias("sc"))
    rows = per.withColumn("stem", stem).join(whole, "stem")
    a, b, c, d = (x + 0.5 for x in (F.col("t"), F.col("c"), F.col("st") - F.col("t"), F.col("sc") - F.col("c")))
    z = (F.log(a / b) - F.log(c / d)) / F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    return rows.where("st + sc > t + c").select("w", z.alias("z")).where(F.abs("z") >= MIN_Z)


def _significant(counts: DataFrame, nt: float, nc: float, least: float) -> DataFrame:
    """Tokens (w, t, c) whose log-odds ``o`` of toxic against clean are significant."""
    t, c = F.col("t"), F.col("c")
    # The half keeps the variance of a token that one side lacks in bounds.
    prior = 0.5 + PRIOR * (t + c) / (nt + nc)
    odds = F.log((t + prior) / F.greatest(F.lit(0.5), nt + PRIOR - t - prior)) - F.log((c + prior) / F.greatest(F.lit(0.5), nc + PRIOR - c - prior))
    z = odds / F.sqrt(1 / (t + prior) + 1 / (c + prior))
    return counts.select("w", "t", "c", odds.alias("o"), z.alias("z")).where(F.abs("z") >= least)


def _contexts(sample: DataFrame, likely: set[str], own: set[str]) -> DataFrame:
    """For each likely class (w) in how many different surroundings its tokens stand on either side: t, c. The row without w
    has those of all tokens whose hash falls in one of TOTALS parts."""

    def work(batches):
        classes = Classes(own)
        for b in batches:
            rows = set()
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = ["", *tokens_of(t), ""]
                for i in range(1, len(words) - 1):
                    around = words[i - 1] + " " + words[i] + " " + words[i + 1]
                    if (known := classes[words[i]]) in likely:
                        rows.add((y, known, hash_of(around)))
                    part = zlib.crc32(around.encode("utf-8", "replace"))
                    if part % TOTALS == 0:
                        rows.add((y, None, part))
            out = list(rows)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int32(), pa.string(), pa.int64()))], ["y", "w", "x"])

    once = map_slices(sample, work, "y int, w string, x long").distinct()
    return once.groupBy("w").agg(F.count_if(F.col("y") == 1).alias("t"), F.count_if(F.col("y") == 0).alias("c"))


def _logistic(bins: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope and intercept by Newton steps, with a weak prior that keeps separated data finite."""
    a, b = 1.0, -1.0
    n = sum(x[2] for x in bins)
    ridge = 1e-4 * n
    for _ in range(60):
        ga, gb, haa, hab, hbb = -ridge * a, -ridge * b, ridge, 0.0, ridge
        for e, y, c in bins:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a * e + b))))
            ga, gb = ga + c * (y - p) * e, gb + c * (y - p)
            v = c * p * (1 - p)
            haa, hab, hbb = haa + v * e * e, hab + v * e, hbb + v
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a + max(-2.0, min(2.0, da)), b + max(-2.0, min(2.0, db))
        if abs(da) + abs(db) < 1e-9:
            break
    return a, b


def with_scores(docs: DataFrame, model: ToxicityModel, text: str = "text", name: str = "score") -> DataFrame:
    """docs with a score from 0 to 1; all other columns stay."""
    kept = [c for c in docs.columns if c != name]
    place = kept.index(text)

    def work(batches):
        for b in batches:
            scores = pa.array([model.score(t) for t in b.column(place).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, scores], [*kept, name])

    narrow = docs.select(*kept)
    return map_slices(narrow, work, T.StructType([*narrow.schema.fields, T.StructField(name, T.DoubleType())]))


def passages(docs: DataFrame, model: ToxicityModel, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per significant passage: id, first_token, last_token, normalised score."""
    def work(batches):
        for b in batches:
            out = [(i, *p) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for p in model.passages(t)[1]]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], b.schema.field(0).type), *(pa.array([r[k] for r in out], t) for k, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.float64())))], [id, "first_token", "last_token", "score"])

    extra = [T.StructField("first_token", T.LongType()), T.StructField("last_token", T.LongType()), T.StructField("score", T.DoubleType())]
    return map_slices(docs.select(id, text), work, T.StructType([docs.schema[id], *extra]))
