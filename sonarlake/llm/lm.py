"""A bidirectional window network over the words of a corpus, trained in numpy.

The network predicts each word from the WINDOW words on its left and right: their embeddings are added up (the
outer ones at half weight) into a hidden layer, whose product with the word's output vector says how much
likelier the word is there than anywhere: log p(word | window) = log p(word) + advantage. The WORDS most frequent
words have vectors of their own; every other word has the vectors of one of BUCKETS hash buckets and, within its
bucket, the share of one of the bucket's distinct words.

Training is noise-contrastive: a word must be told from NOISE words drawn at random, which makes the advantage
self-normalising. All windows of all documents are trained on, where they are: each task runs row-wise Adagrad over
its own texts from the same start, and the tasks' vectors are averaged, each row weighted by how often the task saw
the word. Averages are taken in two rounds of bounded groups; the driver gets the average only, which is as large
as the vocabulary (a constant), and so is what is broadcast.

Defined cases: null and empty texts have no words and train nothing. Words of equal count are ranked by their
bytes. Repeated rows count each. Very long texts are worked on window by window. An empty table trains nothing.
Only the text column is read, so other columns can have any names.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonarlake.llm.session import checkpointed, map_slices
from sonarlake.llm.text import words_lower

#: Words with vectors of their own, and buckets of the others; index 0 is the boundary of a text.
WORDS, BUCKETS = 16_384, 8_192
V = 1 + WORDS + BUCKETS
WINDOW, HIDDEN, NOISE, BATCH, RATE, SEED = 2, 8, 3, 16_384, 1.0, 11
#: Distinct words that a task counts before it hands the counts on; rows of a block of vectors; models averaged at once.
WORDS_HELD, BLOCK, FAN = 200_000, 512, 256
#: Tokens of a shard, which is learned by itself.
SHARD_TOKENS = 4_000_000
#: Words that a task knows the index of at once.
MEMO = 400_000
_OUTER = np.float32(0.5)
_EDGE = np.zeros(WINDOW, np.uint64)


def bucket_of(word: bytes) -> int:
    """Spark's crc32 gives the same."""
    return 1 + WORDS + zlib.crc32(word) % BUCKETS


class Tokens(dict):
    """Word to token: 48 bits of the word's hash, then its index; a bounded memo."""

    def __init__(self, frequent: list[bytes]):
        super().__init__()
        self.index = {w: 1 + k for k, w in enumerate(frequent)}

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word) >> 16 << 16 | (self.index.get(word) or bucket_of(word))
        return out

    def of(self, text: str | None) -> np.ndarray:
        words = words_lower(text)
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def index_of(tokens: np.ndarray) -> np.ndarray:
    return (tokens & np.uint64(0xFFFF)).astype(np.uint16)


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """w, n: all words of the corpus and how often each is there."""

    def count(batches):
        held: Counter = Counter()

        def emit():
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["w", "n"])
            held.clear()
            return out

        for b in batches:
            for t in b.column(0).to_pylist():
                held.update(words_lower(t))
            if len(held) > WORDS_HELD:
                yield emit()
        yield emit()

    return map_slices(docs.select(F.col(text).cast("string")), count, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """frequent: words by falling count. counts and distinct: occurrences and words of each index. tokens: of the corpus."""

    frequent: list[bytes]
    counts: np.ndarray
    distinct: np.ndarray

    @property
    def tokens(self) -> int:
        return int(self.counts.sum())

    @property
    def log_shares(self) -> np.ndarray:
        """log p(index), with half a count more for each."""
        out = np.log((self.counts + 0.5) / (self.counts.sum() + 0.5 * V)).astype(np.float32)
        return out

    @property
    def spread(self) -> np.ndarray:
        """log of how many words share an index."""
        return np.log(np.maximum(self.distinct, 1)).astype(np.float32)


def vocabulary(docs: DataFrame, text: str = "text") -> Vocabulary:
    counts = checkpointed(count_words(docs, text))
    level = F.floor(16 * F.log2("n")).cast("int")
    # Sixteen levels an octave: a few hundred rows tell from which count on there are words enough.
    left, least = WORDS, 0
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect(), reverse=True):
        least, left = r["level"], left - r["words"]
        if left <= 0:
            break
    top = counts.where(level >= least).orderBy(F.col("n").desc(), "w").limit(WORDS)
    rows = sorted(((-r["n"], bytes(r["w"])) for r in top.collect()))
    n, distinct = np.zeros(V, np.int64), np.zeros(V, np.int64)
    n[1 : 1 + len(rows)] = [-r[0] for r in rows]
    distinct[1 : 1 + len(rows)] = 1
    # All words by bucket, less the frequent ones, so nothing has to meet.
    buckets = counts.groupBy((F.crc32("w") % BUCKETS).alias("b")).agg(F.sum("n").alias("n"), F.count("*").alias("words"))
    for r in buckets.collect():
        n[1 + WORDS + r["b"]], distinct[1 + WORDS + r["b"]] = r["n"], r["words"]
    for m, w in rows:
        n[bucket_of(w)] += m
        distinct[bucket_of(w)] -= 1
    return Vocabulary([w for _, w in rows], n, distinct)


def start() -> np.ndarray:
    """The vectors that every shard starts from: by index left, right, and output with a bias."""
    out = np.zeros((V, 3 * HIDDEN + 1), np.float32)
    out[:, : 2 * HIDDEN] = np.random.default_rng(SEED).normal(0, 0.3, (V, 2 * HIDDEN))
    return out


def hidden(rows: np.ndarray) -> np.ndarray:
    """The hidden layer at all places but the first and last two, from the vectors of all places."""
    left, right = rows[:, :HIDDEN], rows[:, HIDDEN : 2 * HIDDEN]
    h = left[1:-3] + right[3:-1]
    h += _OUTER * (left[:-4] + right[4:])
    return np.tanh(h, out=h)


def advantages(table: np.ndarray, seq: np.ndarray) -> np.ndarray:
    """How much likelier each word is in its window than anywhere, as a logarithm; seq has two boundaries at both ends."""
    out = np.zeros(len(seq), np.float32)
    for at in range(0, len(seq) - 2 * WINDOW, BATCH):
        rows = table[seq[at : at + BATCH + 2 * WINDOW]]
        h, own = hidden(rows), rows[WINDOW:-WINDOW, 2 * HIDDEN :]
        out[at + WINDOW : at + WINDOW + len(h)] = np.einsum("ij,ij->i", h, own[:, :HIDDEN]) + own[:, HIDDEN]
    return out


class Trainer:
    """One shard's pass over its windows."""

    def __init__(self, seed: int):
        self.table, self.rng = start(), np.random.default_rng([SEED, seed])
        self.squares = np.full(V, 1e-3, np.float32)
        self.seen = np.zeros(V, np.int64)

    def step(self, seq: np.ndarray) -> None:
        """Trains on the words of seq but the first and last two, which are seen as neighbours."""
        w = seq[WINDOW:-WINDOW]
        real = w > 0
        if not real.any():
            return
        rows = self.table[seq]
        h, own = hidden(rows), rows[WINDOW:-WINDOW, 2 * HIDDEN :]
        vectors, shift = np.ascontiguousarray(own[:, :HIDDEN]), np.float32(math.log(NOISE))
        grad = np.zeros_like(rows)
        out = grad[WINDOW:-WINDOW, 2 * HIDDEN :]
        odds = np.exp(np.minimum(shift - np.einsum("ij,ij->i", h, vectors) - own[:, HIDDEN], 30))
        error = real * (1 / (1 + odds) - 1)
        dh = error[:, None] * vectors
        np.multiply(error[:, None], h, out=out[:, :HIDDEN])
        out[:, HIDDEN] = error
        # The noise of a place are the words some places on, so each word is noise about as often as it is right.
        bias = np.ascontiguousarray(own[:, HIDDEN])
        for by in self.rng.integers(1, max(2, len(w) // 4), NOISE).tolist():
            here, there = slice(0, len(w) - by), slice(by, None)
            odds = np.einsum("ij,ij->i", h[here], vectors[there])
            odds += bias[there]
            np.exp(np.minimum(shift - odds, 30), out=odds)
            error = (real[here] & real[there]) / (1 + odds)
            dh[here] += error[:, None] * vectors[there]
            out[there, :HIDDEN] += error[:, None] * h[here]
            out[there, HIDDEN] += error
        dh *= 1 - h * h
        outer = _OUTER * dh
        grad[1:-3, :HIDDEN] = dh
        grad[:-4, :HIDDEN] += outer
        grad[3:-1, HIDDEN : 2 * HIDDEN] = dh
        grad[4:, HIDDEN : 2 * HIDDEN] += outer
        order = np.argsort(seq, kind="stable")
        ordered = seq[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        used = ordered[first]
        sums = np.add.reduceat(grad[order], first, axis=0)
        self.squares[used] += np.einsum("ij,ij->i", sums, sums)
        self.table[used] -= (np.float32(RATE) / np.sqrt(self.squares[used]))[:, None] * sums
        self.seen += np.bincount(w, minlength=V)

    def train(self, seq: np.ndarray) -> None:
        for at in range(0, len(seq) - 2 * WINDOW, BATCH):
            self.step(seq[at : at + BATCH + 2 * WINDOW])


def _packed(seen: np.ndarray, rows: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(seen.astype(np.float32).tobytes() + rows.astype(np.float16).tobytes())


def _average(key, group):
    """The rows of a block averaged over shards, each weighted by how often it saw the word; in the order of shards, as sums depend on it."""
    total, sums = 0.0, 0.0
    for body in group.sort_by("part").column("body"):
        raw = zstandard.ZstdDecompressor().decompress(body.as_py())
        size = len(raw) // (4 + 2 * (3 * HIDDEN + 1))
        seen = np.frombuffer(raw, np.float32, size).astype(np.float64)
        total = total + seen
        sums = sums + seen[:, None] * np.frombuffer(raw, np.float16, offset=4 * size).reshape(size, -1)
    mean = sums / np.maximum(total, 1)[:, None]
    return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "block": pa.array([key[1].as_py()], pa.int32()), "body": pa.array([_packed(total, mean)], pa.binary())})


def sharded(docs: DataFrame, shards: int, text: str = "text", id: str | None = None) -> DataFrame:
    """(shard, id, text) by shards, in a fixed order, however the rows lie: a hash of id and text deals them, so copies are spread by their ids."""
    own = (F.lit(None) if id is None else F.col(id)).cast("long")
    rows = docs.select(own.alias("id"), F.col(text).cast("string").alias("text")).withColumn("h", F.xxhash64("id", "text"))
    rows = rows.withColumn("shard", F.pmod("h", F.lit(shards)))
    return rows.repartition("shard").sortWithinPartitions("shard", "h", "id", "text").select("shard", "id", "text")


def shards_of(tokens: int) -> int:
    return max(1, -(-tokens // SHARD_TOKENS))


def train(docs: DataFrame, vocab: Vocabulary, text: str = "text", id: str | None = None) -> np.ndarray:
    """The averaged vectors; words that nothing was learned of keep those of the start.

    A shard of the corpus is learned by itself, with a seed of its own, whatever partitions it lies in.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(vocab.frequent)  # WORDS words
    shards = shards_of(vocab.tokens)

    def emit(trainer, shard):
        starts = [at for at in range(0, V, BLOCK) if trainer.seen[at : at + BLOCK].any()]
        bodies = [_packed(trainer.seen[at : at + BLOCK], trainer.table[at : at + BLOCK]) for at in starts]
        return pa.RecordBatch.from_arrays([pa.array([shard] * len(starts), pa.int64()), pa.array([at // BLOCK for at in starts], pa.int32()), pa.array(bodies, pa.binary())], ["part", "block", "body"])

    def work(batches):
        memo, shard, trainer = Tokens(shipped.value), None, None
        parts, held = [_EDGE], 0

        def learn():
            nonlocal parts, held
            if held:
                trainer.train(index_of(np.concatenate(parts)))
            parts, held = [_EDGE], 0

        for b in batches:
            for s, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if s != shard:
                    if trainer:
                        learn()
                        yield emit(trainer, shard)
                    shard, trainer = s, Trainer(s)
                tokens = memo.of(t)
                if len(tokens):
                    parts += [tokens, _EDGE]
                    held += len(tokens) + WINDOW
                if held >= 8 * BATCH:
                    learn()
        if trainer:
            learn()
            yield emit(trainer, shard)

    kind = "part long, block int, body binary"
    found, n = map_slices(sharded(docs, shards, text, id).select("shard", "text"), work, kind), shards
    while True:
        found, n = found.groupBy(F.floor(F.col("part") / FAN).alias("team"), "block").applyInArrow(_average, kind), -(-n // FAN)
        if n == 1:
            break
    out = start()
    for r in found.collect():  # V / BLOCK rows at most
        raw = zstandard.ZstdDecompressor().decompress(bytes(r["body"]))
        size = len(raw) // (4 + 2 * (3 * HIDDEN + 1))
        seen = np.frombuffer(raw, np.float32, size) > 0
        rows = np.frombuffer(raw, np.float16, offset=4 * size).reshape(size, -1)
        at = r["block"] * BLOCK
        out[at : at + size][seen] = rows[seen]
    return out


@dataclass
class Model:
    """What the workers need: all of it is as large as the vocabulary."""

    frequent: list[bytes]
    log_shares: np.ndarray
    spread: np.ndarray
    table: np.ndarray

    @classmethod
    def fit(cls, docs: DataFrame, vocab: Vocabulary, text: str = "text", id: str | None = None) -> Model:
        return cls(vocab.frequent, vocab.log_shares, vocab.spread, train(docs, vocab, text, id))

    def logs(self, seq: np.ndarray) -> np.ndarray:
        """Log-probabilities of the words of seq (indexes, two boundaries at both ends and between texts)."""
        return np.minimum(self.log_shares[seq] + advantages(self.table, seq), 0) - self.spread[seq]
