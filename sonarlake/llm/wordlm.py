"""Masked pseudo-likelihood of documents under a window network, and beside it with a memory of the corpus.

The window network (``lm``) gives each word its probability from the words on both sides, the word itself masked; a
document's score is the sum of the log-probabilities of its words. The network learns shard by shard, which a hash of id and
text deals, so scores don't depend on partitions, and a task that runs again does what it did.

A text that the corpus has twice is likelier than the network can know. So windows are also remembered: counts of
each word between its two neighbours, over the whole corpus and without the window itself, smoothed by the network:

    p = (n(left, word, right) - 1 + NEAR * p_network) / (n(left, right) - 1 + NEAR)

Their sum over all windows is a column of its own (``counted_log_likelihood``) and no part of the score. No window is left out,
and no word: a token is known by a hash of the word itself. Windows whose neighbours are both frequent (FREQUENT occurrences or
more, or the text's end) could give a pair a task of its own. So of these, a task deals out each word between two neighbours
once, with its number; the sums come back to the windows, which have stayed with their documents. Of all other windows, a pair has at
most as many as its rarer word. ``remembered_log_likelihood`` leaves the former windows to the network.

Counts are never gathered in one place: each task deals its windows out by the hash of the two neighbours, a group
counts all windows of its pairs in the corpus, and what that changes goes back, summed by document. Copies of a text
within a task are dealt once, with their number. What moves grows with the corpus, and groups become more, not larger.

Defined cases: null and empty texts have no tokens, a sum of 0 and a null mean; very long texts are one document
like any other; repeated rows count and are returned each; ties don't arise, as equal windows have equal counts; an
empty table gives no rows. The result's columns have fixed names; of the input only id and text are read. Ids are
longs; text that is no number stops the query with Spark's cast error.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonarlake.llm import lm
from sonarlake.llm.session import map_slices
from sonarlake.llm.text import mix
from sonarlake.shared import shuffles_dropped

#: Occurrences from which on a word is frequent; weight of the network; windows of a group; tokens and documents that a task deals out at once.
FREQUENT, NEAR, GROUP, CHUNK, CHUNK_DOCS = 4096, 4.0, 1_500_000, 1_500_000, 100_000
#: The network's log-probabilities go to the groups in steps of 1/STEP, the last of them for all that are less.
STEP = 12.0
_SCHEMA = "p int, chunk long, docs binary, body binary"
_RESULT = "doc_id long, n_tokens long, log_likelihood double, mean_log_likelihood double, remembered_log_likelihood double, counted_log_likelihood double"
#: Rows of windows that stay with their documents, and of their words between neighbours.
_STAY, _BETWEEN = b"w", b"t"


def coarse(logs: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(logs * -STEP), 0, 255).astype(np.uint8)


def window_gains(near: np.ndarray, word: np.ndarray, times: np.ndarray, base: np.ndarray) -> np.ndarray:
    """What the counts add to the log-probability of each window of a group: log p - log p_network."""
    key = near.astype(np.uint64) << np.uint64(24) | word
    order = np.argsort(key)
    key, n, b = key[order], times[order].astype(np.int64), base[order] / -STEP

    def sums(k):
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        return np.repeat(np.add.reduceat(n, first), np.diff(np.append(first, len(k))))

    pair, here = sums(key >> np.uint64(24)), sums(key)
    gain = np.zeros(len(key))
    again = np.flatnonzero(pair > 1)  # a pair that stands once has only the word itself
    p = (here[again] - 1 + NEAR * np.exp(b[again])) / (pair[again] - 1 + NEAR)
    out = np.empty(len(key))
    gain[again] = np.log(p) - b[again]
    out[order] = gain
    return out


def _joined(parts: list[bytes]) -> bytes:
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def _parted(b: bytes, at: int = 0) -> list[bytes]:
    out = []
    while at < len(b):
        size = int.from_bytes(b[at : at + 4], "little")
        out.append(b[at + 4 : at + 4 + size])
        at += 4 + size
    return out


def _squeeze(x: np.ndarray) -> bytes:
    """Numbers by planes of their bytes."""
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes())


def _loosen(b: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


class Chunk:
    """Documents that a task deals out together; equal texts have one place."""

    def __init__(self):
        self.places: dict[str, int] = {}
        self.ids, self.place, self.sizes, self.parts, self.tokens = [], [], [], [lm._EDGE], 0

    def add(self, id: int | None, text: str | None, memo: lm.Tokens) -> bool:
        """Whether the chunk is full."""
        at = self.places.setdefault(text or "", len(self.places))
        if at == len(self.sizes):
            tokens = memo.of(text)
            self.sizes.append(len(tokens))
            self.parts += [tokens, lm._EDGE]
            self.tokens += len(tokens) + 2
        self.ids.append(id)
        self.place.append(at)
        return self.tokens >= CHUNK or len(self.ids) >= CHUNK_DOCS

    def deal(self, model: lm.Model, frequent: int, groups: int, chunk: int) -> pa.RecordBatch:
        """All windows by group; the first row has the documents and what the network gives them."""
        seq, sizes, place = np.concatenate(self.parts), np.array(self.sizes, np.int64), np.array(self.place, np.int64)
        index = lm.index_of(seq)
        at = np.flatnonzero(index)
        logs = model.logs(index)[at]
        doc = np.repeat(np.arange(len(sizes)), sizes)
        sums = np.bincount(doc, logs, len(sizes))
        times = np.bincount(place, minlength=len(sizes))
        rare = (index[at - 1] > frequent) | (index[at + 1] > frequent)
        common = np.flatnonzero(~rare)
        extra = self._between(seq, at[common], doc[common], coarse(logs[common]), times, groups, chunk)
        kept = np.flatnonzero(rare)
        at, doc, base = at[kept], doc[kept], coarse(logs[kept])
        with np.errstate(over="ignore"):
            near = mix(mix(seq[at - 1]) + seq[at + 1])
        group = (near >> np.uint64(32)) % np.uint64(groups)
        order = np.argsort(group << np.uint64(32) | near & np.uint64(0xFFFFFFFF))
        near, group, doc, base = near.astype(np.uint32)[order], group[order], doc[order].astype(np.uint32), base[order]
        word = (mix(seq[at]) >> np.uint64(40)).astype("<u4")[order].view(np.uint8).reshape(-1, 4)[:, :3]
        many = times[doc].astype(np.uint32)
        found, starts = np.unique(group, return_index=True)
        docs, bodies = [], []
        for a, b in zip(starts.tolist(), np.append(starts[1:], len(order)).tolist(), strict=True):
            docs.append(_squeeze(doc[a:b]))
            parts = [_squeeze(np.diff(near[a:b], prepend=np.uint32(0))), _squeeze(many[a:b]), _squeeze(base[a:b])]
            bodies.append(word[a:b].tobytes() + _joined(parts))
        nulls = np.array([i is None for i in self.ids], np.int64)
        ids = np.array([0 if i is None else i for i in self.ids], np.int64)
        about = b"".join(x.tobytes() for x in (np.array([len(ids), len(sizes)]), ids, nulls, place, sizes, sums))
        rows = [(chunk % groups, None, zstandard.ZstdCompressor(level=1).compress(about)), *zip(found.tolist(), docs, bodies, strict=True), *extra]
        return pa.RecordBatch.from_pydict({
            "p": pa.array([r[0] for r in rows], pa.int32()), "chunk": pa.array([chunk] * len(rows), pa.int64()),
            "docs": pa.array([r[1] for r in rows], pa.binary()), "body": pa.array([r[2] for r in rows], pa.binary()),
        })

    def _between(self, seq, at, doc, base, times, groups: int, chunk: int) -> list[tuple[int, bytes, bytes]]:
        """Windows between frequent neighbours: a row of all, and by group their distinct words between neighbours with numbers."""
        if not len(at):
            return []
        with np.errstate(over="ignore"):
            near = mix(mix(seq[at - 1]) + seq[at + 1])
        group = (near >> np.uint64(32)) % np.uint64(groups)
        key = (near & np.uint64(0xFFFFFFFF)) << np.uint64(24) | mix(seq[at]) >> np.uint64(40)
        order = np.lexsort((key, group))
        g, k = group[order], key[order]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (k[1:] != k[:-1])])
        first, place = np.flatnonzero(new), np.empty(len(at), np.uint32)
        place[order] = np.cumsum(new) - 1
        n = np.add.reduceat(times[doc[order]], first).astype(np.uint32)
        g, k = g[first], k[first]
        found, starts = np.unique(g, return_index=True)
        out = [(chunk % groups, _STAY, _joined([len(k).to_bytes(8, "little"), _squeeze(np.diff(doc, prepend=0).astype(np.uint32)), _squeeze(base), _squeeze(place)]))]
        for p, a, b in zip(found.tolist(), starts.tolist(), np.append(starts[1:], len(k)).tolist(), strict=True):
            out.append((p, _BETWEEN, _joined([a.to_bytes(8, "little"), _squeeze(np.diff(k[a:b], prepend=np.uint64(0))), _squeeze(n[a:b])])))
        return out


def between_sums(rows: list[tuple[int, bytes]]):
    """(chunk, body) with the corpus's sums of each word between its neighbours and of the neighbours, for a group's rows (chunk, body)."""
    parts = [(c, *_parted(b)) for c, b in rows]
    keys = [np.cumsum(_loosen(k, np.uint64), dtype=np.uint64) for _, _, k, _ in parts]
    if not keys:
        return
    key, n = np.concatenate(keys), np.concatenate([_loosen(x, np.uint32) for *_, x in parts]).astype(np.int64)
    words, own = np.unique(key, return_inverse=True)
    total = np.bincount(own, n).astype(np.int64)
    _, pair = np.unique(words >> np.uint64(24), return_inverse=True)
    both = np.bincount(pair, total).astype(np.int64)
    here, near = total[own], both[pair][own]
    at = 0
    for (c, start, _, _), k in zip(parts, keys, strict=True):
        yield c, _joined([start, _squeeze(here[at : at + len(k)]), _squeeze(near[at : at + len(k)])])
        at += len(k)


def _group(key, table):
    """Gains by chunk and place of the text; rows that tell the documents pass."""
    rows = list(zip(table.column("chunk").to_pylist(), table.column("docs").to_pylist(), table.column("body").to_pylist(), strict=True))
    out = [(c, d, b) for c, d, b in rows if d is None or d == _STAY]
    out += [(c, _BETWEEN, b) for c, b in between_sums([(c, b) for c, d, b in rows if d == _BETWEEN])]
    chunks, docs, cols = [], [], ([], [], [], [])
    for c, d, b in rows:
        if d in (None, _STAY, _BETWEEN):
            continue
        chunks.append(c)
        docs.append(_loosen(d, np.uint32))
        n = len(docs[-1])
        word = np.frombuffer(b, np.uint8, 3 * n).reshape(-1, 3).astype(np.uint64)
        parts = _parted(b, 3 * n)
        cols[0].append(np.cumsum(_loosen(parts[0], np.uint32), dtype=np.uint32))
        cols[1].append(word[:, 0] | word[:, 1] << np.uint64(8) | word[:, 2] << np.uint64(16))
        cols[2].append(_loosen(parts[1], np.uint32))
        cols[3].append(_loosen(parts[2], np.uint8))
    if docs:
        gains = window_gains(*(np.concatenate(c) for c in cols))
        at = 0
        for c, d in zip(chunks, docs, strict=True):
            sums = np.bincount(d, gains[at : at + len(d)])
            found = np.flatnonzero(sums)
            at += len(d)
            if len(found):
                out.append((c, _squeeze(np.diff(found, prepend=0).astype(np.uint32)), _squeeze(sums[found].astype(np.float32))))
    return pa.table({"chunk": pa.array([r[0] for r in out], pa.int64()), "docs": pa.array([r[1] for r in out], pa.binary()), "body": pa.array([r[2] for r in out], pa.binary())})


def _gather(key, table):
    docs, bodies = table.column("docs").to_pylist(), table.column("body").to_pylist()
    raw = zstandard.ZstdDecompressor().decompress(next(b for d, b in zip(docs, bodies, strict=True) if d is None))
    n, m = np.frombuffer(raw, np.int64, 2).tolist()
    whole = np.frombuffer(raw, np.int64, offset=16)
    ids, nulls, place, sizes, total = *(whole[k * n : (k + 1) * n] for k in range(3)), whole[3 * n : 3 * n + m], whole[3 * n + m :].view(np.float64)
    network, total = total, total.copy()
    gains = np.zeros(m)
    if _STAY in docs:
        count, doc, base, at = _parted(bodies[docs.index(_STAY)])
        here, near = np.zeros((2, int.from_bytes(count, "little")))
        for d, b in zip(docs, bodies, strict=True):
            if d == _BETWEEN:
                start, x, y = _parted(b)
                first, x = int.from_bytes(start, "little"), _loosen(x, np.int64)
                here[first : first + len(x)], near[first : first + len(x)] = x, _loosen(y, np.int64)
        b, at = _loosen(base, np.uint8) / -STEP, _loosen(at, np.uint32)
        gains = np.bincount(np.cumsum(_loosen(doc, np.uint32)), np.log((here[at] - 1 + NEAR * np.exp(b)) / (near[at] - 1 + NEAR)) - b, m)
    for d, b in zip(docs, bodies, strict=True):
        if d not in (None, _STAY, _BETWEEN):
            total[np.cumsum(_loosen(d, np.uint32), dtype=np.uint32)] += _loosen(b, np.float32)
    counted = (total + gains)[place]
    size, own, total = sizes[place], network[place], total[place]
    mean = pa.array(own / np.maximum(size, 1), mask=size == 0)
    return pa.table({"doc_id": pa.array(ids, mask=nulls > 0), "n_tokens": pa.array(size), "log_likelihood": pa.array(own), "mean_log_likelihood": mean, "remembered_log_likelihood": pa.array(total), "counted_log_likelihood": pa.array(counted)})


def corpus_likelihood(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, log_likelihood (sum) and mean_log_likelihood (null without tokens) under the network of these documents, and the sums with their counts."""
    with shuffles_dropped(docs.sparkSession):  # counts of words, and the texts that are dealt for the training
        vocab = lm.vocabulary(docs, text)
        shipped = docs.sparkSession.sparkContext.broadcast(lm.Model.fit(docs, vocab, text, id))  # as large as the vocabulary
    groups, frequent = max(48, math.ceil(vocab.tokens / GROUP)), int((vocab.counts[1 : 1 + lm.WORDS] >= FREQUENT).sum())

    def deal(batches):
        model = shipped.value
        memo, shard, number, chunk = lm.Tokens(model.frequent), None, 0, Chunk()
        for b in batches:
            for s, i, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if s != shard:
                    if chunk.ids:
                        yield chunk.deal(model, frequent, groups, number)
                    shard, number, chunk = s, s << 24, Chunk()
                if chunk.add(i, t, memo):
                    yield chunk.deal(model, frequent, groups, number)
                    number, chunk = number + 1, Chunk()
        if chunk.ids:
            yield chunk.deal(model, frequent, groups, number)

    # A shard comes whole and in order, so a chunk has the same documents whenever it is made.
    dealt = map_slices(lm.sharded(docs, lm.shards_of(vocab.tokens), text, id), deal, _SCHEMA)
    gains = dealt.groupBy("p").applyInArrow(_group, "chunk long, docs binary, body binary")
    return gains.groupBy("chunk").applyInArrow(_gather, _RESULT)
