"""Packing documents into sequences by first-fit decreasing, with a tournament tree of free room.

Documents go to randomised groups of bounded size; each group is packed on its own in one task, so no
group depends on another and nothing is collected. In a group, a document's ids are cut into full
sequences, and the rests go, longest first, into the first sequence with room; a tournament tree over
the free room finds it in logarithmic time. What room is left is then filled by cutting the pieces of
the emptiest sequences, and the one sequence that stays partly filled is cut at powers of two, which
need no padding.

A document's group is a seeded hash of its id and text, so a task that runs again deals every row as before,
in whatever order rows come; within a group rows are sorted by id, then text.

Defined cases: a null or empty text is the closing id alone. Repeated rows are packed once each, in one
group. Documents of equal length go in the order of their ids (null first). Very long texts are spread
over many sequences. An empty table gives no rows. Only the id and text columns are read, so other columns
can have any names. Ids are longs; text that is no number stops the query with Spark's cast error.
``sequence_id`` holds the group in its upper bits.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonarlake.llm.session import enter_stage
from sonarlake.llm.tokens import encoder

SEQUENCE, CLOSING_ID = 2048, 1
#: Documents of a group on average, and the bits of sequence_id that count within a group.
GROUP_DOCS, GROUP_BITS = 1500, 32
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Tournament:
    """Bins with their free room; ``first(n)`` is the first bin with room for n."""

    def __init__(self, bins: int, room: int):
        self.size = 1 << max(0, math.ceil(math.log2(max(1, bins))))
        self.free = [room] * (2 * self.size)

    def first(self, n: int) -> int:
        at = 1
        while at < self.size:
            at *= 2
            if self.free[at] < n:
                at += 1
        return at - self.size

    def take(self, b: int, n: int) -> None:
        at = b + self.size
        self.free[at] -= n
        at //= 2
        while at:
            self.free[at] = max(self.free[2 * at], self.free[2 * at + 1])
            at //= 2


def first_fit_decreasing(lengths: list[int], room: int) -> list[list[int]]:
    """Items by bin, longest first; no item is longer than ``room``."""
    tree = Tournament(len(lengths), room)
    bins: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        b = tree.first(lengths[i])
        tree.take(b, lengths[i])
        if b == len(bins):
            bins.append([])
        bins[b].append(i)
    return bins


def pack(totals: list[int], room: int = SEQUENCE) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) for documents of these lengths."""
    out = [[(d, at, room)] for d, n in enumerate(totals) for at in range(0, n - room + 1, room)]
    rests = [(d, n - n % room, n % room) for d, n in enumerate(totals) if n % room]
    bins = [[rests[i] for i in b] for b in first_fit_decreasing([r[2] for r in rests], room)]
    filled = [sum(p[2] for p in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda b: (filled[b], b))
    low, high = 0, len(order) - 1
    # The emptiest sequences give their pieces, cut where needed, to the fullest that still have room.
    while low < high:
        to, give = order[high], order[low]
        need = room - filled[to]
        if not need:
            high -= 1
            continue
        if not filled[give]:
            low += 1
            continue
        d, at, n = bins[give].pop()
        cut = min(n, need)
        bins[to].append((d, at, cut))
        filled[to] += cut
        filled[give] -= cut
        if cut < n:
            bins[give].append((d, at + cut, n - cut))
    for b in order:
        if filled[b] == room:
            out.append(bins[b])
        elif filled[b]:
            out += _powers(bins[b], filled[b])
    return out


def _powers(pieces: list[tuple[int, int, int]], total: int) -> list[list[tuple[int, int, int]]]:
    """Pieces cut into sequences whose lengths are powers of two."""
    out, left = [], list(reversed(pieces))
    while total:
        want = 1 << (total.bit_length() - 1)
        total -= want
        seq = []
        while want:
            d, at, n = left.pop()
            cut = min(n, want)
            seq.append((d, at, cut))
            want -= cut
            if cut < n:
                left.append((d, at + cut, n - cut))
        out.append(seq)
    return out


def pack_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", room: int = SEQUENCE, vocabulary: str | None = None, seed: int = 7) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    # Groups are as many as the documents and bytes ask for, so a group stays small at any size.
    n, size = rows.agg(F.count("*"), F.sum(F.coalesce(F.length("text"), F.lit(0)))).first()
    groups = max(1, math.ceil(n / GROUP_DOCS), math.ceil((size or 0) / (GROUP_DOCS * 4096)))
    dealt = rows.withColumn("g", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(groups)))

    def work(key, group):
        enter_stage()
        enc, ids, owners = encoder(vocabulary), [], []
        group = group.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        for b in group.to_batches():
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                owners += part.column("doc_id").to_pylist()
                ids += [np.append(x, np.uint32(CLOSING_ID)) for x in enc.ids(part.column("text").to_pylist())]
        cols: list[list] = [[] for _ in range(7)]
        base = key[0].as_py() << GROUP_BITS
        for s, seq in enumerate(pack([len(x) for x in ids], room)):
            offset = 0
            for d, start, length in seq:
                crc = zlib.crc32(ids[d][start : start + length].astype("<u4").tobytes())
                for c, v in zip(cols, (owners[d], start, length, crc, len(ids[d]), base + s, offset), strict=True):
                    c.append(v)
                offset += length
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in cols], [x.split()[0] for x in SCHEMA.split(", ")])

    return dealt.groupBy("g").applyInArrow(work, SCHEMA)
