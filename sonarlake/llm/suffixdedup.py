"""Removal of repeated passages: every byte covered by a string of SPAN bytes that also starts in a
document with a smaller id.

Sorting all suffixes of a corpus would move every byte many times, so suffixes are first brought down to
anchors: of each window of SPAN bytes the least hash of its K-grams picks a place, and equal windows pick
the same one. About one place in eighteen is an anchor, with the run of windows that picked it.

1. A task finds the anchors of its texts. Runs whose hashes agree are sorted as suffixes of the task's text;
   of those that agree throughout, only the ones of the least id go on, and the others are repeats. So a
   passage that a third of the rows share leaves each task once.
2. Anchors meet by the hash of their K-gram. Here hashes say which texts to compare, and decide nothing: a run
   that seems to repeat one of a smaller id as a whole names that run, and neighbouring runs that name
   neighbouring ones become one long piece. A window shared in part of a run reaches SIDE bytes beyond the
   anchor on one side at least; where a side agrees with a smaller id, the run's text is asked for, with the
   text of one run of each other kind.
3. Texts asked for are sorted as suffix arrays by deep-shallow sorting, and neighbours in that order that agree
   are the repeats: long pieces with the text that they name (the long common prefixes that blind tries are
   for), and all windows of the runs that agree in part. A piece that very many documents have meets the text
   that it names in several shares.
4. Spans of each document are united and cut from it.

A run whose hashes (104 bits) agree with another's by chance is found to differ and stays; so hashes never remove
a byte.

Defined cases: a null text is empty; texts shorter than SPAN lose nothing. A null id counts as larger
than all others, and two null ids as equal. Rows that repeat an id don't remove each other's bytes.
Identical rows are each returned. Very long texts are hashed piece by piece, and their repeats are cut into blocks.
An empty table gives no rows. Columns other than id and text are kept by ``remove_repeats``; names that begin with
two underscores are refused, as the plan uses such. Ids are longs; text that is no number stops the query with
Spark's cast error.
"""

from __future__ import annotations

import hashlib
import pickle
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonarlake.llm.session import enter_stage, map_slices
from sonarlake.llm.suffixes import equal_strings
from sonarlake.llm.text import mix, sliding_min

SPAN, K = 50, 16
W = SPAN - K + 1
SIDE = (SPAN - K) // 2
#: Bits of a side's hash: of runs that share a K-gram only, one pair in so many has its text compared for nothing.
SIDE_BITS = 16
SIDE_MASK = np.uint64((1 << SIDE_BITS) - 1)
#: Bytes of text hashed at once, of text between two emissions of a task, and of text for each bucket.
CHUNK, FLUSH, BUCKET_BYTES = 1 << 18, 8 << 20, 16 << 20
#: Bytes of a document that pieces of others name together, and pieces that meet it at once.
BLOCK, FAN = 1 << 15, 256
#: Bytes of asked text that a task hands on together.
ASKED = 8 << 20
#: Shares of a bucket that are sorted one after the other.
SHARES = 16
PLACE = np.uint64((1 << 24) - 1)
#: A finding of a bucket: a span of document ``k`` and what it is; runs have their K-gram, whole ones the document and place
#: of the run that they seem to repeat, and how many runs agree.
FOUND = "k long, start long, end long, role int, g long, ask boolean, rk long, rs long, fan int"
REPEATS, PART, WHOLE, NAMED = range(4)
NO_ID = (1 << 63) - 1

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_M = [np.uint64(int(x) | 1) for x in _rng.integers(0, 1 << 63, 8, dtype=np.int64)]


def gram_values(text: np.ndarray) -> np.ndarray:
    """A hash of the K = 16 bytes at each place."""
    h = _BYTE[text]
    for k, size in enumerate((1, 2, 4, 8)):
        h = h[:-size] * _M[k] + h[size:]
        h ^= h >> np.uint64(29)
    return h


def runs_of(text: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, ...]:
    """(gram hash, run hash, side hashes, first window, last window) for the anchors of one text of at most 16 MB.

    valid: windows that may be used, by start.
    """
    h = gram_values(text)
    order = (h & ~PLACE) | np.arange(len(h), dtype=np.uint64)
    anchor = sliding_min(order, W) & PLACE
    at = np.flatnonzero(valid)
    if not len(at):
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
    a = anchor[at]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (at[1:] != at[:-1] + 1)])
    first = at[new]
    last = at[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(at) - 1]])]

    def window(p):
        x = h[p]
        for k, step in enumerate((16, 32, SPAN - K)):
            x = mix(x * _M[4 + k]) + h[p + step]
        return x

    at = a[new].astype(np.int64)
    gram = mix(h[at])
    sides = np.zeros(len(at), np.int64)
    # SIDE_BITS for each side on which some window of the run reaches far enough; 0 where none does.
    for shift, there, x, y in ((SIDE_BITS, at - first >= SIDE, -SIDE, 1 - SIDE), (0, at - last <= SIDE, K, K + 1)):
        p = at[there]
        sides[there] |= (1 + (mix(h[p + x] * _M[5] + h[p + y]) % SIDE_MASK).astype(np.int64)) << shift
    run = mix(mix(window(first)) * _M[7] + window(last) + (last - first).astype(np.uint64))
    return gram, run, sides, first, last


def merge(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal spans of a union of spans; spans that touch are one."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    return starts[new], reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(starts) - 1]])]


def _squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays, byte planes apart, compressed."""
    z = zstandard.ZstdCompressor(level=1)
    return pickle.dumps([(a.dtype.str, z.compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())) for a in arrays])


def _loosen(data: bytes) -> list[np.ndarray]:
    z = zstandard.ZstdDecompressor()
    out = []
    for kind, raw in pickle.loads(data):
        plain, size = np.frombuffer(z.decompress(raw), np.uint8), np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(plain.reshape(size, len(plain) // size).T).view(kind).ravel())
    return out


def _spans_of_docs(doc: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(doc, merged spans as bytes) of each document; rows in the order of documents."""
    if not len(doc):
        return
    # Documents one after the other on one line, with a gap between them, so that all are merged at once.
    rank = np.concatenate([[0], np.cumsum(doc[1:] != doc[:-1])])
    room = int(ends.max()) + 2
    s, e = merge(starts + rank * room, ends + rank * room)
    owner = s // room
    spans = np.stack([s - owner * room, e - owner * room], axis=1).astype("<i8")
    edges = np.searchsorted(owner, np.arange(rank[-1] + 2)).tolist()
    for k, a, b in zip(doc[np.flatnonzero(np.diff(rank, prepend=-1))].tolist(), edges, edges[1:], strict=False):
        yield k, spans[a:b].tobytes()


def _later(groups: Iterable[list[int]], ids: np.ndarray) -> np.ndarray:
    """Of groups of numbers, those whose id is larger than the least of their group."""
    sizes, flat = array("q"), array("q")
    for group in groups:
        sizes.append(len(group))
        flat.extend(group)
    sizes, flat = np.array(sizes, np.int64), np.array(flat, np.int64)
    if not len(flat):
        return flat
    least = np.minimum.reduceat(ids[flat], np.cumsum(sizes) - sizes)
    return flat[ids[flat] > np.repeat(least, sizes)]


class _Flush:
    """Anchors of a task's texts until the next emission."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.clear()

    def clear(self) -> None:
        self.bytes = 0
        self.docs: list[tuple[int, int]] = []  # id, key
        self.runs: list[tuple[np.ndarray, ...]] = []
        self.texts: list[bytes] = []
        self.text: list[bytes] = []
        self.held = 0

    def add(self, id: int | None, key: int, text: bytes | None) -> None:
        text = text or b""
        self.docs.append((NO_ID if id is None else id, key))
        self.bytes += len(text)
        self.texts.append(text)
        self.text.append(text)
        self.held += len(text)
        if self.held >= CHUNK:
            self.hash_held()

    def hash_held(self) -> None:
        base = len(self.docs) - len(self.text)
        if self.held <= 2 * CHUNK:
            whole = np.frombuffer(b"".join(self.text), np.uint8)
            sizes = np.fromiter(map(len, self.text), np.int64, len(self.text))
            ends = np.cumsum(sizes)
            self._hash(whole, ends - sizes, ends, base, 0)
        else:  # a long text goes piece by piece; pieces overlap by a window less one
            for k, t in enumerate(self.text):
                for at in range(0, max(1, len(t) - SPAN + 1), CHUNK):
                    piece = np.frombuffer(t[at : at + CHUNK + SPAN - 1], np.uint8)
                    self._hash(piece, np.array([0]), np.array([len(piece)]), base + k, at)
        self.text, self.held = [], 0

    def _hash(self, whole: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int, shift: int) -> None:
        if len(whole) < SPAN:
            return
        bad = np.zeros(len(whole) + 1, np.int64)
        np.add.at(bad, np.maximum(starts, ends - SPAN + 1), 1)
        np.add.at(bad, ends, -1)
        valid = np.cumsum(bad)[: len(whole) - SPAN + 1] == 0
        gram, run, sides, first, last = runs_of(whole, valid)
        doc = np.searchsorted(starts, first, "right") - 1
        self.runs.append((gram, run, sides, doc + base, first - starts[doc] + shift, (last - first).astype(np.uint8)))

    def repeated(self, both: np.ndarray, doc: np.ndarray, pos: np.ndarray, size: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Runs whose text is that of a run of a smaller id here; only runs of equal hashes are sorted."""
        kinds = _Groups(both, ids[doc])
        some = np.flatnonzero(kinds.any(ids[doc] > kinds.least))
        out = np.zeros(len(doc), bool)
        sizes = np.fromiter(map(len, self.texts), np.int64, len(self.texts))
        places = (np.cumsum(sizes) - sizes)[doc[some]] + pos[some]
        groups = equal_strings(np.frombuffer(b"".join(self.texts), np.uint8), places, size[some].astype(np.int64) + SPAN)
        out[some[_later(groups, ids[doc[some]])]] = True
        return out

    def emit(self):
        """(bucket, anchors, repeats) rows."""
        self.hash_held()
        if self.runs and any(len(r[0]) for r in self.runs):
            gram, run, sides, doc, pos, size = (np.concatenate(c) for c in zip(*self.runs, strict=True))
            ids = np.array([d[0] for d in self.docs], np.int64)
            keys = np.array([d[1] for d in self.docs], np.int64)
            here = self.repeated(mix(gram + run * _M[6]), doc, pos, size, ids)
            found: dict[int, list] = {}
            for d, spans in _spans_of_docs(doc[here], pos[here], pos[here] + size[here] + SPAN):
                found.setdefault(int(keys[d]) % self.buckets, []).append((int(keys[d]), spans))
            rest = np.flatnonzero(~here)
            bucket = ((gram[rest] >> np.uint64(40)) % np.uint64(self.buckets)).astype(np.int64)
            rest = rest[np.argsort(bucket, kind="stable")]
            edges = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=1))])
            used = np.flatnonzero(np.diff(edges))
            for b in sorted({*used.tolist(), *found}):
                mine = rest[edges[b] : edges[b + 1]] if b + 1 < len(edges) else rest[:0]
                docs, counts = np.unique(doc[mine], return_counts=True)
                low = gram[mine].view(np.uint8).reshape(-1, 8)[:, :5]
                # Four bytes of the run's hash above four of its sides.
                kind = ((run[mine] << np.uint64(2 * SIDE_BITS)) | sides[mine].astype(np.uint64)).astype("<u8")
                step = np.diff(pos[mine], prepend=0)
                yield b, pickle.dumps((low.tobytes(), kind.tobytes(), keys[docs].tobytes(), _squeeze(np.diff(ids[docs], prepend=0), counts, step, size[mine]))), pickle.dumps(found.get(b, []))
        self.clear()


def _anchor_rows(docs: DataFrame, buckets: int) -> DataFrame:
    def work(batches):
        flush = _Flush(buckets)

        def rows():
            out = list(flush.emit())
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.binary()), pa.array([r[2] for r in out], pa.binary())], ["bucket", "anchors", "repeats"])

        for b in batches:
            for id, key, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                flush.add(id, key, text)
                if flush.bytes >= FLUSH:
                    yield rows()
        yield rows()

    return map_slices(docs.select("__id", "__k", "__t"), work, "bucket int, anchors binary, repeats binary")


class _Groups:
    """Rows with equal keys: their least id, and which row has it first."""

    def __init__(self, key: np.ndarray, id: np.ndarray):
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]]) if len(key) else np.zeros(0, bool)
        heads = np.flatnonzero(new)
        self.group = np.empty(len(key), np.int64)
        self.group[order] = np.cumsum(new) - 1
        least = np.minimum.reduceat(id[order], heads) if len(key) else id
        self.least = least[self.group]
        self.first = np.zeros(len(key), bool)
        own = np.flatnonzero(id == self.least)
        self.first[own[np.unique(self.group[own], return_index=True)[1]]] = True

    def any(self, mask: np.ndarray) -> np.ndarray:
        """For each row, whether the mask holds anywhere in its group."""
        out = np.zeros(int(self.group.max()) + 1 if len(self.group) else 0, bool)
        out[self.group[mask]] = True
        return out[self.group]


def _decide(gram: np.ndarray, run: np.ndarray, id: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each run: the one of a smaller id that it seems to repeat as a whole (or -1) and how many agree; whether its text
    is needed to tell in part; whether it is wanted for that, by itself or as an answer."""
    left, right = (run >> np.uint64(SIDE_BITS)) & SIDE_MASK, run & SIDE_MASK
    kinds = _Groups(mix(gram * _M[6] + run), id)
    full = id > kinds.least
    first = np.flatnonzero(kinds.first)
    named = np.zeros(len(id), np.int64)
    named[kinds.group[first]] = first  # by group
    names = np.where(full, named[kinds.group], -1)
    fan = np.bincount(kinds.group)[kinds.group]
    asks, wanted = np.zeros(len(id), bool), np.zeros(len(id), bool)
    for side in (left, right):
        groups = _Groups(gram << np.uint64(SIDE_BITS) | side, id)
        asking = (side > 0) & (id > groups.least) & ~full
        asks |= asking
        # One run of each kind answers for it, where somebody asks.
        wanted |= kinds.first & (side > 0) & groups.any(asking)
    return names, fan, asks, asks | wanted


def _meet(key, group):
    """Anchors of one bucket: per document the spans that repeat, and the runs whose text is asked for."""
    enter_stage()
    gram, run, doc, pos, size, ids, keys = [], [], [], [], [], [], []
    dups: list[tuple[int, bytes]] = []
    n = 0
    for anchors, repeats in zip(group.column("anchors").to_pylist(), group.column("repeats").to_pylist(), strict=True):
        low, raw, k, rest = pickle.loads(anchors)
        i, counts, step, s = _loosen(rest)
        wide = np.zeros((len(s), 8), np.uint8)
        wide[:, :5] = np.frombuffer(low, np.uint8).reshape(-1, 5)
        gram.append(wide.view("<u8").ravel())
        run.append(np.frombuffer(raw, np.uint64))
        doc.append(np.repeat(np.arange(n, n + len(i), dtype=np.int32), counts))
        at = np.cumsum(step)
        pos.append(at.astype(np.int32) if not len(at) or at.max() < 1 << 31 else at)
        size.append(s)
        ids.append(np.cumsum(i))
        keys.append(np.frombuffer(k, np.int64))
        n += len(i)
        dups += pickle.loads(repeats)
    gram, run, doc, pos, size, ids, keys = (np.concatenate(c) for c in (gram, run, doc, pos, size, ids, keys))
    names, fan = np.full(len(gram), -1, np.int64), np.zeros(len(gram), np.int64)
    asks, wanted = (np.zeros(len(gram), bool) for _ in range(2))
    share = (gram >> np.uint64(32)).astype(np.uint8) % SHARES
    for k in range(SHARES):
        rows = np.flatnonzero(share == k)
        if len(rows):
            n, fan[rows], asks[rows], wanted[rows] = _decide(gram[rows], run[rows], ids[doc[rows]])
            names[rows] = np.where(n < 0, -1, rows[n])
    own = [np.frombuffer(spans, "<i8").reshape(-1, 2) for _, spans in dups]
    each = np.repeat(np.array([k for k, _ in dups], np.int64), [len(x) for x in own]) if own else np.zeros(0, np.int64)
    own = np.concatenate([*own, np.zeros((0, 2), np.int64)])
    whole, part = np.flatnonzero(names >= 0), np.flatnonzero(wanted)
    named = np.unique(names[whole])
    rows = np.concatenate([part, whole, named])
    role = np.repeat([REPEATS, PART, WHOLE, NAMED], [len(each), len(part), len(whole), len(named)])
    start = pos[rows].astype(np.int64)
    none, other = np.zeros(len(each), np.int64), names[whole]

    def spread(at, values):
        out = np.zeros(len(role), np.int64)
        out[role == at] = values
        return out

    return pa.table({
        "k": np.concatenate([each, keys[doc[rows]]]), "start": np.concatenate([own[:, 0], start]), "end": np.concatenate([own[:, 1], start + size[rows] + SPAN]),
        "role": role.astype(np.int32), "g": spread(PART, gram[part].astype(np.int64)), "ask": spread(PART, asks[part]).astype(bool),
        "rk": spread(WHOLE, keys[doc[other]]), "rs": spread(WHOLE, pos[other]), "fan": np.concatenate([none, fan[rows]]).astype(np.int32),
    })


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    """Edges of the lists of a column, and all that is in them."""
    return np.concatenate([[0], np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))]).astype(np.int64), column.flatten()


def _fields(column: pa.StructArray, *names: str) -> list[np.ndarray]:
    return [pc.struct_field(column, n).to_numpy(zero_copy_only=False) for n in names]


def _chains(start: np.ndarray, end: np.ndarray, fan: np.ndarray, *same: np.ndarray):
    """(first place in the order, start, end, fan) of runs joined where all of ``same`` is the same and windows follow each other."""
    order = np.lexsort((start, *same))
    start, end = start[order], end[order]
    new = np.ones(len(order), bool)
    new[1:] = start[1:] > end[:-1] - SPAN + 1
    for x in same:
        new[1:] |= np.diff(x[order]) != 0
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(order)) - 1
    return [] if not len(order) else list(zip(order[first].tolist(), start[first].tolist(), end[last].tolist(), np.maximum.reduceat(fan[order], first).tolist(), strict=True))


def _meeting(k: int, block: int, share: int, buckets: int) -> int:
    """The group in which pieces meet the block of the document that they name. Hashes of whole numbers are the same in all workers."""
    return buckets + hash((k, block, share)) % buckets


#: What is known of an asked text, besides its group in front and its bytes at the end.
_ASKED = ("role", "id", "k", "pos", "ask", "rk", "rs")


def _pack(rows: list[tuple]) -> pa.RecordBatch:
    """Asked texts by group, compressed."""
    groups: dict[int, list] = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    z = zstandard.ZstdCompressor(level=1)
    bodies = []
    for mine in groups.values():
        numbers = [np.array(c, np.int64) for c in zip(*(r[1:8] for r in mine), strict=True)]
        bodies.append(pickle.dumps((_squeeze(*numbers, np.array([len(r[8]) for r in mine], np.int64)), z.compress(b"".join(r[8] for r in mine)))))
    return pa.RecordBatch.from_arrays([pa.array(list(groups), pa.int32()), pa.array(bodies, pa.binary())], ["b", "body"])


def _unpack(bodies: list[bytes]) -> pa.Table:
    columns, texts = [], []
    for body in bodies:
        numbers, packed = pickle.loads(body)
        *numbers, sizes = _loosen(numbers)
        whole, ends = zstandard.ZstdDecompressor().decompress(packed), np.cumsum(sizes).tolist()
        texts += [whole[a:b] for a, b in zip([0, *ends], ends)]
        columns.append(numbers)
    out = dict(zip(_ASKED, (np.concatenate(c) for c in zip(*columns, strict=True)), strict=True))
    return pa.table(out | {"ask": out["ask"].astype(bool), "x": pa.array(texts, pa.binary())})


def _asked_rows(buckets: int, id: int, k: int, t: bytes, start, end, role, g, ask, rk, rs, fan):
    """(group, what _ASKED names, bytes) for what is asked of one document."""
    for a in np.flatnonzero(role == PART).tolist():
        yield int(g[a]) % buckets, PART, id, k, int(start[a]), bool(ask[a]), 0, 0, t[start[a] : end[a]]
    mine = np.flatnonzero(role == WHOLE)
    for at, s, e, n in _chains(start[mine], end[mine], fan[mine], rs[mine] // BLOCK, rs[mine] - start[mine], rk[mine]):
        other, place = int(rk[mine][at]), int(rs[mine][at])
        yield _meeting(other, place // BLOCK, k % -(-n // FAN), buckets), WHOLE, id, k, s, True, other, place, t[s:e]
    mine = np.flatnonzero(role == NAMED)
    for _, s, e, n in _chains(start[mine], end[mine], fan[mine], start[mine] // BLOCK):
        for share in range(-(-n // FAN)):
            yield _meeting(k, s // BLOCK, share, buckets), NAMED, id, k, s, False, 0, 0, t[s:e]


def _texts(asked: DataFrame, buckets: int) -> DataFrame:
    """The text of each run that was asked for, and of each piece with what it names."""

    def work(batches):
        rows, held = [], 0
        for b in batches:
            edges, flat = _lists(b.column("__asks"))
            fields = _fields(flat, "start", "end", "role", "g", "ask", "rk", "rs", "fan")
            for n, (id, k) in enumerate(zip(b.column("__id").to_pylist(), b.column("__k").to_pylist(), strict=True)):
                if edges[n] < edges[n + 1]:
                    mine = slice(edges[n], edges[n + 1])
                    new = list(_asked_rows(buckets, NO_ID if id is None else id, k, b.column("__t")[n].as_py(), *(f[mine] for f in fields)))
                    rows += new
                    held += sum(100 + len(r[8]) for r in new)
            if held >= ASKED:
                yield _pack(rows)
                rows, held = [], 0
        yield _pack(rows)

    return map_slices(asked, work, "b int, body binary")


def _window_hits(group: pa.Table):
    """(k, start, end) of the windows of asked runs that repeat one of a smaller id, by a suffix array of the texts."""
    texts = group.column("x").to_pylist()
    ids, pos = group.column("id").to_numpy(), group.column("pos").to_numpy()
    ask = group.column("ask").to_numpy(zero_copy_only=False)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(sizes) - sizes
    windows = sizes - SPAN + 1
    owner = np.repeat(np.arange(len(texts)), windows)
    places = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows) + starts[owner]
    hit = _later(equal_strings(np.frombuffer(b"".join(texts), np.uint8), places, SPAN), ids[owner])
    hit = hit[ask[owner[hit]]]
    who = owner[hit]
    where = pos[who] + places[hit] - starts[who]
    return group.column("k").to_numpy()[who], where, where + SPAN


def _piece_hits(group: pa.Table):
    """(k, start, end) of the pieces that are the text which they name, of a smaller id: both are sorted, and neighbours compared."""
    role, ids, keys, pos, texts = group.column("role").to_numpy(), group.column("id").to_numpy(), group.column("k").to_numpy(), group.column("pos").to_numpy(), group.column("x").to_pylist()
    named: dict[int, list[int]] = {}
    for n in np.flatnonzero(role == NAMED).tolist():
        named.setdefault(int(keys[n]), []).append(n)
    pieces = np.flatnonzero(role == WHOLE).tolist()
    strings, owner, there = [texts[n] for n in pieces], list(pieces), set()
    for n, k, at in zip(pieces, group.column("rk").to_numpy()[pieces].tolist(), group.column("rs").to_numpy()[pieces].tolist(), strict=True):
        size = len(texts[n])
        m = next((m for m in named.get(k, ()) if pos[m] <= at and at + size <= pos[m] + len(texts[m])), None)
        if m is not None and (k, at, size) not in there:
            there.add((k, at, size))
            strings.append(texts[m][at - int(pos[m]) : at - int(pos[m]) + size])
            owner.append(m)
    owner = np.array(owner, np.int64)
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    hit = owner[_later(equal_strings(np.frombuffer(b"".join(strings), np.uint8), np.cumsum(sizes) - sizes, sizes), ids[owner])]
    hit = hit[role[hit] == WHOLE]
    return keys[hit], pos[hit], pos[hit] + np.fromiter((len(texts[n]) for n in hit.tolist()), np.int64, len(hit))


def _sort_texts(key, group):
    enter_stage()
    return _sorted(_unpack(group.column("body").to_pylist()))


def _sorted(group: pa.Table) -> pa.Table:
    """Spans that repeat text of a smaller id, of one group of texts."""
    part = group.column("role").to_numpy() == PART
    found = [f(group.filter(pa.array(rows))) for f, rows in ((_window_hits, part), (_piece_hits, ~part)) if rows.any()]
    keys, start, end = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((start, keys))
    out = list(_spans_of_docs(keys[order], start[order], end[order]))
    return pa.table({"k": pa.array([o[0] for o in out], pa.int64()), "dups": pa.array([o[1] for o in out], pa.binary())})


def _with_spans(docs: DataFrame, id: str, text: str, keep: list[str]) -> DataFrame:
    """The columns ``keep``, the text's bytes ``__t``, and the packed spans ``__dups`` and ``__late``."""
    if taken := [c for c in docs.columns if c.startswith("__") and c != "__null"]:
        raise ValueError(f"columns {taken}: names that begin with two underscores are the plan's")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    key = F.xxhash64(F.col(id), body)
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(4, -(-size // BUCKET_BYTES))
    rows = docs.select(*keep, F.col(id).cast("long").alias("__id"), key.alias("__k"), body.cast("binary").alias("__t"))
    met = _anchor_rows(rows, buckets).groupBy("bucket").applyInArrow(_meet, FOUND)
    repeats = F.col("role") == REPEATS
    dup, ask = F.when(repeats, F.struct("start", "end")), F.when(~repeats, F.struct("start", "end", "role", "g", "ask", "rk", "rs", "fan"))
    per = met.groupBy("k").agg(F.collect_list(dup).alias("__dups"), F.collect_list(ask).alias("__asks")).withColumnRenamed("k", "__a")
    # Texts and findings move once: both uses of ``whole`` read the same columns, so Spark reuses the exchanges.
    whole = rows.join(per, F.col("__k") == F.col("__a"), "left").drop("__a")
    whole = whole.withColumns({c: F.coalesce(c, F.array()) for c in ("__dups", "__asks")})
    late = _texts(whole, 4 * buckets).groupBy("b").applyInArrow(_sort_texts, "k long, dups binary")
    late = late.groupBy("k").agg(F.collect_list("dups").alias("__late")).withColumnRenamed("k", "__b")
    return whole.join(late, F.col("__k") == F.col("__b"), "left").drop("__b").withColumn("__late", F.coalesce("__late", F.array()))


def _fragments(b: pa.RecordBatch):
    """For each row of a batch, its text's bytes, what stays of them, and how many spans go."""
    edges, flat = _lists(b.column("__dups"))
    start, end = _fields(flat, "start", "end")
    for n, (t, late) in enumerate(zip(b.column("__t").to_pylist(), b.column("__late").to_pylist(), strict=True)):
        more = np.frombuffer(b"".join(late), "<i8").reshape(-1, 2)
        here = slice(edges[n], edges[n + 1])
        s, e = merge(np.concatenate([start[here], more[:, 0]]).astype(np.int64), np.concatenate([end[here], more[:, 1]]).astype(np.int64))
        yield t, [t[x:y] for x, y in zip([0, *e.tolist()], [*s.tolist(), len(t)], strict=True)], len(s)


def repeats(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans and kept_sha256 of each document."""
    whole = _with_spans(docs, id, text, [id])

    def cut(batches):
        for b in batches:
            out = []
            for t, parts, n in _fragments(b):
                kept = b"".join(parts)
                out.append((len(t), len(t) - len(kept), n, hashlib.sha256(kept).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(id), *(pa.array([o[n] for o in out], kind) for n, kind in enumerate(kinds))], [id, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    extra = [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")]
    return map_slices(whole, cut, T.StructType([whole.schema[id], *extra, T.StructField("kept_sha256", T.StringType())]))


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with repeated passages cut from the text; what a cut leaves of a split character goes with it.

    A null text stays null.
    """
    others = [c for c in docs.columns if c != text]
    flagged = docs.withColumn("__null", F.col(text).isNull())
    whole = _with_spans(flagged, id, text, [*others, "__null"])

    def cut(batches):
        for b in batches:
            out = []
            for (_, parts, _), null in zip(_fragments(b), b.column("__null").to_pylist(), strict=True):
                out.append(None if null else "".join(p.decode("utf-8", "ignore") for p in parts))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in others), pa.array(out, pa.string())], [*others, text])

    return map_slices(whole, cut, T.StructType([*(docs.schema[c] for c in others), docs.schema[text]])).select(*docs.columns)
