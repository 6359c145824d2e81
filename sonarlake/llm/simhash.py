"""SimHash near-duplicates through a distributed vantage-point tree.

Every distinct fingerprint is measured against a vantage point: its Hamming distance to it, taken block
by block (halves of the 64 bits at first, then quarters, then bytes). Block distances obey the triangle
inequality and add up to the whole, so two fingerprints within radius r have vectors of block distances
at most r apart in sum; branches farther apart are pruned. The top level is the partitioning: a shard is
a cell of equal half distances, each fingerprint lives in one, and visits as a guest those later cells
that its ball overlaps. Within a shard the tree goes on by quarters and bytes while a pair of branches is
large, and leaves are compared exactly. Guests are 20 or 160 small rows for each distinct fingerprint, times the
parts of the cells that they visit, where those are split.

A shard returns a spanning forest of its links, not the links, so a dense group of n near copies costs n
rows. Exact copies have merged before. Shards with too many members are split, each part seeing all
guests. Components of the forests are found by alternating stars.

Defined cases: a null or empty text has no words and fingerprint zero, which links like any other. Texts
of fewer than four words are one shingle. Rows that repeat are each returned. A null id takes part, but
is no component id unless all ids of the component are null. Very long texts are hashed whole, one at a time. Ties
don't arise, as ids of a component are compared for the least only. An empty table gives no rows. Columns other
than id and text are ignored by ``components``; ``keep_first`` keeps them all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonarlake.llm.graph import connected_components
from sonarlake.llm.session import checkpointed, map_slices
from sonarlake.llm.text import words_lower

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Members of a shard before it is split, distinct fingerprints before shards go by quarters, pairs of a leaf.
SHARD, FINE_FROM, LEAF_PAIRS = 20_000, 20_000_000, 1 << 20


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint: a bit is 1 if it is set in over half of the shingles' XXH64."""
    words = words_lower(text)
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(SHINGLE, len(words))
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    n = len(words) - k + 1
    for at in range(0, n, 1 << 15):
        upto = min(n, at + (1 << 15))
        h = np.array([digest(whole[a:b], SEED) for a, b in zip(starts[at:upto].tolist(), ends[at + k - 1 : upto + k - 1].tolist(), strict=True)], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, fp: fingerprints as signed longs."""

    def work(batches):
        for b in batches:
            prints = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints)], ["id", "fp"])

    return map_slices(docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string")), work, "id long, fp long")


def _block_distances(x: np.ndarray, vantage: int, blocks: int) -> np.ndarray:
    """Hamming distance to the vantage point within each of 2, 4 or 8 blocks, as int8 columns."""
    kind = {2: np.uint32, 4: np.uint16, 8: np.uint8}[blocks]
    return np.bitwise_count((x ^ np.uint64(vantage)).view(kind).reshape(-1, blocks)).astype(np.int8)


class _Forest:
    """Union-find over places."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Unites a[k] with b[k] for every k; many links are first thinned to one for each place."""
        while len(a) > 64:
            ra, rb = self.up[a], self.up[b]
            while (self.up[ra] != ra).any() or (self.up[rb] != rb).any():
                ra, rb = self.up[ra], self.up[rb]
            open_ = ra != rb
            a, b = np.maximum(ra, rb)[open_], np.minimum(ra, rb)[open_]
            if not len(a):
                return
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            first = np.concatenate([[True], a[1:] != a[:-1]])
            self.up[a[first]] = b[first]  # hooks a root on a smaller root: no cycles
            a, b = a[~first], b[~first]
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            i, j = self.root(i), self.root(j)
            if i != j:
                self.up[max(i, j)] = min(i, j)


def _compare(x: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int, forest: _Forest) -> None:
    """All pairs of two leaves, in tiles."""
    step = max(1, LEAF_PAIRS // max(1, len(right)))
    for at in range(0, len(left), step):
        part = left[at : at + step]
        i, j = np.nonzero(np.bitwise_count(x[part][:, None] ^ x[right][None, :]) <= radius)
        if len(i):
            forest.link(part[i], right[j])


def _branches(x: np.ndarray, at: np.ndarray, vantage: int, blocks: int) -> tuple[np.ndarray, list[np.ndarray]]:
    d = _block_distances(x[at], vantage, blocks)
    key = np.zeros(len(at), np.int64)
    for k in range(blocks):
        key = key * 65 + d[:, k]
    order = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(np.diff(key[order])) + 1
    groups = np.split(order, cuts)
    return d[[g[0] for g in groups]].astype(np.int16), [at[g] for g in groups]


def _descend(x: np.ndarray, left: np.ndarray, right: np.ndarray, vantage: int, blocks: int, radius: int, forest: _Forest) -> None:
    """Joins two branches: leaves are compared, larger ones split by finer blocks, far ones pruned."""
    if not len(left) or not len(right):
        return
    if blocks > 8 or len(left) * len(right) <= LEAF_PAIRS:
        _compare(x, left, right, radius, forest)
        return
    (dl, gl), (dr, gr) = _branches(x, left, vantage, blocks), _branches(x, right, vantage, blocks)
    for k in range(len(gl)):
        near = np.flatnonzero(np.abs(dr - dl[k]).sum(axis=1) <= radius)
        if not len(near):
            continue
        others = np.concatenate([gr[j] for j in near])
        if len(gl[k]) * len(others) <= LEAF_PAIRS:
            _compare(x, gl[k], others, radius, forest)
        else:
            _descend(x, gl[k], others, vantage, 2 * blocks, radius, forest)


def shard_forest(home: np.ndarray, guests: np.ndarray, vantage: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among ``home`` and from it to ``guests``: (fingerprint, root)."""
    x = np.concatenate([home, guests])
    forest = _Forest(len(x))
    mine = np.arange(len(home))
    _descend(x, mine, mine, vantage, 4, radius, forest)
    _descend(x, mine, np.arange(len(home), len(x)), vantage, 4, radius, forest)
    roots = forest.up
    while (roots[roots] != roots).any():
        roots = roots[roots]
    moved = np.flatnonzero(roots != np.arange(len(x)))
    return x[moved], x[roots[moved]]


def _offsets(blocks: int, radius: int) -> list[tuple[int, ...]]:
    """Cell offsets within the radius that come later in order."""
    out = [()]
    for _ in range(blocks):
        out = [(*o, d) for o in out for d in range(-radius, radius + 1) if sum(map(abs, o)) + abs(d) <= radius]
    return [o for o in out if o > (0,) * blocks]


def link_fingerprints(prints: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(a, b) links of distinct ``fp`` that have the same components as all links within the radius."""
    n, least = prints.agg(F.count("*"), F.min(F.struct(F.xxhash64("fp").alias("h"), "fp"))).first()
    if not n:
        return prints.select(F.col("fp").alias("a"), F.col("fp").alias("b"))
    vantage = least["fp"]
    blocks = 2 if n < FINE_FROM else 4
    width = 64 // blocks
    away = F.col("fp").bitwiseXOR(F.lit(vantage))
    low = F.lit((1 << width) - 1).cast("long")
    dist = [F.bit_count(F.shiftrightunsigned(away, width * k).bitwiseAND(low)) for k in range(blocks)]
    code = lambda ds: sum((d * (65**k) for k, d in enumerate(ds)), F.lit(0)).cast("int")
    placed = prints.select("fp", F.array(*dist).alias("d"))
    cells = placed.groupBy(code([F.col("d")[k] for k in range(blocks)]).alias("cell")).agg(F.count("*").alias("n"))
    parts = cells.select("cell", F.ceil(F.col("n") / shard).cast("int").alias("parts"))  # a row for each cell that is in use
    home = placed.select(code([F.col("d")[k] for k in range(blocks)]).alias("cell"), "fp", F.lit(True).alias("home"))
    moved = F.array(*(F.array(*(F.lit(x) for x in o)) for o in _offsets(blocks, radius)))
    guest = placed.select("fp", "d", F.explode(moved).alias("o")).select(code([F.col("d")[k] + F.col("o")[k] for k in range(blocks)]).alias("cell"), "fp", F.lit(False).alias("home"))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    # Guests of cells that nobody lives in fall out in the join; a member visits the later parts of its own cell.
    spread = home.unionByName(guest).join(F.broadcast(parts) if blocks == 2 else parts, "cell")
    dealt = spread.select("cell", "fp", "home", own.alias("own"), F.explode(F.sequence(F.when(F.col("home"), own).otherwise(0), F.col("parts") - 1)).alias("part"))
    dealt = dealt.select("cell", "part", "fp", (F.col("home") & (F.col("own") == F.col("part"))).alias("home"))

    def work(key, group):
        x = group.column("fp").to_numpy().view(np.uint64)
        lives = group.column("home").to_numpy(zero_copy_only=False)
        a, b = shard_forest(x[lives], x[~lives], vantage & 0xFFFFFFFFFFFFFFFF, radius)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return dealt.groupBy("cell", "part").applyInArrow(work, "a long, b long")


def components(docs: DataFrame, id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """id, fingerprint (16 hex digits) and component_id: the least id that can be reached."""
    rows = checkpointed(with_fingerprints(docs, id, text))
    return _components(rows, radius).select(F.col("id").alias(id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _components(rows: DataFrame, radius: int) -> DataFrame:
    prints = checkpointed(rows.groupBy("fp").agg(F.min("id").alias("first")))
    links = link_fingerprints(prints.select("fp"), radius)
    found = connected_components(links)
    joined = prints.join(found, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    least = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    return rows.join(joined.join(least, "component").select("fp", "component_id"), "fp")


def keep_first(docs: DataFrame, id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """docs with the document of the least id of each component only.

    Rows that repeat both id and text stay once; a document without an id can't be told apart and stays.
    """
    rows = checkpointed(with_fingerprints(docs, id, text))
    first = _components(rows, radius).where(F.col("id") == F.col("component_id")).select(F.col("id").alias("__kept")).distinct()
    out = docs.join(first, F.col(id) == F.col("__kept"), "left_semi").dropDuplicates([id, text])
    return out.unionByName(docs.where(F.col(id).isNull()))
