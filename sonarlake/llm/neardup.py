"""Near-duplicates of 0.8 Jaccard similarity or more on five-word shingles, by SimHash and vantage-point trees, with confirmation.

A text's row holds its 64-bit SimHash of five-word shingles and TREES short ones of 32 further bits each, two in a word.
Each short one has a vantage-point tree as ``simhash`` has it (``tree_links``): the top level is the partitioning, a cell of equal distances
to the tree's vantage point, and each text visits as a guest the later cells within NEAR; inside a task the tree goes on by blocks of 8 and
4 bits, far branches are pruned, leaves are compared exactly. A cell of SORTED pairs or more is one leaf: two texts within NEAR have four of the
eight blocks of 4 bits equal, so each choice of four sorts the cell, and those with equal blocks are compared (a thousandth of random pairs). Texts within NEAR in a tree whose 96 other bits differ in at most WIDE are linked, and
those that links connect form a block; tasks return spanning forests, so a dense group of n texts returns n rows. In a block, pairs at
SimHash distances of at most RADIUS are candidates, and candidates of 0.8 or more link.
The first round proposes each text with its three nearest earlier ones and with one of a tree of
fan-out FAN, so a dense block of n texts proposes O(n) pairs, which are confirmed on the texts. Blocks with candidates
that the first round left out come again: of those only candidates between different components are still open.
Members that have one (``unsettled``) meet again with their sets of shingles (``settle``), all of a block's members
outside its largest component against all members; the tasks count what two sets share and return links that join
components, at most one less than components, whatever the number of candidates. So the components are those of all
candidate pairs. One document of each component stays.

A block of over BLOCK texts is dealt by a hash into parts of that size, and of over GRAMS shingles where sets are
compared. In the first round all parts see some 64 common members, which join the parts' groups; afterwards members
outside the largest component visit every part, in shares of GRAMS shingles. A block of few groups thus costs O(n); one
of many texts that are no copies of each other costs pairs of members within its parts, and their sets are read once for
each part.

At similarity 0.8 a bit of SimHash differs with probability acos(0.889) / pi = 0.152. So two such texts are within 4 of 32
bits in one tree with probability 0.455 and in one of ten with 0.998; their SimHash distance is about 10 of 64 bits, with a deviation of 3.
Of unrelated texts a tree leaves one pair in 10**5, and the 96 other bits one in 30,000 of these.

``similar_components`` takes blocks of any kind, as lists of numbers for each row. ``sketch`` and ``_rows`` give others, bands of four shingle minima;
``keep_first`` doesn't use them.

Defined cases: one row of each component stays, also where ids repeat or are null. A text of fewer than five words is one
shingle; null, empty and blank texts have the same empty set. Very long texts are sketched whole, one at a time. Of equal
texts the row of the least id stays, and of rows that repeat an id and text one. An empty table gives no rows. Columns whose
names begin with two underscores are refused, as the plan uses such. ``settle`` knows shingles by 64-bit hashes.
"""

from __future__ import annotations

from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonarlake.llm import simhash
from sonarlake.llm.graph import connected_components
from sonarlake.llm.session import checkpointed, enter_stage, map_slices
from sonarlake.llm.text import HashMemo, gram_hashes, mix, words_lower
from sonarlake.shared import release

SHINGLE, LEAST, RADIUS, BANDS, ROWS, NEAREST, FAN, BLOCK = 5, 0.8, 20, 10, 4, 3, 64, 4096
#: Distances of a tile, shingles that a confirming task keeps, and shingles of a part whose sets are compared.
TILE, HELD, GRAMS = 1 << 22, 1 << 18, 1 << 20
#: Rows of bands that a task takes at once.
SHARE = 50_000
#: Trees, differing bits within one and of the 96 others; members of a cell before it is split, texts before cells go by halves.
TREES, NEAR, WIDE, CELL, FINE_FROM = 10, 4, 28, 500_000, 3_000_000
#: Pairs of branches that are compared without splitting them; pairs of a cell from which on its blocks are sorted.
LEAF, SORTED = 1 << 24, 1 << 26
#: Pairs that sorted blocks give at once, and pairs of a group from which on what is joined already is left out.
PAIRS, DENSE = 1 << 20, 1 << 16
#: Four bits of each byte: a short SimHash, whose blocks are the bytes' lower halves.
_LOW = 0x0F0F0F0F0F0F0F0F
_WORDS = mix(np.arange(1, TREES // 2 + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_ODD = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingles(text: str | None) -> set[bytes]:
    w = words_lower(text)
    k = min(SHINGLE, len(w))
    return {b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def similarity(a: set, b: set) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


class _Sets(dict):
    """Shingles by key of the text, forgotten when there are over HELD of them."""

    held = 0

    def of(self, key: int, text: str | None) -> set[bytes]:
        found = self.get(key)
        if found is None:
            found = shingles(text)
            if self.held + len(found) > HELD:
                self.clear()
                self.held = 0
            self[key] = found
            self.held += len(found)
        return found


def grams(text: str | None, memo: HashMemo) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    w = words_lower(text)
    return np.unique(gram_hashes(np.fromiter(map(memo.__getitem__, w), np.uint64, len(w)), min(SHINGLE, len(w)))) if w else np.zeros(0, np.uint64)


def sketch(text: str | None, memo: HashMemo) -> tuple[int, int, np.ndarray]:
    """Distinct shingles, SimHash, and bands."""
    found = grams(text, memo)
    g = found if len(found) else np.zeros(1, np.uint64)
    bits, least = np.zeros(64, np.int64), np.full(BANDS * ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
    with np.errstate(over="ignore"):
        for at in range(0, len(g), 4096):
            part = g[at : at + 4096]
            bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            least = np.minimum(least, (part[:, None] * _ODD).min(axis=0))
        bands = np.arange(BANDS, dtype=np.uint64)
        for k in range(ROWS):
            bands = mix(bands + mix(least[k::ROWS]))
    return len(found), int(np.packbits(2 * bits > len(g), bitorder="little").view("<u8")[0]), bands


def prints(text: str | None, memo: HashMemo) -> tuple[int, np.ndarray]:
    """Distinct shingles, and SimHashes: the 64-bit one, then words that hold two short ones each."""
    found = grams(text, memo)
    g = found if len(found) else np.zeros(1, np.uint64)
    bits = np.zeros(64 * (1 + len(_WORDS)), np.int64)
    with np.errstate(over="ignore"):
        for at in range(0, len(g), 4096):
            part = g[at : at + 4096]
            words = np.concatenate([part[:, None], mix(part[:, None] + _WORDS)], axis=1)
            bits += np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return len(found), np.packbits(2 * bits > len(g), bitorder="little").view("<u8")


def _alike(size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether two sets of these sizes can be similar enough."""
    return np.minimum(size[a], size[b]) >= LEAST * np.maximum(size[a], size[b])


def block_pairs(fp: np.ndarray, size: np.ndarray, nearest: int = NEAREST) -> tuple[list[tuple[int, int]], bool]:
    """Proposed pairs of places in a block, and whether all its candidates are among them."""
    n, whole = len(fp), True
    j = np.arange(n)
    parent, digit = j.copy(), 1
    while digit < n:
        parent = np.where((parent == j) & (j % (digit * FAN) > 0), j - j % (digit * FAN), parent)
        digit *= FAN
    near = (np.bitwise_count(fp ^ fp[parent]) <= RADIUS) & (parent < j)
    pairs = [(parent[near], j[near])]
    step = max(1, TILE // n)
    for at in range(0, n, step):
        some = j[at : at + step]
        d = np.bitwise_count(fp[some][:, None] ^ fp[None, : some[-1] + 1])
        d[some[:, None] <= j[None, : some[-1] + 1]] = 99  # earlier ones only
        whole &= bool(((d <= RADIUS).sum(axis=1) <= nearest).all())
        for _ in range(min(nearest, d.shape[1])):
            best = d.shape[1] - 1 - d[:, ::-1].argmin(axis=1)  # the latest of the nearest
            rows = np.flatnonzero(d[np.arange(len(some)), best] <= RADIUS)
            pairs.append((best[rows], some[rows]))
            d[np.arange(len(some)), best] = 99
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
    can = _alike(size, a, b)
    return sorted(set(zip(a[can].tolist(), b[can].tolist(), strict=True))), whole


def candidates(fp: np.ndarray, size: np.ndarray, group: np.ndarray, ask: np.ndarray, home: np.ndarray):
    """Candidates between places ``ask`` and ``home`` of different groups, as two arrays of places, tile by tile."""
    step = max(1, TILE // max(1, len(home)))
    for at in range(0, len(ask), step):
        some = ask[at : at + step]
        near = (np.bitwise_count(fp[some][:, None] ^ fp[home][None, :]) <= RADIUS) & (group[some][:, None] != group[home][None, :])
        i, j = np.nonzero(near)
        can = _alike(size, some[i], home[j])
        yield some[i[can]], home[j[can]]


def joining(fp: np.ndarray, size: np.ndarray, group: np.ndarray, sets: np.ndarray, ask: np.ndarray, home: np.ndarray) -> list[tuple[int, int]]:
    """Similar candidates between places ``ask`` and ``home`` that join different groups, each join once."""
    parent: dict[int, int] = {}

    def top(g: int) -> int:
        while (up := parent.get(g, g)) != g:
            parent[g] = parent.get(up, up)
            g = up
        return g

    # shingles by number, so that a set is a row of marks
    at = np.concatenate([[0], np.cumsum(size)])
    number = np.unique(np.concatenate([np.asarray(x, np.int64) for x in sets]), return_inverse=True)[1]
    marks, out = np.zeros(len(number), bool), []
    for a, b in candidates(fp, size, group, ask, home):
        cuts = np.flatnonzero(a[1:] != a[:-1]) + 1
        for x, y in zip(np.split(a, cuts), np.split(b, cuts), strict=True):
            if not len(x):
                continue
            own, i = number[at[x[0]] : at[x[0] + 1]], int(x[0])
            marks[own] = True
            ends = np.cumsum(size[y])
            both = np.cumsum(marks[number[np.arange(ends[-1]) + np.repeat(at[y] - (ends - size[y]), size[y])]]) if ends[-1] else np.zeros(0, np.int64)
            both = np.diff(np.concatenate([[0], both])[ends], prepend=0)
            marks[own] = False
            for j in y[both >= LEAST * (size[i] + size[y] - both)].tolist():
                p, q = top(int(group[i])), top(int(group[j]))
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    out.append((i, j))
    return out


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    return docs.withColumn("__key", F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))))


def _by_share(dealt: DataFrame, shares: int, work) -> DataFrame:
    """(a, b, band): what ``work`` finds in the band and the columns of each block's part."""
    names = [c for c in dealt.columns if c not in ("band", "part")]

    def each(key, table):
        enter_stage()
        cols = {c: table.column(c).to_numpy() for c in table.column_names}
        order = np.lexsort((cols["key"], cols["part"], cols["band"]))
        cols = {c: v[order] for c, v in cols.items()}
        cuts = np.flatnonzero((np.diff(cols["band"]) != 0) | (np.diff(cols["part"]) != 0)) + 1
        found = set()
        for at, to in zip([0, *cuts.tolist()], [*cuts.tolist(), len(order)], strict=True):
            if to - at > 1:
                found.update(work(int(cols["band"][at]), {c: cols[c][at:to] for c in names}))
        return pa.table({name: pa.array([f[k] for f in found], pa.int64()) for k, name in enumerate(("a", "b", "band"))})

    return dealt.withColumn("share", F.pmod(F.xxhash64("band", "part"), F.lit(max(1, shares)))).groupBy("share").applyInArrow(each, "a long, b long, band long")


def _bands(rows: DataFrame) -> DataFrame:
    return rows.select("key", "size", "fp", F.explode("bands").alias("band"))


def _own(block_parts: Column) -> Column:
    return F.pmod(F.xxhash64("key"), block_parts).cast("int")


def first_round(bands: DataFrame, parts: DataFrame, n: int, nearest: int) -> DataFrame:
    """(a, b, null) of all blocks: the nearest pairs; and (null, null, band) of blocks that have others. Blocks in parts always do."""
    placed = bands.join(parts, "band", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    pivot = (F.col("parts") > 1) & (F.pmod(F.xxhash64("key", F.lit(7)), F.col("parts") * (BLOCK // 64)) == 0)
    every = F.when(pivot, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(_own(F.col("parts"))))
    dealt = placed.select("band", "key", "size", "fp", (F.col("parts") > 1).alias("large"), pivot.alias("pivot"), F.explode(every).alias("part"))

    def work(band, c):
        order = np.argsort(~c["pivot"], kind="stable")  # what all parts see comes first
        pairs, whole = block_pairs(c["fp"].view(np.uint64)[order], c["size"][order], nearest)
        at = c["key"][order[np.array(pairs, np.int64).reshape(-1, 2)]]
        yield from zip(at.min(axis=1).tolist(), at.max(axis=1).tolist(), [None] * len(at), strict=True)
        if not whole or c["large"][0]:
            yield None, None, band

    return _by_share(dealt, -(-n // SHARE), work)


def unsettled(held: DataFrame, parts: DataFrame, n: int) -> DataFrame:
    """(key, band) of members that have candidates in other components, from (band, key, size, fp, group) of whole blocks."""
    sizes = held.groupBy("band", "group").count()
    largest = sizes.groupBy("band").agg(F.max_by("group", F.struct("count", "group")).alias("largest"), F.count("*").alias("groups")).where("groups > 1")
    placed = held.join(largest.select("band", "largest"), "band").join(parts, "band", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    outside = F.col("group") != F.col("largest")
    every = F.when(outside, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(_own(F.col("parts"))))
    dealt = placed.select("band", "key", "size", "fp", "group", outside.alias("outside"), _own(F.col("parts")).alias("own"), F.explode(every).alias("part"))
    dealt = dealt.withColumn("home", F.col("own") == F.col("part")).drop("own")

    def work(band, c):
        open_ = np.zeros(len(c["key"]), bool)
        for a, b in candidates(c["fp"].view(np.uint64), c["size"], c["group"], np.flatnonzero(c["outside"]), np.flatnonzero(c["home"])):
            open_[a] = open_[b] = True
        return ((k, None, band) for k in c["key"][open_].tolist())

    return _by_share(dealt, -(-n // SHARE), work).select(F.col("a").alias("key"), "band").distinct()


def settle(docs: DataFrame, held: DataFrame, text: str, limit: int) -> DataFrame:
    """(a, b): similar candidates that join components, from (band, key, size, fp, group) of unsettled members."""
    load = F.col("size") + 64  # small sets cost rows
    sizes = held.groupBy("band", "group").agg(F.count("*").alias("n"), F.sum(load).alias("load"))
    top = F.struct("n", "group")
    of = sizes.groupBy("band").agg(F.max_by("group", top).alias("largest"), F.sum("load").alias("load"), F.max_by("load", top).alias("rest"))
    of = of.select("band", "largest", F.ceil(F.col("load") / limit).cast("int").alias("parts"), F.greatest(F.ceil((F.col("load") - F.col("rest")) / limit), F.lit(1)).cast("int").alias("chunks"))
    placed = held.join(of, "band")
    at_home = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: _own(F.col("parts")) * F.col("chunks") + c)
    chunk = F.pmod(F.xxhash64("key", F.lit(11)), F.col("chunks")).cast("int")
    visits = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: p * F.col("chunks") + chunk)
    columns = ["band", "key", "size", "fp", "group"]
    home = placed.select(*columns, F.lit(False).alias("ask"), F.explode(at_home).alias("part"))
    ask = placed.where("group <> largest").select(*columns, F.lit(True).alias("ask"), F.explode(visits).alias("part"))
    dealt = checkpointed(home.unionByName(ask))
    total = dealt.agg(F.sum(load)).first()[0] or 0

    def read(batches):
        memo = HashMemo()
        for b in batches:
            got = [grams(t, memo) for t in b.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, got)])
            flat = np.concatenate(got).view(np.int64) if got else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["key", "grams"])

    sets = checkpointed(map_slices(_texts(docs, held.select("key").distinct(), text), read, "key long, grams array<long>"))

    def work(band, c):
        pairs = joining(c["fp"].view(np.uint64), c["size"], c["group"], c["grams"], np.flatnonzero(c["ask"]), np.flatnonzero(~c["ask"]))
        return ((int(c["key"][i]), int(c["key"][j]), None) for i, j in pairs)

    return _by_share(dealt.join(sets, "key"), -(-total // limit), work).select("a", "b").distinct()


def _texts(docs: DataFrame, keys: DataFrame, text: str) -> DataFrame:
    """(key, t): one text of each of the keys."""
    return _keyed(docs.select(text), text).join(keys, F.col("__key") == F.col("key"), "left_semi").groupBy(F.col("__key").alias("key")).agg(F.min(text).alias("t"))


def confirmed(docs: DataFrame, pairs: DataFrame, text: str = "text") -> DataFrame:
    """(a, b): the pairs of keys whose texts are similar."""
    need = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    texts = checkpointed(_texts(docs, need, text))
    one = texts.select(F.col("key").alias("a"), F.col("t").alias("ta"))
    two = texts.select(F.col("key").alias("b"), F.col("t").alias("tb"))

    def confirm(batches):
        sets = _Sets()
        for b in batches:
            ok = [similarity(sets.of(i, x), sets.of(j, y)) >= LEAST for i, j, x, y in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return map_slices(pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb"), confirm, "a long, b long")


def similar_components(docs: DataFrame, rows: DataFrame, text: str = "text", nearest: int = NEAREST, block: int = BLOCK, load: int = GRAMS) -> DataFrame:
    """(node, component) of keys that similar candidates connect, from distinct rows of key, size, fp, bands."""
    bands, n = _bands(rows), BANDS * rows.count()
    parts = checkpointed(bands.groupBy("band").count().where(F.col("count") > block).select("band", F.ceil(F.col("count") / block).cast("int").alias("parts")))
    found = checkpointed(first_round(bands, parts, n, nearest))
    release(docs.sparkSession)
    links = checkpointed(confirmed(docs, found.where("a IS NOT NULL").select("a", "b").distinct(), text))
    release(docs.sparkSession)  # the texts of the pairs
    groups = checkpointed(connected_components(links))
    left = found.where("band IS NOT NULL").select("band").distinct()
    held = bands.join(left, "band", "left_semi").join(groups, F.col("key") == F.col("node"), "left")
    held = checkpointed(held.select("band", "key", "size", "fp", F.coalesce("component", "key").alias("group")))
    again = checkpointed(unsettled(held, parts, n))
    if again.isEmpty():
        return groups
    release(docs.sparkSession)
    more = checkpointed(settle(docs, held.join(again, ["band", "key"], "left_semi"), text, load))
    if more.isEmpty():
        return groups
    return checkpointed(connected_components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)))


class _Forest(simhash._Forest):
    """Unites only places whose other bits are near, too."""

    def __init__(self, fp: np.ndarray, other: np.ndarray):
        super().__init__(len(fp))
        self.fp, self.other = fp, other

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        near = np.bitwise_count(self.fp[a] ^ self.fp[b]) + np.bitwise_count(self.other[a] ^ self.other[b]) <= WIDE
        super().link(a[near], b[near])


def _packed(short: np.ndarray) -> np.ndarray:
    """Short SimHashes as 32 bits: four bits of each byte moved together."""
    for by, kept in ((4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        short = (short | (short >> np.uint64(by))) & np.uint64(kept)
    return short.astype(np.uint32)


def _join(short: np.ndarray, packed: np.ndarray, left: np.ndarray, right: np.ndarray, vantage: int, blocks: int, forest: _Forest) -> None:
    """Links two branches of a tree: large ones are split by finer blocks, far ones pruned, leaves compared exactly in tiles."""
    if blocks > 8 or len(left) * len(right) <= LEAF:
        step = max(1, TILE // 32 // max(1, len(right)))
        for at in range(0, len(left), step):
            part = left[at : at + step]
            found = np.flatnonzero(np.bitwise_count(packed[part][:, None] ^ packed[right][None, :]) <= NEAR)
            if len(found):
                i, j = np.divmod(found, len(right))
                forest.link(part[i], right[j])
        return
    (dl, gl), (dr, gr) = (simhash._branches(short, side, vantage, blocks) for side in (left, right))
    for k in range(len(gl)):
        near = np.flatnonzero(np.abs(dr - dl[k]).sum(axis=1) <= NEAR)
        if len(near):
            _join(short, packed, gl[k], np.concatenate([gr[j] for j in near]), vantage, 2 * blocks, forest)


def _roots(forest: _Forest, at: np.ndarray) -> np.ndarray:
    at = forest.up[at]
    while (forest.up[at] != at).any():
        at = forest.up[at]
    return at


def _dense_group(packed: np.ndarray, lives: np.ndarray, members: np.ndarray, forest: _Forest) -> None:
    """Links the members of a large group, by comparing those outside its largest component with all."""
    for a, b in ((members[:-1], members[1:]), (np.repeat(members[:1], len(members) - 1), members[1:])):
        near = (np.bitwise_count(packed[a] ^ packed[b]) <= NEAR) & (lives[a] | lives[b])
        forest.link(a[near], b[near])
    root, count = np.unique(roots := _roots(forest, members), return_counts=True)
    outside = members[roots != root[count.argmax()]]
    step = max(1, TILE // 32 // len(members))
    for at in range(0, len(outside), step):
        part = outside[at : at + step]
        i, j = np.divmod(np.flatnonzero(np.bitwise_count(packed[part][:, None] ^ packed[members][None, :]) <= NEAR), len(members))
        a, b = part[i], members[j]
        some = lives[a] | lives[b]
        forest.link(a[some], b[some])


def _join_sorted(packed: np.ndarray, lives: np.ndarray, forest: _Forest) -> None:
    """Links members of a cell to each other and to guests, by sorted blocks.

    Of the eight blocks of 4 bits, two within NEAR have at least 8 - NEAR equal, so each choice of so many blocks sorts all, and those
    with equal blocks are compared.
    """
    first = np.argsort(~lives, kind="stable")  # members come before guests, in each group too
    ordered, home = packed[first], int(lives.sum())
    nibbles = [((ordered >> np.uint32(4 * k)) & np.uint32(15)).astype(np.uint16) for k in range(8)]
    for chosen in combinations(range(8), 8 - NEAR):
        key = nibbles[chosen[0]].copy()
        for n, k in enumerate(chosen[1:], 1):
            key |= nibbles[k] << np.uint16(4 * n)
        order = np.argsort(key, kind="stable")
        sizes = np.bincount(key, minlength=1 << 16)
        begins = np.cumsum(sizes) - sizes
        living = np.bincount(key[:home], minlength=1 << 16)
        dense = np.flatnonzero(living * sizes >= DENSE)
        for g in dense.tolist():
            _dense_group(packed, lives, first[order[begins[g] : begins[g] + sizes[g]]], forest)
        living[dense] = 0
        # Each member meets what follows it in its group.
        used = np.flatnonzero(living)
        place = np.arange(int(living.sum())) - np.repeat(np.cumsum(living[used]) - living[used], living[used])
        left = np.repeat(begins[used], living[used]) + place
        after = np.repeat(sizes[used], living[used]) - place - 1
        ends, x = np.cumsum(after), ordered[order]
        cuts = np.searchsorted(ends, np.arange(0, int(ends[-1]) if len(ends) else 0, PAIRS), "right")
        for at, to in pairwise([*cuts.tolist(), len(left)]):
            n = after[at:to]
            i = np.repeat(left[at:to], n)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
            near = np.flatnonzero(np.bitwise_count(x[i] ^ x[j]) <= NEAR)
            forest.link(first[order[i[near]]], first[order[j[near]]])


def cell_forest(word: np.ndarray, fp: np.ndarray, lives: np.ndarray, tree: int, vantage: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, root) of a spanning forest of the links among a cell's members and from them to its guests."""
    low, high = word & np.uint64(_LOW), (word >> np.uint64(4)) & np.uint64(_LOW)
    short, other = (high, low) if tree % 2 else (low, high)
    forest = _Forest(fp, other)
    home, guests = np.flatnonzero(lives), np.flatnonzero(~lives)
    packed = _packed(short)
    if len(home) * len(word) >= SORTED:
        _join_sorted(packed, lives, forest)
    else:
        _join(short, packed, home, home, vantage, 4, forest)
        _join(short, packed, home, guests, vantage, 4, forest)
    roots = forest.up
    while (roots[roots] != roots).any():
        roots = roots[roots]
    moved = np.flatnonzero(roots != np.arange(len(roots)))
    return moved, roots[moved]


def tree_links(rows: DataFrame, cell: int = CELL, fine_from: int = FINE_FROM) -> DataFrame:
    """(a, b): links between keys, from distinct rows of key, fp, words, that have the components of all links of all trees."""
    n, least = rows.agg(F.count("*"), F.min(F.struct(F.xxhash64("key").alias("h"), "words"))).first()
    if not n:
        return rows.select(F.col("key").alias("a"), F.col("key").alias("b"))
    # each tree's vantage point is a text's short SimHash
    points = [((w & 0xFFFFFFFFFFFFFFFF) >> (4 * half)) & _LOW for w in least["words"] for half in (0, 1)]
    blocks = 1 if n < fine_from else 2
    width = 64 // blocks

    def placed_in(tree: int) -> Column:
        word = F.col("words")[tree // 2]
        away = F.shiftrightunsigned(word, 4 * (tree % 2)).bitwiseAND(F.lit(_LOW)).bitwiseXOR(F.lit(points[tree]))
        some = F.lit((1 << width) - 1 if blocks > 1 else -1).cast("long")
        dist = [F.bit_count(F.shiftrightunsigned(away, width * k).bitwiseAND(some)) for k in range(blocks)]
        return F.struct(F.lit(tree).alias("tree"), word.alias("word"), F.array(*dist).alias("d"))

    code = lambda ds: sum((d * (65**k) for k, d in enumerate(ds)), F.lit(0)).cast("int")
    placed = rows.select("key", "fp", F.explode(F.array(*map(placed_in, range(TREES)))).alias("t")).select("key", "fp", "t.*")
    own_cell = code([F.col("d")[k] for k in range(blocks)])
    counts = placed.groupBy("tree", own_cell.alias("cell")).count()
    parts = counts.select("tree", "cell", F.ceil(F.col("count") / cell).cast("int").alias("parts"))  # a row for each cell that is in use
    offsets = [(0,) * blocks, *simhash._offsets(blocks, NEAR)]
    moved = placed.withColumn("o", F.explode(F.array(*(F.array(*map(F.lit, o)) for o in offsets))))
    spread = moved.select("tree", code([F.col("d")[k] + F.col("o")[k] for k in range(blocks)]).alias("cell"), "key", "fp", "word", F.forall("o", lambda x: x == 0).alias("home"))
    # Guests of cells that nobody lives in fall out in the join; a member visits the later parts of its own cell.
    spread = spread.join(F.broadcast(parts), ["tree", "cell"]).withColumn("own", _own(F.col("parts")))
    dealt = spread.withColumn("part", F.explode(F.sequence(F.when(F.col("home"), F.col("own")).otherwise(0), F.col("parts") - 1)))
    dealt = dealt.select("tree", "cell", "part", "key", "fp", "word", (F.col("home") & (F.col("own") == F.col("part"))).alias("home"))

    def work(group, table):
        enter_stage()
        tree, key = group[0].as_py(), table.column("key").to_numpy()
        word, fp = (table.column(c).to_numpy().view(np.uint64) for c in ("word", "fp"))
        at, root = cell_forest(word, fp, table.column("home").to_numpy(zero_copy_only=False), tree, points[tree])
        return pa.table({"a": pa.array(key[at]), "b": pa.array(key[root])})

    return dealt.groupBy("tree", "cell", "part").applyInArrow(work, "a long, b long")


def tree_blocks(rows: DataFrame) -> DataFrame:
    """key, size, fp, bands: rows that the trees link to others, with the number of their block."""
    found = connected_components(checkpointed(tree_links(rows)))
    return rows.join(found, F.col("key") == F.col("node")).select("key", "size", "fp", F.array("component").alias("bands"))


def _rows(docs: DataFrame, id: str, text: str) -> DataFrame:
    def work(batches):
        memo = HashMemo()
        for b in batches:
            got = [sketch(t, memo) for t in b.column(2).to_pylist()]
            flat = pa.array(np.concatenate([g[2] for g in got]).view(np.int64) if got else np.zeros(0, np.int64))
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(got) + 1) * BANDS, pa.int32()), flat)
            prints = pa.array(np.array([g[1] for g in got], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([g[0] for g in got], pa.int64()), prints, bands], ["id", "key", "size", "fp", "bands"])

    keyed = _keyed(docs, text).select(F.col(id).cast("long").alias("id"), F.col("__key").alias("key"), F.col(text).cast("string"))
    return checkpointed(map_slices(keyed, work, "id long, key long, size long, fp long, bands array<long>"))


def _printed(docs: DataFrame, id: str, text: str) -> DataFrame:
    def work(batches):
        memo = HashMemo()
        for b in batches:
            got = [prints(t, memo) for t in b.column(2).to_pylist()]
            found = np.array([g[1] for g in got], np.uint64).reshape(len(got), 1 + TREES // 2).view(np.int64)
            words = pa.ListArray.from_arrays(pa.array(np.arange(len(got) + 1) * (TREES // 2), pa.int32()), pa.array(found[:, 1:].ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([g[0] for g in got], pa.int64()), pa.array(found[:, 0]), words], ["id", "key", "size", "fp", "words"])

    keyed = _keyed(docs, text).select(F.col(id).cast("long").alias("id"), F.col("__key").alias("key"), F.col(text).cast("string"))
    return checkpointed(map_slices(keyed, work, "id long, key long, size long, fp long, words array<long>"))


def keep_first(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component only: of the least id, null ids last, then of the least key of the text."""
    if taken := [c for c in docs.columns if c.startswith("__")]:
        raise ValueError(f"columns {taken}: names that begin with two underscores are the plan's")
    rows = _printed(docs, id, text)
    blocks = checkpointed(tree_blocks(checkpointed(rows.select("key", "size", "fp", "words").dropDuplicates(["key"]))))
    release(docs.sparkSession)
    found = similar_components(docs, blocks, text)
    placed = rows.select("id", "key").join(found, F.col("key") == F.col("node"), "left").select("id", "key", F.coalesce("component", "key").alias("component"))
    release(docs.sparkSession)
    least = placed.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("r")).select(F.col("r.id").alias("__id"), F.col("r.key").alias("__kept"))
    out = _keyed(docs, text).join(least, (F.col("__key") == F.col("__kept")) & F.col(id).cast("long").eqNullSafe(F.col("__id")), "left_semi")
    return out.dropDuplicates(["__key", id]).drop("__key")
