"""Conversation structure repair: the cheapest edits that make roles follow ``(s?(ua)+)?``, by a time-major array DP.

Edits of a conversation's turns, in order: Keep costs 0, Rerole to user or assistant 2, Delete 3 (the only one for blank and
repeated turns), Insert an empty user or assistant turn 2; a truncated turn that isn't deleted adds 1. A state is what the
roles so far amount to: nothing, a system turn, a user turn last, an assistant turn last. Tasks take conversations in
order, bucket them by length, and step all conversations of a bucket back through time at once: arrays of (turn, state,
conversation) hold the least cost of the rest. The way forward, again of all at once, takes the ASCII-least initial among
the edits that keep to that cost.

A conversation of more than ``LONG_ROWS`` turns or ``LONG_BYTES`` of text isn't gathered in one task: its turns are dealt by
ranges and cut into chunks, repeats are found by an aggregate, a chunk becomes the matrix of its least costs between
states, the matrices are chained, and each chunk then traces its own edits from the states that the chain gives it. Only
its result, which is one row with all repaired turns, comes together, as any row must.

Defined cases: a null role or text is one blank. Turns go by turn (null first), then role, then a hash of the text; equal
rows stay beside each other. The initial of an empty role is none that is allowed. A null id is a conversation of its own.
Repeated rows are turns like any other, so all but the first are duplicates. Very long texts only count as their last
characters, and stand whole in the result. A conversation without turns has zeros and an empty audit. An empty table gives
no rows. Only the named columns are read, so others can have any names. Turns are longs; text that is no number stops the
query with Spark's cast error.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonarlake.llm.session import checkpointed, map_slices

#: Above these a conversation is cut into chunks of LONG_ROWS turns.
LONG_ROWS, LONG_BYTES = 20_000, 64 << 20
#: Long conversations whose ids are broadcast (some 16 MB); above it they are joined.
LONG_IDS = 1_000_000
#: Characters and turns that a task gathers before it repairs them.
FLUSH_CHARS, FLUSH_TURNS = 8_000_000, 50_000

SPACES, ENDS = " \t\n\x0b\x0c\r", ".!?"
RETYPE, DELETE, INSERT = 2, 3, 2
START, SYSTEM, USER, ASSISTANT = range(4)
NONE = 1 << 40  # the cost of what can't be done
#: The state after a kept turn, by state and initial (s, u, a, other); 4 is no state. And after a new user or assistant turn.
KEPT = np.array([[SYSTEM, USER, 4, 4], [4, USER, 4, 4], [4, 4, ASSISTANT, 4], [4, USER, 4, 4]])
FILLED = np.array([USER, USER, ASSISTANT, USER])
ROLE = {USER: "user", ASSISTANT: "assistant"}
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_INITIAL = {"s": 0, "u": 1, "a": 2}
_FINE = np.zeros((4, 4), bool)
_FINE[[0, 1, 2], [1, 2, 1]] = True  # su, ua, au


def end_costs(conversations: int = 1) -> np.ndarray:
    """Costs after the last turn: done, or turns still to be inserted."""
    return np.repeat(np.array([0, 2 * INSERT, INSERT, 0])[:, None], conversations, 1)


def backward(initial: np.ndarray, bad: np.ndarray, cut: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Least costs (turn, state, conversation) from before each turn on; ``end`` holds those after the last."""
    steps, n = initial.shape
    costs = np.empty((steps + 1, 4, n), np.int64)
    costs[steps] = end
    padded = np.full((5, n), NONE)
    for t in range(steps - 1, -1, -1):
        after = costs[t + 1]
        padded[:4] = after
        kept = np.take_along_axis(padded, KEPT[:, initial[t]], 0)
        used = np.minimum(kept, RETYPE + after[FILLED]) + cut[t]
        now = np.minimum(np.where(bad[t], NONE, used), DELETE + after)
        for _ in range(3):  # no cheapest way inserts more than three turns in one place
            now = np.minimum(now, INSERT + now[FILLED])
        costs[t] = np.minimum(now, NONE)
    return costs


def forward(costs: np.ndarray, initial: np.ndarray, bad: np.ndarray, cut: np.ndarray, state: np.ndarray, last: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The edits of all conversations, step by step: initials (0 past the end), the turns that they are at, states after them.

    A chunk that isn't the ``last`` ends at its last turn; what is inserted after that belongs to the next.
    """
    steps, n = initial.shape
    at, who = np.zeros(n, np.int64), np.arange(n)
    pad = lambda x: np.concatenate([x, np.zeros((1, n), x.dtype)])
    initial, bad, cut = pad(initial), pad(bad), pad(cut)
    state = state.copy()
    edits, places, states = [], [], []
    while True:
        inside = at < steps
        here, following = costs[at, state, who], np.minimum(at + 1, steps)
        going = inside | (here > 0) if last else inside
        if not going.any():
            break
        i, extra = initial[at, who], cut[at, who]
        kept, filled = KEPT[state, i], FILLED[state]
        use = inside & ~bad[at, who]
        ways = [  # in the order of their initials
            (b"D", inside & (DELETE + costs[following, state, who] == here), state, 1),
            (b"I", INSERT + costs[at, filled, who] == here, filled, 0),
            (b"K", use & (kept < 4) & (extra + costs[following, np.minimum(kept, 3), who] == here), kept, 1),
            (b"R", use & (RETYPE + extra + costs[following, filled, who] == here), filled, 1),
        ]
        edit, place, free = np.zeros(n, np.uint8), at.copy(), going.copy()
        for letter, can, then, move in ways:
            take = free & can
            edit[take], state[take] = ord(letter), then[take]
            at[take] += move
            free &= ~take
        edits.append(edit)
        places.append(place)
        states.append(state.copy())
    none = np.zeros((0, n), np.int64)
    return tuple(np.stack(x) if x else none for x in (edits, places, states))


def faults(roles: list[str], texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Initials, and the first fault of each turn: 1 blank, 2 duplicate, 3 truncated, else 0."""
    seen, out = set(), np.zeros(len(roles), np.int64)
    for k, turn in enumerate(zip(roles, texts, strict=True)):
        body = turn[1].rstrip(SPACES)
        out[k] = 1 if not body else 2 if turn in seen else 3 if body[-1] not in ENDS else 0
        seen.add(turn)
    return np.array([_INITIAL.get(r[:1], 3) for r in roles], np.int64), out


def _conversation(turns: list) -> dict:
    numbers = {t for t, _, _ in turns if t is not None}
    initial, fault = faults([r for _, r, _ in turns], [x for _, _, x in turns])
    out = {"gaps": max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, "illegal": int((~_FINE[initial[:-1], initial[1:]]).sum())}
    return out | {"blank": int((fault == 1).sum()), "duplicate": int((fault == 2).sum()), "truncated": int((fault == 3).sum()), "initial": initial, "fault": fault}


def repair_all(conversations: list[list]) -> list[dict]:
    """Faults, cost, audit and repaired turns of conversations of (turn, role, text); those of one length go together."""
    out = [_conversation(c) for c in conversations]
    lengths = defaultdict(list)
    for k, c in enumerate(conversations):
        lengths[len(c)].append(k)
    for members in lengths.values():
        initial = np.stack([out[k]["initial"] for k in members], 1)
        fault = np.stack([out[k]["fault"] for k in members], 1)
        bad, cut = (fault == 1) | (fault == 2), (fault == 3).astype(np.int64)
        costs = backward(initial, bad, cut, end_costs(len(members)))
        edits, places, states = forward(costs, initial, bad, cut, np.zeros(len(members), np.int64))
        for n, k in enumerate(members):
            letters = edits[:, n][edits[:, n] > 0].astype(np.uint8).tobytes().decode()
            turns = []
            for letter, at, state in zip(letters, places[:, n].tolist(), states[:, n].tolist(), strict=False):
                if letter != "D":
                    _, role, text = conversations[k][at] if letter != "I" else (None, None, "")
                    turns.append({"role": role if letter == "K" else ROLE[state], "text": text})
            out[k] |= {"cost": int(costs[0, START, n]), "audit": letters, "repaired": turns}
    return out


def _schema(rows: DataFrame) -> T.StructType:
    fields = [T.StructField(c, T.LongType()) for c in COUNTS]
    turns = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))
    return T.StructType([T.StructField("conv", rows.schema["conv"].dataType), *fields, T.StructField("audit", T.StringType()), T.StructField("repaired", turns)])


def _whole(rows: DataFrame) -> DataFrame:
    """Conversations that a task can hold; their turns come in order, so a task streams through them."""

    def work(batches):
        held, chars, turns = [], 0, 0  # [id, turns of a conversation]
        kind = None

        def emit(done):
            found = repair_all([c for _, c in done])
            columns = [pa.array([i for i, _ in done], kind), *(pa.array([f[c] for f in found], pa.int64()) for c in COUNTS), pa.array([f["audit"] for f in found], pa.string())]
            columns.append(pa.array([f["repaired"] for f in found], pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))))
            return pa.RecordBatch.from_arrays(columns, ["conv", *COUNTS, "audit", "repaired"])

        for b in batches:
            kind = b.schema.field(0).type
            for conv, turn, role, text, there in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not held or held[-1][0] != conv:
                    if chars > FLUSH_CHARS or turns > FLUSH_TURNS:
                        yield emit(held)
                        held, chars, turns = [], 0, 0
                    held.append([conv, []])
                if there:
                    held[-1][1].append((turn, role, text))
                    chars, turns = chars + len(text), turns + 1
        if held:
            yield emit(held)

    dealt = rows.repartition("conv").sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", F.xxhash64("text"))
    return map_slices(dealt, work, _schema(rows))


def _arrays(table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Initials, whether a turn must go, and its extra cost, of one chunk in order."""
    initial, fault = (table.sort_by("at").column(c).to_numpy().astype(np.int64)[:, None] for c in ("initial", "fault"))
    return initial, (fault == 1) | (fault == 2), (fault == 3).astype(np.int64)


def _chunked(rows: DataFrame, chunk_rows: int) -> DataFrame:
    """Conversations of any length, by chunks."""
    kind = rows.schema["conv"].dataType.simpleString()
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "_h", "_n"]
    named = rows.where("there").drop("there").withColumns({"_h": F.xxhash64("text"), "_n": F.monotonically_increasing_id()})
    sorted_ = named.repartitionByRange(*order).sortWithinPartitions(*order).drop("_h", "_n")
    # The number of a turn rises over all ranges; a chunk is some turns of one range.
    placed = checkpointed(sorted_.withColumn("at", F.monotonically_increasing_id()))
    low = F.col("at").bitwiseAND((1 << 33) - 1)
    chunk = F.col("at") - low + (low - low % chunk_rows)
    first = placed.groupBy("conv", F.sha2(F.to_json(F.struct("role", "text")), 256)).agg(F.min("at").alias("_first")).select("_first")
    # Of equal turns all but the first are duplicates; turns meet by their unique numbers, so equal ones don't gather.
    body = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = F.when(body == "", 1).when(F.col("_first").isNull(), 2).when(~F.right(body, F.lit(1)).isin(*ENDS), 3).otherwise(0)
    letter = F.substring("role", 1, 1)
    initial = F.coalesce(*(F.when(letter == k, v) for k, v in _INITIAL.items()), F.lit(3))
    codes = checkpointed(placed.join(first, F.col("at") == F.col("_first"), "left").select("conv", chunk.alias("chunk"), "at", initial.cast("int").alias("initial"), fault.cast("int").alias("fault")))

    def matrix(table):
        initial, bad, cut = _arrays(table)
        ends = np.where(np.eye(4, dtype=bool), 0, NONE)
        four = lambda x: np.repeat(x, 4, 1)
        costs = backward(four(initial), four(bad), four(cut), ends)[0]
        codes = initial[:, 0]
        found = {
            "conv": table.column("conv")[:1], "chunk": table.column("chunk")[:1], "costs": pa.array([costs.ravel().tolist()]), "first": pa.array([int(codes[0])]), "last": pa.array([int(codes[-1])]),
            "blank": pa.array([int((table.column("fault").to_numpy() == 1).sum())]), "duplicate": pa.array([int((table.column("fault").to_numpy() == 2).sum())]),
            "truncated": pa.array([int(cut.sum())]), "illegal": pa.array([int((~_FINE[codes[:-1], codes[1:]]).sum())]),
        }
        return pa.table(found)

    matrices = codes.groupBy("conv", "chunk").applyInArrow(matrix, f"conv {kind}, chunk long, costs array<long>, first long, last long, blank long, duplicate long, truncated long, illegal long")

    def chain(table):
        """From the last chunk to the first the costs of the rest, then from the first to the last the states."""
        rows = table.sort_by("chunk").to_pylist()
        after = [end_costs()[:, 0]]
        grids = [np.array(r["costs"]).reshape(4, 4) for r in rows]  # from state, to state
        for g in reversed(grids):
            after.append(np.minimum((g + after[-1][None, :]).min(1), NONE))
        after.reverse()
        illegal = sum(r["illegal"] for r in rows) + sum(not _FINE[a["last"], b["first"]] for a, b in zip(rows, rows[1:], strict=False))
        out = {c: sum(r[c] for r in rows) for c in ("blank", "duplicate", "truncated")} | {"illegal": int(illegal), "cost": int(after[0][START])}
        return pa.table({"conv": table.column("conv"), "chunk": [r["chunk"] for r in rows], "after": [a.tolist() for a in after[1:]], "last": [k == len(rows) - 1 for k in range(len(rows))],
                         **{c: [v] * len(rows) for c, v in out.items()}})

    chained = checkpointed(matrices.groupBy("conv").applyInArrow(chain, f"conv {kind}, chunk long, after array<long>, last boolean, blank long, duplicate long, truncated long, illegal long, cost long"))

    def trace(codes_, plan):
        """The edits of a chunk for each state that it may be entered in."""
        initial, bad, cut = _arrays(codes_)
        after, last = plan.to_pylist()[0]["after"], plan.to_pylist()[0]["last"]
        four = lambda x: np.repeat(x, 4, 1)
        costs = backward(four(initial), four(bad), four(cut), np.repeat(np.array(after)[:, None], 4, 1))
        able = costs[0, np.arange(4), np.arange(4)] < NONE
        entered = np.flatnonzero(able)
        edits, places, states = forward(costs[:, :, entered], initial.repeat(len(entered), 1), bad.repeat(len(entered), 1), cut.repeat(len(entered), 1), entered, last)
        at = np.sort(codes_.column("at").to_numpy())
        rows = []
        for n, state in enumerate(entered.tolist()):
            letters = edits[:, n][edits[:, n] > 0].astype(np.uint8).tobytes().decode()
            left = int(states[-1, n]) if len(states) else state
            steps = [{"at": int(at[min(p, len(at) - 1)]), "edit": e, "state": int(s)} for e, p, s in zip(letters, places[:, n].tolist(), states[:, n].tolist(), strict=False)]
            rows.append({"state": state, "left": left, "steps": steps})
        n = len(rows)
        return pa.table({"conv": pa.concat_arrays([codes_.column("conv")[:1].combine_chunks()] * n), "chunk": [codes_.column("chunk")[0].as_py()] * n, "entered": [r["state"] for r in rows],
                         "left": [r["left"] for r in rows], "steps": pa.array([r["steps"] for r in rows], pa.list_(pa.struct([("at", pa.int64()), ("edit", pa.string()), ("state", pa.int64())])))})

    traced = codes.groupBy("conv", "chunk").cogroup(chained.groupBy("conv", "chunk")).applyInArrow(
        trace, f"conv {kind}, chunk long, entered long, left long, steps array<struct<at:long,edit:string,state:long>>")
    traced = checkpointed(traced)

    def walk(table):
        """The state in which each chunk is entered."""
        ways = {(r["chunk"], r["entered"]): r["left"] for r in table.to_pylist()}
        out, state = [], START
        for c in sorted({c for c, _ in ways}):
            out.append((c, state))
            state = ways[c, state]
        return pa.table({"conv": table.column("conv")[: len(out)], "chunk": [c for c, _ in out], "entered": [s for _, s in out]})

    walked = traced.select("conv", "chunk", "entered", "left").groupBy("conv").applyInArrow(walk, f"conv {kind}, chunk long, entered long")
    same = F.col("a.conv").eqNullSafe(F.col("b.conv")) & (F.col("a.chunk") == F.col("b.chunk")) & (F.col("a.entered") == F.col("b.entered"))
    edits = traced.alias("a").join(walked.alias("b"), same, "left_semi").select("conv", F.posexplode("steps").alias("step", "s")).select("conv", "step", "s.*")
    there = placed.select(F.col("at").alias("_at"), F.col("role").alias("_role"), F.col("text").alias("_text"))
    role = F.when(F.col("edit") == "K", F.col("_role")).when(F.col("state") == USER, ROLE[USER]).otherwise(ROLE[ASSISTANT])
    turn = F.when(F.col("edit") != "D", F.struct(role.alias("role"), F.when(F.col("edit") == "I", "").otherwise(F.col("_text")).alias("text")))
    steps = edits.join(there, F.col("at") == F.col("_at")).select("conv", F.struct("at", "step", "edit", turn.alias("turn")).alias("e"))
    gathered = steps.groupBy("conv").agg(F.array_sort(F.collect_list("e")).alias("e")).select(
        "conv", F.array_join("e.edit", "").alias("audit"), F.filter("e.turn", lambda t: t.isNotNull()).alias("repaired"))
    gaps = placed.groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps"))
    whole = chained.where("last").drop("chunk", "after", "last")
    on = lambda x, y: x["conv"].eqNullSafe(y["conv"])
    out = whole.join(gaps, on(whole, gaps)).drop(gaps["conv"])
    return out.join(gathered, on(out, gathered)).drop(gathered["conv"]).select("conv", *COUNTS, "audit", "repaired")


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", there: Column | None = None,
           long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES) -> DataFrame:
    """One row per conversation: its faults, the least cost, the edits' initials (audit), and the repaired turns.

    there: false for rows that only name their conversation (true for all, if not given).
    """
    shown = F.lit(True) if there is None else F.coalesce(there, F.lit(False))
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    named = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), blank(role).alias("role"), blank(text).alias("text"), shown.alias("there"))
    sizes = named.where("there").groupBy("conv").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    large = checkpointed(sizes.where((F.col("n") > long_rows) | (F.col("bytes") > long_bytes)).select(F.col("conv").alias("_long")))
    count = large.count()
    if not count:
        out = _whole(named)
    else:
        ids = F.broadcast(large) if count <= LONG_IDS else large
        same = F.col("conv").eqNullSafe(F.col("_long"))
        out = _whole(named.join(ids, same, "left_anti")).unionByName(_chunked(named.join(ids, same, "left_semi"), long_rows))
    return out.withColumnRenamed("conv", conv)


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Turns damaged by a hash of conversation and turn, to try a repair on: dropped (``there`` is false), emptied, without stops, repeated, or given to the user."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank(conv), F.lit(":"), blank(turn))) % 20
    body = F.when(kind == 1, "").when(kind == 2, F.translate(blank(text), ENDS, "")).otherwise(blank(text))
    damaged = rows.select(F.col(conv).alias(conv), F.col(turn).alias(turn), F.when(kind == 4, ROLE[USER]).otherwise(blank(role)).alias(role), body.alias(text), (kind != 0).alias("there"),
                          F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias("_copy"))
    return damaged.drop("_copy")
