import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import cache

import pytest

from sonarlake.llm import convrepair
from sonarlake.llm.queries import op11_conversation_repair

SPACE = re.compile(r"[\x20\x09-\x0D]")


def plain_repair(turns):
    """Faults, and the best of all edits by (cost, initials), of turns (turn, role, text) in order."""
    fault, seen = [], set()
    for _, role, text in turns:
        last = SPACE.sub("", text)[-1:]
        fault.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
        seen.add((role, text))
    word = re.compile(r"(s?(ua)+)?")
    prefix = {"": 0, "s": 1, "u": 2, "a": 3}
    follow = lambda state, c: prefix.get(c) if (state, c) in {(0, "s"), (0, "u"), (1, "u"), (2, "a"), (3, "u")} else None
    name = {"u": "user", "a": "assistant"}

    @cache
    def best(i, state, inserts):
        """(cost, initials, roles and texts) from turn i on."""
        ways = [(0, "", ())] if i == len(turns) and state in (0, 3) else []
        options = []
        if i < len(turns):
            _, role, text = turns[i]
            options.append((3, "D", state, None, i + 1, 0))
            if fault[i] not in ("blank", "duplicate"):
                extra = fault[i] == "truncated"
                options += [(extra, "K", follow(state, role[:1]), (role, text), i + 1, 0), *((2 + extra, "R", follow(state, c), (name[c], text), i + 1, 0) for c in "ua")]
        if inserts < 3:
            options += [(2, "I", follow(state, c), (name[c], ""), i, inserts + 1) for c in "ua"]
        for cost, letter, then, turn, j, k in options:
            if then is not None and (rest := best(j, then, k)):
                ways.append((cost + rest[0], letter + rest[1], ((turn,) if turn else ()) + rest[2]))
        return min(ways, key=lambda w: w[:2], default=None)

    cost, audit, repaired = best(0, 0, 0)
    assert word.fullmatch("".join(r[0] for r, _ in repaired))
    numbers = {t for t, _, _ in turns if t is not None}
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(turns, turns[1:], strict=False)]
    return (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, fault.count("blank"), fault.count("duplicate"), fault.count("truncated"),
            sum(p not in ("su", "ua", "au") for p in pairs), int(cost), audit, [tuple(t) for t in repaired])


def rows_at_random(rng, conversations, most=9):
    texts = ["Yes.", "No", "Why?", "", " \t\n", "one two three!", "é 日本", "a.", "x" * 3000, "end. \x0b\r", "ok\x85", "."]
    out = []
    for c in range(conversations):
        for t in range(rng.randrange(1, most)):
            if rng.random() < 0.8:
                role = ("system" if t == 0 and rng.random() < 0.3 else "user" if t % 2 == 0 else "assistant") if rng.random() < 0.7 else rng.choice(["user", "assistant", "system", "tool", "", None, "User"])
                out.append((c if c else None, None if rng.random() < 0.05 else t, role, f"{t} {rng.choice(texts)}" if rng.random() < 0.6 else rng.choice([*texts, None])))
    return out


def by_conversation(rows):
    """In the operator's order, for rows whose (turn, role) are not repeated with other texts."""
    out = defaultdict(list)
    for c, t, r, x in rows:
        out[c].append((t, " " if r is None else r, " " if x is None else x))
    return {c: sorted(v, key=lambda t: (t[0] is not None, t[0] or 0, t[1])) for c, v in out.items()}


def distinct_places(rows):
    seen, out = set(), []
    for r in rows:
        if (r[0], r[1], " " if r[2] is None else r[2]) not in seen:
            seen.add((r[0], r[1], " " if r[2] is None else r[2]))
            out.append(r)
    return out


SCHEMA = "conv_id long, turn long, role string, text string, there string, conv int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def results(df):
    return {r["conv_id"]: (*(r[c] for c in convrepair.COUNTS), r["audit"], [tuple(t) for t in r["repaired"]]) for r in df.collect()}


@pytest.mark.parametrize("options", [{}, {"long_rows": 3}, {"long_rows": 1}, {"long_bytes": 500}])
def test_repair_against_all_edits(spark, options):
    rows = distinct_places(rows_at_random(random.Random(8), 150))
    got = convrepair.repair(table(spark, rows).repartition(5), **options)
    assert got.columns == ["conv_id", *convrepair.COUNTS, "audit", "repaired"]
    want = {c: plain_repair(v) for c, v in by_conversation(rows).items()}
    assert results(got) == want and got.count() == len(want)


def test_equal_rows_and_one_long_conversation(spark):
    """Most rows are one conversation, and most of these are one row."""
    rng = random.Random(9)
    long = [(5, t, "user" if t % 2 == 0 else "assistant", f"said {t}." if t % 7 else "same") for t in range(300)]
    rows = long + [(5, 150, "user", "said 150.")] * 200 + distinct_places(rows_at_random(rng, 20))[3:]
    rows = [r for r in rows if r[0] != 5 or r in long or r[3] == "said 150."]
    want = {c: plain_repair(v) for c, v in by_conversation(rows).items()}
    whole, chunked = (results(convrepair.repair(table(spark, rows).repartition(4), long_rows=k)) for k in (20_000, 40))
    assert whole == want and chunked == want and want[5][2] >= 200


def test_forward_and_backward_on_random_codes():
    rng = random.Random(10)
    roles, texts = ["system", "user", "assistant", "tool"], ["a.", "b", " ", "c!"]
    conversations = [[(t, rng.choice(roles), rng.choice(texts)) for t in range(rng.randrange(0, 7))] for _ in range(400)]
    for c, found in zip(conversations, convrepair.repair_all(conversations), strict=True):
        assert (*(found[k] for k in convrepair.COUNTS), found["audit"], [(t["role"], t["text"]) for t in found["repaired"]]) == plain_repair(c)


def plain_damage(rows):
    blank = lambda x: " " if x is None else str(x)
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{blank(c)}:{blank(t)}".encode()) % 20
        r, x = blank(r), blank(x)
        x = "" if kind == 1 else re.sub(r"[.!?]", "", x) if kind == 2 else x
        yield from [(c, t, "user" if kind == 4 else r, x, kind != 0)] * (2 if kind == 3 else 1)


def test_query_against_brute_force(spark, tmp_path):
    rows = distinct_places(rows_at_random(random.Random(11), 300)) + [(9001, 0, "user", "gone.")]
    table(spark, rows).select("conv_id", "turn", "role", "text").write.parquet(f"{tmp_path}/conversations.parquet")
    damaged = list(plain_damage(rows))
    by = by_conversation([d[:4] for d in damaged if d[4]])
    want = {}
    for c in {r[0] for r in rows}:
        *counts, audit, repaired = plain_repair(by.get(c, []))
        want[c] = (*counts, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in repaired).encode()).hexdigest())
    got = {r["conv_id"]: tuple(r)[1:] for r in op11_conversation_repair(spark, str(tmp_path)).collect()}
    assert got == want
    assert plain_repair([])[:7] == (0, 0, 0, 0, 0, 0, "")


def test_empty_table(spark):
    for k in (20_000, 1):
        assert convrepair.repair(table(spark, []), long_rows=k).count() == 0
    only = convrepair.repair(table(spark, [(1, 0, "user", "x")]).drop("there").selectExpr("*", "false AS there"), there=convrepair.F.col("there")).collect()
    assert [tuple(r) for r in only] == [(1, 0, 0, 0, 0, 0, 0, "", [])]
