from __future__ import annotations

import hashlib
import random
import zlib
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import DataFrame, SparkSession

from cueline.llm import turn_repair
from cueline.llm.turn_repair import damaged, repair, repaired_turns

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id bigint, turn bigint, role string, text string"
BLANKS = " \t\n\v\f\r"
#: The grammar's states: nothing, s, u, a.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def cheapest(rows: list[tuple[str, bool, bool]]) -> tuple[int, str, tuple]:
    """Cost, audit and turns (row or None, initial) of the least repair, over every way, one row after the other."""

    @lru_cache(maxsize=None)
    def rest(i: int, q: int, room: int) -> tuple[int, str, tuple] | None:
        ways = [(0, "", ())] if i == len(rows) and q in (0, 3) else []

        def add(cost: int, letter: str, turn: tuple, j: int, to: int, left: int) -> None:
            found = rest(j, to, left)
            if found is not None:
                ways.append((cost + found[0], letter + found[1], turn + found[2]))

        for c in "ua":
            if room and (q, c) in STEP:
                add(5, "I", ((None, c),), i, STEP[q, c], room - 1)
        if i < len(rows):
            initial, must, cut = rows[i]
            add(2, "D", (), i + 1, q, 3)
            if not must:
                more = 5 if cut else 0
                if (q, initial) in STEP:
                    add(more, "K", ((i, None),), i + 1, STEP[q, initial], 3)
                for c in "ua":
                    if (q, c) in STEP and c != initial:
                        add(more + 1, "R", ((i, c),), i + 1, STEP[q, c], 3)
        return min(ways, key=lambda way: way[:2], default=None)

    for i in range(len(rows), 0, -1):  # from the end, so that no call goes deep
        for q in range(4):
            rest(i, q, 3)
    return rest(0, 0, 3)


def plain_damage(rows: list[tuple]) -> list[tuple]:
    out: list[tuple] = []
    for conv, turn, role, text in rows:
        name = lambda x: " " if x is None else str(x)
        chosen = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        role, text = name(role), name(text)
        text = "" if chosen == 1 else "".join(c for c in text if c not in ".!?") if chosen == 2 else text
        out += [(conv, turn, "user" if chosen == 4 else role, text)] * (0 if chosen == 0 else 2 if chosen == 3 else 1)
    return out


def plain(rows: list[tuple], ids: set) -> set[tuple]:
    out = set()
    for conv in ids:
        own = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen: set[tuple] = set()
        faults, coded = [], []
        for _, role, text in own:
            end = text.strip(BLANKS)[-1:]
            fault = 0 if not end else 1 if (role, text) in seen else 2 if end not in ".!?" else None
            seen.add((role, text))
            faults.append(fault)
            coded.append((role[:1], fault in (0, 1), fault == 2))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, audit, left = cheapest(coded)
        full = {"u": "user", "a": "assistant"}
        lines = [f"{own[i][1] if c is None else full[c]}:{own[i][2]}" if i is not None else f"{full[c]}:" for i, c in left]
        out.add((conv, gaps, *(faults.count(k) for k in range(3)), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def conversations(rng: random.Random, n: int) -> list[tuple]:
    rows: list[tuple] = []
    texts = ["Yes.", "No!", "why?", "cut off", "", " \n", None, "Ends. \t", "tail .x", "à la fin!"]
    for conv in range(n):
        for turn in range(rng.randrange(1, 14)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", None, "", "User", "sys"])
            text = rng.choice(texts) if rng.random() < 0.4 else f"text {rng.random()}."
            rows.append((conv if conv else None, None if rng.random() < 0.05 else turn * rng.choice([1, 1, 1, 2]), role, text))
    return rows


def frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    clashing = [(*r, "x", 1) for r in rows]
    return spark.createDataFrame(clashing, SCHEMA + ", conv string, number int").repartition(3)


@pytest.mark.parametrize("run", [64, 3])
def test_same_as_all_ways(spark: SparkSession, run: int) -> None:
    rng = random.Random(run)
    rows = conversations(rng, 150)
    rows += [(900, k, ("user", "assistant")[k % 2], f"turn {k}.") for k in range(150)] + [(901, 0, "user", "Same.")] * 40
    rows += [(902, k, rng.choice(["user", "assistant", "system"]), f"t{k}" + rng.choice([".", "", "!"])) for k in range(200)]
    broken = frame(spark, rows)
    got = repair(broken, run=run)
    assert got.columns == COLUMNS
    assert {tuple(r) for r in got.collect()} == plain(rows, {r[0] for r in rows})


def test_damage_and_all_ids(spark: SparkSession) -> None:
    rows = conversations(random.Random(5), 120) + [(5000 + k, None, None, None) for k in range(60)] + [(7000 + k, k, "user", "Alone.") for k in range(60)]
    whole = frame(spark, rows)
    after = plain_damage(rows)
    assert sorted(map(repr, damaged(whole).collect())) == sorted(map(repr, spark.createDataFrame(after, SCHEMA).collect()))
    ids = {r[0] for r in rows}
    assert ids - {r[0] for r in after}
    assert {tuple(r) for r in repair(damaged(whole), whole).collect()} == plain(after, ids)


def test_repaired_turns_are_the_text(spark: SparkSession) -> None:
    rows = conversations(random.Random(8), 60) + [(70, k, "user", "x" * 2_000_000 + ".") for k in range(2)]
    whole = frame(spark, rows)
    digests = {str(r["conv_id"]) if r["conv_id"] is not None else None: r["repaired_sha256"] for r in repair(whole, run=4).collect()}
    lines: dict[str | None, list[str]] = {c: [] for c in digests}
    for r in sorted(repaired_turns(whole, run=4).collect(), key=lambda r: (r["run"], r["place"])):
        lines[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    assert {c: hashlib.sha256("\n".join(x).encode()).hexdigest() for c, x in lines.items()} == digests


def test_layers_of_one_run() -> None:
    ua = np.array([[3, 6]])
    final = np.array([[[0, turn_repair._NEVER, turn_repair._NEVER, 0]]])
    found = turn_repair.layers(ua, final)
    # Nothing to pay from the begin or after an assistant's turn; after a user's the first row would have to change its role.
    assert found[0, 0, 0] & 0b1001 == 0b1001 and found[0, 0, 0] & 0b0100 == 0


def test_wide_gaps_and_no_rows(spark: SparkSession) -> None:
    top = (1 << 63) - 1
    rows = [(1, -top, "user", "a."), (1, top, "assistant", "b.")]
    assert repair(spark.createDataFrame(rows, SCHEMA)).first()["gaps"] == top
    none = spark.createDataFrame([], SCHEMA)
    assert repair(none).columns == COLUMNS and not repair(none).collect()
    assert [tuple(r)[1:8] for r in repair(none, spark.createDataFrame(rows, SCHEMA)).collect()] == [(0, 0, 0, 0, 0, 0, "")]
