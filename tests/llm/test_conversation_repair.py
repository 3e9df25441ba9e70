"""Faults and cheapest repairs against a dynamic program, on short, long and odd conversations."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from webloom.llm import conversation_repair as repair

SPACE = " \t\n\x0b\x0c\r"
ONWARD = [2, 2, 3, 2]
SCHEMA = "conv_id long, turn long, role string, text string, conv string, pos long, kind string, cost long"
ROLES = ["system", "user", "assistant", "user", "assistant", "tool", "", None]
TEXTS = ["a.", "b!", "c", "", " \n", None, "?", "d . "]


def table(seed: int, lengths: list[int]) -> list[tuple]:
    r = random.Random(seed)
    rows = []
    for conv, n in enumerate(lengths):
        for t in range(n):
            turn = r.choice([t, t, t + 5, None]) if conv % 5 == 3 else 2 * t
            text = r.choice([*TEXTS, f"{t}.", f"{t}?", f"{t} und"])
            rows.append((None if conv == 2 else conv, turn, r.choice(ROLES), text, "x", 1, "y", 2))
    return rows


def faults(rows: list[tuple[str, str]]) -> list[str]:
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(SPACE)
        if not bare:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows: list[tuple[str, str]]) -> tuple[int, str]:
    """(cost, audit) over all edits, by states behind each row; the smaller string wins a tie."""
    found = faults(rows)
    best = [[(10**9, "~")] * 4 for _ in range(len(rows) + 1)]
    for i in range(len(rows), -1, -1):
        for _ in range(4):  # inserted turns stay at row i
            for state in range(4):
                options = [(0, "")] if i == len(rows) and state in (0, 3) else []
                edits = [("I", 3, i, ONWARD[state])]
                if i < len(rows):
                    edits.append(("D", 4, i + 1, state))
                    if found[i] in ("", "truncated"):
                        more = 3 if found[i] else 0
                        to = {"s": 1, "u": 2, "a": 3}.get(rows[i][0][:1])
                        if (to == 1 and state == 0) or (to == 2 and state != 2) or (to == 3 and state == 2):
                            edits.append(("K", more, i + 1, to))
                        edits.append(("R", 3 + more, i + 1, ONWARD[state]))
                options += [(best[j][to][0] + cost, letter + best[j][to][1]) for letter, cost, j, to in edits]
                best[i][state] = min(options)
    return best[0][0]


def repaired(audit: str, rows: list[tuple[str, str]]) -> str:
    out, state, left = [], 0, iter(rows)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(left)
        if letter == "K":
            state = {"s": 1, "u": 2, "a": 3}[role[0]]
            out.append(f"{role}:{text}")
        elif letter != "D":
            state = ONWARD[state]
            out.append(f"{'user' if state == 2 else 'assistant'}:{text}")
    return "\n".join(out)


def expected(rows: list[tuple[str, str]], turns: list[int | None]) -> tuple:
    found, numbers = faults(rows), {t for t in turns if t is not None}
    pairs = [a[0][:1] + b[0][:1] for a, b in zip(rows, rows[1:])]
    cost, audit = cheapest(rows)
    return (
        max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0,
        *(found.count(name) for name in ("blank", "duplicate", "truncated")),
        sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
        hashlib.sha256(repaired(audit, rows).encode()).hexdigest(),
    )


def check(spark, rows: list[tuple], tasks: int) -> None:
    conversations = spark.createDataFrame(rows, SCHEMA).repartition(tasks)
    damaged = repair.damaged(conversations)
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.repair(damaged, conversations).collect()}
    by = defaultdict(list)
    for r in damaged.withColumn("tie", F.xxhash64("text")).collect():
        by[r["conv_id"]].append(((r["turn"] is not None, r["turn"] or 0, r["role"], r["tie"]), r["role"], r["text"], r["turn"]))
    assert set(got) == {r[0] for r in rows}
    for conv, found in got.items():
        ordered = sorted(by.get(conv, []), key=lambda row: row[0])
        assert found == expected([row[1:3] for row in ordered], [row[3] for row in ordered]), conv


def test_short_and_long_conversations(spark):
    check(spark, table(1, [1, 2, 7, 5, 8, 3, 12, 31, 33, 400, 4, 6, 1, 2, 8]), 3)


def test_one_hot_conversation(spark):
    rows = [(1, t, ROLES[t % 3], "the same", "x", 1, "y", 2) for t in range(600)]
    check(spark, rows + [(i, 0, "user", "hi.", "x", 1, "y", 2) for i in range(2, 9)], 2)


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two!", "x", 1, "y", 2) for c in range(40) for t in (0, None)]
    got = defaultdict(list)
    for r in repair.damaged(spark.createDataFrame(rows, SCHEMA)).collect():
        got[r["conv_id"], r["turn"]].append((r["role"], r["text"]))
    kinds = set()
    for conv, turn, role, text, *_ in rows:
        kind = zlib.crc32(f"{conv}:{' ' if turn is None else turn}".encode()) % 20
        kinds.add(kind)
        want = {0: [], 1: [(role, "")], 2: [(role, "One Two")], 3: [(role, text)] * 2, 4: [("user", text)]}
        assert got[conv, turn] == want.get(kind, [(role, text)])
    assert kinds >= {0, 1, 2, 3, 4}


def test_rows_as_they_are(spark):
    """Without damage, conversations come from the rows; a wide span of turns has no number of gaps."""
    rows = [(1, -(2**63), "user", "Hm?"), (1, 2**63 - 1, "assistant", "Yes."), (2, 5, "user", "Hm?")]
    got = {r["conv_id"]: r for r in repair.repair(spark.createDataFrame(rows, SCHEMA.split(", conv string")[0])).collect()}
    assert (got[1]["gaps"], got[1]["audit"], got[1]["cost"]) == (None, "KK", 0)
    assert (got[2]["gaps"], got[2]["audit"], got[2]["cost"]) == (0, "KI", 3)


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair.repair(repair.damaged(none), none).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_blocks_compose(seed):
    """Matrices of blocks, joined, give the same costs as one lattice over all rows."""
    r = random.Random(seed)
    codes = tuple(r.randrange(12) for _ in range(r.randint(3, 20)))
    cut = r.randint(1, len(codes) - 1)
    both = repair.joined(repair.matrix(codes[:cut], False), repair.matrix(codes[cut:], True))
    assert both == repair.matrix(codes, True)
    assert min(both[0], both[3]) == repair.solve(codes)[0]
