"""Packing against plain tokenization, and plans against bounds and exhaustive search."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest

from tests.llm.test_operators import PATH, TEXTS, docs, library, none, prose  # noqa: F401
from webloom.llm import packing

SCHEMA = "doc_id long, text string, length string, rank string, task string"


def check_places(rows: list, capacity: int) -> None:
    """Sequences are filled from 0 without gaps, up to the capacity at most."""
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for some in by.values():
        end = 0
        for offset, length in sorted(some):
            assert offset == end
            end += length
        assert end <= capacity


def test_pieces_of_documents(spark, docs, none):  # noqa: F811
    capacity = 50
    got = packing.pack_documents(docs, PATH, 1, capacity).collect()
    tokenizer, want = library(), Counter()
    for i, text in TEXTS:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for number, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[i, number, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    check_places(got, capacity)
    total = sum(r["length"] for r in got)
    assert len({r["sequence_id"] for r in got}) <= -(-total // capacity) + 1
    assert packing.pack_documents(none, PATH, 1).count() == 0


def test_one_length_only(spark):
    rows = [(i, None if i % 2 else "", "l", "r", "t") for i in range(5000)] + [(None, prose(30, 1), "l", "r", "t")]
    got = packing.pack_documents(spark.createDataFrame(rows, SCHEMA).repartition(7), PATH, 1).collect()
    assert len(got) == 5001
    check_places(got, packing.CAPACITY)
    assert len({r["sequence_id"] for r in got}) == 2


def used(plan: packing.Plan, counts: np.ndarray) -> int:
    """Number of sequences that all pieces really take, after checking their places."""
    length = np.repeat(np.arange(len(counts)), counts)
    rank = np.concatenate([np.arange(c) for c in counts])
    sequence, offset = plan.places(length, rank)
    check_places(
        [dict(sequence_id=s, offset=o, length=n) for s, o, n in zip(sequence, offset, length)], len(counts) - 1
    )
    assert len(set(sequence.tolist())) == plan.sequences
    return plan.sequences


def fewest(counts: tuple[int, ...], capacity: int) -> int:
    """Exhaustive search: fill one sequence after the other, the longest piece left goes first."""

    @lru_cache(None)
    def rest(left: tuple[int, ...], room: int, longest: int) -> int:
        if not any(left):
            return 0
        options = []
        for length in range(min(room, longest), 0, -1):
            if left[length]:
                options.append(rest((*left[:length], left[length] - 1, *left[length + 1 :]), room - length, length))
        if room < capacity:
            first = max(i for i, n in enumerate(left) if n)
            less = (*left[:first], left[first] - 1, *left[first + 1 :])
            options.append(1 + rest(less, capacity - first, first))
        return min(options)

    if not any(counts):
        return 0
    first = max(i for i, n in enumerate(counts) if n)
    return 1 + rest((*counts[:first], counts[first] - 1, *counts[first + 1 :]), capacity - first, first)


@pytest.mark.parametrize("seed", range(25))
def test_small_plans(seed):
    r = np.random.default_rng(seed)
    capacity = 12
    counts = np.bincount(r.integers(1, capacity + 1, r.integers(0, 11)), minlength=capacity + 1)
    plan = packing.Plan(counts)
    best = fewest(tuple(counts.tolist()), capacity)
    assert best <= used(plan, counts) <= best + 1
    assert plan.bound <= best + 1e-9


@pytest.mark.parametrize("low, high, factor", [(1, 600, 1.002), (1000, 3000, 1.02), (600, 2100, 1.03), (4096, 4097, 1.0)])
def test_large_plans(low, high, factor):
    counts = np.bincount(np.random.default_rng(7).integers(low, high, 8000), minlength=4097)
    plan = packing.Plan(counts)
    assert plan.bound <= used(plan, counts) <= plan.bound * factor + 1


def test_plan_does_not_grow_with_copies():
    counts = np.bincount(np.random.default_rng(8).integers(1, 4097, 3000), minlength=4097)
    one, many = packing.Plan(counts * 1000), packing.Plan(counts * 10**7)
    assert many.sequences <= one.sequences * 10_000 * 1.001 and len(many.key) < 3 * len(one.key)
    assert many.sequences >= many.bound


def test_knapsack():
    r = np.random.default_rng(9)
    value = np.concatenate([[0], r.random(30)])
    best, _ = packing.knapsack(value)
    want = [0.0] * 31
    for room in range(1, 31):
        want[room] = max(want[room - 1], *(want[room - k] + value[k] for k in range(1, room + 1)))
    assert best == pytest.approx(want)
