"""Packing of token sequences by a configuration linear program over the length histogram.

Only the histogram of lengths (at most `capacity` numbers) reaches the driver. A configuration is a multiset of lengths
that fits one sequence; the program asks for the fewest configurations, in fractions, that cover every length as often
as it occurs. Multiplicative weights solve it: each length has a weight that falls exponentially with its coverage, and a
knapsack by dynamic programming finds the configurations whose lengths are worth most. The solution is rounded to whole
configurations that the remaining pieces allow, and what is left is placed by best fit, in groups of equal sequences.

Pieces then take their places without meeting each other: pieces of one length are numbered (by task, then within the
task), and a number names a sequence and a place in it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.batches import held, map_batches, share, slices, texts
from webloom.llm.token_files import LibraryEncoder
from webloom.session import written

CAPACITY = 4096
ROUNDS = 60  # knapsacks solved
BATCH = 128  # configurations taken from each
STEP = 0.125  # share of its scarcest length that a configuration covers at a time
SHARPNESS = 6.0  # weights are exp(-SHARPNESS * coverage)
NEAR = 0.02  # a configuration may be worth this much less than the best one of its round
CLOSE = 0.002  # share by which the solution may exceed the bound, and a configuration fall short of a worth of 1
RANK_BITS = 48

Configuration = tuple[tuple[int, int], ...]  # (length, how often), longest first


class Group(NamedTuple):
    """`copies` sequences with the same configuration."""

    copies: int
    configuration: Configuration


def knapsack(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per capacity the largest value of lengths that fit (value[0] is ignored), and the length to take, 0 for none."""
    capacity = len(value) - 1
    best, take = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    backwards, at = np.zeros(capacity + 1), value[1:]
    for room in range(1, capacity + 1):
        # backwards[-room:] is best[room - 1], ..., best[0]
        options = at[:room] + backwards[capacity + 1 - room :]
        length = int(options.argmax())
        if options[length] > best[room - 1]:
            best[room], take[room] = options[length], length + 1
        else:
            best[room] = best[room - 1]
        if room < capacity:
            backwards[capacity - room] = best[room]
    return best, take


def filled(price: np.ndarray, best: np.ndarray, take: np.ndarray, length: int, counts: np.ndarray) -> dict[int, int]:
    """A configuration of `length` and what is worth most beside it, no length more often than there are pieces."""
    out = {length: 1}
    room = len(take) - 1 - length
    while room > 0:
        one = int(take[room])
        if one and out.get(one, 0) >= counts[one]:
            options = price[1 : room + 1] + best[:room][::-1]
            for spent, often in out.items():
                if spent <= room and often >= counts[spent]:
                    options[spent - 1] = -1.0
            one = int(options.argmax()) + 1
            if options[one - 1] <= 0 or price[one] <= 0:
                break
        if one:
            out[one] = out.get(one, 0) + 1
            room -= one
        else:
            room -= 1
    return out


def fractional(counts: np.ndarray, rounds: int = ROUNDS) -> tuple[dict[Configuration, float], np.ndarray, float]:
    """Configurations with their fractions, the dual prices of the lengths, and a lower bound on sequences.

    Fractions cover each length about as often as it occurs. Under the prices no configuration is worth more than 1, so
    no packing has fewer sequences than all pieces are worth, which is the bound; the prices of the round that proves
    most are returned, those by length (length / capacity) at first. counts[l] is the number of pieces of length l;
    counts[0] is ignored.
    """
    capacity = len(counts) - 1
    present = np.flatnonzero(counts[1:]) + 1
    dual = np.arange(capacity + 1) / capacity
    if not len(present):
        return {}, dual, 0.0
    amount = counts[present].astype(float)
    index = np.zeros(capacity + 1, np.int64)
    index[present] = np.arange(len(present))
    covered, used = np.zeros(len(present)), 0.0
    found: dict[Configuration, float] = {}
    bound = float((present * amount).sum() / capacity)
    for _ in range(rounds):
        weight = present * amount * np.exp(-SHARPNESS * (covered - covered.min()))
        price = np.full(capacity + 1, -1.0)
        price[present] = weight / amount
        best, take = knapsack(price)
        if (proved := float(weight.sum() / best[capacity])) > bound:
            bound, dual = proved, np.maximum(price, 0) / best[capacity]
        worth = price[present] + best[capacity - present]
        good = np.flatnonzero(worth >= (1 - NEAR) * best[capacity])
        for length in present[good[np.argsort(covered[good], kind="stable")[:BATCH]]].tolist():
            parts = filled(price, best, take, length, counts)
            lengths = np.fromiter(parts, np.int64, len(parts))
            often = np.fromiter(parts.values(), float, len(parts))
            at = index[lengths]
            x = STEP * float((amount[at] / often).min())
            covered[at] += often * x / amount[at]
            used += x
            key = tuple(sorted(parts.items(), reverse=True))
            found[key] = found.get(key, 0.0) + x
        if used <= bound * covered.min() * (1 + CLOSE):
            break
    return {key: x * bound / used for key, x in found.items()}, dual, bound


def rounded(found: dict[Configuration, float], dual: np.ndarray, left: np.ndarray) -> list[Group]:
    """Whole configurations, as many in total as their fractions add up to or as the pieces allow; `left` shrinks.

    Configurations worth most under the dual prices come first and those worth less than 1 - CLOSE not at all, larger
    fractions before smaller ones. What is cut off one fraction is carried to the next.
    """
    groups, carry = [], 0.0
    worth = {key: round(float(sum(dual[length] * often for length, often in key)), 3) for key in found}
    for key in sorted((k for k in found if worth[k] >= 1 - CLOSE), key=lambda k: (-worth[k], -found[k], k)):
        carry += found[key]
        copies = min([int(carry), *(int(left[length]) // often for length, often in key)])
        if copies > 0:
            carry -= copies
            for length, often in key:
                left[length] -= copies * often
            groups.append(Group(copies, key))
        carry = min(carry, found[key] + 1.0)
    return groups


def best_fit(groups: list[Group], left: np.ndarray) -> list[Group]:
    """Place the remaining pieces, longest first, where they leave the least room; then in new sequences.

    Sequences with equal configurations are handled as one, so the work does not grow with the number of pieces.
    """
    capacity = len(left) - 1
    open_: dict[int, list[Group]] = {}
    rooms = 0  # bit r: there is a group with room r

    def put(copies: int, parts: Configuration, room: int) -> None:
        nonlocal rooms
        if copies:
            open_.setdefault(room, []).append(Group(copies, parts))
            rooms |= 1 << room

    for group in groups:
        put(group.copies, group.configuration, capacity - sum(length * often for length, often in group.configuration))
    for length in range(capacity, 0, -1):
        rest = int(left[length])
        while rest:
            wide = rooms >> length
            if wide:
                room = length + (wide & -wide).bit_length() - 1
                group = open_[room].pop()
                if not open_[room]:
                    rooms ^= 1 << room
            else:
                room, group = capacity, Group(rest, ())
            each = room // length
            whole = min(group.copies, rest // each)
            put(whole, (*group.configuration, (length, each)), room - each * length)
            rest -= whole * each
            others = group.copies - whole
            if rest and others:  # fewer than `each` pieces are left
                put(1, (*group.configuration, (length, rest)), room - rest * length)
                rest, others = 0, others - 1
            if group.configuration:
                put(others, group.configuration, room)
    left[:] = 0
    return [group for some in open_.values() for group in some]


class Plan:
    """Where the pieces of each length go; the number of pieces does not matter for its size."""

    def __init__(self, counts: np.ndarray):
        left = counts.copy()
        left[0] = 0
        found, dual, self.bound = fractional(left)
        groups = best_fit(rounded(found, dual, left), left)
        self.sequences = sum(group.copies for group in groups)
        given: dict[int, int] = {}
        rows: list[tuple[int, int, int, int]] = []
        sequence = 0
        for group in groups:
            offset = 0
            for length, often in group.configuration:
                rank = given.get(length, 0)
                rows.append((length << RANK_BITS | rank, sequence, often, offset))
                given[length] = rank + group.copies * often
                offset += length * often
            sequence += group.copies
        table = np.array(sorted(rows), np.int64).reshape(-1, 4)
        self.key, self.first = table[:, 0].copy(), table[:, 1].copy()
        self.often, self.offset = table[:, 2].astype(np.int32), table[:, 3].astype(np.int32)

    def places(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces that are number `rank` of their length."""
        key = length << RANK_BITS | rank
        at = np.searchsorted(self.key, key, side="right") - 1
        run = key - self.key[at]
        often = self.often[at].astype(np.int64)
        return self.first[at] + run // often, self.offset[at] + run % often * length


def pieces(
    docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pieces of at most `capacity` ids: id, piece, start, length, ids_crc32, and task and number within task and length."""
    with open(tokenizer, encoding="utf-8") as file:
        shared = share(docs.sparkSession, LibraryEncoder(file.read()))
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    end = np.array([end_id], "<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encoder, task = held(shared), TaskContext.get().partitionId()
        numbers = [0] * (capacity + 1)
        for batch in batches:
            strings = texts(batch)
            owner: list[int] = []
            out: dict[str, list] = {n: [] for n in ("piece", "start", "length", "ids_crc32", "rank")}
            for first, last in slices(strings):
                for row, ids in enumerate(encoder.run(strings[first:last]), first):
                    data = ids.tobytes() + end
                    for number, at in enumerate(range(0, len(data), 4 * capacity)):
                        part = data[at : at + 4 * capacity]
                        length = len(part) // 4
                        owner.append(row)
                        out["piece"].append(number)
                        out["start"].append(at // 4)
                        out["length"].append(length)
                        out["ids_crc32"].append(zlib.crc32(part))
                        out["rank"].append(numbers[length])
                        numbers[length] += 1
            yield {"id": batch.column("id").take(pa.array(owner, pa.int64())), "task": [task] * len(owner)} | out

    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, task int, piece int, start long, length long, ids_crc32 long, rank long"
    return map_batches(rows, work, schema)


def pack(found: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, Plan]:
    """The rows of `found` with sequence_id and offset, and the plan. Lengths are 1 to `capacity`, which is below 32,768.

    `task` and `rank` number the rows of a length within a task. `found` must give the same rows whenever it is read.
    """
    counts = written(found.groupBy("task", "length").agg(F.count("*").alias("n")), "piece-counts")
    histogram = np.zeros(capacity + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        histogram[row["length"]] = row["n"]
    plan = Plan(histogram)
    shared = share(found.sparkSession, plan)
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = found.join(before, ["task", "length"]).withColumn("rank", F.col("rank") + F.col("before")).drop("before")
    names = [name for name in found.columns if name not in ("task", "rank")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        known = held(shared)
        for batch in batches:
            columns = (batch.column(n).to_numpy() for n in ("length", "rank"))
            sequence, offset = known.places(*columns)
            yield {name: batch.column(name) for name in names} | {"sequence_id": sequence, "offset": offset}

    kinds = ", ".join(f"`{name}` {found.schema[name].dataType.simpleString()}" for name in names)
    return map_batches(ranked, work, f"{kinds}, sequence_id long, offset long"), plan


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encode all documents, each closed by `end_id`, and pack them into sequences of at most `capacity` ids.

    Returns one row per piece: id_col, piece (from 0), start (ids of the document before it), length, ids_crc32 (unsigned
    crc32 of its ids as little-endian unsigned 32-bit integers), sequence_id, offset (place in the sequence, gapless from
    0). Only documents longer than `capacity` are cut, into pieces of `capacity` and a last one of what is left. Null and
    empty texts have the end id only. Repeated rows and rows with a null id are packed like others, other columns are
    ignored, an empty table gives an empty one. Which of several pieces of one length goes where is arbitrary.
    """
    cut = written(pieces(docs, tokenizer, end_id, capacity, id_col, text_col), "pieces")
    packed, _ = pack(cut, capacity)
    order = ("piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    return packed.select(F.col("id").alias(id_col), *order)
