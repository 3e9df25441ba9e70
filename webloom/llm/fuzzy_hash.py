"""Context-triggered piecewise hashing of documents.

A rolling hash over seven bytes ends a chunk wherever it is congruent to -1 modulo the block size; each chunk gives one
letter, so equal passages give equal letters wherever they stand. A fingerprint is "size:letters:letters", the second
row of letters at twice the block size. Fingerprints are compared by edit distance (insertions and deletions) at the
block sizes that both have.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.batches import map_batches, mix, partitions, slices, texts
from webloom.session import written

WINDOW = 7
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
LENGTH = 64  # letters of a signature at most: the last one covers all that is left
SMALLEST = 3
RUN = 7  # letters in a row that two signatures must share to be alike at all (fewer for short ones)
_MULTIPLIER = 0x01000193


def rolling(data: np.ndarray) -> np.ndarray:
    """32-bit hash of the seven bytes that end at each place (fewer at the start)."""
    m = [np.uint32(pow(_MULTIPLIER, k, 1 << 32)) for k in (1, 2, 4, 6)]
    x = data.astype(np.uint32) + np.uint32(1)
    two = x.copy()
    two[1:] += x[:-1] * m[0]
    out = two.copy()
    out[2:] += two[:-2] * m[1]
    out[4:] += two[:-4] * m[2]
    out[6:] += x[:-6] * m[3]
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x2C1B3C6D)
    out ^= out >> np.uint32(12)
    return out


def fingerprint(data: bytes) -> str:
    """The fingerprint of some bytes; "3::" for none."""
    if not data:
        return f"{SMALLEST}::"
    hashes = rolling(np.frombuffer(data, np.uint8))
    total = np.cumsum(hashes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(7))
    size = SMALLEST
    while size * LENGTH < len(data):
        size *= 2
    places = np.flatnonzero(hashes % np.uint32(size) == size - 1)
    while size > SMALLEST and len(places) < LENGTH // 2:
        size //= 2
        places = np.flatnonzero(hashes % np.uint32(size) == size - 1)
    coarse = places[hashes[places] % np.uint32(2 * size) == 2 * size - 1]
    return f"{size}:{_letters(total, places)}:{_letters(total, coarse)}"


def _letters(total: np.ndarray, places: np.ndarray) -> str:
    ends = places[: LENGTH - 1]
    if not len(ends) or ends[-1] != len(total) - 1:
        ends = np.append(ends, len(total) - 1)
    sums = np.diff(total[ends], prepend=np.uint64(0))
    return "".join(map(LETTERS.__getitem__, (mix(sums) >> np.uint64(58)).tolist()))


def common_subsequences(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Length of the longest common subsequence of each pair of strings of at most 64 letters, for all pairs at once.

    Bit-parallel: one word per pair holds a row of the table, one step per letter of the second string.
    """
    n = len(pairs)
    width = max((len(b) for _, b in pairs), default=0)
    masks = np.zeros((n, 128), np.uint64)
    second = np.zeros((n, max(width, 1)), np.uint8)
    for i, (a, b) in enumerate(pairs):
        codes = np.frombuffer(a.encode(), np.uint8)
        np.bitwise_or.at(masks[i], codes, np.uint64(1) << np.arange(len(codes), dtype=np.uint64))
        second[i, : len(b)] = np.frombuffer(b.encode(), np.uint8)
    row = np.full(n, np.uint64(0xFFFFFFFFFFFFFFFF))
    lines = np.arange(n)
    for k in range(width):
        hit = row & masks[lines, second[:, k]]
        row = (row + hit) | (row - hit)
    used = np.fromiter((len(a) for a, _ in pairs), np.int64, n)
    inside = np.where(used >= 64, ~np.uint64(0), (np.uint64(1) << (used % 64).astype(np.uint64)) - np.uint64(1))
    return np.bitwise_count(~row & inside).astype(np.int64)


def share_run(a: str, b: str) -> bool:
    run = max(1, min(RUN, min(len(a), len(b)) // 3))
    grams = {a[i : i + run] for i in range(len(a) - run + 1)}
    return any(b[i : i + run] in grams for i in range(len(b) - run + 1))


def likeness(pairs: list[tuple[str, str]]) -> list[float]:
    """Likeness from 0 to 1 of each pair of fingerprints: 1 for equal ones, 0 where no block size is shared."""
    rows, jobs = [], []
    for i, (x, y) in enumerate(pairs):
        if x == y:
            continue
        (size_x, *sig_x), (size_y, *sig_y) = x.split(":"), y.split(":")
        at_x, at_y = {int(size_x): sig_x[0], 2 * int(size_x): sig_x[1]}, {int(size_y): sig_y[0], 2 * int(size_y): sig_y[1]}
        for size in at_x.keys() & at_y.keys():
            a, b = at_x[size], at_y[size]
            if a and b and share_run(a, b):
                rows.append(i)
                jobs.append((a, b))
    out = [1.0 if x == y else 0.0 for x, y in pairs]
    for i, (a, b), common in zip(rows, jobs, common_subsequences(jobs).tolist()):
        out[i] = max(out[i], 2 * common / (len(a) + len(b)))
    return out


def edited(text: str, following: str) -> str:
    """The text with its last floor(n/2) code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compared(ids: list, strings: list[str]) -> dict[str, list]:
    """Result columns for all texts but the last, each against the one that follows it."""
    changed = [edited(a, b).encode() for a, b in zip(strings, strings[1:])]
    prints = [fingerprint(t.encode()) for t in strings]
    other = [fingerprint(c) for c in changed]
    return {
        "id": ids[:-1],
        "n_chars": [len(t) for t in strings[:-1]],
        "edited_sha256": [hashlib.sha256(c).hexdigest() for c in changed],
        "fingerprint": prints[:-1],
        "edited_fingerprint": other,
        "near_edited": likeness(list(zip(prints, other))),
        "near_next": likeness(list(zip(prints, prints[1:]))),
    }


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text (see `edited`), and how alike they are.

    Order is descending id_col; after the last document comes the first, a single one follows itself. Null texts are
    empty, null ids come last, rows with the same id stand in the order of their texts. Returns id_col, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next; an empty table gives an empty one.

    Documents are dealt by ranges of ids and move once. Within a range each meets its follower in passing; the last of
    a range meets the first of the next one in a second step that has one row per range.
    """
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    order = (F.desc("id"), F.asc("text"))
    ranged = rows.repartitionByRange(partitions(docs), F.desc("id"), F.xxhash64("text")).sortWithinPartitions(*order)
    result = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [part.split(" ")[0] for part in result.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        part = TaskContext.get().partitionId()
        blank = {"part": [part], "head": [None], "tail": [None]}
        keys: list = []
        held: list[str] = []
        for batch in batches:
            ids, strings = batch.column("id").to_pylist(), texts(batch)
            for at, to in slices(strings, most=256):
                if not keys:
                    yield dict.fromkeys(names, [None]) | blank | {"head": strings[:1]}
                keys += ids[at:to]
                held += strings[at:to]
                if len(keys) > 1:
                    out = compared(keys, held)
                    yield out | {k: v * len(out["id"]) for k, v in blank.items()}
                keys, held = keys[-1:], held[-1:]
        if keys:
            yield dict.fromkeys(names, [None]) | blank | {"id": keys, "tail": held}

    done = written(map_batches(ranged, work, f"{result}, part int, head string, tail string"), "fuzzy-hash")
    heads = done.filter(F.col("head").isNotNull()).select("part", "head")
    tails = done.filter(F.col("tail").isNotNull()).select("part", "id", "tail")
    # One row per range: the head that follows each tail, the first one after the last.
    line, whole = Window.orderBy("part"), Window.partitionBy()
    after = heads.withColumn("place", F.row_number().over(line) - 1).withColumn("n", F.count("*").over(whole))
    after = after.withColumn("place", (F.col("place") - 1 + F.col("n")) % F.col("n")).select("place", "head")
    pairs = tails.withColumn("place", F.row_number().over(line) - 1).join(after, "place").select("id", "tail", "head")

    def last_of_range(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for key, tail, head in zip(*(batch.column(c).to_pylist() for c in ("id", "tail", "head"))):
                yield compared([key, None], [tail, head])

    inner = done.filter(F.col("head").isNull() & F.col("tail").isNull()).select(*names)
    return inner.unionByName(map_batches(pairs, last_of_range, result)).withColumnRenamed("id", id_col)
