"""Language identification with bit-sliced Bloom filters of character n-grams.

One Bloom filter per language, all with the same hash functions, are stored side by side: a slot holds one bit per
language. Reading an n-gram means taking the AND of its slots, which gives at once the bits of all languages that
contain it. A text's n-grams are read, bits are counted per language, the counts are corrected for each filter's rate of
false positives, and the language with the largest corrected count decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.batches import GOLDEN, held, map_batches, mix, share, slices, texts

SLOT_BITS = 19  # slots of the filters, as a power of two
PROBES = 2  # slots of an n-gram
LENGTHS = (3, 4)
TRAIN_PER_LANGUAGE = 3000  # labelled documents of each language that training uses (expected number)
LEAST_SHARE = 0.02  # a language contains an n-gram that stands in this share of its documents,
SMOOTHING = 10  # documents added to those of a language when shares are taken, so that few documents prove little
RELATIVE_SHARE = 0.25  # and in this share of the largest such share of any language
UNKNOWN = "und"


@dataclass
class Filters:
    languages: list[str]
    slots: np.ndarray  # slot by word, each word holding the bits of 64 languages
    false_rate: np.ndarray  # per language
    letters: np.ndarray  # bit-packed: which code points are letters


def letter_table() -> np.ndarray:
    return np.packbits(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))


def grams(strings: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """60-bit hashes of the n-grams of all texts, the text of each, and the number of letters per text.

    Texts are lower-cased; all that is no letter is one kind of boundary, which may stand at an end of an n-gram only.
    """
    lowered = [t.lower() + "\n" for t in strings]
    # The first text has a boundary before it too, as the others have that of the text before.
    codes = np.frombuffer("".join(["\n", *lowered]).encode("utf-32-le", "surrogatepass"), "<u4")
    letter = letters[codes]
    owner = np.repeat(np.arange(len(strings), dtype=np.int32), [len(t) for t in lowered])
    owner = np.append(np.zeros(1, np.int32), owner)
    count = np.bincount(owner[letter], minlength=len(strings))
    x = np.where(letter, codes, 0).astype(np.uint64)
    found, whose = [], []
    for n in LENGTHS:
        if len(x) < n:
            continue
        size = len(x) - n + 1
        inside = letter[1 : 1 + size].copy()
        for k in range(2, n - 1):
            inside &= letter[k : k + size]
        at = np.flatnonzero(inside)
        value = x[at]
        for k in range(1, n):
            value = (value << np.uint64(21) | value >> np.uint64(43)) ^ x[at + k] * GOLDEN
        found.append(mix(value + np.uint64(n)) >> np.uint64(4))
        whose.append(owner[at + 1])
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int32), count
    return np.concatenate(found), np.concatenate(whose), count


def probes(values: np.ndarray) -> Iterator[np.ndarray]:
    for k in range(PROBES):
        yield (values >> np.uint64(k * SLOT_BITS)) & np.uint64((1 << SLOT_BITS) - 1)


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id") -> Filters:
    """Learn from documents with a language. Rows without text or language are left out.

    Of each language about TRAIN_PER_LANGUAGE documents are read. Document counts of n-grams are added up per task
    before the shuffle; the driver gets the filled slots (2**SLOT_BITS rows for each 64 languages at most).
    """
    rows = labelled.select(
        F.col(text_col).cast("string").alias("text"),
        F.col(lang_col).cast("string").alias("lang"),
        F.xxhash64(F.lit(5), F.col(key_col)).alias("key"),
    ).filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    names = sorted(counts)
    letters = letter_table()
    empty = Filters(names, np.zeros((1 << SLOT_BITS, max(1, -(-len(names) // 64))), np.uint64), np.zeros(len(names)), letters)
    if not names:
        return empty
    numbers = {name: i for i, name in enumerate(names)}
    # Number and share of each language are constants of the plan: the texts are not shuffled to meet them.
    constants = F.create_map(
        *(part for n, i in numbers.items()
          for part in (F.lit(n), F.struct(F.lit(i).alias("number"), F.lit(TRAIN_PER_LANGUAGE / counts[n]).alias("share"))))
    )
    own = F.element_at(constants, F.col("lang"))
    drawn = F.pmod("key", F.lit(1 << 30)) / float(1 << 30)
    sample = rows.filter(drawn < own["share"]).select("text", own["number"].alias("number"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        table = np.unpackbits(letters).astype(bool)
        for batch in batches:
            strings, number = texts(batch), np.array(batch.column("number"), np.int64)
            for at, to in slices(strings, most=256):
                values, owner, _ = grams(strings[at:to], table)
                order = np.lexsort((owner, values))
                values, owner = values[order], owner[order]
                new = np.append(True, (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])) if len(values) else []
                values, langs = values[new], number[at:to][owner[new]]
                order = np.lexsort((langs, values))
                values, langs = values[order], langs[order]
                if not len(values):
                    continue
                first = np.flatnonzero(np.append(True, (values[1:] != values[:-1]) | (langs[1:] != langs[:-1])))
                yield {
                    "gram": values[first].astype(np.int64),
                    "number": langs[first].astype(np.int32),
                    "n": np.diff(np.append(first, len(values))),
                }

    seen = map_batches(sample, work, "gram long, number int, n long").groupBy("gram", "number").agg(F.sum("n").alias("n"))
    used = sample.groupBy("number").agg(F.count("*").alias("docs"))
    rated = seen.join(F.broadcast(used), "number").withColumn("rate", F.col("n") / (F.col("docs") + SMOOTHING))  # a row per language
    rated = rated.filter(F.col("rate") >= LEAST_SHARE)
    best = F.max("rate").over(Window.partitionBy("gram"))
    kept = rated.withColumn("best", best).filter(F.col("rate") >= RELATIVE_SHARE * F.col("best"))
    places = F.array(
        *[F.shiftrightunsigned("gram", k * SLOT_BITS).bitwiseAND(F.lit((1 << SLOT_BITS) - 1)) for k in range(PROBES)]
    )
    bits = (
        kept.select(F.explode(places).alias("slot"), F.floor(F.col("number") / 64).alias("word"), F.expr("shiftleft(1L, number % 64)").alias("bit"))
        .groupBy("slot", "word")
        .agg(F.bit_or("bit").alias("bits"))
    )
    for r in bits.toLocalIterator():
        empty.slots[r["slot"], r["word"]] = np.uint64(r["bits"] & 0xFFFFFFFFFFFFFFFF)
    for i in range(len(names)):
        full = (empty.slots[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).mean()
        empty.false_rate[i] = full**PROBES
    return empty


def predict_texts(filters: Filters, strings: list[str], table: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and score of each text; see `predict`."""
    values, owner, letters = grams(strings, table)
    n_grams = np.bincount(owner, minlength=len(strings))
    estimate = np.zeros((len(strings), len(filters.languages)))
    for word in range(filters.slots.shape[1]):
        column = filters.slots[:, word]
        mask = None
        for slot in probes(values):
            mask = column[slot] if mask is None else mask & column[slot]
        for i in range(word * 64, min(len(filters.languages), word * 64 + 64)):
            hits = np.bincount(owner, (mask >> np.uint64(i % 64) & np.uint64(1)), minlength=len(strings))
            wrong = filters.false_rate[i]
            estimate[:, i] = np.maximum(0, (hits - n_grams * wrong) / max(1e-9, 1 - wrong))
    if not filters.languages:
        return [UNKNOWN] * len(strings), np.zeros(len(strings))
    best = estimate.argmax(axis=1)
    total = estimate.sum(axis=1)
    score = np.where(total > 0, estimate.max(axis=1) / np.maximum(total, 1e-9), 1 / len(filters.languages))
    none = letters == 0
    names = [UNKNOWN if no else filters.languages[b] for b, no in zip(best.tolist(), none.tolist())]
    return names, np.where(none, 0.0, score)


def predict(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred and score (the language's part of all corrected counts, 0 to 1) of every whole text.

    Null texts and texts without a letter get `und` and 0; a text with letters but no known n-gram, and ties, get the
    first language by name. Repeated rows are kept; an empty table gives an empty one.
    """
    shared = share(docs.sparkSession, filters)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        filters = held(shared)
        table = np.unpackbits(filters.letters).astype(bool)
        for batch in batches:
            keys, strings = batch.column("id").to_pylist(), texts(batch)
            for at, to in slices(strings, most=256):
                names, score = predict_texts(filters, strings[at:to], table)
                yield {"id": keys[at:to], "lang_pred": names, "score": score}

    kind = rows.schema["id"].dataType.simpleString()
    return map_batches(rows, work, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
