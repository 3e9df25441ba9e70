"""Benchmark decontamination with spaced seeds.

A mask looks at some of the next tokens and ignores the others, so a replaced token at an ignored place does no harm.
The hashes of all masks at all places are taken of test items and of training documents; equal hashes give a pair and
an alignment, and the alignment is verified token by token: a pair counts as an overlap if some stretch of LEAST_TOKENS
aligned tokens or more (or the whole item, if it is shorter) is equal in LEAST_EQUAL of its places or more. The masks
hit every such stretch.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.batches import concatenated, held, map_batches, mix, powers, share, slices, texts, word_hashes
from webloom.session import written

LEAST_TOKENS = 13
LEAST_EQUAL = 0.8
# Places that masks look at, by the tokens of an item; the last line serves longer items too. Of the ways to replace a
# fifth of a stretch (of a whole item, if it is short), each leaves some mask of the line a place where it fits.
MASKS = {
    1: ("1",),
    2: ("11",),
    3: ("111",),
    4: ("1111",),
    5: ("1111", "11101", "11011", "10111"),
    6: ("11111", "111101", "111011", "110111", "101111"),
    7: ("11111", "111011", "110111"),
    8: ("11111", "111011"),
    9: ("1111011", "1101111"),
    10: ("111011", "11010011", "11111"),
    11: ("1110111", "111001011", "1011111", "111111"),
    12: ("11101011", "101100111", "111111"),
    LEAST_TOKENS: ("1111011", "110100010011", "11001111", "111111", "1110111"),
}
ALL_MASKS = sorted({mask for masks in MASKS.values() for mask in masks})
BITS_PER_SEED, MOST_BITS, PROBES = 128, 27, 4  # pre-filter: bits per hash, at most 2**27 (16 MB)

_WORD = np.zeros(256, bool)
_WORD[[*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1), *range(0x80, 0x100)]] = True
_BETWEEN = regex.compile(r"[^\x00-\x7f\p{L}\p{M}\p{N}]+")
# Scripts that put no space between words.
_UNSPACED = regex.compile(
    r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Bopomofo}\p{Yi}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}\p{Tai_Le}"
    r"\p{New_Tai_Lue}\p{Tai_Tham}\p{Tai_Viet}\p{Javanese}\p{Balinese}]"
)


def plain(text: str) -> str:
    """The text in lower case, its tokens divided by ASCII characters that are in none."""
    text = text.lower()
    if text.isascii():
        return text
    return _UNSPACED.sub(r" \g<0> ", _BETWEEN.sub(" ", unicodedata.normalize("NFC", text)))


def tokens(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts and their offsets per text. A token is a maximal run of a-z, 0-9 and letters,
    marks and numbers beyond ASCII in the lower-cased text; a character of a script without spaces is one by itself."""
    buffer, begin = concatenated([plain(t).encode() for t in strings])
    starts, _, hashes = word_hashes(buffer, _WORD[buffer])
    return hashes, np.searchsorted(starts, begin)


def seeds(hashes: np.ndarray, offsets: np.ndarray, numbers: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each of these masks: its number, places (in `hashes`) where it fits into its text, and its hashes there."""
    ends = np.repeat(offsets[1:], np.diff(offsets))
    for number in numbers:
        mask = ALL_MASKS[number]
        n = len(hashes) - len(mask) + 1
        if n <= 0:
            continue
        factor = powers(0x9FB21C651E98DF25, len(mask) + 1)
        total = np.full(n, np.uint64(number + 1))
        for k, looked in enumerate(mask):
            if looked == "1":
                total += hashes[k : k + n] * factor[k + 1]
        at = np.flatnonzero(np.arange(n) + len(mask) <= ends[:n])
        yield number, at, mix(total[at])


def item_seeds(items: DataFrame) -> DataFrame:
    """mask, hash, item, place for each (item, text)."""
    serves = np.array([[mask in MASKS.get(n, ()) for mask in ALL_MASKS] for n in range(LEAST_TOKENS + 1)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            ids, strings = np.array(batch.column("item").to_pylist(), np.int64), texts(batch)
            for first, last in slices(strings, 1 << 21, 4096):
                hashes, offsets = tokens(strings[first:last])
                owner = np.repeat(np.arange(last - first), np.diff(offsets))
                size = np.minimum(np.diff(offsets), LEAST_TOKENS)
                for number, at, value in seeds(hashes, offsets, list(range(len(ALL_MASKS)))):
                    wanted = serves[size[owner[at]], number]
                    at, value = at[wanted], value[wanted]
                    own = owner[at]
                    yield {
                        "mask": np.full(len(at), number),
                        "hash": value.view(np.int64),
                        "item": ids[first:last][own],
                        "place": at - offsets[own],
                    }

    return map_batches(items, work, "mask int, hash long, item long, place long").distinct()


def probes(values: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    other = mix(values ^ np.uint64(0x5851F42D4C957F2D))
    for k in range(PROBES):
        yield (values + other * np.uint64(k)) >> np.uint64(64 - bits)


class SeedFilter:
    """Bloom filter of the test hashes: fixed number of bits, no hash of a test item is refused. `masks` are the numbers
    of the masks that test items have."""

    def __init__(self, table: DataFrame):
        n = table.agg(F.approx_count_distinct("hash").alias("n")).first()["n"]
        self.masks = sorted(r["mask"] for r in table.select("mask").distinct().collect())  # len(ALL_MASKS) at most
        self.bits = min(MOST_BITS, max(10, int(n * BITS_PER_SEED).bit_length()))
        bits = self.bits

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for batch in batches:
                values = np.array(batch.column("hash"), np.int64).view(np.uint64)
                at = np.unique(np.concatenate(list(probes(values, bits)))).astype(np.int64)
                yield {"word": at >> 3, "bit": 1 << (at & 7)}

        words = map_batches(table.select("hash"), work, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits"))
        self.filled = np.zeros(1 << (bits - 3), np.uint8)
        for row in words.toLocalIterator():  # 2**(bits - 3) rows at most
            self.filled[row["word"]] = row["bits"]

    def passes(self, values: np.ndarray) -> np.ndarray:
        """Places of the values that may be test hashes."""
        keep = np.arange(len(values))
        for k in range(PROBES):
            left = values[keep]
            at = list(probes(left, self.bits))[k] if k else left >> np.uint64(64 - self.bits)
            keep = keep[(self.filled[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
        return keep


def candidates(docs: DataFrame, allowed: SeedFilter) -> DataFrame:
    """id, text, hashes, places of the documents that have a seed the filter lets through."""
    shared = share(docs.sparkSession, allowed)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            ids, strings = batch.column("id").to_pylist(), texts(batch)
            for first, last in slices(strings, 1 << 21, 4096):
                hashes, offsets = tokens(strings[first:last])
                at_all, value_all = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
                for _, at, value in seeds(hashes, offsets, held(shared).masks):
                    keep = held(shared).passes(value)
                    at_all.append(at[keep])
                    value_all.append(value[keep])
                at, value = np.concatenate(at_all), np.concatenate(value_all)
                own = np.searchsorted(offsets, at, side="right") - 1
                order = np.argsort(own, kind="stable")
                at, value, own = at[order], value[order].view(np.int64), own[order]
                found, begin = np.unique(own, return_index=True)
                parts = np.append(begin, len(own))
                yield {
                    "id": [ids[first + d] for d in found],
                    "text": [strings[first + d] for d in found],
                    "hashes": [value[a:b] for a, b in zip(parts[:-1], parts[1:])],
                    "places": [at[a:b] - offsets[d] for a, b, d in zip(parts[:-1], parts[1:], found)],
                }

    return map_batches(docs, work, "id long, text string, hashes array<long>, places array<long>")


def best_stretch(equal: np.ndarray) -> tuple[int, int]:
    """Start and end of the longest stretch of which LEAST_EQUAL is true."""
    sums = np.append(0, np.cumsum(np.where(equal, 1 - LEAST_EQUAL, -LEAST_EQUAL)))
    lowest = np.minimum.accumulate(sums)
    start = np.searchsorted(-lowest, -sums - 1e-9)  # first place whose sum is not above the one here
    length = np.arange(len(sums)) - start
    end = int(length.argmax())
    return int(start[end]), end


def overlaps(doc: np.ndarray, item: np.ndarray, shifts: list[int]) -> tuple[int, int, int] | None:
    """(place in the document, tokens, equal tokens) of the longest overlap over the given alignments, or None."""
    best = None
    for shift in shifts:
        a, b = max(0, shift), min(len(doc), shift + len(item))
        if b <= a:
            continue
        equal = doc[a:b] == item[a - shift : b - shift]
        start, end = best_stretch(equal)
        if end - start >= min(LEAST_TOKENS, len(item)) and (best is None or end - start > best[1]):
            best = (a + start, end - start, int(equal[start:end].sum()))
    return best


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Pairs of a document and a test item that overlap: id_col, item_col, place (token of the document), n_tokens,
    n_equal, similarity; one row per pair, with its longest overlap.

    Rows with a null id on either side, null and empty texts and items without a token match nothing; an item of one
    token matches all documents that hold it; repeated rows give one pair; empty tables give an empty one. Executors pre-filter the documents' hashes with a
    Bloom filter of bounded size; what passes is joined with the test hashes, so a full filter costs time only.
    """
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    items = benchmark.select(
        benchmark[item_col].cast("long").alias("item"), benchmark[item_text_col].cast("string").alias("item_text")
    ).filter(F.col("item").isNotNull() & F.col("item_text").isNotNull())
    table = written(item_seeds(items.withColumnRenamed("item_text", "text")), "item-seeds")
    found = written(candidates(rows.filter(F.col("id").isNotNull()), SeedFilter(table)), "leak-candidates")
    placed = found.select("id", F.explode(F.arrays_zip("hashes", "places")).alias("seed")).select(
        "id", F.col("seed.hashes").alias("hash"), F.col("seed.places").alias("at")
    )
    pairs = placed.join(table, "hash").select("id", "item", (F.col("at") - F.col("place")).alias("shift")).distinct()
    pairs = pairs.groupBy("id", "item").agg(F.collect_set("shift").alias("shifts"))
    both = pairs.join(items.distinct(), "item").join(found.select("id", "text").distinct(), "id")
    both = both.select("id", "item", "text", "item_text", "shifts")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        names = ("id", "item", "place", "n_tokens", "n_equal")
        for batch in batches:
            out: dict[str, list] = {n: [] for n in names}
            columns = (batch.column(c).to_pylist() for c in ("id", "item", "text", "item_text", "shifts"))
            for key, item, text, item_text, shifts in zip(*columns):
                hashes, offsets = tokens([text, item_text])
                best = overlaps(hashes[: offsets[1]], hashes[offsets[1] :], sorted(shifts))
                if best:
                    for n, value in zip(names, (key, item, *best)):
                        out[n].append(value)
            yield out

    checked = map_batches(both, work, "id long, item long, place long, n_tokens long, n_equal long")
    longest = F.max(F.struct("n_tokens", "n_equal", -F.col("place"))).alias("best")
    one = checked.groupBy("id", "item").agg(longest)
    return one.select(
        F.col("id").alias(id_col),
        F.col("item").alias(item_col),
        (-F.col("best.col3")).alias("place"),
        F.col("best.n_tokens").alias("n_tokens"),
        F.col("best.n_equal").alias("n_equal"),
        (F.col("best.n_equal") / F.col("best.n_tokens")).alias("similarity"),
    )
