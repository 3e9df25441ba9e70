"""Near-duplicate groups with SuperMinHash signatures, banding, exact verification and union-find.

A SuperMinHash signature gives every element one random permutation of the slots; in round j the element puts the rank
j + r (r random in [0, 1)) into the slot that its permutation names, and each slot keeps its minimum. The ranks of one
element are correlated, which lowers the variance against independent hash functions, and a document is finished in the
first round that cannot lower any slot (early stopping): large documents need a few rounds only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.batches import GOLDEN, map_batches, mix, partitions, powers, slices, texts
from webloom.llm.components import components
from webloom.llm.shingles import hashed_shingles, overlap
from webloom.session import written

ROWS = 5  # slots of a band
BANDS = 40  # a pair of similarity 0.75 shares no band with probability 2e-5, one of 0.8 with 1e-7
SLOTS = ROWS * BANDS
SIMILAR = 75  # linked if 100 * intersection >= SIMILAR * union
LIKELY = 0.59  # share of equal slots below which a pair is not verified again; 0.75 less five deviations
GROUP = 256  # members of a bucket compared with each other in one go
_BLOCK = 1 << 16  # shingles handled at a time; each holds its permutation in SLOTS bytes


def signatures(values: np.ndarray, offsets: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash signature of each set (not empty), as floats: document by slot; slots is 256 at most."""
    n = len(offsets) - 1
    out = np.full((n, slots), np.inf)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + _BLOCK, side="right")) - 1)
        _block(values[offsets[first] : offsets[last]], np.diff(offsets[first : last + 1]), out[first:last], slots)
        first = last
    return out


def _block(values: np.ndarray, sizes: np.ndarray, out: np.ndarray, slots: int) -> None:
    owner = np.repeat(np.arange(len(sizes)), sizes)
    permutation = np.tile(np.arange(slots, dtype=np.uint8), (len(values), 1))
    rows = np.arange(len(values))
    flat = out.reshape(-1)
    seeds = GOLDEN * np.arange(1, slots + 1, dtype=np.uint64)
    for j in range(slots):
        random = mix(values + seeds[j])
        other = j + ((random & np.uint64(0xFFFFFF)) % np.uint64(slots - j)).astype(np.int64)
        chosen = permutation[rows, other]
        permutation[rows, other] = permutation[rows, j]
        rank = j + (random >> np.uint64(24)) * 2.0**-40
        np.minimum.at(flat, owner * slots + chosen, rank)
        open_ = out.max(axis=1) >= j + 1
        stay = open_[owner]
        if not stay.all():
            values, owner, rows = values[stay], owner[stay], rows[stay]
        if not len(values):
            break


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band, different bands having different keys."""
    bits = signature.view(np.uint64).reshape(len(signature), -1, rows)
    key = (mix(bits.copy()) * powers(0xC2B2AE3D27D4EB4F, rows + 1)[1:]).sum(axis=2, dtype=np.uint64)
    return mix(key + GOLDEN * np.arange(1, key.shape[1] + 1, dtype=np.uint64))


def short_signature(signature: np.ndarray) -> np.ndarray:
    """One byte per slot."""
    return (mix(signature.view(np.uint64).copy()) >> np.uint64(56)).astype(np.uint8)


def shingle_rows(rows: DataFrame) -> DataFrame:
    """id, n_shingles, set_a, set_b (128-bit key of the set), bands and short signature of each (id, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            ids, strings = batch.column("id").to_pylist(), texts(batch)
            for at, to in slices(strings, 1 << 22, 1024):
                values, offsets = hashed_shingles([t.encode() for t in strings[at:to]])
                sizes = np.diff(offsets)
                full = np.flatnonzero(sizes)
                filled = np.append(0, np.cumsum(sizes[full]))
                bands: list = [[]] * len(sizes)
                short = [b""] * len(sizes)
                keys = np.zeros((2, len(sizes)), np.int64)
                if len(full):
                    slots = signatures(values, filled)
                    for row, b, x in zip(full.tolist(), band_keys(slots).view(np.int64), short_signature(slots)):
                        bands[row], short[row] = b, x.tobytes()
                    for k in range(2):
                        keys[k, full] = np.add.reduceat(mix(values + np.uint64(k + 1)), filled[:-1]).view(np.int64)
                yield {
                    "id": ids[at:to], "n_shingles": sizes, "set_a": keys[0], "set_b": keys[1], "bands": bands,
                    "signature": short,
                }

    schema = "id long, n_shingles long, set_a long, set_b long, bands array<long>, signature binary"
    return map_batches(rows, work, schema)


def verified(pairs: DataFrame, needed: DataFrame) -> DataFrame:
    """a, b, common, total for pairs (a, b): sizes of intersection and union of the full shingle sets."""
    left = needed.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = needed.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            out: dict[str, list] = {"a": batch.column("a"), "b": batch.column("b"), "common": [], "total": []}
            held_text, held = None, np.empty(0, np.uint64)
            for one, other in zip(texts(batch, "text_a"), texts(batch, "text_b")):
                if other != held_text:  # rows of one centre follow each other
                    held_text, held = other, hashed_shingles([other.encode()])[0]
                own = hashed_shingles([one.encode()])[0]
                common = overlap(own, held)
                out["common"].append(common)
                out["total"].append(len(own) + len(held) - common)
            yield out

    return map_batches(both, work, "a long, b long, common long, total long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents linked by word shingles: id_col, n_shingles, component_id, kept.

    Documents are linked if their sets of five-word shingles have a similarity of 0.75 or more; component_id is the
    smallest id reachable. Null and empty texts and texts without words have no shingles and no links. Rows with a null
    id get null component_id and kept; repeated rows are all returned; rows that share an id but not the text count as
    one document that has either text. An empty table gives an empty one.

    Equal sets are joined by their keys first, so of many copies one goes on. Every band key has a centre, the smallest
    id in its bucket; members are verified against the centre, which needs one pair per member. Pairs of members that
    this leaves apart are then compared where the triangle inequality of the distance to the centre allows a link.
    """
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    sets = written(shingle_rows(rows), "shingle-sets")
    known = sets.filter((F.col("n_shingles") > 0) & F.col("id").isNotNull())
    classes = written(known.groupBy("set_a", "set_b").agg(F.min("id").alias("rep"), F.first("n_shingles").alias("size")), "set-classes")
    # Merge joins: what moves is then the same share of the input at every size.
    chosen = classes.select(F.col("rep").alias("id")).distinct().hint("merge")
    reps = known.select("id", "n_shingles", "bands").join(chosen, "id", "left_semi")
    banded = reps.select(F.col("id").alias("rep"), F.col("n_shingles").alias("size"), F.explode("bands").alias("key")).distinct()
    centres = banded.groupBy("key").agg(F.min("rep").alias("centre"), F.max("rep").alias("last")).filter("centre <> last")
    members = written(banded.join(centres.drop("last"), "key"), "bucket-members")
    stars = members.filter("rep <> centre").select(F.col("rep").alias("a"), F.col("centre").alias("b")).distinct()
    stars = written(stars, "star-pairs")
    wanted = stars.select("a").union(stars.select("b")).distinct().withColumnRenamed("a", "id")
    needed = written(rows.join(wanted.hint("merge"), "id", "left_semi"), "candidate-texts")
    checked = written(verified(stars, needed), "verified-stars")
    linked = F.col("common") * 100 >= F.col("total") * SIMILAR
    links = checked.filter(linked).select("a", "b")
    found = components(links)
    slots = known.select(F.col("id").alias("rep"), "bands", "signature").dropDuplicates(["rep"])
    more = written(apart(members, checked, found, slots.join(needed.withColumnRenamed("id", "rep"), "rep")), "late-links")
    found = components(links.union(more))
    label = classes.join(found, classes["rep"] == found["node"], "left").select(
        "set_a", "set_b", F.coalesce("component", "rep").alias("component_id")
    )
    narrow = sets.select("id", "n_shingles", "set_a", "set_b").join(label, ["set_a", "set_b"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id"))
    return narrow.select(
        F.col("id").alias(id_col),
        "n_shingles",
        F.when(F.col("id").isNotNull(), component).alias("component_id"),
        (F.col("id") == component).alias("kept"),
    )


def apart(members: DataFrame, checked: DataFrame, found: DataFrame, slots: DataFrame) -> DataFrame:
    """Links (a, b) between members of a bucket that are in different components, as far as components need them.

    With d the Jaccard distance, d(a, b) >= |d(a, centre) - d(b, centre)|, and the sizes of linked sets differ by the
    factor SIMILAR at most. A bucket's members that its centre's component holds and that are too near the centre for
    any other member of the bucket drop out. The others are compared in tasks, GROUP by GROUP of a bucket: a pair in the
    first bucket that it shares only, and on full sets if LIKELY of its slots agree. `slots` has rep, bands, signature
    and text.
    """
    distance = checked.select(
        F.col("a").alias("rep"), F.col("b").alias("centre"), (1 - F.col("common") / F.col("total")).alias("distance")
    )
    distance = distance.groupBy("rep", "centre").agg(F.min("distance").alias("distance"))
    of_centre = found.select(F.col("node").alias("centre"), F.col("component").alias("home"))
    placed = (
        members.join(distance, ["rep", "centre"], "left")
        .join(found.withColumnRenamed("node", "rep"), "rep", "left")
        .join(of_centre, "centre", "left")
        .select(
            "key", "rep", "size",
            F.coalesce("distance", F.lit(0.0)).alias("distance"),
            F.coalesce("component", "rep").alias("component"),
            F.coalesce("home", "centre").alias("home"),
        )
    )
    placed = written(placed, "bucket-components")
    slack = 1 - SIMILAR / 100 + 1e-9
    strange = placed.filter("component <> home").groupBy("key").agg(F.min("distance").alias("nearest"))
    open_ = placed.join(strange, "key").filter(
        (F.col("component") != F.col("home")) | (F.col("distance") >= F.col("nearest") - slack)
    )
    open_ = written(open_.select("key", "rep", "size", "distance", "component"), "open-members")
    count = open_.groupBy("key").agg(F.ceil(F.count("*") / GROUP).alias("blocks"))
    block = F.pmod(F.xxhash64("rep"), F.col("blocks"))
    cut = open_.join(count, "key").withColumn("block", block).join(slots, "rep")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    both = cut.select("key", "rep", "size", "distance", "component", "bands", "signature", "text", "block", other)
    both = both.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    dealt = both.repartition(partitions(members), "key", "low", "high").sortWithinPartitions("key", "low", "high", "rep")
    names = ("block", "rep", "size", "distance", "component", "bands", "signature", "text")

    def links(key: int, held: dict[str, list]) -> tuple[list[int], list[int]]:
        block, rep, size, distance, component = (np.array(held[n]) for n in names[:5])
        bands = np.array(held["bands"], np.int64)
        slot = np.frombuffer(b"".join(held["signature"]), np.uint8).reshape(len(rep), SLOTS)
        alone = block.min() == block.max()
        sets: dict[int, np.ndarray] = {}
        one, two = [], []

        def shingles(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = hashed_shingles([(held["text"][i] or "").encode()])[0]
            return sets[i]

        for i in range(len(rep) - 1):
            j = np.arange(i + 1, len(rep))
            ok = (component[j] != component[i]) & (np.abs(distance[j] - distance[i]) <= slack)
            ok &= np.minimum(size[j], size[i]) * 100 >= np.maximum(size[j], size[i]) * SIMILAR
            if not alone:
                ok &= block[j] != block[i]
            j = j[ok]
            j = j[(slot[j] == slot[i]).sum(axis=1) >= LIKELY * SLOTS]
            j = j[bands[i][(bands[j] == bands[i]).argmax(axis=1)] == key]
            for k in j.tolist():
                if component[i] != component[k]:
                    common = overlap(shingles(i), shingles(k))
                    if common * 100 >= (len(shingles(i)) + len(shingles(k)) - common) * SIMILAR:
                        one.append(int(max(rep[i], rep[k])))
                        two.append(int(min(rep[i], rep[k])))
                        component[component == component[k]] = component[i]
        return one, two

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: dict[str, list] = {n: [] for n in names}
        current = None
        for batch in batches:
            columns = {n: batch.column(n).to_pylist() for n in names}
            group = np.stack([np.array(batch.column(n), np.int64) for n in ("key", "low", "high")], 1)
            cuts = np.flatnonzero(np.append(True, (group[1:] != group[:-1]).any(axis=1))).tolist() + [len(group)]
            for x, y in zip(cuts, cuts[1:]):
                if current is not None and current != tuple(group[x]):
                    a, b = links(int(current[0]), held)
                    yield {"a": a, "b": b}
                    held = {n: [] for n in names}
                current = tuple(group[x])
                for n in names:
                    held[n] += columns[n][x:y]
        if held["rep"]:
            a, b = links(int(current[0]), held)
            yield {"a": a, "b": b}

    return map_batches(dealt, work, "a long, b long").distinct()
