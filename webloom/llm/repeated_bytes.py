"""Removal of bytes that repeat 50-byte strings of earlier documents, with suffix arrays of candidate passages.

Every window of WINDOW bytes has an anchor: the CORE-byte string in it with the smallest hash (the leftmost of equal
ones). Equal windows have equal anchors, so only windows whose anchor occurs in two documents can repeat:

1. Anchors of all documents are dealt by hash; those of two or more documents are shared. A Bloom filter of bounded size
   takes them to the tasks that read the documents; what it lets through wrongly costs time only.
2. Per shared anchor and document, the windows of the anchor form one segment. Where all segments of an anchor are equal,
   its first document decides. The others are brought together by anchor, equal ones once, in shards of bounded size.
3. A shard's suffixes are sorted by induced sorting; permuted common prefixes give its groups of equal windows, and each
   group its smallest document id.
4. Windows whose group has a smaller id than their document are joined back, and their union is removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.batches import GOLDEN, chunks, concatenated, held, map_batches, mix, partitions, powers, release, share
from webloom.llm.suffix_sort import repeated_windows
from webloom.session import written

WINDOW, CORE = 50, 24
REACH = WINDOW - CORE + 1  # cores in a window
SHARD_BYTES = 1 << 19  # segments sorted at a time; an anchor's segments stay together
HOT_SEGMENTS = 15  # anchors with 2**15 distinct segments or more (estimated) go by windows, not by segments
BUCKET_BYTES = 8 << 20  # text per bucket of anchors
CHUNK_BYTES = 6 << 20  # text whose anchors a task puts together before it sends them
FILTER_BITS, MOST_FILTER_BITS, PROBES = 24, 28, 3
_BASE = 0x9E3779B97F4A7C55
_INVERSE = pow(_BASE, -1, 1 << 64)
_ROW = ("id", "copy")  # a document and the hash of its text: rows of one id with other texts have spans of their own
_NAMELESS = (1 << 63) - (1 << 41)  # from here on numbers stand for documents without an id, which come after all others


def core_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the CORE bytes that start at each place."""
    with np.errstate(over="ignore"):
        one = data.astype(np.uint64) + np.uint64(1)
        sums, n = {1: one}, 1
        while n * 2 <= CORE:
            last = sums[n]
            sums[2 * n] = last[:-n] * np.uint64(pow(_BASE, n, 1 << 64)) + last[n:]
            n *= 2
        out, have = sums[n], n
        for size in sorted(sums, reverse=True):
            if CORE - have >= size:
                m = len(data) - have - size + 1
                out = out[:m] * np.uint64(pow(_BASE, size, 1 << 64)) + sums[size][have : have + m]
                have += size
    return mix(out)


def window_anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """document, first window, number of windows, place of the anchor and its hash (63 bits, the last bit is 0), for each run of windows that share
    an anchor; texts lie in `data` from offsets[i] to offsets[i + 1] - 1 (a separator follows each)."""
    n = len(data) - WINDOW + 1
    nothing = np.empty(0, np.int64)
    if n <= 0:
        return nothing, nothing, nothing, nothing, np.empty(0, np.uint64)
    hashes = core_hashes(data)
    key = (hashes >> np.uint64(32) << np.uint64(32)) | np.arange(len(hashes), dtype=np.uint64)
    size = 1
    while size * 2 <= REACH:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    key = np.minimum(key[: n], key[REACH - size : REACH - size + n])
    winner = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # Windows may not reach beyond their text.
    lengths = np.diff(offsets) - 1
    whole = lengths >= WINDOW
    mark = np.zeros(len(data) + 1, np.int32)
    np.add.at(mark, offsets[:-1][whole], 1)
    np.add.at(mark, offsets[:-1][whole] + lengths[whole] - WINDOW + 1, -1)
    inside = np.cumsum(mark[:n]) > 0
    winner[~inside] = -1
    first = np.flatnonzero(np.append(True, winner[1:] != winner[:-1]))
    count = np.diff(np.append(first, n))
    on = winner[first] >= 0
    first, count = first[on], count[on]
    # A run may go on into the next text only over separators, whose windows are not inside: no run spans two texts.
    document = np.searchsorted(offsets, first, side="right") - 1
    place = winner[first]
    # Smallest hashes crowd at the lower end; mixed again they spread over all buckets.
    return document, first, count, place, mix(hashes[place]) & ~np.uint64(1)


def segment_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the given stretches of bytes."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(data)), out=sums[1:])
        return mix((sums[end] - sums[begin]) * powers(_INVERSE, len(data))[begin] + (end - begin).astype(np.uint64) * GOLDEN)


def packed(values: np.ndarray) -> bytes:
    """Ascending 64-bit values as differences, by planes of bytes (the upper planes are mostly zeros)."""
    return np.diff(values, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def parts_of(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that only their values become Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def pieces(batches: Iterator[pa.RecordBatch], limit: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """(ids, hashes of texts, texts as bytes) of some consecutive rows at a time."""
    for part in parts_of(batches):
        ids = np.array(part.column("id"), np.int64)
        copy = np.array(part.column("copy"), np.int64)
        raw = [x or b"" for x in part.column("raw").to_pylist()]
        for first, last in chunks(raw, limit):
            yield ids[first:last], copy[first:last], raw[first:last]


def shared_anchors(rows: DataFrame, bits: int) -> DataFrame:
    """(bucket, n, anchors) of the anchors that occur in two documents; 2**bits buckets by the upper bits."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        found, owners, size, base = [], [], 0, 0

        def flush() -> dict:
            anchor, owner = np.concatenate(found), np.concatenate(owners)
            order = np.lexsort((owner, anchor))
            anchor, owner = anchor[order], owner[order]
            new = np.append(True, anchor[1:] != anchor[:-1])
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], len(anchor)) - 1
            value = anchor[starts] | (owner[starts] != owner[ends]).astype(np.uint64)  # last bit: two documents here
            bucket = (value >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(value), np.int64)
            cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            parts = np.append(cuts, len(value))
            return {"bucket": bucket[cuts], "anchors": [packed(value[a:b]) for a, b in zip(parts[:-1], parts[1:])]}

        for ids, _, raw in pieces(batches):
            data, offsets = concatenated(raw)
            document, _, _, _, anchor = window_anchors(data, offsets)
            if len(anchor):
                found.append(anchor)
                owners.append((document + base).astype(np.int32))
            base, size = base + len(ids), size + len(data)
            if size >= CHUNK_BYTES and found:
                yield flush()
                found, owners, size = [], [], 0
        if found:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held, bucket = [], None

        def shared() -> dict:
            value = np.sort(np.concatenate([unpacked(x) for x in held]))
            anchor = value & ~np.uint64(1)
            starts = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
            ends = np.append(starts[1:], len(anchor))
            keep = anchor[starts][(ends - starts > 1) | (value[ends - 1] & np.uint64(1) == 1)]
            return {"bucket": [bucket], "n": [len(keep)], "anchors": [packed(keep)]}

        for batch in batches:
            for b, x in zip(batch.column("bucket").to_pylist(), batch.column("anchors").to_pylist()):
                if b != bucket and held:
                    yield shared()
                    held = []
                bucket = b
                held.append(x)
        if held:
            yield shared()

    sent = map_batches(rows, send, "bucket long, anchors binary").repartition(partitions(rows), "bucket")
    return map_batches(sent.sortWithinPartitions("bucket"), meet, "bucket long, n long, anchors binary")


class AnchorFilter:
    """Bloom filter of anchors, one part per bucket; its size is bounded and it refuses none of its anchors."""

    def __init__(self, table: DataFrame, bits: int):
        """`table` has bucket, n and anchors, one row per bucket."""
        total = table.agg(F.sum("n")).first()[0] or 0
        self.bits, self.any = bits, total > 0
        wanted = max(64, FILTER_BITS * total >> bits)
        self.part = part = min(wanted.bit_length(), max(6, MOST_FILTER_BITS - bits))  # bits of a part, as a power of two
        if not self.any:
            return

        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for batch in batches:
                out = []
                for x in batch.column("anchors").to_pylist():
                    bit = np.zeros(1 << part, bool)
                    for at in _probes(unpacked(x), part):
                        bit[at] = True
                    out.append(np.packbits(bit, bitorder="little").tobytes())
                yield {"bucket": batch.column("bucket"), "filled": out}

        self.filled = np.zeros((1 << bits, 1 << (part - 3)), np.uint8)
        for row in map_batches(table.select("bucket", "anchors"), fill, "bucket long, filled binary").toLocalIterator():
            self.filled[row["bucket"]] |= np.frombuffer(row["filled"], np.uint8)
        self.filled = self.filled.ravel()

    def passes(self, anchor: np.ndarray) -> np.ndarray:
        """Places of the anchors that it lets through."""
        keep = np.arange(len(anchor))
        if not self.any:
            return keep[:0]
        begin = (anchor >> np.uint64(64 - self.bits) if self.bits else np.zeros(len(anchor), np.uint64)) << np.uint64(self.part)
        for k in range(PROBES):
            at = begin[keep] + _probe(anchor[keep], k, self.part)
            keep = keep[(self.filled[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
        return keep


def _probe(anchor: np.ndarray, k: int, part: int) -> np.ndarray:
    return mix(anchor + np.uint64(int(GOLDEN) * (k + 1) & 0xFFFFFFFFFFFFFFFF)) & np.uint64((1 << part) - 1)


def _probes(anchor: np.ndarray, part: int) -> Iterator[np.ndarray]:
    return (_probe(anchor, k, part) for k in range(PROBES))


def segments(rows: DataFrame, allowed: AnchorFilter) -> DataFrame:
    """id, copy, start, windows, anchor, context (hash of the segment and of its anchor's place in it) of shared anchors."""
    shared = share(rows.sparkSession, allowed)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for ids, copy, raw in pieces(batches):
            data, offsets = concatenated(raw)
            document, first, count, place, anchor = window_anchors(data, offsets)
            keep = held(shared).passes(anchor)
            document, first, count, place, anchor = (x[keep] for x in (document, first, count, place, anchor))
            if not len(keep):
                continue
            context = _context(data, first, count, place)
            yield {
                "id": ids[document], "copy": copy[document], "start": first - offsets[document], "windows": count,
                "anchor": anchor.view(np.int64), "context": context.view(np.int64),
            }

    return map_batches(rows, work, "id long, copy long, start int, windows int, anchor long, context long")


def _context(data: np.ndarray, first: np.ndarray, count: np.ndarray, place: np.ndarray) -> np.ndarray:
    return mix(segment_hashes(data, first, first + count + WINDOW - 1) + (place - first).astype(np.uint64) * GOLDEN)


def texts_of_segments(rows: DataFrame, wanted: AnchorFilter) -> DataFrame:
    """anchor, context, segment, low, high (smallest and largest id in this task) of the wanted anchors, equal segments
    of a task once."""
    shared = share(rows.sparkSession, wanted)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for ids, _, raw in pieces(batches, 1 << 19):
            data, offsets = concatenated(raw)
            document, first, count, place, anchor = window_anchors(data, offsets)
            keep = held(shared).passes(anchor)
            if not len(keep):
                continue
            document, first, count, place, anchor = (x[keep] for x in (document, first, count, place, anchor))
            context, own = _context(data, first, count, place), ids[document]
            order = np.lexsort((own, context, anchor))
            a, c = anchor[order], context[order]
            starts = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (c[1:] != c[:-1])))
            ends = np.append(starts[1:], len(a)) - 1
            some = order[starts]
            size = count[some] + WINDOW - 1
            cuts = np.append(0, np.cumsum(size))
            at = np.repeat(first[some] - cuts[:-1], size) + np.arange(cuts[-1])
            buffers = [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data[at])]
            yield {
                "anchor": a[starts].view(np.int64), "context": c[starts].view(np.int64),
                "segment": pa.BinaryArray.from_buffers(pa.binary(), len(some), buffers),
                "low": own[some], "high": own[order[ends]],
            }

    return map_batches(rows, work, "anchor long, context long, segment binary, low long, high long")


def sorted_shards(parts: DataFrame) -> DataFrame:
    """anchor, context, first, last, low: runs of windows of a segment that start in the document `low` too, for
    segments dealt by anchor; runs that could remove nothing are left out."""

    def solve(anchor: list, context: list, segment: list, low: list, high: list) -> dict:
        """One shard: whole anchors; rows of one anchor and context follow each other."""
        key_a, key_c = np.array(anchor, np.int64), np.array(context, np.int64)
        starts = np.flatnonzero(np.append(True, (key_a[1:] != key_a[:-1]) | (key_c[1:] != key_c[:-1])))
        low_of, high_of = np.minimum.reduceat(np.array(low), starts), np.maximum.reduceat(np.array(high), starts)
        text = [segment[i] for i in starts]
        sizes = np.fromiter(map(len, text), np.int64, len(text))
        data = np.frombuffer(b"\0".join(text) + b"\0", np.uint8)
        begin = np.cumsum(sizes + 1) - sizes - 1
        windows = sizes - WINDOW + 1
        owner = np.repeat(np.arange(len(text)), windows)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        valid = np.zeros(len(data), bool)
        valid[begin[owner] + place] = True
        order, group = repeated_windows(data, valid, WINDOW)
        at = np.zeros(len(data), np.int64)
        at[begin[owner] + place] = np.arange(len(owner))
        index = at[order]
        heads = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        least = np.minimum.reduceat(low_of[owner[index]], heads)
        best = np.empty(len(owner), np.int64)
        best[index] = least[group]
        new = np.append(True, (owner[1:] != owner[:-1]) | (best[1:] != best[:-1]))
        run = np.flatnonzero(new)
        last = np.append(run[1:], len(owner)) - 1
        keep = best[run] < high_of[owner[run]]
        run, last = run[keep], last[keep]
        of = starts[owner[run]]
        return {"anchor": key_a[of], "context": key_c[of], "first": place[run], "last": place[last], "low": best[run]}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        names = ("anchor", "context", "segment", "low", "high")
        held: dict[str, list] = {n: [] for n in names}
        size = 0
        for batch in batches:
            columns = {n: batch.column(n).to_pylist() for n in names}
            anchor = np.array(columns["anchor"], np.int64)
            cuts = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])).tolist() + [len(anchor)]
            for a, b in zip(cuts, cuts[1:]):
                if size >= SHARD_BYTES and held["anchor"][-1] != columns["anchor"][a]:
                    yield solve(**held)
                    held, size = {n: [] for n in names}, 0
                for n in names:
                    held[n] += columns[n][a:b]
                size += sum(map(len, columns["segment"][a:b]))
        if held["anchor"]:
            yield solve(**held)

    return map_batches(parts, work, "anchor long, context long, first int, last int, low long")


def windows_of(rows: DataFrame, wanted: AnchorFilter) -> DataFrame:
    """id, copy, start, window_a, window_b (hashes) of every window of the wanted anchors."""
    shared = share(rows.sparkSession, wanted)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for ids, copy, raw in pieces(batches):
            data, offsets = concatenated(raw)
            document, first, count, _, anchor = window_anchors(data, offsets)
            keep = held(shared).passes(anchor)
            if not len(keep):
                continue
            document, first, count, anchor = (x[keep] for x in (document, first, count, anchor))
            begin = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
            owner = np.repeat(document, count)
            yield {
                "id": ids[owner], "copy": copy[owner], "start": begin - offsets[owner],
                "window_a": segment_hashes(data, begin, begin + WINDOW).view(np.int64),
                "window_b": np.repeat(anchor, count).view(np.int64),
            }

    return map_batches(rows, work, "id long, copy long, start int, window_a long, window_b long")


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of stretches as maximal runs."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.append(True, begin[1:] > end[:-1])
    return begin[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]


def spans_per_document(ranges: DataFrame) -> DataFrame:
    """id, copy, spans (begin and end of maximal runs, one after the other) from (id, copy, begin, end)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        key, held_begin, held_end = None, [], []
        out: dict[str, list] = {"id": [], "copy": [], "spans": []}

        def close() -> None:
            begin, end = merged(np.concatenate(held_begin), np.concatenate(held_end))
            out["id"].append(key[0])
            out["copy"].append(key[1])
            out["spans"].append(np.stack((begin, end), 1).ravel())

        for batch in batches:
            ids, copy, begin, end = (np.array(batch.column(c), np.int64) for c in ("id", "copy", "begin", "end"))
            new = np.append(True, (ids[1:] != ids[:-1]) | (copy[1:] != copy[:-1]))
            cuts = np.flatnonzero(new).tolist() + [len(ids)]
            for a, b in zip(cuts, cuts[1:]):
                if (ids[a], copy[a]) != key:
                    if held_begin:
                        close()
                    key, held_begin, held_end = (int(ids[a]), int(copy[a])), [], []
                held_begin.append(begin[a:b])
                held_end.append(end[a:b])
            if len(out["id"]) > 2000:
                yield out
                out = {"id": [], "copy": [], "spans": []}
        if held_begin:
            close()
        yield out

    dealt = ranges.repartition(partitions(ranges), "id", "copy").sortWithinPartitions("id", "copy")
    return map_batches(dealt, work, "id long, copy long, spans array<int>")


def kept_bytes(docs: DataFrame) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 from (id, raw, spans)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        names = ("id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
        for batch in parts_of(batches):
            out: dict[str, list] = {n: [] for n in names}
            for key, raw, spans in zip(*(batch.column(c).to_pylist() for c in ("id", "raw", "spans"))):
                raw, at, left, removed = raw or b"", 0, hashlib.sha256(), 0
                spans = [min(s, len(raw)) for s in spans]
                spans = [s for pair in zip(spans[::2], spans[1::2]) if pair[0] < pair[1] for s in pair]
                for begin, end in zip(spans[::2], spans[1::2]):
                    left.update(raw[at:begin])
                    removed, at = removed + end - begin, end
                left.update(raw[at:])
                for n, value in zip(names, (key, len(raw), removed, len(spans) // 2, left.hexdigest())):
                    out[n].append(value)
            yield out

    return map_batches(docs, work, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id_col (less than 2**63 - 2**41), n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of the bytes that stay).

    A byte goes if a string of 50 bytes that covers it also starts in a document with a smaller id, as both stand in the
    input. Null texts are empty; rows with equal ids remove nothing from each other; documents without an id come after
    all others and remove nothing from each other. Rows that repeat an id with another text are judged one by one: each
    loses what its own text repeats of smaller ids. Repeated rows are all returned; an empty table gives an empty one.

    Whole copies of an earlier document are settled by a digest and don't go on. Anchors with very many different
    segments don't form a shard: their windows are grouped one by one, with partial aggregation.
    """
    spark = docs.sparkSession
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(
        F.coalesce(docs[id_col].cast("long"), F.lit(_NAMELESS) + F.pmod(F.xxhash64(text), F.lit(1 << 40))).alias("id"),
        F.xxhash64(F.lit(5), text).alias("copy"),
        text.cast("binary").alias("raw"),
    )
    keys = written(
        rows.select("id", "copy", F.octet_length("raw").cast("long").alias("n_bytes"), F.sha2("raw", 256).alias("sha")), "byte-keys"
    )
    firsts = keys.filter(F.col("n_bytes") >= WINDOW).groupBy("sha").agg(F.min("id").alias("earliest"))
    copies = keys.join(firsts, "sha").filter(earlier("earliest"))
    whole = written(copies.select(*_ROW).distinct(), "byte-whole-copies")
    own = rows.join(whole, [*_ROW], "left_anti")
    total = keys.agg(F.sum("n_bytes")).first()[0] or 0
    bits = max(4, int(max(4 * partitions(docs), total // BUCKET_BYTES)).bit_length())

    shared = written(shared_anchors(own, bits), "shared-anchors")
    release(spark)
    found = written(segments(own, AnchorFilter(shared, bits)), "byte-segments")
    lowest = F.col("context").bitwiseAND(-F.col("context"))  # bit of the trailing zeros, for the number of contexts
    stats = found.groupBy("anchor").agg(
        F.min("context").alias("context"), F.max("context").alias("other"), F.bit_or(lowest).alias("seen"),
        F.min("id").alias("low"), F.max("id").alias("high"), F.max("windows").alias("windows"),
    )
    # The lowest bit that is not set in `seen`.
    hot = (F.col("seen") + 1).bitwiseAND(F.bitwise_not("seen")) >= 1 << HOT_SEGMENTS
    stats = stats.filter("low < high").withColumn("kind", F.when(F.col("context") == F.col("other"), 0).when(hot, 2).otherwise(1))
    stats = written(stats.drop("other", "seen"), "byte-anchors")
    release(spark)
    shards = sorted_shards(
        texts_of_segments(own, AnchorFilter(bucketed(stats.filter("kind = 1"), bits), bits))
        .repartition(partitions(docs), "anchor")
        .sortWithinPartitions("anchor", "context")
    )
    single = stats.filter("kind = 0").select(
        "anchor", "context", F.lit(0).alias("first"), (F.col("windows") - 1).alias("last"), "low"
    )
    runs = written(single.unionByName(shards), "byte-runs")
    release(spark)
    ranges = found.join(runs, ["anchor", "context"]).filter(earlier("low"))
    ranges = ranges.select(
        *_ROW, (F.col("start") + F.col("first")).alias("begin"), (F.col("start") + F.col("last") + WINDOW).alias("end")
    )
    hot_anchors = AnchorFilter(bucketed(stats.filter("kind = 2"), bits), bits)
    if hot_anchors.any:
        windows = written(windows_of(own, hot_anchors), "byte-windows")
        least = windows.groupBy("window_a", "window_b").agg(F.min("id").alias("low"))
        repeated = windows.join(least, ["window_a", "window_b"]).filter(earlier("low"))
        ranges = ranges.unionByName(repeated.select(*_ROW, F.col("start").alias("begin"), (F.col("start") + WINDOW).alias("end")))
    spans = written(spans_per_document(ranges), "byte-spans")
    release(spark)
    cut = kept_bytes(own.join(spans, [*_ROW]))
    rest = keys.join(spans.select(*_ROW), [*_ROW], "left_anti").join(whole.withColumn("whole", F.lit(True)), [*_ROW], "left")
    gone = F.coalesce("whole", F.lit(False))
    rest = rest.select(
        "id", "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(0).alias("n_removed"),
        F.when(gone, 1).otherwise(0).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.col("sha")).alias("kept_sha256"),
    )
    done = cut.unionByName(rest)
    return done.withColumn("id", F.when(F.col("id") < _NAMELESS, F.col("id"))).withColumnRenamed("id", id_col)


def earlier(low: str) -> Column:
    """Whether `low` is the id of a document that comes before `id`."""
    return F.col(low) < F.least("id", F.lit(_NAMELESS))


def bucketed(anchors: DataFrame, bits: int) -> DataFrame:
    """(bucket, n, anchors) as AnchorFilter takes them, from one row per anchor."""
    bucket = F.shiftrightunsigned("anchor", 64 - bits)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held, bucket = [], None

        def close() -> dict:
            value = np.sort(np.concatenate(held).view(np.uint64))
            return {"bucket": [bucket], "n": [len(value)], "anchors": [packed(value)]}

        for batch in batches:
            number, anchor = (np.array(batch.column(c), np.int64) for c in ("bucket", "anchor"))
            cuts = np.flatnonzero(np.append(True, number[1:] != number[:-1])).tolist() + [len(number)]
            for a, b in zip(cuts, cuts[1:]):
                if number[a] != bucket and held:
                    yield close()
                    held = []
                bucket = int(number[a])
                held.append(anchor[a:b])
        if held:
            yield close()

    dealt = anchors.select(bucket.alias("bucket"), "anchor").repartition(partitions(anchors), "bucket")
    table = map_batches(dealt.sortWithinPartitions("bucket"), work, "bucket long, n long, anchors binary")
    return written(table, "anchor-buckets")
