"""Token-ID files: independent zstandard frames with a trailing seek table.

Layout of a file:

- data frames, each an independent zstandard frame with the ids of consecutive documents as little-endian unsigned
  32-bit integers; a frame is closed when it holds FRAME_IDS ids,
- one index frame: per document its id (64 bits, signed), a flag for a null id, its frame number and its number of ids,
- a seek table in a skippable frame, in the public seekable format: per frame compressed size, decompressed size and a
  checksum (low 32 bits of xxh64 of the decompressed bytes); then number of frames, descriptor and magic number.

A reader takes the seek table from the end of the file, the index frame before it, and decompresses only the frames
that hold the requested documents; every frame it reads is checked.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.batches import filesystem, held, map_batches, partitions, share, shared_output, slices, texts
from webloom.llm.words import END, START, WORD_END, Memory, visible_runs, words_of
from webloom.session import written

# Fixed values of the public seekable zstandard format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

FRAME_IDS = 1 << 16
REMEMBERED = 600_000  # runs of visible characters kept per generation with their ids; only speed depends on it
_ENTRY, _FOOTER = "<III", "<IBI"
_FOOTER_SIZE = struct.calcsize(_FOOTER)
_ENTRY_SIZE = struct.calcsize(_ENTRY)
_INDEX = np.dtype([("doc_id", "<i8"), ("null_id", "u1"), ("frame", "<u4"), ("n_ids", "<u4")])


def checksum(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class Writer:
    """Writes documents one after the other; close() adds index and seek table."""

    def __init__(self, sink, level: int = 3):
        self.sink, self.pack = sink, zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int, int]] = []
        self.index: list[tuple[int, bool, int, int]] = []
        self.waiting: list[np.ndarray] = []
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.index.append((doc_id or 0, doc_id is None, len(self.frames), len(ids)))
        self.waiting.append(ids.astype("<u4"))
        self.held += len(ids)
        if self.held >= FRAME_IDS:
            self._flush()

    def _flush(self) -> None:
        if self.waiting:
            self._frame(b"".join(x.tobytes() for x in self.waiting))
            self.waiting, self.held = [], 0

    def _frame(self, data: bytes) -> None:
        packed = self.pack.compress(data)
        self.sink.write(packed)
        self.frames.append((len(packed), len(data), checksum(data)))

    def close(self) -> None:
        self._flush()
        self._frame(np.array(self.index, _INDEX).tobytes())
        table = b"".join(struct.pack(_ENTRY, *f) for f in self.frames) + struct.pack(
            _FOOTER, len(self.frames), CHECKSUM_FLAG, SEEKABLE_MAGIC
        )
        self.sink.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)


class Reader:
    """Reads a file that supports seek(); raises ValueError where sizes, magic numbers or checksums are wrong."""

    def __init__(self, source):
        self.source, self.unpack = source, zstandard.ZstdDecompressor()
        end = source.seek(0, 2)
        if end < _FOOTER_SIZE:
            raise ValueError("too short for a seek table")
        source.seek(end - _FOOTER_SIZE)
        count, flags, magic = struct.unpack(_FOOTER, source.read(_FOOTER_SIZE))
        length = count * _ENTRY_SIZE + _FOOTER_SIZE
        if magic != SEEKABLE_MAGIC or flags != CHECKSUM_FLAG or end < length + 8:
            raise ValueError("no seek table with checksums at the end")
        source.seek(end - length - 8)
        if struct.unpack("<II", source.read(8)) != (SKIPPABLE_MAGIC, length):
            raise ValueError("the seek table does not fit its footer")
        table = np.frombuffer(source.read(count * _ENTRY_SIZE), "<u4").reshape(count, 3).astype(np.int64)
        self.packed, self.plain, self.sums = table.T
        self.at = np.cumsum(self.packed) - self.packed
        if not count or self.at[-1] + self.packed[-1] != end - length - 8:
            raise ValueError("frame sizes do not add up")
        self.index = np.frombuffer(self.frame(count - 1), _INDEX)
        before = np.cumsum(self.index["n_ids"], dtype=np.int64) - self.index["n_ids"]
        first = np.searchsorted(self.index["frame"], self.index["frame"], side="left")
        self.begin = before - before[first] if len(before) else before  # place of a document in its frame

    def frame(self, number: int) -> bytes:
        self.source.seek(int(self.at[number]))
        packed = self.source.read(int(self.packed[number]))
        data = self.unpack.decompress(packed, max_output_size=int(self.plain[number]))
        if len(data) != self.plain[number] or checksum(data) != self.sums[number]:
            raise ValueError(f"frame {number} fails its checksum")
        return data

    def documents(self, rows: Iterable[int] | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) of the documents at the given rows of the index (ascending), or of all."""
        held, data = -1, np.empty(0, "<u4")
        for row in range(len(self.index)) if rows is None else rows:
            entry = self.index[row]
            if entry["frame"] != held and entry["n_ids"]:
                held, data = int(entry["frame"]), np.frombuffer(self.frame(int(entry["frame"])), "<u4")
            begin = int(self.begin[row])
            ids = data[begin : begin + int(entry["n_ids"])] if entry["n_ids"] else np.empty(0, "<u4")
            yield None if entry["null_id"] else int(entry["doc_id"]), ids

    def rows_of(self, doc_ids: Iterable[int]) -> list[int]:
        wanted = np.isin(self.index["doc_id"], np.fromiter(doc_ids, np.int64)) & (self.index["null_id"] == 0)
        return np.flatnonzero(wanted).tolist()


class LibraryEncoder:
    """Ids of texts from the tokenizers library, which gets each distinct word once.

    Texts are cut where the tokenizer itself cuts them, and what a run between white space gives is remembered, over the
    tasks of a worker too.
    """

    def __init__(self, stored: str):
        self.stored, self.memory = stored, Memory(REMEMBERED)
        self.tokenizer = None

    def _open(self) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer = Tokenizer.from_str(self.stored)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = {w: self.tokenizer.token_to_id(w) for w in (START, END)}
        # Words come normalized and split; the library gets them between blanks.
        self.tokenizer.normalizer = None
        self.tokenizer.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        for label, number in self.tokenizer.get_vocab().items():
            self.ends[number] = label.endswith(WORD_END)

    def _encode(self, runs: list[str]) -> list[bytes]:
        if self.tokenizer is None:
            self._open()
        mixed = {r: words_of(r) for r in runs if not r.isalpha()}
        distinct = {r for r in runs if r not in mixed}
        for words in mixed.values():
            distinct.update(words)
        distinct = list(distinct - self.special.keys())
        encoded = self.tokenizer.encode_batch_fast([" ".join(distinct)], add_special_tokens=False)[0]
        ids = np.array(encoded.ids, "<u4")
        cuts = [0, *(np.flatnonzero(self.ends[ids]) + 1).tolist()]  # every word ends with a token that marks its end
        data = ids.tobytes()
        of = {w: data[4 * a : 4 * b] for w, a, b in zip(distinct, cuts[:-1], cuts[1:], strict=True)}
        of |= {w: np.uint32(n).tobytes() for w, n in self.special.items()}
        return [b"".join(map(of.__getitem__, mixed[r])) if r in mixed else of[r] for r in runs]

    def run(self, documents: list[str]) -> Iterator[np.ndarray]:
        for found in self.memory.of([visible_runs(t) for t in documents], self._encode):
            yield np.frombuffer(b"".join(found), "<u4")


def write_files(
    docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", level: int = 3
) -> DataFrame:
    """Encode and write all documents in ascending order of id_col; returns the manifest of the files.

    One file per range of ids, below the shared folder. Null texts count as empty, a document has `end_id` after its
    ids, null ids come first, rows with the same id stand in the order of their texts. A file gets a name of its own
    per attempt, so a repeated task does no harm; the manifest (path, n_docs, n_ids, first and last id) names the files
    that count. An empty table gives an empty manifest. The tokenizer is read on the driver; its size is fixed.
    """
    spark = docs.sparkSession
    folder = shared_output(spark, "token-files")
    with open(tokenizer, encoding="utf-8") as file:
        shared = share(spark, LibraryEncoder(file.read()))
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    tie = F.xxhash64("text")
    ranged = rows.repartitionByRange(partitions(docs), F.col("id"), tie).sortWithinPartitions("id", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encoder, sink, writer = held(shared), None, None
        n_ids, first, last, path = 0, None, None, ""
        for batch in batches:
            keys, strings = batch.column("id").to_pylist(), texts(batch)
            for at, to in slices(strings):
                if writer is None:
                    name = f"{folder}/{uuid.uuid4().hex}.ids.zst"
                    system, path = filesystem(name)
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    sink = system.open_output_stream(path, compression=None)
                    writer, first, path = Writer(sink, level), keys[0], name
                for key, ids in zip(keys[at:to], encoder.run(strings[at:to])):
                    writer.add(key, np.append(ids, np.uint32(end_id)))
                    n_ids, last = n_ids + len(ids) + 1, key
        if writer is not None:
            writer.close()
            sink.close()
            yield {
                "path": [path], "n_docs": [len(writer.index)], "n_ids": [n_ids], "first_id": [first], "last_id": [last],
            }

    schema = "path string, n_docs long, n_ids long, first_id long, last_id long"
    numbered = map_batches(ranged, work, schema).withColumn("part", F.spark_partition_id())
    return written(numbered, "token-manifest")


def read_files(manifest: DataFrame, wanted: set[int] | None = None) -> DataFrame:
    """Documents of the files: doc_id, start (ids before it in all files), n_tokens, ids_crc32.

    `wanted` restricts the result to some ids: only frames that hold them are decompressed. Files are read by as many
    tasks as there are files. ids_crc32 is the unsigned crc32 of the ids as little-endian unsigned 32-bit integers.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("begin", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    spread = placed.select("path", "begin").repartition(max(1, partitions(manifest)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for path, begin in zip(*(batch.column(c).to_pylist() for c in ("path", "begin"))):
                system, place = filesystem(path)
                with system.open_input_file(place) as source:
                    reader = Reader(source)
                    starts = begin + np.cumsum(reader.index["n_ids"], dtype=np.int64) - reader.index["n_ids"]
                    rows = list(range(len(starts))) if wanted is None else reader.rows_of(wanted)
                    out: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
                    for row, (key, ids) in zip(rows, reader.documents(rows)):
                        out["doc_id"].append(key)
                        out["start"].append(int(starts[row]))
                        out["n_tokens"].append(len(ids))
                        out["ids_crc32"].append(zlib.crc32(ids.tobytes()))
                    yield out

    return map_batches(spread, work, "doc_id long, start long, n_tokens long, ids_crc32 long")
