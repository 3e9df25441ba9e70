"""Small helpers that the operators of this folder share: Arrow batches, hashing of words, output paths."""

from __future__ import annotations

import gc
import pickle
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from webloom.session import scratch_dir
from webloom.sources.tables import read_table

C1, C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def documents(spark, folder: str, name: str = "documents") -> DataFrame:
    return read_table(spark, folder, name)


def map_batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow with a generator of column dictionaries (name to list or array) instead of record batches."""
    fields = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in work(batches):
            found = ((columns[field.name], field.type) for field in arrow)
            arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=kind, from_pandas=True) for c, kind in found]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, fields)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The strings of a column; null becomes the empty string."""
    return [t or "" for t in batch.column(column).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64, elementwise: every bit of the result depends on every bit of the input."""
    x = x ^ (x >> np.uint64(30))
    x *= C1
    x ^= x >> np.uint64(27)
    x *= C2
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.empty(max(n, 1), np.uint64)
    out[0], filled, step = 1, 1, np.uint64(base)
    with np.errstate(over="ignore"):
        while filled < len(out):  # out[filled + i] = out[i] * base**filled
            more = min(filled, len(out) - filled)
            out[filled : filled + more] = out[:more] * step
            step, filled = step * step, filled + more
    return out


def word_hashes(buffer: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the maximal runs of `in_word` in a byte buffer.

    The hash is a polynomial in the bytes of the word (its length included), finalized; it does not depend on where
    the word stands.
    """
    edges = np.flatnonzero(np.diff(np.concatenate(([False], in_word, [False])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return starts, ends, np.empty(0, np.uint64)
    lengths = ends - starts
    total = np.zeros(len(starts), np.uint64)
    longest = int(lengths.max())
    base = np.uint64(0x9E3779B97F4A7C55)
    if longest <= 64:  # one pass per letter position over the words that are that long
        order, left, at = None, lengths, starts
        for k in range(longest):
            alive = np.flatnonzero(left > k) if k else None
            if alive is None:
                total = buffer[starts].astype(np.uint64) + np.uint64(1)
            else:
                if len(alive) < 0.7 * len(left):
                    order = alive if order is None else order[alive]
                    left, at = left[alive], at[alive]
                    alive = slice(None)
                rows = alive if order is None else order[alive]
                total[rows] = total[rows] * base + buffer[at[alive] + k] + np.uint64(1)
    else:  # sums of byte * base**(place in word), word by word in one reduction
        cover = np.flatnonzero(in_word)
        place = cover - np.repeat(starts, lengths)
        weighted = (buffer[cover].astype(np.uint64) + np.uint64(1)) * powers(int(base), longest)[
            np.repeat(lengths, lengths) - 1 - place
        ]
        total = np.add.reduceat(weighted, np.concatenate(([0], np.cumsum(lengths)[:-1])))
    return starts, ends, mix(total)


def concatenated(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One byte buffer, each string followed by a newline, and the offsets (one more than strings)."""
    joined = b"\n".join(strings) + b"\n" if strings else b""
    offsets = np.zeros(len(strings) + 1, np.int64)
    np.cumsum([len(s) + 1 for s in strings], out=offsets[1:])
    return np.frombuffer(joined, np.uint8), offsets


def chunks(strings: list[bytes], limit: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive strings with about `limit` bytes each; a longer string comes alone."""
    first, size = 0, 0
    for i, s in enumerate(strings):
        if size and size + len(s) > limit:
            yield first, i
            first, size = i, 0
        size += len(s) + 1
    if first < len(strings):
        yield first, len(strings)


def slices(strings: list[str], limit: int = 1 << 20, most: int = 512) -> Iterator[tuple[int, int]]:
    """Ranges of at most `most` consecutive texts with about `limit` characters each; a longer text comes alone."""
    first, size = 0, 0
    for i, s in enumerate(strings):
        if i > first and (size + len(s) > limit or i - first >= most):
            yield first, i
            first, size = i, 0
        size += len(s)
    if first < len(strings):
        yield first, len(strings)


def shared_output(spark, name: str) -> str:
    """A new folder for files, below the one that the cluster shares, with the scheme that Spark itself would use."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


# Schemes of Hadoop's file systems and what pyarrow calls the same store.
STORES = {"s3a": "s3", "s3n": "s3"}


def filesystem(path: str):
    """(file system, path on it) for an address with a scheme; one without is refused, since it could be any store's."""
    from pyarrow import fs

    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        raise ValueError(f"{path} does not say on which file system it is")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{STORES.get(scheme, scheme)}:{rest}")


def share(spark, value):
    """Broadcast a value whose class workers need not be able to import. Its size must be bounded."""
    return spark.sparkContext.broadcast([cloudpickle.dumps(value)])


def held(shared):
    """The value of `share`, one object per worker, which keeps what tasks add to it."""
    box = shared.value
    if len(box) == 1:
        box[:] = [None, pickle.loads(box[0])]
    return box[1]


def release(spark) -> None:
    """Free shuffle files of finished phases: they go when the driver's JVM collects the objects that own them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
