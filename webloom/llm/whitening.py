"""Whitening of embeddings with exact bit-sliced scatter matrices.

Entries become integers (fixed point). Each dimension is shifted by its minimum, its bits are packed across rows into
64-bit words, one plane per bit, and a cross-product is a weighted sum of popcounts of ANDed planes:

    sum over rows of x * y = sum over bits a of x and b of y of 2**(a + b) * popcount(plane(x, a) & plane(y, b)).

Planes are grouped in digits of eight bits, so sums over any number of rows that a table can have fit a long; digits are
put together as integers of any size on the driver, which gets one matrix of dimension by dimension and no rows. The
matrix is centred as integers (n * M - s s'), only then divided and decomposed.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.batches import held, map_batches, share
from webloom.session import written

SCALE, ORIGIN = 64, 1_000_000  # x = floor(SCALE * c) + ORIGIN
COMPONENTS = 16
DIGIT = 8  # bits of a digit
BLOCK = 4096  # rows whose planes are packed at a time
LARGEST = 2.0**62  # entries whose fixed-point value is not below this in size count as not finite
NO_VARIANCE = 1e-28  # share of the largest eigenvalue below which an eigenvalue is rounding


class Model(NamedTuple):
    n: int  # distinct vectors
    low: np.ndarray  # smallest x per dimension
    sums: np.ndarray  # sum of x - low per dimension, integers of any size
    mean: np.ndarray  # sums / n
    axes: np.ndarray  # eigenvectors (columns), divided by the square root of their eigenvalue; 0 without variance
    explained: np.ndarray  # eigenvalue / trace; NaN where no vector differs
    varies: np.ndarray  # whether a component has variance


def fixed_point(vector: Column, scale: int = SCALE, origin: int = ORIGIN) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long") + F.lit(origin).cast("long"))


def usable(vector: Column, scale: int = SCALE) -> Column:
    """Whether a vector is neither null nor holds null, NaN, infinite or unrepresentable entries."""
    fine = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double") * scale) < LARGEST, F.lit(False)))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def vectors(batch: pa.RecordBatch, dimensions: int) -> np.ndarray:
    """The column x of a batch, rows by dimensions."""
    column = batch.column("x")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dimensions)


class Planes:
    """Which bit planes each dimension has, given the largest shifted value of each; the last plane is all ones."""

    def __init__(self, low: np.ndarray, spans: list[int]):
        self.low = low
        self.owner: list[int] = []  # dimension of a digit
        self.place: list[int] = []  # first bit of a digit
        bits: list[tuple[int, int]] = []
        first: list[int] = []
        for d, span in enumerate(spans):
            width = span.bit_length()
            for at in range(0, width, DIGIT):
                self.owner.append(d)
                self.place.append(at)
                first.append(len(bits))
                bits += [(d, b) for b in range(at, min(at + DIGIT, width))]
        first.append(len(bits))
        self.dimension = np.array([d for d, _ in bits], np.int64)
        self.bit = np.array([b for _, b in bits], np.uint64)
        self.first = np.array(first, np.int64)
        self.digit = np.append(np.repeat(np.arange(len(first) - 1), np.diff(self.first)), len(first) - 1)
        self.weight = np.append(np.int64(1) << (self.bit.astype(np.int64) % DIGIT), np.int64(1))

    def packed(self, x: np.ndarray) -> np.ndarray:
        """Planes by words of up to BLOCK rows; rows beyond the last one are zero."""
        shifted = (x - self.low).view(np.uint64)
        size = -(-len(x) // 64) * 64
        planes = np.zeros((len(self.digit), size), np.uint8)
        planes[:-1, : len(x)] = ((shifted.T[self.dimension] >> self.bit[:, None]) & np.uint64(1)).astype(np.uint8)
        planes[-1, : len(x)] = 1
        return np.packbits(planes, axis=1).view(np.uint64)

    def add(self, total: np.ndarray, x: np.ndarray) -> None:
        """Add the cross-products of digits of some rows to the upper triangle of `total` (digits by digits)."""
        words = self.packed(x)
        for plane, digit in enumerate(self.digit.tolist()):
            start = int(self.first[digit])
            common = np.bitwise_count(words[plane] & words[start:]).sum(axis=1, dtype=np.int64)
            sums = np.add.reduceat(common * self.weight[start:], self.first[digit:] - start)
            total[digit, digit:] += sums * self.weight[plane]

    def whole(self, total: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        """Number of rows, sums and cross-products of the shifted dimensions, as integers of any size."""
        size = len(self.low)
        sums, cross = np.zeros(size, object), np.zeros((size, size), object)
        last = len(self.owner)
        for i, (d, p) in enumerate(zip(self.owner, self.place)):
            sums[d] += int(total[i, last]) << p
            for j in range(i, last):
                value = int(total[i, j]) << (p + self.place[j])
                cross[d, self.owner[j]] += value
                if i != j:
                    cross[self.owner[j], d] += value
        return int(total[last, last]), sums, cross


def diagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of a nearly diagonal matrix, by Jacobi rotations.

    Off-diagonal entries go until they are small against both diagonal entries, which keeps small eigenvalues right.
    """
    a, u = a.copy(), np.eye(len(a))
    for _ in range(30):
        size = np.sqrt(np.abs(np.diag(a)))
        rough = np.argwhere(np.triu(np.abs(a), 1) > 1e-15 * np.outer(size, size) + 1e-40 * max(size.max(), 1e-300) ** 2)
        if not len(rough):
            break
        for i, j in rough.tolist():
            if not a[i, j]:
                continue
            tau = (a[j, j] - a[i, i]) / (2 * a[i, j])
            t = (1.0 if tau >= 0 else -1.0) / (abs(tau) + np.hypot(1.0, tau))
            c = 1 / np.hypot(1.0, t)
            turn = np.array([[c, t * c], [-t * c, c]])
            change, pair = t * a[i, j], [i, j]
            corner = a[i, i] - change, a[j, j] + change
            a[:, pair] = a[:, pair] @ turn
            a[pair, :] = a[:, pair].T
            a[i, i], a[j, j] = corner
            a[i, j] = a[j, i] = 0.0
            u[:, pair] = u[:, pair] @ turn
    return np.diag(a).copy(), u


def spectrum(centred: np.ndarray, divisor: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors of the integer matrix `centred` divided by `divisor`.

    eigh alone errs by about 1e-16 of the largest eigenvalue. Its vectors, as fixed-point integers, bring the exact
    matrix into nearly diagonal form, whose entries are then right relative to their own size, and rotations finish it.
    """
    rough = (centred / divisor).astype(float)
    _, u = np.linalg.eigh(rough)
    turned = fixed(u, 60)
    exact = turned.T.dot(centred).dot(turned)
    e, turn = diagonal((exact / (divisor << 120)).astype(float))
    # Small parts of a vector count where a dimension is large, so they are right relative to their own size too.
    u = (turned.dot(fixed(turn, 100)) / (1 << 160)).astype(float)
    u /= np.linalg.norm(u, axis=0)
    order = np.argsort(-e, kind="stable")
    return e[order], u[:, order]


def fixed(values: np.ndarray, bits: int) -> np.ndarray:
    """Values times 2**bits, cut to integers of any size."""
    return np.array([[int(v * 2.0**bits) for v in row] for row in values.tolist()], object)


def whitened(model: Model, x: np.ndarray) -> np.ndarray:
    return ((x - model.low).astype(float) - model.mean) @ model.axes


def deviations(model: Model, x: np.ndarray) -> list[int | None]:
    """Per row the sum over dimensions of (n * x - S)**2, exactly; None where that does not fit a long.

    Sums of longs are right modulo 2**64, so only their size has to be known, which floating point tells; rows within
    its error of the limit are added up as integers of any size.
    """
    shifted = x - model.low
    widest = max(int(shifted.max(initial=0)) * model.n, *(int(s) for s in model.sums))
    if widest < 1 << 62:
        part = shifted * np.int64(model.n) - model.sums.astype(np.int64)
        size = (part.astype(float) ** 2).sum(axis=1)
        with np.errstate(over="ignore"):
            found = (part * part).sum(axis=1).tolist()
        small, large = (size < 2.0**63 * (1 - 1e-9)).tolist(), (size > 2.0**63 * (1 + 1e-9)).tolist()
    else:
        found, small, large = ([v] * len(x) for v in (0, False, False))
    out: list[int | None] = []
    for row, value in enumerate(found):
        if not small[row]:
            parts = () if large[row] else zip(shifted[row].tolist(), model.sums)
            value = sum((model.n * v - int(s)) ** 2 for v, s in parts)
        out.append(None if large[row] or value >= 1 << 63 else value)
    return out


def prepared(table: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(id, x) of the usable vectors of the most common length (of equally common ones the longest), and that length."""
    rows = table.select(table[id_col].alias("id"), table[vector_col].alias("v")).filter(usable(F.col("v")))
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("c"))
    common = lengths.orderBy(F.desc("c"), F.desc("d")).first()
    dimensions = common["d"] if common else 0
    return rows.filter(F.size("v") == dimensions).select("id", fixed_point(F.col("v")).alias("x")), dimensions


def summed(found: DataFrame, size: int, kind: type) -> np.ndarray:
    """A matrix from the rows (i, j, value) of all tasks; its size is that of one task's matrix."""
    table = found.groupBy("i", "j").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros((size, size), kind)
    out[table["i"].to_numpy(), table["j"].to_numpy()] = table["value"].to_numpy()
    return out


def cells(total: np.ndarray) -> dict:
    i, j = np.triu_indices(len(total))
    return {"i": i, "j": j, "value": total[i, j]}


def scatter(fit: DataFrame, dimensions: int) -> tuple[np.ndarray, int, np.ndarray, np.ndarray]:
    """Smallest x per dimension, number of rows, sums and cross-products of x less the smallest, over the rows of fit."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        low = high = None
        for batch in batches:
            if len(batch):
                x = vectors(batch, dimensions)
                low = x.min(axis=0) if low is None else np.minimum(low, x.min(axis=0))
                high = x.max(axis=0) if high is None else np.maximum(high, x.max(axis=0))
        if low is not None:
            yield {"d": np.arange(dimensions), "low": low, "high": high}

    found = map_batches(fit, ends, "d long, low long, high long").groupBy("d")
    limits = found.agg(F.min("low").alias("low"), F.max("high").alias("high")).toArrow().sort_by("d")
    low = limits["low"].to_numpy()
    spans = [b - a for a, b in zip(low.tolist(), limits["high"].to_pylist())]
    shared = share(fit.sparkSession, Planes(low, spans))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        planes = held(shared)
        total = np.zeros((len(planes.first),) * 2, np.int64)
        for batch in batches:
            x = vectors(batch, dimensions)
            for at in range(0, len(x), BLOCK):
                planes.add(total, x[at : at + BLOCK])
        if total[-1, -1]:
            yield cells(total)

    planes = Planes(low, spans)
    return (low, *planes.whole(summed(map_batches(fit, count, "i long, j long, value long"), len(planes.first), np.int64)))


def fitted(fit: DataFrame, dimensions: int, components: int = COMPONENTS) -> tuple[Model, float | None]:
    """The model of the rows of fit (column x, at least one row), and the identity error of what it makes of them."""
    low, n, sums, cross = scatter(fit, dimensions)
    e, u = spectrum(n * cross - np.outer(sums, sums), n * n)
    e, u = np.maximum(e, 0.0), u[:, :components]
    trace, kept = e.sum(), e[:components]
    varies = kept > NO_VARIANCE * e.max()
    axes = np.where(varies, u / np.sqrt(np.where(varies, kept, 1.0)), 0.0)
    explained = kept / trace if trace > 0 else np.full(len(kept), np.nan)
    mean = np.array([int(s) / n for s in sums])
    model = Model(n, low, sums, mean, axes, explained, varies)
    shared, size = share(fit.sparkSession, tuple(model)), len(kept)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        learned = Model(*held(shared))
        total = np.zeros((size + 1, size + 1))
        for batch in batches:
            w = whitened(learned, vectors(batch, dimensions))
            w = np.column_stack([w, np.ones(len(w))])
            total += w.T @ w
        if total[-1, -1]:
            yield cells(total)

    total = summed(map_batches(fit, products, "i long, j long, value double"), size + 1, float) / n
    covariance = total[:-1, :-1] - np.triu(np.outer(total[:-1, -1], total[:-1, -1]))
    error = np.abs(covariance - np.eye(size))[np.ix_(varies, varies)]
    return model, float(error.max()) if error.size else None


def whiten(
    table: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """Whitened components of every usable vector.

    Returns one row per vector and component (1 to `components`, at most the dimension): id_col, component, n (distinct
    fixed-point vectors), deviation (sum over dimensions of (n * x - S)**2, null if it exceeds a long), whitened,
    explained (share of the trace), identity_error (largest entry of the whitened fit list's covariance less identity).

    Null vectors and those with null, NaN or infinite entries, or entries of 2**56 and more in size, are dropped, and so
    are those whose length is not the most common one (ties: the longest). Repeated rows and rows with a null id are
    kept, each vector counts once in the fit. A component without variance has a null `whitened`; if no two vectors
    differ, `explained` is null too. identity_error covers components with variance. An empty table gives an empty one;
    other columns are ignored. The driver gets one matrix of the dimension's size; eigenvectors have either sign.
    """
    rows, dimensions = prepared(table, id_col, vector_col)
    kind = table.schema[id_col].dataType.simpleString()
    schema = (
        f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, "
        "identity_error double"
    )
    if not dimensions:
        return table.sparkSession.createDataFrame([], schema)
    model, error = fitted(written(rows.select("x").distinct(), "whitening-fit"), dimensions, components)
    shared, size = share(table.sparkSession, tuple(model)), len(model.varies)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        learned = Model(*held(shared))
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.slice(at, BLOCK)
                x = vectors(part, dimensions)
                row = np.repeat(np.arange(len(x)), size)
                w = np.where(learned.varies, whitened(learned, x), np.nan).reshape(-1)
                yield {
                    id_col: part.column("id").take(pa.array(row)),
                    "component": np.tile(np.arange(1, size + 1, dtype=np.int32), len(x)),
                    "n": np.full(len(row), learned.n, np.int64),
                    "deviation": pa.array(deviations(learned, x), pa.int64()).take(pa.array(row)),
                    "whitened": w,
                    "explained": np.tile(learned.explained, len(x)),
                    "identity_error": pa.array([error] * len(row), pa.float64()),
                }

    return map_batches(rows, work, schema)
