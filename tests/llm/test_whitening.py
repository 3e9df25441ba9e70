"""Bit-sliced scatter and whitening against integers of any size."""

from __future__ import annotations

import math

import numpy as np
import pytest

from webloom.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, x string, id string, n string"


def exact(vectors: list[list[float]]) -> tuple[int, np.ndarray, np.ndarray, list[tuple[int, ...]]]:
    """n, sums and centred products (times n * n) over the distinct fixed-point vectors, and all vectors' points."""
    points = [tuple(math.floor(64 * c) + 1_000_000 for c in v) for v in vectors]
    fit = np.array(sorted(set(points)), object)
    sums = fit.sum(axis=0)
    return len(fit), sums, len(fit) * fit.T.dot(fit) - np.outer(sums, sums), points


def check(spark, usable: list[tuple], others: list[tuple], dimensions: int) -> list:
    rows = [(i, v, "x", "y", "z") for i, v in [*usable, *others]]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    n, sums, centred, points = exact([v for _, v in usable])
    size = min(16, dimensions)
    assert len(got) == len(usable) * size and {r["n"] for r in got} == {n}
    want = {i: sum((n * c - s) ** 2 for c, s in zip(p, sums)) for (i, _), p in zip(usable, points)}
    assert all(r["deviation"] == (want[r["vec_id"]] if want[r["vec_id"]] < 2**63 else None) for r in got)
    assert got[0]["identity_error"] < 1e-8
    # Whitened values over the fit list have unit covariance, and their squares add up to the explained share.
    at = dict(zip((i for i, _ in usable), points))
    one = {at[r["vec_id"]]: [None] * size for r in got}
    for r in got:
        one[at[r["vec_id"]]][r["component"] - 1] = r["whitened"]
    w = np.array(list(one.values()))
    assert np.abs(w.T @ w / n - np.eye(size)).max() < 1e-7 and np.abs(w.mean(axis=0)).max() < 1e-7
    trace = sum(centred[d, d] for d in range(dimensions))
    explained = {r["component"]: r["explained"] for r in got}
    assert sorted(explained.values(), reverse=True) == [explained[c] for c in range(1, size + 1)]
    if dimensions <= 16:
        assert sum(explained.values()) == pytest.approx(1)
    # Eigenvectors: V times the axis is the eigenvalue times the axis; V w-sums recover it without knowing the axis.
    x = np.array([[float(c - s / n) for c, s in zip(p, sums)] for p in one], float)
    axes = x.T @ w / n  # V u / sqrt(e) = sqrt(e) u
    for c in range(size):
        e = explained[c + 1] * float(trace) / n**2
        assert float(axes[:, c] @ axes[:, c]) == pytest.approx(e, rel=1e-6)
    return got


def test_ordinary_vectors(spark):
    r = np.random.default_rng(1)
    usable = [(i, [float(v) for v in r.normal(size=20) * np.linspace(0.2, 3, 20)]) for i in range(300)]
    usable += [(1000 + i, usable[3][1]) for i in range(200)] + [(3, usable[3][1])]
    others = [(1, None), (2, [None] * 20), (3, [math.nan] * 20), (4, [math.inf] + [0.0] * 19), (5, [1.0]), (6, []),
              (7, [2.0**57] + [0.0] * 19)]
    check(spark, usable, others, 20)


def test_one_dimension_outweighs_the_others(spark):
    """Small eigenvalues are right although eigh alone would lose them."""
    r = np.random.default_rng(2)
    usable = [(i, [float(v) for v in r.normal(size=6) * [1e9, 1, 1, 1, 2, 0.5]]) for i in range(200)]
    got = check(spark, usable, [], 6)
    assert any(row["deviation"] is None for row in got)


def test_few_dimensions_and_null_ids(spark):
    rows = [(None, [0.0, 1.0], "x", "y", "z"), (5, [1.0, 3.0], "x", "y", "z"), (5, [1.0, 3.0], "x", "y", "z")]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 6 and {r["n"] for r in got} == {2}
    assert {r["component"]: r["whitened"] is None for r in got} == {1: False, 2: True}
    assert sorted(abs(r["whitened"]) for r in got if r["component"] == 1) == pytest.approx([1, 1, 1])


def test_equal_vectors_and_empty_tables(spark):
    got = whitening.whiten(spark.createDataFrame([(i, [0.5, 2.0], "x", "y", "z") for i in range(3)], SCHEMA)).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got] == [
        (1, 0, None, None, None)
    ] * 6
    none = spark.createDataFrame([], SCHEMA)
    assert whitening.whiten(none).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None, "x", "y", "z")], SCHEMA)).count() == 0


@pytest.mark.parametrize("spread", [0, 1, 100, 70_000, 2**61])
def test_planes_give_exact_products(spread):
    r = np.random.default_rng(3)
    x = r.integers(-spread - 1, spread + 1, (700, 5))
    low = x.min(axis=0)
    planes = whitening.Planes(low, [int(b) - int(a) for a, b in zip(low, x.max(axis=0))])
    total = np.zeros((len(planes.first),) * 2, np.int64)
    for at in range(0, len(x), 333):
        planes.add(total, x[at : at + 333])
    n, sums, cross = planes.whole(total)
    y = x.astype(object) - low.astype(object)
    assert n == len(x) and (sums == y.sum(axis=0)).all() and (cross == y.T.dot(y)).all()
