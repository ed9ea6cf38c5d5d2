"""Tiled whitening against whole-matrix algebra, and its defined cases."""

from __future__ import annotations

import numpy as np
import pytest

from cryoframe.llm.whitening import Centre, centre_of, tiled_covariance, whitened, whole_vectors

DDL = "vec_id long, embedding array<double>"


def expected(vectors: np.ndarray, k: int):
    """Exact n and deviations, and whitened coordinates by one decomposition of the whole matrix."""
    x = np.floor(256 * vectors).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    centred = fit - total / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, total)) for row in x]
    return n, deviation, (x - total / n) @ axes[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def frame(spark, vectors):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(vectors)], DDL)


@pytest.mark.parametrize("dims,width,offset", [(9, 4, 0.0), (5, 32, 0.0), (7, 3, 1e9)])
def test_equals_whole_matrix(spark, dims, width, offset):
    rng = np.random.default_rng(dims)
    vectors = rng.normal(size=(300, dims)) * np.arange(1, dims + 1) ** 1.5 + offset
    vectors[200:] = vectors[7]  # a third of the rows is one vector
    got = whitened(frame(spark, vectors).repartition(5), width=width, rows=16).collect()
    n, deviation, coordinates, explained = expected(vectors, 4)
    assert len(got) == 4 * len(vectors) and {r["n"] for r in got} == {n}
    signs = {}
    for r in sorted(got, key=lambda r: r["vec_id"]):
        want = coordinates[r["vec_id"], r["component"] - 1]
        sign = signs.setdefault(r["component"], 1 if (want > 0) == (r["whitened"] > 0) else -1)
        assert r["whitened"] * sign == pytest.approx(want, rel=1e-5, abs=1e-6)
        assert r["deviation"] == deviation[r["vec_id"]] and r["explained"] == pytest.approx(explained[r["component"] - 1], rel=1e-7)
    assert max(r["identity_error"] for r in got) < 1e-9


def test_tiles_equal_the_covariance(spark):
    rng = np.random.default_rng(3)
    vectors = rng.integers(-40000, 70, size=(500, 11)) / 256
    fit = whole_vectors(frame(spark, vectors)).select("dims", "x").distinct().repartition(7)
    x = np.unique(np.floor(256 * vectors).astype(np.int64), axis=0)
    centre = centre_of(fit, 11)
    assert (centre.n, list(centre.sums)) == (len(x), x.sum(axis=0).tolist())
    for width, rows in ((1, 3), (4, 50), (11, 512)):
        np.testing.assert_allclose(tiled_covariance(fit, 11, centre, width, rows), np.cov(x.T, bias=True), rtol=1e-12, atol=1e-6)


def test_defined_cases(spark):
    rows = [
        (1, [1.0, 2.0, 0.0]), (1, [1.0, 2.0, 0.0]), (None, [0.5, 1.0, 3.0]), (2, [0.0, 0.0, 0.0]), (3, None), (4, []), (5, [1.0, None, 2.0]),
        (6, [float("nan"), 0.0, 0.0]), (7, [float("inf"), 0.0, 0.0]), (8, [1.0, 2.0]), (9, [1e300, 0.0, 0.0]), (10, [-0.001, 1.0, 1.0]),
    ]
    df = spark.createDataFrame(rows, DDL).selectExpr("*", "vec_id as n", "'a' as x", "1 as dims")
    got = whitened(df).collect()
    assert sorted({r["vec_id"] for r in got}, key=str) == sorted([1, None, 2, 10], key=str)
    assert len(got) == 5 * 3 and {r["n"] for r in got} == {4}
    # four different vectors in three dimensions: all components vary
    assert all(r["whitened"] is not None for r in got)
    one = whitened(df.where("vec_id = 1")).collect()
    assert len(one) == 6 and all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 for r in one)
    line = whitened(spark.createDataFrame([(i, [float(i), 0.0]) for i in range(4)], DDL)).collect()
    assert sorted({(r["component"], r["whitened"] is None, r["explained"]) for r in line}) == [(1, False, 1.0), (2, True, 0.0)]
    assert whitened(df.limit(0)).collect() == [] and whitened(df.where("vec_id in (3, 4, 5, 6)")).collect() == []


def test_deviation_beyond_a_long_is_null():
    centre = Centre(3, (3 * (1 << 40) + 1, 0))
    x = np.array([[1 << 40, 5], [-(1 << 40), 5], [(1 << 40) + (1 << 29), 0]], np.int64)
    exact = [sum((3 * int(v) - s) ** 2 for v, s in zip(row, centre.sums)) for row in x]
    assert centre.deviations(x) == [d if d < 1 << 63 else None for d in exact]
