"""Distances inside figures and their ridges, against all cells outside."""

from __future__ import annotations

import numpy as np
import pytest

from cryoframe.operators import distance


def slow(mask: np.ndarray) -> np.ndarray:
    """Squared distance of each cell to the nearest one outside; beyond the image all is outside."""
    wide = np.pad(mask, 1)
    off = np.argwhere(~wide) - 1
    return np.array([[((off - (r, c)) ** 2).sum(axis=1).min() for c in range(mask.shape[1])] for r in range(mask.shape[0])])


def frame(spark, masks):
    return spark.createDataFrame([(k, int(r) - 7, int(c) + 3) for k, m in masks.items() for r, c in np.argwhere(m)], "figure int, row int, col int")


@pytest.mark.parametrize("share", [0.5, 0.9, 0.995])
def test_distances_match_loops(spark, share):
    rng = np.random.default_rng(3)
    masks = {k: rng.random(shape) < share for k, shape in enumerate([(12, 15), (1, 40), (40, 1), (25, 70)])}
    got = {(r["figure"], r["row"] + 7, r["col"] - 3): r["square"] for r in distance.distances(frame(spark, masks), "figure").collect()}
    want = {(k, r, c): int(square[r, c]) for k, m in masks.items() for square in [slow(m)] for r, c in np.argwhere(m)}
    assert got == want


def test_a_square_has_its_width(spark):
    cells = frame(spark, {1: np.ones((30, 30), bool), 2: np.ones((100, 101), bool)})
    cells = cells.unionByName(cells)
    assert {r["figure"]: 2 * r["max"] for r in distance.distances(cells, "figure").groupBy("figure").agg({"far": "max"}).withColumnRenamed("max(far)", "max").collect()} == {1: 30.0, 2: 100.0}


def test_long_runs_take_the_envelope():
    rng = np.random.default_rng(5)
    for n in (49, 300):
        up = rng.integers(1, 60, n)
        height = np.concatenate([[0], up.astype(np.int64) ** 2, [0]])
        at = np.arange(n + 2)
        assert (distance.least_squares(up) == ((at[1:-1, None] - at[None, :]) ** 2 + height[None, :]).min(axis=1)).all()


def test_ridges_run_along_the_middle(spark):
    bar, cross = np.ones((5, 40), bool), np.zeros((41, 41), bool)
    cross[18:23], cross[:, 18:23] = True, True
    got: dict = {1: set(), 2: set()}
    for r in distance.ridges(distance.distances(frame(spark, {1: bar, 2: cross}), "figure"), "figure").collect():
        got[r["figure"]].add((r["row"] + 7, r["col"] - 3))
    assert {(2, c) for c in range(3, 37)} <= got[1] and not any(r != 2 for r, c in got[1] if 4 <= c < 36)
    assert {(20, c) for c in range(3, 38)} <= got[2] and {(r, 20) for r in range(3, 38)} <= got[2]
    assert distance.ridges(distance.distances(frame(spark, {1: bar}).limit(0), "figure"), "figure").collect() == []
