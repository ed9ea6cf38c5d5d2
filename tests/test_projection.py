"""Projections there and back, and warps against single cells."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cryoframe.operators import projection as proj


def test_round_trip(spark):
    rows = [(float(lon), float(lat)) for lon in range(-180, 180, 7) for lat in (40, 55, 60.5, 70, 80, 89.9, 89.9999)] + [(-45.0, 90.0)]
    df = spark.createDataFrame(rows, "lon double, lat double")
    x, y = proj.polar_stereographic(F.col("lon"), F.col("lat"))
    lon, lat = proj.polar_geographic(F.col("x"), F.col("y"))
    for r in df.withColumns({"x": x, "y": y}).withColumns({"lon1": lon, "lat1": lat}).collect():
        assert abs(r["lat"] - r["lat1"]) < 1e-9
        assert r["lat"] == 90.0 or abs(r["lon"] - r["lon1"]) * math.cos(math.radians(r["lat"])) < 1e-9
    at = {(r["lon"], r["lat"]): (r["x"], r["y"]) for r in df.withColumns({"x": x, "y": y}).collect()}
    assert math.hypot(*at[-180.0, 70.0]) == pytest.approx(2187000, rel=2e-2)


def test_warps(spark):
    """Between two lattices that are turned by a quarter and moved: each cell by its own four neighbours."""
    rng = np.random.default_rng(1)
    image = rng.random((9, 13))
    source = spark.createDataFrame([(r, c, None if (r, c) == (4, 4) else float(image[r, c])) for r in range(9) for c in range(13) if (r, c) != (2, 7)], "row int, col int, v double")
    at, to = proj.Lattice(10.0, 50.0, 2.0, -1.0), proj.Lattice(-7.0, 3.0, 0.7, 0.9)
    inverse = lambda x, y: (y * 3.0 + 5.0, 47.0 - x)
    cells = proj.lattice_cells(spark, 14, 16)
    for method in ("nearest", "bilinear"):
        got = {(r["row"], r["col"]): r["v"] for r in proj.warped(source, at, cells, to, inverse, "v", method).collect()}
        assert len(got) == 14 * 16
        value = lambda r, c: None if not (0 <= r < 9 and 0 <= c < 13) or (r, c) in ((4, 4), (2, 7)) else float(image[r, c])
        for (r, c), v in got.items():
            sx, sy = inverse(-7.0 + (c + 0.5) * 0.7, 3.0 + (r + 0.5) * 0.9)
            row, col = (sy - 50.0) / -1.0, (sx - 10.0) / 2.0
            if method == "nearest":
                assert v == value(math.floor(row), math.floor(col))
                continue
            r0, c0 = math.floor(row - 0.5), math.floor(col - 0.5)
            parts = [((1 - abs(row - 0.5 - r0 - i)) * (1 - abs(col - 0.5 - c0 - j)), value(r0 + i, c0 + j)) for i in (0, 1) for j in (0, 1)]
            total = sum(w for w, x in parts if x is not None)
            assert (v is None and total == 0) or v == pytest.approx(sum(w * x for w, x in parts if x is not None) / total)
    with pytest.raises(ValueError):
        proj.warped(source, at, cells, to, inverse, "v", "cubic")
