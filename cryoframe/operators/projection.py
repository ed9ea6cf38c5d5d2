"""Map projection of points, polygons and rasters: polar stereographic both ways, and warps by inverse mapping."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: WGS 84: half axis in metres and eccentricity.
A, E = 6378137.0, 0.08181919084262149
Mapping = Callable[[Column, Column], tuple[Column, Column]]


def _scale(true_scale: float) -> float:
    f = np.radians(true_scale)
    t_c = np.tan(np.pi / 4 - f / 2) / ((1 - E * np.sin(f)) / (1 + E * np.sin(f))) ** (E / 2)
    return float(A * np.cos(f) / np.sqrt(1 - (E * np.sin(f)) ** 2) / t_c)


def polar_stereographic(lon: Column, lat: Column, central: float = -45.0, true_scale: float = 70.0) -> tuple[Column, Column]:
    """WGS 84 longitude and latitude to north polar stereographic metres (EPSG 3413 by default), in closed form."""
    phi = F.radians(lat)
    t = F.tan(F.lit(float(np.pi / 4)) - phi / 2) / F.pow((1 - E * F.sin(phi)) / (1 + E * F.sin(phi)), F.lit(E / 2))
    rho = t * _scale(true_scale)
    turn = F.radians(lon - central)
    return rho * F.sin(turn), -rho * F.cos(turn)


#: Latitude less conformal latitude as a series in sines of 2, 4, 6 and 8 times the latter.
SERIES = (
    E**2 / 2 + 5 * E**4 / 24 + E**6 / 12 + 13 * E**8 / 360, 7 * E**4 / 48 + 29 * E**6 / 240 + 811 * E**8 / 11520, 7 * E**6 / 120 + 81 * E**8 / 1120, 4279 * E**8 / 161280,
)


def polar_geographic(x: Column, y: Column, central: float = -45.0, true_scale: float = 70.0) -> tuple[Column, Column]:
    """North polar stereographic metres to longitude, from -180 to below 180, and latitude; the pole has the central longitude."""
    rho = F.sqrt(x * x + y * y)
    chi = F.lit(float(np.pi / 2)) - 2 * F.atan(rho / _scale(true_scale))
    lat = chi
    for k, c in enumerate(SERIES, 1):
        lat = lat + F.lit(float(c)) * F.sin(chi * (2 * k))
    lon = F.degrees(F.when(rho == 0, F.lit(0.0)).otherwise(F.atan2(x, -y))) + central
    return lon - 360.0 * F.floor((lon + 180.0) / 360.0), F.degrees(lat)


def reprojected(polygons: DataFrame, mapping: Mapping, parts: str = "parts") -> DataFrame:
    """Polygons with every point mapped; sides stay straight between mapped points."""

    def point(p: Column) -> Column:
        x, y = mapping(p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    return polygons.withColumn(parts, F.transform(parts, lambda ring: F.transform(ring, point)))


@dataclass(frozen=True)
class Lattice:
    """Where a raster lies: its outer corner (x, y), and the steps from column to column and from row to row, which may be negative."""

    x: float
    y: float
    dx: float
    dy: float

    def centre(self, row: Column, col: Column) -> tuple[Column, Column]:
        return self.x + (col + 0.5) * self.dx, self.y + (row + 0.5) * self.dy

    def place(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Row and column as broken numbers, whole at outer corners."""
        return (y - self.y) / self.dy, (x - self.x) / self.dx


def lattice_cells(spark: SparkSession, rows: int, columns: int) -> DataFrame:
    """All cells (row, col) of a raster of that size; none is made on the driver."""
    return spark.range(rows * columns).select(F.expr(f"id div {columns}").alias("row"), (F.col("id") % columns).alias("col"))


def cells_seen(source: DataFrame, at: Lattice, to: Lattice, forward: Mapping, margin: int = 1) -> DataFrame:
    """Cells (row, col) of the other lattice that hold the centre of a source cell, and those up to ``margin`` around."""
    row, col = to.place(*forward(*at.centre(F.col("row"), F.col("col"))))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-margin, margin + 1) for j in range(-margin, margin + 1)]))
    held = source.select(F.floor(row).alias("_r"), F.floor(col).alias("_c")).distinct().withColumn("o", around)
    return held.select((F.col("_r") + F.col("o.i")).alias("row"), (F.col("_c") + F.col("o.j")).alias("col")).distinct()


def warped(source: DataFrame, at: Lattice, cells: DataFrame, to: Lattice, inverse: Mapping, v: str = "v", method: str = "bilinear") -> DataFrame:
    """``row, col, v``: the source raster (``row, col, v``) resampled at the centres of ``cells`` of another lattice.

    ``inverse`` maps the other lattice's coordinates to the source's.  ``nearest`` takes the source cell that holds the
    mapped centre.  ``bilinear`` weighs the four source cells whose centres lie around it, those that are missing or null left out
    and the other weights raised to make one.  Cells without any value get null.  Cells meet source cells by one equi-join on the lattice.
    """
    row, col = at.place(*inverse(*to.centre(F.col("row"), F.col("col"))))
    mapped = cells.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col")).withColumns({"_y": row, "_x": col})
    if method == "nearest":
        asked = mapped.select("row", "col", F.floor("_y").alias("_r"), F.floor("_x").alias("_c"), F.lit(1.0).alias("_w"))
    elif method == "bilinear":
        base = mapped.withColumns({"_r0": F.floor(F.col("_y") - 0.5), "_c0": F.floor(F.col("_x") - 0.5)})
        base = base.withColumns({"_fy": F.col("_y") - 0.5 - F.col("_r0"), "_fx": F.col("_x") - 0.5 - F.col("_c0")})
        weight = lambda i, j: (F.col("_fy") if i else 1 - F.col("_fy")) * (F.col("_fx") if j else 1 - F.col("_fx"))
        four = F.explode(F.array(*[F.struct((F.col("_r0") + i).alias("r"), (F.col("_c0") + j).alias("c"), weight(i, j).alias("w")) for i in (0, 1) for j in (0, 1)]))
        asked = base.select("row", "col", four.alias("o")).select("row", "col", F.col("o.r").alias("_r"), F.col("o.c").alias("_c"), F.col("o.w").alias("_w"))
    else:
        raise ValueError(f"no method {method!r}")
    values = source.select(F.col("row").cast("long").alias("_r"), F.col("col").cast("long").alias("_c"), F.col(v).alias("_v"))
    met = asked.join(values, ["_r", "_c"], "left")
    known = F.when(F.col("_v").isNotNull(), F.col("_w"))
    return met.groupBy("row", "col").agg((F.sum(known * F.col("_v")) / F.nullif(F.sum(known), F.lit(0.0))).alias(v))
