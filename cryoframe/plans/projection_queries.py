"""Queries of map projection: points there and back, polygons, and warped rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import polygons as poly, projection as proj
from .base import LATTICE, PLOTS, lattice, plots, query, t

_E = proj.E
_LON, _LAT = "CAST(c_custkey * 7 % 360 - 180 AS DOUBLE)", "CAST(60 + c_custkey % 28 AS DOUBLE)"
_SCALE = f"(6378137.0::DOUBLE * (cos(radians(70)) / sqrt(1 - pow({_E}::DOUBLE * sin(radians(70)), 2))) / (tan(pi() / 4 - radians(70) / 2) / pow((1 - {_E}::DOUBLE * sin(radians(70))) / (1 + {_E}::DOUBLE * sin(radians(70))), {_E / 2!r}::DOUBLE)))"
_RHO = lambda lat: f"(tan(pi() / 4 - radians({lat}) / 2) / pow((1 - {_E}::DOUBLE * sin(radians({lat}))) / (1 + {_E}::DOUBLE * sin(radians({lat}))), {_E / 2!r}::DOUBLE) * {_SCALE})"
_X = lambda lon, lat: f"({_RHO(lat)} * sin(radians({lon} + 45)))"
_Y = lambda lon, lat: f"(-{_RHO(lat)} * cos(radians({lon} + 45)))"
_CHI = lambda x, y: f"(pi() / 2 - 2 * atan(sqrt({x} * {x} + {y} * {y}) / {_SCALE}))"
_BACK_LAT = lambda x, y: f"degrees({_CHI(x, y)} + {' + '.join(f'{c!r}::DOUBLE * sin({2 * k} * {_CHI(x, y)})' for k, c in enumerate(proj.SERIES, 1))})"
_BACK_LON = lambda x, y: f"(degrees(atan2({x}, -{y})) - 45 - 360 * floor((degrees(atan2({x}, -{y})) + 135) / 360))"


def _places(spark, d):
    k = F.col("c_custkey")
    return t(spark, d, "customer").select("c_custkey", (k * 7 % 360 - 180).cast("double").alias("lon"), (60 + k % 28).cast("double").alias("lat"))


@query("m24_polar_projection", f"SELECT c_custkey, round({_X(_LON, _LAT)}, 3) AS x, round({_Y(_LON, _LAT)}, 3) AS y FROM customer")
def _(spark, d):
    x, y = proj.polar_stereographic(F.col("lon"), F.col("lat"))
    return _places(spark, d).select("c_custkey", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query("m24_inverse_projection", f"""
    WITH p AS (SELECT c_custkey, CAST(c_custkey * 37 % 4001 - 2000 AS DOUBLE) * 1000 AS x, CAST(c_custkey * 91 % 3989 - 1990 AS DOUBLE) * 1000 + 0.5::DOUBLE AS y FROM customer)
    SELECT c_custkey, round({_BACK_LON('x', 'y')}, 8) AS lon, round({_BACK_LAT('x', 'y')}, 8) AS lat FROM p""")
def _(spark, d):
    k = F.col("c_custkey")
    p = t(spark, d, "customer").select("c_custkey", ((k * 37 % 4001 - 2000).cast("double") * 1000).alias("x"), ((k * 91 % 3989 - 1990).cast("double") * 1000 + 0.5).alias("y"))
    lon, lat = proj.polar_geographic(F.col("x"), F.col("y"))
    return p.select("c_custkey", F.round(lon, 8).alias("lon"), F.round(lat, 8).alias("lat"))


@query("m24_polygon_reprojection", f"""
    WITH {PLOTS}, q AS (SELECT zone, ring, {_X('(x0 / 50 - 60)', '(70 + y0 / 100)')} AS x0, {_Y('(x0 / 50 - 60)', '(70 + y0 / 100)')} AS y0, {_X('(x1 / 50 - 60)', '(70 + y1 / 100)')} AS x1, {_Y('(x1 / 50 - 60)', '(70 + y1 / 100)')} AS y1 FROM e)
    SELECT zone, round(abs(sum(x0 * y1 - x1 * y0)) / 2 / 1e6, 2) AS square_km, round(min(x0), 3) AS minx, round(max(y0), 3) AS maxy FROM q GROUP BY zone""")
def _(spark, d):
    mapped = proj.reprojected(plots(spark, d).select("zone", "parts"), lambda x, y: proj.polar_stereographic(x / 50 - 60, 70 + y / 100))
    bounds = poly.with_bounds(mapped)
    return bounds.select("zone", F.round(poly.area("parts") / 1e6, 2).alias("square_km"), F.round("minx", 3).alias("minx"), F.round("maxy", 3).alias("maxy"))


#: The lattice in degrees, a step of rows southwards; cells of four kilometres in metres.
_DEGREES, _METRES = proj.Lattice(-50.0, 84.0, 0.4, -0.02), proj.Lattice(-1_000_000.0, 0.0, 4000.0, -4000.0)
_WARP = f"""{LATTICE}, src AS (SELECT CAST(row AS BIGINT) AS r, CAST(col AS BIGINT) AS c, z, -50.0::DOUBLE + (col + 0.5::DOUBLE) * 0.4::DOUBLE AS lon, 84.0::DOUBLE - (row + 0.5::DOUBLE) * 0.02::DOUBLE AS lat FROM lattice),
    seen AS (SELECT DISTINCT CAST(floor(-{_Y('lon', 'lat')} / 4000) AS BIGINT) AS row, CAST(floor(({_X('lon', 'lat')} + 1000000) / 4000) AS BIGINT) AS col FROM src),
    target AS (SELECT DISTINCT row + i AS row, col + j AS col FROM seen, (SELECT unnest([-1, 0, 1]) AS i) a, (SELECT unnest([-1, 0, 1]) AS j) b),
    centre AS (SELECT row, col, -1000000.0::DOUBLE + (col + 0.5::DOUBLE) * 4000 AS x, -(row + 0.5::DOUBLE) * 4000 AS y FROM target),
    back AS (SELECT row, col, ({_BACK_LAT('x', 'y')} - 84) / -0.02::DOUBLE AS sy, ({_BACK_LON('x', 'y')} + 50) / 0.4::DOUBLE AS sx FROM centre)"""


def _warp(spark, d, method):
    source = lattice(spark, d)
    cells = proj.cells_seen(source, _DEGREES, _METRES, proj.polar_stereographic)
    return proj.warped(source, _DEGREES, cells, _METRES, proj.polar_geographic, "z", method).withColumn("z", F.round("z", 6))


@query("m24_warp_nearest", f"WITH {_WARP} SELECT row, col, round(z, 6) AS z FROM back LEFT JOIN src ON src.r = floor(sy) AND src.c = floor(sx)")
def _(spark, d):
    return _warp(spark, d, "nearest")


@query("m24_warp_bilinear", f"""
    WITH {_WARP}, base AS (SELECT *, CAST(floor(sy - 0.5::DOUBLE) AS BIGINT) AS r0, CAST(floor(sx - 0.5::DOUBLE) AS BIGINT) AS c0 FROM back),
    four AS (SELECT row, col, r0 + i AS r, c0 + j AS c, (CASE i WHEN 1 THEN sy - 0.5::DOUBLE - r0 ELSE 1 - (sy - 0.5::DOUBLE - r0) END) * (CASE j WHEN 1 THEN sx - 0.5::DOUBLE - c0 ELSE 1 - (sx - 0.5::DOUBLE - c0) END) AS w
        FROM base, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) k(i, j))
    SELECT row, col, round(sum(w * z) / nullif(sum(w) FILTER (WHERE z IS NOT NULL), 0), 6) AS z FROM four LEFT JOIN src USING (r, c) GROUP BY row, col""")
def _(spark, d):
    return _warp(spark, d, "bilinear")
