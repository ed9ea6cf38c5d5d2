"""Registration of queries over the driver's tables, and the views that stand for rasters and catalogues."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, folder) as a query, with the SQL that gives the same rows."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return put


def t(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def obs(spark: SparkSession, folder: str) -> DataFrame:
    """One elevation per pixel and date: of several events the first; errors are nodata."""
    first = t(spark, folder, "events").groupBy("user_id", F.to_date("ts").alias("d")).agg(
        F.min_by(F.struct("event_type", "value", "event_id"), "event_id").alias("e")
    )
    return first.select(
        F.col("user_id").alias("pixel"), F.expr("cast(user_id div 10 as int)").alias("row"), (F.col("user_id") % 10).cast("int").alias("col"),
        "d", F.when(F.col("e.event_type") != "error", F.col("e.value")).alias("z"), F.col("e.event_type").alias("flag"), F.col("e.event_id").alias("event_id"),
    )


OBS = """obs AS (
    SELECT user_id AS pixel, CAST(user_id // 10 AS INTEGER) AS row, CAST(user_id % 10 AS INTEGER) AS col, CAST(ts AS DATE) AS d,
           CASE WHEN arg_min(event_type, event_id) <> 'error' THEN arg_min(value, event_id) END AS z,
           arg_min(event_type, event_id) AS flag, min(event_id) AS event_id
    FROM events GROUP BY user_id, CAST(ts AS DATE))"""


def lattice(spark: SparkSession, folder: str) -> DataFrame:
    """Ten columns wide: the newest valid elevation of each pixel, null where there is none."""
    o = obs(spark, folder)
    return o.groupBy("pixel", "row", "col").agg(F.expr("max_by(z, d) filter (where z is not null)").alias("z"))


LATTICE = OBS + """, lattice AS (
    SELECT pixel, row, col, arg_max(z, d) FILTER (WHERE z IS NOT NULL) AS z FROM obs GROUP BY pixel, row, col)"""


def img(spark: SparkSession, folder: str) -> DataFrame:
    """Image pixels: image, band, v."""
    return t(spark, folder, "events").select(F.col("user_id").alias("image"), F.col("event_type").alias("band"), F.col("value").alias("v"), "event_id")


def age_hours(ts: str, now: str) -> Column:
    """Hours from ``ts`` to ``now`` in whole seconds of the clock, fractions of ``ts`` cut off, as other engines count them."""
    return F.timestamp_diff("SECOND", F.date_trunc("second", ts), F.lit(now).cast("timestamp")) / 3600.0


IMG = "img AS (SELECT user_id AS image, event_type AS band, value AS v, event_id FROM events)"


def zones(spark: SparkSession, folder: str) -> DataFrame:
    """Square zones from suppliers: centres spread over a 1000 by 1000 plane, sides 20 to 60."""
    k = F.col("s_suppkey")
    x, y, half = (k * 37 % 1000).cast("double"), (k * 91 % 1000).cast("double"), (k % 3 + 1).cast("double") * 10
    return t(spark, folder, "supplier").select(
        k.alias("zone"), (x - half).alias("minx"), (y - half).alias("miny"), (x + half).alias("maxx"), (y + half).alias("maxy")
    )


ZONES = """zones AS (
    SELECT s_suppkey AS zone, CAST(s_suppkey * 37 % 1000 AS DOUBLE) - (s_suppkey % 3 + 1) * 10.0::DOUBLE AS minx,
           CAST(s_suppkey * 91 % 1000 AS DOUBLE) - (s_suppkey % 3 + 1) * 10.0::DOUBLE AS miny,
           CAST(s_suppkey * 37 % 1000 AS DOUBLE) + (s_suppkey % 3 + 1) * 10.0::DOUBLE AS maxx,
           CAST(s_suppkey * 91 % 1000 AS DOUBLE) + (s_suppkey % 3 + 1) * 10.0::DOUBLE AS maxy FROM supplier)"""


#: Directions of the eight corners of a plot, against the clock.
_COMPASS = [(1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)]
#: A square hole in every fourth plot, with the clock, and a triangle beside every fifth.
_HOLE, _BESIDE = [(-12, -12), (-12, 12), (12, 12), (12, -12), (-12, -12)], [(100, 0), (120, 0), (100, 18), (100, 0)]


def plots(spark: SparkSession, folder: str) -> DataFrame:
    """Polygons from suppliers, ``zone, parts`` and bounds: eight corners at whole numbers, some with a hole or a second part."""
    from ..operators.polygons import with_bounds

    k = F.col("s_suppkey")
    point = lambda dx, dy, r=1: F.struct((k * 37 % 1000 + dx * r).cast("double").alias("x"), (k * 91 % 1000 + dy * r).cast("double").alias("y"))
    outer = F.array(*[point(*_COMPASS[i % 8], 30 + (k * 7 + i % 8 * 5) % 61) for i in range(9)])
    hole, beside = (F.array(F.array(*[point(*c) for c in ring])) for ring in (_HOLE, _BESIDE))
    none = F.filter(F.array(outer), lambda g: F.lit(False))
    parts = F.concat(F.array(outer), F.when(k % 4 == 0, hole).otherwise(none), F.when(k % 5 == 1, beside).otherwise(none))
    return with_bounds(t(spark, folder, "supplier").select(k.alias("zone"), parts.alias("parts")))


def _corners(points: list[tuple[int, int]]) -> str:
    return ", ".join(f"({i}, {x}, {y})" for i, (x, y) in enumerate(points))


_PLOT_RING = "SELECT s_suppkey AS zone, {n} AS ring, i, CAST(s_suppkey * 37 % 1000 + dx * {r} AS DOUBLE) AS x, CAST(s_suppkey * 91 % 1000 + dy * {r} AS DOUBLE) AS y FROM supplier, (VALUES {v}) c(i, dx, dy) WHERE {w}"
#: ``e``: the edges of all rings; ``plots``: the bounds; ``SIDES`` after these: what decides whether a point lies inside.
PLOTS = (
    "pv AS (" + _PLOT_RING.format(n=0, r="(30 + (s_suppkey * 7 + i % 8 * 5) % 61)", v=_corners([*_COMPASS, _COMPASS[0]]), w="true")
    + " UNION ALL " + _PLOT_RING.format(n=1, r=1, v=_corners(_HOLE), w="s_suppkey % 4 = 0") + " UNION ALL " + _PLOT_RING.format(n=2, r=1, v=_corners(_BESIDE), w="s_suppkey % 5 = 1")
    + """), e AS (SELECT * FROM (SELECT zone, ring, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM pv WINDOW w AS (PARTITION BY zone, ring ORDER BY i)) WHERE x1 IS NOT NULL),
    plots AS (SELECT zone, min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy FROM pv GROUP BY zone)"""
)


def held(x: str, y: str, border: bool = True) -> str:
    """SQL over edges ``e`` of one zone: whether the point lies inside, or on the border."""
    crossed = f"(e.y0 > {y}) <> (e.y1 > {y}) AND {x} < (e.x1 - e.x0) * ({y} - e.y0) / (e.y1 - e.y0) + e.x0"
    on = f"(e.x1 - e.x0) * ({y} - e.y0) = (e.y1 - e.y0) * ({x} - e.x0) AND {x} BETWEEN least(e.x0, e.x1) AND greatest(e.x0, e.x1) AND {y} BETWEEN least(e.y0, e.y1) AND greatest(e.y0, e.y1)"
    inside = f"count(*) FILTER (WHERE {crossed}) % 2 = 1"
    return f"({inside} OR count(*) FILTER (WHERE {on}) > 0)" if border else f"({inside} AND count(*) FILTER (WHERE {on}) = 0)"


def objects(spark: SparkSession, folder: str) -> DataFrame:
    """Small boxes from customers on the same plane."""
    k = F.col("c_custkey")
    x, y = (k * 53 % 997).cast("double"), (k * 29 % 991).cast("double")
    return t(spark, folder, "customer").select(
        k.alias("object"), x.alias("minx"), y.alias("miny"), (x + (k % 5 + 1).cast("double")).alias("maxx"), (y + (k % 4 + 1).cast("double")).alias("maxy"), F.col("c_acctbal").alias("v")
    )


OBJECTS = """objects AS (
    SELECT c_custkey AS object, CAST(c_custkey * 53 % 997 AS DOUBLE) AS minx, CAST(c_custkey * 29 % 991 AS DOUBLE) AS miny,
           CAST(c_custkey * 53 % 997 + c_custkey % 5 + 1 AS DOUBLE) AS maxx, CAST(c_custkey * 29 % 991 + c_custkey % 4 + 1 AS DOUBLE) AS maxy,
           c_acctbal AS v FROM customer)"""


def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """Scenes from orders: cloud percentage, asset class, acquisition time, footprint cell."""
    return t(spark, folder, "orders").select(
        F.col("o_orderkey").alias("scene"), F.col("o_custkey").alias("area"), F.col("o_orderdate").alias("acquired"),
        (F.floor("o_totalprice") % 101).cast("int").alias("cloud"), F.substring("o_orderpriority", 1, 1).cast("int").alias("asset"), F.col("o_orderstatus").alias("status"),
    )


CATALOGUE = """catalogue AS (
    SELECT o_orderkey AS scene, o_custkey AS area, o_orderdate AS acquired, CAST(CAST(floor(o_totalprice) AS BIGINT) % 101 AS INTEGER) AS cloud,
           CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS asset, o_orderstatus AS status FROM orders)"""


def names(spark: SparkSession, folder: str) -> DataFrame:
    """File names built from line items: date, strip pair and grid in the path."""
    return t(spark, folder, "lineitem").select(
        F.format_string("ext%02d/grid%d/%s_SETSM_%d_%d_dem.tif", (F.col("l_suppkey") % 7).cast("int"), F.col("l_suppkey"), F.date_format("l_shipdate", "yyyyMMdd"), F.col("l_suppkey"), F.col("l_partkey")).alias("path"),
        F.col("l_orderkey").alias("id"), F.col("l_extendedprice").alias("bytes"), F.col("l_linenumber").alias("line"),
    )


NAMES = """names AS (
    SELECT printf('ext%02d/grid%d/%s_SETSM_%d_%d_dem.tif', CAST(l_suppkey % 7 AS INTEGER), l_suppkey, strftime(l_shipdate, '%Y%m%d'), l_suppkey, l_partkey) AS path,
           l_orderkey AS id, l_extendedprice AS bytes, l_linenumber AS line FROM lineitem)"""
