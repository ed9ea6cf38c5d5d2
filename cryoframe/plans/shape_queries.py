"""Queries that filter and chain shapes: polygons, regions of cells, their slopes and widths."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bookkeeping as books, distance, overlay, polygons as poly, raster, spatial as op, windows as win
from ..operators.graph import cut
from .base import IMG, LATTICE, OBS, PLOTS, img, lattice, obs, plots, query, t
from .spatial_queries import _LAB, _POINTS, _SHAPES, POINTS, SIZE, _points

_QUALITY = """s AS (SELECT image, 100.0::DOUBLE * count(*) FILTER (WHERE band <> 'error') / count(*) AS valid FROM img GROUP BY image),
    ent AS (SELECT image, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 4) AS entropy FROM (SELECT image, floor(v / 25) AS v, count(*) AS n FROM img WHERE v IS NOT NULL GROUP BY ALL) GROUP BY image)"""


def _entropy(spark, d):
    return op.shannon_entropy(img(spark, d).withColumn("v", F.floor(F.col("v") / 25)), ["image"], "v").withColumn("entropy", F.round("entropy", 4))


@query("f05_two_threshold_filter", f"WITH {IMG}, {_QUALITY} SELECT image, round(valid, 4) AS valid, entropy FROM ent JOIN s USING (image) WHERE valid < 75 OR entropy < 2")
def _(spark, d):
    valid = img(spark, d).groupBy("image").agg((100.0 * F.count_if(F.col("band") != "error") / F.count("*")).alias("valid"))
    return _entropy(spark, d).join(valid, "image").where("valid < 75 or entropy < 2").select("image", F.round("valid", 4).alias("valid"), "entropy")


@query("f06_single_threshold", f"WITH {IMG}, {_QUALITY} SELECT image, entropy FROM ent WHERE entropy < 2.2")
def _(spark, d):
    return _entropy(spark, d).where("entropy < 2.2D")


@query("f07_area_filter_parts", f"""
    WITH {PLOTS}, r AS (SELECT zone, CAST(ring // 2 AS INTEGER) AS part, abs(sum(x0 * y1 - x1 * y0)) / 2 AS area FROM e GROUP BY zone, ring // 2),
    w AS (SELECT zone FROM r GROUP BY zone HAVING sum(area) >= 6000 AND sum(area) <= 14000)
    SELECT zone, part, area FROM r WHERE zone IN (SELECT zone FROM w) AND area > 200""")
def _(spark, d):
    whole = plots(spark, d).withColumn("whole", poly.area("parts")).where("whole >= 6000 and whole <= 14000")
    return overlay.exploded(whole, "zone", SIZE).select("zone", "part", poly.area("parts").alias("area")).where("area > 200")


@query("f09_bounding_side", f"WITH {PLOTS} SELECT zone FROM plots WHERE greatest(maxx - minx, maxy - miny) <= 150")
def _(spark, d):
    return plots(spark, d).where(F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")) <= 150).select("zone")


@query("f10_narrow_or_holes", f"""
    WITH {PLOTS}, r AS (SELECT zone, ring, sum(x0 * y1 - x1 * y0) / 2 AS a, sum(sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2))) AS p FROM e GROUP BY zone, ring),
    s AS (SELECT zone, abs(sum(a)) AS a, sum(p) AS p, CAST(count(*) FILTER (WHERE a < 0) AS INTEGER) AS holes FROM r GROUP BY zone)
    SELECT zone, holes, round(4 * pi() * a / (p * p), 4) AS circularity FROM s WHERE NOT (a > 8000 AND 4 * pi() * a / (p * p) < 0.3) AND holes <= 1""")
def _(spark, d):
    s = plots(spark, d).select("zone", poly.area("parts").alias("a"), poly.perimeter("parts").alias("p"), poly.holes("parts").alias("holes"))
    s = s.withColumn("c", 4 * F.pi() * F.col("a") / (F.col("p") * F.col("p")))
    return s.where("not (a > 8000 and c < 0.3) and holes <= 1").select("zone", "holes", F.round("c", 4).alias("circularity"))


_REGIONS = f"WITH RECURSIVE {LATTICE}, low AS (SELECT pixel AS id, row, col FROM lattice WHERE z < 120), {_LAB}"
#: Distance of each cell to the nearest one outside of its region; that one is next to a cell of the region.
_WIDTHS = """cellr AS (SELECT lab.region, low.row, low.col FROM lab JOIN low USING (id)),
    off AS (SELECT DISTINCT c.region, c.row + i AS row, c.col + j AS col FROM cellr c, (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) k(i, j) WHERE (c.region, c.row + i, c.col + j) NOT IN (SELECT region, row, col FROM cellr)),
    far AS (SELECT c.region, c.row, c.col, min((c.row - o.row) * (c.row - o.row) + (c.col - o.col) * (c.col - o.col)) AS square FROM cellr c JOIN off o USING (region) GROUP BY ALL),
    wide AS (SELECT region, 2 * sqrt(max(square)) AS width FROM far GROUP BY region), long AS (SELECT region, greatest(max(col) - min(col), max(row) - min(row)) + 1 AS length FROM cellr GROUP BY region)"""


def _regions(spark, d):
    low = lattice(spark, d).where("z < 120").select(F.col("pixel").alias("id"), "row", "col")
    return cut(op.components_on_lattice(low, raster.EIGHT))


def _widths(spark, d):
    cells = _regions(spark, d)
    width = distance.distances(cells, "region").groupBy("region").agg((2 * F.max("far")).alias("width"))
    return width.join(poly.region_shapes(cells), "region")


@query("f11_length_width_filter", f"{_REGIONS}, {_WIDTHS} SELECT region, length, round(width, 6) AS width FROM wide JOIN long USING (region) WHERE length >= 3 AND width <= 12")
def _(spark, d):
    return _widths(spark, d).select("region", F.greatest("wide", "high").alias("length"), F.round("width", 6).alias("width")).where("length >= 3 and width <= 12")


@query("f12_hole_filter", f"{_REGIONS}, {_SHAPES} SELECT region, holes FROM shapes WHERE holes <= 20")
def _(spark, d):
    return poly.region_shapes(_regions(spark, d)).select("region", "holes").where("holes <= 20")


@query("f13_min_area", f"{_REGIONS} SELECT region, count(*) * 10 AS area FROM lab GROUP BY region HAVING count(*) * 10 >= 90")
def _(spark, d):
    return poly.region_shapes(_regions(spark, d)).select("region", (F.col("cells") * 10).alias("area")).where("area >= 90")


@query("f35_medial_width", f"{_REGIONS}, {_WIDTHS} SELECT region, round(width, 6) AS width FROM wide WHERE width <= 15")
def _(spark, d):
    return _widths(spark, d).where("width <= 15").select("region", F.round("width", 6).alias("width"))


_STEEP = f"""w AS (
        SELECT c.row, c.col, {', '.join(f"max(e.z) FILTER (WHERE e.row = c.row + {i} AND e.col = c.col + {j}) AS w{3 * (i + 1) + j + 1}" for i in (-1, 0, 1) for j in (-1, 0, 1))}
        FROM lattice c JOIN lattice e ON abs(e.row - c.row) <= 1 AND abs(e.col - c.col) <= 1 WHERE e.z IS NOT NULL GROUP BY c.row, c.col HAVING count(*) = 9),
    g AS (SELECT *, (w2 + 2 * w5 + w8 - w0 - 2 * w3 - w6) / 8 AS dx, (w6 + 2 * w7 + w8 - w0 - 2 * w1 - w2) / 8 AS dy FROM w),
    steep AS (SELECT *, sqrt(dx * dx + dy * dy) AS steep FROM g),
    terrain AS (SELECT row, col, degrees(atan(steep)) AS slope,
        greatest(255 * (cos(radians(45)) * cos(atan(steep)) + sin(radians(45)) * sin(atan(steep)) * cos(radians(135) - atan2(dy, -dx))), 0) AS hillshade FROM steep)"""


@query("f15_mean_slope", f"{_REGIONS}, {_STEEP} SELECT region, count(*) AS cells, round(avg(slope), 4) AS slope FROM lab JOIN low USING (id) JOIN terrain USING (row, col) GROUP BY region HAVING avg(slope) <= 88")
def _(spark, d):
    slopes = raster.terrain(lattice(spark, d), "z").select("row", "col", "slope")
    mean = _regions(spark, d).join(slopes, ["row", "col"]).groupBy("region").agg(F.count("*").alias("cells"), F.avg("slope").alias("slope"))
    return mean.where("slope <= 88").withColumn("slope", F.round("slope", 4))


@query("f26_steep_slope", f"WITH {LATTICE}, {_STEEP} SELECT row, col, CASE WHEN slope > 40 AND slope <= 88 THEN 255 ELSE 0 END AS steep FROM terrain")
def _(spark, d):
    slope = F.col("slope")
    return raster.terrain(lattice(spark, d), "z").select("row", "col", F.when((slope > 40) & (slope <= 88), 255).otherwise(0).alias("steep"))


@query("k14_clip_per_grid", f"{_POINTS} SELECT zone, object FROM inside")
def _(spark, d):
    return win.points_held(_points(spark, d), plots(spark, d), ["object"], ["zone"], POINTS).select("zone", "object")


_COVER = "cover AS (SELECT DISTINCT l_suppkey AS dem, l_orderkey AS grid FROM lineitem), done AS (SELECT o_orderkey AS grid FROM orders WHERE o_orderstatus <> 'F' OR o_custkey % 1000 < 999)"


def _cover(spark, d):
    cover = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("dem"), F.col("l_orderkey").alias("grid")).distinct()
    return cover, t(spark, d, "orders").where("o_orderstatus <> 'F' or o_custkey % 1000 < 999").select(F.col("o_orderkey").alias("grid"))


@query("j17_relational_division", f"WITH {_COVER} SELECT dem FROM cover LEFT JOIN done ON done.grid = cover.grid GROUP BY dem HAVING bool_and(done.grid IS NOT NULL)")
def _(spark, d):
    cover, done = _cover(spark, d)
    return books.unneeded(cover, "dem", "grid", done)


@query("p01_grid_mosaic", f"""
    WITH {OBS}, ref AS (SELECT pixel, median(z) AS m FROM obs GROUP BY pixel),
    masked AS (SELECT o.pixel, o.d, CASE WHEN o.flag <> 'click' AND o.event_id % 4 <> 1 AND coalesce(abs(o.z - r.m) <= 150, true) AND o.pixel % 13 <> 5 THEN o.z END AS z FROM obs o JOIN ref r USING (pixel)),
    kept AS (SELECT d FROM masked GROUP BY d HAVING 100.0::DOUBLE * count(z) / count(*) >= 10)
    SELECT pixel, CAST(year(d) AS INTEGER) AS year, arg_max(z, d) FILTER (WHERE z IS NOT NULL) AS z, count(z) AS n FROM masked WHERE d IN (SELECT d FROM kept) GROUP BY pixel, year(d)""")
def _(spark, d):
    # match flags, bit masks, outliers against the reference, surface water; then dates that keep enough, newest on top in each year
    o = cut(obs(spark, d))
    ref = o.groupBy("pixel").agg(F.median("z").alias("m"))
    mask = o.select("pixel", "d", (F.col("event_id") % 4).alias("bits"))
    left = raster.masked_where(o.select("pixel", "d", F.when(F.col("flag") != "click", F.col("z")).alias("z")), mask, ["pixel", "d"], "z", "bits", F.col("bits") == 1)
    left = raster.outlier_masked(left, ref, ["pixel"], "z", "m", 150.0)
    left = cut(left.withColumn("z", F.when(F.col("pixel") % 13 != 5, F.col("z"))))
    kept = left.groupBy("d").agg((100.0 * F.count("z") / F.count("*")).alias("per")).where("per >= 10").select("d")
    newest = F.max_by("z", F.when(F.col("z").isNotNull(), F.col("d"))).alias("z")
    return left.join(kept, "d", "left_semi").groupBy("pixel", F.year("d").alias("year")).agg(newest, F.count("z").alias("n"))


@query("p04_subsidence_regions", f"""
    WITH RECURSIVE {LATTICE}, low AS (SELECT pixel AS id, row, col, z FROM lattice WHERE z < 120),
    reach AS (SELECT id, id AS seen FROM low UNION SELECT r.id, b.id FROM reach r JOIN low a ON a.id = r.seen JOIN low b ON abs(a.row - b.row) + abs(a.col - b.col) = 1),
    lab AS (SELECT id, min(seen) AS region FROM reach GROUP BY id), {_SHAPES}, {_STEEP},
    reg AS (SELECT region, round(avg(z), 6) AS mean, round(stddev_pop(z), 4) AS std, max(row) - min(row) + 1 AS high, max(col) - min(col) + 1 AS wide FROM lab JOIN low USING (id) GROUP BY region),
    tilt AS (SELECT region, round(avg(slope), 4) AS slope FROM lab JOIN low USING (id) JOIN terrain USING (row, col) GROUP BY region),
    ring AS (SELECT DISTINCT lab.region, n.pixel, n.z FROM lab JOIN low USING (id) JOIN lattice n ON abs(n.row - low.row) <= 1 AND abs(n.col - low.col) <= 1 WHERE n.pixel NOT IN (SELECT id FROM low)),
    around AS (SELECT region, round(avg(z), 6) AS surround FROM ring GROUP BY region)
    SELECT region, cells, perimeter, mean, std, surround, round(mean - surround, 6) AS relative, slope FROM shapes JOIN reg USING (region) LEFT JOIN around USING (region) LEFT JOIN tilt USING (region)
    WHERE cells >= 3 AND cells <= 10000 AND greatest(wide, high) <= 500 AND NOT (cells > 40 AND 4 * pi() * cells / (perimeter * perimeter) < 0.001) AND coalesce(mean - surround, -1) <= 0 AND coalesce(slope, 0) <= 89.9""")
def _(spark, d):
    cells = lattice(spark, d)
    low = cells.where("z < 120").select(F.col("pixel").alias("id"), "row", "col", "z")
    labelled = cut(op.components_on_lattice(low, raster.FOUR))
    # area, bounding side, narrowness
    shapes = poly.region_shapes(labelled).where("cells >= 3 and cells <= 10000 and greatest(wide, high) <= 500 and not (cells > 40 and circularity < 0.001)")
    stats = labelled.groupBy("region").agg(F.round(F.avg("z"), 6).alias("mean"), F.round(F.stddev_pop("z"), 4).alias("std"))
    tilt = labelled.join(raster.terrain(cells, "z"), ["row", "col"]).groupBy("region").agg(F.round(F.avg("slope"), 4).alias("slope"))
    moved = labelled.select("region", "row", "col", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in raster.EIGHT])).alias("o"))
    spots = moved.select("region", (F.col("row") + F.col("o.i")).alias("row"), (F.col("col") + F.col("o.j")).alias("col")).distinct()
    ring = spots.join(cells, ["row", "col"]).join(low.select("row", "col"), ["row", "col"], "left_anti")
    around = ring.groupBy("region").agg(F.round(F.avg("z"), 6).alias("surround"))
    out = shapes.join(stats, "region").join(around, "region", "left").join(tilt, "region", "left")
    # lower than what is around, and not too steep
    out = out.where("coalesce(mean - surround, -1D) <= 0 and coalesce(slope, 0D) <= 89.9D")
    return out.select("region", "cells", "perimeter", "mean", "std", "surround", F.round(F.col("mean") - F.col("surround"), 6).alias("relative"), "slope")


@query("p07_hillshade_with_lines", f"""
    WITH {LATTICE}, {_STEEP}, burnt AS (SELECT l_suppkey // 10 AS row, l_suppkey % 10 AS col, max(year(l_shipdate)) AS y FROM lineitem GROUP BY ALL)
    SELECT row, col, round(hillshade, 4) AS hillshade, CAST(y AS INTEGER) AS line_year, coalesce(CAST(y AS DOUBLE), round(hillshade, 4)) AS shown FROM terrain LEFT JOIN burnt USING (row, col)""")
def _(spark, d):
    shade = raster.terrain(lattice(spark, d), "z").select("row", "col", F.round("hillshade", 4).alias("hillshade"))
    burnt = t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.max(F.year("l_shipdate")).alias("line_year")).select(
        F.expr("cast(l_suppkey div 10 as int)").alias("row"), (F.col("l_suppkey") % 10).cast("int").alias("col"), "line_year"
    )
    return shade.join(burnt, ["row", "col"], "left").withColumn("shown", F.coalesce(F.col("line_year").cast("double"), "hillshade"))
