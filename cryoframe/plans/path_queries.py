"""Queries of medial axes, longest lines and batches of cells.

The lattice is ten columns wide, so that a cell's number tells its row and column: ``k = 10 * row + col``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bookkeeping as books, distance, edges as edge, paths, polygons as poly, raster, spatial as op
from ..operators.graph import cut
from .base import LATTICE, PLOTS, held, lattice, plots, query, t
from .shape_queries import _STEEP
from .spatial_queries import _NEAR, _TOUCH

_NEAR8 = "abs(a.k // 10 - b.k // 10) <= 1 AND abs(a.k % 10 - b.k % 10) <= 1 AND a.k <> b.k"
_NEAR4 = "abs(a.k // 10 - b.k // 10) + abs(a.k % 10 - b.k % 10) = 1"


def _figures(source: str, name: str, near: str = _NEAR8) -> str:
    """SQL: ``name(figure, k)``, the connected figures of the cells ``k`` of a table; a figure's number is its smallest cell."""
    return f"""{name}_reach AS (SELECT k, k AS seen FROM {source} UNION SELECT r.k, b.k FROM {name}_reach r JOIN {source} a ON a.k = r.seen JOIN {source} b ON {near}),
    {name} AS (SELECT min(seen) AS figure, k FROM {name}_reach GROUP BY k)"""


def _axis(source: str, name: str) -> str:
    """SQL: squared distances ``name_far(figure, r, c, square)`` in figures, and their ridges ``name(k, figure, square)``."""
    return f"""{name}_c AS (SELECT figure, k // 10 AS r, k % 10 AS c FROM {source}),
    {name}_off AS (SELECT DISTINCT figure, r + i AS r, c + j AS c FROM {name}_c, (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) v(i, j) WHERE (figure, r + i, c + j) NOT IN (SELECT figure, r, c FROM {name}_c)),
    {name}_far AS (SELECT a.figure, a.r, a.c, min((a.r - o.r) * (a.r - o.r) + (a.c - o.c) * (a.c - o.c)) AS square FROM {name}_c a JOIN {name}_off o USING (figure) GROUP BY ALL),
    {name}_axes AS (SELECT a.*, coalesce(n.square, 0) AS n, coalesce(m.square, 0) AS m FROM (SELECT * FROM {name}_far, (VALUES (0, 1), (1, 0), (1, 1), (1, -1)) v(i, j)) a
        LEFT JOIN {name}_far n ON n.figure = a.figure AND n.r = a.r + a.i AND n.c = a.c + a.j LEFT JOIN {name}_far m ON m.figure = a.figure AND m.r = a.r - a.i AND m.c = a.c - a.j),
    {name} AS (SELECT r * 10 + c AS k, figure, any_value(square) AS square FROM {name}_axes GROUP BY r, c, figure HAVING bool_or(n <= square AND m <= square AND (n < square OR m < square)))"""


def _lines(source: str) -> str:
    """SQL: ``path(figure, k, d)``, the longest path of the tree of fewest steps of each figure, and ``summary`` of it."""
    return f"""nbr AS (SELECT a.figure, a.k, b.k AS n FROM {source} a JOIN {source} b ON a.figure = b.figure AND {_NEAR8}),
    bfs AS (
        SELECT figure, 0 AS level, [min(k)] AS front, [min(k)] AS seen FROM {source} GROUP BY figure UNION ALL
        SELECT x.figure, x.level + 1, list(DISTINCT n), any_value(seen) || list(DISTINCT n) FROM (SELECT figure, level, seen, unnest(front) AS k FROM bfs) x JOIN nbr ON nbr.figure = x.figure AND nbr.k = x.k
        WHERE NOT list_contains(seen, n) GROUP BY x.figure, x.level),
    lev AS (SELECT figure, unnest(front) AS k, level FROM bfs),
    par AS (SELECT c.figure, c.k, min(n) AS p FROM lev c JOIN nbr USING (figure, k) JOIN lev m ON m.figure = c.figure AND m.k = n AND m.level = c.level - 1 GROUP BY ALL),
    tn AS (SELECT figure, k, p AS n FROM par UNION ALL SELECT figure, p, k FROM par),
    wa AS (SELECT figure, first(k ORDER BY level DESC, k) AS k, CAST(-1 AS BIGINT) AS back, 0 AS d FROM lev GROUP BY figure UNION ALL SELECT w.figure, t.n, w.k, d + 1 FROM wa w JOIN tn t ON t.figure = w.figure AND t.k = w.k WHERE t.n <> w.back),
    eb AS (SELECT figure, first(k ORDER BY d DESC, k) AS b, max(d) AS most FROM wa GROUP BY figure),
    wb AS (SELECT figure, b AS k, CAST(-1 AS BIGINT) AS back, 0 AS d FROM eb UNION ALL SELECT w.figure, t.n, w.k, d + 1 FROM wb w JOIN tn t ON t.figure = w.figure AND t.k = w.k WHERE t.n <> w.back),
    path AS (SELECT figure, k, wa.d FROM wa JOIN wb USING (figure, k) JOIN eb USING (figure) WHERE wa.d + wb.d = most),
    rest AS (SELECT figure, count(*) AS left_over FROM {source} WHERE (figure, k) NOT IN (SELECT figure, k FROM path) AND (figure, k) IN (SELECT figure, k FROM nbr) GROUP BY figure),
    summary AS (
        SELECT figure, cells, a // 10 AS row0, a % 10 AS col0, b // 10 AS row1, b % 10 AS col1, coalesce(left_over, 0) AS left_over
        FROM (SELECT figure, count(*) AS cells, first(k ORDER BY d) AS a, first(k ORDER BY d DESC) AS b FROM path GROUP BY figure) LEFT JOIN rest USING (figure))"""


def _labelled(cells, offsets=raster.EIGHT):
    """Cells (row, col) with their figure."""
    numbered = cells.select((F.col("row") * 10 + F.col("col")).cast("long").alias("id"), "row", "col")
    return cut(op.components_on_lattice(numbered, offsets).select(F.col("region").alias("figure"), "row", "col"))


@query("m21_medial_axis", f"WITH {LATTICE}, low AS (SELECT 0 AS figure, pixel AS k FROM lattice WHERE z < 200), {_axis('low', 'axis')} SELECT k, square FROM axis")
def _(spark, d):
    # the lattice is one figure, dealt by its rows and columns
    low = lattice(spark, d).where("z < 200").select(F.lit(0).alias("figure"), "row", "col")
    return distance.ridges(distance.distances(low, "figure"), "figure").select((F.col("row") * 10 + F.col("col")).alias("k"), "square")


@query("m22_longest_lines", f"WITH RECURSIVE {LATTICE}, low AS (SELECT 0 AS figure, pixel AS k FROM lattice WHERE z < 200), {_axis('low', 'axis')}, {_figures('axis', 'fig')}, {_lines('fig')} SELECT * FROM summary")
def _(spark, d):
    low = lattice(spark, d).where("z < 200").select(F.lit(0).alias("figure"), "row", "col")
    axis = distance.ridges(distance.distances(low, "figure"), "figure")
    return paths.line_summary(_labelled(axis), "figure")


@query("m22_line_cells", f"WITH RECURSIVE {LATTICE}, low AS (SELECT pixel AS k FROM lattice WHERE z < 110), {_figures('low', 'fig')}, {_lines('fig')} SELECT figure, k // 10 AS row, k % 10 AS col, CAST(d AS BIGINT) AS place FROM path")
def _(spark, d):
    return paths.longest_lines(_labelled(lattice(spark, d).where("z < 110")), "figure").select("figure", "row", "col", "place")


@query("m23_left_over_cells", f"WITH RECURSIVE {LATTICE}, low AS (SELECT pixel AS k FROM lattice WHERE z < 150), {_figures('low', 'fig', _NEAR4)}, {_lines('fig')} SELECT figure, cells, left_over FROM summary")
def _(spark, d):
    return paths.line_summary(_labelled(lattice(spark, d).where("z < 150"), raster.FOUR), "figure").select("figure", "cells", "left_over")


@query("p05_headwall_lines", f"""
    WITH RECURSIVE {LATTICE}, gentle AS (SELECT pixel, row, col, z / 40 AS z FROM lattice), {_STEEP.replace("FROM lattice c JOIN lattice e", "FROM gentle c JOIN gentle e")},
    low AS (SELECT CAST(row AS BIGINT) * 10 + col AS k FROM terrain WHERE slope > 20 AND slope <= 88), {_figures('low', 'steep0')}, {_axis('steep0', 'axis')},
    size AS (SELECT figure, 2 * sqrt(max(square)) AS width, greatest(max(c) - min(c), max(r) - min(r)) + 1 AS length, count(*) AS cells FROM axis_far GROUP BY figure),
    side AS (SELECT a.figure, count(*) AS n FROM steep0 a JOIN steep0 b ON a.figure = b.figure AND {_NEAR4} GROUP BY a.figure),
    corner AS (SELECT figure, count(DISTINCT (k // 10 + i) * 100 + k % 10 + j) AS v FROM steep0, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) t(i, j) GROUP BY figure),
    kept AS (SELECT figure FROM size JOIN corner USING (figure) LEFT JOIN side USING (figure) WHERE length >= 3 AND width <= 12 AND 1 - (v - (4 * cells - coalesce(n, 0) // 2) + cells) <= 20),
    ax AS (SELECT k FROM axis WHERE figure IN (SELECT figure FROM kept)), {_figures('ax', 'fig')}, {_lines('fig')} SELECT * FROM summary WHERE cells >= 2""")
def _(spark, d):
    # M07, F26, M18; then F11 and F12 on the regions; M21, and M22 and M23 on the pieces of the axis
    steep = raster.terrain(lattice(spark, d).withColumn("z", F.col("z") / 40), "z").where("slope > 20 and slope <= 88")
    regions = _labelled(steep)
    far = cut(distance.distances(regions, "figure"))
    shapes = poly.region_shapes(regions, "figure").join(far.groupBy("figure").agg((2 * F.max("far")).alias("width")), "figure")
    kept = shapes.where("greatest(wide, high) >= 3 and width <= 12 and holes <= 20").select("figure")
    axis = distance.ridges(far, "figure").join(kept, "figure", "left_semi")
    return paths.line_summary(_labelled(axis), "figure").where("cells >= 2")


_WALK = f"""nb AS (SELECT a.k, list(b.k ORDER BY b.k) AS near FROM low a JOIN low b ON {_NEAR8} GROUP BY a.k), whole AS (SELECT figure, list(k ORDER BY k) AS cells FROM fig GROUP BY figure),
    walk AS (
        SELECT figure, 0 AS batch, cells[1:1] AS queue, cells[1:1] AS seen, 1 AS size, cells[1:1] AS fresh FROM whole UNION ALL
        SELECT figure, CASE WHEN grow THEN batch ELSE batch + 1 END, CASE WHEN grow THEN queue[2:] || new ELSE new END, seen || new, CASE WHEN grow THEN size + len(new) ELSE 1 END, new
        FROM (SELECT w.figure, w.batch, w.queue, w.seen, w.size, w.size < {{most}} AND len(w.queue) > 0 AS grow,
                CASE WHEN w.size < {{most}} AND len(w.queue) > 0 THEN list_filter(coalesce(n.near, []), lambda x: NOT list_contains(w.seen, x)) ELSE list_filter(r.cells, lambda x: NOT list_contains(w.seen, x))[1:1] END AS new
            FROM walk w JOIN whole r ON r.figure = w.figure LEFT JOIN nb n ON n.k = w.queue[1]) s WHERE grow OR len(new) > 0),
    grown AS (SELECT figure AS region, CAST(batch AS INTEGER) AS batch, unnest(fresh) AS id FROM walk)"""


@query("w18_batch_growing", f"WITH RECURSIVE {LATTICE}, low AS (SELECT pixel AS k FROM lattice WHERE z < 120), {_figures('low', 'fig')}, {_WALK.format(most=20)} SELECT region, batch, id FROM grown")
def _(spark, d):
    cells = _labelled(lattice(spark, d).where("z < 120")).withColumn("id", F.col("row") * 10 + F.col("col"))
    return paths.grown_batches(cells, "figure", 20)


_WIDE = lambda sql: sql.replace("// 10", "// 100").replace("% 10", "% 100")


@query("p12_region_orchestration", f"""
    WITH RECURSIVE {PLOTS}, objects AS (SELECT (j + 5) * 100 + i + 5 AS k, i * 40.0::DOUBLE AS minx, j * 40.0::DOUBLE AS miny, i * 40.0::DOUBLE + 40 AS maxx, j * 40.0::DOUBLE + 40 AS maxy FROM (SELECT unnest(range(-3, 32)) AS i) a, (SELECT unnest(range(-3, 32)) AS j) b),
    m AS (SELECT z.zone AS dem, o.k, bool_or({_TOUCH}) OR {held('o.minx', 'o.miny')} AS meets FROM objects o JOIN plots z ON {_NEAR} JOIN e ON e.zone = z.zone GROUP BY z.zone, o.k),
    cover AS (SELECT dem, k FROM m WHERE meets), done AS (SELECT DISTINCT (c_custkey // 28 % 28 + 5) * 100 + c_custkey % 28 + 5 AS k FROM customer WHERE c_acctbal < 0),
    low AS (SELECT DISTINCT k FROM cover WHERE k NOT IN (SELECT k FROM done)), {_WIDE(_figures('low', 'fig'))}, {_WIDE(_WALK.format(most=20))},
    jobs AS (SELECT id AS k, CAST(dense_rank() OVER (ORDER BY region, batch) - 1 AS INTEGER) AS job FROM grown)
    SELECT dem, count(*) AS grids, count(job) AS open, count(job) = 0 AS unneeded, min(job) AS first_job, count(DISTINCT job) AS jobs, CASE WHEN count(job) = 0 THEN 'done' WHEN count(job) < count(*) THEN 'working' ELSE 'notYet' END AS state
    FROM cover LEFT JOIN jobs USING (k) GROUP BY dem""")
def _(spark, d):
    # Which scenes' footprints meet which grids of 40 by 40; one that only touches bounds at its upper side counts
    scenes = plots(spark, d).select(F.col("zone").alias("dem"), "parts", "minx", "miny", "maxx", "maxy")
    spot = lambda lo, hi: F.explode(F.sequence(F.ceil(F.col(lo) / 40) - 1, F.floor(F.col(hi) / 40)))
    grids = scenes.withColumn("col", spot("minx", "maxx")).withColumn("row", spot("miny", "maxy")).select("row", "col").distinct()
    x, y = F.col("col") * 40.0, F.col("row") * 40.0
    boxes = grids.select(((F.col("row") + 5) * 100 + F.col("col") + 5).alias("k"), x.alias("minx"), y.alias("miny"), (x + 40).alias("maxx"), (y + 40).alias("maxy")).select("k", poly.box().alias("parts"))
    cover = cut(edge.meeting(scenes, boxes, ["dem"], ["k"], 40.0).select("dem", "k"))
    # Grids that are not done
    c = F.col("c_custkey")
    done = t(spark, d, "customer").where("c_acctbal < 0").select(((F.expr("c_custkey div 28") % 28 + 5) * 100 + c % 28 + 5).alias("k")).distinct()
    left = books.remaining(cover.select("k").distinct(), [done], "k")
    # Batches that hang together become jobs
    cells = left.select(F.col("k").alias("id"), F.floor(F.col("k") / 100).alias("row"), F.pmod("k", F.lit(100)).alias("col"))
    batches = cut(paths.grown_batches(op.components_on_lattice(cells, raster.EIGHT), "region", 20))
    numbers = books.chunks(batches.select("region", "batch").distinct(), ["region", "batch"], 1)
    jobs = batches.join(numbers, ["region", "batch"]).select(F.col("id").alias("k"), F.col("job").cast("int").alias("job"))
    # State of each scene by its grids; J17: a scene is unneeded if all of them are done
    state = cover.join(jobs, "k", "left").groupBy("dem").agg(F.count("*").alias("grids"), F.count("job").alias("open"), F.min("job").alias("first_job"), F.count_distinct("job").alias("jobs"))
    state = state.join(books.unneeded(cover, "dem", "k", done).withColumn("unneeded", F.lit(True)), "dem", "left").withColumn("unneeded", F.coalesce("unneeded", F.lit(False)))
    return state.withColumn("state", F.when(F.col("open") == 0, "done").when(F.col("open") < F.col("grids"), "working").otherwise("notYet"))
