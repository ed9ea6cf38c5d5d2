"""Work that must follow borders, windows and figures, not boxes around them or pairs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cryoframe.operators import edges, polygons as poly, windows as win


@pytest.fixture(scope="module")
def sliver(spark):
    # a thin slanted figure in a box of 400 million cells
    ring = [(0.0, 0.0), (20000.0, 19990.0), (20000.0, 20000.0), (0.0, 0.0)]
    return poly.with_bounds(spark.createDataFrame([(1, [ring])], f"zone int, parts {poly.RINGS}")).cache()


def test_cells_near_a_long_border(sliver):
    # m16_buffer_ring
    cells = poly.buffered_cells(sliver, 0.5, 1.0)
    inside = edges.burnt(sliver, 1.0)
    assert cells.where("far = 0").select("cx", "cy").exceptAll(inside.select("cx", "cy")).isEmpty()
    assert cells.where("far = 0").count() == inside.count()
    # the upper side runs through centres, and half a cell's width beyond it no other centre lies
    assert cells.where("far > 0.5 or cy > cx").isEmpty() and cells.where("far > 0").count() > 10_000


def test_hexagons_of_a_long_figure(sliver):
    # m15_hexagon_cover
    found = poly.hexagons_in(sliver, 0.5)
    x, y = poly.hexagon_centre(F.col("q"), F.col("r"), 0.5)
    assert found.where((y > x) | (y < x * 0.9995)).isEmpty()
    assert abs(found.count() * 3**0.5 * 1.5 * 0.25 / 100_000 - 1) < 0.01


@pytest.fixture(scope="module")
def crowd(spark):
    # 3,000 squares with the same middle and 20,000 points in a few windows: 60 million pairs; corners and borders among the points
    corner = lambda x, y: F.struct((F.lit(x) * F.col("half")).alias("x"), (F.lit(y) * F.col("half")).alias("y"))
    squares = spark.range(3000).select(F.col("id").alias("zone"), (50.0 + F.col("id") % 10).alias("half"))
    squares = squares.select("zone", F.array(F.array(*[corner(x, y) for x, y in ((-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (-1.0, 1.0), (-1.0, -1.0))])).alias("parts"))
    points = spark.range(20000).select(F.col("id").alias("object"), (F.col("id") % 66).cast("double").alias("x"), F.lit(3.0).alias("y"), (F.col("id") % 7).cast("double").alias("v"))
    return points.cache(), poly.with_bounds(squares).cache()


def test_values_of_held_points_are_folded_by_windows(crowd):
    # j21_pixel_in_zone, a09_zonal_statistics, a04_volume_change
    points, squares = crowd
    got = win.folded(points, squares, "object", ["zone"], 8.0, n=(F.sum, F.lit(1)), total=(F.sum, F.col("v")), most=(F.max, F.col("x"))).collect()
    assert len(got) == 3000
    want = {k: points.where(f"x <= {50 + k}").agg(F.count("*"), F.sum("v"), F.max("x")).first() for k in range(10)}
    assert all((r["n"], r["total"], r["most"]) == tuple(want[r["zone"] % 10]) for r in got)


def test_points_held_and_near(crowd):
    # j23_within_buffer, k14_clip_per_grid
    points, squares = (t.limit(n) for t, n in zip(crowd, (200, 40)))
    pairs = points.crossJoin(squares.select("zone", F.col("maxx").alias("half"))).withColumn("far", F.greatest(F.lit(0.0), F.col("x") - F.col("half")))
    key = (["object"], ["zone"])
    held = win.points_held(points, squares, *key, 8.0)
    assert held.exceptAll(pairs.where("far = 0").select("object", "zone")).isEmpty() and held.count() == pairs.where("far = 0").count()
    near = win.points_within(points, squares, *key, 5.0, 8.0).withColumn("far", F.round("far", 9))
    assert near.exceptAll(pairs.where("far <= 5").select("object", "zone", "far")).isEmpty() and near.count() == pairs.where("far <= 5").count()


def test_what_hangs_together_needs_no_pairs(crowd):
    # m19_merge_touching; 9 million pairs of squares meet
    from cryoframe.operators import graph, overlay

    _, squares = crowd
    links = overlay.touching(squares, "zone", 50.0)
    assert links.count() < 20_000
    assert graph.connected_components(links).where("component = 0").count() == 3000


def test_edges_inside_a_union_meet_no_others(spark):
    # m19_merge_touching, m16_buffer_outline; a big square over 400 small ones, all of whose edges cross others, and one at its rim
    from cryoframe.operators import overlay

    corner = lambda x, y: F.struct((F.col("x") + x * F.col("s")).alias("x"), (F.col("y") + y * F.col("s")).alias("y"))
    ring = F.array(F.array(*[corner(x, y) for x, y in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0))]))
    small = spark.range(1, 401).select("id", (20.0 + F.col("id") % 20 / 8).alias("x"), (20.0 + F.col("id") / 100).alias("y"), F.lit(5.0).alias("s"))
    rows = small.unionByName(spark.createDataFrame([(0, 0.0, 0.0, 100.0), (401, 95.0, 40.0, 10.0)], "id long, x double, y double, s double"))
    polygons = rows.select(F.lit(1).alias("grp"), "id", ring.alias("parts"))
    cells, covered = overlay.open_cells(overlay._numbered(polygons.select("grp", F.col("id").alias("member"), "parts"), ["grp", "member"], "parts"), ["grp"], 10.0)
    assert {r[0] for r in cells.select("member").distinct().collect()} == {0, 401}
    assert covered.where("cover = 0").select("member").distinct().count() == 401
    assert overlay.enclosed(overlay.union_edges(polygons, "grp", "id", 10.0), "grp").first()["area"] == 10_050


def test_moved_copies_have_one_shape(spark):
    # m16_buffer_outline
    from cryoframe.operators import overlay

    ring = lambda x, y, w: [[(x, y), (x + w, y), (x + w, y + 2.0), (x, y + 2.0), (x, y)]]
    rows = [(i, ring(7.0 * i, -3.0 * i, 1.0 + i % 3)) for i in range(30)]
    keys, found = overlay.shapes(spark.createDataFrame(rows, f"zone int, parts {poly.RINGS}"), "zone")
    assert {r["zone"]: r["shape"] for r in keys.collect()} == {i: i % 3 for i in range(30)}
    assert {r["shape"]: [[tuple(p) for p in g] for g in r["parts"]] for r in found.collect()} == {i: ring(0.0, 0.0, 1.0 + i) for i in range(3)}


def test_scenes_alike_are_looked_at_once_a_round(spark, monkeypatch):
    # w05_monthly_greedy_rounds; 6,000 scenes with ten sets of cells, and a few scenes that have several rows
    from cryoframe.operators import catalogue, graph

    rows = [(1, i, [*range(i % 10 * 9, i % 10 * 9 + 20)], i * 7 % 90) for i in range(6000)] + [(1, 2 * i, [*range(i, i + 12)], 95) for i in range(40)]
    sizes, written = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, *a: (sizes.append((out := written(df, *a)).count()), out)[1])
    df = spark.createDataFrame(rows, "a int, scene int, cells array<int>, valid int").repartition(3)
    got = {(r["scene"], r["round"]) for r in catalogue.monthly_rounds(df, ["a"], "scene", "cells", "valid").collect()}
    assert max(sizes) <= 3 * 10 + 80
    want, taken = set(), set()
    left = sorted((-v, i, frozenset(c)) for _, i, c, v in rows)
    for n in range(1, 4):
        seen = None
        for _, i, c in left:
            if i not in taken and (seen is None or (len(seen) <= 95 and len(c - seen) >= 5)):
                seen = c | (seen or set())
                want.add((i, n))
                taken.add(i)
    assert got == want


def test_rounds_do_not_grow_with_a_figures_extent(spark, monkeypatch):
    # m23_left_over_cells, m22_longest_lines, m22_line_cells; 500 tiles in a row
    from cryoframe.operators import paths

    written, tables = paths.written, []

    def counted(df, *a):
        tables.append(1)
        assert len(tables) < 80
        return written(df, *a)

    monkeypatch.setattr(paths, "written", counted)
    cells = spark.range(12000).select(F.lit(1).alias("figure"), F.expr("id div 3").alias("row"), (F.col("id") % 3).alias("col"))
    found = paths.longest_lines(cells, "figure", 8)
    assert found.count() == 4000 and found.agg(F.max("place")).first()[0] == 3999


@pytest.fixture
def copies(spark, monkeypatch):
    # 900 copies of a square, 600 points at six places and as many boxes there, and the rows of every table that is written
    sizes, written = [], win.written
    monkeypatch.setattr(win, "written", lambda df, *a: (sizes.append((out := written(df, *a)).count()), out)[1])
    ring = [(0.0, 0.0), (40.0, 0.0), (40.0, 40.0), (0.0, 40.0), (0.0, 0.0)]
    squares = spark.createDataFrame([(i, [ring]) for i in range(900)], f"zone int, parts {poly.RINGS}")
    x, y = (F.col("id") % 6 * 9).cast("double"), F.lit(20.0)
    points = spark.range(600).select(F.col("id").alias("object"), x.alias("x"), y.alias("y"), (F.col("id") % 7).alias("v"))
    boxes = points.select("object", F.col("x").alias("minx"), F.col("y").alias("miny"), (F.col("x") + 2).alias("maxx"), (F.col("y") + 3).alias("maxy"))
    return squares, points, boxes, sizes


def test_copies_are_tested_for_nearness_once(copies):
    # j23_within_buffer; the last place is 5 beside the squares
    squares, points, _, sizes = copies
    near = win.points_within(points, squares, ["object"], ["zone"], 5.0, 8.0, digits=6)
    assert {(r["far"], r["count"]) for r in near.groupBy("far").count().collect()} == {(0.0, 450_000), (5.0, 90_000)}
    assert near.select("zone", "object").distinct().count() == 540_000 and max(sizes) < 200


def test_copies_are_folded_once(copies):
    # j21_pixel_in_zone
    squares, points, _, sizes = copies
    got = win.folded(points, squares, "object", ["zone"], 8.0, n=(F.sum, F.lit(1)), total=(F.sum, F.col("v"))).collect()
    total = points.where("x <= 40").agg(F.sum("v")).first()[0]
    assert len(got) == 900 and {(r["n"], r["total"]) for r in got} == {(500, total)} and max(sizes) < 200


def test_copies_are_held_once(copies):
    # k14_clip_per_grid
    squares, points, _, sizes = copies
    held = win.points_held(points, squares, ["object"], ["zone"], 8.0)
    assert held.count() == held.distinct().count() == 450_000 and max(sizes) < 200


def test_copies_are_met_once(copies):
    # j03_footprint_lookup; the boxes at 36 end within the squares, those at 45 lie beside them
    squares, _, boxes, sizes = copies
    met = win.meeting_boxes(boxes, squares, ["object"], ["zone"], 4.0, shared=True).groupBy("touches", "inside", "shared").count().collect()
    assert {tuple(r) for r in met} == {(False, True, 6.0, 360_000), (True, True, 6.0, 90_000)} and max(sizes) < 1000


def test_copies_are_gathered_once(copies):
    # j04_cover_map
    squares, _, boxes, sizes = copies
    lists = win.gathered_boxes(boxes, squares, "object", ["zone"], 4.0).collect()
    assert [len(r["polygons"]) for r in lists] == [900] and lists[0]["ids"] == [i for i in range(600) if i % 6 < 5] and max(sizes) < 1000


def test_values_of_pairs_are_found_before_copies_come_apart(copies):
    # w07_overlap_percentage
    squares, _, boxes, sizes = copies
    boxes = boxes.withColumn("maxx", F.col("maxx") + 6)  # those at 36 reach 4 of 8 into the squares
    percent = F.round(100 * F.col("shared") / 24, 1)
    met = win.meeting_boxes(boxes, squares, ["object"], ["zone"], 4.0, shared=True, where=percent >= 60, values={"percent": percent})
    assert {tuple(r) for r in met.groupBy("percent").count().collect()} == {(100.0, 360_000)} and max(sizes) < 1000


def test_borders_are_tested_once_a_list(copies):
    # Spark puts a filter on lists that become rows below what makes them
    squares, points, boxes, _ = copies
    key = (["object"], ["zone"])
    for df in (
        win.points_within(points, squares, *key, 5.0, 8.0), win.points_held(points, squares, *key, 8.0),
        win.meeting_boxes(boxes, squares, *key, 4.0, shared=True), win.gathered_boxes(boxes, squares, "object", ["zone"], 4.0),
    ):
        assert df._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0].count("ArrowEvalPython") == 1
