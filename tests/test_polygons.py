"""Polygons against worked cases and plain loops."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from cryoframe.operators import edges as edge, polygons as poly


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in (*points, points[0])]


SQUARE = [ring((0, 0), (10, 0), (10, 10), (0, 10))]
HOLED = [ring((0, 0), (10, 0), (10, 10), (0, 10)), ring((4, 4), (4, 6), (6, 6), (6, 4))]


def table(spark, rows, names=("left", "right")):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, " + ", ".join(f"{n} {poly.RINGS}" for n in names))


def test_predicates_and_areas(spark):
    inner, across, apart, touching, around = ([ring((x, y), (x + w, y), (x + w, y + w), (x, y + w))] for x, y, w in ((1, 1, 2), (8, 8, 5), (20, 20, 1), (10, 3, 2), (-5, -5, 30)))
    in_hole, over_hole = [ring((4.5, 4.5), (5.5, 4.5), (5.5, 5.5))], [ring((3, 3), (7, 3), (7, 7), (3, 7))]
    rows = [(SQUARE, inner), (SQUARE, across), (SQUARE, apart), (SQUARE, touching), (SQUARE, around), (HOLED, in_hole), (HOLED, over_hole), (HOLED, inner)]
    df = table(spark, rows)
    for size in (2.0, 7.0, 50.0):
        side = lambda name: df.select("id", F.col(name).alias("parts"))
        got = {r["id"]: r["i"] for r in edge.meeting(side("right"), side("left").withColumnRenamed("id", "other"), ["id"], ["other"], size).where("id = other").select("id", F.expr(edge.LIES_IN).alias("i")).collect()}
        assert sorted(got) == [0, 1, 3, 4, 6, 7] and sorted(i for i, lies in got.items() if lies) == [0, 7]
    shared = {r["id"]: r["shared"] for r in poly.shared_area(df, ["id"], left="left", right="right").collect()}
    assert [round(shared[i], 9) for i in range(8)] == [4.0, 4.0, 0.0, 0.0, 100.0, 0.0, 12.0, 4.0]
    one = df.where("id = 6").select(poly.area("left").alias("a"), poly.perimeter("left").alias("p"), poly.holes("left").alias("h")).first()
    assert tuple(one) == (96.0, 48.0, 1)


def _star(rng, cx, cy, reach=9.0, n=12):
    return [(cx + r * math.cos(2 * math.pi * k / n), cy + r * math.sin(2 * math.pi * k / n)) for k in range(n) for r in [rng.uniform(reach / 4, reach)]]


def _inside(rings, x, y):
    odd = False
    for points in rings:
        for p, q in zip(points, points[1:] + points[:1]):
            if (p[1] > y) != (q[1] > y) and x < (q[0] - p[0]) * (y - p[1]) / (q[1] - p[1]) + p[0]:
                odd = not odd
    return odd


@pytest.mark.parametrize("size", [3.0, 11.0, 100.0])
def test_edge_index_matches_loops(spark, size):
    """Points in stars, cells in stars, and pairs of stars that meet, whatever the size of the index's cells."""
    rng = random.Random(4)
    stars = {i: [_star(rng, rng.uniform(-30, 30), rng.uniform(-30, 30), rng.choice([2.0, 9.0, 25.0]))] for i in range(14)}
    stars[20] = [[(-40.0, -40.0), (40.0, -40.0), (40.0, 40.0), (-40.0, 40.0)], [(-20.0, -20.0), (-20.0, 20.0), (20.0, 20.0), (20.0, -20.0)]]  # a square with a hole
    plots = spark.createDataFrame([(i, [ring(*g) for g in r]) for i, r in stars.items()], f"zone int, parts {poly.RINGS}")
    points = [(rng.uniform(-45, 45), rng.uniform(-45, 45)) for _ in range(300)] + [(float(a), float(b)) for a in (-40, -20, 0, 20) for b in (-40, 0, 20)]
    found = {(r["x"], r["y"], r["zone"]) for r in edge.points_in(spark.createDataFrame(points, "x double, y double"), poly.with_bounds(plots), size).collect()}
    border = {(x, y, 20) for x, y in points if (abs(x) in (20, 40) or abs(y) in (20, 40)) and max(abs(x), abs(y)) in (20, 40)}
    assert found == {(x, y, i) for x, y in points for i, r in stars.items() if _inside(r, x, y)} | border
    cells = {(r["cx"], r["cy"], r["zone"]) for r in edge.burnt(plots.where("zone < 20"), 1.5).collect()}
    assert cells == {(a, b, i) for a in range(-40, 40) for b in range(-40, 40) for i, r in stars.items() if i < 20 and _inside(r, (a + 0.5) * 1.5, (b + 0.5) * 1.5)}
    got = edge.meeting(plots, plots.withColumnRenamed("zone", "other"), ["zone"], ["other"], size).where("zone <> other").select("zone", "other", F.expr(edge.LIES_IN).alias("i")).collect()
    some = lambda a, b: any(_inside(b, *p) for g in a for p in g)
    crossing = {(i, j): any(_cross(*s, *t) for s in _sides(a) for t in _sides(b)) for i, a in stars.items() for j, b in stars.items() if i != j}
    assert {(r["zone"], r["other"]) for r in got} == {(i, j) for (i, j), c in crossing.items() if c or some(stars[i], stars[j]) or some(stars[j], stars[i])}
    assert {(r["zone"], r["other"]) for r in got if r["i"]} == {(i, j) for (i, j), c in crossing.items() if not c and some(stars[i], stars[j]) and not some(stars[j], stars[i])}


def _sides(rings):
    return [(p, q) for g in rings for p, q in zip(g, g[1:] + g[:1])]


def _cross(a, b, c, d):
    turn = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    return turn(a, b, c) * turn(a, b, d) < 0 and turn(c, d, a) * turn(c, d, b) < 0


def test_cells_on_borders_count_once(spark):
    """Centres on corners, level edges and slanted edges."""
    square = [ring((0.5, 0.5), (4.5, 0.5), (4.5, 4.5), (0.5, 4.5)), ring((1.5, 1.5), (1.5, 3.5), (3.5, 3.5), (3.5, 1.5))]
    diamond = [ring((2.5, 0.5), (4.5, 2.5), (2.5, 4.5), (0.5, 2.5))]
    df = spark.createDataFrame([(1, square), (2, diamond), (3, []), (4, None)], f"zone int, parts {poly.RINGS}")
    got = [(r["zone"], r["cx"], r["cy"]) for r in edge.burnt(df, 1.0).collect()]
    assert sorted(got) == sorted([(1, x, y) for x in range(5) for y in range(5) if (x, y) != (2, 2)] + [(2, x, y) for x in range(5) for y in range(5) if abs(x - 2) + abs(y - 2) <= 2])


def test_shared_area_of_stars_matches_strips(spark):
    """Two stars with dents: the area that they share, against the sum of thin strips."""
    rng = random.Random(7)

    def star(cx, cy):
        return [(cx + r * math.cos(k * math.pi / 6), cy + r * math.sin(k * math.pi / 6)) for k in range(12) for r in [rng.uniform(2, 9)]]

    def inside(points, x, y):
        odd = False
        for (x0, y0), (x1, y1) in zip(points, points[1:] + points[:1]):
            if (y0 > y) != (y1 > y) and x < (x1 - x0) * (y - y0) / (y1 - y0) + x0:
                odd = not odd
        return odd

    pairs = [(star(0, 0), star(rng.uniform(-4, 4), rng.uniform(-4, 4))) for _ in range(4)]
    df = table(spark, [([ring(*a)], [ring(*b)]) for a, b in pairs])
    got = {r["id"]: r["shared"] for r in poly.shared_area(df, ["id"], left="left", right="right").collect()}
    step = 0.05
    for i, (a, b) in enumerate(pairs):
        n = sum(inside(a, x * step, y * step) and inside(b, x * step, y * step) for x in range(-200, 200) for y in range(-200, 200))
        assert got[i] == pytest.approx(n * step * step, abs=0.8)


def test_distance_and_points(spark):
    plots = poly.with_bounds(spark.createDataFrame([(1, HOLED), (2, SQUARE)], f"zone int, parts {poly.RINGS}"))
    points = spark.createDataFrame([(5.0, 5.0), (0.0, 5.0), (1.0, 1.0), (13.0, 14.0), (-2.0, 5.0)], "x double, y double")
    held = {(r["x"], r["y"], r["zone"]) for r in edge.points_in(points, plots, 7.0).collect()}
    assert held == {(5.0, 5.0, 2), (0.0, 5.0, 1), (0.0, 5.0, 2), (1.0, 1.0, 1), (1.0, 1.0, 2)}
    far = {(r["x"], r["y"]): r["far"] for r in poly.points_within(points, plots.where("zone = 1"), 5.0, 7.0).collect()}
    assert far == {(5.0, 5.0): 1.0, (0.0, 5.0): 0.0, (1.0, 1.0): 0.0, (13.0, 14.0): 5.0, (-2.0, 5.0): 2.0}


def test_regions_become_rings(spark):
    figure = ["####..", "#..#..", "#..#..", "####..", "....#.", "....##"]
    cells = spark.createDataFrame([(7, r, c) for r, line in enumerate(figure) for c, v in enumerate(line) if v == "#"] + [(8, 20, 20)], "region int, row int, col int")
    shapes = {r["region"]: r for r in poly.region_shapes(cells).collect()}
    assert (shapes[7]["cells"], shapes[7]["holes"], shapes[7]["perimeter"]) == (15, 1, 32) and (shapes[8]["cells"], shapes[8]["holes"], shapes[8]["corners"]) == (1, 0, 4)
    rings: dict = {}
    for r in poly.border_rings(cells).collect():
        rings.setdefault((r["region"], r["ring"]), []).append((r["place"], r["x"], r["y"]))
    areas: dict = {}
    for (region, _), points in rings.items():
        xy = [p[1:] for p in sorted(points)]
        areas.setdefault(region, []).append(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(xy, xy[1:] + xy[:1])) / 2)
    assert sorted(areas[7]) == [-4.0, 19.0] and areas[8] == [1.0]
    assert sum(len(p) for (region, _), p in rings.items() if region == 7) == shapes[7]["corners"]


def test_hexagons(spark):
    rng = random.Random(2)
    points = [(rng.uniform(-50, 50), rng.uniform(-50, 50)) for _ in range(300)]
    df = spark.createDataFrame(points, "x double, y double")
    q, r = poly.hexagon(F.col("x"), F.col("y"), 4.0)
    df = df.select("x", "y", q.alias("q"), r.alias("r"))
    pq, pr = poly.hexagon_parent(F.col("q"), F.col("r"))
    centre = lambda a, b: ((a + b / 2) * 4 * 3**0.5, b * 6.0)
    children: dict = {}
    for row in df.withColumns({"pq": pq, "pr": pr}).collect():
        near = min(((row["q"] + i, row["r"] + j) for i in (-1, 0, 1) for j in (-1, 0, 1)), key=lambda h: math.dist(centre(*h), (row["x"], row["y"])))
        assert near == (row["q"], row["r"])
        children.setdefault((row["pq"], row["pr"]), set()).add(near)
    assert max(len(c) for c in children.values()) == 7
    for (a, b), found in children.items():
        home = (2 * a - b, a + 3 * b)
        assert all(max(abs(q - home[0]), abs(r - home[1]), abs(q + r - home[0] - home[1])) <= 1 for q, r in found)
