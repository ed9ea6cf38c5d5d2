"""Unions, outlines and parts of polygons against worked cases and points that are asked one by one."""

from __future__ import annotations

import math
import random

import pytest

from cryoframe.operators import graph, overlay, polygons as poly
from test_polygons import _inside, _star, ring

DDL = f"grp int, member int, parts {poly.RINGS}"


def square(x, y, w, h=None):
    return [ring((x, y), (x + w, y), (x + w, y + (h or w)), (x, y + (h or w)))]


def union(spark, rows, size=4.0):
    """Of each group the union's rings, as lists of points without the closing one, and its area."""
    df = spark.createDataFrame(rows, DDL)
    border = overlay.union_edges(df, "grp", "member", size)
    areas = {r["grp"]: r["area"] for r in overlay.enclosed(border, "grp").collect()}
    found = {}
    for r in overlay.traced(border, "grp").collect():
        assert all(g[0] == g[-1] for g in r["parts"])
        found[r["grp"]] = [[(p["x"], p["y"]) for p in g[:-1]] for g in r["parts"]]
    return found, areas


def signed(g):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(g, g[1:] + g[:1])) / 2


@pytest.mark.parametrize("size", [1.5, 30.0])
def test_worked_unions(spark, size):
    frame = [*square(0, 0, 10), ring((2, 2), (2, 8), (8, 8), (8, 2))]
    rows = [
        (1, 1, square(0, 0, 4)), (1, 2, square(2, 2, 4)), (2, 1, square(0, 0, 4)), (2, 2, square(0, 0, 4)), (3, 1, square(0, 0, 4)), (3, 2, square(4, 0, 4)), (4, 1, square(0, 0, 4)),
        (4, 2, square(4, 4, 4)), (5, 1, frame), (5, 2, square(3, 3, 2)), (6, 1, frame), (6, 2, square(1, 1, 8)), (7, 1, square(0, 0, 9)), (7, 2, square(2, 2, 3)), (8, 1, square(0, 0, 4)),
        (8, 2, square(4, 1, 4, 2)), (9, 1, square(0, 0, 3)), (9, 2, square(5, 5, 3)), (10, 1, square(0, 0, 3)), (10, 2, square(2, 0, 3)),
    ]
    rings, areas = union(spark, rows, size)
    assert areas == {1: 28, 2: 16, 3: 32, 4: 32, 5: 68, 6: 100, 7: 81, 8: 24, 9: 18, 10: 15}
    assert {k: sorted(signed(g) for g in v) for k, v in rings.items()} == {1: [28], 2: [16], 3: [32], 4: [16, 16], 5: [-36, 4, 100], 6: [100], 7: [81], 8: [24], 9: [9, 9], 10: [15]}


def test_unions_of_stars(spark):
    rng = random.Random(11)
    stars = {(g, m): _star(rng, rng.uniform(-12, 12), rng.uniform(-12, 12), 9.0, rng.randint(5, 14)) for g in range(4) for m in range(2 + 4 * g)}
    rings, areas = union(spark, [(g, m, [ring(*s)]) for (g, m), s in stars.items()])
    for g in range(4):
        own = [[s] for (h, _), s in stars.items() if h == g]
        for _ in range(400):
            p = rng.uniform(-22, 22), rng.uniform(-22, 22)
            assert _inside(rings[g], *p) == any(_inside(s, *p) for s in own)
        assert areas[g] == pytest.approx(sum(map(signed, rings[g])))


def test_outlines_of_buffers(spark):
    rng = random.Random(2)
    shapes = {1: [[(0.0, 0.0), (20.0, 0.0), (20.0, 20.0), (0.0, 20.0)], [(5.0, 5.0), (5.0, 15.0), (15.0, 15.0), (15.0, 5.0)]], 2: [_star(rng, 0, 0, 12.0)], 3: [[(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0)], [(4.0, 4.0), (4.0, 5.0), (5.0, 5.0), (5.0, 4.0)]]}
    df = spark.createDataFrame([(k, [ring(*g) for g in v]) for k, v in shapes.items()], f"zone int, parts {poly.RINGS}")
    rings = {r["zone"]: [[(p["x"], p["y"]) for p in g[:-1]] for g in r["parts"]] for r in overlay.traced(overlay.buffered(df, "zone", 2.0, 5.0), "zone").collect()}
    assert sorted(round(signed(g), 3) for g in rings[1])[0] == -36 and len(rings[3]) == 1

    def far(v, x, y):
        if _inside(v, x, y):
            return 0.0
        along = lambda a, b: max(0.0, min(1.0, ((x - a[0]) * (b[0] - a[0]) + (y - a[1]) * (b[1] - a[1])) / math.dist(a, b) ** 2))
        return min(math.dist((x, y), (a[0] + u * (b[0] - a[0]), a[1] + u * (b[1] - a[1]))) for g in v for a, b in zip(g, g[1:] + g[:1]) for u in [along(a, b)])

    for k, v in shapes.items():
        for _ in range(600):
            x, y = rng.uniform(-16, 26), rng.uniform(-16, 26)
            d = far(v, x, y)
            if not 2 * math.cos(math.pi / 16) - 1e-6 < d < 2 + 1e-6:
                assert _inside(rings[k], x, y) == (d < 2)


def test_parts_keep_their_holes(spark):
    """An island in a hole, holes of both, a part beside; rings in any order, and a polygon whose rings turn the other way."""
    turned = lambda rings: [g[::-1] for g in rings]
    hole = lambda *a: turned(square(*a))
    nested = [*square(0, 0, 20), *hole(9, 9, 2), *square(30, 0, 4), *hole(2, 2, 16), *square(5, 5, 10)]
    df = spark.createDataFrame([(1, nested), (2, turned(nested)), (3, square(0, 0, 1)), (4, [])], f"zone int, parts {poly.RINGS}")
    got = {(r["zone"], r["part"]): sorted(abs(round(signed([(p["x"], p["y"]) for p in g[:-1]]))) for g in r["parts"]) for r in overlay.exploded(df, "zone", 6.0).collect()}
    want = {0: [256, 400], 1: [16], 2: [4, 100]}
    assert got == {**{(z, p): a for z in (1, 2) for p, a in want.items()}, (3, 0): [1]}


def test_rings_are_followed(spark):
    rng = random.Random(9)
    ids = rng.sample(range(10_000), 400)
    cuts = [0, 1, 3, 10, 60, 200, 400]
    links, want = [], {}
    for a, b in zip(cuts, cuts[1:]):
        loop = ids[a:b]
        links += list(zip(loop, loop[1:] + loop[:1]))
        at = loop.index(min(loop))
        want[min(loop)] = loop[at + 1 :] + loop[: at + 1]
    got: dict = {}
    for r in graph.followed(spark.createDataFrame(links, "id long, next long")).collect():
        got.setdefault(r["ring"], []).append((r["place"], r["id"]))
    assert {k: [i for _, i in sorted(v)] for k, v in got.items()} == want
