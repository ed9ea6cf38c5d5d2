"""Sweeps, longest lines and batches on lattices, against plain loops over whole figures."""

from __future__ import annotations

import random
from collections import deque

import pytest

from cryoframe.operators import paths


def levels_of(cells, start, near):
    out, queue = {start: 0}, deque([start])
    while queue:
        x = queue.popleft()
        for n in near(cells, x):
            if n not in out:
                out[n] = out[x] + 1
                queue.append(n)
    return out


def eight(cells, x):
    return [n for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and (n := (x[0] + i, x[1] + j)) in cells]


def longest(cells):
    """Cells of the longest path of the tree of fewest steps from the first cell, in order."""
    level = levels_of(cells, min(cells), eight)
    parent = {x: min(n for n in eight(cells, x) if level.get(n) == d - 1) for x, d in level.items() if d}
    tree: dict = {x: set() for x in level}
    for x, p in parent.items():
        tree[x].add(p)
        tree[p].add(x)
    far = lambda found: min(found, key=lambda x: (-found[x], x))
    a = levels_of(tree, far(level), lambda t, x: t[x])
    b = far(a)
    back = levels_of(tree, b, lambda t, x: t[x])
    return sorted((x for x in a if a[x] + back[x] == a[b]), key=a.get)


def figures():
    rng = random.Random(4)
    spiral = {(0, c) for c in range(40)} | {(r, 39) for r in range(30)} | {(29, c) for c in range(5, 40)} | {(r, 5) for r in range(6, 30)} | {(6, c) for c in range(5, 30)}
    ring = {(r, c) for r in range(20) for c in range(20) if r in (0, 19) or c in (0, 19)}
    grown = {(0, 0)}
    while len(grown) < 250:
        x = rng.choice(sorted(grown))
        grown.add((x[0] + rng.choice((-1, 0, 1)), x[1] + rng.choice((-1, 0, 1))))
    return {1: spiral, 2: ring, 3: grown, 4: {(7, 7)}, 5: {(-3, 2), (-2, 3)}, 6: {(r, c) for r in range(9) for c in range(25)}}


@pytest.mark.parametrize("tile", [5, 64])
def test_longest_lines_whatever_the_tiles(spark, tile):
    made = figures()
    df = spark.createDataFrame([(k, r, c) for k, v in made.items() for r, c in v], "figure long, row int, col int").repartition(3)
    got: dict = {}
    for r in paths.longest_lines(df, "figure", tile).collect():
        got.setdefault(r["figure"], []).append((r["place"], (r["row"], r["col"])))
    assert {k: [x for _, x in sorted(v)] for k, v in got.items()} == {k: longest(v) for k, v in made.items()}
    rest = {r["figure"]: (r["cells"], r["left_over"]) for r in paths.line_summary(df, "figure", tile).collect()}
    assert rest == {k: (len(longest(v)), sum(1 for x in v - set(longest(v)) if eight(v, x))) for k, v in made.items()}
    assert paths.longest_lines(df.limit(0), "figure").collect() == []


def batches_of(cells, most):
    left, out = dict(sorted(cells.items())), []
    while left:
        start = next(iter(left))
        queue, batch = deque([start]), [left.pop(start)]
        while queue and len(batch) < most:
            for n in eight(left, queue.popleft()):
                queue.append(n)
                batch.append(left.pop(n))
        out.append(batch)
    return out


@pytest.mark.parametrize("share", [0.3, 0.6, 1.0])
def test_batches_grow_first_in_first_out(spark, share):
    rng = random.Random(int(share * 10))
    regions = {g: {(r, c): r * 100 + c for r in range(rows) for c in range(columns) if rng.random() < share} for g, (rows, columns) in enumerate([(40, 9), (3, 60), (200, 2), (1, 1)])}
    df = spark.createDataFrame([(g, r, c, i) for g, v in regions.items() for (r, c), i in v.items()], "region long, row int, col int, id long").repartition(4)
    for most in (1, 5, 50, 100_000):
        got: dict = {}
        for r in paths.grown_batches(df, "region", most).collect():
            got.setdefault((r["region"], r["batch"]), []).append(r["id"])
        assert got == {(g, n): b for g, v in regions.items() for n, b in enumerate(batches_of(v, most))}
