"""Union of polygons, outlines of buffers and single parts, on the edge lattice of :mod:`.edges`.

A union is a planar overlay: coordinates are snapped to a grid of decimals, edges are cut where they meet others, pieces
that lie inside another polygon or between two go, and what is left is traced into rings.  No polygon and no group
is gathered: edges meet by lattice cells, pieces are rows, and rings are followed by doubling.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .edges import SHIFT_X, SHIFT_Y, dealt, edge_cells, inside, points_in, spans
from .graph import followed, written
from .polygons import _cross, edges, signed_area, with_bounds

#: Decimals that coordinates keep in an overlay.
DIGITS = 6
#: Cells in which more edges than this meet are quartered, this often at most.
MOST, DEPTH = 48, 8
CELL = ["level", "cx", "cy"]
_SIDED = "struct<n:int,x0:double,y0:double,x1:double,y1:double,px:double,py:double>"


def snapped(polygons: DataFrame, digits: int = DIGITS, parts: str = "parts") -> DataFrame:
    """Coordinates rounded to ``digits`` decimals."""
    point = f"named_struct('x', round(p.x, {digits}), 'y', round(p.y, {digits}))"
    return polygons.withColumn(parts, F.expr(f"transform({parts}, g -> transform(g, p -> {point}))"))


def _corner(level: str, size: float, cx: str = "cx", cy: str = "cy") -> tuple[str, str]:
    """SQL: the lower left corner of a cell; each level halves the cells of the one before."""
    return f"(({cx} / pow(2D, {level}) + {SHIFT_X}D) * {size}D)", f"(({cy} / pow(2D, {level}) + {SHIFT_Y}D) * {size}D)"


def _quarters(cells: DataFrame, keys: list[str], level: int, size: float) -> DataFrame:
    """Rows of cells in rows of their quarters, each with the edges there, cut to it, and its own corner."""
    at, side, slack = _corner(f"{level}", size), size / 2.0 ** (level + 1), 1e-9 * size
    low = {"x": f"({at[0]} + _i * {side}D)", "y": f"({at[1]} + _j * {side}D)"}
    rows = cells.withColumn("_q", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])))
    rows = rows.select(*keys, "cx", "cy", "edges", "corner", F.col("_q.i").alias("_i"), F.col("_q.j").alias("_j"))
    rows = rows.withColumns({"_c": F.expr(inside(low["x"], low["y"], size, at=at)), "_x": F.expr(low["x"]), "_y": F.expr(low["y"])})
    # the shares of an edge between which it lies in the quarter
    ends = [f"(({f'_{c}'} {edge}) - e.{c}0) / nullif(e.{c}1 - e.{c}0, 0D)" for c in "xy" for edge in (f"- {slack}D", f"+ {side + slack}D")]
    level_ = {c: f"(e.{c}0 = e.{c}1 and e.{c}0 not between _{c} - {slack}D and _{c} + {side + slack}D)" for c in "xy"}
    first = f"greatest(0D, least({ends[0]}, {ends[1]}), least({ends[2]}, {ends[3]}))"
    last = f"least(1D, greatest({ends[0]}, {ends[1]}), greatest({ends[2]}, {ends[3]}))"
    shares = f"transform(edges, e -> struct(e, if({level_['x']} or {level_['y']}, 2D, {first}) as a, {last} as b))"
    cut = f"transform(filter({shares}, s -> s.a <= s.b), s -> struct(s.e.n as n, s.e.x0 as x0, s.e.y0 as y0, s.e.x1 as x1, s.e.y1 as y1, s.e.x0 + (s.a + s.b) / 2 * (s.e.x1 - s.e.x0) as px, s.e.y0 + (s.a + s.b) / 2 * (s.e.y1 - s.e.y0) as py))"
    rows = rows.select(*keys, (2 * F.col("cx") + F.col("_i")).alias("cx"), (2 * F.col("cy") + F.col("_j")).alias("cy"), F.expr(cut).alias("edges"), F.col("_c").alias("corner"))
    return rows.where("corner or size(edges) > 0")


def open_cells(rows: DataFrame, group: list[str], size: float, most: int = MOST, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """Two tables: ``group, member, level, cx, cy, edges, corner`` of the cells that no member of a group covers; ``group, member, cover`` of the others, with a member that covers the cell.

    ``rows`` are numbered edges ``group, member, n, x0, y0, x1, y1``.  What lies in a covered cell lies inside the union, whatever it
    meets there.  An open cell with more than ``most`` edges is quartered, and its quarters are looked at in the same way: so edges that
    pile up inside a union are left out before any two of them are compared, and those at its border meet few others.
    """
    keys = [*group, "member"]
    on = edge_cells(rows, size).select(*keys, "cx", "cy", F.struct("n", "x0", "y0", "x1", "y1", "px", "py").alias("e"), F.lit(False).alias("corner"))
    inner = spans(rows, keys, size, (SHIFT_X, SHIFT_Y)).select(*keys, F.explode(F.sequence("c0", "c1")).alias("cx"), "cy", F.lit(None).cast(_SIDED).alias("e"), F.lit(True).alias("corner"))
    cells = dealt(on.unionByName(inner), *group, "cx", "cy", "member").groupBy(*keys, "cx", "cy").agg(F.collect_list("e").alias("edges"), F.max("corner").alias("corner"))
    found, covered = [], []
    for level in range(depth + 1):
        cells = written(cells)
        covers = F.expr("size(edges) = 0 and corner")
        state = cells.groupBy(*group, "cx", "cy").agg(F.min(F.when(covers, F.col("member"))).alias("cover"), F.sum(F.size("edges")).alias("_n"))
        cells = written(cells.join(state, [*group, "cx", "cy"]))
        covered.append(cells.where("cover is not null").select(*keys, "cover"))
        split = F.lit(False) if level == depth else F.col("_n") > most
        left = cells.where("cover is null")
        found.append(left.where(~split).select(*keys, F.lit(level).alias("level"), "cx", "cy", "edges", "corner"))
        left = left.where(split)
        if level == depth or left.isEmpty():
            break
        cells = _quarters(left, keys, level, size)
    return reduce(DataFrame.unionByName, found), reduce(DataFrame.unionByName, covered).distinct()


def _numbered(polygons: DataFrame, keys: list[str], parts: str) -> DataFrame:
    """Edges ``keys, n, x0, y0, x1, y1`` of some length, numbered within their polygon."""
    rows = polygons.select(*keys, F.posexplode(edges(parts)).alias("n", "e")).select(*keys, "n", "e.*").where("x0 <> x1 or y0 <> y1")
    return written(dealt(rows, *keys, "n"))


def touching(polygons: DataFrame, key: str, size: float, parts: str = "parts") -> DataFrame:
    """Pairs ``a, b`` of polygons that share a point, borders included, so many that what hangs together by all such pairs hangs together by these; each polygon is paired with the first of those equal to it.

    All that a covered cell holds meets the polygon that covers it; pairs are tested in open cells alone (:func:`open_cells`).
    """
    same = polygons.groupBy(parts).agg(F.min(key).alias("member"))
    cells, covered = open_cells(_numbered(same, ["member"], parts), [], size)
    other = cells.select(*CELL, F.col("member").alias("o_member"), F.col("edges").alias("_re"), F.col("corner").alias("_rc"))
    pairs = dealt(cells, *CELL).join(other, CELL).where("member < o_member")
    at = _corner("level", size)
    holds = lambda own, e, c: f"exists({own}, e -> {inside('e.px', 'e.py', size, e, c, at)})"
    meets = f"(corner and _rc) or exists(edges, e -> exists(_re, f -> {_cross()})) or {holds('edges', '_re', '_rc')} or {holds('_re', 'edges', 'corner')}"
    met = pairs.where(F.expr(meets)).select(F.col("member").alias("a"), F.col("o_member").alias("b"))
    own = polygons.join(same, parts).select(F.col(key).alias("a"), F.col("member").alias("b"))
    return met.unionByName(covered.select(F.col("member").alias("a"), F.col("cover").alias("b"))).unionByName(own).distinct()


def _cuts(cells: DataFrame, group: str, digits: int) -> DataFrame:
    """``group, member, n, px, py``: points of each edge, ends left out, where an edge of another member of its group meets it."""
    names = ("member", "n", "x0", "y0", "x1", "y1")
    other = cells.select(group, *CELL, *[F.col(c).alias(f"o_{c}") for c in names])
    pairs = dealt(cells.select(group, *CELL, *names), group, *CELL).join(other, [group, *CELL]).where("member <> o_member")
    # signed distances from the other edge's line; what is within a step of the grid counts as on it
    near = 0.75 * 10.0**-digits
    off = lambda p, b: F.expr(f"(({b}x1 - {b}x0) * ({p[1]} - {b}y0) - ({b}y1 - {b}y0) * ({p[0]} - {b}x0)) / sqrt(pow({b}x1 - {b}x0, 2) + pow({b}y1 - {b}y0, 2))")
    pairs = pairs.withColumns({f"_{n}": off(p, b) for n, p, b in (("b0", ("o_x0", "o_y0"), ""), ("b1", ("o_x1", "o_y1"), ""), ("a0", ("x0", "y0"), "o_"), ("a1", ("x1", "y1"), "o_"))})
    beside = lambda v, c: f"{v} between least({c}0, {c}1) - {near}D and greatest({c}0, {c}1) + {near}D"
    end = lambda t, x, y: f"if(abs({t}) <= {near}D and {beside(x, 'x')} and {beside(y, 'y')}, struct({x} as x, {y} as y), null)"
    # both edges take the crossing from the same formula, on the edge that comes first
    first = "(member < o_member)"
    pick = lambda c: f"if({first}, {c}, o_{c})"
    late = lambda c: f"if({first}, o_{c}, {c})"
    dx, dy, ex, ey = f"({pick('x1')} - {pick('x0')})", f"({pick('y1')} - {pick('y0')})", f"({late('x1')} - {late('x0')})", f"({late('y1')} - {late('y0')})"
    along = f"((({late('x0')} - {pick('x0')}) * {ey} - ({late('y0')} - {pick('y0')}) * {ex}) / ({dx} * {ey} - {dy} * {ex}))"
    crossing = f"if(_a0 * _a1 < 0 and _b0 * _b1 < 0 and least(abs(_a0), abs(_a1), abs(_b0), abs(_b1)) > {near}D, struct(round({pick('x0')} + {along} * {dx}, {digits}) as x, round({pick('y0')} + {along} * {dy}, {digits}) as y), null)"
    points = pairs.select(group, "member", "n", *names[2:], F.explode(F.expr(f"filter(array({end('_b0', 'o_x0', 'o_y0')}, {end('_b1', 'o_x1', 'o_y1')}, {crossing}), p -> p is not null)")).alias("p"))
    points = points.where("not (p.x = x0 and p.y = y0) and not (p.x = x1 and p.y = y1)")
    return points.select(group, "member", "n", F.col("p.x").alias("px"), F.col("p.y").alias("py")).distinct()


def union_edges(polygons: DataFrame, group: str, member: str, size: float, digits: int = DIGITS, parts: str = "parts") -> DataFrame:
    """``group, x0, y0, x1, y1``: the border of the union of each group's members, what it encloses on the left.

    Rings must turn against the clock, holes with it, and rings of one member may not cross.  Members may overlap, touch, share
    edges or be equal.  Lattice cells of ``size`` bound what meets: take a few edges' length; cells that a member covers are left out (:func:`open_cells`).
    """
    clean = snapped(polygons.select(group, F.col(member).alias("member"), parts), digits, parts).groupBy(group, parts).agg(F.min("member").alias("member"))
    rows = _numbered(clean, [group, "member"], parts)
    cells, _ = open_cells(rows, [group], size)
    cells = written(cells)
    sides = cells.select(group, "member", *CELL, F.explode("edges").alias("e")).select(group, "member", *CELL, "e.n", "e.x0", "e.y0", "e.x1", "e.y1")
    cuts = _cuts(sides, group, digits)
    # an edge that only passes covered cells lies inside
    rows = written(dealt(sides.drop(*CELL), group, "member", "n").distinct())
    at = F.expr("(px - x0) * (x1 - x0) + (py - y0) * (y1 - y0)")
    cuts = cuts.join(rows, [group, "member", "n"]).groupBy(group, "member", "n").agg(F.sort_array(F.collect_list(F.struct(at.alias("t"), F.col("px").alias("x"), F.col("py").alias("y")))).alias("_c"))
    whole = "concat(array(struct(x0 as x, y0 as y)), coalesce(transform(_c, c -> struct(c.x as x, c.y as y)), array()), array(struct(x1 as x, y1 as y)))"
    line = rows.join(cuts, [group, "member", "n"], "left").withColumn("_p", F.expr(whole))
    pieces = line.select(group, "member", F.explode(F.expr("zip_with(slice(_p, 1, size(_p) - 1), slice(_p, 2, size(_p) - 1), (a, b) -> struct(a, b))")).alias("s")).where("s.a <> s.b")
    key = [group, "lo", "hi"]
    forward = F.col("s.a") < F.col("s.b")
    pieces = pieces.select(group, "member", F.least("s.a", "s.b").alias("lo"), F.greatest("s.a", "s.b").alias("hi"), forward.alias("forward"))
    # a piece that one member has on its left and another on its right lies between them
    pieces = dealt(pieces, *key).groupBy(*key).agg(F.collect_set("member").alias("members"), F.bool_or("forward").alias("f"), F.bool_and("forward").alias("all_f"))
    pieces = written(pieces.where("f = all_f").select(*key, "members", "f"))
    middle = pieces.withColumns({"mx": F.expr("(lo.x + hi.x) / 2"), "my": F.expr("(lo.y + hi.y) / 2")})
    number = lambda c, shift: F.floor((F.col(c) / size - shift) * F.pow(F.lit(2.0), "level")).alias(f"c{c[1]}")
    levels = [r[0] for r in cells.select("level").distinct().collect()] or [0]
    spots = middle.withColumn("level", F.explode(F.array(*[F.lit(i) for i in levels]))).select("*", number("mx", SHIFT_X), number("my", SHIFT_Y))
    # a middle in no open cell lies inside, others if a member that is not on the piece holds it
    held = dealt(spots, group, *CELL).join(cells, [group, *CELL])
    within = F.expr(f"not array_contains(members, member) and {inside('mx', 'my', size, at=_corner('level', size))}")
    left = held.select(*key, "f", within.alias("_in")).groupBy(*key).agg(F.any_value("f").alias("f"), F.bool_or("_in").alias("_in")).where("not _in")
    left = left.withColumns({"_s": F.when(F.col("f"), F.col("lo")).otherwise(F.col("hi")), "_e": F.when(F.col("f"), F.col("hi")).otherwise(F.col("lo"))})
    return left.select(group, F.col("_s.x").alias("x0"), F.col("_s.y").alias("y0"), F.col("_e.x").alias("x1"), F.col("_e.y").alias("y1"))


def traced(border: DataFrame, key: str) -> DataFrame:
    """Polygons ``key, parts`` from border edges ``key, x0, y0, x1, y1`` with the inside on the left; rings keep turning left where they touch themselves."""
    arrows = written(border.select(key, F.monotonically_increasing_id().alias("id"), "x0", "y0", "x1", "y1"))
    onward = arrows.select(key, F.col("x0").alias("x1"), F.col("y0").alias("y1"), F.col("id").alias("next"), F.expr("x1 - x0").alias("nx"), F.expr("y1 - y0").alias("ny"))
    turn = F.expr("atan2((x1 - x0) * ny - (y1 - y0) * nx, (x1 - x0) * nx + (y1 - y0) * ny)")
    links = arrows.join(onward, [key, "x1", "y1"]).groupBy("id").agg(F.max_by("next", turn).alias("next"))
    placed = followed(links).join(arrows, "id")
    points = placed.groupBy(key, "ring").agg(F.sort_array(F.collect_list(F.struct("place", F.col("x0").alias("x"), F.col("y0").alias("y")))).alias("_p"))
    ring = "transform(_p, p -> struct(p.x as x, p.y as y))"
    return points.select(key, F.expr(f"concat({ring}, slice({ring}, 1, 1))").alias("_g")).groupBy(key).agg(F.collect_list("_g").alias("parts"))


def dissolved(polygons: DataFrame, group: str, member: str, size: float, digits: int = DIGITS) -> DataFrame:
    """``group, parts``: the union of each group's members as one polygon, outer rings against the clock, holes with it."""
    return traced(union_edges(polygons, group, member, size, digits), group)


def enclosed(border: DataFrame, key: str, name: str = "area") -> DataFrame:
    """Area and length of borders given as edges with the inside on the left."""
    border = written(border)
    near = border.groupBy(key).agg(F.min("x0").alias("_ox"), F.min("y0").alias("_oy"))
    return border.join(near, key).groupBy(key).agg(
        (F.sum(F.expr("(x0 - _ox) * (y1 - _oy) - (x1 - _ox) * (y0 - _oy)")) / 2).alias(name), F.sum(F.expr("sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2))")).alias("length")
    )


def around(polygons: DataFrame, key: str, reach: float, steps: int = 4, parts: str = "parts") -> DataFrame:
    """``key, member, parts``: each polygon, the rectangle within ``reach`` of each edge and the disc, of ``4 * steps`` corners, around each point."""
    e = polygons.select(key, F.posexplode(edges(parts)).alias("n", "e")).select(key, "n", "e.*").where("x0 <> x1 or y0 <> y1")
    e = e.withColumns({"_ox": F.expr(f"{reach}D * (y1 - y0) / sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2))"), "_oy": F.expr(f"{reach}D * (x0 - x1) / sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2))")})
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    side = lambda i, sign: point(F.col(f"x{i}") + sign * F.col("_ox"), F.col(f"y{i}") + sign * F.col("_oy"))
    disc = [point(F.col("x0") + reach * math.cos(k * math.pi / (2 * steps)), F.col("y0") + reach * math.sin(k * math.pi / (2 * steps))) for k in range(4 * steps)]
    own = polygons.select(key, F.lit(0).alias("member"), parts)
    rectangles = e.select(key, (2 * F.col("n") + 1).cast("int").alias("member"), F.array(F.array(side(0, 1), side(1, 1), side(1, -1), side(0, -1), side(0, 1))).alias(parts))
    discs = e.select(key, (2 * F.col("n") + 2).cast("int").alias("member"), F.array(F.array(*disc, disc[0])).alias(parts))
    return own.unionByName(rectangles).unionByName(discs)


def buffered(polygons: DataFrame, key: str, reach: float, size: float, steps: int = 4, digits: int = DIGITS) -> DataFrame:
    """``key, x0, y0, x1, y1``: the outline of all points within ``reach`` of each polygon, holes narrowed or closed; :func:`traced` gives its rings."""
    return union_edges(around(polygons.select(key, "parts"), key, reach, steps), key, "member", size, digits)


def shapes(polygons: DataFrame, key: str, parts: str = "parts") -> tuple[DataFrame, DataFrame]:
    """``key, shape`` of each polygon and ``shape, parts``: polygons that are moved copies of each other have one shape, its first point at the origin."""
    first = f"{parts}[0][0]"
    moved = polygons.select(key, F.expr(f"transform({parts}, g -> transform(g, p -> named_struct('x', p.x - {first}.x, 'y', p.y - {first}.y)))").alias(parts))
    found = written(moved.groupBy(parts).agg(F.min(key).alias("shape")))
    return moved.join(found, parts).select(key, "shape"), found.select("shape", parts)


def exploded(polygons: DataFrame, key: str, size: float, parts: str = "parts") -> DataFrame:
    """``key, part, parts``: each outer ring with its holes, numbered from 0 in the order of the outer rings.

    Outer is what turns like the first ring.  A hole goes to the smallest outer ring around its first point; holes and
    outer rings meet by lattice cells, however many a polygon has.
    """
    rings = polygons.select(key, F.expr(f"sign(aggregate(zip_with(slice({parts}[0], 1, size({parts}[0]) - 1), slice({parts}[0], 2, size({parts}[0]) - 1), (p, q) -> p.x * q.y - q.x * p.y), 0D, (s, v) -> s + v))").alias("_s"), F.posexplode(parts).alias("ring", "_g"))
    rings = rings.select(key, "ring", "_s", F.array("_g").alias("parts")).withColumn("_a", signed_area("parts"))
    outer = rings.where("_a * _s > 0").select(key, "ring", F.abs("_a").alias("whole"), "parts")
    holes = rings.where("_a * _s < 0").select(F.col(key).alias("_k"), F.col("ring").alias("hole"), F.expr("parts[0][0].x").alias("x"), F.expr("parts[0][0].y").alias("y"), F.col("parts").alias("_h"))
    owner = points_in(holes, with_bounds(outer), size).where(F.col("_k") == F.col(key)).groupBy(key, "hole").agg(F.min_by("ring", "whole").alias("ring"), F.any_value("_h").alias("_h"))
    inner = owner.groupBy(key, "ring").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("hole", "_h"))), lambda h: h["_h"])).alias("_holes"))
    number = rings.where("_a * _s > 0").groupBy(key).agg(F.sort_array(F.collect_list("ring")).alias("_n"))
    whole = outer.join(inner, [key, "ring"], "left").join(number, key)
    return whole.select(key, (F.array_position("_n", F.col("ring")) - 1).cast("int").alias("part"), F.expr("concat(parts, coalesce(_holes, cast(array() as array<array<struct<x:double,y:double>>>)))").alias("parts"))
