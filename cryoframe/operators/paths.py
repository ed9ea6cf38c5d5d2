"""Steps between lattice cells: levels from starts, spanning trees, longest lines, batches.

Cells are swept tile by tile: steps between the gates of a tile, the cells from which steps lead to other tiles, are found in it.  Tiles
are merged four by four, so that rounds grow with the logarithm of a figure's extent; from the gates' levels each tile fills in its
cells.  No figure is gathered: a task holds a tile's cells, or the steps between at most :data:`GATES` gates; where more would
meet, tiles are crossed one after another by their gates.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import reduce
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .edges import dealt
from .graph import written

#: Steps to the eight neighbours in row order; a cell's mask has one bit for each step that it may take.
STEPS = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]
ALL = 255
_FAR = np.iinfo(np.int64).max
#: Gates of tiles that may be merged into one.
GATES = 1200


def _walked(pdf: pd.DataFrame) -> pd.DataFrame:
    """Levels of a tile's cells after all walks within it."""
    rows, cols, masks = pdf["row"].to_numpy(), pdf["col"].to_numpy(), pdf["mask"].to_numpy()
    level = pdf["level"].fillna(-1).to_numpy().astype(np.int64)
    level = np.where(level < 0, _FAR, level)
    place = {(int(r), int(c)): i for i, (r, c) in enumerate(zip(rows, cols))}
    queue = [(int(level[i]), int(i)) for i in np.flatnonzero(level < _FAR)]
    heapify(queue)
    while queue:
        at, i = heappop(queue)
        if at > level[i]:
            continue
        r, c, mask = int(rows[i]), int(cols[i]), int(masks[i])
        for k, (a, b) in enumerate(STEPS):
            if mask >> k & 1 and (j := place.get((r + a, c + b))) is not None and level[j] > at + 1:
                level[j] = at + 1
                heappush(queue, (at + 1, j))
    return pdf[["figure", "row", "col", "mask"]].assign(level=pd.array([None if v == _FAR else int(v) for v in level], dtype="Int64"))


def _gate_steps(pdf: pd.DataFrame) -> pd.DataFrame:
    """Fewest steps ``d`` within a tile between its gates ``u`` and ``v``; all gates walk at once, a bit of each cell's words for each gate."""
    rows, cols, masks = (pdf[c].to_numpy().astype(np.int64) for c in ("row", "col", "mask"))
    gates, n = np.flatnonzero(pdf["gate"].to_numpy()), len(rows)
    r, c = rows - rows.min() + 1, cols - cols.min() + 1
    grid = np.full((r.max() + 2, c.max() + 2), n)
    grid[r, c] = np.arange(n)
    # for each step the cell that takes it to a cell, n if there is none
    sources = [np.where(np.append(masks, 0)[i] >> k & 1, i, n) for k, (a, b) in enumerate(STEPS) for i in [grid[r - a, c - b]]]
    own = np.arange(len(gates))
    seen = np.zeros((n + 1, max(1, -(-len(gates) // 64))), np.uint64)
    seen[gates, own // 64] = np.uint64(1) << (own % 64).astype(np.uint64)
    front, step, out = seen.copy(), 0, [np.zeros((3, 0), np.int64)]
    while front.any():
        step += 1
        new = np.zeros_like(seen)
        for i in sources:
            new[:n] |= front[i]
        new &= ~seen
        seen |= new
        to, start = np.nonzero(np.unpackbits(new[gates].view(np.uint8), axis=1, bitorder="little"))
        out.append(np.stack([gates[start], gates[to], np.full(len(to), step)]))
        front = new
    u, v, d = np.concatenate(out, axis=1)
    node = rows * (1 << 32) + cols + (1 << 31)
    return pd.DataFrame({"figure": pdf["figure"].iloc[0], "u": node[u], "v": node[v], "d": d})


def _merged_steps(pdf: pd.DataFrame) -> pd.DataFrame:
    """Fewest steps between the nodes to keep (rows of ``d`` 0 from a node to itself) over the steps of some tiles."""
    nodes, at = np.unique(np.concatenate([pdf["u"].to_numpy(), pdf["v"].to_numpy()]), return_inverse=True)
    u, v = at[: len(pdf)], at[len(pdf) :]
    d = pdf["d"].to_numpy().astype(np.int64)
    best = np.full((len(nodes), len(nodes)), 1 << 40)
    np.minimum.at(best, (u, v), d)
    for k in range(len(nodes)):
        np.minimum(best, best[:, k, None] + best[None, k], out=best)
    keep = np.unique(u[(u == v) & (d == 0)])
    i, j = np.nonzero((best[np.ix_(keep, keep)] < 1 << 40) & ~np.eye(len(keep), dtype=bool))
    return pd.DataFrame({"figure": pdf["figure"].iloc[0], "u": nodes[keep[i]], "v": nodes[keep[j]], "d": best[keep[i], keep[j]]})


def _spread(pdf: pd.DataFrame) -> pd.DataFrame:
    """Levels of nodes from those known (rows marked ``known``, their level in ``d``) over the steps of some tiles."""
    known, steps = pdf[pdf["known"]], pdf[~pdf["known"]]
    onward: dict[int, list[tuple[int, int]]] = {}
    for u, v, d in zip(steps["u"].tolist(), steps["v"].tolist(), steps["d"].tolist()):
        onward.setdefault(u, []).append((v, d))
    level: dict[int, int] = {}
    queue = [(int(d), int(u)) for u, d in zip(known["u"], known["d"])]
    heapify(queue)
    while queue:
        at, u = heappop(queue)
        if u not in level:
            level[u] = at
            for v, d in onward.get(u, ()):
                if v not in level:
                    heappush(queue, (at + d, v))
    return pd.DataFrame({"figure": pdf["figure"].iloc[0], "u": list(level), "level": list(level.values())}).astype("int64")


def _in_tile(node: str, side: int, low: tuple[int, int]) -> list[Column]:
    """The tile (tr, tc) of ``side`` cells, counted from ``low``, that holds a node."""
    row, col = F.shiftright(node, 32), F.col(node).bitwiseAND(F.lit((1 << 32) - 1)) - F.lit(1 << 31)
    return [F.floor((row - F.lit(low[0])) / side).alias("tr"), F.floor((col - F.lit(low[1])) / side).alias("tc")]


def _gate_levels(state: DataFrame, arcs: DataFrame, tile: int, max_rounds: int) -> DataFrame:
    """``figure, u, level``: levels of the gates ``u`` of all tiles, the ends of ``arcs`` that lead from tile to tile.

    Steps between the gates of a tile are found in it; four by four tiles become one, which keeps only steps between its own gates, until
    each figure lies in one tile.  Then levels go back down: those at a tile's gates give those of all gates within it.
    """
    out, tiled = "figure long, u long, v long, d long", ["figure", "tr", "tc"]
    node = (F.col("row") * (1 << 32) + F.col("col") + F.lit(1 << 31)).alias("u")
    # counted from the first tile, as no tile would ever hold cells on both sides of 0
    low = tuple(v // tile * tile for v in state.agg(F.min("row"), F.min("col")).first())
    wide = arcs.select("figure").distinct()
    begin = written(state.where("level = 0").join(wide, "figure", "left_semi").select("figure", node))
    ends = lambda t: t.select("figure", "u").unionByName(t.select("figure", F.col("v").alias("u"))).unionByName(begin).distinct()
    gates = ends(arcs).withColumn("gate", F.lit(True))
    cells = state.join(wide, "figure", "left_semi").select("figure", "row", "col", "mask", node).join(gates, ["figure", "u"], "left")
    cells = cells.select("figure", F.floor(F.col("row") / tile).alias("tr"), F.floor(F.col("col") / tile).alias("tc"), "row", "col", "mask", F.coalesce("gate", F.lit(False)).alias("gate"))
    steps, side, levels, rest = written(cells.groupBy(*tiled).applyInPandas(_gate_steps, out)), tile, [], arcs
    while not rest.isEmpty():
        side *= 4
        same = reduce(lambda a, b: a & b, [a == b for a, b in zip(_in_tile("u", side, low), _in_tile("v", side, low))])
        graph = steps.unionByName(rest.where(same).withColumn("d", F.lit(1).cast("long"))).select("figure", *_in_tile("u", side, low), "u", "v", "d")
        nodes = graph.groupBy(*tiled).agg(F.count_distinct("u").alias("n")).agg(F.max("n")).first()[0] or 0
        if nodes > GATES:
            break
        graph, rest = written(graph), written(rest.where(~same))
        levels.append((side, graph))
        kept = ends(rest).select("figure", *_in_tile("u", side, low), "u", F.col("u").alias("v"), F.lit(0).cast("long").alias("d"))
        steps = written(graph.unionByName(kept).groupBy(*tiled).applyInPandas(_merged_steps, out))
    known = begin.withColumn("level", F.lit(0).cast("long"))
    if not rest.isEmpty():
        # tiles with too many gates to merge are crossed one after another, by gates alone
        onward = written(steps.unionByName(rest.withColumn("d", F.lit(1).cast("long"))))
        front = known
        for _ in range(max_rounds):
            moved = front.join(onward, ["figure", "u"]).select("figure", F.col("v").alias("u"), (F.col("level") + F.col("d")).alias("level"))
            both = known.withColumn("old", F.col("level")).unionByName(moved.withColumn("old", F.lit(None).cast("long")))
            found = written(both.groupBy("figure", "u").agg(F.min("level").alias("level"), F.min("old").alias("old")))
            known, front = found.drop("old"), found.where("old is null or level < old").drop("old")
            if front.isEmpty():
                break
        else:
            raise RuntimeError("the sweep did not end")
    for side, graph in reversed(levels):
        seeds = known.select("figure", *_in_tile("u", side, low), "u", F.col("u").alias("v"), F.col("level").alias("d"), F.lit(True).alias("known"))
        known = written(graph.withColumn("known", F.lit(False)).unionByName(seeds).groupBy(*tiled).applyInPandas(_spread, "figure long, u long, level long"))
    return known


def swept(cells: DataFrame, starts: DataFrame, tile: int = 64, max_rounds: int = 100_000) -> DataFrame:
    """``figure, row, col, mask, level``: the fewest steps from the starts (``figure, row, col``) of its figure to each cell, null where none leads.

    ``cells`` has ``figure`` and ``mask`` (the steps that a cell may take, :data:`STEPS`).
    """
    begin = starts.select("figure", "row", "col", F.lit(0).cast("long").alias("level")).distinct()
    state = written(cells.select("figure", "row", "col", "mask").join(begin, ["figure", "row", "col"], "left"))
    node = lambda r, c: F.col(r) * (1 << 32) + F.col(c) + F.lit(1 << 31)
    rim = state.where(" or ".join(f"pmod({c}, {tile}) in (0, {tile - 1})" for c in ("row", "col")))
    sent = rim.select("figure", "row", "col", "mask", F.explode(F.array(*[F.struct(F.lit(1 << k).alias("bit"), (F.col("row") + a).alias("r"), (F.col("col") + b).alias("c")) for k, (a, b) in enumerate(STEPS)])).alias("o"))
    sent = sent.where(f"(mask & o.bit) > 0 and (floor(row / {tile}) <> floor(o.r / {tile}) or floor(col / {tile}) <> floor(o.c / {tile}))").select("figure", node("row", "col").alias("u"), node("o.r", "o.c").alias("v"))
    arcs = written(sent.join(rim.select("figure", node("row", "col").alias("v")), ["figure", "v"], "left_semi").select("figure", "u", "v"))
    if not arcs.isEmpty():
        gates = _gate_levels(state, arcs, tile, max_rounds).withColumnRenamed("level", "_gate")
        state = state.withColumn("u", node("row", "col")).join(gates, ["figure", "u"], "left").select("figure", "row", "col", "mask", F.coalesce("_gate", "level").alias("level"))
    tiled = state.withColumns({"tr": F.floor(F.col("row") / tile), "tc": F.floor(F.col("col") / tile)})
    return written(tiled.groupBy("figure", "tr", "tc").applyInPandas(_walked, "figure long, row long, col long, mask int, level long"))


def _far_end(found: DataFrame) -> DataFrame:
    """Of each figure the cell of the greatest level, the first in row order of equals."""
    return found.groupBy("figure").agg(F.min_by(F.struct("row", "col"), F.struct(-F.col("level"), "row", "col")).alias("e"), F.max("level").alias("most")).select("figure", "e.row", "e.col", "most")


def spanning_tree(found: DataFrame) -> DataFrame:
    """``figure, row, col, mask, level``: steps along a tree in which each cell of level above 0 hangs on its first neighbour, in row order, of the level below."""
    reached = found.where("level is not null").select("figure", "row", "col", "level")
    sent = reached.select("figure", "level", F.explode(F.array(*[F.struct(F.lit(7 - k).alias("k"), (F.col("row") + a).alias("r"), (F.col("col") + b).alias("c")) for k, (a, b) in enumerate(STEPS)])).alias("o"))
    around = sent.select("figure", F.col("o.r").alias("row"), F.col("o.c").alias("col"), F.col("o.k").alias("k"), F.col("level").alias("n"))
    up = reached.join(around, ["figure", "row", "col"]).where("n = level - 1").groupBy("figure", "row", "col").agg(F.min("k").alias("k"))
    table = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in STEPS])
    bits = up.select("figure", "row", "col", F.expr("shiftleft(1, k)").alias("bit")).unionByName(
        up.withColumn("s", table[F.col("k")]).select("figure", (F.col("row") + F.col("s.a")).alias("row"), (F.col("col") + F.col("s.b")).alias("col"), F.expr("shiftleft(1, 7 - k)").alias("bit"))
    )
    masks = bits.groupBy("figure", "row", "col").agg(F.bit_or("bit").cast("int").alias("mask"))
    return reached.join(masks, ["figure", "row", "col"], "left").withColumn("mask", F.coalesce("mask", F.lit(0)))


def longest_lines(cells: DataFrame, figure: str, tile: int = 64) -> DataFrame:
    """``figure, row, col, place, steps``: the cells of each figure's longest line in order, ``steps`` is their number less one.

    A figure hangs together by the eight steps; cells that its first cell in row order does not reach are left out.  From that
    cell the fewest steps make a tree (:func:`spanning_tree`); its longest path goes from the farthest cell to the one farthest from
    that, and a cell lies on it if its steps from both ends add up to the whole.  Of equally far cells the first in row order counts.
    """
    own = cells.select(F.col(figure).cast("long").alias("figure"), F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col")).distinct().withColumn("mask", F.lit(ALL))
    first = own.groupBy("figure").agg(F.min(F.struct("row", "col")).alias("s")).select("figure", "s.row", "s.col")
    levels = swept(own, first, tile)
    tree = written(spanning_tree(levels).drop("level"))
    a = swept(tree, _far_end(levels.where("level is not null")), tile)
    b_end = _far_end(a)
    b = swept(tree, b_end, tile)
    whole = a.select("figure", "row", "col", F.col("level").alias("from_a")).join(b.select("figure", "row", "col", F.col("level").alias("from_b")), ["figure", "row", "col"])
    whole = whole.join(b_end.select("figure", F.col("most").alias("steps")), "figure")
    return whole.where("from_a + from_b = steps").select(F.col("figure").alias(figure), "row", "col", F.col("from_a").alias("place"), "steps")


def line_summary(cells: DataFrame, figure: str, tile: int = 64) -> DataFrame:
    """Per figure its longest line: ``cells`` on it, its ends, and the cells left over that have a neighbour in the figure."""
    own = cells.select(F.col(figure).cast("long").alias(figure), F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col")).distinct()
    path = longest_lines(own, figure, tile)
    ends = path.groupBy(figure).agg(F.count("*").alias("cells"), F.min_by(F.struct("row", "col"), "place").alias("a"), F.max_by(F.struct("row", "col"), "place").alias("b"))
    near = own.select(figure, F.explode(F.array(*[F.struct((F.col("row") + a).alias("row"), (F.col("col") + b).alias("col")) for a, b in STEPS])).alias("n")).select(figure, "n.row", "n.col").distinct()
    left = own.join(path.select(figure, "row", "col"), [figure, "row", "col"], "left_anti").join(near, [figure, "row", "col"], "left_semi").groupBy(figure).agg(F.count("*").alias("left_over"))
    return ends.join(left, figure, "left").select(
        figure, "cells", F.col("a.row").alias("row0"), F.col("a.col").alias("col0"), F.col("b.row").alias("row1"), F.col("b.col").alias("col1"), F.coalesce("left_over", F.lit(0)).alias("left_over")
    )


def grown_batches(cells: DataFrame, region: str, most: int) -> DataFrame:
    """``region, batch, id``: batches of cells (``id, row, col``) of each region, grown first in first out.

    A batch starts at its region's first unused cell in row order.  Cells are taken from the front of a queue, and their unused
    neighbours join batch and queue in row order; it ends when it has ``most`` cells, which the last neighbours may exceed, or the queue is
    empty.  The order is sequential within a region; its cells stream by in row order, and as a batch reaches at most ``most`` rows below
    its start, only so many rows are held.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((int(g), int(r), int(c), int(i)) for b in batches for g, r, c, i in zip(*(x.to_pylist() for x in b.columns)))
        out: list[tuple[int, int, int]] = []
        held: dict[tuple[int, int], int] = {}
        starts: deque[tuple[int, int]] = deque()
        at, number, ahead = None, 0, next(rows, None)
        while ahead is not None or held:
            if not held:
                at, number, starts = ahead[0], (number if ahead[0] == at else 0), deque()
            while starts and starts[0] not in held:
                starts.popleft()
            top = starts[0][0] if starts else ahead[1]
            while ahead is not None and ahead[0] == at and ahead[1] <= top + most:
                held[ahead[1], ahead[2]] = ahead[3]
                starts.append((ahead[1], ahead[2]))
                ahead = next(rows, None)
            queue, batch = deque([starts[0]]), [held.pop(starts[0])]
            while queue and len(batch) < most:
                r, c = queue.popleft()
                for a, b in STEPS:
                    if (r + a, c + b) in held:
                        queue.append((r + a, c + b))
                        batch.append(held.pop((r + a, c + b)))
            out += [(at, number, i) for i in batch]
            number += 1
            if len(out) >= 10_000:
                yield _batch_rows(out)
                out = []
        if out:
            yield _batch_rows(out)

    ordered = dealt(cells.select(F.col(region).cast("long"), F.col("row").cast("long"), F.col("col").cast("long"), F.col("id").cast("long")), region).sortWithinPartitions(region, "row", "col")
    return ordered.mapInArrow(walk, "region long, batch int, id long")


def _batch_rows(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64()))], names=["region", "batch", "id"])
