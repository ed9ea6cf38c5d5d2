"""Points and boxes against the edges of one window, for Arrow batches of windows.

A row is a window of :mod:`.windows`: a polygon's edges there and a list of points or boxes.  A batch is laid out flat, a pair of
point and edge a place, in slices of bounded length, so that memory follows neither windows nor rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql.functions import arrow_udf

#: Pairs that are looked at together.
PAIRS = 1 << 16
#: Bytes of a batch to Python, where the session has not set them.
_BYTES, _SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(df: DataFrame) -> DataFrame:
    """``df``, with the session's batches to Python bounded in bytes unless the user has set a bound."""
    if df.sparkSession.conf.get(_SETTING, None) is None:
        df.sparkSession.conf.set(_SETTING, str(_BYTES))
    return df


def _length(lists: pa.Array) -> np.ndarray:
    return pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)


def _values(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False)


def _lists(values: np.ndarray, length: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(values, kind))


class _Batch:
    """The points of a batch and the edges of their windows."""

    def __init__(self, edges: tuple[pa.Array, ...], places: pa.Array, corner: pa.Array, left: pa.Array, low: pa.Array):
        each, self.count = _length(edges[0]), _length(places)
        self.edges = [_values(e) for e in edges]
        self.row = np.repeat(np.arange(len(self.count)), self.count)
        self.each, self.first = each[self.row], (np.cumsum(each) - each)[self.row]
        self.corner, self.left, self.low = (a.to_numpy(zero_copy_only=False)[self.row] for a in (corner, left, low))

    def slices(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray, list[np.ndarray]]]:
        """Points, where the pairs of each begin, the point of each pair, and the edge's ends ``x0, y0, x1, y1``."""
        ends, a = np.cumsum(self.each), 0
        while a < len(ends):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, "right")))
            n = self.each[a:b]
            start = np.cumsum(n) - n
            edge = np.arange(int(n.sum())) + np.repeat(self.first[a:b] - start, n)
            yield slice(a, b), start, np.repeat(np.arange(a, b), n), [e[edge] for e in self.edges]
            a = b

    def odd(self, start: np.ndarray, of: np.ndarray, ends: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether edges are crossed an odd number of times from the window's corner up and then along to a point, which counts as just right of and above itself."""
        x0, y0, x1, y1 = ends
        left, n = self.left[of], np.zeros(len(of), np.int64)
        i = np.flatnonzero((y0 > y) != (y1 > y))
        across = (x1[i] - x0[i]) * (y[i] - y0[i]) / (y1[i] - y0[i]) + x0[i]
        n[i] += (across > left[i]) & (across <= x[i])
        i = np.flatnonzero((x0 > left) != (x1 > left))
        up = (y1[i] - y0[i]) * (left[i] - x0[i]) / (x1[i] - x0[i]) + y0[i]
        n[i] += (up > self.low[of[i]]) & (up <= y[i])
        return np.add.reduceat(n, start) % 2 == 1

    def chosen(self, keep: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """For each row the places in its list that are kept, and how many."""
        number = np.arange(len(self.row)) - np.repeat(np.cumsum(self.count) - self.count, self.count)
        length = np.bincount(self.row[keep], minlength=len(self.count))
        return _lists(number[keep], length, pa.int32()), length


def held(x0: pa.Array, y0: pa.Array, x1: pa.Array, y1: pa.Array, corner: pa.Array, left: pa.Array, low: pa.Array, xs: pa.Array, ys: pa.Array) -> pa.Array:
    """Which of a list's points lie in the polygon or on its border."""
    batch, x, y = _Batch((x0, y0, x1, y1), xs, corner, left, low), _values(xs), _values(ys)
    keep = np.zeros(len(x), bool)
    for at, start, of, ends in batch.slices():
        a, b, c, d = ends
        px, py = x[of], y[of]
        on = ((c - a) * (py - b) == (d - b) * (px - a)) & (np.minimum(a, c) <= px) & (np.maximum(a, c) >= px) & (np.minimum(b, d) <= py) & (np.maximum(b, d) >= py)
        keep[at] = np.logical_or.reduceat(on, start) | (batch.corner[at] != batch.odd(start, of, ends, px, py))
    return batch.chosen(keep)[0]


def within(x0: pa.Array, y0: pa.Array, x1: pa.Array, y1: pa.Array, corner: pa.Array, left: pa.Array, low: pa.Array, xs: pa.Array, ys: pa.Array, reach: pa.Array) -> pa.Array:
    """Which of a list's points are not farther than ``reach`` from the polygon, and how far, 0 inside."""
    batch, x, y = _Batch((x0, y0, x1, y1), xs, corner, left, low), _values(xs), _values(ys)
    far = np.zeros(len(x))
    for at, start, of, ends in batch.slices():
        a, b, c, d = ends
        px, py, dx, dy = x[of], y[of], c - a, d - b
        along = np.clip((dx * (px - a) + dy * (py - b)) / (dx * dx + dy * dy), 0.0, 1.0)
        ox, oy = a + along * dx - px, b + along * dy - py
        inside = batch.corner[at] != batch.odd(start, of, ends, px, py)
        far[at] = np.where(inside, 0.0, np.sqrt(np.minimum.reduceat(ox * ox + oy * oy, start)))
    keep = far <= reach.to_numpy(zero_copy_only=False)[batch.row]
    chosen, length = batch.chosen(keep)
    return pa.StructArray.from_arrays([chosen, _lists(far[keep], length, pa.float64())], ["at", "far"])


def _part(ends: list[np.ndarray], minx: np.ndarray, miny: np.ndarray, maxx: np.ndarray, maxy: np.ndarray) -> np.ndarray:
    """The strip of a box below an edge; holes and lower borders count negative.

    What edges above the box add is the length of its upper side inside: all or nothing by its left end, changed where edges
    cross it, less what these edges have as strips above it.  An edge's two terms are taken together, which leaves no quotient.
    """
    x0, y0, x1, y1 = ends
    xa, xb, high = np.maximum(np.minimum(x0, x1), minx), np.minimum(np.maximum(x0, x1), maxx), maxy - miny
    with np.errstate(divide="ignore", invalid="ignore"):
        ya, yb = (y0 + (y1 - y0) * (x - x0) / (x1 - x0) for x in (xa, xb))
        below = lambda y: np.where(y < miny, 0.0, np.where(y > maxy, high * high / 2 + high * (y - maxy), (y - miny) * (y - miny) / 2))
        slanted = (xb - xa) * (below(yb) - below(ya)) / (yb - ya)
        top = (x1 - x0) * (maxy - y0) / (y1 - y0) + x0
        crosses = ((y0 > maxy) != (y1 > maxy)) & (top > minx) & (top < maxx)
    level = (xb - xa) * (np.clip(np.where(y0 == y1, y0, ya), miny, maxy) - miny)
    wide = xa < xb
    strip = np.sign(x0 - x1) * np.where(wide, np.where((y0 == y1) | (ya == yb), level, slanted), 0.0)
    over = np.where(wide & ((ya + yb) / 2 > maxy), np.sign(x1 - x0) * (xb - xa), 0.0)
    over = np.where(crosses, np.sign(y1 - y0) * (np.clip(np.where(y1 > y0, x1, x0), minx, maxx) - maxx), over)
    return np.where(wide, strip, 0.0) + high * over


def met(
    x0: pa.Array, y0: pa.Array, x1: pa.Array, y1: pa.Array, corner: pa.Array, left: pa.Array, low: pa.Array, lowx: pa.Array, lowy: pa.Array, highx: pa.Array, highy: pa.Array, area: pa.Array,
) -> pa.Array:
    """Which of a list's boxes the polygon meets: 1 if an edge touches the box, and 2 if its lower left corner is inside; and the shared area if ``area`` is true, else 0."""
    batch, box, area = _Batch((x0, y0, x1, y1), lowx, corner, left, low), [_values(v) for v in (lowx, lowy, highx, highy)], bool(len(area)) and area[0].as_py()
    touched, inside, shared = np.zeros(len(box[0]), bool), np.zeros(len(box[0]), bool), np.zeros(len(box[0]))
    for at, start, of, ends in batch.slices():
        a, b, c, d = ends
        minx, miny, maxx, maxy = (v[of] for v in box)
        inside[at] = batch.corner[at] != batch.odd(start, of, ends, minx, miny)
        near = np.flatnonzero((np.minimum(a, c) <= maxx) & (np.maximum(a, c) >= minx) & (np.minimum(b, d) <= maxy) & (np.maximum(b, d) >= miny))
        e, q = [v[near] for v in ends], [v[near] for v in (minx, miny, maxx, maxy)]
        turns = [(e[2] - e[0]) * (y - e[1]) - (e[3] - e[1]) * (x - e[0]) for x in (q[0], q[2]) for y in (q[1], q[3])]
        touches = (np.minimum.reduce(turns) <= 0) & (np.maximum.reduce(turns) >= 0)
        touched[of[near[touches]]] = True
        if area:
            whole = (box[2][at] - box[0][at]) * (box[3][at] - box[1][at])
            parts = np.bincount(of[near] - at.start, _part(e, *q), at.stop - at.start)
            # the upper left corners only of boxes that an edge touches
            some = np.flatnonzero(touched[at])
            pairs, n = np.flatnonzero(touched[of]), batch.each[at][some]
            upper = inside[at].copy()
            if len(some):
                upper[some] = batch.corner[at][some] != batch.odd(np.cumsum(n) - n, of[pairs], [v[pairs] for v in ends], minx[pairs], maxy[pairs])
            shared[at] = np.where(touched[at], parts, 0.0) + np.where(upper, whole, 0.0)
    keep = touched | inside
    chosen, length = batch.chosen(keep)
    return pa.StructArray.from_arrays([chosen, _lists((touched + 2 * inside)[keep], length, pa.int8()), _lists(shared[keep], length, pa.float64())], ["at", "state", "shared"])


#: What Spark gets of a test.
_RESULTS = {held: "array<int>", within: "struct<at:array<int>,far:array<double>>", met: "struct<at:array<int>,state:array<tinyint>,shared:array<double>>"}


def tested(test: Callable[..., pa.Array], *columns: Column | str) -> Column:
    """A test of this module as a column.

    Not called deterministic, or else a filter on its result goes below it, with a second run of the test.
    """
    return arrow_udf(test, _RESULTS[test]).asNondeterministic()(*columns)
