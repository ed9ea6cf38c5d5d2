"""Embedding whitening by a tiled covariance.

Vectors become vectors of whole numbers, ``floor(scale * entry)``, packed in as few bytes as they need.  The
covariance is taken over each different vector once.  Vectors are cut into row-blocks and each row-block into
blocks of columns; these are shuffled by row-block, every pair of column blocks (a tile of dimension pairs) is
multiplied where they meet, and products are summed per tile.  Only the assembled matrix, dimensions squared,
comes to the driver, where it is decomposed.  Sums are of whole numbers and exact; vectors are centred by
whole numbers before anything is multiplied, so a large common offset costs no digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import written
from .shared import bounded

#: Whole numbers from here on have no exact double below; vectors that need them take no part.
LIMIT = float(1 << 53)
_WIDTHS = {2: "<i2", 4: "<i4", 8: "<i8"}
#: Sums are kept in two longs, of the high and the low bits of each number.
LOW_BITS = 26
#: Partial tiles of a tile meet in so many tasks before the last one.
SALTS = 16


def _packed(x: np.ndarray) -> pa.Array:
    """Each row of whole numbers as a width byte and its numbers in that width, the least that holds the row."""
    most = np.abs(x).max(axis=1)
    out = np.empty(len(x), object)
    for width, kind in _WIDTHS.items():
        mine = np.flatnonzero((most < 1 << (8 * width - 1)) & (np.equal(out, None)))
        if len(mine):
            raw = np.concatenate([np.full((len(mine), 1), width, np.uint8), np.ascontiguousarray(x[mine].astype(kind)).view(np.uint8).reshape(len(mine), -1)], axis=1)
            out[mine] = [r.tobytes() for r in raw]
    return pa.array(out, pa.binary())


def _unpacked(column: pa.Array, dims: int) -> np.ndarray:
    """The matrix of packed rows of ``dims`` numbers."""
    out = np.empty((len(column), dims), np.int64)
    size = column.cast(pa.large_binary())
    ends = np.frombuffer(size.buffers()[1], np.int64)[size.offset : size.offset + len(size) + 1]
    raw = np.frombuffer(size.buffers()[2], np.uint8) if size.buffers()[2] else np.zeros(0, np.uint8)
    lengths = np.diff(ends)
    for width, kind in _WIDTHS.items():
        mine = np.flatnonzero(lengths == 1 + width * dims)
        if len(mine):
            at = ends[mine][:, None] + 1 + np.arange(width * dims)[None, :]
            out[mine] = raw[at].view(kind)
    return out


def whole_vectors(embeddings: DataFrame, scale: int = 256, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``vec_id, dims, x`` of each row whose vector has only finite entries: x is ``floor(scale * entry)``, packed.

    Null and empty vectors, vectors with a null or non-finite entry, and vectors with a number of 2**53 or
    more are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            values = lists.flatten()
            lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            with np.errstate(invalid="ignore", over="ignore"):
                x = np.floor(scale * values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False))
            fine = np.concatenate([[0], np.cumsum(np.isfinite(x) & (np.abs(x) < LIMIT))])
            starts = np.concatenate([[0], np.cumsum(lengths)])
            usable = (fine[starts[1:]] - fine[starts[:-1]] == lengths) & (lengths > 0)
            for dims in np.unique(lengths[usable]):
                mine = np.flatnonzero(usable & (lengths == dims))
                rows = x[starts[mine][:, None] + np.arange(dims)[None, :]].astype(np.int64)
                yield pa.record_batch([batch.column(0).take(pa.array(mine)), pa.array(np.full(len(mine), dims), pa.int32()), _packed(rows)], names=["vec_id", "dims", "x"])

    entries = bounded(embeddings).select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    return entries.mapInArrow(run, "vec_id long, dims int, x binary")


@dataclass(frozen=True)
class Centre:
    """The number of vectors and the exact sums of their dimensions, as whole part and remainder of the mean."""

    n: int
    sums: tuple[int, ...]

    @property
    def whole(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        return np.array([s % self.n for s in self.sums], np.int64)

    def centred(self, x: np.ndarray, columns: slice = slice(None)) -> np.ndarray:
        return (x - self.whole[columns]) - self.rest[columns] / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of squares of ``n * x - sums``; None beyond a long."""
        near = x - self.whole
        guess = (((near - self.rest / self.n) * self.n) ** 2).sum(axis=1)
        small = guess < float(1 << 61)
        out: list[int | None] = [None] * len(x)
        y = self.n * near[small] - self.rest
        for i, d in zip(np.flatnonzero(small), (y * y).sum(axis=1).tolist()):
            out[i] = d
        for i in np.flatnonzero(~small):
            d = sum((self.n * int(a) - int(r)) ** 2 for a, r in zip(near[i].tolist(), self.rest.tolist()))
            out[i] = d if d < 1 << 63 else None
        return out


def centre_of(fit: DataFrame, dims: int) -> Centre:
    """Number of rows and exact sums; each task hands on one row a dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for batch in batches:
            x = _unpacked(batch.column(0), dims)
            n += len(x)
            high += (x >> LOW_BITS).sum(axis=0)
            low += (x & ((1 << LOW_BITS) - 1)).sum(axis=0)
        if n:
            yield pa.record_batch([pa.array(np.arange(dims), pa.int32()), pa.array(np.full(dims, n)), pa.array(high), pa.array(low)], names=["dim", "n", "high", "low"])

    parts = fit.select("x").mapInArrow(run, "dim int, n long, high long, low long")
    rows = parts.groupBy("dim").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")).orderBy("dim").collect()
    return Centre(rows[0]["n"], tuple((r["high"] << LOW_BITS) + r["low"] for r in rows))


def _summed(tiles: DataFrame, by: list[str]) -> DataFrame:
    """Sums of the tiles (``i, j, salt``, ``tile``) that agree in ``by``; a task holds one running sum of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for i, j, salt, raw in zip(*(c.to_pylist() for c in batch.columns)):
                key = (i, j, salt if "salt" in by else 0)
                part = np.frombuffer(raw, float)
                sums[key] = sums[key] + part if key in sums else part
        yield _tile_batch(sums)

    return tiles.repartition(*by).mapInArrow(run, tiles.schema)


def _tile_batch(sums: dict[tuple, np.ndarray]) -> pa.RecordBatch:
    keys = sorted(sums)
    columns = [pa.array([k[c] for k in keys], pa.int32()) for c in range(3)]
    return pa.record_batch([*columns, pa.array([sums[k].tobytes() for k in keys], pa.binary())], names=["i", "j", "salt", "tile"])


def tiled_covariance(fit: DataFrame, dims: int, centre: Centre, width: int = 32, rows: int = 512) -> np.ndarray:
    """Covariance (divisor n) of the packed vectors ``x`` of ``fit``; tiles are ``width`` by ``width`` dimensions, row-blocks have ``rows`` rows."""
    cuts = [slice(a, min(a + width, dims)) for a in range(0, dims, width)]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        for batch in batches:
            for a in range(0, len(batch), rows):
                x = _unpacked(batch.column(0).slice(a, rows), dims)
                # of one row-block all column blocks have the same width in bytes
                most = int(np.abs(x).max())
                kind = next(k for w, k in _WIDTHS.items() if most < 1 << (8 * w - 1))
                yield pa.record_batch(
                    [pa.array([number] * len(cuts)), pa.array(range(len(cuts)), pa.int32()), pa.array([kind] * len(cuts)), pa.array([x[:, c].astype(kind).tobytes() for c in cuts], pa.binary())],
                    names=["block", "part", "kind", "x"],
                )
                number += 1

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        salt = (context.partitionId() if context else 0) % SALTS
        sums: dict[tuple, np.ndarray] = {}
        at, held = None, {}

        def multiply() -> None:
            for i in held:
                for j in held:
                    if i <= j:
                        tile = (held[i].T @ held[j]).ravel()
                        key = (i, j, salt)
                        sums[key] = sums[key] + tile if key in sums else tile

        for batch in batches:
            for block, part, kind, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if block != at:
                    multiply()
                    at, held = block, {}
                size = cuts[part].stop - cuts[part].start
                held[part] = centre.centred(np.frombuffer(raw, kind).astype(np.int64).reshape(-1, size), cuts[part])
        multiply()
        if sums:
            yield _tile_batch(sums)

    shuffled = fit.select("x").mapInArrow(blocks, "block long, part int, kind string, x binary").repartition("block").sortWithinPartitions("block", "part")
    tiles = shuffled.mapInArrow(products, "i int, j int, salt int, tile binary")
    out = np.zeros((dims, dims))
    for r in _summed(_summed(tiles, ["i", "j", "salt"]), ["i", "j"]).collect():
        a, b = cuts[r["i"]], cuts[r["j"]]
        tile = np.frombuffer(r["tile"], float).reshape(a.stop - a.start, b.stop - b.start) / centre.n
        out[a, b], out[b, a] = tile, tile.T
    return out


@dataclass(frozen=True)
class Whitener:
    """Centre, unit eigenvectors (columns) by falling eigenvalue, eigenvalues, and the covariance's trace."""

    centre: Centre
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates; NaN for components without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, (self.centre.centred(x) @ self.vectors) / np.sqrt(self.values), np.nan)


def decomposed(covariance: np.ndarray, centre: Centre, components: int) -> Whitener:
    """The leading components; eigenvalues that rounding alone could have made count as 0."""
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    trace = float(np.trace(covariance))
    top = np.where(values[order] > max(trace, 0.0) * len(covariance) * np.finfo(float).eps, values[order], 0.0)
    return Whitener(centre, vectors[:, order], top, trace)


def identity_error(fit: DataFrame, dims: int, model: Whitener) -> float:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity, over components with variance; 0 without any."""
    live = np.flatnonzero(model.values > 0)
    if not len(live):
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, squares, n = np.zeros(len(live)), np.zeros((len(live), len(live))), 0
        for batch in batches:
            w = model.whiten(_unpacked(batch.column(0), dims))[:, live]
            sums, squares, n = sums + w.sum(axis=0), squares + w.T @ w, n + len(w)
        if n:
            values = np.concatenate([sums, squares.ravel()])
            yield pa.record_batch([pa.array(np.arange(len(values)), pa.int32()), pa.array(values)], names=["at", "value"])

    found = fit.select("x").mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).orderBy("at").collect()
    values = np.array([r["value"] for r in found]) / model.centre.n
    mean, square = values[: len(live)], values[len(live) :].reshape(len(live), len(live))
    return float(np.abs(square - np.outer(mean, mean) - np.eye(len(live))).max())


def whitened(embeddings: DataFrame, components: int = 4, scale: int = 256, width: int = 32, rows: int = 512, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """One row per usable vector and leading component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    The fit list holds each different whole-number vector once; a vector of which there are many copies counts
    once, and equal rows are made one before they are shuffled.  Every usable row is whitened, copies and rows
    with a null or repeated vec_id each for themselves.  The dimension is the commonest length on the fit list (the
    larger of equals); vectors of another length take no part, nor do those that :func:`whole_vectors` leaves
    out, zero vectors do.  A component without variance (fewer different vectors than components) has a null
    ``whitened`` and ``explained`` 0, null if no dimension varies; vectors of fewer dimensions than components have
    that many components.  ``deviation`` is null where it exceeds a long.  Among equal eigenvalues the order is
    that of the solver.  An empty table, or one without usable vectors, gives no rows; other columns are ignored.
    """
    rows_ = whole_vectors(embeddings, scale, vector, key)
    fit = written(rows_.select("dims", "x").distinct())
    most = fit.groupBy("dims").count().orderBy(F.desc("count"), F.desc("dims")).first()
    ddl = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if most is None:
        return embeddings.sparkSession.createDataFrame([], ddl)
    dims = int(most["dims"])
    fit = fit.where(F.col("dims") == dims)
    centre = centre_of(fit, dims)
    model = decomposed(tiled_covariance(fit, dims, centre, width, rows), centre, components)
    error = identity_error(fit, dims, model)
    explained = [v / model.trace if model.trace > 0 else None for v in model.values.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values)
        for batch in batches:
            x = _unpacked(batch.column(1), dims)
            w = model.whiten(x).ravel()
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(x)), k)))
            deviation = [d for d in centre.deviations(x) for _ in range(k)]
            yield pa.record_batch(
                [
                    ids, pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), pa.array(np.full(len(w), centre.n)), pa.array(deviation, pa.int64()),
                    pa.array(w, mask=np.isnan(w)), pa.array(explained * len(x), pa.float64()), pa.array(np.full(len(w), error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows_.where(F.col("dims") == dims).select("vec_id", "x").mapInArrow(run, ddl)
