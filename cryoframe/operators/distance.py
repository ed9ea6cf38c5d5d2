"""Exact distances inside figures, and the ridges of these distances.

The square of a cell's distance to the nearest cell outside is found in two steps that need no figure whole: runs of cells
in each column give the distance up or down, and along each run of cells in a row the least of the parabolas over these is
taken.  Columns and rows are dealt to tasks; a task holds one run of one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .edges import dealt


def least_squares(up: np.ndarray) -> np.ndarray:
    """For a run of cells with distances ``up`` in their columns: squared distance of each to the nearest cell outside, the cells before and after the run included."""
    n = len(up)
    height = np.concatenate([[0], up.astype(np.int64) ** 2, [0]])
    if n <= 48:
        at = np.arange(n + 2)
        return ((at[1:-1, None] - at[None, :]) ** 2 + height[None, :]).min(axis=1)
    # lower envelope: parabolas by their corner, and where each begins to be the least
    corners, begins = [0], [-np.inf]
    for q in range(1, n + 2):
        while True:
            p = corners[-1]
            x = ((height[q] + q * q) - (height[p] + p * p)) / (2 * (q - p))
            if x > begins[-1]:
                break
            corners.pop()
            begins.pop()
        corners.append(q)
        begins.append(x)
    own = np.asarray(corners)[np.searchsorted(begins, np.arange(1, n + 1), side="right") - 1]
    return (np.arange(1, n + 1) - own) ** 2 + height[own]


def distances(cells: DataFrame, key: str) -> DataFrame:
    """``key, row, col, square, far``: of each cell of a figure (``key`` a long) the distance of its centre to the nearest centre outside, and its exact square.

    Cells that are not in the figure are outside, also beyond its bounds.  Repeated cells count once.
    """
    unique = cells.select(F.col(key).cast("long").alias(key), F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col")).distinct()
    column = Window.partitionBy(key, "col")
    runs = unique.withColumn("_run", F.col("row") - F.row_number().over(column.orderBy("row")))
    run = Window.partitionBy(key, "col", "_run")
    up = runs.withColumn("up", F.least(F.col("row") - F.min("row").over(run), F.max("row").over(run) - F.col("row")) + 1).select(key, "row", "col", "up")

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def squares(table: np.ndarray) -> pa.RecordBatch:
            breaks = np.flatnonzero((table[1:, 0] != table[:-1, 0]) | (table[1:, 1] != table[:-1, 1]) | (table[1:, 2] != table[:-1, 2] + 1)) + 1
            found = np.concatenate([least_squares(part) for part in np.split(table[:, 3], breaks)])
            return pa.record_batch([*(pa.array(table[:, c]) for c in range(3)), pa.array(found)], names=[key, "row", "col", "square"])

        for batch in batches:
            if not len(batch):
                continue
            table = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            # the last run may go on in the next batch
            table = np.concatenate([*held, table])
            ends = np.flatnonzero((table[1:, 0] != table[:-1, 0]) | (table[1:, 1] != table[:-1, 1]) | (table[1:, 2] != table[:-1, 2] + 1))
            last = ends[-1] + 1 if len(ends) else 0
            if last:
                yield squares(table[:last])
            held = [table[last:]]
        if held and len(held[0]):
            yield squares(held[0])

    dealt_rows = dealt(up, key, "row").sortWithinPartitions(key, "row", "col")
    found = dealt_rows.mapInArrow(along, f"{key} long, row long, col long, square long")
    return found.withColumn("far", F.sqrt(F.col("square").cast("double")))


#: Half of the eight directions; the others are opposite.
AXES = [(0, 1), (1, 0), (1, 1), (1, -1)]


def ridges(found: DataFrame, key: str) -> DataFrame:
    """The medial axis: cells of :func:`distances` where along one of four axes no neighbour is farther from the border and one is nearer."""
    spots = [(i * s, j * s) for i, j in AXES for s in (1, -1)]
    sent = F.explode(F.array(F.struct(F.lit(-1).alias("k"), F.col("row").alias("r"), F.col("col").alias("c")), *[F.struct(F.lit(k).alias("k"), (F.col("row") + i).alias("r"), (F.col("col") + j).alias("c")) for k, (i, j) in enumerate(spots)]))
    around = found.select(key, "square", sent.alias("o")).groupBy(key, F.col("o.r").alias("row"), F.col("o.c").alias("col")).agg(
        F.max(F.when(F.col("o.k") == -1, F.col("square"))).alias("square"), *[F.coalesce(F.max(F.when(F.col("o.k") == k, F.col("square"))), F.lit(0)).alias(f"_{k}") for k in range(8)]
    )
    crest = " or ".join(f"(_{2 * a} <= square and _{2 * a + 1} <= square and (_{2 * a} < square or _{2 * a + 1} < square))" for a in range(4))
    return around.where(f"square is not null and ({crest})").select(key, "row", "col", "square", F.sqrt(F.col("square").cast("double")).alias("far"))
