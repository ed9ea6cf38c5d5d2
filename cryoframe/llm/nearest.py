"""Approximate nearest neighbours with a forest of random-projection trees.

The trees are grown on a bounded sample; every row is then indexed by its leaf in each tree.  A query
walks all trees through one shared priority queue, best margin first, until the leaves it has opened
hold enough rows, and is ranked exactly against the rows of those leaves.  How many are enough is
measured on the table itself: exact neighbours of ``HELD_OUT`` queries are found by comparing them with
all rows, and the leaves that hold them say how far the queue must be walked to meet the asked share.
A row lies in one leaf of every tree and is compared as often as it is met; no query opens fewer than ``OPENED``
rows so counted, which in a table of few rows are all of them.
Leaves are cut into chunks of bounded size by their counted number of rows, so that no task holds a whole
hot leaf, and equal vectors are one entry that keeps as many of its smallest ids as an answer can need.

Only rows of leaves that some query opened are sent anywhere.  The sample that trees are grown on grows
with the table, so that leaves keep their size, up to ``MOST`` vectors (on the driver); in tables of more
than fifty times as many, leaves grow.  Bounds that never grow: that sample and the number of leaves that
follows from it, ``CHUNK`` rows in a chunk and ``ASKED`` queries that meet it in a task, ``HELD_OUT``
queries for the measurement.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded, cut

CHUNK, ASKED = 4096, 16_384
#: Queries that the search is measured on, and the least rows that any query opens, a row counted in every leaf that holds it.
HELD_OUT, OPENED = 256, 12_800
#: Least and greatest number of vectors that trees are grown on; between them a fiftieth of the table.
LEAST, MOST = 20_000, 200_000


class Forest:
    """Trees as flat arrays; ``left`` and ``right`` hold node numbers, or -1 - leaf."""

    def __init__(self, sample: np.ndarray, trees: int, leaf: int, seed: int = 7) -> None:
        self.rng = np.random.default_rng(seed)
        self.normals: list[np.ndarray] = []
        self.offsets: list[float] = []
        self.left: list[int] = []
        self.right: list[int] = []
        self.roots: list[int] = []
        self.leaves = 0
        for _ in range(trees):
            self.roots.append(self._grow(sample, np.arange(len(sample)), leaf))
        dim = sample.shape[1]
        self.normal = np.array(self.normals, np.float32).reshape(-1, dim)
        self.offset = np.array(self.offsets, np.float32)
        self.child = np.array([self.left, self.right], np.int64).reshape(2, -1)
        del self.normals, self.offsets, self.left, self.right

    def _grow(self, sample: np.ndarray, rows: np.ndarray, leaf: int) -> int:
        if len(rows) > leaf:
            for _ in range(4):
                a, b = self.rng.choice(rows, 2, replace=False)
                normal = sample[a] - sample[b]
                length = np.linalg.norm(normal)
                if length == 0:
                    continue
                normal = normal / length
                at = sample[rows] @ normal
                middle = float(np.median(at))
                low = at < middle
                if 0 < low.sum() < len(rows):
                    node = len(self.normals)
                    self.normals.append(normal)
                    self.offsets.append(middle)
                    self.left.append(0)
                    self.right.append(0)
                    self.left[node] = self._grow(sample, rows[low], leaf)
                    self.right[node] = self._grow(sample, rows[~low], leaf)
                    return node
        self.leaves += 1
        return -self.leaves

    def leaf_of(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf numbers, one column for each tree."""
        out = np.empty((len(vectors), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            at = np.full(len(vectors), root, np.int64)
            while (inner := np.flatnonzero(at >= 0)).size:
                node = at[inner]
                side = np.einsum("ij,ij->i", vectors[inner], self.normal[node]) >= self.offset[node]
                at[inner] = self.child[side.astype(np.int64), node]
            out[:, t] = -1 - at
        return out

    def walk(self, query: np.ndarray) -> Iterator[int]:
        """Leaves of all trees in the order of the shared queue."""
        margin = self.normal @ query - self.offset
        queue = [(-np.inf, root) for root in self.roots]
        while queue:
            worst, node = heapq.heappop(queue)
            while node >= 0:
                m = margin[node]
                near, far = (1, 0) if m >= 0 else (0, 1)
                heapq.heappush(queue, (max(worst, abs(m)), int(self.child[far, node])))
                node = int(self.child[near, node])
            yield -1 - node

    def search(self, query: np.ndarray, sizes: np.ndarray, enough: int) -> list[int]:
        """Leaves in the order of the shared queue until they hold ``enough`` rows."""
        opened: list[int] = []
        held = 0
        for leaf in self.walk(query):
            opened.append(leaf)
            held += sizes[leaf]
            if held >= enough:
                break
        return opened


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.float32)


def _ranked(queries: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, row, distance) of the ``k`` nearest rows to each query, all of those that tie included."""
    q_at, r_at, far = [], [], []
    rows = rows.astype(np.float64)
    norm = (rows * rows).sum(axis=1)
    for a in range(0, len(queries), 128):
        block = queries[a : a + 128].astype(np.float64)
        near = norm[None, :] - 2 * block @ rows.T + (block * block).sum(axis=1)[:, None]
        slack = 1e-9 * (1 + np.abs(norm).max() + (block * block).sum(axis=1))
        limit = np.partition(near, k - 1, axis=1)[:, k - 1] if near.shape[1] > k else np.full(len(block), np.inf)
        i, j = np.nonzero(near <= (limit + slack)[:, None])
        total = np.zeros(len(i))
        for d in range(rows.shape[1]):
            step = block[i, d] - rows[j, d]
            total += step * step
        q_at.append(i + a)
        r_at.append(j)
        far.append(np.sqrt(total))
    return np.concatenate(q_at), np.concatenate(r_at), np.concatenate(far)


def _enough(forest: Forest, sizes: np.ndarray, near: list[tuple[np.ndarray, np.ndarray]], recall: float) -> int:
    """Rows to open so that the share ``recall`` of known neighbours is met.

    ``near`` has each query's vector and its neighbours' leaves, one column for each tree; a query is walked until all of its are met.
    """
    needed: list[int] = []
    for query, leaves in near:
        holds: dict[int, list[int]] = {}
        for i, row in enumerate(leaves.tolist()):
            for x in row:
                holds.setdefault(x, []).append(i)
        missing, held = set(range(len(leaves))), 0
        for leaf in forest.walk(query):
            for i in holds.get(leaf, ()):
                if i in missing:
                    missing.remove(i)
                    needed.append(held + 1)
            if not missing:
                break
            held += int(sizes[leaf])
    needed.sort()
    return needed[max(0, int(np.ceil(recall * len(needed))) - 1)] if needed else 1


def _known(indexed: DataFrame, asked: np.ndarray, ids: list[int], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The queries ``asked`` with the leaves of their ``k`` nearest rows among all of ``indexed``."""
    held = indexed.sparkSession.sparkContext.broadcast(asked)

    def run(batches):
        best = None
        for batch in batches:
            i, j, far = _ranked(held.value, _matrix(batch.column(0)), k + 1)
            found = pa.table([pa.array(i), *[batch.column(c).take(pa.array(j)) for c in (1, 2)], pa.array(far)], names=["q", "ids", "leaves", "score"])
            found = found if best is None else pa.concat_tables([best, found])
            q = found["q"].to_numpy()
            order = np.lexsort((found["score"].to_numpy(), q))
            q = q[order]
            best = found.take(pa.array(order[np.arange(len(q)) - np.searchsorted(q, q) <= k]))
        if best is not None:
            yield from best.to_batches()

    found = indexed.mapInArrow(run, "q long, ids array<long>, leaves array<long>, score double")
    best = Window.partitionBy("q").orderBy("score", "ids")
    found = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).orderBy("q", "n").collect()
    near: list[list] = [[] for _ in ids]
    for r in found:
        near[r["q"]] += [r["leaves"] for i in r["ids"] if i != ids[r["q"]]]
    return [(query, np.array(leaves[:k], np.int64)) for query, leaves in zip(asked, near) if leaves]


def nearest_neighbours(
    vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding",
    k: int = 10, trees: int = 16, leaf: int = 256, search: int | None = None, sample: int | None = None, recall: float = 0.95, complete: bool = False,
) -> DataFrame:
    """The ``k`` nearest rows found for each query row: ``query_id, rank, vec_id, score``.

    ``is_query`` marks query rows; candidates are all rows but the query's own, and ``score`` is the
    Euclidean distance in double precision, ties in favour of the smaller id.

    Each query is compared with the rows of the leaves it opens until these hold ``search`` rows, a row
    counted in every leaf that holds it.  Without ``search`` it is the least number that finds the share
    ``recall`` of the exact neighbours of up to ``HELD_OUT`` of the queries, and ``OPENED`` at least.  Trees are grown on ``sample``
    vectors; without it on a fiftieth of the table, within ``LEAST`` and ``MOST``.  ``complete`` compares every query with every row, without a forest.

    Rows take no part, neither as query nor as candidate, if the id is null or if the vector is null,
    empty, all zero, holds null or non-finite components or has not the commonest length.  Rows that
    repeat an id with an equal vector count once.  An empty table, or one without queries, gives no rows; other
    columns are ignored.
    """
    spark = vectors.sparkSession
    v = F.col("v")
    number = "double" if vectors.schema[vector_col].dataType.simpleString() == "array<double>" else "float"
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = bounded(vectors).select(F.col(id_col).cast("long").alias("vid"), F.col(vector_col).cast(f"array<{number}>").alias("v"), is_query.alias("asks"))
    rows = rows.where(F.col("vid").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    dim = lengths[0]["n"] if lengths else 0
    rows = rows.where(F.size("v") == dim)

    order = Window.partitionBy("v").orderBy("vid")
    distinct = rows.dropDuplicates(["vid", "v"]).select("vid", "v")
    entries = distinct.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    entries = cut(entries.groupBy("v").agg(F.sort_array(F.collect_list("vid")).alias("ids")))
    total = entries.count()
    queries = cut(rows.where("asks").select(F.col("vid").alias("qid"), F.col("v").alias("q")).dropDuplicates())
    n_queries = queries.count()
    one_leaf = Forest(np.zeros((0, max(dim, 1)), np.float32), 1, 1)

    def indexed_by(grown: Forest) -> tuple[DataFrame, np.ndarray]:
        """All entries with their leaves, and the number of rows in each leaf."""
        forest = spark.sparkContext.broadcast(grown)

        def index(batches):
            for batch in batches:
                leaves = forest.value.leaf_of(_matrix(batch.column(0)))
                flat = pa.ListArray.from_arrays(np.arange(0, leaves.size + 1, leaves.shape[1], dtype=np.int32), leaves.ravel())
                yield pa.record_batch([*batch.columns, flat], names=["v", "ids", "leaves"])

        indexed = entries.mapInArrow(index, f"v array<{number}>, ids array<long>, leaves array<long>")
        if grown is one_leaf:
            return indexed, np.array([total])
        indexed = cut(indexed)
        counts = np.zeros(grown.leaves, np.int64)
        for r in indexed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect():
            counts[r["leaf"]] = r["count"]
        return indexed, counts

    grown, enough = one_leaf, total
    if not complete and total:
        sample = sample or min(MOST, max(LEAST, total // 50))
        drawn = entries.select("v").orderBy(F.xxhash64("v"), "v").limit(sample).toPandas()["v"]
        grown = Forest(np.array(drawn.tolist(), np.float32).reshape(-1, dim), trees, max(8, leaf * len(drawn) // total))
    indexed, counts = indexed_by(grown)
    if grown is not one_leaf:
        enough = search
        if search is None:
            asked = queries.orderBy(F.xxhash64("qid", "q"), "qid", "q").limit(HELD_OUT).toPandas()
            near = _known(indexed, np.array(asked["q"].tolist()), asked["qid"].tolist(), k) if len(asked) else []
            enough = max(OPENED, _enough(grown, counts, near, recall))
    forest, sizes = spark.sparkContext.broadcast(grown), spark.sparkContext.broadcast(counts)

    def walk(batches):
        for batch in batches:
            opened = [forest.value.search(q, sizes.value, enough) for q in _matrix(batch.column(1))] if len(batch) else []
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(opened, pa.list_(pa.int64()))], names=["qid", "q", "leaves"])

    walked = cut(queries.mapInArrow(walk, f"qid long, q array<{number}>, leaves array<long>"))
    opened = np.zeros(len(counts), bool)
    for r in walked.select(F.explode("leaves").alias("leaf")).distinct().collect():
        opened[r["leaf"]] = True
    wanted = spark.sparkContext.broadcast(opened)

    def probe(batches):
        for batch in batches:
            leaves = batch.column(2).to_numpy()
            pieces = -(-sizes.value[leaves] // CHUNK)
            at = np.repeat(np.arange(len(leaves)), pieces)
            chunk = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            yield pa.record_batch([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(leaves[at]), pa.array(chunk.astype(np.int64))], names=["qid", "q", "leaf", "chunk"])

    parts = max(1, -(-n_queries // ASKED))
    probes = walked.select("qid", "q", F.explode("leaves").alias("leaf")).mapInArrow(probe, f"qid long, q array<{number}>, leaf long, chunk long").withColumn("part", F.pmod(F.xxhash64("qid"), F.lit(parts)))

    def chunked(batches):
        for batch in batches:
            batch = batch.filter(pa.array(wanted.value[batch.column(2).to_numpy()]))
            leaf = batch.column(2).to_numpy()
            salt = batch.column(3).to_numpy()
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(salt % np.maximum(1, -(-sizes.value[leaf] // CHUNK)))], names=["v", "ids", "leaf", "chunk"])

    salt = F.abs(F.xxhash64("v") % 1_000_003)
    held = indexed.select("v", "ids", F.explode("leaves").alias("leaf"), salt.alias("salt")).mapInArrow(chunked, f"v array<{number}>, ids array<long>, leaf long, chunk long")
    held = held.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))

    def rank(asked: pa.Table, rows: pa.Table) -> pa.Table:
        schema = pa.schema([("qid", pa.int64()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())])
        if not len(asked) or not len(rows):
            return schema.empty_table()
        i, j, far = _ranked(_matrix(asked["q"]), _matrix(rows["v"]), k + 1)
        qid = asked["qid"].to_numpy()[i]
        return pa.table([pa.array(qid), rows["ids"].combine_chunks().take(pa.array(j)), pa.array(far)], schema=schema)

    found = probes.groupBy("leaf", "chunk", "part").cogroup(held.groupBy("leaf", "chunk", "part")).applyInArrow(rank, "qid long, ids array<long>, score double")
    near = found.select(F.col("qid").alias("query_id"), F.explode("ids").alias("vec_id"), "score").where("query_id <> vec_id").distinct()
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
