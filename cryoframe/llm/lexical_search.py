"""Ranked lexical search: WAND on document shards.

Documents become rows of the queries' terms that they hold, with how often, in one pass that also counts what the
weights need.  A task reads its part of that table shard by shard; a shard is bounded by its postings, and
gets an inverted index of its own.  In a shard each query walks the posting lists of its terms: from the
greatest impact that each term has there it finds the pivot, the first document that could reach the
query's worst kept score, and all documents before it are skipped.  What a query has kept goes from shard to
shard of a task; the ten of each task are merged by a window.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import written
from .shared import bounded

#: ASCII letters and digits and all bytes beyond ASCII make terms; letters are lower-cased, other bytes part.
_TERM_BYTES = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()
#: Bytes of query texts that are searched together, and postings of a shard at most.
BLOCK_BYTES, SHARD_POSTINGS = 8 << 20, 4 << 20


def terms_of(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased."""
    return text.translate(_TERM_BYTES).split()


def forward_index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, terms, counts``: for each document that holds a term, how many it has, and those of the vocabulary.

    Each task adds one row that ``sums`` marks: the documents with a term (``doc_id``), all their terms (``n``), and
    in how many documents (``counts``) each of ``terms`` is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = vocabulary.get
        held: Counter = Counter()
        docs_, total = 0, 0
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
                words = terms_of(text.as_py() or b"")
                if not words:
                    continue
                docs_, total = docs_ + 1, total + len(words)
                known = {i: c for w, c in Counter(words).items() if (i := find(w)) is not None}
                held.update(known.keys())
                if known:
                    rows.append((False, doc, len(words), list(known), list(known.values())))
            if rows:
                yield _index_batch(rows)
        if docs_:
            yield _index_batch([(True, docs_, total, list(held), list(held.values()))])

    return docs.mapInArrow(run, "sums boolean, doc_id long, n long, terms array<int>, counts array<long>")


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["sums", "doc_id", "n", "terms", "counts"])


@dataclass(frozen=True)
class Statistics:
    """Documents with a term, all terms of them, and the documents that hold each term of the vocabulary."""

    documents: int
    terms: int
    held: dict[int, int]

    def weight(self, term: int) -> int:
        return math.floor(1000 * math.log((2 * self.documents + 2) / (2 * self.held.get(term, 0) + 1)))


def collected_statistics(index: DataFrame) -> Statistics:
    """Sums of the marked rows; what comes to the driver is one row a term of the vocabulary."""
    parts = index.where("sums")
    total = parts.agg(F.sum("doc_id").alias("documents"), F.sum("n").alias("terms")).first()
    held = parts.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy("t.terms").agg(F.sum("t.counts").alias("n")).collect()
    return Statistics(total["documents"] or 0, total["terms"] or 0, {r["terms"]: r["n"] for r in held})


class Shard:
    """Inverted index of some documents: of each term the documents that hold it, ascending, and its impact in each."""

    def __init__(self, ids: list, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray, owners: np.ndarray, statistics: Statistics) -> None:
        self.ids = ids
        if int(sizes.max(initial=0)) * 75 * statistics.documents >= 1 << 63:
            m = np.array([25 + 75 * int(n) * statistics.documents // statistics.terms for n in sizes], np.int64)
        else:
            m = 25 + (75 * sizes * statistics.documents) // statistics.terms
        impacts = (1_000_000_000 * counts) // (1000 * counts + 8 * m[owners])
        order = np.argsort(terms, kind="stable")
        terms, self.docs, self.impacts = terms[order], owners[order], impacts[order]
        self.starts = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])) if len(terms) else np.zeros(0, np.int64)
        self.place = {int(t): i for i, t in enumerate(terms[self.starts])}
        self.ends = np.concatenate([self.starts[1:], [len(terms)]]) if len(terms) else self.starts
        self.most = np.maximum.reduceat(self.impacts, self.starts) if len(terms) else self.starts
        self.lists: dict[int, tuple[list[int], list[int], int]] = {}

    def postings(self, term: int) -> tuple[list[int], list[int], int] | None:
        """Documents, impacts and the greatest impact of a term."""
        if term not in self.place:
            return None
        if term not in self.lists:
            i = self.place[term]
            part = slice(self.starts[i], self.ends[i])
            self.lists[term] = (self.docs[part].tolist(), self.impacts[part].tolist(), int(self.most[i]))
        return self.lists[term]


def _rank(score: int, doc: int | None) -> tuple:
    """Greater is better: higher scores, then smaller ids, null last."""
    return (score, doc is not None, -doc if doc is not None else 0)


def search_shard(shard: Shard, query: list[tuple[int, int]], kept: list[tuple], k: int) -> int:
    """WAND: puts the best documents of the shard for ``query`` (term, weight) into the heap ``kept``; returns how many were scored."""
    cursors = []
    for term, weight in query:
        if weight > 0 and (found := shard.postings(term)) is not None:
            docs, impacts, most = found
            # current document, greatest score, place, documents, impacts, weight
            cursors.append([docs[0], most * weight, 0, docs, impacts, weight])
    ids, scored = shard.ids, 0
    order = lambda c: c[0]
    cursors.sort(key=order)
    least = kept[0][0] if len(kept) == k else 1
    while cursors:
        bound = 0
        for at, cursor in enumerate(cursors):
            bound += cursor[1]
            if bound >= least:
                break
        else:
            return scored
        pivot = cursor[0]
        if cursors[0][0] == pivot:
            score, moved = 0, 0
            for c in cursors:
                if c[0] != pivot:
                    break
                moved += 1
                score += c[4][c[2]] * c[5]
                c[2] += 1
                c[0] = c[3][c[2]] if c[2] < len(c[3]) else -1
            scored += 1
            if score >= least:
                entry = _rank(score, ids[pivot])
                if len(kept) < k:
                    heappush(kept, entry)
                elif entry > kept[0]:
                    heapreplace(kept, entry)
                if len(kept) == k:
                    least = kept[0][0]
        else:
            # documents before the pivot cannot reach the heap: all cursors before it jump there
            moved = at
            for c in cursors[:at]:
                if c[0] < pivot:
                    c[2] = bisect_left(c[3], pivot, c[2])
                    c[0] = c[3][c[2]] if c[2] < len(c[3]) else -1
        if any(c[0] < 0 for c in cursors[:moved]):
            cursors = [c for c in cursors if c[0] >= 0]
        cursors.sort(key=order)
    return scored


def _shards(batches: Iterator[pa.RecordBatch], statistics: Statistics, most: int) -> Iterator[Shard]:
    """Shards of ``(doc_id, n, terms, counts)`` rows with about ``most`` postings at most, one document at least."""
    ids: list = []
    sizes, terms, counts, owners, total = [], [], [], [], 0

    def done() -> Shard:
        return Shard(ids, *(np.concatenate(p) for p in (sizes, terms, counts, owners)), statistics)

    for batch in batches:
        for a in range(0, len(batch), 1024):
            part = batch.slice(a, 1024)
            lengths = part.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            owners.append(np.repeat(np.arange(len(ids), len(ids) + len(part)), lengths))
            ids += part.column(0).to_pylist()
            sizes.append(part.column(1).to_numpy())
            terms.append(part.column(2).flatten().to_numpy())
            counts.append(part.column(3).flatten().to_numpy())
            total += int(lengths.sum())
            if total >= most:
                yield done()
                ids, sizes, terms, counts, owners, total = [], [], [], [], [], 0
    if ids:
        yield done()


def search_block(index: DataFrame, queries: list[list[tuple[int, int]]], statistics: Statistics, k: int, postings: int) -> DataFrame:
    """``query, doc_id, score``: of each task the best ``k`` documents for each query of (term, weight)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: list[list[tuple]] = [[] for _ in queries]
        for shard in _shards(batches, statistics, postings):
            for query, heap in zip(queries, heaps):
                search_shard(shard, query, heap, k)
        rows = [(q, -d if known else None, score) for q, heap in enumerate(heaps) for score, known, d in heap]
        yield pa.record_batch([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], names=["query", "doc_id", "score"])

    return index.where("not sums").select("doc_id", "n", "terms", "counts").mapInArrow(run, "query int, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, block_bytes: int = BLOCK_BYTES, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """``item_id, rank, doc_id, score``: of each item the ``k`` documents of highest score above 0, equal scores by ascending doc_id.

    Different query texts are searched once, in blocks of about ``block_bytes`` that the driver holds one after the
    other; each block reads all documents.  A text is used whole, however long.  Null texts and texts
    without a term find nothing and are not found.  Rows that repeat a doc_id count and rank as
    documents of their own, a null doc_id comes last among equals; rows that repeat item_id and text are one
    item, an item_id with several texts gets a ranking for each.  Empty tables give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    texts = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    different = asked.select("text").distinct()
    size = different.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes)
    ddl = "item_id long, rank int, doc_id long, score long"
    out = spark.createDataFrame([], ddl)
    for b in range(blocks):
        found = [r["text"] for r in different.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).collect()]
        words = [Counter(terms_of(t.encode())) for t in found]
        vocabulary = {w: i for i, w in enumerate(sorted(set().union(*words)))} if words else {}
        if not vocabulary:
            continue
        index = written(forward_index(texts, vocabulary))
        statistics = collected_statistics(index)
        if not statistics.documents:
            return out
        weights = {w: statistics.weight(i) for w, i in vocabulary.items()}
        queries = [[(vocabulary[w], weights[w] * times) for w, times in counts.items()] for counts in words]
        best = search_block(index, queries, statistics, k, shard_postings)
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        numbers = spark.createDataFrame(list(enumerate(found)), "query int, text string")
        hits = ranked.join(F.broadcast(numbers), "query").join(asked, "text").select("item_id", "rank", "doc_id", "score")
        out = hits if blocks == 1 else out.unionByName(hits)
    return out
