"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are sequences of words (runs of letters, digits and non-ASCII
characters; A-Z lower-cased, so punctuation and case do not matter).  Documents that share a seed of
``MIN_MATCH`` words with an item are candidates; how much of the item its shared seeds touch bounds
the tiling from above.  Candidates whose bound reaches the threshold are tiled: the longest common
passage not yet used is marked again and again, found by Karp-Rabin hashes of falling length.  The
share of the item that tiles cover does not depend on their order, so reordered passages count.

While the benchmark has at most ``broadcast_seeds`` seeds, its seeds go to all tasks and documents are
read once and not shuffled.  A larger benchmark is joined to the documents by seed instead; the result is
the same.  There texts are judged once, whatever the number of rows that repeat them, and seeds are salted
by text, as a passage may lie in a large part of all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import documents, keep_rows
from .wordhash import PUNCTUATED, _powers, batches_of_text, mix, shingle_hashes, text_bytes, word_hashes, word_spans

MIN_MATCH = 5
#: Pairs of equal windows that are looked at together; parts that a seed of the shuffled join is salted into.
_PAIRS, SALTS = 1 << 20, 16
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, offsets = text_bytes(column)
    starts, ends, word_offsets = word_spans(raw, offsets, PUNCTUATED)
    return word_hashes(raw, starts, ends), word_offsets


def seeds_of(words: np.ndarray, word_offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seed hashes in text order and each row's offsets; rows of fewer than ``MIN_MATCH`` words have none."""
    seeds, offsets = shingle_hashes(words, word_offsets, MIN_MATCH)
    counts = np.diff(offsets)
    short = np.diff(word_offsets) < MIN_MATCH
    keep = np.repeat(~short, counts)
    return seeds[keep], np.concatenate([[0], np.cumsum(np.where(short, 0, counts))])


def _window_hashes(tokens: np.ndarray, length: int) -> np.ndarray:
    sums = np.zeros(len(tokens) + 1, np.uint64)
    np.cumsum(tokens * _powers(_BASE, len(tokens) + 1)[: len(tokens)], out=sums[1:])
    n = len(tokens) - length + 1
    return (sums[length:] - sums[:n]) * _powers(_INVERSE, len(tokens) + 1)[:n]


def _matches(a: np.ndarray, b: np.ndarray, used_a: np.ndarray, used_b: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """Maximal matches (size, i, j) of unused tokens, of at least ``length``, the longest first."""
    if min(len(a), len(b)) < length:
        return []
    count_a, count_b = (np.concatenate([[0], np.cumsum(u)]) for u in (used_a, used_b))
    free_a = np.flatnonzero(count_a[length:] == count_a[:-length])
    free_b = np.flatnonzero(count_b[length:] == count_b[:-length])
    if not len(free_a) or not len(free_b):
        return []
    hash_a, hash_b = _window_hashes(a, length)[free_a], _window_hashes(b, length)[free_b]
    order = np.argsort(hash_b, kind="stable")
    low, high = np.searchsorted(hash_b[order], hash_a), np.searchsorted(hash_b[order], hash_a, side="right")
    counts = high - low
    firsts, seconds = [], []
    # A text that repeats itself has many pairs of equal windows, and few that could not start earlier.
    at, ends = 0, np.cumsum(counts)
    while at < len(counts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _PAIRS, side="right")))
        some = counts[at:to]
        x = np.repeat(free_a[at:to], some)
        y = free_b[order[np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some) + np.repeat(low[at:to], some)]]
        before = (x > 0) & (y > 0)
        before[before] = (a[x[before] - 1] == b[y[before] - 1]) & ~used_a[x[before] - 1] & ~used_b[y[before] - 1]
        firsts.append(x[~before])
        seconds.append(y[~before])
        at = to
    i, j = np.concatenate(firsts), np.concatenate(seconds)
    size = np.zeros(len(i), np.int64)
    going = np.arange(len(i))
    while len(going):
        x, y = i[going] + size[going], j[going] + size[going]
        ok = (x < len(a)) & (y < len(b))
        going, x, y = going[ok], x[ok], y[ok]
        going = going[(a[x] == b[y]) & ~used_a[x] & ~used_b[y]]
        size[going] += 1
    return sorted(((int(n), int(p), int(q)) for n, p, q in zip(size, i, j) if n >= length), key=lambda m: (-m[0], m[1], m[2]))


def greedy_tiles(a: np.ndarray, b: np.ndarray, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Tiles (size, i, j): pairwise disjoint equal passages of ``a`` and ``b``, the longest taken first."""
    used_a, used_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    tiles: list[tuple[int, int, int]] = []
    length = max(min_match, min(len(a), len(b), 32))
    while True:
        found = _matches(a, b, used_a, used_b, length)
        if found and found[0][0] > 2 * length:
            length = found[0][0]
            continue
        marked = False
        for size, i, j in found:
            if not used_a[i : i + size].any() and not used_b[j : j + size].any():
                used_a[i : i + size] = True
                used_b[j : j + size] = True
                tiles.append((size, i, j))
                marked = True
        if marked and found[-1][0] >= length and len(found) > 1:
            continue
        if length == min_match:
            return tiles
        length = max(min_match, length // 2)


class Items:
    """Benchmark items as word sequences, with a sorted array of their seeds."""

    def __init__(self, ids: list[int | None], column: pa.Array) -> None:
        words, at = words_of(column)
        seeds, seed_at = seeds_of(words, at)
        self.ids = ids
        self.words = [words[at[i] : at[i + 1]] for i in range(len(ids))]
        owner = np.repeat(np.arange(len(ids)), np.diff(seed_at))
        place = np.arange(len(seeds)) - np.repeat(seed_at[:-1], np.diff(seed_at))
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.owner, self.place = seeds[order], owner[order], place[order]

    def judge(self, words: np.ndarray, seeds: np.ndarray, threshold: float) -> list[tuple[int, float, int, int]]:
        """(item row, coverage, number of tiles, longest tile) of the items that a document covers."""
        low, high = np.searchsorted(self.seeds, seeds), np.searchsorted(self.seeds, seeds, side="right")
        hit = np.flatnonzero(high > low)
        if not len(hit):
            return []
        counts = (high - low)[hit]
        at = np.repeat(low[hit], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        owner, place, where = self.owner[at], self.place[at], np.repeat(hit, counts)
        found = []
        for item in np.unique(owner):
            own, mine = self.words[item], owner == item
            touched = np.zeros(len(own) + 1, np.int64)
            np.add.at(touched, place[mine], 1)
            np.add.at(touched, np.minimum(place[mine] + MIN_MATCH, len(own)), -1)
            if np.count_nonzero(np.cumsum(touched)[:-1]) < threshold * len(own):
                continue
            tiles = greedy_tiles(own, self._touched_words(words, np.unique(where[mine])))
            covered = sum(t[0] for t in tiles)
            if covered >= threshold * len(own):
                found.append((int(item), covered / len(own), len(tiles), max(t[0] for t in tiles)))
        return found

    @staticmethod
    def _touched_words(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The words in seeds at ``starts``, a word that equals no other between parts that do not touch."""
        edge = np.zeros(len(words) + 1, np.int64)
        edge[starts] += 1
        np.add.at(edge, starts + MIN_MATCH, -1)
        inside = np.cumsum(edge)[:-1] > 0
        first = inside & ~np.concatenate([[False], inside[:-1]])
        at = np.flatnonzero(inside)
        out = np.empty(len(at) + int(first.sum()), np.uint64)
        gaps = np.cumsum(first[at])
        out[np.arange(len(at)) + gaps] = words[at]
        breaks = np.flatnonzero(first[at]) + np.arange(int(first.sum()))
        out[breaks] = mix(np.arange(len(breaks), dtype=np.uint64) + np.uint64(0xABCDEF0123456789))
        return out


_OUT = ["doc_id", "item_id", "coverage", "n_tiles", "longest_tile"]
_DDL = "doc_id long, item_id long, coverage double, n_tiles int, longest_tile int"


def _record(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()]
    return pa.record_batch([pa.array([r[c] for r in rows], kinds[c]) for c in range(5)], names=_OUT)


def _seed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in batches_of_text(batch.column(1)):
            part = batch.slice(a, b - a)
            seeds, at = seeds_of(*words_of(part.column(1)))
            ids = part.column(0).take(pa.array(np.repeat(np.arange(b - a), np.diff(at))))
            yield pa.record_batch([ids, pa.array(seeds.view(np.int64))], names=["id", "seed"])


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, broadcast_seeds: int = 1_000_000) -> DataFrame:
    """One row per document and benchmark item that it holds: ``doc_id, item_id, coverage, n_tiles, longest_tile``.

    ``coverage`` is the share of the item's words in tiles of at least ``MIN_MATCH`` words, at least
    ``threshold``.  Null and empty texts, and items of fewer than ``MIN_MATCH`` words, match nothing.
    Very long texts are used whole.  Repeated rows of documents or items give a pair for each; ids may be
    null.  Of equally long matches the first in the item, then in the document, is taken.  Empty tables
    give no rows and other columns are ignored.
    """
    items, rows = _items(benchmark), documents(docs)
    if _seed_count(items) > broadcast_seeds:
        texts = lambda df, id_, key: df.where("text is not null").select(id_, F.md5("text").alias(key))
        found = _judged_texts(rows, items, threshold)
        return texts(rows, "doc_id", "r").join(found, "r").join(texts(items, "item_id", "i"), "i").select(*_OUT)
    known = _shared_items(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bank = Items(*known.value)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            yield _record([(ids[r], bank.ids[i], *rest) for r, i, *rest in _judged(batch.column(1), bank, threshold)])

    return rows.mapInArrow(run, _DDL)


def _seed_count(items: DataFrame) -> int:
    words = F.size(F.split(F.coalesce("text", F.lit("")), r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"))
    return items.select(F.sum(words).alias("n")).first()["n"] or 0


def _shared_items(items: DataFrame):
    found = items.toArrow()
    return items.sparkSession.sparkContext.broadcast((found["item_id"].to_pylist(), found["text"].combine_chunks()))


def _judged(texts: pa.Array, bank: Items, threshold: float) -> Iterator[tuple]:
    """(row, item row, coverage, number of tiles, longest tile) of what the texts hold."""
    for a, b in batches_of_text(texts):
        words, at = words_of(texts.slice(a, b - a))
        seeds, seed_at = seeds_of(words, at)
        near = np.searchsorted(bank.seeds, seeds)
        hits = np.zeros(len(seeds), bool)
        inside = near < len(bank.seeds)
        hits[inside] = bank.seeds[near[inside]] == seeds[inside]
        held = np.concatenate([[0], np.cumsum(hits)])
        for r in np.flatnonzero(held[seed_at[1:]] > held[seed_at[:-1]]):
            for found in bank.judge(words[at[r] : at[r + 1]], seeds[seed_at[r] : seed_at[r + 1]], threshold):
                yield (a + int(r), *found)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, broadcast_seeds: int = 1_000_000) -> DataFrame:
    """The rows of ``docs``, with all columns, whose text holds no item as :func:`contaminated_pairs` finds them."""
    items = _items(benchmark)
    if _seed_count(items) > broadcast_seeds:
        found = _judged_texts(documents(docs), items, threshold).select("r").distinct()
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.md5(F.col("text").cast("string")).alias("r"))
        return rows.join(found, "r", "left_anti").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
    known = _shared_items(items)

    def start():
        bank = Items(*known.value)

        def keep(texts: pa.Array) -> np.ndarray:
            clean = np.ones(len(texts), bool)
            clean[[r for r, *_ in _judged(texts, bank, threshold)]] = False
            return clean

        return keep

    return keep_rows(docs, start)


def _judged_texts(rows: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """``r, i, coverage, n_tiles, longest_tile`` of different texts and items, by the MD5 of each, for a benchmark of any size."""
    different = lambda df, key: df.where("text is not null").select(F.md5("text").alias(key), "text").dropDuplicates([key])
    rows, items = different(rows, "r"), different(items, "i")
    seeds = lambda df, id_: df.select(id_, "text").mapInArrow(_seed_rows, "id string, seed long").withColumnRenamed("id", id_)
    salt = F.pmod(F.xxhash64("r"), F.lit(SALTS)).cast("int").alias("salt")
    ours, theirs = seeds(rows, "r").distinct().select("r", "seed", salt), seeds(items, "i").groupBy("i", "seed").agg(F.count("*").alias("times"))
    sizes = theirs.groupBy("i").agg(F.sum("times").alias("n"))
    theirs = theirs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # A place in the item at which a shared seed starts touches MIN_MATCH words, which bounds the tiles.
    shared = ours.join(theirs, ["seed", "salt"]).groupBy("r", "i").agg(F.sum("times").alias("shared"))
    enough = shared.join(sizes, "i").where(F.col("shared") * MIN_MATCH >= threshold * F.col("n")).select("r", "i")
    pairs = enough.join(rows, "r").join(items.withColumnRenamed("text", "item_text"), "i")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r, text, i, item_text in zip(*(c.to_pylist() for c in batch.columns)):
                bank = Items([i], pa.array([item_text]))
                words, at = words_of(pa.array([text]))
                out += [(r, i, *rest) for _, *rest in bank.judge(words, seeds_of(words, at)[0], threshold)]
            columns = zip(*out) if out else [[]] * 5
            kinds = [pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int32()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["r", "i", *_OUT[2:]])

    return pairs.select("r", "text", "i", "item_text").mapInArrow(run, "r string, i string, coverage double, n_tiles int, longest_tile int")
