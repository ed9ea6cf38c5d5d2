"""MinHash near-duplicate groups by tensored banding.

Two small collections of groups of ``DEPTH`` minhashes are drawn.  Every pair (A_i, B_j) of groups,
one from each collection, is a table key, so ``groups ** 2`` tables of ``2 * DEPTH`` hashes cost only
``2 * groups * DEPTH`` minhashes.  The number of groups follows from the similarity and the rate at which
links may miss all tables (:func:`groups_for`).  With the defaults a pair of Jaccard similarity 0.85 misses
all 49 tables with probability 2.6e-4 and one of 0.9 with 4e-6; nothing after the tables loses a link.

Texts with equal shingle sets are one class, compared once, whatever their number.  In a bucket of a
table every class whose minhashes agree well enough is first compared with the bucket's first one, on full
sets, and where that leaves several components with one that the bucket draws.  This gathers crowds of copies,
so that few pairs are left of them; what fails here is not lost.  All classes of buckets that then still hold
several components go on by exact prefixes: of the shingles of a class, the rarest first, so many are
taken that two classes of the asked similarity must share one of them.  Similar texts that are not linked
differ in their rare shingles and do not meet, so a bucket full of them stays cheap.  Of classes that meet at
a shingle, one-bit minhashes, which lose a link of just the asked similarity once in 100,000 pairs, keep
those that are far apart from being read; the others are compared on full sets.  No group is gathered in one
task.  An exact run takes all classes through the prefixes, and asks no bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .shared import cut, documents
from .wordhash import batches_of_text, shingle_hashes, text_bytes, word_hashes, word_spans

#: Minhashes in a group; one-bit minhashes; cells of the counts that order shingles by rarity, as a power of two.
DEPTH, BITS, CELLS = 2, 1024, 20
#: The rates at which a pair of exactly the asked similarity may miss all tables, and be held far apart by its bits.
MISS, BITS_MISS = 3e-4, 1e-5
_rng = np.random.default_rng(20240608)
_BIT_ADD = _rng.integers(0, 1 << 32, BITS, dtype=np.uint32)
_BIT_MULTIPLY = _rng.integers(0, 1 << 31, BITS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def groups_for(numerator: int, denominator: int, miss: float = MISS) -> int:
    """The fewest groups in each collection for which a pair of this similarity misses all tables at most at rate ``miss``; 7 at 0.85."""
    same = numerator / denominator
    if not 0 < same <= 1:
        raise ValueError("the similarity must lie above 0 and not above 1")
    groups = 1
    while 1 - (1 - (1 - same**DEPTH) ** groups) ** 2 > miss:
        groups += 1
    return groups


@lru_cache
def bits_for(numerator: int, denominator: int, miss: float = BITS_MISS) -> int:
    """The number of differing bits that a pair of this similarity exceeds with a probability of at most ``miss``; 115 at 0.85."""
    share, above = (1 - numerator / denominator) / 2, 0.0
    for k in range(BITS, -1, -1):
        above += comb(BITS, k) * share**k * (1 - share) ** (BITS - k)
        if above > miss:
            return k
    return 0


@lru_cache
def _minhashes(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    return rng.integers(0, 1 << 63, hashes, dtype=np.uint64), rng.integers(0, 1 << 63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_SKETCH = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("sketch", pa.list_(pa.int32()))])
SKETCH_DDL = "doc_id long, mark long, n_shingles long, digest binary, sketch array<int>"


def _shingles(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    raw, offsets = text_bytes(column)
    starts, ends, word_offsets = word_spans(raw, offsets)
    return shingle_hashes(word_hashes(raw, starts, ends), word_offsets, width)


def sketches_of(rows_of: pa.RecordBatch, width: int, n_hashes: int) -> Iterator[pa.RecordBatch]:
    """Sketches of a batch of (text, doc_id, mark)."""
    texts = rows_of.column(0)
    add, multiply = _minhashes(n_hashes)
    for a, b in batches_of_text(texts):
        hashes, offsets = _shingles(texts.slice(a, b - a), width)
        rows = b - a
        sizes, digests = np.zeros(rows, np.int64), [b""] * rows
        for r in range(rows):
            if offsets[r + 1] > offsets[r]:
                own = np.unique(hashes[offsets[r] : offsets[r + 1]])
                sizes[r], digests[r] = len(own), blake2b(own.tobytes(), digest_size=16).digest()
        full = np.flatnonzero(np.diff(offsets) > 0)
        lows = np.zeros((rows, n_hashes), dtype=np.int32)
        for k in range(n_hashes if len(full) else 0):
            least = np.minimum.reduceat((hashes ^ add[k]) * multiply[k], offsets[full])
            lows[full, k] = (least >> np.uint64(16)).astype(np.uint32).view(np.int32)
        sketch = pa.ListArray.from_arrays(np.arange(0, (rows + 1) * n_hashes, n_hashes, dtype=np.int32), lows.ravel())
        yield pa.record_batch([rows_of.column(1).slice(a, rows), rows_of.column(2).slice(a, rows), pa.array(sizes), pa.array(digests, pa.binary()), sketch], schema=_SKETCH)


def marked(docs: DataFrame) -> DataFrame:
    """text, doc_id and a 64-bit ``mark`` of the text, which together with doc_id names a row."""
    return documents(docs).select("text", "doc_id", F.xxhash64("text").alias("mark"))


def sketch_documents(docs: DataFrame, width: int, n_hashes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from sketches_of(batch, width, n_hashes)

    return marked(docs).mapInArrow(run, SKETCH_DDL)


def _group_key(sketch: Column, first: int) -> Column:
    return F.xxhash64(F.lit(first), *[sketch[first + d] for d in range(DEPTH)])


def _groups(sketch: Column, collection: int, groups: int) -> Column:
    return F.array(*[_group_key(sketch, collection * groups * DEPTH + g * DEPTH) for g in range(groups)])


def _bits_differ(a: Column, b: Column) -> Column:
    total = F.lit(0)
    for k in range(BITS // 64):
        total = total + F.bit_count(a[k].bitwiseXOR(b[k]))
    return total


def _bit_sketches(texts: DataFrame, width: int) -> DataFrame:
    """``vertex`` and ``BITS`` one-bit minhashes as an array of longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in batches_of_text(batch.column(1)):
                hashes, offsets = _shingles(batch.column(1).slice(a, b - a), width)
                full = np.flatnonzero(np.diff(offsets) > 0)
                bits = np.zeros((b - a, BITS), np.uint8)
                low = (hashes >> np.uint64(32)).astype(np.uint32)
                for k in range(BITS if len(full) else 0):
                    least = np.minimum.reduceat((low ^ _BIT_ADD[k]) * _BIT_MULTIPLY[k], offsets[full])
                    bits[full, k] = least * np.uint32(0x9E3779B1) >> np.uint32(31)
                words = np.packbits(bits, axis=1).view(np.int64).ravel()
                lists = pa.ListArray.from_arrays(np.arange(0, len(words) + 1, BITS // 64, dtype=np.int32), words)
                yield pa.record_batch([batch.column(0).slice(a, b - a), lists], names=["vertex", "bits"])

    return texts.select("vertex", "text").mapInArrow(run, "vertex long, bits array<long>")


def _agreements(a: Column, b: Column, n_hashes: int) -> Column:
    total = F.lit(0)
    for k in range(n_hashes):
        total = total + (a[k] == b[k]).cast("int")
    return total


def _sizes_allow(numerator: int, denominator: int) -> Column:
    return F.lit(denominator) * F.least("x_n", "y_n") >= F.lit(numerator) * F.greatest("x_n", "y_n")


def _cell_counts(texts: DataFrame, width: int) -> np.ndarray:
    """How often the shingles of all sets fall in each of ``2 ** CELLS`` cells; its size does not grow with the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in batches_of_text(batch.column(0)):
                hashes, offsets = _shingles(batch.column(0).slice(a, b - a), width)
                own = [np.unique(hashes[offsets[r] : offsets[r + 1]]) for r in range(b - a)]
                cells, n = np.unique(np.concatenate(own) >> np.uint64(64 - CELLS), return_counts=True)
                yield pa.record_batch([pa.array(cells.astype(np.int64)), pa.array(n)], names=["cell", "n"])

    found = texts.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << CELLS, np.uint32)
    counts[found["cell"].to_numpy()] = np.minimum(found["n"].to_numpy(), 0xFFFFFFFF)
    return counts


def _prefixes(texts: DataFrame, numerator: int, denominator: int, width: int) -> DataFrame:
    """``vertex, shingle, place, short``: the rarest shingles of each set, of which two sets of the asked similarity share at least one.

    Of n shingles a linked set shares at least ``numerator / denominator`` * n, so all but one of these can be
    left out.  With a set that is not smaller it shares at least 2 * numerator / (numerator + denominator) * n,
    and ``short`` marks the shingles that are then enough.  ``place`` counts from 0 in the order of rarity: that
    of a shingle's cell and then its hash.  The same order for all sets is all that is needed.
    """
    counts = texts.sparkSession.sparkContext.broadcast(_cell_counts(texts, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in batches_of_text(batch.column(1)):
                hashes, offsets = _shingles(batch.column(1).slice(a, b - a), width)
                taken, places, short = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [np.zeros(0, bool)]
                sizes = np.zeros(b - a, np.int64)
                for r in np.flatnonzero(np.diff(offsets)):
                    own = np.unique(hashes[offsets[r] : offsets[r + 1]])
                    n = len(own)
                    sizes[r] = n + 1 - -(-numerator * n // denominator)
                    order = np.lexsort((own, counts.value[(own >> np.uint64(64 - CELLS)).astype(np.int64)]))
                    taken.append(own[order[: sizes[r]]])
                    places.append(np.arange(sizes[r], dtype=np.int32))
                    short.append(places[-1] < n + 1 - -(-2 * numerator * n // (numerator + denominator)))
                ids = batch.column(0).slice(a, b - a).take(pa.array(np.repeat(np.arange(b - a), sizes)))
                columns = [pa.array(np.concatenate(x)) for x in ([t.view(np.int64) for t in taken], places, short)]
                yield pa.record_batch([ids, *columns], names=["vertex", "shingle", "place", "short"])

    return texts.select("vertex", "text").mapInArrow(run, "vertex long, shingle long, place int, short boolean")


def _meeting(placed: DataFrame, prefixes: DataFrame, bits: DataFrame | None, numerator: int, denominator: int) -> DataFrame:
    """Pairs (x, y) of classes of different components that share a prefix shingle and may be linked by size and place.

    ``placed`` has ``vertex, n`` and the component ``at``; x is the larger set.  With ``bits`` pairs that these hold far apart are left out.  At the first shingle that a
    pair shares, what comes after it must hold all the others that a link needs.  The classes of a shingle's
    largest component are not paired with each other, so that a crowd of copies meets only what lies outside of it.
    """
    rows = prefixes.join(placed, "vertex")
    parts = rows.groupBy("shingle", "at").agg(F.count("*").alias("c"), F.bool_or("short").alias("short"))
    mixed = parts.groupBy("shingle").agg(F.max_by("at", F.struct("c", "at")).alias("main"), F.count("*").alias("parts"), F.bool_or("short").alias("any"))
    rows = rows.join(mixed.where("parts > 1 and any").select("shingle", "main"), "shingle")
    rows = cut(rows.withColumn("bits", F.lit(None).cast("array<long>")) if bits is None else rows.join(bits, "vertex"))
    x, y = (rows.select("shingle", "main", "short", *[F.col(c).alias(f"{p}{c}") for c in ("vertex", "at", "n", "place", "bits")]) for p in ("x_", "y_"))
    y = y.where("short").drop("short").withColumnRenamed("main", "y_main")
    needed = F.ceil(F.lit(numerator) * (F.col("x_n") + F.col("y_n")) / F.lit(numerator + denominator))
    rest = F.least(F.col("x_n") - F.col("x_place"), F.col("y_n") - F.col("y_place"))
    fits = (F.col("x_at") != F.col("y_at")) & (F.struct("x_n", "x_vertex") > F.struct("y_n", "y_vertex")) & _sizes_allow(numerator, denominator) & (rest >= needed)
    if bits is not None:
        fits = fits & (_bits_differ(F.col("x_bits"), F.col("y_bits")) <= bits_for(numerator, denominator))
    outside = x.where("x_at <> main").join(y, "shingle").where(fits)
    inside = x.where("x_at = main").join(y.where("y_at <> y_main"), "shingle").where(fits)
    return outside.unionByName(inside).select(F.col("x_vertex").alias("x"), F.col("y_vertex").alias("y")).distinct()


def _confirmed(pairs: DataFrame, texts: DataFrame, numerator: int, denominator: int, width: int) -> DataFrame:
    """Pairs (x, y) whose full shingle sets reach the similarity; the counts come along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in batches_of_text(batch.column(2)):
                part = batch.slice(a, b - a)
                xs, x_at = _shingles(part.column(2), width)
                ys, y_at = _shingles(part.column(3), width)
                both = np.zeros(b - a, np.int64)
                union = np.zeros(b - a, np.int64)
                last, kept = None, None
                for r in range(b - a):
                    mine, other = np.unique(xs[x_at[r] : x_at[r + 1]]), ys[y_at[r] : y_at[r + 1]]
                    if last is None or len(last) != len(other) or not np.array_equal(last, other):
                        last, kept = other, np.unique(other)
                    both[r] = len(np.intersect1d(mine, kept, assume_unique=True))
                    union[r] = len(mine) + len(kept) - both[r]
                linked = np.flatnonzero(denominator * both >= numerator * union)
                yield pa.record_batch(
                    [part.column(0).take(pa.array(linked)), part.column(1).take(pa.array(linked)), pa.array(both[linked]), pa.array(union[linked])],
                    names=["x", "y", "n_both", "n_union"],
                )

    x, y = texts.select(F.col("vertex").alias("x"), F.col("text").alias("x_text")), texts.select(F.col("vertex").alias("y"), F.col("text").alias("y_text"))
    joined = pairs.join(x, "x").join(y, "y").select("x", "y", "x_text", "y_text")
    return joined.mapInArrow(run, "x long, y long, n_both long, n_union long")


def _components(docs: DataFrame, numerator: int, denominator: int, width: int, miss: float, exact: bool) -> DataFrame:
    """Every row of ``docs`` as ``doc_id, mark, n_shingles, vertex, component, first``.

    ``vertex`` is the row's class of equal sets, ``component`` the smallest doc_id of the linked classes and
    ``first`` whether the row's class stands for them; all null for rows without words or without doc_id.
    """
    n_groups = groups_for(numerator, denominator, miss)
    sketched = cut(sketch_documents(docs, width, 2 * n_groups * DEPTH))
    usable = sketched.where("n_shingles > 0 and doc_id is not null")
    classes = usable.groupBy("digest").agg(F.min(F.struct("doc_id", "mark", "n_shingles", "sketch")).alias("best"))
    # Ids are written once, by the checkpoint, and are read from there.
    classes = cut(classes.select("digest", F.monotonically_increasing_id().alias("vertex"), "best.doc_id", "best.mark", F.col("best.n_shingles").alias("n"), "best.sketch"))

    groups = classes.select("vertex", *[_groups(F.col("sketch"), c, n_groups).alias(name) for c, name in enumerate("ab")])
    keys = groups.select("vertex", F.explode("a").alias("ka"), "b").select("vertex", "ka", F.explode("b").alias("kb"))
    keys = keys.select("vertex", F.xxhash64("ka", "kb").alias("key"))
    shared = keys.groupBy("key").agg(F.min("vertex").alias("head"), F.max("vertex").alias("tail")).where("head < tail").select("key", "head")
    members = cut(keys.join(shared, "key"))

    known = classes.select("vertex", "n", "doc_id", "mark")
    if not exact:
        known = known.join(members.select("vertex").distinct(), "vertex")
    known = cut(known)
    # A class stands for one text, which rows may repeat.
    texts = cut(marked(docs).join(known.select("vertex", "doc_id", "mark"), ["doc_id", "mark"]).select("vertex", "text").dropDuplicates(["vertex"]))
    sketches = classes.join(members.select("vertex").distinct(), "vertex").select("vertex", "n", "sketch")
    x_side, y_side = (sketches.select(F.col("vertex").alias(p), F.col("n").alias(f"{p}_n"), F.col("sketch").alias(f"{p}_sketch")) for p in "xy")

    # Pairs that fail here are not lost: they stay in different components and go on.
    n_hashes, same = 2 * n_groups * DEPTH, numerator / denominator
    spread = (n_hashes * same * (1 - same)) ** 0.5

    def linked(pairs: DataFrame, least: float) -> DataFrame:
        likely = _agreements(F.col("x_sketch"), F.col("y_sketch"), n_hashes) >= int(least)
        pairs = pairs.distinct().join(x_side, "x").join(y_side, "y").where(_sizes_allow(numerator, denominator) & likely).select("x", "y")
        return cut(_confirmed(pairs, texts, numerator, denominator, width))

    at = F.coalesce("component", "vertex").alias("at")

    def mixed_buckets(stars: DataFrame) -> DataFrame:
        """Members of buckets that hold several components, with their component and a head that the bucket draws."""
        within = members.join(stars, "vertex", "left").select("key", "vertex", at)
        drawn = F.min_by(F.struct("vertex", "at"), F.xxhash64("key", "vertex")).alias("drawn")
        mixed = within.groupBy("key").agg(F.min("at").alias("low"), F.max("at").alias("high"), drawn).where("low < high").select("key", "drawn")
        return within.join(mixed, "key")

    first = linked(members.where("vertex <> head").select(F.col("vertex").alias("x"), F.col("head").alias("y")), n_hashes * same - 4 * spread)
    first = first.select("x", "y")
    stars = cut(connected_components(first, "x", "y"))
    again = mixed_buckets(stars).where("at <> drawn.at").select(F.col("vertex").alias("x"), F.col("drawn.vertex").alias("y"))
    first = first.unionByName(linked(again, n_hashes * same - 1).select("x", "y"))
    stars = cut(connected_components(first, "x", "y"))
    placed = known.join(stars, "vertex", "left").select("vertex", "n", at)
    if not exact:
        placed = placed.join(mixed_buckets(stars).select("vertex").distinct(), "vertex")
    placed = cut(placed)
    late = cut(texts.join(placed.select("vertex"), "vertex"))
    pairs = _meeting(placed, _prefixes(late, numerator, denominator, width), None if exact else _bit_sketches(late, width), numerator, denominator)
    second = cut(_confirmed(pairs, texts, numerator, denominator, width))
    links = first.unionByName(second.select("x", "y"))

    found = cut(connected_components(links, "x", "y").join(classes.select("vertex", "doc_id"), "vertex"))
    best = found.groupBy("component").agg(F.min(F.struct("doc_id", "vertex")).alias("best"))
    found = found.join(best, "component").select("vertex", F.col("best.doc_id").alias("low"), F.col("best.vertex").alias("stands"))
    named = classes.join(found, "vertex", "left").select(
        "digest", "vertex", F.coalesce("low", "doc_id").alias("component"), (F.coalesce("stands", "vertex") == F.col("vertex")).alias("first")
    )
    has = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    return sketched.join(named, "digest", "left").select("doc_id", "mark", "n_shingles", *[F.when(has, F.col(c)).alias(c) for c in ("vertex", "component", "first")])


def near_duplicate_groups(docs: DataFrame, numerator: int = 85, denominator: int = 100, width: int = 5, miss: float = MISS, exact: bool = False) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Documents are linked when ``denominator * |A & B| >= numerator * |A | B|`` for their sets of
    distinct ``width``-word shingles; ``component_id`` is the smallest doc_id reachable over links.  A link
    of just that similarity is missed with at most probability ``miss`` by the tables, closer ones more
    rarely, and with ``BITS_MISS`` by the bits.  With ``exact`` all classes, not only those that share a table, are
    compared by exact prefixes, and no link is missed.

    Null, empty and white-space texts have no shingles and are linked with nothing: their component is
    their own doc_id and they are kept.  A text with fewer words than ``width`` has one shingle, its
    whole word sequence.  Very long texts are hashed whole.  Rows that repeat a doc_id are each judged
    by their own text, and linked by it alone, and each returned.  A row with a null doc_id is returned with
    a null component and is kept.  Columns other than doc_id and text are ignored.  An empty table gives no rows.
    """
    component = F.coalesce("component", "doc_id")
    return _components(docs, numerator, denominator, width, miss, exact).select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame, numerator: int = 80, denominator: int = 100, width: int = 5, miss: float = MISS, exact: bool = False) -> DataFrame:
    """The rows of ``docs``, with all columns, of which none is a near duplicate of another: of each component the text of the smallest doc_id.

    Links are those of :func:`near_duplicate_groups`.  Rows with equal doc_id and text are one, of which any
    stays; rows with a null doc_id stay, and so do texts without words, one of each doc_id and text.
    """
    judged = _components(docs, numerator, denominator, width, miss, exact)
    goes = judged.where("doc_id is not null and vertex is not null").groupBy("doc_id", "mark").agg(F.min("component").alias("low"), F.bool_and("first").alias("first"))
    goes = goes.where("not first or doc_id <> low").select("doc_id", "mark")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("mark"))
    named = rows.where("doc_id is not null").join(goes, ["doc_id", "mark"], "left_anti").dropDuplicates(["doc_id", "mark"])
    return named.select("row").unionByName(rows.where("doc_id is null").select("row")).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
