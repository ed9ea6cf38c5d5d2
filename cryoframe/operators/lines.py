"""Operators on lines: distances between them and ripples around them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hausdorff(points: DataFrame, line: str, group: str) -> DataFrame:
    """Discrete Hausdorff distance of every pair of lines (a < b) of a group, from their vertices x, y.

    The least distance of each vertex to the other line is an aggregate, and so is the greatest of those.
    """
    a = points.select(group, F.col(line).alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("n").alias("an"))
    b = points.select(group, F.col(line).alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    far = F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2)
    near = a.join(b, group).where("a <> b").groupBy(group, "a", "b", "an").agg(F.min(far).alias("d")).groupBy(group, "a", "b").agg(F.max("d").alias("d"))
    return near.groupBy(group, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("d").alias("hausdorff"))


def ripples(lines: DataFrame, key: str, limit: int = 75, start: float = 0.1, step: float = 2.0, lo: float = 0.3, hi: float = 3.0, strict: bool = True) -> DataFrame:
    """Lines that join the centre line of their key as its buffer widens, at most one of a year.

    Each row is a candidate: ``far`` (greatest distance from the centre), ``length``, ``centre`` (the
    centre line's length), ``year`` and ``id``.  Candidates come by ring, then id; one is taken if its year
    is new, its length lies in [lo, hi] times the centre's and, if ``strict``, it is shorter than the centre.
    Gives their number, whether their years run one way, and the gaps between their rings.  A key's
    candidates are sorted into one array and folded by built-in functions.
    """
    ring = F.greatest(F.lit(0), F.ceil((F.col("far") - start) / step).cast("int"))
    length, centre = F.col("length"), F.col("centre")
    fits = (ring < limit) & (length >= centre * lo) & (length <= centre * hi)
    if strict:
        fits = fits & (centre - length >= 1e-6)
    item = F.when(fits, F.struct(ring.alias("ring"), F.col("id"), F.col("year").cast("int").alias("year")))
    ids = dict(lines.dtypes)["id"]
    fold = f"""
        aggregate(_list, named_struct('years', cast(array() as array<int>), 'rings', cast(array() as array<int>), 'ids', cast(array() as array<{ids}>)), (acc, x) ->
          if(array_contains(acc.years, x.year), acc,
             named_struct('years', array_append(acc.years, x.year), 'rings', array_append(acc.rings, x.ring), 'ids', array_append(acc.ids, x.id))))"""
    taken = lines.groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("_list")).select(key, F.expr(fold).alias("t"))
    taken = taken.withColumn("s", F.array_sort(F.array_distinct("t.rings")))
    taken = taken.withColumn("g", F.expr(f"if(size(s) > 1, zip_with(slice(s, 2, size(s)), slice(s, 1, size(s) - 1), (b, a) -> (b - a) * {float(step)}D), cast(null as array<double>))"))
    years = F.col("t.years")
    return taken.select(
        key, F.size(years).alias("ri_count"), (F.array_sort(years) == years).alias("mono_incre"), (F.reverse(F.array_sort(years)) == years).alias("mono_decre"),
        F.when(F.col("g").isNotNull(), F.when(F.size("t.rings") > F.size("s"), 0.0).otherwise(F.array_min("g"))).alias("min_gap"), F.array_max("g").alias("max_gap"),
        F.array_join(F.col("t.ids").cast("array<string>"), "_").alias("line_ids"),
    )
