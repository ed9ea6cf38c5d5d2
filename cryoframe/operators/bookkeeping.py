"""Operators that keep track of which grids, scenes and files are done."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut


def remaining(work: DataFrame, done: list[DataFrame], key: str) -> DataFrame:
    """Rows of ``work`` whose key is in none of the ``done`` lists: one anti join against their union."""
    seen = reduce(DataFrame.unionByName, [x.select(key) for x in done])
    return work.join(seen, key, "left_anti")


def unneeded(cover: DataFrame, item: str, grid: str, completed: DataFrame) -> DataFrame:
    """Items all of whose grids are completed (relational division by one aggregate)."""
    flags = cover.select(item, grid).distinct().join(completed.select(grid).distinct().withColumn("done", F.lit(True)), grid, "left")
    return flags.groupBy(item).agg(F.bool_and(F.coalesce("done", F.lit(False))).alias("unneeded")).where("unneeded").select(item)


def exists_flags(work: DataFrame, products: DataFrame, no_result: DataFrame, key: str) -> DataFrame:
    """Each work key with the number of its products, and whether it is done: it has a product or stands in the no-result list."""
    counted = products.groupBy(key).agg(F.count("*").alias("n_products"))
    none = no_result.select(key).distinct().withColumn("none", F.lit(True))
    return work.join(counted, key, "left").join(none, key, "left").select(
        key, F.coalesce("n_products", F.lit(0)).cast("long").alias("n_products"), (F.coalesce(F.col("n_products"), F.lit(0)) > 0).__or__(F.coalesce("none", F.lit(False))).alias("done")
    )


def append_absent(have: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``have`` and those rows of ``new`` whose key it lacks, each new key once."""
    return have.select(key).unionByName(new.select(key).distinct().join(have.select(key), key, "left_anti"))


def file_count_split(files: DataFrame, key: str, allowed: list[int]) -> DataFrame:
    """Number of files of each key and whether it is an allowed one."""
    return files.groupBy(key).agg(F.count("*").alias("n_files")).withColumn("good", F.col("n_files").isin(allowed))


def one_file_each(grids: DataFrame, files: DataFrame, key: str, path: str) -> DataFrame:
    """Each grid with its file: the path if there is one, ``missing`` for none and ``ambiguous`` for several."""
    counted = files.groupBy(key).agg(F.count("*").alias("n"), F.min(path).alias("path"))
    return grids.select(key).join(counted, key, "left").select(
        key, F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous").otherwise("one").alias("state"), F.when(F.col("n") == 1, F.col("path")).alias("path")
    )


def latest_state(changes: DataFrame, key: str, status: str, at: list[str]) -> DataFrame:
    """The last status of each key."""
    return changes.groupBy(key).agg(F.max_by(status, F.struct(*at)).alias(status))


def completed_all(tasks: DataFrame, key: str, task: str, wanted: list[str]) -> DataFrame:
    """Keys that have each wanted task."""
    return tasks.where(F.col(task).isin(wanted)).groupBy(key).agg(F.count_distinct(task).alias("n")).where(F.col("n") == len(wanted)).select(key)


def _ranges(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def numbered(rows: DataFrame, order: list[Column | str], name: str = "n", buckets: int | None = None) -> DataFrame:
    """Rows numbered from 1 in the given total order.

    Ranges of the order are numbered apart and shifted by the counts of the ranges before them, so that
    no single task numbers the whole table; only the counts of the ranges meet in one place.  Rows are cut
    with their range before they are counted: a range exchange that is planned twice draws other bounds.
    """
    placed = cut(rows.repartitionByRange(buckets or _ranges(rows), *order).withColumn("_p", F.spark_partition_id()))
    counts = placed.groupBy("_p").agg(F.count("*").alias("_c"))
    before = counts.select("_p", (F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    # one row for each range: at most ``buckets``
    return placed.join(F.broadcast(before), "_p").withColumn(name, own + F.col("_before")).drop("_p", "_before")


def running_counts(rows: DataFrame, keys: list[str], v: str, buckets: int | None = None) -> DataFrame:
    """Each distinct non-null value of a key with its count ``_n``, the count ``_upto`` of values not above it, and the key's count ``_all``.

    Equal values are counted before anything is ordered; ranges of key and value are then summed apart, so
    that no task holds all values of a key.
    """
    counts = rows.where(F.col(v).isNotNull()).groupBy(*keys, v).agg(F.count("*").alias("_n"))
    placed = cut(counts.repartitionByRange(buckets or _ranges(rows), *keys, v).withColumn("_p", F.spark_partition_id()))
    named = {c: f"_k{i}" for i, c in enumerate(["_p", *keys])}  # keys may be null
    parts = placed.groupBy(*[F.col(c).alias(k) for c, k in named.items()]).agg(F.sum("_n").alias("_c"))
    whole = Window.partitionBy(*[named[k] for k in keys])
    parts = parts.select(*named.values(), (F.sum("_c").over(whole.orderBy("_k0")) - F.col("_c")).alias("_before"), F.sum("_c").over(whole).alias("_all"))
    placed = placed.join(parts, [F.col(c).eqNullSafe(F.col(k)) for c, k in named.items()])
    upto = F.sum("_n").over(Window.partitionBy("_p", *keys).orderBy(v)) + F.col("_before")
    return placed.select(*keys, v, "_n", upto.alias("_upto"), "_all")


def quantiles(rows: DataFrame, keys: list[str], v: str, shares: dict[str, float], buckets: int | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation of the non-null values of each key, named by ``shares``."""
    counted = running_counts(rows.select(*keys, F.col(v).cast("double").alias("_v")), keys, "_v", buckets)
    holds = lambda at: (at >= F.col("_upto") - F.col("_n")) & (at < F.col("_upto"))
    ends = {}
    for name, p in shares.items():
        spot = F.lit(float(p)) * (F.col("_all") - 1)
        low, high = F.max(F.when(holds(F.floor(spot)), F.col("_v"))), F.max(F.when(holds(F.ceil(spot)), F.col("_v")))
        ends[name] = low + (high - low) * F.max(spot - F.floor(spot))
    return counted.groupBy(*keys).agg(*[e.alias(name) for name, e in ends.items()])


def cumulative_shares(rows: DataFrame, keys: list[str], v: str, name: str = "share", buckets: int | None = None) -> DataFrame:
    """Each distinct value of a key with the share of the key's non-null values that are not above it."""
    return running_counts(rows, keys, v, buckets).select(*keys, v, (F.col("_upto") / F.col("_all")).alias(name))


def chunks(items: DataFrame, order: list[Column | str], per_job: int, buckets: int | None = None) -> DataFrame:
    """Job number of each item: items in order, ``per_job`` to a job."""
    return numbered(items, order, "_at", buckets).withColumn("job", F.floor((F.col("_at") - 1) / per_job)).drop("_at")


def running_offsets(files: DataFrame, order: str, n: str, buckets: int | None = None) -> DataFrame:
    """Files (one row for each ``order``) with the number of items before them, ``first``, for drawing items by a global number."""
    placed = cut(files.repartitionByRange(buckets or _ranges(files), order).withColumn("_p", F.spark_partition_id()))
    parts = placed.groupBy("_p").agg(F.sum(n).alias("_c"))
    before = parts.select("_p", (F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).alias("_before"))
    own = F.sum(n).over(Window.partitionBy("_p").orderBy(order)) - F.col(n)
    return placed.join(F.broadcast(before), "_p").withColumn("first", own + F.col("_before")).drop("_p", "_before")


def in_intervals(points: DataFrame, at: str, intervals: DataFrame, lo: str, hi: str) -> DataFrame:
    """Each whole number ``at`` with the intervals [lo, hi) of whole numbers that hold it.

    Intervals are laid on strips as wide as four of them on average and joined by strip, so that no task
    compares every number with every interval.
    """
    sizes = intervals.where(F.col(lo) < F.col(hi)).agg(F.avg(F.col(hi) - F.col(lo)).alias("w")).first()
    width = max(1, int(4 * (sizes["w"] or 1)))
    strip = lambda c: F.floor(c / F.lit(width)).cast("long")
    laid = intervals.where(F.col(lo) < F.col(hi)).withColumn("_s", F.explode(F.sequence(strip(F.col(lo)), strip(F.col(hi) - 1))))
    return points.withColumn("_s", strip(F.col(at))).join(laid, "_s").where((F.col(at) >= F.col(lo)) & (F.col(at) < F.col(hi))).drop("_s")


def located(numbers: DataFrame, number: str, files: DataFrame, n: str) -> DataFrame:
    """File and local position of each global number, from files with their offset ``first``."""
    ends = files.withColumn("_end", F.col("first") + F.col(n))
    return in_intervals(numbers, number, ends, "first", "_end").withColumn("local", F.col(number) - F.col("first")).drop("_end")


def task_levels(tasks: DataFrame, needs: DataFrame, max_levels: int = 10_000) -> DataFrame:
    """``task, level``: 0 for tasks that need none of the others, else one more than the greatest level of what they need (``task, needs``).

    Level by level, all tasks that need one of the last level move up, until none does; needs in a ring raise an error.
    Needs that are no tasks hold nothing up.
    """
    from .graph import written

    links = written(needs.join(tasks.select(F.col("task").alias("needs")).distinct(), "needs", "left_semi").select("task", "needs").distinct())
    level = written(tasks.select("task").distinct().join(links, "task", "left_anti"), 2)
    levels = [level.withColumn("level", F.lit(0))]
    for n in range(1, max_levels):
        level = written(links.join(level.withColumnRenamed("task", "needs"), "needs").select("task").distinct(), 2)
        if level.isEmpty():
            break
        levels.append(level.withColumn("level", F.lit(n)))
    else:
        raise RuntimeError("tasks need each other in a ring")
    out = levels[0]
    for part in levels[1:]:
        out = out.unionByName(part)
    return out.groupBy("task").agg(F.max("level").alias("level"))
