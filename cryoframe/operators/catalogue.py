"""Operators over scene catalogues: predicates, greedy selection, pair planning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_range(c: Column, lower: float | None, upper: float | None) -> Column:
    """Open or closed attribute range: without a lower bound below ``upper``, without an upper one above ``lower``, with both the closed interval."""
    if lower is None and upper is None:
        return F.lit(True)
    if lower is None:
        return c < upper
    if upper is None:
        return c > lower
    return (c >= lower) & (c <= upper)


def first_by(rows: DataFrame, keys: list[str], order: list[Column | str], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in the given total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def consecutive_pairs(rows: DataFrame, keys: list[str], order: list[str], item: str) -> DataFrame:
    """Each item with the one before it in its group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.select(*keys, F.lag(item).over(w).alias("reference"), F.col(item).alias("secondary")).where("reference is not null")


def smallest_enough_window(points: DataFrame, keys: list[str], days: str, radii: list[int], enough: int) -> DataFrame:
    """Points within the smallest radius (in days) that holds ``enough`` of them; the widest where none does."""
    counted = points.groupBy(*keys).agg(*[F.count_if(F.abs(F.col(days)) <= r).alias(f"n{r}") for r in radii])
    radius = F.lit(radii[-1])
    for r in reversed(radii):
        radius = F.when(F.col(f"n{r}") >= enough, F.lit(r)).otherwise(radius)
    chosen = counted.select(*keys, radius.alias("radius"))
    return points.join(chosen, keys).where(F.abs(F.col(days)) <= F.col("radius"))


def greedy_cover(scenes: DataFrame, area: str, scene: str, cells: str, order: list[str]) -> DataFrame:
    """Per area the scenes that, in the given order, add a cell to what is covered so far; with their gain.

    ``cells`` is an array of covered cell numbers.  The order decides, so an area's scenes are sorted into
    one array and folded by built-in functions; their number is bounded by the catalogue of an area.
    """
    item = F.struct(*order, F.col(scene).alias("_scene"), F.col(cells).alias("_cells"))
    kinds = dict(scenes.dtypes)
    taken = f"array<struct<scene:{kinds[scene]},gain:int,covered:int>>"
    fold = f"""
        aggregate(_list, named_struct('seen', cast(array() as {kinds[cells]}), 'out', cast(array() as {taken})), (acc, x) ->
          if(size(array_except(x._cells, acc.seen)) = 0, acc, named_struct(
            'seen', array_union(acc.seen, x._cells),
            'out', concat(acc.out, array(named_struct('scene', x._scene, 'gain', size(array_except(x._cells, acc.seen)), 'covered', size(array_union(acc.seen, x._cells))))))),
          acc -> acc.out)"""
    lists = scenes.groupBy(area).agg(F.sort_array(F.collect_list(item)).alias("_list"))
    out = lists.select(area, F.explode(F.expr(fold)).alias("_t"))
    return out.select(area, F.col("_t.scene").alias(scene), "_t.gain", "_t.covered")


def monthly_rounds(scenes: DataFrame, keys: list[str], scene: str, cells: str, valid: str, rounds: int = 3, least_gain: float = 0.05, enough: float = 0.95, full: int = 100) -> DataFrame:
    """``keys, scene, round``: per key (an area and month) the scenes of up to ``rounds`` greedy rounds.

    Up to three scenes are all kept.  A round starts with the best unused scene by ``valid``, adds in that order
    those that raise the covered share by ``least_gain`` and ends beyond ``enough``; a scene that covers next to nothing is never taken.

    What a scene would add only shrinks as a round goes on, so the next one is the best unused scene that adds enough now:
    one aggregate finds it for all keys at once, and steps repeat until no key takes any.  Coverage is a bitmap of longs
    over cell numbers from 0 below ``full``; a key's state is one row with what it has taken, at most ``rounds * (1 + 1 / least_gain)`` scenes.
    Of a key's scenes that cover the same cells a round takes one at most, as another would add nothing; so only the best ``rounds`` of them are looked at,
    and scenes that have several rows.
    """
    from .graph import written

    words = -(-full // 64)
    bits = f"transform(sequence(0, {words - 1}), w -> aggregate(filter({cells}, c -> c div 64 = w), 0L, (s, c) -> s | shiftleft(1L, cast(c % 64 as int))))"
    listed = scenes.select(*keys, F.col(scene).alias("_scene"), F.struct((-F.col(valid)).alias("v"), F.col(scene).alias("s")).alias("_order"), F.expr(bits).alias("_bits"))
    counted = listed.groupBy(*keys).agg(F.count("*").alias("_n"))
    few = listed.join(counted.where("_n <= 3"), keys).select(*keys, F.col("_scene").alias(scene), F.lit(1).alias("round"))
    count = lambda c: f"aggregate({c}, 0, (s, x) -> s + bit_count(x))"
    items = listed.join(counted.where("_n > 3").select(*keys), keys).where(f"{count('_bits')} / {full} >= 0.0001D")
    if least_gain > 0:
        again = written(listed.groupBy(*keys, "_scene").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n"))
        single, repeated = items, items.limit(0)
        if not again.isEmpty():
            single, repeated = (items.join(again, [*keys, "_scene"], how) for how in ("left_anti", "left_semi"))
        items = first_by(single, [*keys, "_bits"], ["_order"], rounds).unionByName(repeated)
    items = written(items)
    kind = f"array<struct<scene:{dict(items.dtypes)['_scene']},round:int>>"
    state = written(items.select(*keys).distinct().withColumns({"_cover": F.expr(f"array_repeat(0L, {words})"), "_round": F.lit(0), "_taken": F.expr(f"cast(array() as {kind})"), "_go": F.lit(True)}))
    done = []
    while not state.isEmpty():
        unused = items.join(state, keys).where("not array_contains(transform(_taken, t -> t.scene), _scene)")
        gain = count("zip_with(_bits, _cover, (a, b) -> a & ~b)")
        adds = F.expr(f"_round > 0 and {count('_cover')} / {full} <= {enough}D and {gain} / {full} >= {least_gain}D")
        item = F.struct("_scene", "_bits")
        best = unused.groupBy(*keys).agg(F.min_by(item, F.when(adds, F.col("_order"))).alias("_more"), F.min_by(item, "_order").alias("_first"))
        step = state.join(best, keys, "left").withColumn("_new", F.when(F.col("_more").isNull() & (F.col("_round") < rounds), F.col("_first")))
        round_ = F.col("_round") + F.col("_new").isNotNull().cast("int")
        pick = F.coalesce("_more", "_new")
        cover = F.when(F.col("_new").isNotNull(), F.col("_new._bits")).otherwise(F.expr("zip_with(_cover, _more._bits, (a, b) -> a | b)"))
        taken = F.array_append("_taken", F.struct(pick["_scene"].alias("scene"), round_.alias("round")))
        step = written(step.select(*keys, F.when(pick.isNotNull(), cover).alias("_cover"), round_.alias("_round"), F.when(pick.isNotNull(), taken).otherwise(F.col("_taken")).alias("_taken"), pick.isNotNull().alias("_go")))
        done.append(step.where("not _go").select(*keys, "_taken"))
        state = step.where("_go")
    out = few
    for part in done:
        out = out.unionByName(part.select(*keys, F.explode("_taken").alias("t")).select(*keys, F.col("t.scene").alias(scene), F.col("t.round").alias("round")))
    return out


def parameter_grid(spark, axes: dict[str, list[int]], keep: Column | None = None) -> DataFrame:
    """All combinations of the values of the axes that satisfy ``keep``; one row explodes into literal arrays."""
    grid = spark.range(1).drop("id")
    for name, values in axes.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return grid if keep is None else grid.where(keep)
