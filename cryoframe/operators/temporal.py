"""Operators over dated observations: differences per pixel, grouping of dates, ordered sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest_minus_oldest(obs: DataFrame, keys: list[str]) -> DataFrame:
    """Difference of the newest and the oldest valid elevation of each pixel, with their gap in days and date numbers.

    One hash aggregate: of all pairs of valid dates the one with the largest gap is always the first
    and the last.  Pixels with fewer than two valid dates get null, 0 days and number 255.
    """
    dates = obs.select("d").distinct()
    numbered = dates.withColumn("n", F.row_number().over(Window.orderBy("d")) - 1)
    valid = "filter (where z is not null)"
    seen = obs.groupBy(*keys).agg(
        F.expr(f"max_by(z, d) {valid}").alias("z_new"), F.expr(f"min_by(z, d) {valid}").alias("z_old"),
        F.expr(f"max(d) {valid}").alias("d_new"), F.expr(f"min(d) {valid}").alias("d_old"), F.count("z").alias("n_valid"),
    )
    new, old = numbered.select(F.col("d").alias("d_new"), F.col("n").alias("i_new")), numbered.select(F.col("d").alias("d_old"), F.col("n").alias("i_old"))
    pair = F.col("n_valid") >= 2
    return seen.join(new, "d_new", "left").join(old, "d_old", "left").select(
        *keys,
        F.when(pair, F.col("z_new") - F.col("z_old")).alias("dz"),
        F.when(pair, F.datediff("d_new", "d_old")).otherwise(0).alias("gap_days"),
        F.when(pair, F.col("i_old")).otherwise(255).cast("int").alias("old_index"),
        F.when(pair, F.col("i_new")).otherwise(255).cast("int").alias("new_index"),
    )


def max_subsidence(obs: DataFrame, keys: list[str], sentinel: float = 9999.0) -> DataFrame:
    """Smallest later-minus-earlier difference of each pixel; of equal ones the larger gap.

    A running maximum of (z, earliest date) replaces the pairs of dates.
    """
    before = Window.partitionBy(*keys).orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    day = F.unix_date("d")
    best = obs.where("z is not null").withColumn("best", F.max(F.struct(F.col("z").alias("z"), (-day).alias("d"))).over(before))
    drops = best.select(*keys, (F.col("z") - F.col("best.z")).alias("dz"), (day + F.col("best.d")).alias("gap")).where(F.col("dz") < sentinel)
    least = drops.groupBy(*keys).agg(F.min(F.struct("dz", (-F.col("gap")).alias("gap"))).alias("m"))
    return obs.select(*keys).distinct().join(least, keys, "left").select(
        *keys, F.col("m.dz").alias("dz"), F.coalesce(-F.col("m.gap"), F.lit(0)).alias("gap_days")
    )


def centimetres(z: Column, nodata: int = 32767) -> Column:
    """Metres as 16-bit centimetres: clipped, cut toward zero, null as ``nodata``."""
    cm = F.when(z.isNotNull(), F.least(F.greatest(z * 100, F.lit(-32768.0)), F.lit(32767.0)))
    return F.coalesce((F.signum(cm) * F.floor(F.abs(cm))).cast("int"), F.lit(nodata))


def date_groups(rows: DataFrame, keys: list[str], days: int, d: str = "d") -> DataFrame:
    """Anchor date of every date of a key: in date order, a date joins the last anchor within ``days`` or becomes one.

    Anchors lie more than ``days`` apart, so no earlier anchor can fit; the fold needs one pass.
    """
    folded = F.aggregate(
        F.sort_array(F.collect_set(d)),
        F.expr("named_struct('at', cast(null as date), 'out', cast(array() as array<struct<d:date,anchor:date>>))"),
        lambda acc, x: F.struct(
            F.when(F.datediff(x, acc["at"]) <= days, acc["at"]).otherwise(x).alias("at"),
            F.concat(acc["out"], F.array(F.struct(x.alias("d"), F.when(F.datediff(x, acc["at"]) <= days, acc["at"]).otherwise(x).alias("anchor")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return rows.groupBy(*keys).agg(folded.alias("g")).select(*keys, F.explode("g").alias("g")).select(*keys, "g.d", "g.anchor")


def closest_to_midsummer(rows: DataFrame, keys: list[str], d: Column, value: str, ties: list[str]) -> DataFrame:
    """Per key and year, the value whose month-day number is closest to 0701; ties by the given columns."""
    off = F.abs(F.month(d) * 100 + F.dayofmonth(d) - 701)
    return rows.groupBy(*keys, F.year(d).alias("year")).agg(F.min_by(value, F.struct(off, *ties)).alias("on_top"), F.min(off).alias("off"))


def monotone(rows: DataFrame, keys: list[str], order: str, y: str) -> DataFrame:
    """Whether y never falls, and never rises, along the order; one row counts as both."""
    last = F.lag(y).over(Window.partitionBy(*keys).orderBy(order))
    stepped = rows.withColumn("last", last)
    return stepped.groupBy(*keys).agg(
        F.coalesce(F.bool_and(F.col(y) >= F.col("last")), F.lit(True)).alias("increasing"),
        F.coalesce(F.bool_and(F.col(y) <= F.col("last")), F.lit(True)).alias("decreasing"),
        F.count("*").alias("n"),
    )


def step_gaps(rows: DataFrame, keys: list[str], step: str, delta: float) -> DataFrame:
    """Least, largest and mean gap between occupied steps times ``delta``; 0 as least if a step is occupied twice; null for one step."""
    used = rows.groupBy(*keys, step).agg(F.count("*").alias("n"))
    gap = (F.col(step) - F.lag(step).over(Window.partitionBy(*keys).orderBy(step))) * F.lit(delta)
    g = used.withColumn("gap", gap).groupBy(*keys).agg(
        F.min("gap").alias("lo"), F.max("gap").alias("max_gap"), F.avg("gap").alias("mean"), F.max("n").alias("most"), F.count("*").alias("steps")
    )
    lone = F.col("steps") <= 1
    return g.select(
        *keys, F.when(~lone, F.when(F.col("most") > 1, 0.0).otherwise(F.col("lo"))).alias("min_gap"), F.when(~lone, F.col("max_gap")).alias("max_gap"),
        F.round("mean", 4).alias("mean_gap"),
    )


def movement(rows: DataFrame, keys: list[str], order: list[str], x: str, y: str) -> DataFrame:
    """Path length over straight distance, and the least turning angle in degrees, of a track.

    Fewer than two points: null.  Two points, or ends closer than 1e-6: 1 and 0.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    ends = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    dx, dy = F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)
    s = rows.select(*keys, dx.alias("dx"), dy.alias("dy"), F.lead(x).over(w).alias("nx"), F.lead(y).over(w).alias("ny"), F.col(x).alias("x"), F.col(y).alias("y"),
                    F.first(x).over(ends).alias("x0"), F.first(y).over(ends).alias("y0"), F.last(x).over(ends).alias("x1"), F.last(y).over(ends).alias("y1"))
    ux, uy, vx, vy = -F.col("dx"), -F.col("dy"), F.col("nx") - F.col("x"), F.col("ny") - F.col("y")
    cosine = (ux * vx + uy * vy) / (F.sqrt(ux * ux + uy * uy) * F.sqrt(vx * vx + vy * vy))
    angle = F.when((ux * ux + uy * uy > 0) & (vx * vx + vy * vy > 0), F.degrees(F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0)))))
    a = s.withColumn("angle", angle).groupBy(*keys).agg(
        F.sum(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))).alias("path"),
        F.first(F.sqrt((F.col("x1") - F.col("x0")) ** 2 + (F.col("y1") - F.col("y0")) ** 2)).alias("straight"), F.min("angle").alias("least"), F.count("*").alias("n"),
    )
    plain = (F.col("n") == 2) | (F.col("straight") < 1e-6)
    return a.select(
        *keys, F.when(F.col("n") >= 2, F.when(plain, 1.0).otherwise(F.round(F.col("path") / F.col("straight"), 4))).alias("sinuosity"),
        F.when(F.col("n") >= 2, F.when(plain, 0.0).otherwise(F.round("least", 4))).alias("least_angle"),
    )
