"""Operators over pixel tables: masks, mosaics, band arithmetic, neighbourhoods, stretches.

A raster is a table of pixels, ``row`` and ``col`` on a lattice and ``v`` (null as nodata).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EIGHT = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)]
FOUR = [(-1, 0), (0, -1), (0, 1), (1, 0)]


def masked_where(pixels: DataFrame, flags: DataFrame, keys: list[str], v: str, flag: str, drop: Column) -> DataFrame:
    """``pixels`` with ``v`` null where the flag of the same pixel satisfies ``drop``; pixels without a flag keep their value."""
    return pixels.join(flags.select(*keys, flag), keys, "left").withColumn(v, F.when(~F.coalesce(drop, F.lit(False)), F.col(v))).drop(flag)


def outlier_masked(pixels: DataFrame, reference: DataFrame, keys: list[str], v: str, ref: str, limit: float = 50.0) -> DataFrame:
    """``v`` is null where it differs by more than ``limit`` from the reference."""
    near = F.abs(F.col(v) - F.col(ref)) <= limit
    return pixels.join(reference.select(*keys, ref), keys, "left").withColumn(v, F.when(F.coalesce(near, F.lit(True)), F.col(v))).drop(ref)


def last_on_top(pixels: DataFrame, keys: list[str], v: str, priority: Column) -> DataFrame:
    """Mosaic: of the valid values of a pixel the one with the greatest priority."""
    valid = F.when(F.col(v).isNotNull(), priority)
    return pixels.groupBy(*keys).agg(F.max_by(v, valid).alias(v))


def clearest_on_top(pixels: DataFrame, keys: list[str], v: str, cloud: Column) -> DataFrame:
    """Mosaic: of the valid values of a pixel the one with the least cloud."""
    return pixels.groupBy(*keys).agg(F.min_by(v, F.when(F.col(v).isNotNull(), cloud)).alias(v))


def mosaic_mean(pixels: DataFrame, keys: list[str], v: str) -> DataFrame:
    """Mosaic: the mean of a pixel's valid values (our definition; averaging is a resampling rule elsewhere)."""
    return pixels.groupBy(*keys).agg(F.avg(v).alias(v))


def mosaic_median(pixels: DataFrame, keys: list[str], v: str) -> DataFrame:
    return pixels.groupBy(*keys).agg(F.median(v).alias(v))


def normalised_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b) in double precision, null where the sum is 0."""
    return F.try_divide(a.cast("double") - b, a.cast("double") + b)


def rescaled(v: Column, lo: Column | float, hi: Column | float, to_lo: float = 1.0, to_hi: float = 255.0) -> Column:
    """Linear map of [lo, hi] to [to_lo, to_hi], clipped, rounded down."""
    lo, hi = (x if isinstance(x, Column) else F.lit(float(x)) for x in (lo, hi))
    clipped = F.when(v.isNotNull(), F.least(F.greatest(v, lo), hi))
    return F.floor((clipped - lo) / (hi - lo) * (to_hi - to_lo) + to_lo).cast("int")


def neighbours(cells: DataFrame, offsets: list[tuple[int, int]], payload: list[str]) -> DataFrame:
    """Each cell with the payload of its neighbours (``n_`` prefix) that exist: one equi-join on the shifted position."""
    shift = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in offsets]))
    ends = cells.select((F.col("row")).alias("n_row"), F.col("col").alias("n_col"), *[F.col(c).alias(f"n_{c}") for c in payload])
    moved = cells.withColumn("o", shift).withColumns({"n_row": F.col("row") + F.col("o.i"), "n_col": F.col("col") + F.col("o.j")})
    return moved.join(ends, ["n_row", "n_col"]).withColumns({"di": F.col("o.i"), "dj": F.col("o.j")}).drop("o")


def focal(cells: DataFrame, v: str, pad: Column | None = None) -> DataFrame:
    """Each cell with the map ``w`` of the values around it, keyed ``3 * (i + 1) + j + 1``.

    Every cell sends its value to the nine cells it touches and one aggregate gathers them, so the
    table is shuffled once.  Only cells of the table are returned.
    """
    shift = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in [*EIGHT, (0, 0)]]))
    sent = cells.select("row", "col", F.col(v).alias("v"), shift.alias("o")).select(
        (F.col("row") - F.col("o.i")).alias("row"), (F.col("col") - F.col("o.j")).alias("col"), (3 * (F.col("o.i") + 1) + F.col("o.j") + 1).alias("k"), "v"
    )
    gathered = sent.groupBy("row", "col").agg(
        *[F.max(F.when(F.col("k") == k, F.col("v"))).alias(f"w{k}") for k in range(9)], F.max(F.when(F.col("k") == 4, F.lit(True))).alias("own")
    )
    return gathered.where("own").drop("own")


def sharpened(cells: DataFrame, v: str) -> DataFrame:
    """Five times the centre less its four neighbours, mirrored at the border without repeating it, clipped to 0..255."""
    f = focal(cells, v)
    opposite = lambda a, b: F.coalesce(F.col(a), F.col(b))
    total = 5 * F.col("w4") - opposite("w1", "w7") - opposite("w7", "w1") - opposite("w3", "w5") - opposite("w5", "w3")
    return f.select("row", "col", F.least(F.greatest(total, F.lit(0.0)), F.lit(255.0)).alias(v))


def median_blur(cells: DataFrame, v: str) -> DataFrame:
    """Median of the nine values around each cell; outside the table the nearest cell toward the centre stands in."""
    f = focal(cells, v)
    at = lambda i, j: F.col(f"w{3 * (i + 1) + j + 1}")
    values = F.array(*[F.coalesce(at(i, j), at(i, 0), at(0, j), at(0, 0)) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    return f.select("row", "col", F.sort_array(values)[4].alias(v))


def majority_dilated(cells: DataFrame, v: str) -> DataFrame:
    """Nodata cells take the most frequent valid value around them, the smallest of equally frequent ones."""
    f = focal(cells, v)
    around = F.array(*[F.col(f"w{k}") for k in range(9)])
    values = F.filter(around, lambda x: x.isNotNull())
    counted = F.transform(F.array_distinct(values), lambda x: F.struct((-F.size(F.filter(values, lambda y: y == x))).alias("n"), x.alias("v")))
    return f.select("row", "col", F.coalesce(F.col("w4"), F.array_min(counted)["v"]).alias(v))


def terrain(cells: DataFrame, z: str, size: float = 1.0, azimuth: float = 315.0, altitude: float = 45.0) -> DataFrame:
    """Slope in degrees, hillshade 0..255 and position index of interior cells (all nine values valid)."""
    f = focal(cells, z).where(" and ".join(f"w{k} is not null" for k in range(9)))
    w = [F.col(f"w{k}") for k in range(9)]
    dx = (w[2] + 2 * w[5] + w[8] - w[0] - 2 * w[3] - w[6]) / (8 * size)
    dy = (w[6] + 2 * w[7] + w[8] - w[0] - 2 * w[1] - w[2]) / (8 * size)
    steep = F.sqrt(dx * dx + dy * dy)
    zenith, direction = F.radians(F.lit(90 - altitude)), F.radians(F.lit(360 - azimuth + 90))
    aspect = F.atan2(dy, -dx)
    shade = 255 * (F.cos(zenith) * F.cos(F.atan(steep)) + F.sin(zenith) * F.sin(F.atan(steep)) * F.cos(direction - aspect))
    ring = w[0] + w[1] + w[2] + w[3] + w[5] + w[6] + w[7] + w[8]
    return f.select(
        "row", "col", F.degrees(F.atan(steep)).alias("slope"), F.greatest(shade, F.lit(0.0)).alias("hillshade"), (w[4] - ring / 8).alias("tpi")
    )


def histogram(pixels: DataFrame, keys: list[str], v: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Counts in equal bins of [lo, hi]; the last bin has its right edge, values outside count nowhere."""
    width = (hi - lo) / bins
    b = F.least(F.floor((F.col(v) - lo) / width), F.lit(bins - 1)).cast("int")
    return pixels.where((F.col(v) >= lo) & (F.col(v) <= hi)).groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"))


def percentile_bounds(hist: DataFrame, keys: list[str], lo: float, width: float, p_lo: float, p_hi: float) -> DataFrame:
    """Left edges of the first bin whose cumulated share reaches ``p_lo`` and, from the top, of the first whose tail reaches 1 - ``p_hi``; bin 0 is not tried from the top."""
    up, down = Window.partitionBy(*keys).orderBy("bin"), Window.partitionBy(*keys).orderBy(F.desc("bin"))
    shares = hist.withColumns({"below": F.sum("n").over(up), "above": F.sum("n").over(down), "total": F.sum("n").over(Window.partitionBy(*keys))})
    return shares.groupBy(*keys).agg(
        F.min(F.when(F.col("below") / F.col("total") >= p_lo, F.col("bin") * width + lo)).alias("lower"),
        F.max(F.when((F.col("above") / F.col("total") >= 1 - p_hi) & (F.col("bin") > 0), F.col("bin") * width + lo)).alias("upper"),
    )


def stretched(pixels: DataFrame, bounds: DataFrame, keys: list[str], v: str) -> DataFrame:
    """8-bit stretch of each band between its bounds (``lower``, ``upper``): 1..255, 0 for nodata."""
    return pixels.join(bounds, keys).withColumn("v8", F.coalesce(rescaled(F.col(v), F.col("lower"), F.col("upper")), F.lit(0)))


def colour_relief(pixels: DataFrame, v: str, stops: list[tuple[float, int, int, int]], nodata: tuple[int, int, int] = (0, 0, 0)) -> DataFrame:
    """Red, green and blue of each value, linear between the stops and constant beyond; the table of stops is part of the expression."""
    stops = sorted(stops)
    value = F.col(v)

    def channel(c: int) -> Column:
        out = F.when(value.isNull(), F.lit(nodata[c - 1])).when(value <= stops[0][0], F.lit(stops[0][c]))
        for a, b in zip(stops, stops[1:]):
            out = out.when(value <= b[0], F.floor(a[c] + (value - a[0]) / (b[0] - a[0]) * (b[c] - a[c]) + 0.5).cast("int"))
        return out.otherwise(F.lit(stops[-1][c]))

    return pixels.withColumns({"r": channel(1), "g": channel(2), "b": channel(3)})
