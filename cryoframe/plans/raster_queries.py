"""Queries of the raster operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import raster as op
from ..operators.bookkeeping import cumulative_shares
from .base import IMG, LATTICE, OBS, img, lattice, obs, query, t


def _flag(flag: str) -> tuple[str, str]:
    return f"CASE WHEN flag = '{flag}' THEN 1 ELSE 0 END", flag


@query("s02_bands_flattened", f"WITH {IMG} SELECT band, count(v) AS n, round(sum(v), 4) AS total FROM img WHERE v IS NOT NULL GROUP BY band")
def _(spark, d):
    return img(spark, d).where("v is not null").groupBy("band").agg(F.count("v").alias("n"), F.round(F.sum("v"), 4).alias("total"))


@query("s03_one_band_values", f"WITH {IMG} SELECT event_id, v FROM img WHERE band = 'view' AND v IS NOT NULL AND v >= 10")
def _(spark, d):
    return img(spark, d).where("band = 'view' and v is not null and v >= 10").select("event_id", "v")


@query("f20_match_flag_mask", f"WITH {OBS} SELECT pixel, d, CASE WHEN flag = 'view' THEN z END AS z FROM obs")
def _(spark, d):
    o = obs(spark, d)
    flags = o.select("pixel", "d", F.when(F.col("flag") == "view", 1).otherwise(0).alias("tag"))
    return op.masked_where(o.select("pixel", "d", "z"), flags, ["pixel", "d"], "z", "tag", F.col("tag") == 0)


@query("f21_bitmask", f"WITH {OBS} SELECT pixel, d, CASE WHEN event_id % 4 = 0 THEN z END AS z FROM obs")
def _(spark, d):
    o = obs(spark, d)
    mask = o.select("pixel", "d", (F.col("event_id") % 4).alias("bits"))
    return op.masked_where(o.select("pixel", "d", "z"), mask, ["pixel", "d"], "z", "bits", F.col("bits") != 0)


@query("f22_outlier_mask", f"""
    WITH {OBS}, ref AS (SELECT pixel, median(z) AS m FROM obs GROUP BY pixel)
    SELECT o.pixel, o.d, CASE WHEN coalesce(abs(o.z - r.m) <= 50, true) THEN o.z END AS z FROM obs o LEFT JOIN ref r USING (pixel)""")
def _(spark, d):
    o = obs(spark, d).select("pixel", "d", "z")
    return op.outlier_masked(o, o.groupBy("pixel").agg(F.median("z").alias("m")), ["pixel"], "z", "m")


@query("f23_water_mask", f"WITH {OBS} SELECT pixel, d, z FROM obs WHERE (row, col) NOT IN (SELECT DISTINCT row, col FROM obs WHERE z > 490)")
def _(spark, d):
    o = obs(spark, d)
    water = o.where("z > 490").select("row", "col").distinct()
    return o.join(water, ["row", "col"], "left_anti").select("pixel", "d", "z")


@query("f24_qa_bits", """
    SELECT event_id, event_id & 3072 = 0 AS s2_clear, event_id & 40 = 0 AS l_sr_clear,
           NOT ((event_id & 16 <> 0 AND event_id & 64 <> 0) OR event_id & 256 <> 0) AS l_toa_clear FROM events""")
def _(spark, d):
    qa = F.col("event_id")
    bit = lambda k: qa.bitwiseAND(F.lit(1 << k)) != 0
    return t(spark, d, "events").select("event_id", (~bit(10) & ~bit(11)).alias("s2_clear"), (~bit(5) & ~bit(3)).alias("l_sr_clear"), (~((bit(4) & bit(6)) | bit(8))).alias("l_toa_clear"))


@query("f25_edge_mask", "SELECT s_suppkey, CASE WHEN s_acctbal >= -30 THEN s_acctbal END AS v FROM supplier")
def _(spark, d):
    return t(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_acctbal") >= -30, F.col("s_acctbal")).alias("v"))


@query("f27_subsidence_mask", f"""
    WITH {LATTICE}, lab AS (SELECT row, col, CASE WHEN z < 100 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM lattice),
    near AS (
        SELECT c.row, c.col, o.i, o.j, coalesce(e.v, f.v, g.v, c.v) AS v
        FROM lab c, (SELECT unnest([-1, 0, 1]) AS i) a, (SELECT unnest([-1, 0, 1]) AS j) b, LATERAL (SELECT a.i AS i, b.j AS j) o
        LEFT JOIN lab e ON e.row = c.row + o.i AND e.col = c.col + o.j LEFT JOIN lab f ON f.row = c.row + o.i AND f.col = c.col LEFT JOIN lab g ON g.row = c.row AND g.col = c.col + o.j)
    SELECT row, col, median(v) AS v FROM near GROUP BY row, col""")
def _(spark, d):
    lab = lattice(spark, d).select("row", "col", F.when(F.col("z") < 100, 1.0).otherwise(0.0).alias("v"))
    return op.median_blur(lab, "v")


@query("a22_mosaic_mean", f"WITH {OBS} SELECT row, col, round(avg(z), 6) AS z FROM obs GROUP BY row, col")
def _(spark, d):
    return op.mosaic_mean(obs(spark, d), ["row", "col"], "z").withColumn("z", F.round("z", 6))


@query("a23_mosaic_last", f"WITH {OBS} SELECT row, col, arg_max(z, d) FILTER (WHERE z IS NOT NULL) AS z FROM obs GROUP BY row, col")
def _(spark, d):
    return op.last_on_top(obs(spark, d), ["row", "col"], "z", F.col("d"))


@query("a24_mosaic_median", f"WITH {OBS} SELECT row, col, flag, round(median(z), 4) AS z FROM obs GROUP BY row, col, flag")
def _(spark, d):
    return op.mosaic_median(obs(spark, d), ["row", "col", "flag"], "z").withColumn("z", F.round("z", 4))


@query("a25_mosaic_clearest", f"""
    WITH {OBS} SELECT row, col, first(z ORDER BY event_id % 101, event_id) FILTER (WHERE z IS NOT NULL) AS z FROM obs GROUP BY row, col""")
def _(spark, d):
    return op.clearest_on_top(obs(spark, d), ["row", "col"], "z", F.struct(F.col("event_id") % 101, "event_id"))


@query("a19_match_flag_sum", f"WITH {OBS} SELECT row, col, CAST(sum(CASE WHEN flag = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS total, CAST(sum(CASE WHEN flag = 'view' THEN 1 ELSE 0 END) % 256 AS BIGINT) AS wrapped FROM obs GROUP BY row, col")
def _(spark, d):
    total = F.sum(F.when(F.col("flag") == "view", 1).otherwise(0))
    return obs(spark, d).groupBy("row", "col").agg(total.alias("total"), (total % 256).alias("wrapped"))


@query("a21_count_and_latest_year", """
    SELECT l_suppkey AS pixel, count(DISTINCT year(l_shipdate)) AS years, CAST(max(year(l_shipdate)) AS INTEGER) AS latest FROM lineitem GROUP BY l_suppkey""")
def _(spark, d):
    year = F.year("l_shipdate")
    return t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("pixel")).agg(F.countDistinct(year).alias("years"), F.max(year).alias("latest"))


_PIVOT = "p AS (SELECT image, avg(v) FILTER (WHERE band = 'view') AS nir, avg(v) FILTER (WHERE band = 'click') AS red, avg(v) FILTER (WHERE band = 'purchase') AS green FROM img GROUP BY image)"


def _bands(spark, d):
    return img(spark, d).groupBy("image").pivot("band", ["view", "click", "purchase"]).agg(F.avg("v")).select(
        "image", F.col("view").alias("nir"), F.col("click").alias("red"), F.col("purchase").alias("green")
    )


@query("m01_normalised_difference", f"""
    WITH {IMG}, {_PIVOT} SELECT image, round((nir - red) / nullif(nir + red, 0), 4) AS ndvi, round((green - nir) / nullif(green + nir, 0), 4) AS ndwi FROM p""")
def _(spark, d):
    nd = op.normalised_difference
    return _bands(spark, d).select("image", F.round(nd(F.col("nir"), F.col("red")), 4).alias("ndvi"), F.round(nd(F.col("green"), F.col("nir")), 4).alias("ndwi"))


@query("m02_linear_rescale", f"WITH {IMG} SELECT event_id, CAST(floor((least(greatest(v, 0), 300) - 0) / 300.0::DOUBLE * 254 + 1) AS INTEGER) AS v8 FROM img WHERE v IS NOT NULL")
def _(spark, d):
    return img(spark, d).where("v is not null").select("event_id", op.rescaled(F.col("v"), 0, 300).alias("v8"))


@query("m03_product_cast", "SELECT event_id, CAST(floor(CASE WHEN event_type = 'view' THEN value * 10000 ELSE value END) AS INTEGER) AS dn FROM events")
def _(spark, d):
    return t(spark, d, "events").select("event_id", F.floor(F.when(F.col("event_type") == "view", F.col("value") * 10000).otherwise(F.col("value"))).cast("int").alias("dn"))


@query("m04_sharpen", f"""
    WITH {LATTICE}, c AS (SELECT row, col, coalesce(z, 0.0::DOUBLE) % 256 AS v FROM lattice)
    SELECT c.row, c.col, round(least(greatest(5 * c.v - coalesce(u.v, w.v) - coalesce(w.v, u.v) - coalesce(l.v, r.v) - coalesce(r.v, l.v), 0), 255), 4) AS v
    FROM c LEFT JOIN c u ON u.row = c.row - 1 AND u.col = c.col LEFT JOIN c w ON w.row = c.row + 1 AND w.col = c.col
           LEFT JOIN c l ON l.row = c.row AND l.col = c.col - 1 LEFT JOIN c r ON r.row = c.row AND r.col = c.col + 1""")
def _(spark, d):
    cells = lattice(spark, d).select("row", "col", (F.coalesce("z", F.lit(0.0)) % 256).alias("v"))
    return op.sharpened(cells, "v").withColumn("v", F.round("v", 4))


@query("m05_median_blur", f"""
    WITH {LATTICE}, c AS (SELECT row, col, coalesce(z, 0.0::DOUBLE) AS v FROM lattice),
    near AS (
        SELECT c.row, c.col, coalesce(e.v, f.v, g.v, c.v) AS v
        FROM c, (SELECT unnest([-1, 0, 1]) AS i) a, (SELECT unnest([-1, 0, 1]) AS j) b, LATERAL (SELECT a.i AS i, b.j AS j) o
        LEFT JOIN c e ON e.row = c.row + o.i AND e.col = c.col + o.j LEFT JOIN c f ON f.row = c.row + o.i AND f.col = c.col LEFT JOIN c g ON g.row = c.row AND g.col = c.col + o.j)
    SELECT row, col, median(v) AS v FROM near GROUP BY row, col""")
def _(spark, d):
    return op.median_blur(lattice(spark, d).select("row", "col", F.coalesce("z", F.lit(0.0)).alias("v")), "v")


@query("m06_majority_dilation", f"""
    WITH {LATTICE}, c AS (SELECT row, col, CASE WHEN z >= 60 THEN CAST(floor(z / 50) AS INTEGER) END AS v FROM lattice),
    n AS (SELECT c.row, c.col, e.v, count(*) AS k FROM c JOIN c e ON abs(e.row - c.row) <= 1 AND abs(e.col - c.col) <= 1 WHERE e.v IS NOT NULL GROUP BY ALL)
    SELECT c.row, c.col, coalesce(c.v, (SELECT n.v FROM n WHERE n.row = c.row AND n.col = c.col ORDER BY n.k DESC, n.v LIMIT 1)) AS v FROM c""")
def _(spark, d):
    return op.majority_dilated(lattice(spark, d).select("row", "col", F.when(F.col("z") >= 60, F.floor(F.col("z") / 50).cast("int")).alias("v")), "v")


@query("m07_terrain", f"""
    WITH {LATTICE}, w AS (
        SELECT c.row, c.col, {', '.join(f"max(e.z) FILTER (WHERE e.row = c.row + {i} AND e.col = c.col + {j}) AS w{3 * (i + 1) + j + 1}" for i in (-1, 0, 1) for j in (-1, 0, 1))}
        FROM lattice c JOIN lattice e ON abs(e.row - c.row) <= 1 AND abs(e.col - c.col) <= 1 WHERE e.z IS NOT NULL GROUP BY c.row, c.col HAVING count(*) = 9),
    g AS (SELECT *, (w2 + 2 * w5 + w8 - w0 - 2 * w3 - w6) / 8 AS dx, (w6 + 2 * w7 + w8 - w0 - 2 * w1 - w2) / 8 AS dy FROM w),
    s AS (SELECT *, sqrt(dx * dx + dy * dy) AS steep FROM g)
    SELECT row, col, round(degrees(atan(steep)), 4) AS slope,
           round(greatest(255 * (cos(radians(45)) * cos(atan(steep)) + sin(radians(45)) * sin(atan(steep)) * cos(radians(135) - atan2(dy, -dx))), 0), 4) AS hillshade,
           round(w4 - (w0 + w1 + w2 + w3 + w5 + w6 + w7 + w8) / 8, 6) AS tpi FROM s""")
def _(spark, d):
    r = op.terrain(lattice(spark, d), "z")
    return r.select("row", "col", F.round("slope", 4).alias("slope"), F.round("hillshade", 4).alias("hillshade"), F.round("tpi", 6).alias("tpi"))


_STOPS = [(0.0, 0, 0, 128), (100.0, 0, 200, 255), (250.0, 255, 255, 0), (500.0, 255, 0, 0)]


def _channel(c: int) -> str:
    parts = " ".join(f"WHEN z <= {b[0]} THEN CAST(floor({a[c]} + (z - {a[0]}) / ({b[0]} - {a[0]}) * ({b[c]} - {a[c]}) + 0.5) AS INTEGER)" for a, b in zip(_STOPS, _STOPS[1:]))
    return f"CASE WHEN z IS NULL THEN 0 WHEN z <= 0 THEN {_STOPS[0][c]} {parts} ELSE {_STOPS[-1][c]} END"


@query("m08_colour_relief", f"WITH {LATTICE} SELECT row, col, {_channel(1)} AS r, {_channel(2)} AS g, {_channel(3)} AS b FROM lattice")
def _(spark, d):
    return op.colour_relief(lattice(spark, d).select("row", "col", "z"), "z", _STOPS).drop("z")


@query("m09_layer_stack", f"""
    WITH {OBS} SELECT row, col, coalesce(CAST(max(CAST(floor(z) AS INTEGER) % 255) FILTER (WHERE flag = 'view') AS INTEGER), 255) AS band1,
           coalesce(CAST(max(CAST(floor(z) AS INTEGER) % 255) FILTER (WHERE flag = 'click') AS INTEGER), 255) AS band2,
           coalesce(CAST(max(CAST(floor(z) AS INTEGER) % 255) FILTER (WHERE flag = 'purchase') AS INTEGER), 255) AS band3 FROM obs GROUP BY row, col""")
def _(spark, d):
    o = obs(spark, d).withColumn("v", F.floor("z").cast("int") % 255)
    stack = o.groupBy("row", "col").pivot("flag", ["view", "click", "purchase"]).agg(F.max("v"))
    return stack.select("row", "col", *[F.coalesce(c, F.lit(255)).alias(f"band{i}") for i, c in enumerate(("view", "click", "purchase"), 1)])


@query("m10_valid_mask", f"WITH {OBS} SELECT pixel, d, CASE WHEN z IS NOT NULL THEN 1 ELSE 0 END AS valid FROM obs")
def _(spark, d):
    return obs(spark, d).select("pixel", "d", F.col("z").isNotNull().cast("int").alias("valid"))


@query("m25_crop", f"WITH {LATTICE} SELECT row, col, z FROM lattice WHERE row BETWEEN 2 AND 8 AND col BETWEEN 3 AND 6")
def _(spark, d):
    return lattice(spark, d).where("row between 2 and 8 and col between 3 and 6").select("row", "col", "z")


@query("m27_stable_ground_stack", f"""
    WITH {OBS}, ref AS (SELECT pixel, avg(z) AS m FROM obs GROUP BY pixel)
    SELECT o.pixel, o.d, CASE WHEN o.z IS NULL OR r.m IS NULL THEN 32767 ELSE CAST(sign(r.m - o.z) * floor(round(abs(least(greatest((r.m - o.z) * 100, -32768), 32767)), 4)) AS INTEGER) END AS cm
    FROM obs o JOIN ref r USING (pixel)""")
def _(spark, d):
    o = obs(spark, d)
    ref = o.groupBy("pixel").agg(F.avg("z").alias("m"))
    cm = F.least(F.greatest((F.col("m") - F.col("z")) * 100, F.lit(-32768.0)), F.lit(32767.0))
    whole = F.when(F.col("z").isNotNull() & F.col("m").isNotNull(), F.signum(F.col("m") - F.col("z")) * F.floor(F.round(F.abs(cm), 4)))
    return o.join(ref, "pixel").select("pixel", "d", F.coalesce(whole.cast("int"), F.lit(32767)).alias("cm"))


@query("m33_band_times_mask", f"WITH {OBS} SELECT pixel, d, z * CASE WHEN flag = 'view' THEN 1 ELSE 0 END AS kept, CASE WHEN flag = 'view' THEN 255 ELSE 0 END AS mask255 FROM obs")
def _(spark, d):
    m = F.when(F.col("flag") == "view", 1).otherwise(0)
    return obs(spark, d).select("pixel", "d", (F.col("z") * m).alias("kept"), (m * 255).alias("mask255"))


@query("m34_histogram_equalised", f"""
    WITH {IMG} SELECT event_id, CAST(floor(cume_dist() OVER (PARTITION BY band ORDER BY v) * 254 + 1) AS INTEGER) AS v8 FROM img WHERE v IS NOT NULL""")
def _(spark, d):
    i = img(spark, d)
    return i.join(cumulative_shares(i, ["band"], "v"), ["band", "v"]).select("event_id", F.floor(F.col("share") * 254 + 1).cast("int").alias("v8"))


_RANGES = {"view": (0.0, 200.0), "click": (100.0, 400.0), "purchase": (0.0, 500.0)}


@query("m35_per_band_rescale", f"""
    WITH {IMG}, r(band, lo, hi) AS (VALUES {', '.join(f"('{b}', {lo}::DOUBLE, {hi}::DOUBLE)" for b, (lo, hi) in _RANGES.items())})
    SELECT event_id, CAST(floor((least(greatest(v, lo), hi) - lo) / (hi - lo) * 254 + 1) AS INTEGER) AS v8 FROM img JOIN r USING (band) WHERE v IS NOT NULL""")
def _(spark, d):
    ranges = spark.createDataFrame([(b, lo, hi) for b, (lo, hi) in _RANGES.items()], "band string, lo double, hi double")
    rows = img(spark, d).where("v is not null").join(F.broadcast(ranges), "band")
    return rows.select("event_id", op.rescaled(F.col("v"), F.col("lo"), F.col("hi")).alias("v8"))


@query("m36_linear_colormap", f"WITH {IMG} SELECT event_id, round((v - min(v) OVER (PARTITION BY band)) / (max(v) OVER (PARTITION BY band) - min(v) OVER (PARTITION BY band)), 6) AS share FROM img")
def _(spark, d):
    ends = img(spark, d).groupBy("band").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return img(spark, d).join(F.broadcast(ends), "band").select("event_id", F.round((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")), 6).alias("share"))


_HIST = f"{IMG}, h AS (SELECT band, CAST(least(floor((v - 0) / 5.0::DOUBLE), 99) AS INTEGER) AS bin, count(*) AS n FROM img WHERE v >= 0 AND v <= 500 GROUP BY ALL)"
_CUM = "c AS (SELECT band, bin, n, sum(n) OVER (PARTITION BY band ORDER BY bin) AS below, sum(n) OVER (PARTITION BY band ORDER BY bin DESC) AS above, sum(n) OVER (PARTITION BY band) AS total FROM h)"
_BOUNDS = "b AS (SELECT band, min(bin * 5.0::DOUBLE) FILTER (WHERE below / total >= 0.02) AS lower, max(bin * 5.0::DOUBLE) FILTER (WHERE above / total >= 1 - 0.98::DOUBLE AND bin > 0) AS upper FROM c GROUP BY band)"


def _hist(spark, d):
    return op.histogram(img(spark, d), ["band"], "v", 0, 500, 100)


@query("a10_histogram", f"WITH {_HIST} SELECT band, bin, n FROM h")
def _(spark, d):
    return _hist(spark, d)


@query("a11_percentile_bounds", f"WITH {_HIST}, {_CUM}, {_BOUNDS} SELECT band, lower, upper FROM b")
def _(spark, d):
    return op.percentile_bounds(_hist(spark, d), ["band"], 0, 5.0, 0.02, 0.98)


@query("a12_histogram_log", f"WITH {_HIST}, {_CUM} SELECT band, bin, n, round(100.0::DOUBLE * below / total, 4) AS cumulative FROM c")
def _(spark, d):
    w = Window.partitionBy("band")
    return _hist(spark, d).select("band", "bin", "n", F.round(100.0 * F.sum("n").over(w.orderBy("bin")) / F.sum("n").over(w), 4).alias("cumulative"))


@query("a13_density_histograms", f"WITH {_HIST} SELECT band, bin, round(100.0::DOUBLE * n / sum(n) OVER (PARTITION BY band), 4) AS percent FROM h")
def _(spark, d):
    return _hist(spark, d).select("band", "bin", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("band")), 4).alias("percent"))


@query("w08_percentile_stretch", f"""
    WITH {_HIST}, {_CUM}, {_BOUNDS}
    SELECT event_id, coalesce(CAST(floor((least(greatest(v, lower), upper) - lower) / (upper - lower) * 254 + 1) AS INTEGER), 0) AS v8 FROM img JOIN b USING (band)""")
def _(spark, d):
    bounds = op.percentile_bounds(_hist(spark, d), ["band"], 0, 5.0, 0.02, 0.98)
    return op.stretched(img(spark, d), F.broadcast(bounds), ["band"], "v").select("event_id", "v8")


@query("w09_patchwise_stretch", f"""
    WITH {OBS}, p AS (SELECT pixel, d, z, row // 5 AS pr, col // 5 AS pc FROM obs),
    b AS (SELECT pr, pc, quantile_cont(z, 0.02) AS lower, quantile_cont(z, 0.98) AS upper FROM p GROUP BY ALL)
    SELECT pixel, d, CASE WHEN z IS NULL THEN 255 ELSE CAST(floor((least(greatest(z, lower), upper) - lower) / (upper - lower) * 254) AS INTEGER) END AS v8 FROM p JOIN b USING (pr, pc)""")
def _(spark, d):
    p = obs(spark, d).withColumns({"pr": F.expr("row div 5"), "pc": F.expr("col div 5")})
    bounds = p.groupBy("pr", "pc").agg(F.percentile("z", F.lit(0.02)).alias("lower"), F.percentile("z", F.lit(0.98)).alias("upper"))
    v8 = op.rescaled(F.col("z"), F.col("lower"), F.col("upper"), 0.0, 254.0)
    return p.join(bounds, ["pr", "pc"]).select("pixel", "d", F.coalesce(v8, F.lit(255)).alias("v8"))
