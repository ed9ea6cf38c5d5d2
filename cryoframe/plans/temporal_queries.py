"""Queries of the temporal operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import temporal as op
from .base import NAMES, OBS, names, obs, query, t


@query("a01_newest_minus_oldest", f"""
    WITH {OBS}, days AS (SELECT d, CAST(row_number() OVER (ORDER BY d) - 1 AS INTEGER) AS n FROM (SELECT DISTINCT d FROM obs)),
    seen AS (
        SELECT pixel, row, col, arg_max(z, d) FILTER (WHERE z IS NOT NULL) AS z1, arg_min(z, d) FILTER (WHERE z IS NOT NULL) AS z0,
               max(d) FILTER (WHERE z IS NOT NULL) AS d1, min(d) FILTER (WHERE z IS NOT NULL) AS d0, count(z) AS n
        FROM obs GROUP BY pixel, row, col)
    SELECT pixel, row, col, CASE WHEN s.n >= 2 THEN round(z1 - z0, 4) END AS dz,
           CASE WHEN s.n >= 2 THEN CAST(date_diff('day', d0, d1) AS INTEGER) ELSE 0 END AS gap_days,
           CASE WHEN s.n >= 2 THEN a.n ELSE 255 END AS old_index, CASE WHEN s.n >= 2 THEN b.n ELSE 255 END AS new_index
    FROM seen s LEFT JOIN days a ON a.d = d0 LEFT JOIN days b ON b.d = d1""")
def _(spark, d):
    return op.newest_minus_oldest(obs(spark, d), ["pixel", "row", "col"]).withColumn("dz", F.round("dz", 4))


@query("a02_max_subsidence", f"""
    WITH {OBS}, pairs AS (
        SELECT a.pixel, b.z - a.z AS dz, date_diff('day', a.d, b.d) AS gap,
               row_number() OVER (PARTITION BY a.pixel ORDER BY b.z - a.z, date_diff('day', a.d, b.d) DESC) AS rn
        FROM obs a JOIN obs b ON a.pixel = b.pixel AND a.d < b.d WHERE a.z IS NOT NULL AND b.z IS NOT NULL AND b.z - a.z < 9999)
    SELECT o.pixel, round(p.dz, 4) AS dz, CAST(coalesce(p.gap, 0) AS INTEGER) AS gap_days
    FROM (SELECT DISTINCT pixel FROM obs) o LEFT JOIN pairs p ON o.pixel = p.pixel AND p.rn = 1""")
def _(spark, d):
    return op.max_subsidence(obs(spark, d), ["pixel"]).withColumn("dz", F.round("dz", 4))


@query("a03_centimetres", f"""
    WITH {OBS} SELECT pixel, d, CASE WHEN z IS NULL THEN 32767 ELSE
        CAST(sign(least(greatest(z * 100, -32768), 32767)) * floor(abs(least(greatest(z * 100, -32768), 32767))) AS INTEGER) END AS cm FROM obs""")
def _(spark, d):
    return obs(spark, d).select("pixel", "d", op.centimetres(F.col("z")).alias("cm"))


@query("a14_date_statistics", """
    SELECT CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month, count(*) AS n,
           count(DISTINCT CAST(l_shipdate AS DATE)) AS n_dates FROM lineitem GROUP BY ALL""")
def _(spark, d):
    return t(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month")).agg(
        F.count("*").alias("n"), F.countDistinct(F.to_date("l_shipdate")).alias("n_dates")
    )


@query("w01_date_groups", f"""
    WITH RECURSIVE {OBS}, anchors AS (
        SELECT pixel, min(d) AS anchor FROM obs GROUP BY pixel
        UNION ALL
        SELECT a.pixel, (SELECT min(o.d) FROM obs o WHERE o.pixel = a.pixel AND date_diff('day', a.anchor, o.d) > 3) FROM anchors a
        WHERE EXISTS (SELECT 1 FROM obs o WHERE o.pixel = a.pixel AND date_diff('day', a.anchor, o.d) > 3))
    SELECT o.pixel, o.d, max(a.anchor) AS anchor FROM (SELECT DISTINCT pixel, d FROM obs) o JOIN anchors a ON a.pixel = o.pixel AND a.anchor <= o.d GROUP BY o.pixel, o.d""")
def _(spark, d):
    return op.date_groups(obs(spark, d), ["pixel"], 3)


_SUMMER = "abs(month(l_shipdate) * 100 + day(l_shipdate) - 701)"


@query("w02_closest_to_midsummer", f"""
    SELECT l_suppkey, CAST(year(l_shipdate) AS INTEGER) AS year,
           first(l_extendedprice ORDER BY {_SUMMER}, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS on_top, CAST(min({_SUMMER}) AS INTEGER) AS off
    FROM lineitem GROUP BY l_suppkey, year(l_shipdate)""")
def _(spark, d):
    ties = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    return op.closest_to_midsummer(t(spark, d, "lineitem"), ["l_suppkey"], F.col("l_shipdate"), "l_extendedprice", ties)


@query("w03_group_by_strip_pair", f"""
    WITH {NAMES}, found AS (SELECT path, regexp_extract_all(path, 'SETSM_[0-9]+_[0-9]+') AS pairs FROM names)
    SELECT pairs[1] AS pair, count(*) AS n FROM found WHERE len(pairs) = 1 GROUP BY pairs[1]""")
def _(spark, d):
    found = names(spark, d).select(F.expr("regexp_extract_all(path, r'SETSM_[0-9]+_[0-9]+', 0)").alias("pairs"))
    return found.where(F.size("pairs") == 1).groupBy(F.col("pairs")[0].alias("pair")).agg(F.count("*").alias("n"))


@query("w04_group_by_acquisition_date", f"""
    WITH {NAMES} SELECT CAST(strptime(substr(regexp_extract(path, '[^/]+$'), 1, 8), '%Y%m%d') AS DATE) AS acquired, count(*) AS n FROM names GROUP BY 1""")
def _(spark, d):
    base = F.regexp_extract("path", r"[^/]+$", 0)
    return names(spark, d).groupBy(F.to_date(F.substring(base, 1, 8), "yyyyMMdd").alias("acquired")).agg(F.count("*").alias("n"))


@query("w11_monotone", f"""
    WITH {OBS}, s AS (SELECT pixel, z, lag(z) OVER (PARTITION BY pixel ORDER BY d) AS last FROM obs WHERE z IS NOT NULL)
    SELECT pixel, coalesce(bool_and(z >= last), true) AS increasing, coalesce(bool_and(z <= last), true) AS decreasing, count(*) AS n FROM s GROUP BY pixel""")
def _(spark, d):
    return op.monotone(obs(spark, d).where("z is not null"), ["pixel"], "d", "z")


@query("w12_step_gaps", """
    WITH used AS (SELECT l_suppkey, CAST(floor(l_quantity / 10) AS INTEGER) AS step, count(*) AS n FROM lineitem GROUP BY 1, 2),
    g AS (SELECT *, (step - lag(step) OVER (PARTITION BY l_suppkey ORDER BY step)) * 2.0::DOUBLE AS gap FROM used),
    a AS (SELECT l_suppkey, min(gap) AS lo, max(gap) AS hi, avg(gap) AS mean, max(n) AS most, count(*) AS steps FROM g GROUP BY l_suppkey)
    SELECT l_suppkey, CASE WHEN steps > 1 THEN CASE WHEN most > 1 THEN 0.0::DOUBLE ELSE lo END END AS min_gap, CASE WHEN steps > 1 THEN hi END AS max_gap,
           round(mean, 4) AS mean_gap FROM a""")
def _(spark, d):
    rows = t(spark, d, "lineitem").select("l_suppkey", F.floor(F.col("l_quantity") / 10).cast("int").alias("step"))
    return op.step_gaps(rows, ["l_suppkey"], "step", 2.0)


@query("w13_movement", f"""
    WITH {OBS}, p AS (SELECT row, d, event_id, CAST(col AS DOUBLE) AS x, z AS y FROM obs WHERE z IS NOT NULL),
    s AS (SELECT row, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, lead(x) OVER w - x AS vx, lead(y) OVER w - y AS vy,
                 first_value(x) OVER e AS x0, first_value(y) OVER e AS y0, last_value(x) OVER e AS x1, last_value(y) OVER e AS y1 FROM p
          WINDOW w AS (PARTITION BY row ORDER BY d, event_id),
                 e AS (PARTITION BY row ORDER BY d, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    a AS (SELECT row, sum(sqrt(dx * dx + dy * dy)) AS path, first(sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2))) AS straight, count(*) AS n,
                 min(CASE WHEN dx * dx + dy * dy > 0 AND vx * vx + vy * vy > 0 THEN degrees(acos(least(greatest(
                     (-dx * vx - dy * vy) / (sqrt(dx * dx + dy * dy) * sqrt(vx * vx + vy * vy)), -1.0::DOUBLE), 1.0::DOUBLE))) END) AS least FROM s GROUP BY row)
    SELECT row, CASE WHEN n >= 2 THEN CASE WHEN n = 2 OR straight < 1e-6 THEN 1.0::DOUBLE ELSE round(path / straight, 4) END END AS sinuosity,
           CASE WHEN n >= 2 THEN CASE WHEN n = 2 OR straight < 1e-6 THEN 0.0::DOUBLE ELSE round(least, 4) END END AS least_angle FROM a""")
def _(spark, d):
    track = obs(spark, d).where("z is not null").select("row", "d", "event_id", F.col("col").cast("double").alias("x"), F.col("z").alias("y"))
    return op.movement(track, ["row"], ["d", "event_id"], "x", "y")


@query("j10_consecutive_pairs", """
    WITH p AS (SELECT l_suppkey, l_orderkey AS second, lag(l_orderkey) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS first,
                      date_diff('day', lag(l_shipdate) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey), l_shipdate) AS gap_days FROM lineitem)
    SELECT l_suppkey, first, second, CAST(gap_days AS INTEGER) AS gap_days FROM p WHERE first IS NOT NULL""")
def _(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
    return t(spark, d, "lineitem").select(
        "l_suppkey", F.lag("l_orderkey").over(w).alias("first"), F.col("l_orderkey").alias("second"), F.datediff("l_shipdate", F.lag("l_shipdate").over(w)).alias("gap_days")
    ).where("first is not null")


@query("j11_date_pairs", f"""
    WITH {OBS}, d AS (SELECT pixel, d FROM obs WHERE z IS NOT NULL)
    SELECT a.pixel, a.d AS old, b.d AS new, CAST(date_diff('day', a.d, b.d) AS INTEGER) AS gap_days FROM d a JOIN d b ON a.pixel = b.pixel AND a.d < b.d""")
def _(spark, d):
    days = obs(spark, d).where("z is not null").groupBy("pixel").agg(F.sort_array(F.collect_list("d")).alias("ds"))
    old = days.select("pixel", "ds", F.posexplode("ds").alias("i", "old"))
    return old.select("pixel", "old", F.explode(F.slice("ds", F.col("i") + 2, F.size("ds"))).alias("new")).withColumn("gap_days", F.datediff("new", "old"))
