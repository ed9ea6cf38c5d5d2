"""Queries of line operators, streaming, and of the composite pipelines."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from ..operators import catalogue as cat, lines, raster, spatial, temporal
from ..operators.graph import shared_folder
from ..streaming import jobs
from .base import CATALOGUE, IMG, LATTICE, OBS, catalogue, img, lattice, obs, query, t
from .catalogue_queries import _GREEDY, _SCENES


def _candidates(spark, d, line: str):
    year, far, length = F.year("l_shipdate").alias("year"), F.col("l_quantity").alias("far"), (F.col("l_extendedprice") / 1000).alias("length")
    key, id_ = F.col(line).alias("line"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")
    first = t(spark, d, "lineitem").groupBy(key, id_).agg(F.min(F.struct(year, far, length)).alias("s"))
    return first.select("line", "id", "s.*", F.lit(60.0).alias("centre"))


#: A candidate joins if its year is new and it is shorter than the centre and long enough; lists keep what has joined.
_RIPPLES = """rows AS (
        SELECT l_suppkey AS line, l_orderkey * 10 + l_linenumber AS id, min({'year': year(l_shipdate), 'far': l_quantity, 'length': l_extendedprice / 1000}) AS s FROM lineitem GROUP BY 1, 2),
    c AS (SELECT line, id, CAST(s.year AS INTEGER) AS year, s.length AS length, CAST(greatest(0, ceil((s.far - 0.1::DOUBLE) / 2.0::DOUBLE)) AS INTEGER) AS ring FROM rows),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY ring, id) AS rn FROM c WHERE ring < 75 AND length >= 0.3::DOUBLE * 60 AND 60 - length >= 1e-6),
    fold AS (
        SELECT line, CAST(0 AS BIGINT) AS rn, CAST([] AS INTEGER[]) AS years, CAST([] AS INTEGER[]) AS rings, CAST([] AS BIGINT[]) AS ids FROM (SELECT DISTINCT line FROM c)
        UNION ALL
        SELECT f.line, r.rn, CASE WHEN list_contains(f.years, r.year) THEN f.years ELSE list_append(f.years, r.year) END, CASE WHEN list_contains(f.years, r.year) THEN f.rings ELSE list_append(f.rings, r.ring) END,
               CASE WHEN list_contains(f.years, r.year) THEN f.ids ELSE list_append(f.ids, r.id) END
        FROM fold f JOIN ranked r ON r.line = f.line AND r.rn = f.rn + 1),
    last AS (SELECT line, arg_max(years, rn) AS years, arg_max(rings, rn) AS rings, arg_max(ids, rn) AS ids FROM fold GROUP BY line),
    steps AS (SELECT *, list_sort(list_distinct(rings)) AS s FROM last),
    gaps AS (SELECT *, list_transform(range(1, len(s)), lambda i: (s[i + 1] - s[i]) * 2.0::DOUBLE) AS g FROM steps),
    ripples AS (
        SELECT line, CAST(len(years) AS INTEGER) AS ri_count, len(list_filter(range(1, len(years)), lambda i: years[i] > years[i + 1])) = 0 AS mono_incre,
               len(list_filter(range(1, len(years)), lambda i: years[i] < years[i + 1])) = 0 AS mono_decre,
               CASE WHEN len(g) > 0 THEN CASE WHEN len(rings) > len(s) THEN 0.0::DOUBLE ELSE list_min(g) END END AS min_gap, list_max(g) AS max_gap, array_to_string(ids, '_') AS line_ids FROM gaps)"""


@query("w10_ripple_statistics", f"WITH RECURSIVE {_RIPPLES} SELECT * FROM ripples")
def _(spark, d):
    return lines.ripples(_candidates(spark, d, "l_suppkey"), "line")


@query("p06_line_screening", f"WITH RECURSIVE {_RIPPLES.replace('SELECT l_suppkey AS line', 'SELECT l_partkey AS line')} SELECT * FROM ripples WHERE ri_count > 2 AND (mono_incre OR mono_decre)")
def _(spark, d):
    return lines.ripples(_candidates(spark, d, "l_partkey"), "line").where("ri_count > 2 and (mono_incre or mono_decre)")


@query("w14_hausdorff", f"""
    WITH {OBS}, p AS (SELECT row, col, CAST(event_id % 97 AS DOUBLE) AS x, z AS y, event_id AS n FROM obs WHERE z IS NOT NULL),
    m AS (SELECT a.row, a.col AS a, b.col AS b, a.n, min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS d FROM p a JOIN p b ON a.row = b.row AND a.col <> b.col GROUP BY ALL),
    h AS (SELECT row, a, b, max(d) AS d FROM m GROUP BY ALL)
    SELECT row, least(a, b) AS a, greatest(a, b) AS b, round(max(d), 4) AS hausdorff FROM h GROUP BY ALL""")
def _(spark, d):
    p = obs(spark, d).where("z is not null").select("row", "col", (F.col("event_id") % 97).cast("double").alias("x"), F.col("z").alias("y"), F.col("event_id").alias("n"))
    return lines.hausdorff(p, "col", "row").withColumn("hausdorff", F.round("hausdorff", 4))


@query("e04_status_stream", "SELECT user_id, arg_max(event_type, ts) AS event_type, max(ts) AS ts FROM events GROUP BY user_id")
def _(spark, d):
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(_watched(d, "events"))
    return jobs.newest_of(jobs.run_to_table(jobs.latest_status(stream, "user_id", "event_type", "ts"), "update", _state(spark)), ["user_id"])


def _watched(d: str, name: str) -> str:
    return f"{d}/{name}.parquet*"


def _state(spark) -> str:
    """A new folder for a stream in the session's shared checkpoint folder."""
    return f"{shared_folder(spark)}/stream-{uuid4().hex}"


_YEARLY = f"""{OBS}, masked AS (SELECT o.pixel, o.row, o.col, o.d, CASE WHEN o.event_id % 4 <> 1 AND coalesce(abs(o.z - r.m) <= 150, true) THEN o.z END AS z FROM obs o JOIN (SELECT pixel, median(z) AS m FROM obs GROUP BY pixel) r USING (pixel)),
    kept AS (SELECT d FROM masked GROUP BY d HAVING 100.0::DOUBLE * count(z) / count(*) >= 10)"""


def _masked(spark, d):
    """Bitmask, outlier mask against the pixel's median, then dates that keep a tenth of their pixels."""
    o = obs(spark, d)
    mask = o.select("pixel", "d", (F.col("event_id") % 4).alias("bits"))
    o = raster.masked_where(o.select("pixel", "row", "col", "d", "z"), mask, ["pixel", "d"], "z", "bits", F.col("bits") == 1)
    ref = obs(spark, d).groupBy("pixel").agg(F.median("z").alias("m"))
    o = raster.outlier_masked(o, ref, ["pixel"], "z", "m", 150.0)
    kept = o.groupBy("d").agg((100.0 * F.count("z") / F.count("*")).alias("per")).where("per >= 10").select("d")
    return o.join(kept, "d", "left_semi")


@query("p02_grouped_difference", f"""
    WITH {OBS}, g AS (SELECT pixel, CAST(date_trunc('month', d) AS DATE) + CAST(((day(d) - 1) // 10) * 10 AS INTEGER) AS d, avg(z) AS z FROM obs GROUP BY ALL)
    SELECT pixel, CASE WHEN count(z) >= 2 THEN round(arg_max(z, d) FILTER (WHERE z IS NOT NULL) - arg_min(z, d) FILTER (WHERE z IS NOT NULL), 6) END AS dz FROM g GROUP BY pixel""")
def _(spark, d):
    decade = F.date_add(F.trunc("d", "month"), F.floor((F.dayofmonth("d") - 1) / 10).cast("int") * 10)
    grouped = raster.mosaic_mean(obs(spark, d).select("pixel", decade.alias("d"), "z"), ["pixel", "d"], "z")
    return temporal.newest_minus_oldest(grouped, ["pixel"]).select("pixel", F.round("dz", 6).alias("dz"))


@query("p03_elevation_difference", f"""
    WITH {_YEARLY}, s AS (SELECT pixel, count(z) AS n, arg_max(z, d) FILTER (WHERE z IS NOT NULL) - arg_min(z, d) FILTER (WHERE z IS NOT NULL) AS dz,
        date_diff('day', min(d) FILTER (WHERE z IS NOT NULL), max(d) FILTER (WHERE z IS NOT NULL)) AS gap FROM masked WHERE d IN (SELECT d FROM kept) GROUP BY pixel)
    SELECT pixel, CASE WHEN n < 2 THEN 32767 ELSE CAST(sign(dz) * floor(abs(round(dz, 6) * 100)) AS INTEGER) END AS cm, CASE WHEN n < 2 THEN 0 ELSE CAST(gap AS INTEGER) END AS gap_days FROM s""")
def _(spark, d):
    a = temporal.newest_minus_oldest(_masked(spark, d), ["pixel"])
    return a.select("pixel", temporal.centimetres(F.round("dz", 6)).alias("cm"), "gap_days")


@query("p08_daily_mosaic", f"WITH {CATALOGUE} SELECT area % 50 AS grid, CAST(acquired AS DATE) AS d, first(scene ORDER BY cloud, scene) AS top, count(*) AS n FROM catalogue WHERE cloud <= 60 AND asset <= 2 GROUP BY ALL")
def _(spark, d):
    c = catalogue(spark, d).where("cloud <= 60 and asset <= 2")
    return c.groupBy((F.col("area") % 50).alias("grid"), F.to_date("acquired").alias("d")).agg(F.min_by("scene", F.struct("cloud", "scene")).alias("top"), F.count("*").alias("n"))


@query("p09_pair_planning", f"""
    WITH {CATALOGUE}, p AS (SELECT area, status, lag(scene) OVER (PARTITION BY area, status ORDER BY acquired, scene) AS reference, scene AS secondary FROM catalogue)
    SELECT area, status, reference, secondary, '{{"ref":' || reference || ',"sec":' || secondary || '}}' AS job FROM p WHERE reference IS NOT NULL""")
def _(spark, d):
    pairs = cat.consecutive_pairs(catalogue(spark, d), ["area", "status"], ["acquired", "scene"], "scene")
    return pairs.withColumn("job", F.to_json(F.struct(F.col("reference").alias("ref"), F.col("secondary").alias("sec"))))


@query("p11_quality_screening", f"""
    WITH {IMG}, s AS (SELECT image, 100.0::DOUBLE * count(*) FILTER (WHERE band <> 'error') / count(*) AS valid FROM img GROUP BY image),
    ent AS (SELECT image, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 4) AS entropy FROM (SELECT image, floor(v / 25) AS v, count(*) AS n FROM img WHERE v IS NOT NULL GROUP BY ALL) GROUP BY image),
    ok AS (SELECT image, entropy FROM ent JOIN s USING (image) WHERE NOT (valid < 75 OR entropy < 2))
    SELECT image // 10 AS grid, first(image ORDER BY entropy DESC, image) AS image FROM ok GROUP BY image // 10""")
def _(spark, d):
    i = img(spark, d)
    valid = i.groupBy("image").agg((100.0 * F.count_if(F.col("band") != "error") / F.count("*")).alias("valid"))
    ent = spatial.shannon_entropy(i.withColumn("v", F.floor(F.col("v") / 25)), ["image"], "v").withColumn("entropy", F.round("entropy", 4))
    ok = ent.join(valid, "image").where("not (valid < 75 or entropy < 2)")
    return ok.groupBy(F.expr("image div 10").alias("grid")).agg(F.min_by("image", F.struct(-F.col("entropy"), "image")).alias("image"))


@query("p13_acquisition_plan", f"""
    WITH RECURSIVE {CATALOGUE}, chosen AS ({_SCENES} WHERE cloud <= 50 AND scene NOT IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 6)), {_GREEDY}
    SELECT f.area, f.scene, CAST(f.gain AS INTEGER) AS gain, CAST(len(f.seen) AS INTEGER) AS covered, c.cloud, c.asset FROM fold f JOIN catalogue c USING (scene) WHERE f.gain > 0""")
def _(spark, d):
    c = catalogue(spark, d).where("cloud <= 50")
    cells = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: ((F.col("scene") * 7 + i * F.col("asset")) % 40).cast("int"))
    kind = F.when(F.col("asset") == 1, 0).when(F.col("asset") == 2, 1).otherwise(2)
    held = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("scene")).agg(F.count("*").alias("n")).where("n >= 6").select("scene")
    plan = cat.greedy_cover(c.join(held, "scene", "left_anti").withColumns({"cells": cells, "kind": kind}), "area", "scene", "cells", ["kind", "cloud", "scene"])
    return plan.join(c.select("scene", "cloud", "asset"), "scene")


@query("p16_parameter_sweep", "SELECT CAST(az AS INTEGER) AS az, CAST(rg AS INTEGER) AS rg, count(*) AS n FROM (SELECT unnest([1, 2, 4]) AS az) a, (SELECT unnest([1, 2, 4]) AS rg) b, supplier WHERE az <= rg AND s_suppkey % (az * rg) = 0 GROUP BY ALL")
def _(spark, d):
    grid = cat.parameter_grid(spark, {"az": [1, 2, 4], "rg": [1, 2, 4]}, F.col("az") <= F.col("rg"))
    return F.broadcast(grid).crossJoin(t(spark, d, "supplier")).where("s_suppkey % (az * rg) = 0").groupBy("az", "rg").agg(F.count("*").alias("n"))


@query("s28_directory_scan")
def _(spark, d):
    from ..sources.rasters import list_files

    files = list_files(spark, d, "*.parquet")
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "bytes")


@query("s29_mosaic_tile_names", "SELECT DISTINCT printf('%02d_%02d_10m_v4.1', CAST(s_suppkey * 91 % 1000 // 100 AS INTEGER), CAST(s_suppkey * 37 % 1000 // 100 AS INTEGER)) AS tile FROM supplier")
def _(spark, d):
    k = F.col("s_suppkey")
    tile = F.format_string("%02d_%02d_%s_v%s", F.floor(k * 91 % 1000 / 100).cast("int"), F.floor(k * 37 % 1000 / 100).cast("int"), F.lit("10m"), F.lit("4.1"))
    return t(spark, d, "supplier").select(tile.alias("tile")).distinct()


@query("s16_catalogue_extent_and_time", f"WITH {CATALOGUE} SELECT scene FROM catalogue WHERE area % 100 BETWEEN 20 AND 60 AND area % 37 BETWEEN 5 AND 25 AND acquired >= TIMESTAMP '1996-01-01' AND acquired < TIMESTAMP '1998-01-01'")
def _(spark, d):
    inside = (F.col("area") % 100).between(20, 60) & (F.col("area") % 37).between(5, 25)
    when = (F.col("acquired") >= F.lit("1996-01-01").cast("timestamp")) & (F.col("acquired") < F.lit("1998-01-01").cast("timestamp"))
    return catalogue(spark, d).where(inside & when).select("scene")


@query("s17_catalogue_baseline_and_overlap", f"WITH {CATALOGUE} SELECT scene FROM catalogue WHERE cloud / 101.0::DOUBLE >= 0.1 AND scene % 48 <= 24")
def _(spark, d):
    return catalogue(spark, d).where((F.col("cloud") / 101.0 >= 0.1) & (F.col("scene") % 48 <= 24)).select("scene")


@query("s22_granule_list", f"WITH {CATALOGUE} SELECT scene, cloud FROM catalogue WHERE scene IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 7)")
def _(spark, d):
    granules = t(spark, d, "lineitem").where("l_linenumber = 7").select(F.col("l_orderkey").alias("scene"))
    return catalogue(spark, d).join(granules, "scene", "left_semi").select("scene", "cloud")


def _output(spark) -> str:
    return _state(spark).replace("/stream-", "/output-")


@query("k01_pixel_sink", f"WITH {OBS} SELECT row AS grid_id, count(*) AS n, count(z) AS valid FROM obs GROUP BY row")
def _(spark, d):
    from ..sources.rasters import write_pixels

    path = _output(spark)
    write_pixels(obs(spark, d).withColumn("grid_id", F.col("row")), path)
    return spark.read.parquet(path).groupBy("grid_id").agg(F.count("*").alias("n"), F.count("z").alias("valid"))


@query("k02_vector_sink", "SELECT s_suppkey AS id, 'POLYGON ((' || x || ' ' || y || ', ' || (x + 1) || ' ' || y || ', ' || (x + 1) || ' ' || (y + 1) || ', ' || x || ' ' || (y + 1) || ', ' || x || ' ' || y || '))' AS wkt FROM (SELECT s_suppkey, s_suppkey % 90 AS x, s_suppkey % 70 AS y FROM supplier)")
def _(spark, d):
    from ..sources.rasters import write_wkt

    path, k = _output(spark), F.col("s_suppkey")
    boxes = t(spark, d, "supplier").select(k.alias("id"), (k % 90).alias("minx"), (k % 70).alias("miny"), (k % 90 + 1).alias("maxx"), (k % 70 + 1).alias("maxy"))
    write_wkt(boxes, path)
    return spark.read.parquet(path).select("id", "wkt")


@query("k03_sheet_sink", f"WITH {CATALOGUE} SELECT scene, cloud, status FROM catalogue")
def _(spark, d):
    from ..sources.rasters import write_table

    path = _output(spark)
    write_table(catalogue(spark, d).select("scene", "cloud", "status"), path)
    return spark.read.option("header", True).schema("scene long, cloud int, status string").csv(path)


@query("k05_dated_sink", f"WITH {OBS} SELECT d AS acq_date, count(*) AS n FROM obs GROUP BY d")
def _(spark, d):
    from ..sources.rasters import write_by_date

    path = _output(spark)
    write_by_date(obs(spark, d).withColumn("acq_date", F.col("d")), path)
    return spark.read.parquet(path).groupBy("acq_date").agg(F.count("*").alias("n"))
