"""Queries that write a fixture in the shared folder and read it back through the readers."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from ..operators import polygons as poly
from ..operators.graph import shared_folder
from ..sources import rasters, shapefile, text
from ..streaming import jobs
from .base import PLOTS, plots, query, t


def scratch(spark) -> str:
    return f"{shared_folder(spark)}/fixture-{uuid4().hex}"


def written_lines(lines):
    """Lines (``value``) written as text files in the shared folder, and read again."""
    path = scratch(lines.sparkSession)
    lines.write.text(path)
    return lines.sparkSession.read.text(path)


@query("s01_pixel_window_scan", "SELECT event_id, user_id AS pixel, nullif(value, 0.0::DOUBLE) AS v FROM events WHERE user_id BETWEEN 20 AND 59")
def _(spark, d):
    path = scratch(spark)
    pixel = F.col("user_id")
    rows = t(spark, d, "events").select("event_id", pixel.alias("pixel"), F.expr("cast(user_id div 10 as int)").alias("row"), (pixel % 10).cast("int").alias("col"), F.col("value").alias("v"), (pixel % 3).alias("grid_id"))
    rasters.write_pixels(rows, path)
    return rasters.read_pixels(spark, path, (2, 0, 5, 9), 0.0).select("event_id", "pixel", "v")


@query("s05_footprint_json", f"WITH {PLOTS} SELECT CAST(zone AS VARCHAR) AS id, min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy FROM pv WHERE ring = 0 GROUP BY zone")
def _(spark, d):
    path = scratch(spark)
    rings = F.transform("parts", lambda g: F.transform(g, lambda p: F.array(p["x"], p["y"])))
    feature = F.struct(F.lit("Feature").alias("type"), F.col("zone").cast("string").alias("id"), F.struct(F.lit("Polygon").alias("type"), rings.alias("coordinates")).alias("geometry"))
    files = plots(spark, d).groupBy((F.col("zone") % 4).alias("file")).agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(feature).alias("features"))).alias("value"))
    files.repartition("file").write.partitionBy("file").text(path)
    return rasters.read_footprints(spark, path)


@query("s06_xml_metadata", """
    SELECT o_orderkey AS scene, CAST(CAST(floor(o_totalprice) AS BIGINT) % 101 AS DOUBLE) AS cloud, CAST(o_orderdate AS DATE) AS acquired FROM orders""")
def _(spark, d):
    path = scratch(spark)
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value.cast("string"), F.lit(f"</{name}>"))
    row = tag("scene", F.concat(tag("id", F.col("o_orderkey")), tag("cloudCoverPercentage", F.floor("o_totalprice") % 101), tag("acquisitionDateTime", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))))
    files = t(spark, d, "orders").groupBy((F.col("o_orderkey") % 8).alias("file")).agg(F.concat(F.lit("<scenes>"), F.array_join(F.collect_list(row), ""), F.lit("</scenes>")).alias("value"))
    files.repartition("file").write.partitionBy("file").text(path)
    m = rasters.read_metadata_xml(spark, path, "scene")
    return m.select(F.col("id").cast("long").alias("scene"), F.col("cloudCoverPercentage").cast("double").alias("cloud"), F.to_date(F.substring(F.col("acquisitionDateTime").cast("string"), 1, 10)).alias("acquired"))


def _lines(spark, rows):
    path = scratch(spark)
    rows.write.text(path)
    return spark.read.text(path)


@query("s08_box_lines", """SELECT 'PDO' || c_custkey AS name, CAST(c_custkey % 360 - 180 AS DOUBLE) AS minx, CAST(c_custkey % 180 - 90 AS DOUBLE) AS miny, CAST(c_custkey % 360 - 179 AS DOUBLE) AS maxx,
    CAST(c_custkey % 180 - 88 AS DOUBLE) AS maxy FROM customer WHERE c_custkey % 3 = 0""")
def _(spark, d):
    k = F.col("c_custkey")
    line = F.concat_ws(",", F.concat(F.when(k % 3 == 0, "PDO").otherwise("X"), k.cast("string")), *[x.cast("string") for x in (k % 360 - 180, k % 180 - 90, k % 360 - 179, k % 180 - 88)])
    return text.parse_boxes(_lines(spark, t(spark, d, "customer").select(line.alias("value"))))


@query("s13_feature_counts", "SELECT '/data/' || l_suppkey || '.gpkg' AS path, count(*) AS n FROM lineitem GROUP BY l_suppkey")
def _(spark, d):
    lines = t(spark, d, "lineitem").groupBy("l_suppkey").count().select(F.format_string("/data/%d.gpkg, Feature Count: %d", "l_suppkey", "count").alias("value"))
    return text.parse_feature_counts(_lines(spark, lines.unionByName(spark.range(3).select(F.lit("no count").alias("value")))))


@query("s27_many_file_view", "SELECT CAST(s_suppkey % 3 AS INTEGER) AS priority, count(*) AS n, sum(s_suppkey) AS total FROM supplier GROUP BY ALL")
def _(spark, d):
    paths = []
    for i in range(3):
        paths.append(scratch(spark))
        t(spark, d, "supplier").where(F.col("s_suppkey") % 3 == i).write.parquet(paths[-1])
    return rasters.read_virtual_mosaic(spark, paths).groupBy("priority").agg(F.count("*").alias("n"), F.sum("s_suppkey").alias("total"))


@query("e02_new_files_stream", "SELECT event_type, count(*) AS n, CAST(2 AS BIGINT) AS batches FROM events GROUP BY event_type")
def _(spark, d):
    """A folder that files come to: what has come is handed on at each call, each file once, two at a time."""
    events = t(spark, d, "events").select("event_id", "event_type")
    folder, progress, out = scratch(spark), scratch(spark), scratch(spark)

    def put(rows, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    for part in range(2):
        events.where(F.pmod(F.xxhash64("event_id"), F.lit(2)) == part).repartition(2).write.mode("append").parquet(folder)
        for _ in range(2):  # the second call finds nothing new
            jobs.new_files(spark, folder, "event_id long, event_type string", progress, put, 2)
    seen = spark.read.parquet(out)
    return seen.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("batch").alias("batches"))


@query("e08_back_pressure", "SELECT count(*) AS n, CAST(4 AS BIGINT) AS batches FROM orders")
def _(spark, d):
    """Four files come at once and are taken one at a time."""
    folder = scratch(spark)
    t(spark, d, "orders").select("o_orderkey").repartition(4).write.parquet(folder)
    stream = spark.readStream.schema("o_orderkey long").option("maxFilesPerTrigger", 1).parquet(folder)
    rows = jobs.run_to_table(stream, "append", scratch(spark))
    return rows.agg(F.count("*").alias("n"), F.count_distinct("batch").alias("batches"))


@query("s04_vector_layer", f"""
    WITH {PLOTS}, r AS (SELECT zone, count(DISTINCT ring) AS rings, abs(sum(x0 * y1 - x1 * y0)) / 2 AS area FROM e GROUP BY zone)
    SELECT zone, s_name AS name, minx, maxy, CAST(rings AS INTEGER) AS rings, area FROM plots JOIN r USING (zone) JOIN supplier ON s_suppkey = zone WHERE minx <= 600 AND maxx >= 150 AND miny <= 700 AND maxy >= 100""")
def _(spark, d):
    # plots with names are written as layers and read again by ranges of records, those that meet a box
    path = f"{shared_folder(spark)}/layer-{uuid4().hex}"
    named = plots(spark, d).join(t(spark, d, "supplier").select(F.col("s_suppkey").alias("zone"), F.col("s_name").alias("name")), "zone")
    shapefile.write_layer(named, path, {"zone": 12, "name": 40})
    layer = shapefile.read_layer(spark, path, (150.0, 100.0, 600.0, 700.0), range_bytes=1 << 16)
    return layer.select(F.col("fields.zone").cast("long").alias("zone"), F.col("fields.name").alias("name"), "minx", "maxy", F.size("parts").alias("rings"), poly.area("parts").alias("area"))


@query("e03_settled_counts", "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR GROUP BY ALL")
def _(spark, d):
    """Counts of days are handed on once a day's end is 24 hours old; files come in order, the newest last."""
    instant = F.expr("timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts))")
    events = t(spark, d, "events").select("event_id", "event_type", instant.alias("ts"))
    folder = scratch(spark)
    events.repartitionByRange(3, "ts").sortWithinPartitions("ts").write.parquet(folder)
    stream = spark.readStream.schema(events.schema).parquet(folder)
    settled = jobs.run_to_table(jobs.settled_counts(stream, "ts", "event_type"), "append", scratch(spark))
    return settled.select(F.expr("date_add(DATE '1970-01-01', cast(unix_seconds(start) div 86400 as int))").alias("day"), "event_type", "n")


@query("s12_id_list", "SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'F'")
def _(spark, d):
    ids = t(spark, d, "orders").where("o_orderstatus = 'F'").select(F.explode(F.array(F.concat(F.lit(" "), F.col("o_custkey").cast("string")), F.concat(F.lit("# "), F.col("o_custkey").cast("string")), F.lit(""))).alias("value"))
    return text.parse_ids(written_lines(ids))
