"""Queries over scene catalogues, their files and names."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import catalogue as op
from ..operators.bookkeeping import numbered
from .base import age_hours, CATALOGUE, catalogue, IMG, img, NAMES, names, OBJECTS, objects, OBS, obs, PLOTS, plots, query, t


def _base():
    """File name at the end of a path."""
    return F.regexp_extract("path", r"[^/]+$", 0)


@query("s07_scene_rows", f"""
    WITH {CATALOGUE}, f AS (SELECT l_orderkey AS scene, count(*) AS asset_count, string_agg(CAST(l_partkey AS VARCHAR) || '.tif', ',' ORDER BY CAST(l_partkey AS VARCHAR) || '.tif') AS asset_files FROM lineitem GROUP BY l_orderkey)
    SELECT c.scene, coalesce(CASE WHEN c.cloud < 90 THEN c.cloud END, 101) AS cloud, coalesce(CASE WHEN c.status <> 'P' THEN CAST(c.acquired AS DATE) END, DATE '1970-01-01') AS acquired,
           coalesce(f.asset_count, 0) AS asset_count, coalesce(f.asset_files, '') AS asset_files FROM catalogue c LEFT JOIN f USING (scene)""")
def _(spark, d):
    name = F.concat(F.col("l_partkey").cast("string"), F.lit(".tif"))
    files = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("scene")).agg(F.count("*").alias("asset_count"), F.array_join(F.sort_array(F.collect_list(name)), ",").alias("asset_files"))
    c = catalogue(spark, d)
    return c.join(files, "scene", "left").select(
        "scene", F.coalesce(F.when(F.col("cloud") < 90, F.col("cloud")), F.lit(101)).alias("cloud"),
        F.coalesce(F.when(F.col("status") != "P", F.to_date("acquired")), F.lit("1970-01-01").cast("date")).alias("acquired"),
        F.coalesce("asset_count", F.lit(0)).cast("long").alias("asset_count"), F.coalesce("asset_files", F.lit("")).alias("asset_files"),
    )


@query("s11_sidecar_maps", "SELECT event_id, 'k' AS key, CAST(json_extract(props, '$.k') AS BIGINT) AS value FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def _(spark, d):
    return t(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,long>")).alias("key", "value")).where("value is not null")


@query("s14_colour_table", "SELECT CAST(p_partkey AS DOUBLE) / 2 AS value, p_size * 5 AS r, CAST(p_partkey % 256 AS INTEGER) AS g, CAST(p_partkey * 7 % 256 AS INTEGER) AS b, 255 AS alpha, p_brand AS label FROM part")
def _(spark, d):
    from ..sources.text import parse_colour_table
    from .source_queries import written_lines

    k = F.col("p_partkey")
    colours = F.concat_ws(",", F.format_string("%.1f", k / 2), (F.col("p_size") * 5).cast("string"), (k % 256).cast("string"), (k * 7 % 256).cast("string"), F.lit("255"), F.concat(F.lit(" "), "p_brand"))
    line = F.explode(F.array(F.concat(F.lit("# part "), k.cast("string")), F.lit("INTERPOLATION:INTERPOLATED"), colours, F.lit("nv,0,0,0,0,nodata")))
    return parse_colour_table(written_lines(t(spark, d, "part").select(line.alias("value")))).where("not nodata").drop("nodata")


@query("s15_band_triples", f"WITH {IMG} SELECT image, event_id, CASE band WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS position, v FROM img WHERE band IN ('view', 'click', 'purchase')")
def _(spark, d):
    order = F.create_map(*[x for i, b in enumerate(("view", "click", "purchase"), 1) for x in (F.lit(b), F.lit(i))])
    return img(spark, d).where(F.col("band").isin("view", "click", "purchase")).select("image", "event_id", order[F.col("band")].alias("position"), "v")


@query("s18_catalogue_search", f"WITH {CATALOGUE} SELECT CAST(year(acquired) AS INTEGER) AS year, count(*) AS n FROM catalogue WHERE acquired >= TIMESTAMP '1996-01-01' AND acquired <= TIMESTAMP '1999-12-31' AND cloud <= 30 GROUP BY 1")
def _(spark, d):
    c = catalogue(spark, d).where((F.col("acquired") >= F.lit("1996-01-01").cast("timestamp")) & (F.col("acquired") <= F.lit("1999-12-31").cast("timestamp")) & (F.col("cloud") <= 30))
    return c.groupBy(F.year("acquired").alias("year")).agg(F.count("*").alias("n"))


@query("s19_clearest_scenes", f"WITH {CATALOGUE} SELECT scene, cloud FROM catalogue WHERE month(acquired) BETWEEN 6 AND 9 AND cloud < 20 ORDER BY cloud, scene LIMIT 30")
def _(spark, d):
    c = catalogue(spark, d).where(F.month("acquired").between(6, 9) & (F.col("cloud") < 20))
    return c.orderBy("cloud", "scene").limit(30).select("scene", "cloud")


@query("s20_polarisation_query", f"WITH {CATALOGUE} SELECT scene FROM catalogue WHERE list_contains(['V' || asset, status], 'V2') AND status = 'O'")
def _(spark, d):
    tags = F.array(F.concat(F.lit("V"), F.col("asset").cast("string")), F.col("status"))
    return catalogue(spark, d).where(F.array_contains(tags, "V2") & (F.col("status") == "O")).select("scene")


@query("s21_date_product_band_windows", """
    WITH w AS (SELECT DATE '1997-06-01' + CAST(i * 7 AS INTEGER) AS day, p AS product FROM (SELECT unnest(range(0, 20)) AS i) a, (SELECT unnest(['F', 'O']) AS p) b)
    SELECT CAST(w.day AS DATE) AS day, w.product, count(o.o_orderkey) AS n FROM w LEFT JOIN orders o ON o.o_orderdate >= w.day AND o.o_orderdate < w.day + INTERVAL 1 DAY AND o.o_orderstatus = w.product GROUP BY ALL""")
def _(spark, d):
    days = spark.sql("SELECT explode(sequence(DATE'1997-06-01', DATE'1997-10-12', INTERVAL 7 DAY)) AS day").crossJoin(spark.sql("SELECT explode(array('F', 'O')) AS product"))
    o = t(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day"), F.col("o_orderstatus").alias("product")).agg(F.count("*").alias("n"))
    return days.join(o, ["day", "product"], "left").select("day", "product", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


_RADII = "CASE WHEN n7 >= 2 THEN 7 WHEN n14 >= 2 THEN 14 WHEN n28 >= 2 THEN 28 ELSE 60 END"


@query("s23_widening_window", f"""
    WITH {OBS}, p AS (SELECT pixel, event_id, CAST(date_diff('day', DATE '2024-01-15', d) AS INTEGER) AS days FROM obs WHERE flag = 'purchase'),
    r AS (SELECT pixel, {_RADII} AS radius FROM (SELECT pixel, count(*) FILTER (WHERE abs(days) <= 7) AS n7, count(*) FILTER (WHERE abs(days) <= 14) AS n14, count(*) FILTER (WHERE abs(days) <= 28) AS n28 FROM p GROUP BY pixel))
    SELECT pixel, event_id, days, radius FROM p JOIN r USING (pixel) WHERE abs(days) <= radius""")
def _(spark, d):
    p = obs(spark, d).where("flag = 'purchase'").select("pixel", "event_id", F.datediff("d", F.lit("2024-01-15").cast("date")).alias("days"))
    return op.smallest_enough_window(p, ["pixel"], "days", [7, 14, 28, 60], 2).select("pixel", "event_id", "days", "radius")


@query("s24_urls_to_fetch", f"WITH {NAMES} SELECT DISTINCT path FROM names WHERE path NOT LIKE 'ext03/%' AND id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def _(spark, d):
    have = t(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    return names(spark, d).where(~F.col("path").startswith("ext03/")).join(have, "id", "left_anti").select("path").distinct()


@query("s25_degree_tiles", f"""
    WITH {OBJECTS}, e AS (SELECT floor(min(minx) / 20) AS x0, ceil(max(maxx) / 20) AS x1, floor(min(miny) / 20) AS y0, ceil(max(maxy) / 20) AS y1 FROM objects),
    g AS (SELECT unnest(range(CAST(y0 AS BIGINT), CAST(y1 AS BIGINT))) AS lat, x0, x1 FROM e), h AS (SELECT lat, unnest(range(CAST(x0 AS BIGINT), CAST(x1 AS BIGINT))) AS lon FROM g)
    SELECT printf('DSM_COG_10_N%02d_00_E%03d_00_DEM', lat, lon) AS tile FROM h""")
def _(spark, d):
    e = objects(spark, d).agg(*[F.floor(F.min(c) / 20).alias(f"{c}0") for c in ("minx", "miny")], *[F.ceil(F.max(c) / 20).alias(f"{c}1") for c in ("maxx", "maxy")])
    g = e.select(F.explode(F.sequence(F.col("miny0"), F.col("maxy1") - 1)).alias("lat"), "minx0", "maxx1").select("lat", F.explode(F.sequence(F.col("minx0"), F.col("maxx1") - 1)).alias("lon"))
    return g.select(F.format_string("DSM_COG_10_N%02d_00_E%03d_00_DEM", "lat", "lon").alias("tile"))


@query("s26_sizes_per_extent", f"""
    WITH {NAMES} SELECT split_part(path, '/', 1) AS extent, count(*) AS n_files, count(*) FILTER (WHERE line = 7) AS n_unknown,
           round(sum(CASE WHEN line <> 7 THEN bytes END) / 1073741824.0::DOUBLE, 8) AS gb FROM names GROUP BY 1""")
def _(spark, d):
    known = F.when(F.col("line") != 7, F.col("bytes"))
    return names(spark, d).groupBy(F.split("path", "/")[0].alias("extent")).agg(
        F.count("*").alias("n_files"), F.count_if(F.col("line") == 7).alias("n_unknown"), F.round(F.sum(known) / 1073741824.0, 8).alias("gb")
    )


@query("s30_collection_bands", f"WITH {CATALOGUE} SELECT scene, unnest(CASE WHEN status = 'F' THEN ['dem', 'mask', 'matchtag'] ELSE ['dem'] END) AS band FROM catalogue")
def _(spark, d):
    bands = F.when(F.col("status") == "F", F.array(F.lit("dem"), F.lit("mask"), F.lit("matchtag"))).otherwise(F.array(F.lit("dem")))
    return catalogue(spark, d).select("scene", F.explode(bands).alias("band"))


_MISSION = "CASE asset WHEN 1 THEN 'sentinel-1' WHEN 2 THEN 'ers' ELSE 'envisat' END"


@query("s31_files_by_mission", f"WITH {CATALOGUE} SELECT {_MISSION} AS mission, count(*) AS n FROM catalogue WHERE CASE asset WHEN 1 THEN status = 'F' WHEN 2 THEN status IN ('O', 'P') ELSE status = 'O' END GROUP BY 1")
def _(spark, d):
    mission = F.when(F.col("asset") == 1, "sentinel-1").when(F.col("asset") == 2, "ers").otherwise("envisat")
    wanted = F.when(F.col("asset") == 1, F.col("status") == "F").when(F.col("asset") == 2, F.col("status").isin("O", "P")).otherwise(F.col("status") == "O")
    return catalogue(spark, d).where(wanted).groupBy(mission.alias("mission")).agg(F.count("*").alias("n"))


@query("s32_known_footprints", "SELECT l_orderkey AS scene, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY l_orderkey HAVING count(*) >= 3")
def _(spark, d):
    from ..sources.text import parse_excluded_scenes
    from .source_queries import written_lines

    name = F.format_string("scene%08d", F.col("o_orderkey"))
    line = F.explode(F.array(F.concat(F.lit(" "), name), F.concat(F.lit("#"), name), F.lit("x")))
    excluded = parse_excluded_scenes(written_lines(t(spark, d, "orders").where("o_orderstatus = 'P'").select(line.alias("value"))))
    n = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("scene")).agg(F.count("*").alias("n")).where("n >= 3")
    return n.join(excluded.select(F.substring("scene", 6, 8).cast("long").alias("scene")), "scene", "left_anti")


@query("s33_seasonal_loop", f"""
    WITH {CATALOGUE}, y AS (SELECT unnest(range(1990, 2001)) AS year)
    SELECT CAST(y.year AS INTEGER) AS year, count(scene) AS n FROM y LEFT JOIN catalogue c ON year(c.acquired) = y.year AND month(c.acquired) IN (6, 7, 8) GROUP BY y.year""")
def _(spark, d):
    years = spark.sql("SELECT explode(sequence(1990, 2000)) AS year")
    n = catalogue(spark, d).where(F.month("acquired").isin(6, 7, 8)).groupBy(F.year("acquired").alias("year")).agg(F.count("*").alias("n"))
    return years.join(n, "year", "left").select("year", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("s35_unpack_choice", f"""
    WITH {NAMES}, c AS (SELECT id, path, CASE WHEN id % 2 = 0 THEN 1 ELSE 2 END AS rank FROM names WHERE id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'))
    SELECT id, first(path ORDER BY rank, path) AS path FROM c GROUP BY id""")
def _(spark, d):
    registered = t(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    rank = F.when(F.col("id") % 2 == 0, 1).otherwise(2)
    return names(spark, d).join(registered, "id", "left_anti").groupBy("id").agg(F.min_by("path", F.struct(rank, "path")).alias("path"))


@query("f01_month_filter", f"WITH {NAMES} SELECT id, path FROM names WHERE month(strptime(regexp_extract(path, '([0-9]{{8}})_', 1), '%Y%m%d')) IN (6, 7, 8, 9)")
def _(spark, d):
    return names(spark, d).where(F.month(F.to_date(F.regexp_extract("path", r"([0-9]{8})_", 1), "yyyyMMdd")).isin(6, 7, 8, 9)).select("id", "path")


@query("f02_year_filter", f"WITH {CATALOGUE} SELECT scene, strftime(acquired, '%Y-%m-%d') AS acquired FROM catalogue WHERE year(acquired) >= 1998")
def _(spark, d):
    return catalogue(spark, d).where(F.year("acquired") >= 1998).select("scene", F.date_format("acquired", "yyyy-MM-dd").alias("acquired"))


_VALID = "per AS (SELECT pixel, 100.0::DOUBLE * count(z) / count(*) AS per FROM obs GROUP BY pixel)"


def _valid(spark, d):
    return obs(spark, d).groupBy("pixel").agg((100.0 * F.count("z") / F.count("*")).alias("per"))


@query("f03_valid_percent_filter", f"WITH {OBS}, {_VALID} SELECT pixel, round(per, 4) AS per FROM per WHERE per >= 80")
def _(spark, d):
    return _valid(spark, d).where("per >= 80").select("pixel", F.round("per", 4).alias("per"))


@query("f04_valid_percent_or_unknown", f"WITH {OBS}, {_VALID} SELECT c_custkey AS dem FROM customer LEFT JOIN per ON pixel = c_custkey WHERE per > 80 OR per IS NULL")
def _(spark, d):
    per = _valid(spark, d)
    return t(spark, d, "customer").join(per, F.col("c_custkey") == per.pixel, "left").where("per > 80 or per is null").select(F.col("c_custkey").alias("dem"))


@query("f08_attribute_range", "SELECT p_partkey, p_size < 30 AS below, p_size > 10 AS above, p_size >= 10 AND p_size <= 30 AS inside FROM part WHERE p_retailprice >= 950")
def _(spark, d):
    s = F.col("p_size")
    return t(spark, d, "part").where("p_retailprice >= 950").select(
        "p_partkey", op.in_range(s, None, 30).alias("below"), op.in_range(s, 10, None).alias("above"), op.in_range(s, 10, 30).alias("inside")
    )


@query("f14_relative_difference", f"""
    WITH {OBS}, m AS (SELECT row, col, avg(z) AS m FROM obs GROUP BY row, col), s AS (SELECT row, avg(z) AS s FROM obs GROUP BY row)
    SELECT CAST(row_number() OVER (ORDER BY row, col) AS INTEGER) AS poly_id, row, col, round(m - s, 6) AS rel FROM m JOIN s USING (row) WHERE m - s <= 0 AND col >= 2""")
def _(spark, d):
    o = obs(spark, d)
    m, s = o.groupBy("row", "col").agg(F.avg("z").alias("m")), o.groupBy("row").agg(F.avg("z").alias("s"))
    kept = m.join(s, "row").withColumn("rel", F.col("m") - F.col("s")).where("rel <= 0 and col >= 2")
    return numbered(kept, ["row", "col"], "poly_id").select(F.col("poly_id").cast("int").alias("poly_id"), "row", "col", F.round("rel", 6).alias("rel"))


@query("f16_candidate_predicate", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_linenumber > 2 AND (l_quantity > 25 OR l_discount > 0.05) AND l_tax < 0.06 AND l_extendedprice > 1000")
def _(spark, d):
    return t(spark, d, "lineitem").where("l_linenumber > 2 and (l_quantity > 25 or l_discount > 0.05D) and l_tax < 0.06D and l_extendedprice > 1000").select("l_orderkey", "l_linenumber", "l_partkey")


@query("f17_cloud_and_product_choice", f"""
    WITH {CATALOGUE}, a AS (SELECT area, min(cloud) AS cloud, min(scene) FILTER (WHERE asset = 1) AS sr, count(*) FILTER (WHERE asset = 1) AS n_sr, min(scene) FILTER (WHERE asset = 2) AS ms, count(*) FILTER (WHERE asset = 2) AS n_ms FROM catalogue GROUP BY area)
    SELECT area, coalesce(sr, ms) AS scene FROM a WHERE CASE WHEN n_sr > 0 THEN n_sr = 1 ELSE n_ms = 1 END AND cloud <= 30""")
def _(spark, d):
    sr, ms = F.col("asset") == 1, F.col("asset") == 2
    a = catalogue(spark, d).groupBy("area").agg(
        F.min("cloud").alias("cloud"), F.min(F.when(sr, F.col("scene"))).alias("sr"), F.count_if(sr).alias("n_sr"), F.min(F.when(ms, F.col("scene"))).alias("ms"), F.count_if(ms).alias("n_ms")
    )
    return a.where(F.when(F.col("n_sr") > 0, F.col("n_sr") == 1).otherwise(F.col("n_ms") == 1) & (F.col("cloud") <= 30)).select("area", F.coalesce("sr", "ms").alias("scene"))


@query("f18_name_exclusion", f"WITH {NAMES} SELECT DISTINCT path FROM names WHERE NOT regexp_matches(path, 'SETSM_1|_2_dem|ext06')")
def _(spark, d):
    return names(spark, d).where(~F.col("path").rlike("SETSM_1|_2_dem|ext06")).select("path").distinct()


@query("f19_age_filter", "SELECT event_id FROM events WHERE date_diff('second', ts, TIMESTAMP '2024-01-31 00:00:00') / 3600.0::DOUBLE > 24")
def _(spark, d):
    age = age_hours("ts", "2024-01-31 00:00:00")
    return t(spark, d, "events").where(age > 24).select("event_id")


@query("f28_downloadable_assets", "SELECT event_id, 'asset' || event_type AS asset FROM events")
def _(spark, d):
    permissions = F.array(F.concat(F.lit("assets.asset"), F.col("event_type"), F.lit(":download")))
    return t(spark, d, "events").select("event_id", F.explode(F.transform(permissions, lambda x: F.split(F.split(x, ":")[0], r"\.")[1])).alias("asset"))


@query("f29_integrity_split", f"WITH {NAMES} SELECT id, min(bytes) > 2000 AS good, count(*) AS n FROM names WHERE id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') GROUP BY id")
def _(spark, d):
    known = t(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("id"))
    return names(spark, d).join(known, "id", "left_anti").groupBy("id").agg((F.min("bytes") > 2000).alias("good"), F.count("*").alias("n"))


@query("f30_multi_band", f"WITH {IMG} SELECT image FROM img GROUP BY image HAVING count(DISTINCT band) > 1")
def _(spark, d):
    return img(spark, d).groupBy("image").agg(F.count_distinct("band").alias("n")).where("n > 1").select("image")


@query("f31_path_keys", f"""
    WITH {NAMES} SELECT id, line, path, CAST(regexp_extract(path, 'grid([0-9]+)', 1) AS INTEGER) AS grid, regexp_extract(path, 'SETSM_[0-9]+_[0-9]+') AS strip, split_part(path, '/', 1) AS extent FROM names""")
def _(spark, d):
    return names(spark, d).select(
        "id", "line", "path", F.regexp_extract("path", r"grid([0-9]+)", 1).cast("int").alias("grid"), F.regexp_extract("path", r"SETSM_[0-9]+_[0-9]+", 0).alias("strip"), F.split("path", "/")[0].alias("extent")
    )


@query("f32_product_names", f"WITH {NAMES} SELECT id, line, path, regexp_replace(regexp_extract(path, '[^/]+$'), '[^0-9]', '', 'g') AS digits, split_part(path, '/', 3) AS file, 'product_' || split_part(path, '/', 2) || '.tar.gz' AS product FROM names")
def _(spark, d):
    return names(spark, d).select(
        "id", "line", "path", F.regexp_replace(_base(), r"\D", "").alias("digits"), F.element_at(F.split("path", "/"), -1).alias("file"),
        F.concat(F.lit("product_"), F.split("path", "/")[1], F.lit(".tar.gz")).alias("product"),
    )


@query("f33_multi_value_rows", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_linenumber IN (1, 2) AND l_quantity IN (1, 2)")
def _(spark, d):
    keep = F.forall(F.array(F.col("l_linenumber").cast("double"), F.col("l_quantity")), lambda x: F.array_contains(F.array(F.lit(1.0), F.lit(2.0)), x))
    return t(spark, d, "lineitem").where(keep).select("l_orderkey", "l_linenumber", "l_partkey")


@query("f34_key_agreement", f"WITH {NAMES} SELECT id, line, path, regexp_extract(path, 'grid([0-9]+)', 1) = regexp_extract(path, 'SETSM_([0-9]+)', 1) AS agrees FROM names")
def _(spark, d):
    return names(spark, d).select("id", "line", "path", (F.regexp_extract("path", r"grid([0-9]+)", 1) == F.regexp_extract("path", r"SETSM_([0-9]+)", 1)).alias("agrees"))


@query("f36_suffix_rename", f"WITH {NAMES} SELECT DISTINCT CASE WHEN p LIKE '%_dem.tif' THEN p ELSE regexp_replace(p, '\\.tif$', '_dem.tif') END AS path FROM (SELECT CASE WHEN line % 2 = 0 THEN path ELSE replace(path, '_dem.tif', '.tif') END AS p FROM names)")
def _(spark, d):
    p = names(spark, d).select(F.when(F.col("line") % 2 == 0, F.col("path")).otherwise(F.replace("path", F.lit("_dem.tif"), F.lit(".tif"))).alias("p"))
    return p.select(F.when(F.endswith("p", F.lit("_dem.tif")), F.col("p")).otherwise(F.regexp_replace("p", r"\.tif$", "_dem.tif")).alias("path")).distinct()


@query("f37_asset_file_exists", f"""
    WITH {CATALOGUE} SELECT scene, CAST(scene AS VARCHAR) || CASE asset WHEN 1 THEN '_SR.tif' WHEN 2 THEN '_MS.tif' WHEN 3 THEN '_udm.tif' ELSE '_meta.xml' END AS file,
           scene IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber > 3) AS present FROM catalogue""")
def _(spark, d):
    tail = F.when(F.col("asset") == 1, "_SR.tif").when(F.col("asset") == 2, "_MS.tif").when(F.col("asset") == 3, "_udm.tif").otherwise("_meta.xml")
    have = t(spark, d, "lineitem").where("l_linenumber > 3").select(F.col("l_orderkey").alias("scene")).distinct().withColumn("present", F.lit(True))
    return catalogue(spark, d).join(have, "scene", "left").select("scene", F.concat(F.col("scene").cast("string"), tail).alias("file"), F.coalesce("present", F.lit(False)).alias("present"))


@query("t01_clearest_n", f"WITH {CATALOGUE} SELECT scene, cloud FROM catalogue ORDER BY cloud, scene LIMIT 3")
def _(spark, d):
    return catalogue(spark, d).orderBy("cloud", "scene").limit(3).select("scene", "cloud")


@query("t02_valid_percent_ranked", f"WITH {OBS}, {_VALID} SELECT pixel, round(per, 4) AS per, CAST(row_number() OVER (ORDER BY round(per, 4) DESC, pixel) AS INTEGER) AS place FROM per")
def _(spark, d):
    per = _valid(spark, d).select("pixel", F.round("per", 4).alias("per"))
    return numbered(per, [F.desc("per"), F.col("pixel")], "place").withColumn("place", F.col("place").cast("int"))


@query("t03_groups_in_date_order", f"WITH {OBS} SELECT d, count(*) AS n FROM obs GROUP BY d ORDER BY d")
def _(spark, d):
    return obs(spark, d).groupBy("d").agg(F.count("*").alias("n")).orderBy("d")


@query("t04_class_then_cloud", f"WITH {CATALOGUE} SELECT area, scene, CAST(row_number() OVER (PARTITION BY area ORDER BY CASE asset WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END, cloud, scene) AS INTEGER) AS place FROM catalogue")
def _(spark, d):
    kind = F.when(F.col("asset") == 1, 0).when(F.col("asset") == 2, 1).otherwise(2)
    return catalogue(spark, d).select("area", "scene", F.row_number().over(Window.partitionBy("area").orderBy(kind, "cloud", "scene")).alias("place"))


@query("t05_first_work_list", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' ORDER BY o_orderkey LIMIT 20")
def _(spark, d):
    return t(spark, d, "orders").where("o_orderstatus <> 'F'").orderBy("o_orderkey").limit(20).select("o_orderkey")


_GREEDY = """ranked AS (SELECT area, scene, list_distinct(cells) AS cells, row_number() OVER (PARTITION BY area ORDER BY kind, cloud, scene) AS rn FROM chosen),
    fold AS (
        SELECT area, CAST(0 AS BIGINT) AS rn, CAST([] AS INTEGER[]) AS seen, CAST(NULL AS BIGINT) AS scene, CAST(0 AS BIGINT) AS gain FROM (SELECT DISTINCT area FROM ranked)
        UNION ALL
        SELECT f.area, r.rn, list_distinct(list_concat(f.seen, r.cells)), r.scene, len(list_distinct(list_concat(f.seen, r.cells))) - len(f.seen) FROM fold f JOIN ranked r ON r.area = f.area AND r.rn = f.rn + 1)"""
_SCENES = """SELECT area, scene, cloud, asset, CASE asset WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS kind,
        list_transform(range(0, 6), lambda i: CAST((scene * 7 + i * asset) % 40 AS INTEGER)) AS cells FROM catalogue"""


@query("w06_greedy_set_cover", f"""
    WITH RECURSIVE {CATALOGUE}, chosen AS ({_SCENES}), {_GREEDY}
    SELECT area, scene, CAST(gain AS INTEGER) AS gain, CAST(len(seen) AS INTEGER) AS covered FROM fold WHERE gain > 0""")
def _(spark, d):
    c = catalogue(spark, d)
    cells = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: ((F.col("scene") * 7 + i * F.col("asset")) % 40).cast("int"))
    kind = F.when(F.col("asset") == 1, 0).when(F.col("asset") == 2, 1).otherwise(2)
    return op.greedy_cover(c.withColumns({"cells": cells, "kind": kind}), "area", "scene", "cells", ["kind", "cloud", "scene"])


_PICK = "first({{'scene': i.scene, 'cells': i.cells}} ORDER BY i.valid DESC, i.scene) FILTER (WHERE NOT list_contains(s.taken, i.scene){})"


@query("w05_monthly_greedy_rounds", f"""
    WITH RECURSIVE {CATALOGUE}, items AS (
        SELECT area % 20 AS block, strftime(acquired, '%Y-%m') AS month, scene, 100 - cloud AS valid, list_distinct(list_transform(range(0, 15), lambda i: CAST((scene * 3 + i * (asset + 1)) % 100 AS INTEGER))) AS cells FROM catalogue WHERE acquired IS NOT NULL),
    many AS (SELECT block, month FROM items GROUP BY ALL HAVING count(*) > 3),
    steps AS (
        SELECT block, month, 0 AS round, CAST([] AS INTEGER[]) AS cover, CAST([] AS BIGINT[]) AS taken, CAST(NULL AS BIGINT) AS scene FROM many UNION ALL
        SELECT block, month, CASE WHEN more IS NULL THEN round + 1 ELSE round END, CASE WHEN more IS NULL THEN fresh.cells ELSE list_distinct(cover || more.cells) END, taken || [coalesce(more.scene, fresh.scene)], coalesce(more.scene, fresh.scene)
        FROM (SELECT s.block, s.month, s.round, any_value(s.cover) AS cover, any_value(s.taken) AS taken, {_PICK.format("")} AS fresh,
                {_PICK.format(" AND s.round > 0 AND len(s.cover) / 100.0::DOUBLE <= 0.95::DOUBLE AND len(list_filter(i.cells, lambda x: NOT list_contains(s.cover, x))) / 100.0::DOUBLE >= 0.05::DOUBLE")} AS more
            FROM steps s JOIN items i ON i.block = s.block AND i.month = s.month GROUP BY s.block, s.month, s.round, len(s.taken)) WHERE more IS NOT NULL OR (round < 3 AND fresh IS NOT NULL))
    SELECT block, month, scene, round FROM steps WHERE scene IS NOT NULL UNION ALL SELECT block, month, scene, 1 FROM items WHERE (block, month) NOT IN (SELECT block, month FROM many)""")
def _(spark, d):
    c = catalogue(spark, d).where("acquired is not null").withColumns({
        "block": F.col("area") % 20, "month": F.date_format("acquired", "yyyy-MM"),
        "cells": F.transform(F.sequence(F.lit(0), F.lit(14)), lambda i: ((F.col("scene") * 3 + i * (F.col("asset") + 1)) % 100).cast("int")),
        "valid": F.lit(100) - F.col("cloud"),
    })
    return op.monthly_rounds(c, ["block", "month"], "scene", "cells", "valid")


@query("j09_name_join", f"WITH {CATALOGUE}, {NAMES} SELECT n.id, n.line, n.path, c.cloud FROM names n JOIN catalogue c ON c.scene = n.id")
def _(spark, d):
    return names(spark, d).join(catalogue(spark, d).select(F.col("scene").alias("id"), "cloud"), "id").select("id", "line", "path", "cloud")


@query("j12_substring_lookup", f"WITH {CATALOGUE}, {NAMES} SELECT scene, min(path) AS path FROM catalogue JOIN names ON CAST(regexp_extract(path, '_([0-9]+)_dem', 1) AS BIGINT) = scene GROUP BY scene")
def _(spark, d):
    n = names(spark, d).select(F.regexp_extract("path", r"_([0-9]+)_dem", 1).cast("long").alias("scene"), "path")
    return catalogue(spark, d).select("scene").join(n, "scene").groupBy("scene").agg(F.min("path").alias("path"))


@query("j13_triple_product_join", """
    WITH a AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_linenumber = 1 GROUP BY 1), b AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_linenumber = 2 GROUP BY 1)
    SELECT o_orderkey AS base, coalesce(a.n = 1 AND b.n = 1, false) AS complete FROM orders LEFT JOIN a ON a.k = o_orderkey LEFT JOIN b ON b.k = o_orderkey""")
def _(spark, d):
    side = lambda line, n: t(spark, d, "lineitem").where(F.col("l_linenumber") == line).groupBy(F.col("l_orderkey").alias("base")).agg(F.count("*").alias(n))
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("base"))
    return o.join(side(1, "a"), "base", "left").join(side(2, "b"), "base", "left").select("base", F.coalesce((F.col("a") == 1) & (F.col("b") == 1), F.lit(False)).alias("complete"))


@query("j24_parameter_grid", f"""
    WITH {PLOTS} SELECT zone, CAST(az AS INTEGER) AS az, CAST(rg AS INTEGER) AS rg, CAST(fl AS INTEGER) AS fl FROM plots, (SELECT unnest([1, 2, 3, 4, 5]) AS az) a, (SELECT unnest([1, 2, 3, 4, 5]) AS rg) b, (SELECT unnest([8, 16, 32, 64, 128]) AS fl) c
    WHERE az <= rg AND fl * az <= maxx - minx AND fl * rg <= maxy - miny""")
def _(spark, d):
    # looks and filter sizes that fit into each plot; the grid of parameters is fixed and small
    grid = op.parameter_grid(spark, {"az": [1, 2, 3, 4, 5], "rg": [1, 2, 3, 4, 5], "fl": [8, 16, 32, 64, 128]}, F.col("az") <= F.col("rg"))
    fits = (F.col("fl") * F.col("az") <= F.col("maxx") - F.col("minx")) & (F.col("fl") * F.col("rg") <= F.col("maxy") - F.col("miny"))
    return plots(spark, d).crossJoin(F.broadcast(grid)).where(fits).select("zone", "az", "rg", "fl")
