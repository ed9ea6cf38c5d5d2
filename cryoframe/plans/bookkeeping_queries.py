"""Queries of the bookkeeping, set, state and job-control operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import bookkeeping as op
from .base import CATALOGUE, IMG, NAMES, OBS, ZONES, age_hours, catalogue, img, names, obs, query, t, zones


def _orders(spark, d, where: str):
    return t(spark, d, "orders").where(where).select(F.col("o_orderkey").alias("id"))


_LISTS = "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 11 = 0 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 13 = 0 UNION ALL SELECT o_orderkey FROM orders WHERE o_custkey % 17 = 0"


def _lists(spark, d):
    return [_orders(spark, d, w) for w in ("o_orderstatus = 'F'", "o_orderkey % 11 = 0", "o_orderkey % 13 = 0", "o_custkey % 17 = 0")]


@query("j14_grid_id_join", f"WITH {OBS} SELECT o.row AS grid, count(*) AS n, round(sum(o.z), 4) AS total FROM obs o JOIN (SELECT DISTINCT s_suppkey AS grid FROM supplier) s ON s.grid = o.row GROUP BY o.row")
def _(spark, d):
    polygons = t(spark, d, "supplier").select(F.col("s_suppkey").alias("grid")).distinct()
    return obs(spark, d).withColumnRenamed("row", "grid").join(polygons, "grid").groupBy("grid").agg(F.count("*").alias("n"), F.round(F.sum("z"), 4).alias("total"))


@query("j16_anti_joins", f"SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN ({_LISTS})")
def _(spark, d):
    return op.remaining(t(spark, d, "orders").select(F.col("o_orderkey").alias("id")), _lists(spark, d), "id").select("id")


@query("j18_existence_lookup", "SELECT o_orderkey AS id, coalesce(p.n, 0) AS n_products, coalesce(p.n, 0) > 0 OR o_orderkey % 11 = 0 AS done FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_linenumber > 4 GROUP BY 1) p ON p.l_orderkey = o_orderkey")
def _(spark, d):
    products = t(spark, d, "lineitem").where("l_linenumber > 4").select(F.col("l_orderkey").alias("id"))
    return op.exists_flags(_orders(spark, d, "true"), products, _orders(spark, d, "o_orderkey % 11 = 0"), "id")


@query("j19_existing_missing_split", f"WITH {NAMES} SELECT o_orderkey AS id, min(path) AS path, min(path) IS NULL AS missing FROM orders LEFT JOIN names ON id = o_orderkey AND line = 2 GROUP BY o_orderkey")
def _(spark, d):
    first = names(spark, d).where("line = 2").groupBy("id").agg(F.min("path").alias("path"))
    return _orders(spark, d, "true").join(first, "id", "left").select("id", "path", F.col("path").isNull().alias("missing"))


@query("j20_keyed_join", "SELECT a.event_id, a.value AS value_sam, b.value AS value_class FROM events a JOIN events b ON b.event_id = a.event_id + 1")
def _(spark, d):
    e = t(spark, d, "events").select("event_id", "value")
    other = e.select((F.col("event_id") - 1).alias("event_id"), F.col("value").alias("value_class"))
    return e.withColumnRenamed("value", "value_sam").join(other, "event_id")


@query("s12_append_if_absent", "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linenumber = 5 AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def _(spark, d):
    return op.append_absent(_orders(spark, d, "o_orderstatus = 'F'"), t(spark, d, "lineitem").where("l_linenumber = 5").select(F.col("l_orderkey").alias("id")), "id")


@query("k04_append_attributes", "SELECT c_custkey, c_acctbal, coalesce(n, 0) AS n_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey")
def _(spark, d):
    n = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"))
    return t(spark, d, "customer").select("c_custkey", "c_acctbal").join(n, "c_custkey", "left").withColumn("n_orders", F.coalesce("n_orders", F.lit(0)).cast("long"))


@query("k06_file_count_check", "SELECT l_orderkey AS grid, count(*) AS n_files, count(*) IN (2, 5) AS good FROM lineitem GROUP BY l_orderkey")
def _(spark, d):
    return op.file_count_split(t(spark, d, "lineitem").select(F.col("l_orderkey").alias("grid")), "grid", [2, 5])


@query("k07_product_index", f"""
    WITH {NAMES}, f AS (SELECT id, count(*) AS n, min(path) AS path FROM names WHERE line = 1 GROUP BY id)
    SELECT o_orderkey AS id, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'one' END AS state, CASE WHEN n = 1 THEN path END AS path FROM orders LEFT JOIN f ON id = o_orderkey""")
def _(spark, d):
    return op.one_file_each(_orders(spark, d, "true"), names(spark, d).where("line = 1"), "id", "path")


@query("k08_feature_count_append", "SELECT l_suppkey AS dir, count(*) FILTER (WHERE l_returnflag <> 'R') AS n FROM lineitem GROUP BY l_suppkey")
def _(spark, d):
    return t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("dir")).agg(F.count_if(F.col("l_returnflag") != "R").alias("n"))


@query("k09_product_urls", "SELECT s_suppkey AS grid, 'https://data.example/ext' || lpad(CAST(s_suppkey % 7 AS VARCHAR), 2, '0') || '/grid' || s_suppkey || s AS url FROM supplier, (SELECT unnest(['_dem.tif', '_diff.tif', '_index.txt']) AS s)")
def _(spark, d):
    base = F.concat_ws("/", F.lit("https://data.example"), F.concat(F.lit("ext"), F.lpad((F.col("s_suppkey") % 7).cast("string"), 2, "0")), F.concat(F.lit("grid"), F.col("s_suppkey").cast("string")))
    suffixes = F.array(*[F.lit(s) for s in ("_dem.tif", "_diff.tif", "_index.txt")])
    return t(spark, d, "supplier").select(F.col("s_suppkey").alias("grid"), F.explode(F.transform(suffixes, lambda s: F.concat(base, s))).alias("url"))


@query("k10_distinct_extents", f"WITH {NAMES} SELECT DISTINCT split_part(path, '/', 2) AS grid FROM names")
def _(spark, d):
    return names(spark, d).select(F.split("path", "/")[1].alias("grid")).distinct()


@query("k11_pair_manifest", """SELECT l_orderkey, l_linenumber, l_partkey, '{"ref":' || l_orderkey || ',"line":' || l_linenumber || ',"part":' || l_partkey || '}' AS job FROM lineitem""")
def _(spark, d):
    job = F.to_json(F.struct(F.col("l_orderkey").alias("ref"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part")))
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", job.alias("job"))


@query("k13_nested_metadata", "SELECT o_orderkey AS id, o_custkey AS path_number, o_orderstatus AS direction, o_orderdate AS start FROM orders")
def _(spark, d):
    nested = t(spark, d, "orders").select(F.struct(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("path_number"), F.col("o_orderstatus").alias("direction"), F.col("o_orderdate").alias("start")).alias("properties"))
    return nested.select("properties.*")


@query("k15_readme_text", f"""WITH {NAMES} SELECT split_part(path, '/', 2) AS grid, 'Product ' || split_part(path, '/', 2) || chr(10) || 'Files: ' || count(*) || chr(10) || 'First: ' || min(path) AS readme FROM names GROUP BY 1""")
def _(spark, d):
    grid = F.split("path", "/")[1]
    return names(spark, d).groupBy(grid.alias("grid")).agg(F.format_string("Product %s\nFiles: %d\nFirst: %s", F.first(grid), F.count("*"), F.min("path")).alias("readme"))


@query("a15_boolean_share", f"WITH {CATALOGUE} SELECT area, count(*) AS n, count(*) FILTER (WHERE asset = 1) AS n_true, count(*) FILTER (WHERE asset <> 1) AS n_false, round(100.0::DOUBLE * count(*) FILTER (WHERE asset = 1) / count(*), 4) AS percent FROM catalogue GROUP BY area")
def _(spark, d):
    b = F.col("asset") == 1
    return catalogue(spark, d).groupBy("area").agg(F.count("*").alias("n"), F.count_if(b).alias("n_true"), F.count_if(~b).alias("n_false"), F.round(100.0 * F.count_if(b) / F.count("*"), 4).alias("percent"))


@query("a16_metric_pivot", """
    WITH m AS (SELECT unnest(['quantity', 'price', 'discount']) AS metric, unnest([l_quantity, l_extendedprice, l_discount]) AS v FROM lineitem)
    SELECT metric, min(v) AS least, max(v) AS largest, round(avg(v), 6) AS mean, median(v) AS median FROM m GROUP BY metric""")
def _(spark, d):
    m = t(spark, d, "lineitem").select(F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount")).unpivot([], ["quantity", "price", "discount"], "metric", "v")
    plain = m.groupBy("metric").agg(F.min("v").alias("least"), F.max("v").alias("largest"), F.round(F.avg("v"), 6).alias("mean"))
    return plain.join(op.quantiles(m, ["metric"], "v", {"median": 0.5}), "metric")


@query("a26_count_checks", "SELECT count(*) AS n, count(DISTINCT o_orderkey) AS n_distinct, count(*) = count(DISTINCT o_orderkey) AS unique_ids FROM orders")
def _(spark, d):
    n, k = F.count("*"), F.count_distinct("o_orderkey")
    return t(spark, d, "orders").agg(n.alias("n"), k.alias("n_distinct"), (n == k).alias("unique_ids"))


@query("a27_total_size", f"WITH {NAMES} SELECT round(sum(bytes) / 1073741824.0::DOUBLE, 6) AS gb, count(*) AS n FROM names")
def _(spark, d):
    return names(spark, d).agg(F.round(F.sum("bytes") / 1073741824.0, 6).alias("gb"), F.count("*").alias("n"))


@query("a28_lists_per_column", "SELECT n_regionkey AS region, array_to_string(list(n_nationkey ORDER BY n_nationkey), ',') AS keys, array_to_string(list(n_name ORDER BY n_nationkey), ',') AS names FROM nation GROUP BY n_regionkey")
def _(spark, d):
    rows = F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name")))
    g = t(spark, d, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(rows.alias("r"))
    return g.select("region", F.array_join(F.col("r.n_nationkey").cast("array<string>"), ",").alias("keys"), F.array_join("r.n_name", ",").alias("names"))


@query("a29_stacked_lines", f"WITH {OBS} SELECT CAST(row_number() OVER (PARTITION BY row ORDER BY d, pixel) AS INTEGER) AS id, row AS grid, pixel, CAST(year(d) AS INTEGER) AS dem_year, strftime(d, '%Y%m%d') AS dem_date FROM obs")
def _(spark, d):
    return obs(spark, d).select(F.row_number().over(Window.partitionBy("row").orderBy("d", "pixel")).alias("id"), F.col("row").alias("grid"), "pixel", F.year("d").alias("dem_year"), F.date_format("d", "yyyyMMdd").alias("dem_date"))


@query("w15_cumulative_offsets", """
    WITH f AS (SELECT s_suppkey AS file, s_suppkey % 5 + 1 AS n FROM supplier), o AS (SELECT *, sum(n) OVER (ORDER BY file) - n AS first FROM f)
    SELECT c_custkey AS number, file, CAST(c_custkey - first AS BIGINT) AS local FROM customer JOIN o ON c_custkey >= first AND c_custkey < first + n""")
def _(spark, d):
    files = t(spark, d, "supplier").select(F.col("s_suppkey").alias("file"), (F.col("s_suppkey") % 5 + 1).alias("n"))
    numbers = t(spark, d, "customer").select(F.col("c_custkey").alias("number"))
    return op.located(numbers, "number", op.running_offsets(files, "file", "n"), "n").select("number", "file", "local")


@query("w16_random_sample", "SELECT o_orderkey FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 100")
def _(spark, d):
    return t(spark, d, "orders").orderBy(F.md5(F.col("o_orderkey").cast("string")), "o_orderkey").limit(100).select("o_orderkey")


@query("w17_job_chunks", "SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 250 AS BIGINT) AS job FROM orders")
def _(spark, d):
    return op.chunks(t(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 250).select("o_orderkey", "job")


@query("w19_label_offsets", f"WITH {OBS} SELECT DISTINCT row, flag, CAST(dense_rank() OVER (ORDER BY row, flag) AS INTEGER) AS label FROM obs")
def _(spark, d):
    labels = obs(spark, d).select("row", "flag").distinct()
    return op.numbered(labels, ["row", "flag"], "label").withColumn("label", F.col("label").cast("int"))


@query("w20_range_assignment", """
    WITH e AS (SELECT DISTINCT p_size * 30.0::DOUBLE AS hi FROM part WHERE p_size % 5 = 0), b AS (SELECT hi, coalesce(lag(hi) OVER (ORDER BY hi), 0) AS lo FROM e)
    SELECT c_custkey AS dn, lo, hi FROM customer JOIN b ON c_custkey > lo AND c_custkey <= hi""")
def _(spark, d):
    ends = op.numbered(t(spark, d, "part").where("p_size % 5 = 0").select((F.col("p_size") * 30.0).alias("hi")).distinct(), ["hi"], "place")
    below = ends.select((F.col("place") + 1).alias("place"), F.col("hi").alias("lo"))
    bounds = ends.join(below, "place", "left").select(F.coalesce("lo", F.lit(0.0)).alias("lo"), "hi")
    # whole numbers in (lo, hi] lie in [floor(lo) + 1, floor(hi) + 1)
    bounds = bounds.withColumns({"first": F.floor("lo") + 1, "end": F.floor("hi") + 1})
    return op.in_intervals(t(spark, d, "customer").select(F.col("c_custkey").alias("dn")), "dn", bounds, "first", "end").select("dn", "lo", "hi")


@query("t06_remaining_work", f"SELECT event_id AS id FROM events WHERE event_id NOT IN ({_LISTS}) AND date_diff('second', ts, TIMESTAMP '2024-01-31 00:00:00') / 3600.0::DOUBLE > 24")
def _(spark, d):
    age = age_hours("ts", "2024-01-31 00:00:00")
    return op.remaining(t(spark, d, "events").select(F.col("event_id").alias("id"), "ts"), _lists(spark, d), "id").where(age > 24).select("id")


@query("u01_two_way_except", "SELECT id, side FROM (SELECT o_orderkey AS id, 'new' AS side FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 5 = 0 UNION ALL SELECT o_orderkey, 'old' FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0)")
def _(spark, d):
    old, new = _orders(spark, d, "o_orderkey % 3 = 0"), _orders(spark, d, "o_orderkey % 5 = 0")
    return new.join(old, "id", "left_anti").withColumn("side", F.lit("new")).unionByName(old.join(new, "id", "left_anti").withColumn("side", F.lit("old")))


@query("u02_set_difference", "SELECT DISTINCT l_orderkey AS id FROM lineitem EXCEPT SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def _(spark, d):
    return t(spark, d, "lineitem").select(F.col("l_orderkey").alias("id")).subtract(_orders(spark, d, "o_orderstatus = 'F'"))


@query("u03_intersection", "SELECT l_orderkey AS id FROM lineitem INTERSECT SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def _(spark, d):
    return t(spark, d, "lineitem").select(F.col("l_orderkey").alias("id")).intersect(_orders(spark, d, "o_orderstatus = 'F'"))


@query("u04_union_of_lists", f"SELECT id, count(*) AS n FROM ({_LISTS}) GROUP BY id")
def _(spark, d):
    a, *rest = _lists(spark, d)
    for x in rest:
        a = a.unionByName(x)
    return a.groupBy("id").agg(F.count("*").alias("n"))


@query("u05_append_remote", "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' UNION SELECT l_orderkey FROM lineitem WHERE l_linenumber = 6")
def _(spark, d):
    return _orders(spark, d, "o_orderstatus = 'F'").unionByName(t(spark, d, "lineitem").where("l_linenumber = 6").select(F.col("l_orderkey").alias("id"))).distinct()


@query("u06_union_distinct", f"SELECT DISTINCT id FROM ({_LISTS})")
def _(spark, d):
    a, *rest = _lists(spark, d)
    for x in rest:
        a = a.unionByName(x)
    return a.distinct()


@query("u07_union_all", "SELECT s_suppkey AS id, s_name AS name, s_acctbal AS value FROM supplier UNION ALL SELECT c_custkey, c_name, NULL FROM customer")
def _(spark, d):
    a = t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("value"))
    return a.unionByName(t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), allowMissingColumns=True)


@query("u08_failed_in_done", "SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_linenumber = 4 AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def _(spark, d):
    return t(spark, d, "lineitem").where("l_linenumber = 4").select(F.col("l_orderkey").alias("id")).join(_orders(spark, d, "o_orderstatus = 'F'"), "id", "left_semi").distinct()


@query("u09_drop_duplicates", "SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY l_orderkey, l_linenumber")
def _(spark, d):
    first = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey")
    return t(spark, d, "lineitem").withColumn("n", F.row_number().over(first)).where("n = 1").select("l_orderkey", "l_linenumber", "l_partkey")


@query("c01_date_from_name", f"WITH {NAMES} SELECT id, line, path, CAST(strptime(regexp_extract(path, '([0-9]{{8}})_', 1), '%Y%m%d') AS DATE) AS acquired FROM names")
def _(spark, d):
    return names(spark, d).select("id", "line", "path", F.to_date(F.regexp_extract("path", r"([0-9]{8})_", 1), "yyyyMMdd").alias("acquired"))


@query("c02_day_difference", "SELECT o_orderkey, CAST(date_diff('day', DATE '1997-01-01', o_orderdate) AS INTEGER) AS signed, CAST(abs(date_diff('day', DATE '1997-01-01', o_orderdate)) AS INTEGER) AS absolute FROM orders")
def _(spark, d):
    gap = F.datediff("o_orderdate", F.lit("1997-01-01").cast("date"))
    return t(spark, d, "orders").select("o_orderkey", gap.alias("signed"), F.abs(gap).alias("absolute"))


@query("c03_epoch_millis", "SELECT event_id, strftime(epoch_ms(1700000000000 + event_id * 1000), '%Y%m%d-%H%M%S') AS stamp FROM events")
def _(spark, d):
    ms = F.timestamp_millis(F.lit(1700000000000) + F.col("event_id") * 1000)
    return t(spark, d, "events").select("event_id", F.date_format(ms, "yyyyMMdd-HHmmss").alias("stamp"))


@query("c04_iso_month", "SELECT event_id, strftime(ts, '%Y-%m') AS month FROM events WHERE ts IS NOT NULL")
def _(spark, d):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return t(spark, d, "events").where("ts is not null").select("event_id", F.date_format(F.to_timestamp(iso), "yyyy-MM").alias("month"))


@query("c05_regex_digits", f"WITH {NAMES} SELECT id, bool_and(regexp_matches(path, '^ext[0-9]{{2}}/')) AS all_tiles, min(regexp_replace(path, '[^0-9]', '', 'g')) AS digits FROM names GROUP BY id")
def _(spark, d):
    return names(spark, d).groupBy("id").agg(F.bool_and(F.col("path").rlike(r"^ext\d{2}/")).alias("all_tiles"), F.min(F.regexp_replace("path", r"\D", "")).alias("digits"))


@query("c06_padding_and_joins", "SELECT s_suppkey, lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS padded, concat_ws('_', 'grid', s_suppkey, s_nationkey) AS joined, replace(s_name, '#', '-') AS replaced FROM supplier")
def _(spark, d):
    return t(spark, d, "supplier").select(
        "s_suppkey", F.lpad(F.col("s_suppkey").cast("string"), 5, "0").alias("padded"), F.concat_ws("_", F.lit("grid"), F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")).alias("joined"),
        F.replace("s_name", F.lit("#"), F.lit("-")).alias("replaced"),
    )


@query("c07_url_tokens", "SELECT page_id, split_part(split_part(split_part(regexp_extract(url, '^[^:]+://[^/?#]+([^?#]*)', 1), '/', 2), '?', 1), '#', 1) AS token FROM pages")
def _(spark, d):
    return t(spark, d, "pages").select("page_id", F.coalesce(F.element_at(F.slice(F.split(F.parse_url("url", F.lit("PATH")), "/"), 2, 1), 1), F.lit("")).alias("token"))


@query("c08_json_flatten", """SELECT event_id, '{"k":' || CAST(json_extract(props, '$.k') AS BIGINT) || ',"type":"' || event_type || '"}' AS flat FROM events""")
def _(spark, d):
    merged = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("type"), F.col("event_type")))
    return t(spark, d, "events").select("event_id", F.to_json(F.struct(F.element_at(merged, "k").cast("long").alias("k"), F.element_at(merged, "type").alias("type"))).alias("flat"))


@query("c09_grouped_lists", "SELECT o_custkey AS key, array_to_string(list(o_orderkey ORDER BY o_orderkey), ' ') AS ids FROM orders GROUP BY o_custkey")
def _(spark, d):
    return t(spark, d, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.array_join(F.sort_array(F.collect_list("o_orderkey")).cast("array<string>"), " ").alias("ids"))


@query("c10_orbit_routing", "SELECT o_orderstatus || '/' || strftime(o_orderdate, '%Y/%m') AS folder, count(*) AS n FROM orders GROUP BY 1")
def _(spark, d):
    name = F.split(F.concat_ws("_", "o_orderstatus", F.date_format("o_orderdate", "yyyy"), F.date_format("o_orderdate", "MM")), "_")
    return t(spark, d, "orders").groupBy(F.concat_ws("/", name[0], name[1], name[2]).alias("folder")).agg(F.count("*").alias("n"))


@query("c11_extent_of_image", f"WITH {OBS} SELECT flag AS image, min(col) AS minx, min(row) AS miny, max(col) + 1 AS maxx, max(row) + 1 AS maxy FROM obs GROUP BY flag")
def _(spark, d):
    return obs(spark, d).groupBy(F.col("flag").alias("image")).agg(F.min("col").alias("minx"), F.min("row").alias("miny"), (F.max("col") + 1).alias("maxx"), (F.max("row") + 1).alias("maxy"))


@query("c12_product_id_tokens", f"WITH {NAMES} SELECT DISTINCT split_part(path, '/', 2) || '_' || split_part(path, '/', 3) AS product FROM names")
def _(spark, d):
    p = F.split("path", "/")
    return names(spark, d).select(F.array_join(F.slice(p, 2, F.size(p)), "_").alias("product")).distinct()


@query("e01_resume", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 3)")
def _(spark, d):
    return op.remaining(_orders(spark, d, "true"), [t(spark, d, "lineitem").where("l_linenumber = 3").select(F.col("l_orderkey").alias("id"))], "id")


@query("e03_age_gate", "SELECT event_id FROM events WHERE ts <= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR")
def _(spark, d):
    e = t(spark, d, "events")
    newest = e.agg(F.max("ts").alias("newest"))
    return e.crossJoin(F.broadcast(newest)).where(F.expr("ts <= newest - INTERVAL 24 HOURS")).select("event_id")


@query("e04_latest_state", "SELECT user_id AS subset, arg_max(event_type, {'t': ts, 'e': event_id}) AS status FROM events GROUP BY user_id")
def _(spark, d):
    return op.latest_state(t(spark, d, "events").withColumnRenamed("user_id", "subset"), "subset", "event_type", ["ts", "event_id"]).withColumnRenamed("event_type", "status")


@query("e05_completion", "SELECT l_orderkey AS id FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) = 2")
def _(spark, d):
    return op.completed_all(t(spark, d, "lineitem").withColumnRenamed("l_orderkey", "id"), "id", "l_returnflag", ["A", "N"])


@query("e06_task_levels", """
    WITH RECURSIVE dep AS (SELECT p_partkey AS task, p_partkey // 3 AS needs FROM part WHERE p_partkey >= 3 UNION SELECT p_partkey, p_partkey // 2 FROM part WHERE p_partkey % 5 = 0 AND p_partkey >= 2),
    level AS (SELECT p_partkey AS task, 0 AS n FROM part WHERE p_partkey NOT IN (SELECT task FROM dep) UNION SELECT d.task, l.n + 1 FROM dep d JOIN level l ON l.task = d.needs)
    SELECT task, CAST(max(n) AS INTEGER) AS level FROM level GROUP BY task""")
def _(spark, d):
    tasks = t(spark, d, "part").select(F.col("p_partkey").alias("task"))
    needs = tasks.where("task >= 3").select("task", F.expr("task div 3").alias("needs")).unionByName(tasks.where("task % 5 = 0 and task >= 2").select("task", F.expr("task div 2").alias("needs")))
    return op.task_levels(tasks, needs)


@query("e10_quarantine", "SELECT l_orderkey AS scene, count(*) AS n, count(*) <> 4 AS incomplete FROM lineitem GROUP BY l_orderkey")
def _(spark, d):
    return t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("scene")).agg(F.count("*").alias("n")).withColumn("incomplete", F.col("n") != 4)


@query("e11_not_submitted", "SELECT s_suppkey AS extent FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50 AND l_linenumber = 7)")
def _(spark, d):
    marks = t(spark, d, "lineitem").where("l_quantity = 50 and l_linenumber = 7").select(F.col("l_suppkey").alias("extent"))
    return op.remaining(t(spark, d, "supplier").select(F.col("s_suppkey").alias("extent")), [marks], "extent")


@query("e12_changed_files", "SELECT a.l_orderkey AS id, a.last, b.o_orderdate AS kept, a.last IS DISTINCT FROM b.o_orderdate AS changed FROM (SELECT l_orderkey, max(l_shipdate) AS last FROM lineitem GROUP BY 1) a LEFT JOIN orders b ON b.o_orderkey = a.l_orderkey")
def _(spark, d):
    now = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_shipdate").alias("last"))
    kept = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("kept"))
    return now.join(kept, "id", "left").withColumn("changed", ~F.col("last").eqNullSafe(F.col("kept")))


@query("e14_job_submission", "SELECT o_orderkey AS id, 'job' || lpad(CAST(o_orderkey % 100000 AS VARCHAR), 5, '0') AS job FROM orders WHERE o_orderstatus = 'O' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')")
def _(spark, d):
    done = t(spark, d, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("id"))
    job = F.concat(F.lit("job"), F.lpad((F.col("id") % 100000).cast("string"), 5, "0"))
    return op.remaining(_orders(spark, d, "o_orderstatus = 'O'"), [done], "id").select("id", job.alias("job"))


@query("e15_completeness", "SELECT o_orderkey AS id, CAST(o_custkey % 7 AS BIGINT) AS expected, coalesce(n, 0) AS found, coalesce(n, 0) >= o_custkey % 7 AS complete FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey")
def _(spark, d):
    log = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.format_string("found %d files in folder", F.col("o_custkey") % 7).alias("line"))
    n = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("found"))
    r = log.select("id", F.regexp_extract("line", r"found (\d+) files", 1).cast("long").alias("expected")).join(n, "id", "left")
    return r.select("id", "expected", F.coalesce("found", F.lit(0)).cast("long").alias("found")).withColumn("complete", F.col("found") >= F.col("expected"))


@query("e16_inputs_to_clean", f"WITH {NAMES} SELECT DISTINCT path FROM names WHERE id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def _(spark, d):
    return names(spark, d).join(_orders(spark, d, "o_orderstatus = 'F'"), "id", "left_semi").select("path").distinct()


@query("p14_export_list", f"WITH {IMG} SELECT image, 'img' || image || '.tif ' || count(*) AS line FROM img JOIN supplier ON s_suppkey = image GROUP BY image")
def _(spark, d):
    known = t(spark, d, "supplier").select(F.col("s_suppkey").alias("image"))
    return img(spark, d).groupBy("image").agg(F.count("*").alias("n")).join(known, "image").select("image", F.concat_ws(" ", F.concat(F.lit("img"), F.col("image").cast("string"), F.lit(".tif")), F.col("n").cast("string")).alias("line"))


@query("p15_config_fan_out", """SELECT s_suppkey AS grid, '{"grid":' || s_suppkey || ',"prompts":' || n || '}' AS config FROM supplier JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_linenumber = 7 AND l_quantity < 25 GROUP BY 1) ON l_suppkey = s_suppkey""")
def _(spark, d):
    n = t(spark, d, "lineitem").where("l_linenumber = 7 and l_quantity < 25").groupBy(F.col("l_suppkey").alias("grid")).agg(F.count("*").alias("prompts"))
    return t(spark, d, "supplier").select(F.col("s_suppkey").alias("grid")).join(n, "grid").select("grid", F.to_json(F.struct("grid", "prompts")).alias("config"))
