"""Worked cases and brute-force models of operators that SQL does not cover."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cryoframe.operators import bookkeeping, catalogue, graph, raster, spatial, temporal
from cryoframe.sources import rasters, text
from cryoframe.streaming import jobs


def _obs(spark, rows):
    return spark.createDataFrame([(p, dt.date(2024, 1, 1) + dt.timedelta(days=n), z) for p, n, z in rows], "pixel long, d date, z double")


def test_difference_worked_case(spark):
    o = _obs(spark, [(1, 0, 5.0), (1, 10, 9.0), (1, 30, 6.0), (2, 0, None), (2, 10, 9.0), (2, 30, 6.0), (3, 0, 1.0)])
    a = {r["pixel"]: r for r in temporal.newest_minus_oldest(o, ["pixel"]).collect()}
    assert (a[1]["dz"], a[1]["gap_days"], a[1]["old_index"], a[1]["new_index"]) == (1.0, 30, 0, 2)
    assert (a[2]["dz"], a[2]["gap_days"]) == (-3.0, 20)
    assert (a[3]["dz"], a[3]["gap_days"], a[3]["new_index"]) == (None, 0, 255)
    b = {r["pixel"]: (r["dz"], r["gap_days"]) for r in temporal.max_subsidence(o, ["pixel"]).collect()}
    assert b == {1: (-3.0, 20), 2: (-3.0, 20), 3: (None, 0)}


def test_majority_dilation_worked_case(spark):
    grid = [[255, 1, 1, 255], [255, 2, 1, 255], [255, 255, 255, 255], [255, 3, 3, 255]]
    cells = spark.createDataFrame([(r, c, None if v == 255 else v) for r, row in enumerate(grid) for c, v in enumerate(row)], "row int, col int, v int")
    got = {(r["row"], r["col"]): r["v"] for r in raster.majority_dilated(cells, "v").collect()}
    assert [[got[r, c] for c in range(4)] for r in range(4)] == [[1, 1, 1, 1], [1, 2, 1, 1], [2, 3, 3, 1], [3, 3, 3, 3]]


def test_centimetres(spark):
    df = spark.createDataFrame([(1.239,), (-1.239,), (400.0,), (None,)], "z double")
    assert [r[0] for r in df.select(temporal.centimetres(df.z)).collect()] == [123, -123, 32767, 32767]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(200, 100), (5, 5), (70, 70), (None, 1)], "a long, b long")
    got = {r["vertex"]: r["component"] for r in graph.connected_components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 200: 100, 70: 70}
    assert graph.connected_components(edges.where("false")).collect() == []


def test_greedy_cover_matches_a_loop(spark):
    rng = np.random.default_rng(4)
    scenes = [(int(a), int(s), [int(x) for x in rng.integers(0, 12, 4)], int(rng.integers(0, 50))) for a in range(5) for s in range(12)]
    df = spark.createDataFrame(scenes, "area long, scene long, cells array<int>, cloud int")
    expected = set()
    for a in range(5):
        seen: set[int] = set()
        for _, s, cells, _ in sorted((x for x in scenes if x[0] == a), key=lambda x: (x[3], x[1])):
            if set(cells) - seen:
                expected.add((a, s, len(set(cells) - seen)))
                seen |= set(cells)
    assert {(r["area"], r["scene"], r["gain"]) for r in catalogue.greedy_cover(df, "area", "scene", "cells", ["cloud", "scene"]).collect()} == expected


def test_monthly_rounds_keep_small_groups(spark):
    df = spark.createDataFrame([(1, "2024-01", s, [s], 90.0 - s) for s in range(3)] + [(2, "2024-01", s, list(range(s * 10, s * 10 + 30)), 50.0 + s) for s in range(6)], "a long, m string, scene long, cells array<int>, valid double")
    got = {(r["a"], r["scene"], r["round"]) for r in catalogue.monthly_rounds(df, ["a", "m"], "scene", "cells", "valid").collect()}
    assert {(1, s, 1) for s in range(3)} <= got
    assert min(x for x in got if x[0] == 2 and x[2] == 1)[1] == 0 and (2, 5, 1) in got


def test_intersections_match_brute_force(spark):
    rng = np.random.default_rng(1)
    boxes = lambda n: [(i, *(float(v) for v in (x, y, x + w, y + h))) for i, (x, y, w, h) in enumerate(rng.integers(0, 100, (n, 4)))]
    a, b = boxes(40), boxes(30)
    left = spark.createDataFrame(a, "i long, minx double, miny double, maxx double, maxy double")
    right = spark.createDataFrame(b, "j long, minx double, miny double, maxx double, maxy double")
    got = sorted((r["i"], r["j"]) for r in spatial.intersecting(left, right, 25.0).collect())
    assert got == sorted((x[0], y[0]) for x in a for y in b if x[1] <= y[3] and y[1] <= x[3] and x[2] <= y[4] and y[2] <= x[4])


def test_monthly_rounds_match_a_loop(spark):
    rng = np.random.default_rng(8)
    rows = [(int(g), int(i), [int(x) for x in rng.choice(130, rng.integers(0, 50), replace=False)], int(rng.integers(0, 9))) for g in range(12) for i in range(rng.integers(1, 40))]
    want = set()
    for g in range(12):
        left = sorted([(-v, i, set(c)) for h, i, c, v in rows if h == g])
        if len(left) <= 3:
            want |= {(g, i, 1) for _, i, _ in left}
            continue
        left = [x for x in left if x[2]]
        for n in range(1, 4):
            seen, rest = None, []
            for v, i, c in left:
                if seen is None or (len(seen) / 130 <= 0.95 and len(c - seen) / 130 >= 0.05):
                    seen = c | (seen or set())
                    want.add((g, i, n))
                else:
                    rest.append((v, i, c))
            left = rest
    df = spark.createDataFrame(rows, "a int, scene int, cells array<int>, valid int").repartition(3)
    assert {(r["a"], r["scene"], r["round"]) for r in catalogue.monthly_rounds(df, ["a"], "scene", "cells", "valid", full=130).collect()} == want


@pytest.mark.parametrize("tile", [4, 128])
def test_regions_whatever_the_tiles(spark, tile):
    mask = np.random.default_rng(6).random((40, 31)) < 0.55
    cells = {(int(r) - 9, int(c) - 5): int(r) * 31 + int(c) for r, c in np.argwhere(mask)}
    df = spark.createDataFrame([(i, r, c, f"x{i}") for (r, c), i in cells.items()], "id long, row int, col int, v string")
    for offsets in (raster.FOUR, raster.EIGHT):
        want, left = {}, dict(sorted(cells.items(), key=lambda x: x[1]))
        while left:
            start = next(iter(left))
            low, stack = left.pop(start), [start]
            want[low] = low
            while stack:
                r, c = stack.pop()
                for n in [(r + a, c + b) for a, b in offsets if (r + a, c + b) in left]:
                    want[left.pop(n)] = low
                    stack.append(n)
        got = spatial.components_on_lattice(df, offsets, tile).collect()
        assert {r["id"]: r["region"] for r in got} == want and all(r["v"] == f"x{r['id']}" for r in got)


def test_chunks_number_all_rows(spark):
    df = spark.createDataFrame([(i,) for i in range(1003)], "id long")
    got = {r["id"]: r["job"] for r in bookkeeping.chunks(df, ["id"], 100, buckets=7).collect()}
    assert all(got[i] == i // 100 for i in range(1003))


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_numbers_survive_a_payload_and_exchanges_planned_twice(spark, reuse):
    """600,000 rows: too many for a range exchange to see them all when it draws its bounds."""
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        df = spark.range(600_000).select(F.xxhash64("id").alias("id"), F.col("id").cast("string").alias("name"))
        got = bookkeeping.numbered(df, ["id"], buckets=8)
        wrong = got.withColumn("m", F.row_number().over(Window.orderBy("id"))).where("n <> m or name is null")
        assert wrong.count() == 0
        if reuse == "false":
            sizes = bookkeeping.chunks(df, ["id"], 100, buckets=8).groupBy("job").count().groupBy("count").count().collect()
            assert [tuple(r) for r in sizes] == [(100, 6000)]
            shares = bookkeeping.cumulative_shares(df.withColumn("k", F.col("id") % 3), ["k"], "id", buckets=8).groupBy("k").agg(F.max("share").alias("top"), F.count("*").alias("n")).collect()
            assert all(r["top"] == 1.0 for r in shares) and sum(r["n"] for r in shares) == 600_000
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def test_numbers_are_located_in_files_of_uneven_size(spark):
    sizes = {f: (f * 7) % 50 if f != 40 else 5000 for f in range(100)}
    files = bookkeeping.running_offsets(spark.createDataFrame(list(sizes.items()), "file long, n long"), "file", "n", buckets=5)
    expected, at = {}, 0
    for f, n in sizes.items():
        expected |= {at + i: (f, i) for i in range(n)}
        at += n
    got = bookkeeping.located(spark.range(-3, at + 3).withColumnRenamed("id", "number"), "number", files, "n").collect()
    assert len(got) == at and {r["number"]: (r["file"], r["local"]) for r in got} == expected


def test_text_formats(spark):
    lines_ = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    assert [tuple(r) for r in text.parse_feature_counts(lines_("a/b.gpkg, Feature Count: 12", "junk")).collect()] == [("a/b.gpkg", 12)]
    assert [r["id"] for r in text.parse_ids(lines_("12", " 12 ", "x", "")).collect()] == [12]
    assert [r["scene"] for r in text.parse_excluded_scenes(lines_("20200101_a", "# no", "abc")).collect()] == ["20200101_a"]
    assert [tuple(r) for r in text.parse_boxes(lines_("PDO1,1,2,3,4", "X,1,2,3,4", "PDO2,1")).collect()] == [("PDO1", 1.0, 2.0, 3.0, 4.0)]
    colours = text.parse_colour_table(lines_("# c", "-1.5,0,0,128,255,low", "nv,0,0,0,0,nodata")).collect()
    assert sorted((r["value"], r["nodata"]) for r in colours if r["value"] is not None) == [(-1.5, False)]


def test_raster_sinks_and_sources(spark, tmp_path):
    pixels = spark.createDataFrame([(g, r, c, float(r * c) - 1) for g in (1, 2) for r in range(5) for c in range(5)], "grid_id int, row int, col int, v double")
    rasters.write_pixels(pixels, str(tmp_path / "p"))
    got = rasters.read_pixels(spark, str(tmp_path / "p"), (1, 1, 2, 3), nodata=0.0)
    assert got.count() == 12 and got.where("v is null").count() == 2
    assert rasters.read_virtual_mosaic(spark, [str(tmp_path / "p/grid_id=1"), str(tmp_path / "p/grid_id=2")]).where("priority = 1").count() == 25
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 2.0)], "id long, minx double, miny double, maxx double, maxy double")
    rasters.write_wkt(boxes, str(tmp_path / "w"))
    assert spark.read.parquet(str(tmp_path / "w")).first()["wkt"].startswith("POLYGON ((0.0 0.0, 1.0 0.0")
    rasters.write_table(boxes, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 1
    rasters.write_by_date(boxes.withColumn("acq_date", boxes.id), str(tmp_path / "d"))
    assert (tmp_path / "d" / "acq_date=1").is_dir()
    (tmp_path / "f.json").write_text('{"features":[{"id":"a","geometry":{"type":"Polygon","coordinates":[[[0,1],[2,1],[2,5],[0,1]]]}}]}')
    assert tuple(rasters.read_footprints(spark, str(tmp_path / "f.json")).first()) == ("a", 0.0, 1.0, 2.0, 5.0)
    (tmp_path / "m.xml").write_text("<r><scene><cloud>12</cloud></scene><scene><cloud>7</cloud></scene></r>")
    assert sorted(r["cloud"] for r in rasters.read_metadata_xml(spark, str(tmp_path / "m.xml"), "scene").collect()) == [7, 12]
    assert rasters.list_files(spark, str(tmp_path / "w"), "*.parquet").count() >= 1


def test_new_files_are_handled_once(spark, tmp_path):
    folder, seen = str(tmp_path / "in"), []
    handle = lambda df, n: seen.extend(r["id"] for r in df.collect())
    spark.range(3).coalesce(1).write.mode("append").parquet(folder)
    jobs.new_files(spark, folder, "id long", str(tmp_path / "state"), handle)
    spark.range(10, 12).coalesce(1).write.mode("append").parquet(folder)
    jobs.new_files(spark, folder, "id long", str(tmp_path / "state"), handle)
    assert sorted(seen) == [0, 1, 2, 10, 11]


def test_late_counts(spark, tmp_path):
    folder = str(tmp_path / "e")
    rows = [(dt.datetime(2024, 1, d, 12), "a") for d in (1, 1, 2, 5)]
    spark.createDataFrame(rows, "ts timestamp, k string").coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema("ts timestamp, k string").parquet(folder)
    out = jobs.run_to_table(jobs.settled_counts(stream, "ts", "k"), "append", str(tmp_path / "s")).drop("batch")
    assert {r["start"].day: r["n"] for r in out.collect()} == {1: 2, 2: 1}


def test_layers_round_trip(spark, tmp_path):
    """Written by three tasks and read by ranges of records, with a box; null shapes, holes, blank and long values."""
    from cryoframe.sources import shapefile

    square = lambda x, w: [{"x": float(a), "y": float(b)} for a, b in ((x, 0), (x + w, 0), (x + w, w), (x, w), (x, 0))]
    rows = [(i, [square(10 * i, 8), square(10 * i + 2, 2)[::-1]], None if i % 7 == 0 else f"näme {i}") for i in range(90)] + [(90, [], "nothing"), (91, None, None)]
    df = spark.createDataFrame(rows, "zone int, parts array<array<struct<x:double,y:double>>>, label string").repartition(3)
    path = f"{tmp_path}/layer"
    assert shapefile.write_layer(df, path, {"zone": 6, "label": 12}) == 92
    whole = shapefile.read_layer(spark, path, range_bytes=600)
    assert whole.rdd.getNumPartitions() > 20
    got = {int(r["fields"]["zone"]): r for r in whole.collect()}
    assert {z: ([[p.asDict() for p in g] for g in r["parts"]], r["fields"]["label"]) for z, r in got.items()} == {z: (p, label) for z, p, label in rows[:90]}
    assert (got[3]["minx"], got[3]["maxx"], got[3]["maxy"]) == (30.0, 38.0, 8.0)
    boxed = {int(r["fields"]["zone"]) for r in shapefile.read_layer(spark, path, (95.0, 1.0, 130.0, 2.0)).collect()}
    assert boxed == {9, 10, 11, 12, 13}
    assert shapefile.write_layer(df.limit(0), f"{tmp_path}/none", {"zone": 6}) == 0 and shapefile.read_layer(spark, f"{tmp_path}/none").collect() == []
    with pytest.raises(Exception, match="longer"):
        shapefile.write_layer(df, f"{tmp_path}/short", {"label": 3})


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(2)
    rows = [(k, None if rng.random() < 0.1 else float(v)) for k in "abc" for v in rng.integers(0, 50, {"a": 1, "b": 30, "c": 1001}[k])]
    got = {r["k"]: (r["q1"], r["m"], r["top"]) for r in bookkeeping.quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"q1": 0.25, "m": 0.5, "top": 1.0}, buckets=5).collect()}
    for k in got:
        assert np.allclose(got[k], np.quantile([v for x, v in rows if x == k and v is not None], [0.25, 0.5, 1.0]))
    assert {"b", "c"} <= set(got)


def test_differences_have_their_order(spark, folder):
    from cryoframe.plans.base import obs

    o = obs(spark, folder)
    a = temporal.newest_minus_oldest(o, ["pixel"]).withColumnsRenamed({"dz": "a", "gap_days": "ga"})
    both = a.join(temporal.max_subsidence(o, ["pixel"]), "pixel").where("a is not null").collect()
    assert both and all(r["dz"] <= r["a"] and r["gap_days"] <= r["ga"] for r in both)


def test_bins_sum_to_the_values_inside(spark):
    df = spark.createDataFrame([("a", float(v)) for v in range(-5, 106)] + [("a", None)], "band string, v double")
    h = raster.histogram(df, ["band"], "v", 0, 100, 7).collect()
    assert sum(r["n"] for r in h) == 101 and max(r["bin"] for r in h) == 6
