"""Pixel tables on disk: readers that push windows down, and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_pixels(spark: SparkSession, path: str, window: tuple[int, int, int, int] | None = None, nodata: float | None = None, v: str = "v") -> DataFrame:
    """A pixel table; ``window`` is (first row, first column, last row, last column) and reaches the scan as a filter, ``nodata`` becomes null."""
    pixels = spark.read.parquet(path)
    if window is not None:
        r0, c0, r1, c1 = window
        pixels = pixels.where(F.col("row").between(r0, r1) & F.col("col").between(c0, c1))
    return pixels if nodata is None else pixels.withColumn(v, F.nullif(v, F.lit(nodata)))


def write_pixels(pixels: DataFrame, path: str, grid: str = "grid_id", mode: str = "overwrite") -> None:
    """One folder for each grid; within it pixels are clustered by row, so that windows prune row groups."""
    pixels.repartition(grid).sortWithinPartitions(grid, "row", "col").write.mode(mode).partitionBy(grid).parquet(path)


def read_virtual_mosaic(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Many pixel tables as one, with the file of each pixel as ``source`` and its place in the list as ``priority``."""
    order = F.create_map(*[x for i, p in enumerate(paths) for x in (F.lit(p.rstrip("/")), F.lit(i))])
    parts = [spark.read.parquet(p).withColumn("source", F.lit(p.rstrip("/"))) for p in paths]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.withColumn("priority", order[F.col("source")])


def list_files(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """``path, bytes, modified`` of files under a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def read_metadata_xml(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """Rows of an XML file by their tag (reader built into Spark)."""
    return spark.read.format("xml").option("rowTag", row_tag).load(path)


def read_footprints(spark: SparkSession, path: str) -> DataFrame:
    """``id`` and bounds of the outer ring of each GeoJSON polygon feature (one feature collection to a file)."""
    schema = "features array<struct<id:string,geometry:struct<type:string,coordinates:array<array<array<double>>>>>>"
    f = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    ring = F.col("f.geometry.coordinates")[0]
    axis = lambda i: F.transform(ring, lambda p: p[i])
    return f.select(
        F.col("f.id").alias("id"), F.array_min(axis(0)).alias("minx"), F.array_min(axis(1)).alias("miny"), F.array_max(axis(0)).alias("maxx"), F.array_max(axis(1)).alias("maxy")
    )


def write_by_date(rows: DataFrame, path: str, d: str = "acq_date", mode: str = "overwrite") -> None:
    """One folder for each acquisition date."""
    rows.repartition(d).write.mode(mode).partitionBy(d).parquet(path)


def write_table(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A sheet as CSV with a header."""
    rows.write.mode(mode).option("header", True).csv(path)


def write_wkt(boxes: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Boxes with their outline as well-known text, in Parquet."""
    corners = [("minx", "miny"), ("maxx", "miny"), ("maxx", "maxy"), ("minx", "maxy"), ("minx", "miny")]
    ring = F.concat_ws(", ", *[F.concat_ws(" ", F.col(x).cast("string"), F.col(y).cast("string")) for x, y in corners])
    boxes.withColumn("wkt", F.concat(F.lit("POLYGON (("), ring, F.lit("))"))).write.mode(mode).parquet(path)
