"""Parsers of the small text formats around rasters; each takes lines (column ``value``, as ``spark.read.text`` gives)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse_colour_table(lines: DataFrame) -> DataFrame:
    """``value, r, g, b, alpha, label, nodata`` of a colour table; comments and lines of other forms are left out, ``nv`` is the nodata row."""
    p = F.split("value", ",")
    rows = lines.where(~F.trim("value").startswith("#") & (F.size(p) >= 5) & (F.col("value").rlike(r"^\s*(-?[0-9.]+|nv),")))
    return rows.select(
        F.try_to_number(F.trim(p[0]), F.lit("S9999999D999999")).cast("double").alias("value"),
        *[F.trim(p[i]).cast("int").alias(c) for i, c in enumerate(("r", "g", "b", "alpha"), 1)],
        F.when(F.size(p) >= 6, F.trim(p[5])).otherwise(F.lit("")).alias("label"), (F.trim(p[0]) == "nv").alias("nodata"),
    )


def parse_feature_counts(lines: DataFrame) -> DataFrame:
    """``path, n`` of lines ``path, Feature Count: n``; other lines are left out."""
    p = F.split("value", ", Feature Count: ")
    return lines.where(F.size(p) == 2).select(F.trim(p[0]).alias("path"), F.trim(p[1]).cast("long").alias("n"))


def parse_ids(lines: DataFrame) -> DataFrame:
    """``id`` of each line that is a whole number; blanks and comments are left out."""
    return lines.select(F.expr("try_cast(trim(value) as bigint)").alias("id")).where("id is not null").distinct()


def parse_excluded_scenes(lines: DataFrame) -> DataFrame:
    """``scene`` of each line of at least six characters without ``#``."""
    return lines.where(~F.contains("value", F.lit("#")) & (F.length("value") >= 6)).select(F.trim("value").alias("scene")).distinct()


def parse_boxes(lines: DataFrame, mark: str = "PDO") -> DataFrame:
    """``name, minx, miny, maxx, maxy`` of comma-separated lines of four fields or more whose first one holds ``mark``."""
    p = F.split("value", ",")
    rows = lines.where((F.size(p) >= 5) & F.contains(p[0], F.lit(mark)))
    return rows.select(F.trim(p[0]).alias("name"), *[F.trim(p[i]).cast("double").alias(c) for i, c in enumerate(("minx", "miny", "maxx", "maxy"), 1)])
