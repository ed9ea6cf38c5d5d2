"""Incremental job control as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_files(spark: SparkSession, folder: str, schema: str, checkpoint: str, handle: Callable[[DataFrame, int], None], per_batch: int = 8) -> None:
    """Hands files that have come since the last call to ``handle``, at most ``per_batch`` at a time, each file once.

    This is the poll loop (list, subtract what is done, take the first few, submit): progress is kept in
    ``checkpoint``, and ``maxFilesPerTrigger`` holds the load back.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)
    q = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def settled_counts(events: DataFrame, at: str, key: str, lateness: str = "24 hours", window: str = "1 day") -> DataFrame:
    """Counts of each key and window that are emitted once they are older than ``lateness`` (append mode)."""
    return events.withWatermark(at, lateness).groupBy(F.window(at, window), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def latest_status(changes: DataFrame, key: str, status: str, at: str) -> DataFrame:
    """Last status of each key so far (update or complete mode); works on streams and tables."""
    return changes.groupBy(key).agg(F.max_by(status, F.col(at)).alias(status), F.max(at).alias(at))


def run_to_table(df: DataFrame, mode: str, folder: str) -> DataFrame:
    """Runs a stream over all there is into Parquet below ``folder`` and gives what it wrote, with the number ``batch`` of its batch.

    A batch that is run again after a failure replaces what it wrote before.
    """

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}")

    q = df.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    schema = df.schema.add("batch", "long")
    return df.sparkSession.read.schema(schema).option("basePath", f"{folder}/rows").parquet(f"{folder}/rows")


def newest_of(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The last batch's row of each key, from what a stream in update mode wrote."""
    rest = [c for c in updates.columns if c not in (*keys, "batch")]
    if not keys:
        return updates.agg(F.max_by(F.struct(*rest), "batch").alias("r")).select("r.*")
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")
