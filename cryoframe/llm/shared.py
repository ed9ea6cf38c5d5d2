"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import cut  # noqa: F401  (for all corpus operators)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Spark's setting for the size of the batches that Python gets; without it 10,000 long texts make one batch.
BATCH_BYTES, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(df: DataFrame) -> DataFrame:
    """``df``, with the session's batches to Python bounded in bytes unless the user has set a bound."""
    if df.sparkSession.conf.get(BATCH_SETTING, None) is None:
        df.sparkSession.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df


def documents(docs: DataFrame) -> DataFrame:
    """doc_id (long) and text (string) of any table that has them, whatever else it carries."""
    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def keep_rows(docs: DataFrame, start: Callable[[], Callable[[pa.Array], np.ndarray]]) -> DataFrame:
    """Rows of ``docs``, with all their columns, for whose ``text`` the function that ``start`` gives is True; nothing is shuffled.

    ``start`` runs once in each task.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = start()
        for batch in batches:
            yield batch.filter(pa.array(keep(batch.column(at)), pa.bool_()))

    return bounded(docs).mapInArrow(run, docs.schema)
