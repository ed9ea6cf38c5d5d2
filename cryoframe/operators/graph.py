"""Connected components of an edge table by repeated contraction; order along rings by doubling."""

from __future__ import annotations

import os
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def in_few(df: DataFrame, each: int) -> DataFrame:
    """``df`` in at most ``each`` partitions for every core, for a table that is written: files of many more cost more than they carry."""
    return df.coalesce(each * max(1, df.sparkSession.sparkContext.defaultParallelism))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage in the session's shared checkpoint folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return in_few(df, 8).checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a local session without one uses the machine's temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (named or os.path.join(tempfile.gettempdir(), "cryoframe-checkpoints")).rstrip("/")


def written(df: DataFrame, each: int = 4) -> DataFrame:
    """Cut the lineage by a table written in the session's shared folder.

    A checkpointed table hands on the size that was guessed for its plan, and guesses for joins are products: in a
    loop they square from round to round, until the planner multiplies numbers of a million digits.  A written
    table has the size of its files.
    """
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid4().hex}"
    in_few(df, each).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def followed(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``id, ring, place`` for a table ``id, next`` in which every id is the next of one other: its ring's smallest id, and its place in the ring, rising from there.

    Ids jump ahead: after each round one knows the id twice as far away, the smallest that it has passed, and how far off
    that is.  When no id finds a smaller one any more, all know the smallest of their ring.
    """
    state = written(links.select("id", "next", F.least("id", "next").alias("low"), F.when(F.col("next") < F.col("id"), 1).otherwise(0).cast("long").alias("off")))
    for step in range(max_rounds):
        ahead = state.select(F.col("id").alias("next"), F.col("next").alias("after"), F.col("low").alias("beyond"), F.col("off").alias("more"))
        smaller = F.col("beyond") < F.col("low")
        moved = written(
            state.join(ahead, "next").select("id", F.col("after").alias("next"), F.least("low", "beyond").alias("low"), F.when(smaller, F.col("more") + (1 << step)).otherwise(F.col("off")).alias("off"), smaller.alias("new")), 2
        )
        state = moved.drop("new")
        if moved.where("new").isEmpty():
            # one that is its ring's smallest is at place 0, those before it come last
            return state.select("id", F.col("low").alias("ring"), (-F.col("off")).alias("place"))
    raise RuntimeError("rings did not close")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", by_id: int = 2, max_rounds: int = 60) -> DataFrame:
    """``(vertex, component)`` for every vertex of the edges; component is the smallest vertex.

    In each round every vertex moves to the first of its closed neighbourhood and the edges are
    contracted.  First is by id in the first ``by_id`` rounds, which ends stars around a smallest vertex at
    once, and by a hash of id and round later, which shrinks chains and lattices by a constant factor.  All state is in written tables; only emptiness comes to the driver.  Self loops
    and repeated edges are allowed; rows with a null end are ignored.  An empty table gives an empty table.
    """
    ends = edges.select(F.col(a).cast("long").alias("src"), F.col(b).cast("long").alias("dst")).where("src is not null and dst is not null")
    edges = written(ends.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), 2)
    loops = edges.where("src = dst").select(F.col("src").alias("vertex")).distinct()
    edges = edges.where("src <> dst")
    placed, step = None, 0
    while not edges.isEmpty():
        if step == max_rounds:
            raise RuntimeError("connected components did not converge")
        moved = written(_moves(edges, step, step < by_id), 2)
        left, right = moved.select(F.col("v").alias("src"), F.col("m").alias("a")), moved.select(F.col("v").alias("dst"), F.col("m").alias("b"))
        pairs = edges.join(left, "src").join(right, "dst").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
        edges = written(pairs.where("src <> dst").distinct(), 2)
        if placed is None:
            placed = moved.select(F.col("v").alias("vertex"), F.col("m").alias("at"))
        else:
            onward = moved.select(F.col("v").alias("at"), F.col("m").alias("next"))
            placed = written(placed.join(onward, "at", "left").select("vertex", F.coalesce("next", "at").alias("at")), 2)
        step += 1
    if placed is None:
        return loops.select("vertex", F.col("vertex").alias("component"))
    out = placed.join(placed.groupBy("at").agg(F.min("vertex").alias("component")), "at").select("vertex", "component")
    return out.unionByName(loops.join(out, "vertex", "left_anti").select("vertex", F.col("vertex").alias("component")))


def _moves(edges: DataFrame, step: int, by_id: bool) -> DataFrame:
    """Where each vertex ``v`` moves to: ``m``, the first vertex of its closed neighbourhood in the order of this round."""
    place = lambda c: F.lit(0).cast("long") if by_id else F.xxhash64(F.lit(step), F.col(c))
    both = edges.select(F.col("src").alias("v"), F.col("dst").alias("to")).union(edges.select(F.col("dst").alias("v"), F.col("src").alias("to")))
    best = both.groupBy("v").agg(F.min(F.struct(place("to").alias("o"), F.col("to").alias("id"))).alias("best"))
    return best.select("v", F.least("best", F.struct(place("v").alias("o"), F.col("v").alias("id")))["id"].alias("m"))
