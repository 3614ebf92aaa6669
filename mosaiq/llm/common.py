"""Shared plumbing of the training-data operators: reading, Arrow maps, lineage cuts, components."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch handed to Python: bounds a worker's memory when texts are long.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, by a path that only Spark needs to be able to open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Return a worker's free memory to the system: workers are reused, and what one task needed stays theirs."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library isn't glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with small batches; narrow, so a lost executor costs one input split.

    The size of a batch is the session's; it is lowered to BATCH_ROWS where it is larger, and stays so,
    as the plan is run later.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def lasting_dir(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints, which outlives it.

    Where it names none, a temporary one of its own, but only if driver and executors are one process.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="mosaiq-"))
    return sc.getCheckpointDir()


def shared_dir(spark: SparkSession) -> str:
    """This session's folder for checkpoints and stages, in ``lasting_dir``."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(lasting_dir(spark))
    return sc.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, in whatever store it lies."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: rows are written to the shared checkpoint folder, and survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffled(df: DataFrame) -> DataFrame:
    """``df``, marked so that a join with it sorts and shuffles both sides, and sends none through the driver.

    Spark's estimates count neither the rows that an explode makes nor the length of texts and arrays, so a
    side of any size can pass for one that is small enough to broadcast.
    """
    return df.hint("merge")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` by alternating large-star and small-star rounds.

    Returns ``(node, label)``, one row per node that occurs in an edge; the label is the smallest
    node of its component. Every round is a grouped minimum and a join, written to the checkpoint
    folder; nothing but two numbers per round reaches the driver. A hub's edges, two numbers each, meet
    in a sort-merge join with one row a node, which adaptive execution splits on the edges' side.
    No edges give no rows.
    """
    e = cut(edges.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct())
    before = None
    while True:
        both = e.unionByName(e.selectExpr("b AS a", "a AS b"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(shuffled(low), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = cut(large)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(shuffled(low), "a").selectExpr("b AS a", "m AS b").unionByName(low.selectExpr("a", "m AS b"))
        e = cut(small.where("a <> b").distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return e.selectExpr("a AS node", "b AS label").unionByName(e.selectExpr("b AS node", "b AS label").distinct())


__all__ = ["BATCH_ROWS", "components", "cut", "lasting_dir", "map_arrow", "remove", "shared_dir", "shuffled", "table"]
