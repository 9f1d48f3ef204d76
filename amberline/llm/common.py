"""Helpers that the training-data operators share: staged tables, text batches, graph labels."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from amberline.operators.batches import flat, slices
from amberline.operators.staging import hidden, shared_dir

__all__ = ["connected_components", "drop", "flat", "freeing", "hidden", "purge", "raw_bytes", "settle", "shared_dir", "slices", "stage", "stage_at", "text_or_empty", "trim"]


def stage(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: a cut of the lineage that outlives executors."""
    return stage_at(spark, df, name)[0]


def stage_at(spark: SparkSession, df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The same, with the path, for ``drop`` once nothing reads it any more."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that runs inside go as it ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def purge(spark: SparkSession) -> None:
    """Delete every table this application staged. Call it after the last result has been written."""
    drop(spark, shared_dir(spark))


def trim() -> None:
    """Memory that is free within this process goes back to the system, where the libraries can do that."""
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give:
        give(0)


_SETTLED: list[tuple[str, Callable[[], None]]] = []


def settle(owner: str, leave: Callable[[], None] | None = None) -> None:
    """Called as a task of ``owner`` begins: a Python worker outlives the stages that it serves, so what
    another operator has kept in it goes now. ``leave`` says how to let go of what this one will keep."""
    while _SETTLED and _SETTLED[-1][0] != owner:
        _SETTLED.pop()[1]()
        trim()
    if leave is not None:
        _SETTLED[:] = [(owner, leave)]


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def raw_bytes(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """Label each node of ``edges(src, dst)`` with the smallest node that it reaches: ``(node, root)``.

    Alternating large-star and small-star rounds: each rewires neighbourhoods to their least
    member, so depth shrinks geometrically and no task sees more than one node's aggregate.
    Rounds end when a round leaves the edge set as it was. Each deletes the edges it has read.
    """
    current, path = stage_at(
        spark,
        edges.where(F.col("src") != F.col("dst"))
        .select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        .distinct(),
        "edges",
    )
    seen = None
    while True:
        both = current.union(current.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = both.groupBy("src").agg(F.min("dst").alias("low")).select("src", F.least("src", "low").alias("low"))
        large = both.where("dst > src").join(low, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        large = large.where("src <> dst").distinct()
        low = large.groupBy("src").agg(F.min("dst").alias("low"))
        small = (
            large.join(low, "src")
            .where(F.col("dst") != F.col("low"))
            .select(F.col("dst").alias("src"), F.col("low").alias("dst"))
            .union(low)
            .distinct()
        )
        before = path
        current, path = stage_at(spark, small, "edges")
        drop(spark, before)
        state = current.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))
        ).first()
        if tuple(state) == seen:
            return current.select(F.col("src").alias("node"), F.col("dst").alias("root"))
        seen = tuple(state)
