"""Tables written once to the folder that driver and executors share, and global running sums on top of them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="amberline-")
        spark.sparkContext.setCheckpointDir(root)
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/amberline/{spark.sparkContext.applicationId}"


def staged(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hidden(columns: list[str], name: str) -> str:
    """A name for a column of our own that none of ``columns`` has, whatever their case."""
    taken, name = {c.lower() for c in columns}, f"_{name}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], number: str = "k") -> DataFrame:
    """``df`` with a global row number and running sums in ``order``, which must be total.

    Rows are range-partitioned by the order and written once; sums of whole partitions (one row
    each) give the offsets, and each partition is then summed on its own, so no task sees all rows.
    Columns of any name pass through.
    """
    own = lambda name: hidden(df.columns, name)
    part, n, place = own("part"), own("n"), own("r")
    added, before_, local_ = ([own(f"{c}{i}") for i in range(len(sums))] for c in "stl")
    named = df.withColumns(dict(zip(added, sums.values())))
    # the file that a row lies in names its range, whatever later reads do with files
    ranged = named.repartitionByRange(*order).withColumn(part, F.spark_partition_id())
    ranged = staged(ranged, "ordered")
    totals = ranged.groupBy(part).agg(F.count(F.lit(1)).alias(n), *(F.sum(s).alias(t) for s, t in zip(added, before_)))
    before = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)  # one row a partition
    offsets = totals.select(part, *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in [n, *before_]))
    local = W.partitionBy(part).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = ranged.withColumns({place: F.row_number().over(W.partitionBy(part).orderBy(*order)), **{c: F.sum(s).over(local) for s, c in zip(added, local_)}})
    out = out.join(offsets, part)
    return out.select(*df.columns, (F.col(n) + F.col(place)).alias(number), *((F.col(t) + F.col(c)).alias(name) for name, t, c in zip(sums, before_, local_)))
