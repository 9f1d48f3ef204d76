"""Exact quantiles of many columns at once by radix selection.

A double becomes a 64-bit key of the same order. Rows are counted by the top 16 bits of the key, and then only
those that share the bits of a wanted rank by the next 16, four times in all. No task keeps a value, no value is
sorted or shuffled: what travels are at most 65,536 counts a column and wanted prefix from each task.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from amberline.session import ship

SIGN = np.uint64(1 << 63)


def keys(values: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the doubles; -0.0 is 0.0, NaN the largest."""
    bits = np.where(np.isnan(values), np.nan, values + 0.0).view(np.uint64)
    return np.where(bits & SIGN != 0, ~bits, bits | SIGN)


def value(key: int) -> float:
    bits = key ^ (1 << 63) if key >> 63 else ~key & (1 << 64) - 1
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def counted(df: DataFrame, level: int, prefixes: list[list[int]]) -> DataFrame:
    """``c, prefix, bucket, n``: rows of column c whose key starts with a prefix of ``16 * level`` bits, by the next 16."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {(c, p): np.zeros(65536, np.int64) for c, some in enumerate(prefixes) for p in some}
        for batch in batches:
            for c, some in enumerate(prefixes):
                key = keys(np.asarray(batch.column(c).drop_null(), dtype=float)) >> np.uint64(48 - 16 * level)
                for p in some:
                    own = key if level == 0 else key[key >> np.uint64(16) == np.uint64(p)]
                    sums[c, p] += np.bincount((own & np.uint64(65535)).astype(np.int64), minlength=65536)
        for (c, p), n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"c": pa.array(np.full(len(at), c), pa.int32()), "prefix": pa.array(np.full(len(at), p), pa.int64()), "bucket": pa.array(at, pa.int32()), "n": n[at]})

    return df.mapInArrow(count, "c int, prefix long, bucket int, n long").groupBy("c", "prefix", "bucket").agg(F.sum("n").alias("n"))


def quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> dict[str, list[float | None]]:
    """Per column the quantiles at ``shares``, linear between ranks; null where a column has no value. Nulls take no part."""
    spark = ship(df.sparkSession)
    own = df.select(*(F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)))
    total = own.agg(*(F.count(c).alias(c) for c in own.columns)).first()
    wanted = {}  # (column, rank): prefix found so far, rank within it
    for i in range(len(columns)):
        for q in shares if total[i] else ():
            for r in (floor((total[i] - 1) * q), ceil((total[i] - 1) * q)):
                wanted[i, r] = (0, r)
    for level in range(4):
        if not wanted:
            break
        prefixes = [sorted({p for (c, _), (p, _) in wanted.items() if c == i}) for i in range(len(columns))]
        asked = spark.createDataFrame([(c, p, r, at) for (c, r), (p, at) in wanted.items()], "c int, prefix long, rank long, at long")
        upto = F.sum("n").over(W.partitionBy("c", "prefix").orderBy("bucket"))  # 65,536 rows a prefix at most
        found = counted(own, level, prefixes).withColumn("upto", upto).join(F.broadcast(asked), ["c", "prefix"])  # a row a rank
        for r in found.where("upto > at and upto - n <= at").collect():
            wanted[r["c"], r["rank"]] = (r["prefix"] << 16 | r["bucket"], r["at"] - (r["upto"] - r["n"])) if level < 3 else (value(r["prefix"] % (1 << 48) << 16 | r["bucket"]), 0)
    out = {}
    for i, c in enumerate(columns):
        out[c] = [None] * len(shares)
        for k, q in enumerate(shares if total[i] else ()):
            place = (total[i] - 1) * q
            low, high = wanted[i, floor(place)][0], wanted[i, ceil(place)][0]
            out[c][k] = low if low == high else low * (1 - (place - floor(place))) + high * (place - floor(place))
    return out
