"""A stored BM25 index with block maxima, and a search that passes over blocks that cannot reach a query's best k.

Chunks are dealt to blocks of consecutive ordinals. For each term and block the index holds the largest contribution
that the term makes to a chunk of the block; their sum over the terms of a query bounds every score there. The
blocks with the largest bounds are scored first. They give a k-th best score, and of the other blocks only
those are scored whose bound reaches it. This is done slab by slab, a slab being a bounded number of blocks, and the best
of all slabs are merged. The rows are those of a search of all postings.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amberline.operators import retrieval
from amberline.session import ship

BLOCK, FIRST = 1024, 4
#: What rounding may take from a bound.
SLACK = 1e-8


@dataclass(frozen=True)
class Stored:
    """``postings(term, block, ord, gain)``, ``maxima(term, block, most)``, the ``Index`` that they were made from, and chunks a block."""

    index: retrieval.Index
    postings: DataFrame
    maxima: DataFrame
    block: int


def store(index: retrieval.Index, path: str, block: int = BLOCK) -> Stored:
    """Write the index once, sorted by term and block within files; read it with ``load``. Postings move once, to the weights of their terms."""
    hit = index.postings.join(index.terms, "term").join(F.broadcast(index.facts))  # one row of facts
    own = hit.select("term", F.floor(F.col("ord") / block).cast("long").alias("block"), "ord", retrieval.gain().alias("gain"))
    own.sortWithinPartitions("term", "block", "ord").write.option("compression", "zstd").parquet(f"{path}/postings")
    spark = index.chunks.sparkSession
    read = spark.read.parquet(f"{path}/postings")
    read.groupBy("term", "block").agg(F.max("gain").alias("most")).sortWithinPartitions("term", "block").write.option("compression", "zstd").parquet(f"{path}/maxima")
    for name, part in (("chunks", index.chunks), ("terms", index.terms), ("facts", index.facts.withColumn("block", F.lit(block)))):
        part.write.option("compression", "zstd").parquet(f"{path}/{name}")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> Stored:
    """A stored index; its ``Index`` has no raw postings, which this search does not read."""
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    index = retrieval.Index(read("chunks"), read("postings").select("term", "ord"), read("terms"), read("facts").drop("block"))
    return Stored(index, read("postings"), read("maxima"), read("facts").first()["block"])


def passed(slab: retrieval.Slab, block: int, k: int, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By query and block of a slab: bounds (NaN where no query term is held), what is read; and the scores of the chunks that are read."""
    shape = len(slab.query_id), -(-slab.rows // block)
    bounds, held = np.zeros(shape), np.zeros(shape, bool)
    for query, qtf, place, most in slab.terms(slab.maxima):
        bounds[query[:, None], place // block] += np.maximum(np.outer(qtf, most), 0.0)  # a chunk need not hold a term of negative weight
        held[query[:, None], place // block] = True
    place = np.argsort(np.argsort(np.where(held, -bounds, np.inf), axis=1, kind="stable"), axis=1)
    early = held & (place < first)
    scores = slab.scores(lambda query, chunk: early[query[:, None], chunk // block])
    least = np.partition(scores, -k, axis=1)[:, -k] if slab.rows > k else np.zeros(shape[0])
    late = held & ~early & (bounds + SLACK >= np.maximum(least, 0.0)[:, None])  # all of them, if fewer than k score above 0
    scores += slab.scores(lambda query, chunk: late[query[:, None], chunk // block])
    return np.where(held, bounds, np.nan), early | late, scores


def search(stored: Stored, queries: DataFrame, k: int, first: int = FIRST) -> tuple[DataFrame, DataFrame]:
    """The k best chunks of each query, as ``retrieval.search`` has them, and ``query_id, block, bound, read`` of all blocks with a query term.

    Bounds and scores stay in the task that holds a slab of whole blocks; there a block is passed over if its bound
    does not reach the k-th best score of the first ones. Neither result is computed unless it is used.
    """
    ship(queries.sparkSession)
    qt, block = retrieval.asked_terms(queries), stored.block
    size = block * max(1, retrieval.SLAB // block)
    kind = qt.schema["query_id"].dataType.simpleString()
    rows = lambda df, place, most: df.select("term", place.alias("ord"), most.alias("gain"), F.lit(df is stored.maxima).alias("most"))
    both = rows(stored.postings, F.col("ord"), F.col("gain")).unionByName(rows(stored.maxima, F.col("block") * block, F.col("most")))
    groups = retrieval.by_slab(stored.index, qt, both.join(qt.select("term", "set").distinct(), "term"), size)

    def found(key: tuple, held: pa.Table, asked: pa.Table) -> pa.Table:
        slab = retrieval.Slab(key, held, asked, size)
        return slab.best(passed(slab, block, k, first)[2], k)

    def judged(key: tuple, held: pa.Table, asked: pa.Table) -> pa.Table:
        slab = retrieval.Slab(key, held, asked, size)
        bounds, read, _ = passed(slab, block, k, first)
        query, at = np.nonzero(~np.isnan(bounds))
        return pa.table({"query_id": slab.query_id.take(pa.array(query)), "block": pa.array(at + slab.first // block, pa.int64()), "bound": bounds[query, at], "read": read[query, at]})

    best = retrieval.top(groups.applyInArrow(found, f"query_id {kind}, ord long, score double"), k)
    return best, groups.applyInArrow(judged, f"query_id {kind}, block long, bound double, read boolean")
