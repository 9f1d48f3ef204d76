"""Nearest neighbours by vantage-point trees, one per shard of the vectors.

A node holds a vantage point and the median distance to it; the nearer half goes inside, the other
half outside (ties by place, so halves are even and depth is the logarithm of the rows). Since halves
are even, a tree is its rows in an order, with a vantage and a median beside the first outer row of
each node: a table that Spark writes once and sorts, and that a task reads as it reads any rows.

A search for many queries walks a tree once: at a node the queries still there are split into those
for which the inside is nearer and those for which the outside is, each goes to its near side first,
and to the far side only if |distance - median| <= factor * bound. The bound is the distance of the
k-th best so far, which a query brings along from its own shard. By the triangle inequality nothing
is lost at factor 1; a smaller factor skips more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from amberline.llm.common import stage

SHARD_ROWS, BLOCK_QUERIES, LEAF = 16384, 2048, 256
#: Queries that one copy of a tree answers, in blocks of BLOCK_QUERIES.
SPAN_QUERIES = 1 << 17
#: Rows of the distance table that a leaf visit makes at once.
STEP = 512


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of a to all rows of b, squares added in the order of the components."""
    total = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        step = a[:, k, None] - b[None, :, k]
        total += step * step
    return np.sqrt(total)


class Tree:
    """Rows in the order of a tree. A node is a range of over ``leaf`` rows, cut in the middle."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, radius: np.ndarray, vantage: np.ndarray, leaf: int = LEAF):
        self.ids, self.vectors, self.radius, self.vantage, self.leaf = ids, vectors, radius, vantage, leaf
        #: Pairs of a query and a row whose distance was computed.
        self.compared = 0

    @classmethod
    def grown(cls, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> Tree:
        """The tree of rows in any order; rows of equal ids keep theirs."""
        n = len(ids)
        order = np.argsort(ids, kind="stable")
        radius, vantage = np.full(n, np.nan), np.full(n, -1, np.int64)
        todo = [(0, n)]
        while todo:
            first, end = todo.pop()
            if end - first <= leaf:
                continue
            rows, half = order[first:end], (end - first) // 2
            middle, chosen = first + half, rows[half]
            d = distances(vectors[rows], vectors[chosen][None])[:, 0]
            by = np.argsort(d, kind="stable")
            radius[middle], vantage[middle] = d[by[half]], chosen
            order[first:end] = np.concatenate([rows[np.sort(by[:half])], rows[np.sort(by[half:])]])
            todo += [(first, middle), (middle, end)]
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        return cls(ids[order], vectors[order], radius, np.where(vantage >= 0, place[vantage], -1), leaf)

    def search(self, own: np.ndarray, queries: np.ndarray, k: int, factor: float = 1.0, limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the k nearest per query, nearest first, ties to the smaller id; -1 and inf where fewer.

        Rows beyond the ``limit`` of a query are of no use to it, and may be left out.
        """
        self.best_id = np.full((len(own), k), np.iinfo(np.int64).max)
        self.best = np.full((len(own), k), np.inf)
        self.limit = np.full(len(own), np.inf) if limit is None else limit
        self.own, self.queries, self.k, self.factor = own, queries, k, factor
        if len(self.ids) and len(own):
            self._visit(0, len(self.ids), np.arange(len(own)))
        return np.where(np.isinf(self.best), -1, self.best_id), self.best

    def _bound(self, active: np.ndarray) -> np.ndarray:
        return np.minimum(self.best[active, -1], self.limit[active])

    def _visit(self, first: int, end: int, active: np.ndarray) -> None:
        if not len(active):
            return
        if end - first <= self.leaf:
            for q in range(0, len(active), STEP):
                self._leaf(slice(first, end), active[q : q + STEP])
            return
        middle = first + (end - first) // 2
        away = distances(self.queries[active], self.vectors[self.vantage[middle]][None])[:, 0]
        gap = away - self.radius[middle]
        near_in = gap < 0
        self._visit(first, middle, active[near_in])
        self._visit(middle, end, active[~near_in])
        far = np.abs(gap) <= self.factor * self._bound(active) + 1e-12 * (away + self.radius[middle])  # what rounding may take
        self._visit(middle, end, active[near_in & far])
        self._visit(first, middle, active[~near_in & far])

    def _leaf(self, rows: slice, active: np.ndarray) -> None:
        d = distances(self.queries[active], self.vectors[rows])
        self.compared += d.size
        ids = np.broadcast_to(self.ids[rows], d.shape)
        d = np.where(ids == self.own[active, None], np.inf, d)
        some = (d <= self._bound(active)[:, None]).any(axis=1)
        if not some.any():
            return
        active = active[some]
        d = np.concatenate([self.best[active], d[some]], axis=1)
        ids = np.concatenate([self.best_id[active], ids[some]], axis=1)
        pick = np.lexsort((ids, d), axis=1)[:, : self.k]
        self.best[active] = np.take_along_axis(d, pick, axis=1)
        self.best_id[active] = np.take_along_axis(ids, pick, axis=1)


def usable(vector: str) -> Column:
    """Not null, not zero, and without null or non-finite components."""
    c = F.col(vector)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return c.isNotNull() & F.coalesce(F.forall(c, finite), F.lit(False)) & F.coalesce(F.exists(c, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=float).reshape(len(column), -1)


def _numbers(table: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    return np.asarray(table.column(name))


#: Rows of trees (asks is false), in the order of ``place``, and queries with what their own shard holds.
_GROWN = "dim int, shard int, asks boolean, place int, id long, v array<double>, radius double, vantage int, near array<long>, away array<double>"
_FOUND = "query_id long, vec_id long, score double"


def nearest(spark: SparkSession, vectors: DataFrame, k: int = 10, factor: float = 1.0, every: int = 100, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest rows of each row whose id is divisible by ``every``: ``query_id, rank, vec_id, score``.

    Vectors that are null, zero or not finite take no part, nor do rows with a null id; vectors are
    compared with those of the same length. A query never finds a row with its own id; if an id is
    repeated among the queries, its least vector asks; other repeated ids are found once a row. Ties
    go to the smaller id. An empty table gives no rows; columns besides the two named are not read.

    The tree of a shard is grown once, in the task that also answers the queries which lie there, and
    written. Each query then passes the trees of the other shards with its k-th distance as a bound,
    so that of a shard which is too far nothing comes back.
    """
    if not 0 < factor <= 1:
        raise ValueError("factor must be above 0 and at most 1")
    rows = vectors.where(F.col(vec_id).isNotNull() & usable(vector)).select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    n = rows.count()
    shards, spans = max(1, -(-n // SHARD_ROWS)), max(1, -(-n // (every * SPAN_QUERIES)))
    # by id and vector, so that one id on many rows does not fill one shard
    placed = lambda df: df.withColumns({"dim": F.size("v"), "shard": F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int")})
    asked = rows.where(F.pmod("id", F.lit(every)) == 0).groupBy("id").agg(F.min("v").alias("v"))

    def grow(key: tuple, asked: pa.Table, held: pa.Table) -> pa.Table:
        tree = Tree.grown(_numbers(held, "id"), _matrix(held.column("v")))  # a query is a row of its shard, so there are some
        m, q = len(tree.ids), asked.num_rows
        own, x = np.zeros(0, np.int64), tree.vectors[:0]
        if q:
            own, x = _numbers(asked, "id"), _matrix(asked.column("v"))
        near, away = tree.search(own, x, k, factor)
        real = [~np.isinf(d) for d in away]
        lists = lambda values, kind: pa.array([None] * m + [x[ok] for x, ok in zip(values, real)], pa.list_(kind))
        both = np.concatenate([tree.vectors, x])
        v = pa.ListArray.from_arrays(np.arange(m + q + 1, dtype=np.int32) * both.shape[1], both.ravel())
        return pa.table({
            "dim": pa.array(np.full(m + q, key[0].as_py(), np.int32)),
            "shard": pa.array(np.full(m + q, key[1].as_py(), np.int32)),
            "asks": pa.array(np.arange(m + q) >= m),
            "place": pa.array(np.arange(m + q, dtype=np.int32)),
            "id": pa.array(np.r_[tree.ids, own]),
            "v": v,
            "radius": pa.array(np.r_[tree.radius, np.full(q, np.nan)]),
            "vantage": pa.array(np.r_[tree.vantage, np.full(q, -1)].astype(np.int32)),
            "near": lists(near, pa.int64()),
            "away": lists(away, pa.float64()),
        })

    def pass_by(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by tree, each tree before its queries; one tree is held at a time."""
        at, parts, tree = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = np.stack([_numbers(batch, c).astype(np.int64) for c in ("dim", "shard", "span", "asks")], axis=1)
            edges = np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1
            for first, end in zip(np.r_[0, edges], np.r_[edges, len(names)]):
                if at != tuple(names[first, :3]):
                    at, parts, tree = tuple(names[first, :3]), [], None
                if not names[first, 3]:
                    part = batch.slice(first, end - first)
                    parts.append((_numbers(part, "id"), _matrix(part.column("v")), _numbers(part, "radius"), _numbers(part, "vantage")))
                    continue
                if tree is None and parts:
                    tree, parts = Tree(*(np.concatenate(c) for c in zip(*parts))), []
                if tree is None:  # no vectors of this length in this shard
                    continue
                for block in range(first, end, BLOCK_QUERIES):
                    part = batch.slice(block, min(BLOCK_QUERIES, end - block))
                    own, limit = _numbers(part, "id"), _numbers(part, "bound")
                    found, d = tree.search(own, _matrix(part.column("v")), k, factor, limit)
                    real = (~np.isinf(d) & (d <= limit[:, None])).ravel()
                    if real.any():
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, k)[real]), pa.array(found.ravel()[real]), pa.array(d.ravel()[real])], names=["query_id", "vec_id", "score"])

    keys = ["dim", "shard"]
    grown = placed(asked).groupBy(*keys).cogroup(placed(rows).groupBy(*keys)).applyInArrow(grow, _GROWN)
    grown = stage(spark, grown, "trees")
    queries, trees = grown.where("asks"), grown.where("not asks")
    found = queries.select(F.col("id").alias("query_id"), F.explode(F.arrays_zip("near", "away")).alias("x")).select("query_id", F.col("x.near").alias("vec_id"), F.col("x.away").alias("score"))
    if shards > 1:
        every_span, others = F.sequence(F.lit(0), F.lit(spans - 1)), F.sequence(F.lit(0), F.lit(shards - 1))
        bound = F.when(F.size("away") < k, F.lit(float("inf"))).otherwise(F.element_at("away", -1))
        told = [*keys, "span", "asks", "place", "id", "v", "radius", "vantage", "bound"]
        held = trees.withColumns({"span": F.explode(every_span), "bound": F.lit(float("inf"))})
        sent = queries.withColumns({"span": F.pmod(F.xxhash64("id", F.lit(1)), F.lit(spans)).cast("int"), "bound": bound})
        sent = sent.withColumnRenamed("shard", "home").withColumn("shard", F.explode(others)).where("shard <> home")
        beside = held.select(*told).union(sent.select(*told))
        beside = beside.repartition(min(shards * spans, 1 << 15), *keys, "span").sortWithinPartitions(*keys, "span", "asks", "place", "id")
        found = found.union(beside.mapInArrow(pass_by, _FOUND))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))  # at most k rows a shard and query
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
