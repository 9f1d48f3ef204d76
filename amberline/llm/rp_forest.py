"""Near-duplicate vectors by a forest of random-projection trees.

Every tree projects unit vectors on one random direction a level and splits a node at the median there. Rows
within a margin of the cut go to both sides, so that a pair is parted only if its projections lie farther
apart than the margin on both sides of the cut. Within a leaf all cosines are computed. A pair of one tree's
leaf may meet again in others: it counts in the first place that its two rows share, which every row can tell
from the list of its places. So a leaf reports a number of links and a least member for each row, never pairs.

Nodes are split in rounds of ``LEVELS`` levels. The cuts of a round come from a sample of about ``SAMPLE`` rows a
node, which sets where cuts lie and not which rows are compared. A leaf that no direction splits (many rows that
are nearly the same) is compared block against block.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import fsum, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amberline.llm import common
from amberline.llm.vptree import usable

TREES, LEVELS, ROUNDS, SAMPLE, SEED = 8, 8, 6, 4096, 12
#: Rows at which a node is a leaf, and above which a leaf is split again or compared in blocks.
LEAF, MOST = 1024, 2048
#: Width of the band that goes to both sides, in deviations of the projected difference of a pair at the threshold.
SPILL = 1.0
#: Rows of all trees that are grown together.
AT_ONCE = 1 << 17
#: Rows of a leaf whose cosines are computed at once.
STRIP = 512
KEYS = ["dim", "tree", "leaf"]


def units(column: pa.Array) -> np.ndarray:
    v = np.asarray(column.flatten()).astype(float).reshape(len(column), -1)
    v = v / np.abs(v).max(axis=1, keepdims=True, initial=0.0)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def directions(tree: int, depth: int, d: int) -> np.ndarray:
    """One unit vector for each of the ``LEVELS`` levels below ``depth``, as columns."""
    made = [np.random.default_rng([SEED, tree, depth + k]).standard_normal(d) for k in range(LEVELS)]
    return np.stack([x / np.sqrt(x @ x) for x in made], axis=1)


def margin(least: float, d: int) -> float:
    return 0.5 * SPILL * sqrt(2 * (1 - least) / d)


def cuts_of(projected: np.ndarray, rows: int, band: float) -> np.ndarray:
    """Cuts of the nodes of one subtree in heap order, NaN where a node stays a leaf; a sampled row stands for its share of ``rows``."""
    cuts = np.full(2**LEVELS - 1, np.nan)
    each = rows / max(len(projected), 1)
    nodes = [np.arange(len(projected))]
    for level in range(LEVELS):
        below: list[np.ndarray] = []
        for k, own in enumerate(nodes):
            sides = [own[:0], own[:0]]
            if len(own) >= 32 and len(own) * each > LEAF:
                p = projected[own, level]
                cut = float(np.median(p))
                sides = [own[p <= cut + band], own[p > cut - band]]
                if max(map(len, sides)) <= 0.9 * len(own):
                    cuts[2**level - 1 + k] = cut
            below += sides
        nodes = below
    return cuts


def walked(projected: np.ndarray, cuts: np.ndarray, leaf: np.ndarray, band: float) -> tuple[np.ndarray, np.ndarray]:
    """Where each row ends: positions of rows, and the leaves that they reach (more than one a row near cuts)."""
    who, at, ended = np.arange(len(leaf)), np.zeros(len(leaf), np.int64), []
    for level in range(LEVELS):
        cut = cuts[who, 2**level - 1 + at]
        stays = np.isnan(cut)
        ended.append((who[stays], leaf[stays]))
        who, at, leaf, cut = who[~stays], at[~stays], leaf[~stays], cut[~stays]
        p = projected[who, level]
        left, right = p <= cut + band, p > cut - band
        who = np.concatenate([who[left], who[right]])
        leaf = np.concatenate([2 * leaf[left], 2 * leaf[right] + 1])
        at = np.concatenate([2 * at[left], 2 * at[right] + 1])
    ended.append((who, leaf))
    return np.concatenate([x[0] for x in ended]), np.concatenate([x[1] for x in ended])


def grown(spark: SparkSession, groups: DataFrame, trees: range, least: float) -> tuple[DataFrame, str]:
    """``dim, tree, leaf, node, v`` of all leaves of some trees, and where they are stored; ``groups`` has ``dim, node, v``."""
    kind = groups.schema["v"].dataType.simpleString()
    schema = f"dim int, tree int, leaf long, node long, v {kind}"

    def fit(key: tuple, held: pa.Table) -> pa.Table:
        d, tree, leaf = (k.as_py() for k in key)
        v = units(held.column("v").combine_chunks())
        cuts = cuts_of(v @ directions(tree, leaf.bit_length() - 1, d), held.column("n")[0].as_py(), margin(least, d))
        return pa.table({"dim": pa.array([d], pa.int32()), "tree": pa.array([tree], pa.int32()), "leaf": [leaf], "cuts": [cuts]})

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim, tree, leaf = (np.asarray(batch.column(c)) for c in KEYS)
            depth = np.array([int(x).bit_length() - 1 for x in leaf])
            kinds = np.stack([dim, tree, depth], axis=1)
            for k in np.unique(kinds, axis=0) if batch.num_rows else []:
                rows = np.flatnonzero((kinds == k).all(axis=1))
                own = batch.take(pa.array(rows))
                cuts = np.asarray(own.column("cuts").flatten()).reshape(len(rows), -1)
                d, t, deep = map(int, k)
                who, ends = walked(units(own.column("v")) @ directions(t, deep, d), cuts, leaf[rows], margin(least, d))
                out = own.take(pa.array(who))
                yield pa.RecordBatch.from_arrays([out.column("dim"), out.column("tree"), pa.array(ends), out.column("node"), out.column("v")], names=[*KEYS, "node", "v"])

    live = groups.select("dim", F.explode(F.sequence(F.lit(trees[0]), F.lit(trees[-1]))).alias("tree"), F.lit(1).cast("long").alias("leaf"), "node", "v")
    closed, paths = None, []

    def kept(df: DataFrame, name: str) -> DataFrame:
        staged, path = common.stage_at(spark, df, name)
        paths.append(path)
        return staged

    for turn in range(ROUNDS):
        sizes = kept(live.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST), "sizes")
        if sizes.isEmpty():
            break
        drawn = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(2**30)) / 2**30
        cuts = live.join(sizes, KEYS).where(drawn * F.col("n") < SAMPLE).groupBy(*KEYS).applyInArrow(fit, "dim int, tree int, leaf long, cuts array<double>")
        cuts = kept(cuts.where(~F.isnan(F.get("cuts", F.lit(0)))), "cuts")  # the others no direction splits
        small = live.join(cuts.select(*KEYS), KEYS, "left_anti")
        live = kept(live.join(cuts, KEYS).mapInArrow(route, schema), "rows")
        closed = small if closed is None else closed.unionByName(small)
    leaves = common.stage_at(spark, live if closed is None else closed.unionByName(live), "leaves")
    for path in paths:
        common.drop(spark, path)
    return leaves


def lows(linked: np.ndarray) -> np.ndarray:
    """The least position that each position of a symmetric matrix of links reaches."""
    label = np.arange(len(linked))
    while True:
        low = np.minimum(label, np.where(linked, label[None, :], len(linked)).min(axis=1, initial=len(linked)))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def earlier(places: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """Whether a row of the first list and one of the second share a place."""
    codes, at = np.unique(np.concatenate([*places, *others, np.zeros(0, np.int64)]), return_inverse=True)
    marks = np.zeros((len(places) + len(others), len(codes)), np.float32)
    marks[np.repeat(np.arange(len(marks)), [len(x) for x in [*places, *others]]), at] = 1
    return marks[: len(places)] @ marks[len(places) :].T > 0


def near(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Which pairs have a cosine of at least ``least``; those within rounding of it are summed exactly."""
    out = np.zeros((len(a), len(b)), bool)
    for k in range(0, len(a), STRIP):
        cosine = a[k : k + STRIP] @ b.T
        out[k : k + STRIP] = cosine >= least
        for i, j in zip(*np.nonzero(np.abs(cosine - least) < 1e-12)):
            x, y = a[k + i], b[j]
            out[k + i, j] = fsum(x * y) / sqrt(fsum(x * x) * fsum(y * y)) >= least
    return out


def compared(held: pa.Table, place: int, first: int, second: int, least: float) -> dict[str, np.ndarray]:
    """``node, low, links`` of the rows of two blocks of a leaf that have links; a pair that shares an earlier place adds none."""
    block, node, copies = (np.asarray(held.column(c).combine_chunks()) for c in ("block", "node", "copies"))
    v = units(held.column("v").combine_chunks())
    left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
    linked = near(v[left], v[right], least)
    if first == second:
        linked |= linked.T
        np.fill_diagonal(linked, False)
    rows, columns = linked.any(axis=1), linked.any(axis=0)
    left, right, linked = left[rows], right[columns], linked[np.ix_(rows, columns)]
    if not len(left):
        return {"node": np.zeros(0, np.int64), "low": np.zeros(0, np.int64), "links": np.zeros(0, np.int64)}
    places = held.column("places").combine_chunks()
    before = lambda at: [x[x < place] for x in (np.asarray(places[int(k)].values) for k in at)]
    new = linked & ~earlier(before(left), before(right))
    if first == second:
        who, links, whole = left, new @ copies[left], linked
    else:
        who, links = np.concatenate([left, right]), np.concatenate([new @ copies[right], new.T @ copies[left]])
        whole = np.block([[np.zeros((len(left),) * 2, bool), linked], [linked.T, np.zeros((len(right),) * 2, bool)]])
    order = np.argsort(node[who], kind="stable")
    low = np.empty(len(who), np.int64)
    low[order] = node[who][order][lows(whole[np.ix_(order, order)])]
    return {"node": node[who], "low": low, "links": links}


def links(spark: SparkSession, groups: DataFrame, least: float) -> DataFrame:
    """``node, low, links`` of ``groups(dim, node, copies, v)`` from all trees.

    A few trees are grown and compared at a time, so that the disk holds ``AT_ONCE`` rows of a tree or the copies of one tree,
    and not of all; what stays of a tree are the leaves of each row, by which later ones know what has met.
    """
    many = max(1, min(TREES, AT_ONCE // max(1, groups.count())))
    found, met, old = None, None, None
    with common.freeing(spark):
        for first in range(0, TREES, many):
            leaves, path = grown(spark, groups.select("dim", "node", "v"), range(first, min(first + many, TREES)), least)
            place = F.shiftleft(F.col("tree").cast("long"), 56) + F.col("leaf")
            own = leaves.groupBy("node").agg(F.collect_list(place).alias("places"))  # a few a tree
            if met is not None:
                own = met.join(own.withColumnRenamed("places", "more"), "node").select("node", F.concat("places", "more").alias("places"))
            met, new = common.stage_at(spark, own, "places")
            part = common.stage(spark, met_in(leaves, met, groups, least), "links")
            found = part if found is None else found.unionByName(part)
            for gone in (path, old):
                if gone:
                    common.drop(spark, gone)
            old = new
    common.drop(spark, old)
    return found


def met_in(leaves: DataFrame, places: DataFrame, groups: DataFrame, least: float) -> DataFrame:
    """``node, low, links`` of the rows of some leaves; ``places`` are those of these and of earlier trees."""
    sizes = leaves.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.when(F.col("n") > MOST, F.ceil(F.col("n") * 2 / MOST)).otherwise(1).cast("int")
    known = leaves.join(sizes, KEYS).join(places.join(groups.select("node", "copies"), "node"), "node").withColumn("blocks", blocks)
    known = known.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    known = known.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    known = known.withColumns({"first": F.least("block", "other"), "second": F.greatest("block", "other")})

    def compare(key: tuple, held: pa.Table) -> pa.Table:
        _, tree, leaf, first, second = (k.as_py() for k in key)
        return pa.table(compared(held, (tree << 56) + leaf, first, second, least))

    found = known.select(*KEYS, "first", "second", "block", "node", "copies", "places", "v").groupBy(*KEYS, "first", "second")
    return found.applyInArrow(compare, "node long, low long, links long")


def linked(spark: SparkSession, vectors: DataFrame, least: float = 0.9, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row: other rows of cosine ``least`` or more, and the least id reachable by links.

    Rows with equal vectors are compared once and count one by one. Vectors that are null, zero or hold null or
    non-finite components link with nothing; nor do vectors of different lengths with each other. A row with a
    null id links as any other, but lends its id to no component; ``component_id`` of rows that reach no id is
    null and ``kept`` is then true. Rows with the same id and different vectors are different rows. No pair
    below ``least`` links; a pair at it is missed with a probability of about (1 - 0.97^depth)^``TREES``, depth being the
    logarithm to base 1.7 of rows / ``LEAF``, and pairs of larger cosine more rarely. An empty table gives no rows.
    """
    if not 0 < least < 1:
        raise ValueError("the least cosine lies between 0 and 1")
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v"), usable(vector).alias("use"))
    groups = rows.where("use").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    groups = common.stage(spark, groups.withColumns({"node": F.monotonically_increasing_id(), "dim": F.size("v")}), "vectors")
    found = links(spark, groups, least)
    roots = common.connected_components(spark, found.select(F.col("node").alias("src"), F.col("low").alias("dst")))
    totals = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = groups.join(roots, "node", "left").join(totals, "node", "left").withColumn("root", F.coalesce("root", "node"))
    firsts = known.groupBy("root").agg(F.min("rep").alias("component_id"))
    labels = known.join(firsts, "root").select(F.col("v").alias("same"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    labels = common.stage(spark, labels, "labels")
    used = rows.where("use").join(labels, F.col("v") == F.col("same")).select("vec_id", "n_links", "component_id")
    rest = rows.where("not coalesce(use, false)").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return used.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
