"""Histogram trees, grown level by level for many fits at once: forests and gradient boosting for two classes.

Features are binned once. Rows with the same bins are one cell to any tree, so trees are grown and scored on cells and how often
rows of a class fall into them, which soon stop growing with the rows. A tree asks for the best splits of the nodes it has reached; who answers does not
matter to it. If a search has more than ``HELD_ROWS`` cells, Spark answers: every task adds its rows to histograms of
(fit, node, feature), these are summed by key, and only the best split of each comes back, one job a level for
all fits together. A smaller fit is grown in the task that holds its cells, with the same splits; a forest tree there
takes all nodes of a level at once, by histograms while nodes are few and by sorted runs of bins when they are many.
Sums of a forest are whole counts of the two classes, weighted only when gains are taken, so both ways agree to the bit.

Forest: bootstrap counts are Poisson(1) numbers of (tree, row), drawn from a hash, so that they are the same in any
partitioning; classes are balanced within each tree's bootstrap. Trees are grown once to the largest depth and number
that is asked for: a shallower point stops on the way down, a smaller one uses the first trees.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amberline.operators.staging import staged

#: Cells of a search (of up to ``HELD_WIDTH`` features, else in proportion fewer) whose fits are grown in one task each; beyond it rows stay where they are and histograms travel.
HELD_ROWS, HELD_WIDTH = 1 << 20, 8
#: Rows, for which a task holds a cell's bins and a key, up to which it draws the bootstraps of its trees.
DRAWN_ROWS = 1 << 22
BINS, SEED = 255, 2026
#: Trees of a forest that share the jobs of a level, and that a task grows.
CHUNK, GROWN = 20, 10
#: Boosting rounds after which raw scores are written anew when rows are not held.
REFRESH = 10
NODES = 64  # whose histograms are in memory at once
STEPS, LEAVES, LEAST_ROWS = 100, 31, 20


def bin_edges(df: DataFrame, x: str, d: int) -> list[np.ndarray]:
    """Up to 255 upper edges a feature: its distinct values where they are few, quantiles otherwise."""
    asked = F.array(*(F.lit((k + 1) / (BINS + 1)) for k in range(BINS)))
    row = df.agg(*(F.percentile_approx(F.get(x, F.lit(k)), asked, 10000).alias(f"q{k}") for k in range(d))).first()
    return [np.unique(np.array(row[k] if row[k] is not None else [0.0], float)) for k in range(d)]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, k]) for k, e in enumerate(edges)], axis=1).astype(np.uint8) if len(edges) else np.zeros((len(x), 0), np.uint8)


def celled(rows: DataFrame, edges: list[np.ndarray], d: int, held: list[int]) -> DataFrame:
    """``row, key, y, part, cell``: the bins of a row, a byte a feature, and the place of its fold in ``held`` from 1 on (0: in none)."""
    place = F.coalesce(F.array_position(F.array(*map(F.lit, held)), F.col("fold")), F.lit(0)).cast("int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = binned(np.asarray(batch.column("x").flatten()).reshape(batch.num_rows, d), edges)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], packed_bins(bins)], names=["row", "key", "y", "part", "cell"])

    own = rows.select("row", "key", F.col("y").cast("int").alias("y"), place.alias("part"), "x")
    return staged(own.mapInArrow(run, "row long, key long, y int, part int, cell binary"), "cells")


def packed_bins(bins: np.ndarray) -> pa.Array:
    n, d = bins.shape
    ends = pa.py_buffer(np.arange(0, n * d + 1, d, dtype=np.int32) if d else np.zeros(n + 1, np.int32))
    return pa.Array.from_buffers(pa.binary(), n, [None, ends, pa.py_buffer(np.ascontiguousarray(bins))])


def column_of(table: pa.Table | pa.RecordBatch, name: str) -> pa.Array:
    return table.column(name).combine_chunks() if isinstance(table, pa.Table) else table.column(name)


def bins_of(table: pa.Table | pa.RecordBatch, d: int) -> np.ndarray:
    cells = column_of(table, "cell")
    data, first = cells.buffers()[2], cells.offset * d
    held = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return held[first : first + len(cells) * d].reshape(len(cells), d)


def distinct(bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cells of these rows, in an order of their own, and the number of each row's cell."""
    at = np.zeros(len(bins), np.int64)
    for first in range(0, bins.shape[1], 3):
        for j in range(first, min(first + 3, bins.shape[1])):
            at = at << 8 | bins[:, j]
        at = np.unique(at, return_inverse=True)[1]
    return bins[np.unique(at, return_index=True)[1]], at


def by_row(cells: DataFrame, found: DataFrame) -> DataFrame:
    """``point, row, p`` of the rows in held folds; ``found`` has ``part, cell`` and ``scores`` of (point, p)."""
    return cells.where("part > 0").select("row", "part", "cell").join(found, ["part", "cell"]).select("row", F.inline("scores")).select("point", "row", "p")


@dataclass(frozen=True)
class Limits:
    """What a tree may do: its depth (None: open), its leaves, rows a leaf, and features drawn a node (None: all)."""

    depth: int | None = None
    leaves: int | None = None
    rows: int = 1
    drawn: int | None = None
    hessian: float = 0.0
    seed: int = 0
    weights: tuple[float, float] | None = None  # of the two classes, where sums are whole counts of them


@dataclass
class Tree:
    """Nodes by number; ``feature`` is -1 at a leaf. ``total`` has sums of gradients, hessians and rows."""

    limits: Limits
    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    total: list[tuple[float, float, float]] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    draw: list[int] = field(default_factory=list)
    known: list[tuple | None] = field(default_factory=list)

    def add(self, total: tuple[float, float, float], depth: int, draw: int) -> int:
        for column, v in ((self.feature, -1), (self.cut, 0), (self.left, -1), (self.total, total), (self.depth, depth), (self.draw, draw)):
            column.append(v)
        ends = self.limits.depth is not None and depth >= self.limits.depth or depth > 0 and total[2] < 2 * self.limits.rows
        self.known.append((0.0,) if ends else None)
        return len(self.feature) - 1

    def split(self, node: int) -> None:
        gain, feature, cut, sums = self.known[node]
        whole = self.total[node]
        rest = tuple(a - b for a, b in zip(whole, sums))
        self.feature[node], self.cut[node] = feature, cut
        if self.left[node] < 0:
            self.left[node] = self.add(sums, self.depth[node] + 1, self.draw[node] * 6364136223846793005 + 1 & 2**61 - 1)
            self.add(rest, self.depth[node] + 1, self.draw[node] * 6364136223846793005 + 3 & 2**61 - 1)

    def frontier(self) -> list[int]:
        """Split what is worth most among what is known; the nodes whose best splits have to be found next."""
        if not self.feature:
            self.add((0.0, 0.0, 0.0), 0, self.limits.seed)
            return [0]
        self.feature = [-1] * len(self.feature)
        heap, leaves, open_ = [], 1, []

        def seen(node: int) -> None:
            if self.known[node] is None:
                open_.append(node)
            elif self.known[node][0] > 0:
                heapq.heappush(heap, (-self.known[node][0], node))

        seen(0)
        while heap and (self.limits.leaves is None or leaves < self.limits.leaves):
            node = heapq.heappop(heap)[1]
            self.split(node)
            leaves += 1
            seen(self.left[node])
            seen(self.left[node] + 1)
        return open_

    def learn(self, nodes: list[int], found: list[tuple]) -> None:
        for node, (total, *best) in zip(nodes, found):
            if node == 0:
                self.total[0] = total
            self.known[node] = tuple(best)

    def packed(self) -> dict[str, np.ndarray]:
        return {"feature": np.array(self.feature), "cut": np.array(self.cut), "left": np.array(self.left), "value": values(np.array(self.total), self.limits)}

    def explored(self) -> dict[str, np.ndarray]:
        """With all splits that were tried, also those that are not taken now."""
        some = [(int(self.known[n][1]), int(self.known[n][2])) if left >= 0 else (-1, 0) for n, left in enumerate(self.left)]
        return {"feature": np.array([f for f, _ in some]), "cut": np.array([c for _, c in some]), "left": np.array(self.left)}


def values(total: np.ndarray, limits: Limits) -> np.ndarray:
    g, h = np.moveaxis(weighted(total, limits), -1, 0)[:2]
    return np.divide(g, h, out=np.zeros_like(g), where=h > 0)


def descend(tree: dict[str, np.ndarray], bins: np.ndarray, most: int | None = None, at: np.ndarray | None = None) -> np.ndarray:
    """The node that each row reaches, after ``most`` steps at the latest."""
    at = np.zeros(len(bins), np.int64) if at is None else at.copy()
    step = 0
    while most is None or step < most:
        go = np.flatnonzero(tree["feature"][at] >= 0)
        if not len(go):
            break
        node = at[go]
        at[go] = tree["left"][node] + (bins[go, tree["feature"][node]] > tree["cut"][node])
        step += 1
    return at


def histograms(bins: np.ndarray, place: np.ndarray, nodes: int, stats: np.ndarray) -> np.ndarray:
    """Sums of the three ``stats`` by (node, feature, bin); rows at place -1 are left out."""
    d, width = bins.shape[1], BINS + 1
    own = np.flatnonzero(place >= 0)
    first, parts, out = place[own] * width, [stats[own, k] for k in range(3)], np.zeros((nodes, d, width, 3))
    for j in range(d):
        at = first + bins[own, j]
        for k in range(3):
            out[:, j, :, k] = np.bincount(at, parts[k], nodes * width).reshape(nodes, width)
    return out


def weighted(sums: np.ndarray, limits: Limits) -> np.ndarray:
    """Gradients, hessians and rows; those of a forest come as positives, negatives and rows."""
    if limits.weights is None:
        return sums
    neg, pos = limits.weights
    return np.stack([sums[..., 0] * pos, sums[..., 0] * pos + sums[..., 1] * neg, sums[..., 2]], axis=-1)


def gains_of(left: np.ndarray, whole: np.ndarray, limits: Limits) -> np.ndarray:
    """What the cuts gain that leave the sums ``left`` of ``whole`` to their left; 0 if they may not be."""
    right = weighted(whole - left, limits)
    left, whole = weighted(left, limits), weighted(whole, limits)
    term = lambda s: np.divide(s[..., 0] ** 2, s[..., 1], out=np.zeros(s.shape[:-1]), where=s[..., 1] > 0)
    gain = term(left) + term(right) - term(whole)
    fits = (left[..., 2] >= limits.rows) & (right[..., 2] >= limits.rows) & (left[..., 1] > limits.hessian) & (right[..., 1] > limits.hessian)
    return np.where(fits & (gain > 1e-9 * np.abs(whole[..., 1])), gain, 0.0)


def best_splits(held: np.ndarray, limits: Limits) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By (node, feature): gain of the best cut (0: none), the cut, sums to its left; and the sums of the node."""
    left = held.cumsum(axis=2)
    gain = gains_of(left, left[:, :, -1:, :], limits)
    cut = gain.argmax(axis=2)
    pick = lambda a: np.take_along_axis(a, cut[:, :, None], axis=2)[:, :, 0]
    return pick(gain), cut, np.stack([pick(left[..., k]) for k in range(3)], axis=-1), left[:, :, -1, :]


def run_splits(bins: np.ndarray, place: np.ndarray, stats: np.ndarray, limits: Limits) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``best_splits`` of many small nodes, all of which have rows: only bins that a node has are looked at. ``stats`` are whole numbers."""
    nodes, d, width = int(place.max()) + 1, bins.shape[1], BINS + 1
    whole = np.stack([np.bincount(place, stats[:, k], nodes) for k in range(3)], axis=-1)
    before = np.cumsum(whole, axis=0) - whole
    gain, cut, sums = np.zeros((nodes, d)), np.zeros((nodes, d), np.int64), np.zeros((nodes, d, 3))
    for j in range(d):
        key = place * width + bins[:, j]
        order = np.argsort(key)
        key = key[order]
        last = np.flatnonzero(np.r_[key[1:] != key[:-1], True])  # of each run of rows with the same node and bin
        node = key[last] // width
        left = np.cumsum(stats[order], axis=0)[last] - before[node]
        own = gains_of(left, whole[node], limits)
        head = np.searchsorted(node, np.arange(nodes))
        most = np.maximum.reduceat(own, head)
        best = np.flatnonzero(own == most[node])
        best = best[np.searchsorted(node[best], np.arange(nodes))]  # the first of equals
        gain[:, j], cut[:, j], sums[:, j] = most, key[last[best]] % width, left[best]
    return gain, cut, sums, np.repeat(whole[:, None], d, axis=1)


def mixed(z: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return z ^ (z >> np.uint64(31))


def drawn(gains: np.ndarray, limits: Limits, draw: np.ndarray) -> np.ndarray:
    """By node the feature with the largest gain; of a forest, among the first few in the node's random order that have any."""
    if limits.drawn is None:
        return gains.argmax(axis=1)
    number = np.arange(1, gains.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(mixed(draw.astype(np.uint64)[:, None] + number), axis=1, kind="stable")
    own = np.take_along_axis(gains, order, axis=1)
    first = np.where(np.cumsum(own > 0, axis=1) <= limits.drawn, own, 0.0).argmax(axis=1)
    return np.take_along_axis(order, first[:, None], axis=1)[:, 0]


def chosen(gains: np.ndarray, cuts: np.ndarray, sums: np.ndarray, whole: np.ndarray, limits: Limits, draw: int) -> tuple:
    k = int(drawn(gains[None], limits, np.array([draw]))[0])
    return tuple(map(float, whole)), float(gains[k]), k, int(cuts[k]), tuple(map(float, sums[k]))


def held_tree(limits: Limits, bins: np.ndarray, stats: np.ndarray) -> Tree:
    """A tree with a limit of leaves over rows in memory."""
    tree, at = Tree(limits), np.zeros(len(bins), np.int64)
    while open_ := tree.frontier():
        at = descend(tree.explored(), bins, at=at)  # a split may be taken back, its rows stay below it
        found = []
        for k in range(0, len(open_), NODES):
            some = open_[k : k + NODES]
            number = np.full(len(tree.feature), -1)
            number[some] = np.arange(len(some))
            parts = best_splits(histograms(bins, number[at], len(some), stats), limits)
            found += [chosen(g, c, s, w[0], limits, tree.draw[n]) for n, g, c, s, w in zip(some, *parts)]
        tree.learn(open_, found)
    return tree


def held_levels(limits: Limits, bins: np.ndarray, stats: np.ndarray) -> dict[str, np.ndarray]:
    """A packed tree without a limit of leaves over rows in memory, a level at a time; ``stats`` are counts of the two classes and of both."""
    total, draw = stats.sum(axis=0)[None], np.array([limits.seed], np.uint64)
    place, rows, first, parts, depth = np.zeros(len(bins), np.int64), np.arange(len(bins)), 0, [], 0
    while True:
        # ``total`` and ``draw`` are of the nodes of this level, ``rows`` those in its open nodes, ``place`` their node
        feature, cut, left = np.full(len(total), -1), np.zeros(len(total), np.int64), np.full(len(total), -1)
        open_ = (total[:, :2] > 0).all(axis=1) & ((depth == 0) | (total[:, 2] >= 2 * limits.rows)) & (limits.depth is None or depth < limits.depth)
        keep = open_[place]
        rows, place, number = rows[keep], place[keep], np.cumsum(open_) - 1
        parts.append((feature, cut, left, total))
        if not len(rows) or not bins.shape[1]:
            break
        own, at = bins[rows], number[place]
        few = open_.sum() * (BINS + 1) <= len(rows)
        found = best_splits(histograms(own, at, int(open_.sum()), stats[rows]), limits) if few else run_splits(own, at, stats[rows], limits)
        gain, cuts, sums, _ = found
        k = drawn(gain, limits, draw[open_])
        pick = lambda a, k=k: a[np.arange(len(k)), k]
        splits = pick(gain) > 0
        node = np.flatnonzero(open_)[splits]
        feature[node], cut[node], left[node] = k[splits], pick(cuts)[splits], first + len(total) + 2 * np.arange(len(node))
        keep = feature[place] >= 0
        rows, place, own = rows[keep], place[keep], own[keep]
        place = left[place] - first - len(total) + (own[np.arange(len(rows)), feature[place]] > cut[place])
        first += len(total)
        begun = draw[node] * np.uint64(6364136223846793005)
        draw = np.stack([begun + np.uint64(1), begun + np.uint64(3)], axis=1).ravel() & np.uint64(2**61 - 1)
        total = np.stack([pick(sums)[splits], total[node] - pick(sums)[splits]], axis=1).reshape(-1, 3)
        depth += 1
        if not len(node):
            break
    feature, cut, left, total = map(np.concatenate, zip(*parts))
    return {"feature": feature, "cut": cut, "left": left, "value": values(total, limits)}


def passed_trees(spark: SparkSession, rows: DataFrame, limits: list[Limits], d: int, stats_of: Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray, np.ndarray]]]) -> list[Tree]:
    """Trees of all fits over rows that stay where they are. ``stats_of`` gives (fit, bins, stats) of a batch, for the fits that learn from it."""
    trees = [Tree(x) for x in limits]
    while any(fronts := [t.frontier() for t in trees]):
        packed = [t.packed() for t in trees]

        def count(batches: Iterator[pa.RecordBatch], packed=packed, fronts=fronts) -> Iterator[pa.RecordBatch]:  # noqa: B006
            part = TaskContext.get().partitionId() % 32
            sums: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                for fit, bins, stats in stats_of(batch) if batch.num_rows else ():
                    at = descend(packed[fit], bins)
                    for k in range(0, len(fronts[fit]), NODES):
                        some = np.array(fronts[fit][k : k + NODES])
                        number = np.full(len(packed[fit]["feature"]), -1)
                        number[some] = np.arange(len(some))
                        made = histograms(bins, number[at], len(some), stats)
                        sums[fit, k] = sums[fit, k] + made if (fit, k) in sums else made
            for (fit, k), held in sums.items():
                for i, j in zip(*np.nonzero(held[..., 2].any(axis=2))):
                    one = pa.ListArray.from_arrays([0, held[i, j].size], held[i, j].ravel())
                    yield pa.RecordBatch.from_arrays([pa.array([fit], pa.int32()), pa.array([fronts[fit][k + i]]), pa.array([int(j)], pa.int32()), pa.array([part], pa.int32()), one], names=["fit", "node", "feature", "part", "held"])

        def add(held: pa.Table) -> pa.Table:
            values = np.asarray(held.column("held").combine_chunks().flatten()).reshape(held.num_rows, -1).sum(axis=0)
            return pa.table({c: held.column(c)[:1] for c in ("fit", "node", "feature")} | {"held": [values]})

        def best(key: tuple, held: pa.Table) -> pa.Table:
            values = np.asarray(held.column("held").combine_chunks().flatten()).reshape(held.num_rows, -1).sum(axis=0)
            gain, cut, sums, whole = best_splits(values.reshape(1, 1, BINS + 1, 3), limits[key[0].as_py()])
            return pa.table({c: held.column(c)[:1] for c in ("fit", "node", "feature")} | {"gain": gain[0], "cut": cut[0].astype(np.int32), "sums": [sums[0, 0]], "whole": [whole[0, 0]]})

        keys = "fit int, node long, feature int"
        made = rows.mapInArrow(count, f"{keys}, part int, held array<double>").groupBy("fit", "node", "feature", "part").applyInArrow(add, f"{keys}, held array<double>")
        found = made.groupBy("fit", "node", "feature").applyInArrow(best, f"{keys}, gain double, cut int, sums array<double>, whole array<double>").collect()  # a row a feature of an open node
        by = {}
        for r in found:
            by.setdefault((r["fit"], r["node"]), []).append(r)
        for fit, (tree, front) in enumerate(zip(trees, fronts)):
            answers = []
            for node in front:
                gains, cuts, sums, whole = np.zeros(d), np.zeros(d, int), np.zeros((d, 3)), np.zeros(3)
                for r in by.get((fit, node), []):
                    gains[r["feature"]], cuts[r["feature"]], sums[r["feature"]], whole = r["gain"], r["cut"], r["sums"], r["whole"]
                answers.append(chosen(gains, cuts, sums, whole, tree.limits, tree.draw[node]))
            tree.learn(front, answers)
    return trees


def holds(n: int, d: int) -> bool:
    """Whether a task may hold that many cells."""
    return n * max(d, HELD_WIDTH) <= HELD_ROWS * HELD_WIDTH


# forests


def bootstrap(key: np.ndarray, tree: int) -> np.ndarray:
    """Poisson(1) counts of rows in a tree's sample."""
    z = key.astype(np.uint64) + np.uint64(((SEED << 32) + tree + 1) * 0x9E3779B97F4A7C15 % 2**64)
    u = (mixed(z) >> np.uint64(11)) / 2.0**53
    terms = np.cumsum(np.exp(-1.0) / np.cumprod(np.r_[1.0, np.arange(1.0, 20.0)]))
    return np.searchsorted(terms, u, side="right").astype(float)


def class_weights(by_class: np.ndarray) -> tuple[float, float]:
    """Of negatives and positives; ``by_class`` are the counts of the two classes in the tree's bootstrap."""
    neg, pos = by_class.sum() / (2 * np.maximum(by_class, 1.0))
    return float(neg), float(pos)


def class_counts(y: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.stack([counts * (y == 1), counts * (y != 1), counts], axis=1)


def forest_stats(y: np.ndarray, counts: np.ndarray, by_class: np.ndarray) -> np.ndarray:
    """Weighted positives, weights and rows."""
    return weighted(class_counts(y, counts), Limits(weights=class_weights(by_class)))


def forest_scores(tree: dict[str, np.ndarray], bins: np.ndarray, depths: list[int | None]) -> np.ndarray:
    """A column of scores for each depth."""
    out, at, done = np.zeros((len(bins), len(depths))), None, 0
    for k in sorted(range(len(depths)), key=lambda k: (depths[k] is None, depths[k] or 0)):
        at = descend(tree, bins, None if depths[k] is None else depths[k] - done, at)
        out[:, k], done = tree["value"][at], depths[k]
    return out


def forest(spark: SparkSession, rows: DataFrame, d: int, held: list[int], points: list[dict[str, Any]], n: int) -> DataFrame:
    """``point, row, p`` of the rows of each fold in ``held`` by forests over the other folds. ``rows``: ``row, key, y, fold, x``."""
    edges = bin_edges(rows, "x", d)
    depths = list(dict.fromkeys(p["maxDepth"] for p in points))
    sizes = sorted({p["numTrees"] for p in points})
    deepest = None if None in depths else max(depths)
    limits = lambda t, by_class: Limits(depth=deepest, drawn=max(1, int(np.sqrt(d))), seed=SEED * 1000 + t, weights=class_weights(by_class))
    at_size = lambda t: [s for s in sizes if t < s]
    schema = "size int, depth int, row long, p double"

    def added(row: np.ndarray, scores: dict[int, np.ndarray]) -> pa.Table:
        parts = [pa.table({"size": pa.array([s] * len(row), pa.int32()), "depth": pa.array([k] * len(row), pa.int32()), "row": row, "p": p[:, k]}) for s, p in scores.items() for k in range(len(depths))]
        return pa.concat_tables(parts) if parts else pa.table({"size": pa.array([], pa.int32()), "depth": pa.array([], pa.int32()), "row": pa.array([], pa.int64()), "p": pa.array([], pa.float64())})

    def arrays(table: Any) -> tuple[np.ndarray, ...]:
        column = lambda c: table.column(c).combine_chunks() if isinstance(table, pa.Table) else table.column(c)
        x = np.asarray(column("x").flatten()).reshape(table.num_rows, d)
        return binned(x, edges), *(np.asarray(column(c)) for c in ("row", "key", "y", "fold"))

    cells = celled(rows, edges, d, held)
    if n <= DRAWN_ROWS and holds(cells.select("cell").distinct().count(), d):
        slots, parts_ = [(s, k) for s in range(len(sizes)) for k in range(len(depths))], len(held) + 1

        def grow(key: tuple, table: pa.Table) -> pa.Table:
            first = key[0].as_py() * GROWN
            cell, at = distinct(bins_of(table, d))
            own, y, part = (np.asarray(column_of(table, c)) for c in ("key", "y", "part"))
            place, asked = (part * 2 + y) * np.int64(len(cell)) + at, [np.unique(at[part == i]) for i in range(1, parts_)]
            sums = [np.zeros((len(a), len(sizes), len(depths))) for a in asked]
            for t in range(first, min(first + GROWN, sizes[-1])):
                counts = np.concatenate([bootstrap(own[a : a + (1 << 18)], t) for a in range(0, len(own), 1 << 18)])
                counts = np.bincount(place, counts, 2 * parts_ * len(cell)).reshape(parts_, 2, len(cell))
                for i, (a, total) in enumerate(zip(asked, sums), 1):
                    neg, pos = counts.sum(axis=0) - counts[i]
                    inside = neg + pos > 0
                    stats = np.stack([pos, neg, pos + neg], axis=1)[inside]
                    grown = held_levels(limits(t, np.array([neg.sum(), pos.sum()])), cell[inside], stats)
                    total[:, [sizes.index(s) for s in at_size(t)]] += forest_scores(grown, cell[a], depths)[:, None]
            made = [pa.table({"part": pa.array([i] * len(a), pa.int32()), "cell": packed_bins(cell[a]), "p": pa.FixedSizeListArray.from_arrays(total.ravel(), len(slots)).cast(pa.list_(pa.float64()))}) for i, (a, total) in enumerate(zip(asked, sums), 1)]
            return pa.concat_tables(made)

        chunks = (sizes[-1] - 1) // GROWN + 1
        copies = cells.select("key", "y", "part", "cell", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk")).repartition(3 * chunks, "chunk")
        grown = copies.groupBy("chunk").applyInArrow(grow, "part int, cell binary, p array<double>")
        total = grown.groupBy("part", "cell").agg(*(F.sum(F.get("p", F.lit(j))).alias(f"p{j}") for j in range(len(slots))))
        at = [slots.index((sizes.index(p["numTrees"]), depths.index(p["maxDepth"]))) for p in points]
        scores = F.array(*(F.struct(F.lit(i).alias("point"), (F.col(f"p{j}") / F.lit(p["numTrees"])).alias("p")) for i, (j, p) in enumerate(zip(at, points))))
        return by_row(cells, total.select("part", "cell", scores.alias("scores")))
    parts = []
    for first in range(0, sizes[-1], CHUNK):
        fits = [(k, t) for k in held for t in range(first, min(first + CHUNK, sizes[-1]))]

        def classes(batches: Iterator[pa.RecordBatch], fits=fits) -> Iterator[pa.RecordBatch]:  # noqa: B006
            total = np.zeros((len(fits), 2))
            for batch in batches:
                _, _, own, y, fold = arrays(batch)
                for i, (k, t) in enumerate(fits):
                    total[i] += np.bincount(y[fold != k].astype(int), bootstrap(own[fold != k], t), 2)
            yield pa.RecordBatch.from_pydict({"fit": pa.array(range(len(fits)), pa.int32()), "neg": total[:, 0], "pos": total[:, 1]})

        by_class = {r["fit"]: np.array([r["neg"], r["pos"]]) for r in rows.mapInArrow(classes, "fit int, neg double, pos double").groupBy("fit").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")).collect()}

        def stats_of(batch: pa.RecordBatch, fits=fits) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:  # noqa: B006
            bins, _, own, y, fold = arrays(batch)
            for i, (k, t) in enumerate(fits):
                counts = np.where(fold != k, bootstrap(own, t), 0.0)
                inside = counts > 0
                yield i, bins[inside], class_counts(y[inside], counts[inside])

        packed = [t.packed() for t in passed_trees(spark, rows, [limits(t, by_class[i]) for i, (_, t) in enumerate(fits)], d, stats_of)]

        def score(batches: Iterator[pa.RecordBatch], fits=fits, packed=packed) -> Iterator[pa.RecordBatch]:  # noqa: B006
            for batch in batches:
                bins, row, _, _, fold = arrays(batch)
                for k in np.unique(fold):
                    scores: dict[int, np.ndarray] = {}
                    for (f, t), tree in zip(fits, packed):
                        if f == k:
                            p = forest_scores(tree, bins[fold == k], depths)
                            for s in at_size(t):
                                scores[s] = scores[s] + p if s in scores else p
                    yield from added(row[fold == k], scores).to_batches()

        parts.append(staged(rows.mapInArrow(score, schema), "scores"))
    sums = parts[0]
    for part in parts[1:]:
        sums = sums.unionByName(part)
    total = sums.groupBy("size", "depth", "row").agg(F.sum("p").alias("p"))
    numbered = [F.when((F.col("size") == p["numTrees"]) & (F.col("depth") == depths.index(p["maxDepth"])), i) for i, p in enumerate(points)]
    return total.select(F.explode(F.array_compact(F.array(*numbered))).alias("point"), "row", (F.col("p") / F.col("size")).alias("p"))


# boosting


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def boost_stats(raw: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    p = sigmoid(raw)
    return np.stack([w * (p - y), w * p * (1 - p), np.ones(len(y))], axis=1)


def boosting(spark: SparkSession, rows: DataFrame, d: int, held: list[int], points: list[dict[str, Any]], n: int, weights: dict[int, tuple[float, float]]) -> DataFrame:
    """``point, row, p`` of the rows of each fold in ``held``; ``weights`` are those of the two classes outside a fold."""
    edges = bin_edges(rows, "x", d)
    steps = [p.get("maxIter", STEPS) for p in points]
    limits = [Limits(depth=p["maxDepth"], leaves=LEAVES, rows=LEAST_ROWS, hessian=1e-3) for p in points]

    cells = celled(rows, edges, d, held)
    counted = staged(cells.groupBy("cell", "y", "part").agg(F.count(F.lit(1)).alias("n")), "counted")

    def arrays(table: Any) -> tuple[np.ndarray, ...]:
        return bins_of(table, d), *(np.asarray(column_of(table, c)) for c in ("y", "part", "n"))

    def weight(i: int, y: np.ndarray) -> np.ndarray:
        return np.where(y == 1, weights[held[i - 1]][1], weights[held[i - 1]][0])

    scored_by = F.collect_list(F.struct("point", "p")).alias("scores")
    if holds(counted.count(), d):

        def grow(key: tuple, table: pa.Table) -> pa.Table:
            k, i = (v.as_py() for v in key)
            bins, y, part, n = arrays(table)
            cell, at = distinct(bins)
            counts = np.bincount(y * np.int64(len(cell)) + at, n * (part != k), 2 * len(cell)).reshape(2, -1)
            y, learned = np.nonzero(counts)
            n, raw, w = counts[y, learned][:, None], np.zeros(len(cell)), weight(k, y)
            for _ in range(steps[i]):
                tree = held_tree(limits[i], cell[learned], boost_stats(raw[learned], y, w) * n).packed()
                raw -= points[i]["stepSize"] * tree["value"][descend(tree, cell)]
            test = np.unique(at[part == k])
            return pa.table({"part": pa.array([k] * len(test), pa.int32()), "cell": packed_bins(cell[test]), "point": pa.array([i] * len(test), pa.int32()), "p": sigmoid(raw[test])})

        copies = counted.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(held)))).alias("k")).select("*", F.explode(F.sequence(F.lit(0), F.lit(len(points) - 1))).alias("point"))
        found = copies.repartition(3 * len(held) * len(points), "k", "point").groupBy("k", "point").applyInArrow(grow, "part int, cell binary, point int, p double")
        return by_row(cells, found.groupBy("part", "cell").agg(scored_by))
    fits = [(k, i) for k in range(1, len(held) + 1) for i in range(len(points))]
    kept, late = counted.withColumn("raw", F.array_repeat(F.lit(0.0), len(fits))), [[] for _ in fits]

    def scored(batch: pa.RecordBatch, late: list) -> tuple[np.ndarray, ...]:
        bins, y, part, n = arrays(batch)
        raw = np.array(np.asarray(batch.column("raw").flatten()).reshape(batch.num_rows, len(fits)))
        for f, grown in enumerate(late):
            for tree in grown:
                raw[:, f] -= points[fits[f][1]]["stepSize"] * tree["value"][descend(tree, bins)]
        return bins, y, part, n, raw

    for step in range(max(steps)):

        def stats_of(batch: pa.RecordBatch, late=late, step=step) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:  # noqa: B006
            bins, y, part, n, raw = scored(batch, late)
            for f, (k, i) in enumerate(fits):
                if step < steps[i]:
                    own = part != k
                    yield f, bins[own], boost_stats(raw[own, f], y[own], weight(k, y[own])) * n[own, None]

        for f, tree in enumerate(passed_trees(spark, kept, [limits[i] for _, i in fits], d, stats_of)):
            if step < steps[fits[f][1]]:
                late[f].append(tree.packed())
        if (step + 1) % REFRESH == 0 or step + 1 == max(steps):

            def renew(batches: Iterator[pa.RecordBatch], late=late) -> Iterator[pa.RecordBatch]:  # noqa: B006
                for batch in batches:
                    if batch.num_rows:
                        raw = scored(batch, late)[-1]
                        at = batch.schema.get_field_index("raw")
                        yield batch.set_column(at, "raw", pa.ListArray.from_arrays(np.arange(0, raw.size + 1, len(fits), dtype=np.int32), raw.ravel()))

            kept, late = staged(kept.mapInArrow(renew, kept.schema), "boosted"), [[] for _ in fits]
    own = kept.select("cell", "part", F.posexplode("raw").alias("f", "raw"))
    of = F.array(*(F.struct(F.lit(k).alias("part"), F.lit(i).alias("point")) for k, i in fits))
    own = own.withColumn("fit", F.get(of, F.col("f"))).where("fit.part = part").select("part", "cell", "fit.point", (1 / (1 + F.exp(-F.col("raw")))).alias("p"))
    return by_row(cells, own.dropDuplicates(["part", "cell", "point"]).groupBy("part", "cell").agg(scored_by))  # a cell comes once a class
