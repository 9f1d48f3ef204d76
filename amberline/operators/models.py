"""Classifier comparison: balanced weights, stratified folds, grid search by average precision, ablation, one-shot test.

All points and folds of a learner are fitted together. Logistic regression takes Newton steps of all fits in one
aggregate; forests and boosting are the histogram trees of ``trees``. Every row is scored by the models of its
own fold, and one grouped average precision ranks all of them. Fitted numbers differ from other libraries' by
design of the learners; counts, folds and metrics do not.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from amberline.operators import trees
from amberline.operators.decision import average_precision, average_precision_by, fold_summary, metrics_at
from amberline.operators.staging import staged
from amberline.session import ship


@dataclass(frozen=True)
class Spec:
    """A learner by name, whether its features are scaled, and its grid."""

    name: str
    scaled: bool = False
    grid: dict[str, tuple[Any, ...]] = field(default_factory=dict)

    def points(self) -> list[dict[str, Any]]:
        return [dict(zip(self.grid, values)) for values in product(*self.grid.values())]


# The grids that are searched.
SPECS = (
    Spec("dummy"),
    Spec("logistic", True, {"C": (0.001, 0.01, 0.1, 1.0, 10.0)}),
    Spec("random_forest", False, {"numTrees": (200, 500), "maxDepth": (8, 16, None)}),
    Spec("gradient_boosting", False, {"stepSize": (0.05, 0.1), "maxDepth": (3, 6, None)}),
)
SEED = 2026


NEWTON, TOLERANCE = 60, 1e-9


def sigmoid_loss(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z) - y * z


def logistic(rows: DataFrame, d: int, held: list[int], points: list[dict[str, Any]], weights: dict[int, tuple[float, float]]) -> DataFrame:
    """``point, row, p``: rows of each fold scored by logistic regressions on the other folds.

    Features are standardized by the rows that a fit learns from. A fit minimizes C times the weighted log loss
    plus half the square of its coefficients (not of the intercept), by Newton steps that are halved while
    they do not lower it. One job a step gathers loss, gradient and Hessian of all fits.
    """

    def columns(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        x = np.asarray(batch.column("x").flatten()).reshape(batch.num_rows, d)
        return x, *(np.asarray(batch.column(c)) for c in ("y", "fold", "row"))

    def summed(values_of: Any) -> dict[int, np.ndarray]:
        """Sums over all rows of the arrays that ``values_of`` gives by number for a batch."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for k, v in values_of(*columns(batch)) if batch.num_rows else ():
                    sums[k] = sums[k] + v if k in sums else v
            part = TaskContext.get().partitionId() % 32
            yield pa.RecordBatch.from_pydict({"k": pa.array(list(sums), pa.int32()), "part": pa.array([part] * len(sums), pa.int32()), "v": pa.array(list(sums.values()), pa.list_(pa.float64()))})

        def add(table: pa.Table) -> pa.Table:
            v = np.asarray(table.column("v").combine_chunks().flatten()).reshape(table.num_rows, -1)
            return pa.table({"k": table.column("k")[:1], "v": [v.sum(axis=0)]})

        parts = rows.mapInArrow(count, "k int, part int, v array<double>").groupBy("k", "part").applyInArrow(add, "k int, v array<double>")
        return {r["k"]: np.array(r["v"]) for r in parts.groupBy("k").applyInArrow(add, "k int, v array<double>").collect()}  # one a fit

    each = summed(lambda x, y, fold, row: [(int(k), np.r_[(fold == k).sum(), x[fold == k].sum(axis=0)]) for k in np.unique(fold)])
    total = sum(each.values())
    mean = {k: (total - each.get(k, 0 * total))[1:] / (total - each.get(k, 0 * total))[0] for k in held}
    spread = summed(lambda x, y, fold, row: [(i, ((x[fold != k] - mean[k]) ** 2).sum(axis=0)) for i, k in enumerate(held)])
    scale = {k: np.sqrt(spread[i] / (total - each.get(k, 0 * total))[0]) for i, k in enumerate(held)}
    scale = {k: np.where(s > 0, s, 1.0) for k, s in scale.items()}
    ready = lambda x, k: np.c_[(x - mean[k]) / scale[k], np.ones(len(x))]
    fits = [(k, i) for k in held for i in range(len(points))]
    penalty = np.r_[np.ones(d), 0.0]
    beta, step, best = np.zeros((len(fits), d + 1)), np.zeros((len(fits), d + 1)), np.full(len(fits), np.inf)
    going = list(range(len(fits)))
    for _ in range(NEWTON):
        tried = beta + step

        def derived(x: np.ndarray, y: np.ndarray, fold: np.ndarray, row: np.ndarray, tried=tried, going=tuple(going)) -> Iterator[tuple[int, np.ndarray]]:  # noqa: B006
            for k in held:
                own = [f for f in going if fits[f][0] == k]
                if own:
                    z, t = ready(x[fold != k], k), y[fold != k]
                    w = np.where(t == 1, weights[k][1], weights[k][0])
                    for f in own:
                        eta = z @ tried[f]
                        p = trees.sigmoid(eta)
                        yield f, np.r_[(w * sigmoid_loss(eta, t)).sum(), z.T @ (w * (p - t)), (z.T @ (z * (w * p * (1 - p))[:, None])).ravel()]

        found = summed(derived)
        for f in list(going):
            c, v = points[fits[f][1]]["C"], found[f]
            loss = c * v[0] + 0.5 * (penalty * tried[f] ** 2).sum()
            if loss > best[f] + 1e-12 * abs(best[f]):
                step[f] /= 2
                if np.abs(step[f]).max() < TOLERANCE:
                    going.remove(f)
                continue
            beta[f], best[f] = tried[f], loss
            gradient = c * v[1 : d + 2] + penalty * beta[f]
            step[f] = -np.linalg.lstsq(c * v[d + 2 :].reshape(d + 1, d + 1) + np.diag(penalty), gradient, rcond=None)[0]
            if np.abs(step[f]).max() < TOLERANCE:
                going.remove(f)
        if not going:
            break

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, _, fold, row = columns(batch)
            for f, (k, i) in enumerate(fits):
                own = fold == k
                p = trees.sigmoid(ready(x[own], k) @ beta[f])
                yield pa.RecordBatch.from_pydict({"point": pa.array([i] * len(p), pa.int32()), "row": row[own], "p": p})

    return rows.mapInArrow(score, "point int, row long, p double")


def scores(spark: SparkSession, spec: Spec, points: list[dict[str, Any]], df: DataFrame, features: list[str], label: str, fold: str, held: list[int]) -> DataFrame:
    """``df``, where its fold is in ``held``, once for each point, with ``point`` (its number) and ``p``: a score by a model of the other folds.

    Features are numbers; a null counts as 0. Rows without a label are scored but not learned from: their fold must be held.
    """
    x = F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features)) if features else F.array().cast("array<double>")
    ship(spark)
    own = staged(df.withColumns({"_row": F.monotonically_increasing_id(), "_x": x}), "fits")
    seeds = [f.name for f in df.schema if f.name != label and not isinstance(f.dataType, MapType)]  # a row draws by what it holds
    rows = own.select(F.col("_row").alias("row"), F.xxhash64(*seeds).alias("key"), F.coalesce(F.col(label).cast("double"), F.lit(0.0)).alias("y"), F.col(fold).cast("int").alias("fold"), F.col("_x").alias("x"))
    counts = {r["fold"]: (r["n"], r["pos"]) for r in rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos")).collect()}  # a row a fold
    n, share, weights = {}, {}, {}
    for k in held:
        n[k], pos = (sum(c[i] for f, c in counts.items() if f != k) for i in (0, 1))
        if not pos or pos == n[k]:
            raise ValueError("two classes are needed")
        share[k], weights[k] = pos / n[k], (n[k] / (2 * (n[k] - pos)), n[k] / (2 * pos))
    if spec.name == "dummy":
        prior = F.create_map(*(F.lit(v) for k in held for v in (k, float(share[k]))))
        return own.where(F.col(fold).isin(held)).withColumns({"point": F.lit(0), "p": F.get(F.array(prior), F.lit(0))[F.col(fold).cast("int")]}).drop("_row", "_x")
    whole, d = sum(c[0] for c in counts.values()), len(features)
    if spec.name == "logistic":
        found = logistic(rows, d, held, points, weights)
    elif spec.name == "random_forest":
        found = trees.forest(spark, rows, d, held, points, whole)
    else:
        found = trees.boosting(spark, rows, d, held, points, whole, weights)
    return own.join(staged(found, "scores"), F.col("_row") == F.col("row")).drop("_row", "_x", "row")


def fit_predict(spec: Spec, params: dict[str, Any], train: DataFrame, test: DataFrame, features: list[str], label: str) -> DataFrame:
    """``test`` with ``p``; everything that is fitted comes from ``train``."""
    both = train.withColumn("_held", F.lit(0)).unionByName(test.withColumn("_held", F.lit(1)), allowMissingColumns=True)
    return scores(train.sparkSession, spec, [params], both, features, label, "_held", [1]).select(*test.columns, "p")


def cross_validate(spark: SparkSession, specs: list[Spec], df: DataFrame, features: list[str], label: str, fold: str, folds: int) -> DataFrame:
    """``model, point, params, fold, score``: average precision of each grid point, by its number in the grid, on each fold."""
    found = None
    for spec in specs:
        points = spec.points()
        scored = scores(spark, spec, points, df, features, label, fold, list(range(folds)))
        own = average_precision_by(scored.select(F.col("point"), F.col(fold).alias("fold"), F.col(label).alias("y"), "p"), ["point", "fold"], "y", "p")
        text = F.get(F.array(*(F.lit(str(sorted(p.items()))) for p in points)), F.col("point"))
        own = own.select(F.lit(spec.name).alias("model"), "point", text.alias("params"), F.col("fold").cast("int").alias("fold"), F.col("average_precision").alias("score"))
        found = own if found is None else found.unionByName(own)
    return staged(found, "search")


def best_points(scores: DataFrame) -> DataFrame:
    """The best grid point of each model by mean score, ties to the first in the grid."""
    mean = scores.groupBy("model", "point", "params").agg(F.avg("score").alias("mean_score"), F.stddev_pop("score").alias("sd_score"))
    first = F.min_by(F.struct("point", "params", "mean_score", "sd_score"), F.struct(-F.col("mean_score"), F.col("point")))
    return mean.groupBy("model").agg(first.alias("b")).select("model", "b.point", "b.params", "b.mean_score", "b.sd_score")


def chosen(spark: SparkSession, specs: list[Spec], df: DataFrame, features: list[str], label: str, fold: str, folds: int) -> tuple[Spec, dict[str, Any]]:
    """The learner and the grid point with the best mean score, ties to the first in ``specs``."""
    best = {r["model"]: r for r in best_points(cross_validate(spark, specs, df, features, label, fold, folds)).collect()}  # one row a model
    spec = max(specs, key=lambda s: best[s.name]["mean_score"])
    return spec, spec.points()[best[spec.name]["point"]]


def ablation(spark: SparkSession, spec: Spec, params: dict[str, Any], df: DataFrame, base: list[str], extra: list[str], label: str, fold: str, folds: int) -> DataFrame:
    """The same parameters and folds with and without a block of features, and the difference."""
    fixed = Spec(spec.name, spec.scaled, {k: (v,) for k, v in params.items()})
    both = [cross_validate(spark, [fixed], df, f, label, fold, folds).withColumn("model", F.lit(n)) for n, f in (("baseline", base), ("with_extra", base + extra))]
    means = fold_summary(both[0].unionByName(both[1])).drop("rank")
    return means.join(F.broadcast(means.where("model = 'baseline'").select(F.col("mean_score").alias("_b")))).select("model", "mean_score", "sd_score", F.round(F.col("mean_score") - F.col("_b"), 6).alias("delta"))


def evaluate_once(spec: Spec, params: dict[str, Any], threshold: float, train: DataFrame, test: DataFrame, features: list[str], label: str, amount: str) -> DataFrame:
    """Metrics on the test rows at a threshold fixed before; the only function that may read them, called last."""
    scored = fit_predict(spec, params, train, test, features, label)
    at = metrics_at(scored, label, amount, "p", F.lit(threshold))
    return at.join(F.broadcast(average_precision(scored, label, "p")))  # one row each
