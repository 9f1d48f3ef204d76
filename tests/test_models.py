"""Learners against plain solvers, jobs over rows against rows in memory, and a real search of the whole grid."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from amberline.operators import decision, models, trees


def table(spark, n=240, d=3, seed=0, folds=3):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 9, size=(n, d)).astype(float) + np.arange(d)
    y = (x @ np.arange(1, d + 1) + rng.normal(size=n) * 6 > np.median(x @ np.arange(1, d + 1))).astype(int)
    y[: n // 8] = 0
    rows = [(int(k), int(y[k]), int(k % folds), *map(float, x[k])) for k in range(n)]
    return spark.createDataFrame(rows, "k long, y int, fold int, " + ", ".join(f"x{j} double" for j in range(d))), x, y, np.arange(n) % folds


def by_point(df):
    return {(r["point"], r["k"]): r["p"] for r in df.select("point", "k", "p").collect()}


def test_logistic_against_a_plain_solver(spark):
    df, x, y, fold = table(spark)
    x[:, 2] = 4.0  # constant
    df = df.withColumn("x2", F.lit(4.0))
    points = [{"C": c} for c in (0.001, 1.0, 10.0)]
    got = by_point(models.scores(spark, models.SPECS[1], points, df, ["x0", "x1", "x2"], "y", "fold", [0, 1, 2]))
    assert len(got) == 3 * len(y)
    for i, point in enumerate(points):
        for k in range(3):
            train = fold != k
            m, s = x[train].mean(axis=0), x[train].std(axis=0)
            z = np.c_[(x - m) / np.where(s > 0, s, 1), np.ones(len(x))]
            w = np.where(y[train] == 1, train.sum() / (2 * y[train].sum()), train.sum() / (2 * (train.sum() - y[train].sum())))
            beta, ridge = np.zeros(4), np.diag([1.0, 1.0, 1.0, 0.0])
            for _ in range(100):
                p = 1 / (1 + np.exp(-z[train] @ beta))
                g = point["C"] * z[train].T @ (w * (p - y[train])) + ridge @ beta
                h = point["C"] * (z[train].T * (w * p * (1 - p))) @ z[train] + ridge
                beta -= np.linalg.pinv(h) @ g
            for j in np.flatnonzero(fold == k):
                assert abs(got[i, j] - 1 / (1 + np.exp(-z[j] @ beta))) < 1e-7


def plain_booster(x, y, train, steps, rate, depth, leaves=31, rows=20):
    """Best-first trees over sorted values, one split at a time."""
    n, pos = train.sum(), y[train].sum()
    w = np.where(y == 1, n / (2 * pos), n / (2 * (n - pos)))
    raw = np.zeros(len(y))
    edges = [np.unique(c) for c in x.T]

    def best(at, g, h):
        out = (0.0,)
        for j, values in enumerate(edges):
            for v in values:
                left = at & (x[:, j] <= v)
                right = at & ~left
                if left.sum() >= rows and right.sum() >= rows and min(h[left].sum(), h[right].sum()) > 1e-3:
                    gain = g[left].sum() ** 2 / h[left].sum() + g[right].sum() ** 2 / h[right].sum() - g[at].sum() ** 2 / h[at].sum()
                    if gain > out[0] + 1e-9:
                        out = (gain, j, v)
        return out

    for _ in range(steps):
        p = 1 / (1 + np.exp(-raw))
        g, h = w * (p - y), w * p * (1 - p)
        nodes = [(train.copy(), np.ones(len(y), bool), 0)]
        found = [best(train, g, h)]
        while len(nodes) < leaves:
            k = max((k for k in range(len(nodes)) if found[k][0] > 0 and (depth is None or nodes[k][2] < depth)), key=lambda k: found[k][0], default=None)
            if k is None:
                break
            own, every, deep = nodes.pop(k)
            _, j, v = found.pop(k)
            for side in (x[:, j] <= v, x[:, j] > v):
                nodes.append((own & side, every & side, deep + 1))
                found.append(best(own & side, g, h))
        for own, every, _ in nodes:
            raw[every] -= rate * g[own].sum() / h[own].sum()
    return 1 / (1 + np.exp(-raw))


POINTS = [{"stepSize": 0.1, "maxDepth": 2, "maxIter": 4}, {"stepSize": 0.3, "maxDepth": None, "maxIter": 3}]


@pytest.mark.parametrize("held", [trees.HELD_ROWS, 0])
def test_boosting_against_a_plain_booster(spark, monkeypatch, held):
    monkeypatch.setattr(trees, "HELD_ROWS", held)
    monkeypatch.setattr(trees, "REFRESH", 2)
    df, x, y, fold = table(spark)
    got = by_point(models.scores(spark, models.SPECS[3], POINTS, df.repartition(3), ["x0", "x1", "x2"], "y", "fold", [0, 2]))
    assert len(got) == 2 * (np.isin(fold, [0, 2])).sum()
    for i, p in enumerate(POINTS):
        for k in (0, 2):
            want = plain_booster(x, y, fold != k, p["maxIter"], p["stepSize"], p["maxDepth"])
            assert max(abs(got[i, j] - want[j]) for j in np.flatnonzero(fold == k)) < 1e-9


def test_leaves_are_limited_best_first(spark, monkeypatch):
    monkeypatch.setattr(trees, "LEAVES", 5)
    monkeypatch.setattr(trees, "LEAST_ROWS", 3)
    df, x, y, fold = table(spark, seed=4)
    got = by_point(models.scores(spark, models.SPECS[3], [{"stepSize": 1.0, "maxDepth": None, "maxIter": 2}], df, ["x0", "x1", "x2"], "y", "fold", [1]))
    want = plain_booster(x, y, fold != 1, 2, 1.0, None, leaves=5, rows=3)
    assert max(abs(got[0, j] - want[j]) for j in np.flatnonzero(fold == 1)) < 1e-9


def test_forest_over_jobs_equals_forest_in_memory(spark, monkeypatch):
    monkeypatch.setattr(trees, "CHUNK", 3)
    points = [{"numTrees": n, "maxDepth": k} for n in (2, 5) for k in (2, None)]
    df, *_ = table(spark, n=150)
    df = models.staged(df.repartition(3), "test")
    run = lambda p: by_point(models.scores(spark, models.SPECS[2], p, df, ["x0", "x1", "x2"], "y", "fold", [0, 1]))
    near = run(points)
    assert len(near) == 4 * 100
    one = run(points[2:3])  # a point alone is what it is among others
    assert all(abs(p - near[2, k]) < 1e-12 for (_, k), p in one.items())
    monkeypatch.setattr(trees, "HELD_ROWS", 0)
    far = run(points)
    assert far.keys() == near.keys() and max(abs(far[k] - near[k]) for k in near) < 1e-9


def test_bootstraps_are_poisson_and_balanced():
    key = np.arange(200000) * 2654435761
    counts = [trees.bootstrap(key, t) for t in range(3)]
    for c in counts:
        assert abs(c.mean() - 1) < 0.01 and abs(c.var() - 1) < 0.02 and abs((c == 0).mean() - np.exp(-1)) < 0.005
    assert abs(np.corrcoef(counts[0], counts[1])[0, 1]) < 0.01
    y = (np.arange(len(key)) % 17 == 0).astype(float)
    stats = trees.forest_stats(y, counts[0], np.bincount(y.astype(int), counts[0], 2))
    assert abs(stats[:, 0].sum() - stats[:, 1].sum() / 2) < 1e-6 and abs(stats[:, 1].sum() - counts[0].sum()) < 1e-6


def test_average_precision_by_group(spark):
    df = spark.range(300).select((F.col("id") % 3).alias("a"), (F.col("id") % 7 % 2).alias("y"), (F.col("id") * 37 % 20 / 20).alias("p"))
    got = {r["a"]: r["average_precision"] for r in decision.average_precision_by(df, ["a"], "y", "p").collect()}
    assert got == {k: decision.average_precision(df.where(f"a = {k}"), "y", "p").first()[0] for k in range(3)}


def test_best_point_takes_the_first_of_equals(spark):
    rows = [("m", 0, "z", 0, 0.5), ("m", 1, "a", 0, 0.5), ("m", 2, "b", 0, 0.25)]
    got = models.best_points(spark.createDataFrame(rows, "model string, point int, params string, fold int, score double")).first()
    assert (got["point"], got["params"]) == (0, "z")


def test_one_class_is_refused(spark):
    df, *_ = table(spark, n=20)
    with pytest.raises(ValueError, match="two classes"):
        models.scores(spark, models.SPECS[1], [{"C": 1.0}], df.withColumn("y", F.lit(0)), ["x0"], "y", "fold", [0])


def test_search_of_the_whole_grid(spark, sf):
    from amberline.plans import decision_queries as q

    train = q._labelled(spark, sf).where("split = 'train'")
    found = models.cross_validate(spark, list(models.SPECS), train, q._BASE + q._EXTRA, "quality", "fold", q.FOLDS).collect()
    assert sorted((r["model"], r["point"], r["fold"]) for r in found) == sorted((s.name, i, k) for s in models.SPECS for i in range(len(s.points())) for k in range(q.FOLDS))
    assert all(0 <= r["score"] <= 1 for r in found)
    mean = lambda name: max(np.mean([r["score"] for r in found if (r["model"], r["point"]) == (name, i)]) for i in range(6) if (name, i) in {(r["model"], r["point"]) for r in found})
    assert mean("random_forest") > mean("dummy")


def test_labels_of_held_rows_are_not_read(spark):
    df, *_ = table(spark, n=90)
    points = [models.SPECS[1].points(), [{"numTrees": 3, "maxDepth": None}], POINTS[:1]]
    for spec, p in zip(models.SPECS[1:], points):
        run = lambda d: by_point(models.scores(spark, spec, p, d, ["x0", "x1"], "y", "fold", [2]))  # noqa: B023, E731
        staged = models.staged(df.coalesce(1), "test")
        assert run(staged) == run(models.staged(staged.withColumn("y", F.when(F.col("fold") == 2, 1 - F.col("y")).otherwise(F.col("y"))), "test"))


def test_runs_of_bins_give_the_splits_of_histograms():
    rng = np.random.default_rng(3)
    bins, place = rng.integers(0, 40, size=(900, 4)).astype(np.uint8), np.sort(np.r_[np.arange(30), rng.integers(0, 30, size=870)])
    stats = trees.class_counts((rng.random(900) < 0.3).astype(float), rng.integers(1, 4, size=900).astype(float))
    limits = trees.Limits(weights=(0.6, 1.7), rows=2)
    for got, want in zip(trees.run_splits(bins, place, stats, limits), trees.best_splits(trees.histograms(bins, place, 30, stats), limits)):
        got, want = (np.broadcast_to(a, (30, 4, *a.shape[2:])) for a in (got, want))
        assert np.array_equal(got, want)


def test_a_search_of_many_rows_takes_no_job_a_level(spark):
    """Before, beyond 65,536 rows each level of each round of trees was a Spark job of its own."""
    n = 70000
    df = models.staged(spark.range(n).select("id", (F.xxhash64("id") % 1000).cast("double").alias("x0"), (F.xxhash64("id", F.lit(1)) % 3 == 0).cast("int").alias("y"), (F.col("id") % 2).cast("int").alias("fold")), "test")
    points = [({"numTrees": 2, "maxDepth": None}, models.SPECS[2]), ({"stepSize": 0.1, "maxDepth": None, "maxIter": 8}, models.SPECS[3])]
    for at, (point, spec) in enumerate(points):
        spark.sparkContext.setJobGroup(f"search-{at}", "search")
        got = models.scores(spark, spec, [point], df, ["x0"], "y", "fold", [0]).agg(F.count("p"), F.min("p"), F.max("p")).first()
        assert got[0] == n // 2 and 0 <= got[1] < got[2] <= 1
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"search-{at}")) < 25
    spark.sparkContext._jsc.clearJobGroup()


def test_a_search_is_held_by_its_cells(spark, monkeypatch):
    """Before, a search of more rows than HELD_ROWS took jobs for each level of its trees, however few of its rows differed."""
    df = spark.range(6000).select("id", (F.xxhash64("id") % 12).cast("double").alias("x0"), (F.xxhash64("id", F.lit(1)) % 3).cast("double").alias("x1"), (F.col("id") % 2).cast("int").alias("fold"))
    df = models.staged(df.withColumn("y", (F.col("x0") + F.col("x1") + F.xxhash64("id", F.lit(2)) % 9 > 0).cast("int")), "test")
    points = [({"numTrees": 3, "maxDepth": None}, models.SPECS[2]), ({"stepSize": 0.1, "maxDepth": None, "maxIter": 4}, models.SPECS[3])]
    for at, (point, spec) in enumerate(points):
        found = []
        for held in (trees.HELD_ROWS, 500, 0):  # 500: more than the cells and less than the rows
            monkeypatch.setattr(trees, "HELD_ROWS", held)
            spark.sparkContext.setJobGroup(f"cells-{at}-{held}", "search")
            found.append({r["id"]: r["p"] for r in models.scores(spark, spec, [point], df, ["x0", "x1"], "y", "fold", [0]).collect()})
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"cells-{at}-500")) < 25
        assert len(found[0]) == 3000 and len(set(found[0].values())) > 9
        assert found[0] == found[1] and max(abs(p - found[2][k]) for k, p in found[0].items()) < 1e-9
        monkeypatch.undo()
    spark.sparkContext._jsc.clearJobGroup()


@pytest.mark.parametrize("d", [0, 1, 3, 7])
def test_cells_are_the_different_rows(d):
    bins = np.random.default_rng(d).integers(0, 3, size=(200, d)).astype(np.uint8) * 127
    cell, at = trees.distinct(bins)
    assert np.array_equal(cell[at], bins) and len({r.tobytes() for r in cell}) == len(cell)
    table = trees.pa.table({"cell": trees.packed_bins(bins)})
    assert np.array_equal(trees.bins_of(table, d), bins) and np.array_equal(trees.bins_of(table.to_batches()[0].slice(50, 20), d), bins[50:70])
    assert [len(a) for a in trees.distinct(bins[:0])] == [0, 0]
