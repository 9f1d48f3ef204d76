"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text is lower-cased and framed by blanks; its features are the hashed character n-grams that
occur in it, once each. For a feature with df_1 toxic and df_0 other training texts, the naive Bayes
log-count ratio is r = ln((df_1 + a) / sum(df_1 + a)) - ln((df_0 + a) / sum(df_0 + a)). A logistic
regression is fitted to the features multiplied by their r. Training takes at most ROWS_A_CLASS
labelled rows of each class, those with the least hash of doc_id: a documented bound on the fit, not
on what is scored.

Two settings are chosen on the training rows alone: the ridge, and by how many standard errors a feature's
shares in the two classes must differ. Each pair of ``SETTINGS`` is fitted on two of three inner folds and judged by
the log loss on the third, both classes counting alike; the pair with the least sum wins, the first of equals, and is
then fitted on all training rows. Texts with equal features share an inner fold. Sizes of n-grams and the
threshold are fixed beforehand.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amberline.llm.common import slices, text_or_empty

SIZES = (3, 4, 5)
DIMENSION_BITS = 20
ROWS_A_CLASS = 2000
FEATURES = 8192
#: Ridge, and least standard errors between a feature's shares in the two classes, that the inner folds choose from.
SETTINGS = tuple((ridge, z) for z in (8.0, 5.0, 3.0) for ridge in (30.0, 3.0, 0.3))
FOLDS, TRIAL_STEPS = 3, 120
LEAST_TEXTS, SMOOTH, STEPS = 4, 1.0, 400
THRESHOLD = 0.7


def hashed(chars: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each n-gram size, the feature number at every start in a run of code points."""
    value = np.zeros(len(chars), np.uint64)
    step = np.uint64(0x100000001B3)
    done = 0
    for size in SIZES:
        while done < size:
            value = value[: len(chars) - done] * step + chars[done:].astype(np.uint64) + np.uint64(1)
            done += 1
        if not len(value):
            return
        yield size, ((value ^ (value >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - DIMENSION_BITS)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of framed texts in one run, and where each begins, with the end as last."""
    framed = [f" {t.lower()} " for t in texts]
    chars = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), np.uint32)
    return chars, np.cumsum([0, *map(len, framed)])


def features(text: str) -> np.ndarray:
    chars, _ = code_points([text])
    return np.unique(np.concatenate([f for _, f in hashed(chars)] or [np.zeros(0, np.uint64)])).astype(np.uint32)


def log_loss(rows: list[np.ndarray], labels: np.ndarray, model: tuple[float, np.ndarray, np.ndarray]) -> float:
    """Mean loss of a class, summed over both; a class without rows adds nothing."""
    bias, at, weights = model
    table = np.zeros(1 << DIMENSION_BITS)
    table[at] = weights
    margin = np.array([bias + table[x].sum() for x in rows])
    loss = np.logaddexp(0.0, np.where(labels == 1, -margin, margin))
    return float(sum(loss[labels == c].mean() for c in (0, 1) if (labels == c).any()))


def choose(rows: list[np.ndarray], labels: np.ndarray) -> tuple[float, float]:
    """The pair of ``SETTINGS`` with the least loss over the inner folds."""
    fold = np.array([zlib.crc32(x.tobytes()) % FOLDS for x in rows], dtype=np.int64)
    lost = [0.0] * len(SETTINGS)
    for k in range(FOLDS):
        own, other = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if not len(own) or not len(other):
            continue
        for i, setting in enumerate(SETTINGS):
            model = fit([rows[j] for j in own], labels[own], setting, TRIAL_STEPS)
            lost[i] += log_loss([rows[j] for j in other], labels[other], model)
    return SETTINGS[int(np.argmin(lost))]


def fit(rows: list[np.ndarray], labels: np.ndarray, setting: tuple[float, float], steps: int = STEPS) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, feature numbers and their weights. Rows with equal features and label count once. With one class only, there are no weights."""
    ridge, least_z = setting
    once = {(r.tobytes(), int(y)): k for k, (r, y) in reversed(list(enumerate(zip(rows, labels))))}
    keep = sorted(once.values())
    rows, labels = [rows[k] for k in keep], labels[keep]
    n = np.array([(labels == 0).sum(), (labels == 1).sum()])
    prior = (n[1] + 1.0) / (n.sum() + 2.0)
    if not n.all():
        return float(np.log(prior / (1 - prior))), np.zeros(0, np.int64), np.zeros(0)
    df = [np.bincount(np.concatenate([r for r, y in zip(rows, labels) if y == c]), minlength=1 << DIMENSION_BITS) for c in (0, 1)]
    total = df[0] + df[1]
    p = total / n.sum()
    z = np.abs(df[1] / n[1] - df[0] / n[0]) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n[1] + 1 / n[0]))
    z[(total < LEAST_TEXTS) | (total == n.sum())] = 0
    chosen = np.sort(np.argsort(-z, kind="stable")[:FEATURES])
    chosen = chosen[z[chosen] >= least_z]
    ratio = [np.log((d[chosen] + SMOOTH) / (d + SMOOTH).sum()) for d in df]
    r = ratio[1] - ratio[0]
    place = np.full(1 << DIMENSION_BITS, -1, np.int64)
    place[chosen] = np.arange(len(chosen))
    inside = [place[x] for x in rows]
    inside = [x[x >= 0] for x in inside]
    column = np.concatenate(inside) if inside else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(rows)), [len(x) for x in inside])
    value, y = r[column], labels.astype(float)
    weight = np.where(y == 1, 0.5 / n[1], 0.5 / n[0])  # both classes count alike
    w, b = np.zeros(len(chosen)), 0.0
    m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for step in range(1, steps + 1):
        margin = b + np.bincount(row, value * w[column], minlength=len(rows))
        error = weight * (1 / (1 + np.exp(-np.clip(margin, -50, 50))) - y)
        slope = np.append(np.bincount(column, value * error[row], minlength=len(w)) + ridge / len(rows) * w, error.sum())
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return float(b), chosen, w * r


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> tuple[float, np.ndarray, np.ndarray]:
    """Fit on the labelled rows of ``docs``. ``labels`` holds doc_id and toxic; unlabelled and null rows are left out."""
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("_y"))
    chosen = [marks.where(F.col("_y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(ROWS_A_CLASS) for y in (0, 1)]
    picked = F.broadcast(chosen[0].union(chosen[1]).withColumnRenamed("doc_id", "_id"))  # at most 2 * ROWS_A_CLASS rows
    texts = docs.select("doc_id", text_or_empty().alias("_text")).join(picked, F.col("doc_id") == F.col("_id")).select("doc_id", "_y", "_text")

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", 2 << 20):
            made = [features(t).tobytes() for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_y"), pa.array(made, pa.binary())], names=["doc_id", "y", "features"])

    def fit_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[np.ndarray] = []
        y: list[int] = []
        for batch in batches:
            rows += [np.frombuffer(b, np.uint32) for b in batch.column("features").to_pylist()]
            y += batch.column("y").to_pylist()
        labels = np.array(y, dtype=np.int64)
        bias, at, weights = fit(rows, labels, choose(rows, labels))
        yield pa.RecordBatch.from_arrays([pa.array([bias]), pa.array([at.astype("<i8").tobytes()], pa.binary()), pa.array([weights.astype("<f8").tobytes()], pa.binary())], names=["bias", "at", "weights"])

    few = texts.mapInArrow(reduce, "doc_id long, y int, features binary").repartition(1).sortWithinPartitions("doc_id", "y", "features")
    model = few.mapInArrow(fit_all, "bias double, at binary, weights binary").first()
    if model is None:  # no labelled rows, so no task to fit on
        return fit([], np.zeros(0, np.int64), SETTINGS[0])
    return model["bias"], np.frombuffer(model["at"], "<i8"), np.frombuffer(model["weights"], "<f8")


def scores(texts: list[str], bias: float, table: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Probability of the toxic class; ``table`` holds the weight of every feature number, ``used`` where it is not zero."""
    chars, starts = code_points(texts)
    total = np.full(len(texts), bias)
    seen: list[np.ndarray] = []
    for size, feature in hashed(chars):
        hit = np.flatnonzero(used[feature])
        doc = np.searchsorted(starts, hit, side="right") - 1
        inside = hit + size <= starts[doc + 1]
        seen.append((doc[inside].astype(np.int64) << DIMENSION_BITS) | feature[hit[inside]].astype(np.int64))
    pair = np.unique(np.concatenate(seen)) if seen else np.zeros(0, np.int64)
    total += np.bincount(pair >> DIMENSION_BITS, table[pair & ((1 << DIMENSION_BITS) - 1)], minlength=len(texts))
    return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def scored(spark: SparkSession, docs: DataFrame, labels: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns, ``held_out``, ``score`` and ``predicted`` of each row of ``docs``.

    Null and empty texts get the score of a text without features. Rows with a null doc_id are
    scored and are not held out. Without labels of both classes all scores are the smoothed share
    of toxic labels. Extra columns are ignored; an empty table gives no rows.
    """
    carry = carry or ["doc_id"]
    held = lambda c: F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")) % 3 == 1, F.lit(False))
    bias, at, weights = train(spark, docs, labels.where(~held("doc_id")))
    model = spark.sparkContext.broadcast((bias, at, weights))  # at most FEATURES weights
    source = docs.select(*carry, held("doc_id").alias("held_out"), text_or_empty().alias("_text"))
    schema = source.drop("_text").schema.add("score", "double").add("predicted", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, at, weights = model.value
        table = np.zeros(1 << DIMENSION_BITS)
        table[at] = weights
        used = table != 0
        for batch in slices(batches, "_text", 1 << 20):
            score = scores(batch.column("_text").to_pylist(), bias, table, used)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=schema.names)

    return source.mapInArrow(run, schema)
