"""The toxicity classifier against dense matrices, and what it may not look at."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from amberline.llm import toxicity


def grams(text):
    """Hashed n-grams of a text, one at a time."""
    chars, out = [ord(c) for c in f" {text.lower()} "], set()
    for size in toxicity.SIZES:
        for i in range(len(chars) - size + 1):
            v = 0
            for c in chars[i : i + size]:
                v = (v * 0x100000001B3 + c + 1) % 2**64
            out.add(((v ^ (v >> 32)) * 0x9E3779B97F4A7C15 % 2**64) >> (64 - toxicity.DIMENSION_BITS))
    return out


def dense(texts, y, setting, steps):
    """The same fit on a dense matrix of all features that occur."""
    ridge, least_z = setting
    sets = [grams(t) for t in texts]
    every = sorted(set().union(*sets))
    x = np.array([[f in s for f in every] for s in sets], float)
    n = np.array([(y == 0).sum(), (y == 1).sum()])
    df = np.stack([x[y == c].sum(axis=0) for c in (0, 1)])
    p = df.sum(axis=0) / n.sum()
    z = np.abs(df[1] / n[1] - df[0] / n[0]) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n[0] + 1 / n[1]))
    own = (z >= least_z) & (df.sum(axis=0) >= toxicity.LEAST_TEXTS) & (df.sum(axis=0) < n.sum())
    smooth = df + toxicity.SMOOTH
    total = smooth.sum(axis=1) + toxicity.SMOOTH * ((1 << toxicity.DIMENSION_BITS) - len(every))
    r = np.log(smooth[1] / total[1]) - np.log(smooth[0] / total[0])
    scaled, weight = (x * r)[:, own], np.where(y == 1, 0.5 / n[1], 0.5 / n[0])
    w, b = np.zeros(own.sum()), 0.0
    m, v = np.zeros(own.sum() + 1), np.zeros(own.sum() + 1)
    for step in range(1, steps + 1):
        e = weight * (1 / (1 + np.exp(-(b + scaled @ w))) - y)
        g = np.append(scaled.T @ e + ridge / len(y) * w, e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        d = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, b = w - d[:-1], b - d[-1]
    return b, dict(zip(np.array(every)[own], w * r[own]))


def made(n=60, seed=0):
    rng = random.Random(seed)
    bad, good = ["vile", "rotten", "Scum"], ["garden", "Été", "window", "river \U0001f600"]
    y = np.array([k % 3 == 0 for k in range(n)], int)
    return [" ".join(rng.choices(good, k=6) + (rng.choices(bad, k=2) if t else [])) + f" {k}" for k, t in enumerate(y)], y


@pytest.mark.parametrize("setting", [(3.0, 3.0), (0.3, 5.0)])
def test_fit_and_scores_against_dense_matrices(setting):
    texts, y = made()
    assert all(set(toxicity.features(t).tolist()) == grams(t) for t in [*texts, "", "a"])
    b, weights = dense(texts, y, setting, toxicity.STEPS)
    bias, at, w = toxicity.fit([toxicity.features(t) for t in texts], y, setting)
    assert sorted(weights) == at.tolist() and len(at) > 5
    assert abs(bias - b) < 1e-6 and max(abs(weights[f] - v) for f, v in zip(at.tolist(), w)) < 1e-6
    table = np.zeros(1 << toxicity.DIMENSION_BITS)
    table[at] = w
    asked = [*texts, "", "vile", "another river, rotten" * 50]
    got = toxicity.scores(asked, bias, table, table != 0)
    want = [1 / (1 + np.exp(-(b + sum(weights.get(f, 0.0) for f in grams(t))))) for t in asked]
    assert np.abs(got - want).max() < 1e-6


def test_settings_have_the_least_loss_of_the_inner_folds():
    texts, y = made(90, 1)
    rows = [toxicity.features(t) for t in texts]
    fold = np.array([zlib.crc32(r.tobytes()) % toxicity.FOLDS for r in rows])
    lost = {}
    for setting in toxicity.SETTINGS:
        lost[setting] = 0.0
        for k in range(toxicity.FOLDS):
            b, weights = dense([t for t, f in zip(texts, fold) if f != k], y[fold != k], setting, toxicity.TRIAL_STEPS)
            own = {c: [np.log1p(np.exp((1 - 2 * c) * (b + sum(weights.get(f, 0.0) for f in grams(t))))) for t, f, v in zip(texts, fold, y) if f == k and v == c] for c in (0, 1)}
            lost[setting] += sum(np.mean(v) for v in own.values() if v)
    best = toxicity.choose(rows, y)
    assert lost[best] <= min(lost.values()) + 1e-6


def test_held_out_labels_change_nothing(spark):
    texts, y = made(150, 2)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = [zlib.crc32(str(k).encode()) % 3 == 1 for k in range(150)]
    run = lambda marks: [tuple(r) for r in toxicity.scored(spark, docs, spark.createDataFrame(list(enumerate(marks)), "doc_id long, toxic int")).orderBy("doc_id").collect()]
    one = run([int(v) for v in y])
    assert one == run([int(1 - v) if h else int(v) for v, h in zip(y, held)]) and [r[1] for r in one] == held
    assert {r[0] for r in docs.join(spark.createDataFrame(one, "doc_id long, held_out boolean, score double, predicted int"), "doc_id").where(F.col("predicted") == 1).select("doc_id").collect()} >= {k for k in range(150) if y[k] and held[k]}
