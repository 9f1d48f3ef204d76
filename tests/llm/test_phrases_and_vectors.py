"""Collocations, the projection forest and whitening against brute force, and their odd inputs."""

import random
import re
from collections import Counter
from math import floor

import numpy as np
import pytest
from pyspark.sql import functions as F

from amberline.llm import collocations, rp_forest, whitening

# collocations


def brute_phrases(rows, max_n, least, top, inside=50):
    f, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, max_n + 1):
                for i in range(len(w) - k + 1):
                    f.setdefault(lang, Counter())[tuple(w[i : i + k])] += 1
    out = []
    for lang, own in f.items():
        cand = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cand.items()):
                continue
            score, k = min((10**6 * a * a // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), a, own[p[:k]], own[p[k:]]))
        for rank, (score, _, phrase, a, l, r) in enumerate(sorted(kept)[:top], 1):  # noqa: E741
            out.append((lang, rank, phrase.decode(), a, l, r, n[lang], -score))
    return sorted(out)


def found(spark, rows, **more):
    df = spark.createDataFrame([(t, l, "x", 1, "y") for t, l in rows], "text string, lang string, phrase string, f int, w string")
    got = collocations.collocations(spark, df, **more)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("max_n,least,top", [(3, 10, 2000), (2, 3, 5), (5, 4, 40)])
def test_collocations_against_brute_force(spark, monkeypatch, max_n, least, top):
    rng = random.Random(max_n)
    words = ["New", "york", "the", "é", "É", "a-b", "a\x00b", "zz", " ", "İ"]
    rows = [(rng.choice([*[" "] * 6, "", ". ", "\t", "\r\n"]).join(rng.choices(words, k=rng.randint(0, 12))), rng.choice(["en", "de", None, ""])) for _ in range(900)]
    rows += [(", ".join(["new  York\tcity hall", "York city"] * 30), "en"), (None, "en"), ("", None), ("...", "de"), ("to be or not to be " * 3000, "en")] * 2
    monkeypatch.setattr(collocations, "PARTS", 3)
    want = brute_phrases(rows, max_n, least, top)
    assert len(want) > 10 and found(spark, rows, max_n=max_n, least=least, top=top) == want


def test_collocations_of_nothing(spark):
    assert found(spark, []) == [] and found(spark, [(None, None), ("one two", "en")]) == []


def test_scores_are_exact_beyond_64_bits(spark):
    rows = [(a, l, r) for a in (10, 3 * 10**9 + 7, 10**14 + 1) for l in (a, a + 1, 7 * a) for r in (a, 2 * a + 3)]  # noqa: E741
    df = spark.createDataFrame(rows, "a long, l long, r long")
    got = df.withColumn("score", collocations.score_of(F.col("a"), F.col("l"), F.col("r"))).collect()
    assert [r["score"] for r in got] == [10**6 * a * a // (l * r) for a, l, r in rows]


# projection forest


def brute_links(rows, least):
    """Links and least reachable id of each row, by all pairs."""
    ok = [v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    n, label = len(rows), list(range(len(rows)))
    links = [0] * n
    unit = [np.array(v, float) / np.linalg.norm(v) if o else None for (_, v), o in zip(rows, ok)]

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least:
                links[i] += 1
                links[j] += 1
                label[root(i)] = root(j)
    ids = {}
    for k in range(n):
        ids.setdefault(root(k), []).append(rows[k][0])
    low = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return sorted(((rows[k][0], links[k], low[root(k)], rows[k][0] == low[root(k)]) for k in range(n)), key=str)


def clouds(seed, n, d, groups):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    for k, size in enumerate(groups):
        at = rng.choice(n, size, replace=False)
        x[at] = x[at[0]] + rng.normal(size=(size, d)) * rng.uniform(0, 0.3, size=(size, 1))
    return x.astype(np.float32)


@pytest.mark.parametrize("leaf,most", [(1024, 2048), (24, 40), (16, 16)])
def test_links_against_all_pairs(spark, monkeypatch, leaf, most):
    monkeypatch.setattr(rp_forest, "LEAF", leaf)
    monkeypatch.setattr(rp_forest, "MOST", most)
    monkeypatch.setattr(rp_forest, "ROUNDS", 2)
    x = clouds(leaf, 500, 16, [120, 60, 20, 3, 2])
    rows = [(int(k), [float(v) for v in row]) for k, row in enumerate(x)]
    rows += [(1000 + k, rows[7][1]) for k in range(90)] + [(2000, [2 * v for v in rows[7][1]]), (3, rows[9][1]), (3, rows[9][1]), (None, rows[7][1]), (None, rows[11][1])]
    rows += [(3000, None), (3001, [0.0] * 16), (3002, [float("nan")] * 16), (3003, [None] * 16), (3004, []), (3005, [1.0]), (3006, [2.0]), (None, None), (3001, [0.0] * 16)]
    df = spark.createDataFrame([(i, v, "a", "b", "c") for i, v in rows], "vec_id long, embedding array<float>, node string, v string, label string")
    got = rp_forest.linked(spark, df)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_links(rows, 0.9)
    assert rp_forest.linked(spark, df.limit(0)).count() == 0


def test_pairs_at_the_threshold_meet_in_some_tree():
    """Pairs of cosine 0.9 alone, the hardest ones, at a depth of nine levels: the share that no tree keeps together."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = rng.normal(size=x.shape)
    y -= (y * x).sum(axis=1)[:, None] * x
    y = 0.9 * x + np.sqrt(1 - 0.81) * y / np.linalg.norm(y, axis=1)[:, None]
    both, band, met = np.concatenate([x, y]), rp_forest.margin(0.9, 64), np.zeros(len(x), bool)
    for tree in range(rp_forest.TREES):
        p = both @ rp_forest.directions(tree, 0, 64)
        who, leaf = rp_forest.walked(p, np.repeat(rp_forest.cuts_of(p, 10**9, band)[None], len(p), axis=0), np.ones(len(p), np.int64), band)
        places = [set() for _ in both]
        for w, at in zip(who, leaf):
            places[w].add(int(at))
        assert max(map(len, places)) > 1 and len(set().union(*places)) > 60
        met |= [bool(places[k] & places[k + len(x)]) for k in range(len(x))]
    assert met.mean() > 0.99


# whitening


def brute_whitened(vectors, most):
    x = np.array([[floor(1024 * c) + 100000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(axis=0)
    deviation = [int(v) for v in ((n * x - s) ** 2).sum(axis=1)]
    centred = (n * x - s).astype(float) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:most]
    return deviation, centred @ axes[:, order] / np.sqrt(values[order]), values[order] / values.sum()


@pytest.mark.parametrize("n,d", [(300, 12), (64, 7), (40, 1)])
def test_whitening_against_a_library(spark, n, d):
    rng = np.random.default_rng(d)
    x = (rng.normal(size=(n, d)) @ np.diag(10.0 ** -np.arange(d).clip(0, 3)) + rng.normal(size=d)).astype(np.float32)
    df = spark.createDataFrame([(k, [float(c) for c in v], "a", 1, 2) for k, v in enumerate(x)], "vec_id long, embedding array<float>, x string, w int, d int")
    bad = spark.createDataFrame([(900, None, "a", 1, 2), (901, [None] * d, "a", 1, 2), (902, [float("inf")] * d, "a", 1, 2), (903, [1.0] * (d + 1), "a", 1, 2)], df.schema)
    got = whitening.whitened(spark, df.union(bad).repartition(5)).collect()
    deviation, w, explained = brute_whitened(x.astype(float).tolist(), 8)
    assert sorted((r["vec_id"], r["component"]) for r in got) == [(k, c + 1) for k in range(n) for c in range(min(8, d))]
    own = np.zeros_like(w)
    for r in got:
        assert r["n"] == n and int(r["deviation"]) == deviation[r["vec_id"]] and r["identity_error"] < 1e-9
        assert abs(r["explained"] - explained[r["component"] - 1]) <= 1e-9 * explained[r["component"] - 1]
        own[r["vec_id"], r["component"] - 1] = r["whitened"]
    sign = np.sign((own * w).sum(axis=0))
    assert np.abs(own - sign * w).max() < 1e-6


def test_whitening_odd_rows(spark):
    schema = "vec_id long, embedding array<double>"
    make = lambda rows: sorted(map(tuple, whitening.whitened(spark, spark.createDataFrame(rows, schema)).select("vec_id", "component", "n", F.col("deviation").cast("string"), "whitened", "explained", "identity_error").collect()), key=str)
    assert make([]) == [] and make([(1, None), (2, [])]) == []
    assert make([(None, [0.0, 0.0]), (1, [0.0, 0.0])]) == sorted([(i, c, 2, "0", 0.0, 0.0, 0.0) for i in (None, 1) for c in (1, 2)], key=str)
    two = make([(1, [1.0, 5.0]), (1, [3.0, 5.0])])
    assert [(r[1], r[2], r[3], round(abs(r[4]), 9), r[5]) for r in two] == [(1, 2, str(2048**2), 1.0, 1.0)] * 2 + [(2, 2, str(2048**2), 0.0, 0.0)] * 2
    large = make([(k, [1e300 * (-1) ** k, 0.5 * k]) for k in range(4)])
    assert len(large) == 8 and all(int(r[3]) >= (4 * 2**50) ** 2 and np.isfinite(r[4]) for r in large)


@pytest.mark.parametrize("d", [1, 2, 5, 8, 33])
def test_jacobi(d):
    rng = np.random.default_rng(d)
    scale = 10.0 ** -np.linspace(0, 6, d)
    m = rng.normal(size=(200, d)) * scale
    a = m.T @ m
    values, axes = whitening.jacobi(a)
    assert (np.diff(values) <= 0).all() and np.abs(axes.T @ axes - np.eye(d)).max() < 1e-13
    assert np.abs(a @ axes - axes * values).max() < 1e-12 * values[0]
    exact = np.linalg.svd(m, compute_uv=False) ** 2
    assert np.abs(values / exact - 1).max() < 1e-9  # small ones as well
    assert (whitening.jacobi(np.zeros((d, d)))[0] == 0).all()
