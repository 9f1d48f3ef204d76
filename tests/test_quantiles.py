"""Radix selection against sorted lists."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from amberline.operators import quantiles


def test_keys_keep_the_order():
    v = np.array([-np.inf, -1e300, -1.5, -1e-310, -0.0, 0.0, 5e-324, 1.0, 1.0000000000000002, 1e308, np.inf, np.nan])
    k = quantiles.keys(v)
    assert k[4] == k[5] and all(a < b for a, b in zip(k[:4], k[1:5])) and all(a < b for a, b in zip(k[5:], k[6:]))
    back = [quantiles.value(int(x)) for x in k]
    assert all(a == b for a, b in zip(back[:-1], v[:-1])) and math.isnan(back[-1])


def linear(values, q):
    s = sorted(values)
    at = (len(s) - 1) * q
    low, high = s[math.floor(at)], s[math.ceil(at)]
    return low + (high - low) * (at - math.floor(at))


@pytest.mark.parametrize("parts", [1, 5])
def test_quantiles_of_many_columns(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.gauss(0, 1), rng.choice([None, 1.5, -2.0]), rng.randint(-(10**6), 10**6), None, 10.0 ** rng.randint(-300, 300) * rng.choice([-1, 1]), 7.0) for _ in range(997)]
    df = spark.createDataFrame(rows, "a double, b double, c long, d double, e double, f double").repartition(parts)
    shares = [0.0, 0.1, 0.25, 0.5, 0.99, 1.0]
    got = quantiles.quantiles(df, list("abcdef"), shares)
    for i, c in enumerate("abcdef"):
        own = [float(r[i]) for r in rows if r[i] is not None]
        for q, v in zip(shares, got[c]):
            assert v is None if not own else math.isclose(v, linear(own, q), rel_tol=1e-12, abs_tol=1e-300)
    assert quantiles.quantiles(df.limit(0), ["a"], [0.5]) == {"a": [None]}
    assert quantiles.quantiles(df.select(F.lit(3).alias("x")).limit(1), ["x"], [0.5]) == {"x": [3.0]}
