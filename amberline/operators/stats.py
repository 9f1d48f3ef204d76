"""Rates, intervals, tests and distributions as aggregates."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amberline.functions.text import erfc
from amberline.operators.quantiles import quantiles
from amberline.operators.staging import running


def wilson(successes: Column, trials: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of a share; without trials both are 0."""
    n, p = trials.cast("double"), F.try_divide(successes.cast("double"), trials.cast("double"))
    z2 = F.lit(z * z)
    middle, spread = p + z2 / (2 * n), z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    clamp = lambda c: F.coalesce(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    some = trials > 0
    low, high = F.try_divide(middle - spread, 1 + z2 / n), F.try_divide(middle + spread, 1 + z2 / n)
    return F.when(some, clamp(low)).otherwise(0.0), F.when(some, clamp(high)).otherwise(0.0)


def response_by_segment(df: DataFrame, segment: str, target: str) -> DataFrame:
    """Count, responders, rate and its Wilson interval per segment; rows without a segment are left out."""
    own = df.where(F.col(segment).isNotNull()).groupBy(F.col(segment).cast("string").alias("segment"))
    own = own.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(target).cast("long")).alias("responders"))
    # bounds of a group that exists: trials are never 0 here, nullif keeps the plan free of division errors
    low, high = wilson(F.col("responders"), F.nullif(F.col("n"), F.lit(0)))
    return own.select("segment", "n", "responders", F.round(F.col("responders") / F.col("n"), 6).alias("rate"), F.round(low, 6).alias("ci_low"), F.round(high, 6).alias("ci_high"))


def target_rate(df: DataFrame, target: str) -> DataFrame:
    rate = F.avg(F.col(target).cast("double"))
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(target).cast("long")).alias("positives"), F.round(rate, 6).alias("rate"), F.round(F.try_divide(1 - rate, rate), 6).alias("negatives_per_positive"))


def describe(df: DataFrame, column: str) -> DataFrame:
    """Exact quantiles (linear between ranks) and the sample deviation."""
    q = [F.lit(v).cast("double") for v in quantiles(df, [column], [0.25, 0.5, 0.75])[column]]
    out = df.agg(F.count(column).alias("n"), F.min(column).alias("min"), F.max(column).alias("max"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"))
    r = lambda c, name: F.round(c, 4).alias(name)
    return out.select("n", r(F.col("min"), "min"), r(q[0], "q25"), r(q[1], "median"), r(q[2], "q75"), r(F.col("max"), "max"), r(F.col("mean"), "mean"), r(F.col("std"), "std"))


def ranked_quantiles(df: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """``share, value``: exact quantiles, linear between ranks, by a distributed order of the distinct values.

    ``percentile`` holds all distinct values of a column in one task; this holds none, at the price of a range shuffle.
    """
    values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ranked = running(values, [F.asc("v")], {"upto": F.col("n")})
    total = ranked.agg(F.max("upto").alias("total"))
    at = ranked.join(F.broadcast(total))  # one row
    place = lambda q: (F.col("total") - 1) * F.lit(q)
    ends = [x for i, q in enumerate(shares) for x in (F.min(F.when(F.col("upto") > F.floor(place(q)), F.col("v"))).alias(f"a{i}"), F.min(F.when(F.col("upto") > F.ceil(place(q)), F.col("v"))).alias(f"b{i}"))]
    out = at.agg(F.max("total").alias("total"), *ends)
    rows = [F.struct(F.lit(q).alias("share"), (F.col(f"a{i}") + (F.col(f"b{i}") - F.col(f"a{i}")) * (place(q) - F.floor(place(q)))).alias("value")) for i, q in enumerate(shares)]
    return out.select(F.inline(F.array(*rows)))


def modes(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The k most frequent values, ties to the smaller value."""
    n = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(column).alias("total"))
    top = n.orderBy(F.desc("n"), "value").limit(k)
    return top.join(F.broadcast(total)).select("value", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))  # one row


def histogram(df: DataFrame, column: str, width: float) -> DataFrame:
    """Counts in bins of one width, named by their lower edge."""
    return df.where(F.col(column).isNotNull()).groupBy((F.floor(F.col(column) / width) * width).cast("double").alias("bin_low")).agg(F.count(F.lit(1)).alias("n"))


def edge_histogram(df: DataFrame, column: str, low: float, high: float, bins: int, log: bool = False) -> DataFrame:
    """Counts in equal bins of [low, high], the last edge included; with ``log`` bins are equal in log10 and values <= 0 are bin -1."""
    v = F.log10(F.when(F.col(column) > 0, F.col(column))) if log else F.col(column)
    number = F.least(F.floor((v - low) / ((high - low) / bins)), F.lit(bins - 1))
    place = F.when(F.col(column) <= 0, -1).when((v < low) | (v > high), None).otherwise(number) if log else F.when((v < low) | (v > high), None).otherwise(number)
    return df.select(place.cast("long").alias("bin")).where("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def missing_against_target(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """Per column: response with the value missing and present, their ratio, and Yates's chi-square with one degree of freedom."""
    y = F.col(target).cast("long")
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).isNull().alias("missing")) for c in columns))
    count = lambda cond: F.sum(cond.cast("long"))
    m = F.col("missing")
    t = df.select(y.alias("y"), F.inline(rows)).groupBy("column").agg(
        count(m & (F.col("y") == 1)).alias("a"), count(m & (F.col("y") == 0)).alias("b"), count(~m & (F.col("y") == 1)).alias("c"), count(~m & (F.col("y") == 0)).alias("d")
    )
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    gap = F.greatest(F.abs(a * d - b * c) - (a + b + c + d) / 2, F.lit(0.0))
    t = t.withColumn("chi2", F.try_divide((a + b + c + d) * gap * gap, (a + b) * (c + d) * (a + c) * (b + d)))
    rate_m, rate_p = F.try_divide(a, a + b), F.try_divide(c, c + d)
    return t.select(
        "column", (F.col("a") + F.col("b")).alias("n_missing"), F.round(rate_m, 6).alias("rate_missing"), F.round(rate_p, 6).alias("rate_present"),
        F.round(100 * (rate_m - rate_p), 4).alias("diff_pp"), F.round(F.try_divide(rate_m, rate_p), 6).alias("ratio"), F.round("chi2", 4).alias("chi2"), F.round(erfc(F.sqrt(F.col("chi2") / 2)), 5).alias("p_value"),
    )


def skew_g1(column: str) -> Column:
    """Bias-corrected skewness."""
    n = F.count(column).cast("double")
    return F.when(n > 2, F.skewness(column) * F.sqrt(n * (n - 1)) / (n - 2))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson r of each pair over the rows that have both, in one aggregate."""
    pairs = list(combinations(columns, 2))
    both = lambda a, b: F.corr(F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b)))
    out = df.agg(*(both(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)))
    return out.select(F.inline(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(f"r{i}", 6).alias("r")) for i, (a, b) in enumerate(pairs)))))
