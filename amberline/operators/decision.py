"""From scores to decisions: revenue curves, thresholds, calibration, precision-recall, slices.

Money is summed in whole cents, so that running sums are exact in any order of partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from amberline.operators.quantiles import quantiles
from amberline.operators.staging import running

#: Cost of one contact, in cents.
COST = 68
LEAST_SLICE = 100


def cents(c: Column) -> Column:
    return F.round(F.coalesce(c, F.lit(0.0)) * 100).cast("long")


def money(c: Column) -> Column:
    return (c / 100.0).cast("double")


def revenue_curve(df: DataFrame, target: str, amount: str, score: str, key: str) -> DataFrame:
    """Per number of contacts, best scores first (ties by ``key``): threshold, net revenue, precision, recall."""
    own = df.select(F.col(key).alias("key"), F.col(target).cast("long").alias("y"), cents(F.col(amount)).alias("c"), F.col(score).alias("threshold"))
    total = own.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("all_y"))
    ordered = running(own, [F.desc("threshold"), F.asc("key")], {"sum_c": F.col("c"), "sum_y": F.col("y")}, "contacts")
    out = ordered.join(F.broadcast(total))  # one row
    return out.select(
        "contacts", F.round(F.col("contacts") / F.col("n"), 6).alias("fraction"), "threshold", money(F.col("sum_c") - COST * F.col("contacts")).alias("net_revenue"),
        F.round(F.col("sum_y") / F.col("contacts"), 6).alias("precision"), F.round(F.try_divide("sum_y", "all_y"), 6).alias("recall"),
    )


def metrics_at(df: DataFrame, target: str, amount: str, score: str, threshold: Column) -> DataFrame:
    """Contacts at or above a threshold; precision is null without contacts, recall without responders."""
    hit = F.col(score) >= threshold
    y = F.col(target).cast("long")
    out = df.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(hit.cast("long")), F.lit(0)).alias("contacts"), F.coalesce(F.sum(F.when(hit, cents(F.col(amount)) - COST)), F.lit(0)).alias("net"),
        F.coalesce(F.sum(F.when(hit, y)), F.lit(0)).alias("found"), F.sum(y).alias("responders"),
    )
    return out.select(
        "contacts", F.round(F.try_divide("contacts", "n"), 6).alias("fraction"), money(F.col("net")).alias("net_revenue"),
        F.round(F.try_divide("found", "contacts"), 6).alias("precision"), F.round(F.try_divide("found", "responders"), 6).alias("recall"),
    )


def net_revenue(df: DataFrame, amount: str, contacted: Column) -> DataFrame:
    return df.agg(money(F.coalesce(F.sum(F.when(contacted, cents(F.col(amount)) - COST)), F.lit(0))).alias("net_revenue"))


def curve_peak(curve: DataFrame) -> DataFrame:
    """The first best point of a curve."""
    return curve.orderBy(F.desc("net_revenue"), "contacts").limit(1).select("contacts", "threshold", "net_revenue")


def choose_threshold(df: DataFrame, target: str, amount: str, score: str, key: str) -> DataFrame:
    """The score at the first peak of the curve, and the metrics of contacting all that tie with it."""
    peak = curve_peak(revenue_curve(df, target, amount, score, key)).select(F.col("threshold"))
    joined = df.join(F.broadcast(peak))  # one row
    at = metrics_at(joined, target, amount, score, F.col("threshold"))
    return at.join(F.broadcast(peak)).select("threshold", *at.columns)


def by_score(df: DataFrame, target: str, score: str) -> DataFrame:
    """Rows and responders per distinct score."""
    return df.groupBy(F.col(score).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(target).cast("long")).alias("y"))


def average_precision(df: DataFrame, target: str, score: str) -> DataFrame:
    """Sum over distinct scores of the step in recall times the precision there."""
    steps = running(by_score(df, target, score), [F.desc("s")], {"cn": F.col("n"), "cy": F.col("y")})
    total = F.sum("y")
    return steps.agg(F.round(F.try_divide(F.sum(F.col("y") * F.col("cy") / F.col("cn")), total), 6).alias("average_precision"))


def average_precision_by(df: DataFrame, by: list[str], target: str, score: str) -> DataFrame:
    """The same for each group: one global order of (group, score), from whose running sums those of earlier groups are taken."""
    steps = df.groupBy(*by, F.col(score).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(target).cast("long")).alias("y"))
    steps = running(steps, [*(F.asc(c) for c in by), F.desc("s")], {"cn": F.col("n"), "cy": F.col("y")})
    before = steps.groupBy(*by).agg(F.min(F.col("cn") - F.col("n")).alias("bn"), F.min(F.col("cy") - F.col("y")).alias("by"))
    own = steps.join(F.broadcast(before), by).groupBy(*by)  # one row a group
    return own.agg(F.round(F.try_divide(F.sum(F.col("y") * (F.col("cy") - F.col("by")) / (F.col("cn") - F.col("bn"))), F.sum("y")), 6).alias("average_precision"))


def calibration(df: DataFrame, target: str, score: str, bins: int = 10) -> DataFrame:
    """Mean score and observed rate in quantile bins; equal edges are one, a score on an edge belongs to the bin below."""
    cuts = quantiles(df, [score], [i / bins for i in range(bins + 1)])[score]
    inner = sorted({c for c in cuts if c is not None})[1:-1]
    number = F.size(F.filter(F.array(*map(F.lit, inner)).cast("array<double>"), lambda e: e < F.col(score)))
    own = df.select(number.alias("bin"), F.col(score).alias("p"), F.col(target).cast("double").alias("y"))
    return own.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 6).alias("mean_score"), F.round(F.avg("y"), 6).alias("observed"))


def slices(df: DataFrame, attributes: dict[str, Column], target: str, score: str, threshold: float) -> DataFrame:
    """Rows, responders, contact rate, recall (null without responders) and response rate per segment of each attribute.

    Every row is in one segment of each attribute, null as "(missing)".
    """
    rows = F.array(*(F.struct(F.lit(a).alias("attribute"), F.coalesce(c.cast("string"), F.lit("(missing)")).alias("segment")) for a, c in attributes.items()))
    hit, y = (F.col(score) >= threshold).cast("long"), F.col(target).cast("long")
    own = df.select(hit.alias("hit"), y.alias("y"), F.inline(rows)).groupBy("attribute", "segment")
    out = own.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("responders"), F.sum("hit").alias("h"), F.sum(F.col("hit") * F.col("y")).alias("found"))
    return out.select("attribute", "segment", "n", "responders", F.round(F.col("h") / F.col("n"), 6).alias("contact_rate"), F.round(F.try_divide("found", "responders"), 6).alias("recall"), F.round(F.col("responders") / F.col("n"), 6).alias("response_rate"))


def contact_gap(found: DataFrame, least: int = LEAST_SLICE) -> DataFrame:
    """Largest less smallest contact rate among segments of at least ``least`` rows, where there are two or more."""
    own = found.where(F.col("n") >= least).groupBy("attribute").agg(
        F.count(F.lit(1)).alias("segments"), F.max(F.struct("contact_rate", "segment")).alias("hi"), F.min(F.struct("contact_rate", "segment")).alias("lo")
    )
    return own.where("segments > 1").select("attribute", F.round(F.col("hi.contact_rate") - F.col("lo.contact_rate"), 6).alias("gap"), F.col("hi.segment").alias("highest"), F.col("lo.segment").alias("lowest"))


def fold_summary(scores: DataFrame) -> DataFrame:
    """Mean, population deviation and rank of models over folds; ``scores`` has model, fold, score."""
    own = scores.groupBy("model").agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s"))
    rank = F.rank().over(W.partitionBy(F.lit(0)).orderBy(F.desc("m")))  # one row a model
    return own.select("model", F.round("m", 6).alias("mean_score"), F.round("s", 6).alias("sd_score"), rank.alias("rank"))
