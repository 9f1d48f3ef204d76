"""Splits and transforms. What is fitted comes from the training rows only and is small; it is held as literals or as a table of levels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amberline.operators.quantiles import quantiles
from amberline.operators.staging import running

#: Values of a target beyond which it is a measure and not a class.
MOST_CLASSES = 1000
FORBIDDEN = ("TARGET_B", "TARGET_D", "CONTROLN")


def portable_hash(key: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")).cast("binary"))


def stratified_split(df: DataFrame, target: str, key: str, share: float = 0.2, seed: int = 2026, into: str = "test", rest: str = "train") -> DataFrame:
    """Exactly ceil(share * n) rows of ``into``, per class as the share says to within a row, the same in any partitioning.

    Rows are ranked within their class by a hash of the key (ties by key). A class gets the whole part
    of its quota; what is missing to the total goes to the largest remainders.
    """
    counts = df.groupBy(F.col(target).alias("_y")).agg(F.count(F.lit(1)).alias("_n")).limit(MOST_CLASSES + 1).collect()  # one row a class
    if len(counts) > MOST_CLASSES:
        raise ValueError(f"{target} has more than {MOST_CLASSES} values: not classes")
    if len(counts) < 2:
        raise ValueError("a stratified split needs two classes or more")
    n = sum(r["_n"] for r in counts)
    total = -int(-(n * round(share * 10**9)) // 10**9)
    quota = {r["_y"]: n_ * total // n for r in counts for n_ in [r["_n"]]}
    left = sorted(counts, key=lambda r: (-(r["_n"] * total % n), str(r["_y"])))
    for r in left[: total - sum(quota.values())]:
        quota[r["_y"]] += 1
    ranked = running(df.withColumn("_h", portable_hash(F.col(key), seed)), [F.asc(target), F.asc("_h"), F.asc(key)], {}, "_k")
    first, before = {}, 0
    for r in sorted(counts, key=lambda r: (r["_y"] is not None, r["_y"])):
        first[r["_y"]] = before
        before += r["_n"]
    test = F.lit(False)
    for y, q in quota.items():
        same = F.col(target).isNull() if y is None else F.col(target) == F.lit(y)
        test = test | (same & (F.col("_k") <= first[y] + q))
    return ranked.withColumn("split", F.when(test, into).otherwise(rest)).drop("_h", "_k")


def stratified_folds(df: DataFrame, target: str, key: str, folds: int = 5, seed: int = 2026, into: str = "fold") -> DataFrame:
    """A fold per row; within each class, rows in hash order go to the folds in turn, so that counts differ by one at most."""
    ranked = running(df.withColumn("_h", portable_hash(F.col(key), seed)), [F.asc(target), F.asc("_h"), F.asc(key)], {}, "_k")
    first = ranked.groupBy(F.col(target).alias("_y")).agg(F.min("_k").alias("_first"))
    own = ranked.join(F.broadcast(first), F.col(target).eqNullSafe(F.col("_y")))  # one row a class
    return own.withColumn(into, F.pmod(F.col("_k") - F.col("_first"), F.lit(folds)).cast("int")).drop("_h", "_k", "_y", "_first")


def non_null_count(columns: list[str]) -> Column:
    return sum((F.col(c).isNotNull().cast("int") for c in columns[1:]), F.col(columns[0]).isNotNull().cast("int"))


def response_columns(columns: list[str], pattern: str = r"RAMNT_(\d+)$") -> list[str]:
    """Columns of earlier campaigns; numbers up to 2 would leak the target."""
    import re

    found = [(int(m[1]), c) for c in columns if (m := re.match(pattern, c))]
    if any(n <= 2 for n, _ in found):
        raise ValueError("a response column of this campaign would leak the target")
    return [c for _, c in sorted(found)]


@dataclass(frozen=True)
class Medians:
    """Exact medians of the training rows; nulls of any rows are replaced by them."""

    values: dict[str, float]

    @classmethod
    def fit(cls, train: DataFrame, columns: list[str]) -> Medians:
        return cls({c: q[0] for c, q in quantiles(train, columns, [0.5]).items()})

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in self.values.items()})


@dataclass(frozen=True)
class Scaler:
    """Mean 0 and population deviation 1 over the training rows; a constant column becomes 0."""

    values: dict[str, tuple[float, float]]

    @classmethod
    def fit(cls, train: DataFrame, columns: list[str]) -> Scaler:
        row = train.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
        return cls({c: (row[f"m_{c}"], row[f"s_{c}"]) for c in columns})

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s or 1.0) for c, (m, s) in self.values.items()})


@dataclass(frozen=True)
class OneHot:
    """0/1 columns per level; levels under ``least`` training rows share one column, unseen ones fall there or nowhere."""

    column: str
    levels: tuple[str, ...]
    infrequent: bool

    @classmethod
    def fit(cls, train: DataFrame, column: str, least: int = 10, most: int = 1000) -> OneHot:
        level = F.coalesce(F.col(column).cast("string"), F.lit("missing"))
        counts = train.groupBy(level.alias("v")).agg(F.count(F.lit(1)).alias("n"))
        kept = [r["v"] for r in counts.where(F.col("n") >= least).orderBy("v").limit(most + 1).collect()]
        if len(kept) > most:
            raise ValueError(f"{column} has more than {most} frequent levels: a column each is too wide, pipeline.LevelFlags makes one sparse vector of them")
        return cls(column, tuple(kept), bool(counts.where(F.col("n") < least).limit(1).count()))

    def encode(self, shown: list[str] | None = None) -> list[Column]:
        """With ``shown``, the columns are those of these levels and the shared one, whatever levels were frequent."""
        v = F.coalesce(F.col(self.column).cast("string"), F.lit("missing"))
        out = [(v == x).cast("int").alias(f"{self.column}_{x}") for x in (self.levels if shown is None else shown)]
        shared = (~v.isin(*self.levels)).cast("int").alias(f"{self.column}_infrequent")
        return out + [shared] * (self.infrequent or shown is not None)


def frequency_table(train: DataFrame, column: str) -> DataFrame:
    """Share of each level among the training rows that have one."""
    total = train.agg(F.count(column).alias("_total"))
    n = train.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("level")).agg(F.count(F.lit(1)).alias("_n"))
    return n.join(F.broadcast(total)).select("level", (F.col("_n") / F.col("_total")).alias("share"))  # one row of totals


def frequency_encode(df: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """``share`` of each row's level; unseen and null give 0. Catalyst broadcasts the table only if it is small."""
    return df.join(table, F.col(column) == F.col("level"), "left").withColumn("share", F.coalesce("share", F.lit(0.0))).drop("level")


def ordinal(column: str, order: list[str]) -> Column:
    c = F.col(column)
    out = F.when(c == order[0], 0)
    for i, v in enumerate(order[1:], 1):
        out = out.when(c == v, i)
    return out


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """Weight n / (classes * n_class) per class."""
    own = df.groupBy(F.col(target).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = own.agg(F.sum("n").alias("_all"), F.count(F.lit(1)).alias("_k"))
    return own.join(F.broadcast(total)).select("label", "n", F.round(F.col("_all") / (F.col("_k") * F.col("n")), 6).alias("weight"))  # one row of totals
