"""Column profiles: one row of facts per column of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from amberline.functions.text import is_blank


def require_columns(df: DataFrame, names: list[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def kind(dtype: T.DataType) -> str:
    return "string" if isinstance(dtype, T.StringType) else "float" if isinstance(dtype, (T.DoubleType, T.FloatType)) else "int" if isinstance(dtype, T.IntegralType) else "other"


def _shown(df: DataFrame, c: str) -> Column:
    """A value as text, equal for equal values only."""
    dtype, value = df.schema[c].dataType, F.col(f"`{c}`")
    if isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)):
        return F.when(value.isNotNull(), F.to_json(F.struct(value.alias("v"))))
    return (value + F.lit(0.0) if kind(dtype) == "float" else value).cast("string")  # -0.0 is 0.0


def inventory(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column, position, dtype, non_null, pct_missing, pct_blank, n_unique`` (null is no value).

    One scan for any number of columns: counts of (column, value), which are added before they are
    shuffled, give all facts. NaN is a value; a table without rows has counts of 0 and null shares.
    """
    columns = columns or df.columns
    require_columns(df, columns)
    cells = F.array(*(F.struct(F.lit(i).alias("position"), _shown(df, c).alias("value")) for i, c in enumerate(columns)))
    counts = df.select(F.inline(cells)).groupBy("position", "value").agg(F.count(F.lit(1)).alias("n"))
    held, blank = F.col("value").isNotNull(), is_blank(F.col("value"))
    added = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))
    facts = counts.groupBy("position").agg(F.sum("n").alias("n"), added(held).alias("held"), added(blank).alias("blank"), F.count("value").alias("values"))
    names = df.sparkSession.createDataFrame([(i, c, kind(df.schema[c].dataType)) for i, c in enumerate(columns)], "position int, column string, dtype string")
    share = lambda c: F.try_divide(F.col(c), F.col("n"))
    return names.join(F.broadcast(facts), "position", "left").select(  # one row a column
        "column", "position", "dtype", F.coalesce("held", F.lit(0)).cast("long").alias("non_null"), F.round(100 * (1 - share("held")), 4).alias("pct_missing"),
        F.round(100 * F.when(F.col("dtype") == "string", share("blank")).otherwise(share("n") - 1), 4).alias("pct_blank"), F.coalesce("values", F.lit(0)).cast("long").alias("n_unique"),
    )


def value_shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, value, n``: how often each value occurs, null as a value of its own. One pass over the table."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))
    return df.select(F.inline(pairs)).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def near_constant(df: DataFrame, columns: list[str], share: float = 0.99) -> DataFrame:
    """Columns whose most frequent value (null counts) holds more than ``share`` of the rows."""
    top = value_shares(df, columns).groupBy("column").agg(F.max("n").alias("m"), F.sum("n").alias("n"))
    return top.where(F.col("m") / F.col("n") > share).select("column", F.round(100 * F.col("m") / F.col("n"), 2).alias("top_value_pct"))


def constant(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns with one value, null included."""
    return value_shares(df, columns).groupBy("column").agg(F.count(F.lit(1)).alias("n_values")).where("n_values = 1").select("column")


def assign_groups(columns: list[str], explicit: dict[str, str], prefixes: dict[str, str]) -> dict[str, str]:
    """Group of each column: explicit membership before prefixes; a column without a group is an error."""
    out = {}
    for c in columns:
        hit = explicit.get(c) or next((g for p, g in prefixes.items() if c.startswith(p)), None)
        if hit is None:
            raise ValueError(f"no group for column {c}")
        out[c] = hit
    return out


def column_run(columns: list[str], first: str, last: str, without: tuple[str, ...] = ()) -> list[str]:
    """The columns from ``first`` to ``last`` by position."""
    if first not in columns or last not in columns:
        raise ValueError(f"no column {first if first not in columns else last}")
    a, b = columns.index(first), columns.index(last)
    if a > b:
        raise ValueError(f"{first} stands after {last}")
    return [c for c in columns[a : b + 1] if c not in without]
