"""Readers and writers with declared schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from amberline.functions.text import host

# What a CSV cell may say for "missing".
NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
PAGE = "url string, title string, http_status int, fetch_timestamp string, word_count long, sha256 string, blocks array<struct<kind:string,text:string>>"


def read_csv(spark: SparkSession, path: str, schema: T.StructType, target: str | None = None, rows: int | None = None) -> DataFrame:
    """A CSV file with a header, by a declared schema; cells that do not fit are an error.

    NULL_TOKENS are null in number columns (and the empty string in text columns); blanks stay as
    they are. ``rows``, if given, is checked by a count.
    """
    if target is not None and target not in schema.names:
        raise ValueError(f"no target column {target}")
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    raw = spark.read.schema(text).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)
    null = lambda c: F.when(~F.coalesce(c.isin(*NULL_TOKENS), F.lit(True)), c)
    out = raw.select(*(F.col(f"`{f.name}`") if isinstance(f.dataType, T.StringType) else null(F.col(f"`{f.name}`")).cast(f.dataType).alias(f.name) for f in schema))
    if rows is not None and (n := out.count()) != rows:
        raise ValueError(f"{path} has {n} rows, {rows} are expected")
    return out


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """One JSON file a page; ``path`` gives the order of the corpus."""
    return spark.read.schema(PAGE).option("multiLine", True).option("mode", "FAILFAST").json(f"{folder.rstrip('/')}/*.json").withColumn("path", F.input_file_name())


def write_csv(df: DataFrame, path: str) -> None:
    """A small report as one CSV file in a folder."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def first_occurrences(df: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct keys with the least place at which each occurs."""
    return df.groupBy(key).agg(F.min(order).alias(order))


def discovered(urls: DataFrame, url: str, order: str, site: str, denied: tuple[str, ...] = ()) -> DataFrame:
    """Distinct URLs of one host, in order of first occurrence, without denied parts."""
    keep = F.contains(host(F.col(url)), F.lit(site))
    for part in denied:
        keep = keep & ~F.contains(F.col(url), F.lit(part))
    return first_occurrences(urls.where(keep), url, order)


def fetch_status(http_status: Column, final_url: Column, url: Column, cached: Column) -> Column:
    """What became of a fetch, from its facts: response, cache, offhost or failure."""
    return F.when(host(final_url) != host(url), "offhost").when((http_status == 304) & cached, "cache").when(http_status == 200, "response").otherwise("failure")


def manifest(pages: DataFrame) -> DataFrame:
    return pages.select("url", "sha256", "word_count")


def manifest_diff(listed: DataFrame, held: DataFrame) -> DataFrame:
    """Differences between a manifest and a corpus, both (url, sha256): one row and reason per URL that differs."""
    both = listed.select("url", F.col("sha256").alias("listed")).join(held.select("url", F.col("sha256").alias("held")), "url", "full_outer")
    reason = F.when(F.col("held").isNull(), "missing from corpus on disk").when(F.col("listed").isNull(), "on disk but not in manifest").when(F.col("listed") != F.col("held"), "sha256 mismatch")
    return both.withColumn("reason", reason).where("reason is not null")


def assembled(fetched: DataFrame) -> dict[str, DataFrame]:
    """Pages, failures and excluded URLs of ``fetched(url, status, ...)``, where status also says ``excluded``."""
    status = F.col("status")
    return {"pages": fetched.where(status.isin("response", "cache")), "failures": fetched.where(status.isin("failure", "offhost")), "excluded": fetched.where(status == "excluded")}


def manifest_summary(fetched: DataFrame) -> DataFrame:
    """Pages, their words, failures and excluded URLs."""
    status, page = F.col("status"), F.col("status").isin("response", "cache")
    return fetched.agg(F.count_if(page).alias("n_pages"), F.coalesce(F.sum(F.when(page, F.col("word_count"))), F.lit(0)).alias("n_words"), F.count_if(status.isin("failure", "offhost")).alias("n_failures"), F.count_if(status == "excluded").alias("n_excluded"))


def check_size(spark: SparkSession, path: str, size: int) -> None:
    """A downloaded file must have the size that its source states."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    held = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).getLen()
    if held != size:
        raise ValueError(f"{path} has {held} bytes, {size} are expected")
