"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

Each source s has a rate: the mean number of times a document of s must be repeated for s to make
up its target weight of the mix. A document is repeated as often as a Poisson variable with that
mean says, whose uniform number is a hash of the document's id and the seed: the distribution
function is inverted, so the same document is drawn alike wherever it is computed. Rates above
PIECE are summed from equal smaller rates, each with a hash of its own. A second hash places each
copy: rows are dealt by it and lie ordered by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql import functions as F

from amberline.llm.common import hidden, stage

PIECE = 64.0
#: Terms of the distribution function that are added up for one piece: its mean plus 12 deviations and more.
TERMS = 192
#: Sources up to which the table of rates is sent to all tasks.
FEW_SOURCES = 10_000


def uniform(key: Column, salt: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an md5, which other engines can compute too."""
    digest = F.md5(F.concat_ws(":", key.cast("string"), salt.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def poisson(u: Column, rate: Column) -> Column:
    """The least n at which the distribution function of a Poisson variable exceeds u."""
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.lit(0).alias("n"))

    def step(a: Column, k: Column) -> Column:
        p = a["p"] * rate / k
        return F.when(u < a["c"], a).otherwise(F.struct(p.alias("p"), (a["c"] + p).alias("c"), k.cast("int").alias("n")))

    return F.aggregate(F.sequence(F.lit(1), F.least(F.lit(TERMS), F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int"))), start, step, lambda a: a["n"])


def copies(key: Column, rate: Column, seed: int) -> Column:
    pieces = F.greatest(F.lit(1), F.ceil(rate / PIECE).cast("int"))
    part = lambda k: poisson(uniform(key, F.concat_ws(".", F.lit(str(seed)), k.cast("string"))), rate / pieces)
    total = F.aggregate(F.sequence(F.lit(0), pieces - 1), F.lit(0), lambda a, k: a + part(k))
    return F.when(rate > 0, total).otherwise(0)


def rates(docs: DataFrame, source: str, weights: dict[str, float] | None, power: float) -> DataFrame:
    """``(source, rate)``. Without weights a source's target is its number of documents to ``power``;
    with them, sources not named get none. The mix has as many documents, on average, as the input."""
    n = docs.groupBy(F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    if weights is None:
        target = F.pow("n", F.lit(float(power)))
    else:
        pairs = [x for k, w in sorted(weights.items()) for x in (F.lit(k), F.lit(float(w)))]
        target = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("source")), F.lit(0.0)) if pairs else F.lit(0.0)
    wanted = stage(docs.sparkSession, n.withColumn("w", target), "sources")
    every = wanted.agg(F.sum("n").alias("all_n"), F.sum("w").alias("all_w"))  # one row
    share = F.try_divide(F.col("w") * F.col("all_n"), F.col("all_w") * F.col("n"))
    return wanted.join(F.broadcast(every)).select("source", F.coalesce(share, F.lit(0.0)).alias("rate"))


def mixed(
    spark: SparkSession, docs: DataFrame, key: str = "doc_id", source: str = "source", weights: dict[str, float] | None = None,
    power: float = 0.5, seed: int = 7, detail: bool = False,
) -> DataFrame:
    """Copies of the rows of ``docs``, in a global random order.

    Rows that share a key are repeated alike. A row without a key draws by a hash of its values
    instead, so such rows do not all draw alike; a null source is the empty source. Rows at one place
    of the order (equal keys and copy numbers) follow a hash of their values; equal rows are
    exchangeable. Texts are hashed whole, however long. Columns pass through, whatever their names;
    an empty table gives no rows. With ``detail`` each copy also has ``copy`` (from 0) and ``place``,
    the key of the order, which take the place of columns so named.
    """
    names = {n: hidden(docs.columns, n) for n in ("source", "rate", "copy", "zero", "place", "row")}
    col = {n: F.col(c) for n, c in names.items()}
    table = rates(docs, source, weights, power).toDF(names["source"], names["rate"])
    few = table.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES
    plain = [f.name for f in docs.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    row = F.xxhash64(*(F.col(f"`{c}`") for c in plain))
    keyed = docs.withColumns({names["source"]: F.coalesce(F.col(source).cast("string"), F.lit("")), names["row"]: row})
    joined = keyed.join(F.broadcast(table) if few else table, names["source"], "left")
    ident = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("null:"), col["row"].cast("string")))
    n = copies(ident, F.coalesce(col["rate"], F.lit(0.0)), seed)
    spread = joined.select("*", F.posexplode(F.array_repeat(F.lit(0), n)).alias(names["copy"], names["zero"]))
    place = F.md5(F.concat_ws(":", ident, col["copy"].cast("string"), F.lit(f"place{seed}")).cast("binary"))
    out = spread.withColumn(names["place"], place)
    out = out.repartition(names["place"], names["row"]).sortWithinPartitions(names["place"], names["row"])
    if detail:
        kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("copy", "place")]
        return out.select(*kept, col["copy"].alias("copy"), col["place"].alias("place"))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
