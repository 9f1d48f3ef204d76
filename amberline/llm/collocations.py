"""Phrases that occur more often than their parts would let one expect, per language.

All runs of 1 to ``max_n`` words become rows and are counted per language and phrase. A candidate has 2 to
``max_n`` words and at least ``least`` occurrences; each way to cut it in two joins the counts of both parts,
and the cut with the lowest score stands for it. A candidate that mostly occurs inside a longer one is left out
by an anti-join with the one-word extensions: what a phrase two words longer says, the one between says too,
since it is at least as frequent and so a candidate as well.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from amberline.llm import common

PIECES, BLANKS = r"[.,;:!?\x0A-\x0D]", r"[\x20\x09]+"
#: Parts of a language that are ranked apart first, so that the last window sees ``PARTS * top`` rows a language at most.
PARTS = 32


def lowered(text: Column) -> Column:
    """A-Z in lower case and nothing else; texts of ASCII alone take the faster way."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.lower(text))


def phrases(docs: DataFrame, lengths: list[int], text: str, lang: str) -> DataFrame:
    """``key, times``: a row per run of so many words of a piece; with runs of one word, also one per piece without words that counts its words.

    The key is the language, a line feed and the words: one string takes less room in the shuffle than two.
    """
    pieces = docs.select(F.concat(F.coalesce(F.col(lang).cast("string"), F.lit("und")), F.lit("\n")).alias("lang"), F.explode(F.split(lowered(common.text_or_empty(text)), PIECES)).alias("piece"))
    trimmed = pieces.select("lang", F.btrim("piece", F.lit(" \t")).alias("piece")).where("piece <> ''")
    words = trimmed.select("lang", F.split("piece", BLANKS).alias("w")).withColumn("size", F.size("w")).where(F.col("size") >= min(lengths))
    at = words.select("lang", "w", "size", F.explode(F.sequence(F.lit(0), F.col("size") - (min(lengths) - 1))).alias("i"))
    word = lambda k: F.get("w", F.col("i") + k)
    runs = []
    for n in lengths:
        run = F.concat("lang", word(0), *(part for k in range(1, n) for part in (F.lit(" "), word(k))))
        runs.append(F.when(F.col("i") + n <= F.col("size"), run) if n > 1 else F.concat("lang", F.coalesce(word(0), F.lit(""))))
    last = F.col("i") == F.col("size")
    return at.select(F.when(last, F.col("size")).otherwise(1).alias("times"), F.explode(F.array(*runs)).alias("key")).where("key is not null")


def counted(spark: SparkSession, docs: DataFrame, max_n: int, least: int = 1, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, phrase, f``: runs of up to ``max_n`` words that occur ``least`` times; the number of all words under the empty phrase.

    Longer runs are counted length by length, so that the disk holds the shuffle of one length at a time.
    """
    found = None
    for lengths in [[1, 2], *([n] for n in range(3, max_n + 1))]:
        counts = phrases(docs, lengths, text, lang).groupBy("key").agg(F.sum("times").alias("f"))
        phrase = F.call_function("substring_index", F.col("key"), F.lit("\n"), F.lit(-1))  # no phrase holds a line feed
        kept = counts.where((F.col("f") >= least) | F.endswith("key", F.lit("\n")))
        kept = kept.select(F.call_function("left", F.col("key"), F.length("key") - F.length(phrase) - 1).alias("lang"), phrase.alias("phrase"), "f")
        with common.freeing(spark):
            own = common.stage(spark, kept, "phrases")
        found = own if found is None else found.unionByName(own)
    return found


def first_words(phrase: Column, k: Column) -> Column:
    return F.call_function("substring_index", phrase, F.lit(" "), k)


def score_of(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(10^6 a a / (l r)) in Decimal: exact for counts under 10^15, though products pass 64 bits."""
    a, l, r = (c.cast("decimal(15,0)") for c in (a, l, r))  # noqa: E741
    return F.call_function("div", a * a * F.lit(1000000).cast("decimal(7,0)"), l * r)


def collocations(spark: SparkSession, docs: DataFrame, max_n: int = 3, least: int = 10, top: int = 2000, inside: int = 50, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each language by score, then a, then phrase (byte order).

    a, l, r count the phrase, the part before the cut and the part after it, n all words of the language;
    score is floor(10^6 a a / (l r)), in Decimal, of the cut where it is least (the first such cut). A candidate
    is dropped if a longer one that contains it has at least ``inside`` percent of its occurrences.

    Null and empty texts have no words; a null language is ``und``. Repeated rows count each time. A text
    without any separator is one piece, whatever its length: rows are made word by word, so it needs the
    memory of its words only. An empty table gives no rows. Other columns are not read.
    """
    if max_n < 2:
        raise ValueError("phrases have two words or more")
    counts = counted(spark, docs, max_n, least, text, lang)
    size = F.size(F.split("phrase", " "))
    candidates = counts.where((F.col("phrase") != "") & (size > 1))
    k = F.explode(F.sequence(F.lit(1), size - 1)).alias("k")
    cuts = candidates.select("lang", "phrase", F.col("f").alias("a"), size.alias("size"), k)
    cuts = cuts.withColumns({"head": first_words(F.col("phrase"), F.col("k")), "tail": first_words(F.col("phrase"), F.col("k") - F.col("size"))})
    part = lambda name, to: counts.where("phrase <> ''").select("lang", F.col("phrase").alias(name), F.col("f").alias(to))
    cuts = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"])
    scored = cuts.withColumn("score", score_of(F.col("a"), F.col("l"), F.col("r")))
    scored = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    longer = candidates.where(size > 2).select("lang", "f", F.explode(F.array(first_words(F.col("phrase"), size - 1), first_words(F.col("phrase"), 1 - size))).alias("inner"))
    longer = longer.groupBy("lang", "inner").agg(F.max("f").alias("f")).withColumnRenamed("lang", "own")
    kept = scored.join(longer, (F.col("lang") == F.col("own")) & (F.col("phrase") == F.col("inner")) & (F.col("f") * 100 >= F.col("a") * inside), "left_anti")
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = F.row_number().over(W.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*order))
    best = kept.withColumn("rank", some).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    total = counts.where("phrase = ''").select("lang", F.col("f").alias("n"))  # a row a language
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
