"""BM25 retrieval over chunk tables.

A corpus is ``(ord, url, title, text)``: ord is the corpus order, dense from 0 and used for all ties.
Queries are ``(query_id, query)``. Scores are rounded to 9 digits before ranking, so that the order
of additions cannot change a rank.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from amberline.functions.text import tokens
from amberline.operators.staging import running, staged
from amberline.session import ship

# BM25 parameters.
K1, B, EPSILON = 1.5, 0.75, 0.25
DIGITS = 9
#: Consecutive chunks, and queries about, whose scores a task holds at once.
SLAB, SET = 4096, 512


def corpus(df: DataFrame, key: str, url: str, title: str, text: str) -> DataFrame:
    own = df.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(title).alias("title"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    numbered = running(own, [F.asc("key"), F.asc("url"), F.asc("text")], {}, "n").select((F.col("n") - 1).alias("ord"), "key", "url", "title", "text")
    return staged(numbered, "chunks")  # texts are then sorted once, however often they are read


@dataclass(frozen=True)
class Index:
    """``chunks(ord, key, url, title, text)``, ``postings(term, ord, tf, dl)``, ``terms(term, df, idf)``, and ``facts``: one row of n and avgdl."""

    chunks: DataFrame
    postings: DataFrame
    terms: DataFrame
    facts: DataFrame


def counted(t: Column) -> Column:
    """The distinct terms of an array of tokens with their counts: an array of (term, tf)."""

    def runs(held: Column) -> Column:
        n = F.size(held)
        heads = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(held, i) != F.get(held, i - 1)))
        return F.when(n > 0, F.transform(F.array(heads), lambda h: F.transform(h, lambda i, k: F.struct(F.get(held, i).alias("term"), (F.coalesce(F.get(h, k + 1), n) - i).cast("long").alias("tf"))))[0])

    return F.transform(F.array(F.sort_array(t)), runs)[0]  # an array of one names what is read many times


def build(chunks: DataFrame) -> Index:
    """The text is cut into tokens once and its terms are counted where it lies; lengths and facts come from the postings. No chunks are an error."""
    tokenized = chunks.select("ord", tokens(F.col("text")).alias("t"))
    own = tokenized.select("ord", F.size("t").alias("dl"), F.explode(counted(F.col("t"))).alias("c"))
    postings = staged(own.select("c.term", "ord", "dl", "c.tf"), "postings")
    n = chunks.count()
    if not n:
        raise ValueError("an index needs a chunk")
    facts = staged(postings.agg(F.lit(n).cast("long").alias("n"), (F.coalesce(F.sum("tf"), F.lit(0)).cast("double") / n).alias("avgdl")), "facts")
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = staged(df.join(F.broadcast(facts)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)), "raw")  # one row of facts; read twice
    mean = raw.agg(F.avg("raw").alias("mean"))
    terms = raw.join(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))  # one row
    return Index(chunks, postings, staged(terms, "terms"), facts)


def query_terms(queries: DataFrame) -> DataFrame:
    """``(query_id, term)`` with repeats."""
    return queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term"))


def asked_terms(queries: DataFrame) -> DataFrame:
    """``query_id, term, qtf, set`` of the queries that have tokens, dealt to sets of about ``SET`` queries."""
    qt = staged(query_terms(queries).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf")), "asked")
    sets = qt.select("query_id").distinct().count() // SET + 1
    return qt.withColumn("set", F.pmod(F.xxhash64("query_id"), F.lit(sets)).cast("int"))


def by_slab(index: Index, qt: DataFrame, gains: DataFrame, slab: int) -> PandasCogroupedOps:
    """``gains(term, set, ord, gain, most)`` and the terms of the queries of the set, grouped by set and by slabs of ``slab`` consecutive ordinals.

    A group is bounded whatever the corpus and the number of queries. Rows with ``most`` are for a block and not for a chunk.
    """
    slabs = index.facts.select(F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / slab))).alias("slab"), "n")
    asked = qt.crossJoin(F.broadcast(slabs)).select("slab", F.col("set").alias("of"), "query_id", "term", F.col("qtf").cast("double").alias("qtf"), "n")  # a row a slab
    held = gains.select(F.floor(F.col("ord") / slab).cast("long").alias("slab"), "set", "term", "ord", "gain", "most")
    return held.groupBy("slab", "set").cogroup(asked.groupBy("slab", "of"))


class Slab:
    """One group of ``by_slab`` in memory: queries and terms by number, postings by term."""

    def __init__(self, key: tuple, held: pa.Table, asked: pa.Table, size: int):
        self.first = key[0].as_py() * size
        self.rows = min(size, asked.column("n")[0].as_py() - self.first)
        ids = asked.column("query_id").combine_chunks().dictionary_encode(null_encoding="encode")
        terms = asked.column("term").combine_chunks().dictionary_encode()
        self.query_id, self.n_terms = ids.dictionary, len(terms.dictionary)
        of_query = np.asarray(terms.indices)
        order = np.argsort(of_query, kind="stable")
        self.query, self.qtf = np.asarray(ids.indices)[order], np.asarray(asked.column("qtf").combine_chunks())[order]
        self.asks = np.searchsorted(of_query[order], np.arange(self.n_terms + 1))
        at = np.asarray(pc.index_in(held.column("term").combine_chunks(), value_set=terms.dictionary))
        place, gain = np.asarray(held.column("ord").combine_chunks()) - self.first, np.asarray(held.column("gain").combine_chunks())
        most = held.column("most").combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
        self.postings, self.maxima = ((at[own], place[own], gain[own]) for own in (~most, most))

    def terms(self, rows: tuple[np.ndarray, ...]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each term that ``rows`` (``postings`` or ``maxima``) have: queries that ask for it, how often, and its places and gains."""
        order = np.lexsort((rows[1], rows[0]))
        at, place, gain = (x[order] for x in rows)
        ends = np.searchsorted(at, np.arange(self.n_terms + 1))
        for t in np.flatnonzero(np.diff(ends)):
            held, asks = slice(ends[t], ends[t + 1]), slice(self.asks[t], self.asks[t + 1])
            yield self.query[asks], self.qtf[asks], place[held], gain[held]

    def scores(self, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> np.ndarray:
        """A row a query, a column a chunk; chunks without a query term have 0. ``wanted`` says of queries and chunks which pairs count."""
        out = np.zeros((len(self.query_id), self.rows))
        for query, qtf, place, gain in self.terms(self.postings):
            part = np.outer(qtf, gain)
            out[query[:, None], place] += part if wanted is None else np.where(wanted(query, place), part, 0.0)
        return rounded(out)

    def best(self, scores: np.ndarray, k: int) -> pa.Table:
        """``query_id, ord, score`` of the k best chunks of each query, ties to the first."""
        if scores.shape[1] > k:
            least = np.partition(scores, -k, axis=1)[:, -k, None]
            same = scores == least
            room = k - (scores > least).sum(axis=1, keepdims=True)
            query, place = np.nonzero((scores > least) | same & (np.cumsum(same, axis=1) <= room))
        else:
            query, place = (x.ravel() for x in np.indices(scores.shape))
        return pa.table({"query_id": self.query_id.take(pa.array(query)), "ord": pa.array(place + self.first, pa.int64()), "score": scores[query, place]})


def rounded(scores: np.ndarray) -> np.ndarray:
    """To ``DIGITS`` digits, halves away from zero."""
    return np.copysign(np.floor(np.abs(scores) * 10**DIGITS + 0.5) / 10**DIGITS, scores) + 0.0


def gain() -> Column:
    """What one occurrence of a term in a query adds to the score of a chunk."""
    return F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))


def top(found: DataFrame, k: int) -> DataFrame:
    """``query_id, ord, score, rank`` of the k best of what the slabs have found."""
    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "ord"))
    return found.withColumn("rank", best).where(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """The k best chunks of each query that has tokens: ``(query_id, rank, ord, score)``.

    Chunks without a query term score 0 and take part in corpus order. Every slab of the corpus gives the k best of its
    own chunks, so that pairs of query and chunk never leave a task; the k best of all are among them.
    """
    ship(queries.sparkSession)
    qt = asked_terms(queries)
    wanted = staged(qt.select("term", "set").distinct().join(index.terms, "term"), "wanted")  # its size is then known before the postings are read
    hit = index.postings.join(wanted, "term").join(F.broadcast(index.facts))  # one row of facts
    gains = hit.select("term", "set", "ord", gain().alias("gain"), F.lit(False).alias("most"))

    def run(key: tuple, held: pa.Table, asked: pa.Table) -> pa.Table:
        slab = Slab(key, held, asked, SLAB)
        return slab.best(slab.scores(), k)

    kind = qt.schema["query_id"].dataType.simpleString()
    return top(by_slab(index, qt, gains, SLAB).applyInArrow(run, f"query_id {kind}, ord long, score double"), k)


def ranked_pages(index: Index, queries: DataFrame, k: int = 40, pages: int = 10, hits: DataFrame | None = None) -> DataFrame:
    """Distinct pages of the k best chunks, by their best chunk: ``(query_id, page_rank, url)``.

    ``hits``, here and below, may be a result of ``search`` with k or more that is at hand.
    """
    hits = staged(search(index, queries, k), "hits") if hits is None else hits.where(F.col("rank") <= k)
    hits = hits.join(index.chunks.select("ord", "url"), "ord")
    first = hits.groupBy("query_id", "url").agg(F.min("rank").alias("best"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy("best"))
    return first.withColumn("page_rank", place).where(F.col("page_rank") <= pages).select("query_id", "page_rank", "url")


def coverage(index: Index, queries: DataFrame) -> DataFrame:
    """Share of a query's tokens (repeats kept) that the corpus knows; 0 without tokens."""
    known = query_terms(queries).join(index.terms.select("term", F.lit(1.0).alias("known")), "term", "left")
    share = known.groupBy("query_id").agg(F.avg(F.coalesce("known", F.lit(0.0))).alias("c"))
    return queries.select("query_id").join(share, "query_id", "left").select("query_id", F.round(F.coalesce("c", F.lit(0.0)), 6).alias("coverage"))


def best_overlap(index: Index, queries: DataFrame, k: int = 3, hits: DataFrame | None = None) -> DataFrame:
    """The largest share of a query's tokens that one of its k best chunks holds."""
    asked = queries.select("query_id", tokens(F.col("query")).alias("q"))
    hits = staged(search(index, queries, k), "hits") if hits is None else hits.where(F.col("rank") <= k)
    held = hits.select("query_id", "ord").join(index.chunks.select("ord", "text"), "ord").join(asked, "query_id").withColumn("t", tokens(F.col("text")))  # only texts that were found are cut
    share = F.try_divide(F.size(F.filter("q", lambda t: F.array_contains("t", t))), F.size("q"))
    best = held.groupBy("query_id").agg(F.max(share).alias("o"))
    return queries.select("query_id").join(best, "query_id", "left").select("query_id", F.round(F.coalesce("o", F.lit(0.0)), 6).alias("overlap"))


def page_metrics(ranked: DataFrame, expected: DataFrame) -> DataFrame:
    """Reciprocal rank of the first expected page and whether it is among the first three; ``expected`` is (query_id, category, url)."""
    hit = ranked.join(expected.select("query_id", "url"), ["query_id", "url"], "left_semi").groupBy("query_id").agg(F.min("page_rank").alias("first"))
    own = expected.select("query_id", "category").distinct().join(hit, "query_id", "left")
    return own.select("query_id", "category", F.coalesce(F.round(1 / F.col("first"), 4), F.lit(0.0)).alias("reciprocal_rank"), F.coalesce((F.col("first") <= 3).cast("int"), F.lit(0)).alias("hit_at_3"))
