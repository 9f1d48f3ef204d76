"""One query per operator over its whole table, with production parameters, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amberline.llm import bpe_automaton, collocations, mixing, pii, quality, rp_forest, secrets, simhash, suffix_dedup, token_store, toxicity, vptree, whitening
from amberline.session import ship, table

MIX_POWER, MIX_SEED = 0.5, 7


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(ship(spark), table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scanned(ship(spark), table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scanned(ship(spark), table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(ship(spark), table(spark, sf_dir, "documents"), width=4, max_bits=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(ship(spark), table(spark, sf_dir, "documents"))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.round_trip(ship(spark), table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


def op7_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.coded(ship(spark), table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), ["doc_id"])


def op8_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The copies of all documents, by source in proportion to the root of its size; texts as digests."""
    mix = mixing.mixed(ship(spark), table(spark, sf_dir, "documents").select("doc_id", "source", "text"), power=MIX_POWER, seed=MIX_SEED, detail=True)
    return mix.select("doc_id", "source", F.col("copy").cast("int").alias("copy"), "place", F.md5(F.encode("text", "utf-8")).alias("text_md5"))


def op9_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(ship(spark), table(spark, sf_dir, "embeddings"), k=10, factor=1.0, every=100)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(ship(spark), table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(ship(spark), table(spark, sf_dir, "documents"), max_n=3, least=10, top=2000)


def op12_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp_forest.linked(ship(spark), table(spark, sf_dir, "embeddings"), least=0.9)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whitened(ship(spark), table(spark, sf_dir, "embeddings"), most=8)
    return found.withColumn("deviation", F.col("deviation").cast("long"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_pii": op2_pii,
    "op3_secrets": op3_secrets,
    "op4_simhash": op4_simhash,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_token_store": op6_token_store,
    "op7_bpe_automaton": op7_bpe_automaton,
    "op8_poisson_mix": op8_poisson_mix,
    "op9_vptree": op9_vptree,
    "op10_quality": op10_quality,
    "op11_collocations": op11_collocations,
    "op12_rp_forest": op12_rp_forest,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL: dict[str, str] = {
    "op8_poisson_mix": f"""
        with n as (select coalesce(source, '') as s, count(*)::double as n from documents group by 1),
        rate as (select s, pow(n, {MIX_POWER}) * sum(n) over () / (sum(pow(n, {MIX_POWER})) over () * n) as r from n),
        cdf as (select s, r, k, sum(exp(-r + k * ln(r) - lgamma(k + 1))) over (partition by s order by k) as c
                from rate, range(0, 192) as t(k)),
        u as (select doc_id, text, source, coalesce(source, '') as s,
                     ('0x' || substr(md5(coalesce(doc_id::varchar, 'null') || ':{MIX_SEED}.0'), 1, 13))::bigint / 4503599627370496.0 as u
              from documents),
        drawn as (select doc_id, u.source, text, (select count(*) from cdf where cdf.s = u.s and cdf.c <= u.u) as copies from u)
        select doc_id, source, t.copy::int as copy, md5(doc_id || ':' || t.copy || ':place{MIX_SEED}') as place, md5(text) as text_md5
        from drawn, lateral (select unnest(range(0, drawn.copies)) as copy) as t
    """,
    "op9_vptree": """
        with v as (
            select vec_id, embedding::double[] as e from embeddings
            where vec_id is not null and embedding is not null
              and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
              and len(list_filter(embedding, lambda x: x <> 0)) > 0
        ),
        d as (
            select q.vec_id as query_id, c.vec_id,  -- squares added from the first component on
                   sqrt(list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])), lambda a, b: a + b)) as score
            from v as q join v as c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id
        )
        select query_id, row_number() over (partition by query_id order by score, vec_id)::int as rank, vec_id, score
        from d qualify row_number() over (partition by query_id order by score, vec_id) <= 10
    """,
    "op11_collocations": r"""
        with pieces as (
            select coalesce(lang, 'und') as lang,
                   unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
            from documents
        ),
        split as (select row_number() over () as piece, lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as w from pieces),
        words as (select piece, lang, unnest(w) as x, unnest(range(len(w))) as i from split),
        ahead as (select lang, x, lead(x, 1) over p as y, lead(x, 2) over p as z from words window p as (partition by piece order by i)),
        runs as (
            select lang, 1 as k, x as phrase from ahead
            union all select lang, 2, x || ' ' || y from ahead where y is not null
            union all select lang, 3, x || ' ' || y || ' ' || z from ahead where z is not null
        ),
        f as (select lang, k, phrase, count(*) as f from runs group by all),
        n as (select lang, sum(f)::bigint as n from f where k = 1 group by 1),
        cand as (select lang, k, phrase, f as a, string_split(phrase, ' ') as w from f where k > 1 and f >= 10),
        cuts as (
            select c.lang, c.k, c.phrase, c.a, cut, h.f as l, t.f as r, (1000000::hugeint * c.a * c.a // (h.f::hugeint * t.f))::bigint as score
            from cand as c, (values (1), (2)) as x(cut), f as h, f as t
            where cut < c.k and h.lang = c.lang and t.lang = c.lang
              and h.phrase = array_to_string(c.w[1:cut], ' ') and t.phrase = array_to_string(c.w[cut + 1:], ' ')
        ),
        best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
        longer as (select lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) as inside from cand where k = 3),
        kept as (select * from best as b where not exists (from longer as o where o.lang = b.lang and o.inside = b.phrase and 100 * o.a >= 50 * b.a)),
        ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
        select lang, rank, phrase, a, l, r, n, score from ranked join n using (lang) where rank <= 2000
    """,
    "op12_rp_forest": """
        with recursive v as (
            select row_number() over () as node, vec_id, embedding::double[] as e,
                   coalesce(len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0, false) as use
            from embeddings
        ),
        links as (select a.node as x, b.node as y from v as a join v as b on a.node <> b.node and a.use and b.use and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.9),
        reach(node, there) as (select node, node from v union select r.node, l.y from reach as r join links as l on r.there = l.x),
        component as (select r.node, min(v.vec_id) as component_id from reach as r join v on v.node = r.there group by 1),
        n as (select x as node, count(*) as n_links from links group by 1)
        select vec_id, coalesce(n_links, 0) as n_links, component_id, vec_id is not distinct from component_id as kept
        from v join component using (node) left join n using (node)
    """,
}
