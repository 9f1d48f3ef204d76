"""Queries on tables that the driver's smallest ones do not show: cut-off entities, more rows, frequent terms."""

import duckdb
import pytest
from pyspark.sql import functions as F

from amberline.plans import catalogue


def against_sql(spark, folder, name, **tables):
    """Rows of a query and of its SQL over tables written to ``folder``."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    got, want = catalogue.QUERIES[name](spark, str(folder)), con.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    key = lambda row: tuple((v is None, str(v)) for v in row)
    rows = sorted((tuple(r) for r in got.select(*names).collect()), key=key)
    assert rows == sorted(want.fetchall(), key=key)
    return rows


def test_titles_with_cut_off_entities(spark, tmp_path):
    titles = {"<head><title> a &amp;&amp </title>": "a &&amp", "<title>&quot;b&quot</title>": "&quot;b&quot", "<title>&amp;lt;\u00a0</title><title>c</title>": "&lt;", "<p>no title": "", "<title>\td\n</title>": "\td\n"}
    pages = spark.createDataFrame([*enumerate(titles), (9, None)], "page_id long, html string").withColumn("url", F.lit("https://x.org/1"))
    assert against_sql(spark, tmp_path, "html_title", pages=pages) == [*enumerate(titles.values()), (9, None)]


@pytest.mark.parametrize("copies", [1, 12])
def test_one_hot_columns_do_not_depend_on_the_rows(spark, sf, tmp_path, copies):
    """With more rows every rare level is frequent, and no row is infrequent; the columns stay."""
    customer = spark.read.parquet(f"{sf}/customer.parquet")
    least = 4200 * copies
    keys = spark.range(1, least + 1).select(F.col("id").alias("c_custkey"), F.element_at(F.array(*map(F.lit, ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"))), (F.col("id") % 5 + 1).cast("int")).alias("c_mktsegment"))
    rows = against_sql(spark, tmp_path, "one_hot_min_frequency", customer=keys.join(customer.drop("c_custkey", "c_mktsegment").limit(1)))
    assert len(rows) == least and (sum(r[-1] for r in rows) > 0) == (copies == 1)


def test_scores_stay_in_slabs(spark, monkeypatch):
    """Many slabs and sets of queries give what one gives; pairs of query and chunk are no rows of any exchange."""
    from amberline.operators import blockmax, retrieval

    texts = [f"shared word{i % 7} word{i % 11} other{i % 3}" if i % 5 else "shared" for i in range(200)]
    index = retrieval.build(retrieval.corpus(spark.createDataFrame([(i, "u", "t", t) for i, t in enumerate(texts)], "k int, url string, title string, text string"), "k", "url", "title", "text"))
    queries = spark.createDataFrame([(i, f"word{i % 7} word{i % 11} shared shared") for i in range(40)] + [(99, "nothing here is known"), (98, ""), (None, "word3")], "query_id int, query string")
    rows = lambda df: sorted(map(tuple, df.select("query_id", "rank", "ord", F.round("score", 8)).collect()), key=str)
    want = rows(retrieval.search(index, queries, 4))
    assert len(want) == 42 * 4
    for slab, size in ((64, 7), (1, 1000)):
        monkeypatch.setattr(retrieval, "SLAB", slab)
        monkeypatch.setattr(retrieval, "SET", size)
        assert rows(retrieval.search(index, queries, 4)) == want
    monkeypatch.setattr(retrieval, "SLAB", 64)
    plan = retrieval.search(index, queries, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Aggregate" not in plan.split("FlatMapCoGroupsInArrow")[0]
    import tempfile

    stored = blockmax.store(index, f"{tempfile.mkdtemp()}/index", block=10)  # six blocks a slab
    best, blocks = blockmax.search(stored, queries, 4, first=1)
    assert rows(best) == want
    assert blocks.select("query_id", "block").distinct().count() == blocks.count() and blocks.agg(F.max("block")).first()[0] == 19


def test_terms_are_counted_without_an_exchange(spark):
    from amberline.operators import retrieval

    df = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, None), (4, ["a"])], "k int, t array<string>")
    assert {r["k"]: r["c"] and [tuple(x) for x in r["c"]] for r in df.select("k", retrieval.counted(F.col("t")).alias("c")).collect()} == {1: [("a", 1), ("b", 2)], 2: None, 3: None, 4: [("a", 1)]}


@pytest.mark.parametrize("rows", [1, 1 << 17])
def test_a_forest_keeps_no_tree(spark, monkeypatch, rows):
    """Trees one by one link as all together do, and rows of a tree do not stay on disk."""
    from pathlib import Path

    import numpy as np

    from amberline.llm import rp_forest
    from amberline.operators.staging import shared_dir

    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 8))
    x[100:] = x[:100].repeat(2, axis=0) + rng.normal(size=(200, 8)) * 0.1
    for name, value in (("AT_ONCE", rows), ("LEAF", 24), ("MOST", 40)):
        monkeypatch.setattr(rp_forest, name, value, raising=False)
    stored = lambda: {p.name for p in Path(shared_dir(spark).removeprefix("file://")).glob("*") if p.name.split("-")[0] in ("leaves", "rows", "places")}
    before = stored()
    got = rp_forest.linked(spark, spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>"))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    assert {r["vec_id"]: r["n_links"] for r in got.collect()} == dict(enumerate((u @ u.T >= 0.9).sum(axis=1) - 1))
    assert stored() <= before


def test_near_duplicates_leave_no_texts_and_buckets(spark):
    from pathlib import Path

    from amberline.llm import simhash
    from amberline.operators.staging import shared_dir

    stored = lambda: {p.name for p in Path(shared_dir(spark).removeprefix("file://")).glob("*") if "-texts-" in p.name or p.name.split("-")[0] in ("met", "large")}
    before = stored()
    texts = [" ".join(f"w{k % 3}x{i}" for i in range(40)) + f" end{k % 20}" for k in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["doc_id"] for r in simhash.keep_first(spark, docs).orderBy("doc_id").collect()] == [0, 1, 2]
    assert stored() <= before


def test_near_duplicates_meet_by_pigeonring_first(spark, monkeypatch):
    """Before, the stage did not use the fingerprints at all. What they miss is found all the same."""
    import random

    from amberline.llm import simhash

    rng = random.Random(5)
    texts = []
    for _ in range(12):
        words = [f"w{rng.randrange(4000)}" for _ in range(160)]
        texts.append(" ".join(words))
        for cut in (1, 4, 12):  # from very near to hardly near
            texts.append(" ".join([*words[:-cut], *(f"z{rng.randrange(4000)}" for _ in range(cut))]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [set(simhash.shingle_set(t.encode(), 5).tolist()) for t in texts]
    alike = {(a, b) for b in range(len(texts)) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    want = {b for b in range(len(texts)) if not any((a, b) in alike for a in range(b))}  # chains stay within a dozen
    found, links = [], simhash.links

    def seen(spark, nodes, max_bits):
        found.append(links(spark, nodes, max_bits).count())
        return links(spark, nodes, max_bits)

    def none(spark, nodes, max_bits):
        return links(spark, nodes, max_bits).limit(0)

    for change in (seen, none):
        monkeypatch.setattr(simhash, "links", change)
        assert {r["doc_id"] for r in simhash.keep_first(spark, docs).collect()} == want
    assert found and 0 < found[0] < len(alike)
