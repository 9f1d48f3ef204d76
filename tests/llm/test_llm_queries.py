"""The registered queries and the pipeline."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from amberline.llm import common, queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    got = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(r[c] for c in names) for r in df.collect()) == sorted(got.fetchall())


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = common.stage(spark, stage(spark, docs, sf), "test")
        if name != "tokens":
            assert out.dtypes == docs.dtypes
        if name in ("quality", "near_duplicates"):
            assert 0 < out.count() < n
            assert out.exceptAll(docs).count() == 0
        if name == "personal_data":
            assert out.count() == docs.count()
            assert out.where(F.col("text").rlike(r"[a-z0-9]@[a-z0-9]+\.")).count() == 0
        docs = out
    assert docs.where("n_tokens > 0").count() == docs.count() > 0
    assert corpus_pipeline.run(spark, sf).count() == docs.count()


GOOD = "good words in a row that are long enough to pass all rules here"
#: Extra columns named as the operators name their own, with values that must come back.
CLASHES = ["_text", "_at", "_hash", "_base", "_spans", "_source", "_rate", "_copy", "_zero", "_place", "_row", "copy", "place", "_id", "_h", "node", "root", "key", "fp", "score", "pattern", "p_good", "held_out", "_y"]


def clashing(spark, rows):
    made = [(*r, *(f"{c}-{k}" for c in CLASHES)) for k, r in enumerate(rows)]
    return spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES))


ROWS = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, GOOD, "en", None, 64), (1, GOOD, "en", None, 64), (2, f"{GOOD} mail a.b@c.de", "en", "a", 80), (3, "alpha beta gamma " * 4 + "delta", "en", "b", 60)]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_keep_columns_of_any_name(spark, name, stage):
    df = clashing(spark, ROWS)
    got = stage(spark, df, "").collect()
    assert stage(spark, df.limit(0), "").count() == 0
    if name == "tokens":
        assert len(got) == len(ROWS)
        return
    given = {tuple(r[c] for c in CLASHES): r for r in df.collect()}
    assert all(tuple(r[c] for c in CLASHES) in given for r in got)
    rows = sorted(r["node"] for r in got)
    if name == "quality":
        assert rows == ["node-2", "node-3", "node-4"]
    if name == "near_duplicates":  # no words; the equal texts and one that shares 10 of 12 shingles with them; the last
        assert len(rows) == 3 and rows[0] == "node-1" and rows[1] in ("node-2", "node-3") and rows[2] == "node-5"
    if name == "personal_data":
        assert rows == [f"node-{k}" for k in range(6)]
        assert [(r["text"], r["n_chars"]) for r in got if r["node"] == "node-4"] == [(f"{GOOD} mail [EMAIL]", len(GOOD) + 13)]
    if name == "mix":
        assert all(r.asDict() == given[tuple(r[c] for c in CLASHES)].asDict() for r in got)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_take_columns_of_any_name(spark, sf, tmp_path, name):
    clashing(spark, ROWS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 1, "x"), (2, 1, 0, "y")], "doc_id long, quality int, toxic int, _id string").write.parquet(f"{tmp_path}/labels.parquet")
    vectors = [(k, [float(k), 1.0], "a", "b", "c") for k in range(101)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, id string, v string, shard string").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = queries.QUERIES[name](spark, str(tmp_path)).collect()
    if name == "op9_vptree":
        assert len(rows) == 20
    elif name == "op11_collocations":
        assert rows == []  # nothing occurs ten times in one language
    elif name == "op12_rp_forest":
        assert sorted(r["vec_id"] for r in rows) == list(range(101)) and {r["component_id"] for r in rows} == {0, 1}
    elif name == "op13_whitening":
        assert sorted((r["vec_id"], r["component"]) for r in rows) == [(k, c) for k in range(101) for c in (1, 2)]
    elif name == "op8_poisson_mix":
        assert {r["doc_id"] for r in rows} <= {None, 1, 2, 3}
    else:
        assert sorted(r["doc_id"] or 0 for r in rows) == [0, 1, 1, 1, 2, 3]
