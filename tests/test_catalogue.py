"""Every query with SQL gives DuckDB's rows; the others give rows."""

import duckdb
import pytest

from amberline.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def same(spark_rows, columns, duck_rows, names):
    assert sorted(columns) == sorted(names)
    order = sorted(columns)
    a = [tuple(r[c] for c in order) for r in spark_rows]
    b = [tuple(r[names.index(c)] for c in order) for r in duck_rows]
    key = lambda row: tuple((v is None, str(v)) for v in row)
    assert sorted(a, key=key) == sorted(b, key=key)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_matches_sql(spark, sf, duck, name):
    df = catalogue.QUERIES[name](spark, sf)
    got = duck.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    same(df.collect(), df.columns, got.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_gives_rows(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_entry(spark, sf):
    kinds = {r["kind"] for r in catalogue.entry(spark, sf).collect()}
    assert {"refusal", "escalation"} <= kinds


def test_partitioning_does_not_matter(spark, sf):
    run = lambda: sorted(map(tuple, catalogue.QUERIES["choose_threshold"](spark, sf).collect()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    first = run()
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        assert run() == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
