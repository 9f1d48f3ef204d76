"""Hand-computed cases of single operators."""

import ast
import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from amberline.functions import text
from amberline.operators import chunks, decision, features, models, profile, retrieval, routing, stats
from amberline.sources import html, tables


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(expr(F.col("c"))).first()[0]


@pytest.mark.parametrize("value,months", [(9706, 0), (9705, 1), (9606, 12), (7506, 264), (0, None), (9700, None), (9713, None), (9799, None), (None, None), (1, 1169), (9710, -4)])
def test_months_before(spark, value, months):
    assert one(spark, value, text.months_before, "int") == months


@pytest.mark.parametrize("value,clean", [(" ", None), ("", None), ("   ", None), ("F", "F"), (" F ", "F"), (None, None), ("\n a \n", "a"), (" ", None)])
def test_blank_to_null(spark, value, clean):
    assert one(spark, value, text.blank_to_null) == clean


@pytest.mark.parametrize("age,band", [(25.0, "20-29"), (71.0, "70-79"), (99.0, "80-99"), (None, "(missing)"), (1.0, "(missing)"), (30.0, "30-39"), (29.0, "20-29"), (100.0, "(missing)")])
def test_age_band(spark, age, band):
    assert one(spark, age, text.age_band, "double") == band


def test_tokens_and_words(spark):
    assert one(spark, "The Contact's page-2 is HERE, a Contact", text.tokens) == ["contact", "page", "contact"]
    assert one(spark, None, text.tokens) is None
    assert one(spark, " a b  c\n", text.word_count) == 3


def test_trim_quote(spark):
    long = "One two. " + "word " * 100
    assert one(spark, long, text.trim_quote) == "One two."
    assert one(spark, "word " * 95, text.trim_quote) == " ".join(["word"] * 90)
    assert one(spark, "  short \n", text.trim_quote) == "short"


def test_split_oversized(spark):
    got = one(spark, " ".join(["w"] * 1200), text.split_oversized)
    assert [len(p.split()) for p in got] == [500, 500, 200]
    assert one(spark, "  ", text.split_oversized) == []


def test_wilson(spark):
    for (s, n), (low, high) in {(5, 40): (0.0546, 0.2611), (0, 50): (0.0, None), (50, 50): (None, 1.0), (0, 0): (0.0, 0.0), (1445, 38151): (0.0360, 0.0398)}.items():
        row = spark.createDataFrame([(s, n)], "s int, n int").select(*stats.wilson(F.col("s"), F.col("n"))).first()
        assert low is None or row[0] == pytest.approx(low, abs=1e-3)
        assert high is None or row[1] == pytest.approx(high, abs=1e-3)


def test_yates_chi_square(spark):
    counts = [(None, 1, 923), (None, 0, 18915 - 923), (1.0, 1, 2951), (1.0, 0, 57414 - 2951)]
    df = spark.createDataFrame(counts, "c double, y int, n int").select("c", "y", F.explode(F.sequence(F.lit(1), "n")))
    row = stats.missing_against_target(df, ["c"], "y").first()
    assert row["chi2"] == pytest.approx(1.945, abs=2e-3) and row["p_value"] == pytest.approx(0.1631, abs=2e-4)


def test_near_constant_counts_nulls_and_may_be_empty(spark):
    df = spark.createDataFrame([(1.0 if i == 0 else None, i, "L") for i in range(200)], "a double, b int, c string")
    assert {r["column"] for r in profile.near_constant(df, ["a", "b", "c"]).collect()} == {"a", "c"}
    assert profile.near_constant(df, ["b"]).collect() == []


def test_ranked_quantiles(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 2, 3, 10)] + [(None,)], "v double")
    got = {r["share"]: r["value"] for r in stats.ranked_quantiles(df, "v", [0.0, 0.25, 0.5, 0.9, 1.0]).collect()}
    assert got == {0.0: 1.0, 0.25: 2.0, 0.5: 2.0, 0.9: pytest.approx(7.2), 1.0: 10.0}


def test_column_runs_and_groups():
    assert profile.column_run(["a", "b", "c", "d"], "b", "d", ("c",)) == ["b", "d"]
    with pytest.raises(ValueError):
        profile.column_run(["a", "b"], "b", "a")
    with pytest.raises(ValueError, match="no group"):
        profile.assign_groups(["x"], {}, {"a": "g"})
    with pytest.raises(ValueError, match="leak"):
        features.response_columns(["RAMNT_2", "RAMNT_3"])
    assert features.response_columns(["RAMNT_10", "RAMNT_3", "OTHER"]) == ["RAMNT_3", "RAMNT_10"]


def scored(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "k int, y int, amount double, p double")


def test_revenue_curve(spark):
    curve = decision.revenue_curve(scored(spark, [(0, 0.0, 0.9), (0, 0.0, 0.8), (1, 10.0, 0.2), (1, 20.0, 0.1)]), "y", "amount", "p", "k").orderBy("contacts").collect()
    assert [r["net_revenue"] for r in curve] == [-0.68, -1.36, 7.96, 27.28]
    curve = decision.revenue_curve(scored(spark, [(1, 10.0, 0.9), (0, 0.0, 0.8), (1, 10.0, 0.7), (0, 0.0, 0.6)]), "y", "amount", "p", "k").orderBy("contacts").collect()
    assert [r["recall"] for r in curve] == [0.5, 0.5, 1.0, 1.0] and [r["precision"] for r in curve] == [1.0, 0.5, 0.666667, 0.5]
    tie = decision.revenue_curve(scored(spark, [(0, 0.0, 0.5), (1, 10.0, 0.5)]), "y", "amount", "p", "k").orderBy("contacts").first()
    assert tie["net_revenue"] == -0.68


def test_thresholds(spark):
    best = decision.choose_threshold(scored(spark, [(1, 20.0, 0.9), (1, 10.0, 0.8), (0, 0.0, 0.4), (0, 0.0, 0.3), (0, 0.0, 0.2)]), "y", "amount", "p", "k").first()
    assert (best["contacts"], best["net_revenue"], best["recall"], best["threshold"]) == (2, 28.64, 1.0, 0.8)
    assert decision.metrics_at(scored(spark, [(0, 0.0, 0.5)] * 3), "y", "amount", "p", F.lit(0.5)).first()["contacts"] == 3
    none = decision.metrics_at(scored(spark, [(1, 1.0, 0.1), (0, 0.0, 0.2)]), "y", "amount", "p", F.lit(0.9)).first()
    assert none["precision"] is None and none["recall"] == 0.0
    assert decision.metrics_at(scored(spark, [(0, 0.0, 0.1)]), "y", "amount", "p", F.lit(0.0)).first()["recall"] is None


def test_average_precision_is_not_the_trapezoid(spark):
    df = scored(spark, [(1, 0.0, 0.9), (0, 0.0, 0.8), (0, 0.0, 0.7), (1, 0.0, 0.6), (0, 0.0, 0.6), (1, 0.0, 0.1)])
    assert decision.average_precision(df, "y", "p").first()[0] == pytest.approx((1 + 2 / 5 + 3 / 6) / 3, abs=1e-6)


def test_slices_partition_the_rows(spark):
    rows = [(1, "F", 45), (0, "M", 55), (1, "F", None), (0, " ", 65), (0, "M", 45), (1, "F", 55)]
    df = spark.createDataFrame([(*r, p) for r, p in zip(rows, [0.9, 0.9, 0.1, 0.9, 0.9, 0.9])], "y int, g string, age int, p double")
    got = decision.slices(df, {"g": text.blank_to_null(F.col("g")), "age": text.age_band(F.col("age"))}, "y", "p", 0.5).collect()
    for a in ("g", "age"):
        assert sum(r["n"] for r in got if r["attribute"] == a) == 6
    women = next(r for r in got if r["segment"] == "F")
    assert women["recall"] == pytest.approx(2 / 3, abs=1e-6)


def test_split_is_exact_and_stable(spark):
    df = spark.range(1000).select("id", (F.col("id") % 20 == 0).cast("int").alias("y"))
    cut = features.stratified_split(df, "y", "id", 0.2, 2026)
    assert {(r["split"], r["y"]): r["n"] for r in cut.groupBy("split", "y").agg(F.count(F.lit(1)).alias("n")).collect()} == {("test", 0): 190, ("test", 1): 10, ("train", 0): 760, ("train", 1): 40}
    ids = lambda d: sorted(r["id"] for r in d.where("split = 'test'").collect())
    assert ids(cut) == ids(features.stratified_split(df.repartition(7), "y", "id", 0.2, 2026))
    with pytest.raises(ValueError):
        features.stratified_split(df.where("y = 0"), "y", "id")


def test_fitted_values_come_from_the_training_rows(spark):
    train = spark.createDataFrame([(1.0, "CA"), (2.0, "CA"), (3.0, "CA"), (4.0, "TX")], "v double, s string")
    assert features.Medians.fit(train, ["v"]).values == {"v": 2.5}
    mean, sd = features.Scaler.fit(train, ["v"]).values["v"]
    assert (mean, sd) == (2.5, pytest.approx(1.118034))
    other = spark.createDataFrame([(9.0, "CA"), (None, "NY"), (0.0, None)], "v double, s string")
    shares = [r["share"] for r in features.frequency_encode(other, features.frequency_table(train, "s"), "s").orderBy("v").collect()]
    assert sorted(shares) == [0.0, 0.0, 0.75]
    moved = train.unionAll(other)  # the control: fitting on more rows must move the values
    assert features.Scaler.fit(moved, ["v"]).values["v"][0] != 2.5
    hot = features.OneHot.fit(train, "s", least=2)
    assert hot.levels == ("CA",) and hot.infrequent
    assert [tuple(r) for r in other.select(*hot.encode()).collect()] == [(1, 0), (0, 1), (0, 1)]


def test_chunk_packer(spark):
    kind = "array<struct<kind:string,text:string>>"
    para = lambda n: {"kind": "text", "text": " ".join(["w"] * n)}
    sizes = lambda blocks: [(r["section"], r["word_count"]) for r in chunks.chunked(spark.createDataFrame([("u", "T", blocks)], f"url string, title string, blocks {kind}")).orderBy("chunk_id").collect()]
    assert sizes([para(1200)]) == [(None, 500), (None, 500), (None, 200)]
    assert sizes([{"kind": "heading", "text": "H"}, *[para(60)] * 6]) == [("H", 240), ("H", 120)]
    assert sizes([para(150), para(400)]) == [(None, 150), (None, 400)]
    assert sizes([]) == []
    first = chunks.chunked(spark.createDataFrame([("u", "T", [{"kind": "heading", "text": "H"}, para(3)])], f"url string, title string, blocks {kind}")).first()
    assert first["text"] == "T — H\n\nw w w" and first["chunk_id"] == "u#0"


def test_html_blocks():
    page = "<html><head><title> T </title></head><body><nav>menu</nav><main id='main-content'><div class='social-media'>x</div><h2>Care &amp; help</h2><p><strong>Label</strong></p><p>See <b>this</b> now<p>next</p><h3>care &amp; HELP</h3></main></body></html>"
    title, found = html.blocks(page, "u")
    assert title == "T"
    assert [(b["kind"], b["text"]) for b in found] == [("heading", "Care & help"), ("heading", "Label"), ("text", "See"), ("text", "this"), ("text", "now"), ("text", "next"), ("text", "care & HELP")]
    assert html.blocks(None, "u") == ("u", [])


def index(spark, texts):
    df = spark.createDataFrame([(i, f"https://x.org/{u}", u, t) for i, (u, t) in enumerate(texts)], "k int, url string, title string, text string")
    return retrieval.build(retrieval.corpus(df, "k", "url", "title", "text"))


PAGES = [("contact", "contact the office by phone"), ("mission", "our mission and research work"), ("care-network", "clinical care network of clinics"), ("event", "family gathering event with research")]


def test_retrieval_pads_with_zero_scores(spark):
    idx = index(spark, PAGES)
    q = spark.createDataFrame([(1, "contact office"), (2, "quarterly earnings"), (3, "the and of")], "query_id int, query string")
    got = {(r["query_id"], r["rank"]): (r["ord"], r["score"]) for r in retrieval.search(idx, q, 3).collect()}
    assert got[1, 1][0] == 0 and got[1, 1][1] > 0
    assert [got[2, r] for r in (1, 2, 3)] == [(0, 0.0), (1, 0.0), (2, 0.0)]
    assert not any(k[0] == 3 for k in got)
    assert {r["query_id"]: r["coverage"] for r in retrieval.coverage(idx, q).collect()} == {1: 1.0, 2: 0.0, 3: 0.0}


ADVICE = ["Should I change my child's seizure medication?", "What dose of aspirin should she take?", "my daughter's eye looks cloudy, is that normal?", "Will my son get worse?", "is it safe to stop the drug"]
PLAIN = ["How do I contact the foundation?", "What is the best pizza recipe in Chicago?", "Where is the mission page?"]


@pytest.mark.parametrize("question,advice", [(q, True) for q in ADVICE] + [(q, False) for q in PLAIN])
def test_advice(spark, question, advice):
    assert one(spark, question, routing.asks_advice) is advice


def test_routing_end_to_end(spark):
    q = spark.createDataFrame([(1, ADVICE[0]), (2, "contact office phone"), (3, "best pizza recipe"), (4, None)], "query_id int, query string")
    got = {r["query_id"]: r for r in routing.answers(index(spark, PAGES), q).collect()}
    assert [got[i]["kind"] for i in (1, 2, 3, 4)] == ["refusal", "answer", "escalation", "escalation"]
    assert got[2]["citations"][0]["url"] == "https://x.org/contact" and "contact the office" in got[2]["text"]
    assert "https://x.org/care-network" in got[1]["text"]


def test_citation_check(spark):
    df = spark.createDataFrame([("See https://a.b/c).", ["https://a.b/c"]), ("See https://a.b/d", ["https://a.b/c"]), ("none", ["https://a.b/c"])], "t string, r array<string>")
    assert [r[0] for r in df.select(routing.citation_check(F.col("t"), F.col("r"))).collect()] == ["answer", "escalation", "escalation"]


def test_manifest_diff(spark):
    listed = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "url string, sha256 string")
    held = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "url string, sha256 string")
    assert {r["url"]: r["reason"] for r in tables.manifest_diff(listed, held).collect()} == {"b": "sha256 mismatch", "c": "missing from corpus on disk", "d": "on disk but not in manifest"}


def test_csv_by_declared_schema(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("id,v,s\n1,2.5, \n2,NA,x\n")
    schema = T.StructType().add("id", "long").add("v", "double").add("s", "string")
    assert [tuple(r) for r in tables.read_csv(spark, str(path), schema, "v", 2).collect()] == [(1, 2.5, " "), (2, None, "x")]
    with pytest.raises(ValueError):
        tables.read_csv(spark, str(path), schema, "absent")
    with pytest.raises(ValueError):
        tables.read_csv(spark, str(path), schema, rows=3)


def test_models_learn(spark):
    df = spark.range(400).select("id", (F.col("id") % 2).cast("double").alias("x"), F.rand(1).alias("noise"), (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 5 % 2).cast("int").alias("fold"), F.lit(1.0).alias("amount"))
    scores = models.cross_validate(spark, [models.Spec("dummy"), models.Spec("logistic", True, {"C": (1.0,)})], df, ["x", "noise"], "y", "fold", 2)
    best = {r["model"]: r["mean_score"] for r in models.best_points(scores).collect()}
    assert best["logistic"] > 0.99 > best["dummy"]


def test_only_one_function_reads_the_test_rows():
    tree = ast.parse(Path(models.__file__).read_text())
    takers = [f.name for f in tree.body if isinstance(f, ast.FunctionDef) and "test" in [a.arg for a in f.args.args]]
    assert takers == ["fit_predict", "evaluate_once"]


def test_every_user_turn_is_classified(spark, tmp_path):
    import re

    import duckdb

    from amberline.operators import routing
    from amberline.plans import catalogue

    texts = [
        "My daughter\u2019s rash \u2014 is it serious?", "\u00bfQu\u00e9 dosis? Which dose is right", "caf\u00e9 hours?", "the \u00e9dose of it", "dose\u00e9", "is it safe \u2013 really", "HOW LONG do people LIVE \u2026",
        "we have a na\u00efve question", "we have pain \u2013 much", "will she get worse\u2026", "dosage\u00a0of it", "plain words", "my baby has a fever", "", None,
    ]
    rows = [(k, 0, "user", t) for k, t in enumerate(texts)] + [(99, 1, "assistant", "which dose \u2013")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spoken = catalogue.QUERIES["classify_advice"](spark, str(tmp_path)).where("origin = 'conversation'").collect()
    found = {r["a"]: r["advice"] for r in spoken}
    any_of = lambda patterns, t: any(re.search(p, t, re.IGNORECASE) for p in patterns)
    asks = lambda t: any_of(routing.DIRECT, t) or (any_of(routing.PERSON, t) and any_of(routing.CLINICAL, t))
    assert found == {k: asks(t or "") for k, t in enumerate(texts)}
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    rows = con.execute(f"select a, advice from ({catalogue.ORACLE_SQL['classify_advice']}) where origin = 'conversation'").fetchall()
    assert dict(rows) == found


def test_fold_summary_reads_all_orders(spark, sf):
    from amberline.plans import catalogue, decision_queries

    p = {}
    for r in decision_queries.scored(spark, sf).select("k", "p").collect():
        p.setdefault(f"m{r['k'] % 3}", []).append(r["p"])
    assert sum(map(len, p.values())) > 30
    found = {r["model"]: r["mean_score"] for r in catalogue.QUERIES["fold_summary"](spark, sf).collect()}
    assert found.keys() == p.keys() and all(abs(found[m] - sum(v) / len(v)) < 2e-6 for m, v in p.items())


def test_folds_are_stratified(spark, sf):
    from amberline.plans import decision_queries

    df = spark.createDataFrame([(k, int(k % 20 == 0)) for k in range(203)], "k long, y int")
    made = [features.stratified_folds(d, "y", "k", 5, 7) for d in (df, df.repartition(3))]
    assert sorted(map(tuple, made[0].collect())) == sorted(map(tuple, made[1].collect()))
    for own, y in ((made[0], "y"), (decision_queries._labelled(spark, sf).where("split = 'train'"), "quality")):
        n = {}
        for r in own.groupBy(y, "fold").count().collect():
            n.setdefault(r[y], []).append(r["count"])
        assert all(len(c) == 5 and max(c) - min(c) <= 1 for c in n.values())


def test_running_sums_beside_columns_of_any_name(spark):
    from amberline.operators.staging import running

    names = ["_part", "_n", "_r", "_S0", "_t0", "_l0", "__part"]
    df = spark.range(50).select("id", *(F.lit(f"{c}!").alias(c) for c in names))
    got = running(df, [F.desc("id")], {"total": F.col("id")}, "place").collect()
    assert all([r[c] for c in names] == [f"{c}!" for c in names] for r in got)
    assert {r["id"]: (r["place"], r["total"]) for r in got} == {k: (50 - k, sum(range(k, 50))) for k in range(50)}


def test_a_measure_is_not_split_by_class(spark):
    with pytest.raises(ValueError, match="not classes"):
        features.stratified_split(spark.range(1500), "id", "id")


def test_inventory_of_odd_values(spark):
    nan, schema = float("nan"), "k int, `a.b` string, f double, g float, l array<string>, s struct<x:int>, d date, y binary"
    day = datetime.date(2020, 2, 29)
    rows = [
        (1, " ", 0.0, 1.5, ["a, b"], (1,), day, b"\xff"), (2, "", -0.0, nan, ["a", "b"], (None,), day, b"\xfe"), (3, None, nan, nan, None, None, None, None), (3, "x", nan, None, [None], (1,), day, b"\xff"),
    ]
    df = spark.createDataFrame(rows, schema)
    got = {r["column"]: tuple(r)[1:] for r in profile.inventory(df).collect()}
    assert got == {
        "k": (0, "int", 4, 0.0, 0.0, 3), "a.b": (1, "string", 3, 25.0, 50.0, 3), "f": (2, "float", 4, 0.0, 0.0, 2), "g": (3, "float", 3, 25.0, 0.0, 2), "l": (4, "other", 3, 25.0, 0.0, 3),
        "s": (5, "other", 3, 25.0, 0.0, 2), "d": (6, "other", 3, 25.0, 0.0, 1), "y": (7, "other", 3, 25.0, 0.0, 2),
    }
    assert [tuple(r)[3:] for r in profile.inventory(df.limit(0), ["a.b"]).collect()] == [(0, None, None, 0)]
    wide = spark.range(50).select(*(F.col("id").alias(f"c{k}") for k in range(200)))
    plan = profile.inventory(wide)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (0, 50") == 1
    assert {(r["non_null"], r["n_unique"]) for r in profile.inventory(wide).collect()} == {(50, 50)}
