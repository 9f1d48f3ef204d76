"""The feature pipeline: what it refuses, what it learns from, what it stores."""

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from amberline.operators import pipeline


def frame(spark, n=120, **more):
    df = spark.range(n).select(
        F.col("id").alias("CONTROLN"), (F.col("id") % 3 == 0).cast("int").alias("TARGET_B"), (F.col("id") % 3 * 1.5).alias("TARGET_D"), F.when(F.col("id") % 4 != 0, F.col("id") * 1.0).alias("gift"), (F.col("id") % 9).alias("AGE"),
        (F.col("id") % 90 * 100 + F.col("id") % 15).alias("DOB"), F.when(F.col("id") % 2 == 0, 3.0).alias("RAMNT_5"), F.concat(F.lit("s"), (F.col("id") % 40).cast("string")).alias("state"), F.lit(5.0).alias("HH1"),
    )
    return df.withColumns({k: F.lit(v) for k, v in more.items()})


def policy(**more):
    return pipeline.PolicyFrame(**{"numeric": ["gift", "AGE"], "categorical": ["state"], "dates": ["DOB"], "ages": ["AGE"], "responses": r"RAMNT_(\d+)$", "censusCols": ["HH1"], "keep": ["_key", "_y", "_amount"]} | more)


def test_labels_and_amounts(spark):
    out = pipeline.labelled(frame(spark), "TARGET_B", "TARGET_D", "CONTROLN")
    assert not {"TARGET_B", "TARGET_D", "CONTROLN"} & set(out.columns) and dict(out.dtypes)["_y"] == "int" and dict(out.dtypes)["_amount"] == "double"
    with pytest.raises(ValueError, match="TARGET_D"):
        pipeline.labelled(frame(spark).drop("TARGET_D"), "TARGET_B", "TARGET_D", "CONTROLN")


def test_policy_refuses_leaks_and_gaps(spark):
    df = pipeline.labelled(frame(spark), "TARGET_B", "TARGET_D", "CONTROLN")
    with pytest.raises(ValueError, match="gift"):
        policy().fit(df.drop("gift"))
    with pytest.raises(ValueError, match="must not reach"):
        policy().fit(df.withColumn("TARGET_D", F.lit(1)))
    with pytest.raises(ValueError, match="leak"):
        policy().fit(df.withColumn("RAMNT_2", F.lit(1)))
    with pytest.raises(ValueError, match="HH1"):
        policy(census=True).fit(df.drop("HH1"))
    assert policy().numbers_out() == ["gift", "AGE", "DOB_months", "n_responses"] and policy(census=True).numbers_out()[-1] == "HH1"
    out = policy().fit(df).transform(df)
    assert out.columns == ["_key", "_y", "_amount", "gift", "AGE", "DOB_months", "n_responses", "state"]
    assert out.where("AGE <= 5").count() == 0 and out.agg(F.sum("n_responses")).first()[0] == 60


def vectors(model, df):
    return {r["_key"]: r["v"] for r in model.transform(df).select("_key", vector_to_array("features").alias("v")).collect()}


@pytest.mark.parametrize("scaled", [False, True])
def test_saved_and_read_again(spark, tmp_path, scaled):
    df = pipeline.labelled(frame(spark), "TARGET_B", "TARGET_D", "CONTROLN")
    made = pipeline.pipeline(policy(census=True), ["state"], {}, ["state"], scaled=scaled, learner=LogisticRegression(featuresCol="features", labelCol="_y", maxIter=5)).fit(df.where("_key < 80"))
    made.write().save(f"{tmp_path}/m")
    read = PipelineModel.load(f"{tmp_path}/m")
    rest = df.where("_key >= 80")
    assert vectors(read, rest) == vectors(made, rest) and len(vectors(made, rest)) == 40
    p = lambda m: {r["_key"]: tuple(r["probability"]) for r in m.transform(rest).collect()}
    assert p(read) == p(made)


def test_learned_numbers_do_not_move_with_other_rows(spark):
    df = pipeline.labelled(frame(spark), "TARGET_B", "TARGET_D", "CONTROLN")
    train, rest = df.where("_key < 80"), df.where("_key >= 80")
    made = pipeline.pipeline(policy(), ["state"], {}, ["state"], scaled=True).fit(train)
    one = vectors(made, rest.where("_key = 90"))
    assert one[90] == vectors(made, rest.withColumn("gift", F.when(F.col("_key") == 90, F.col("gift")).otherwise(1e9)))[90]


@pytest.mark.parametrize("levels", [3, 2500])
def test_levels_of_any_number(spark, levels):
    df = spark.range(30000).select("id", F.concat(F.lit("v"), (F.col("id") % levels).cast("string")).alias("c"))
    df = df.union(spark.createDataFrame([(-1, None), (-2, "once"), (-3, "twice"), (-4, "twice")], "id long, c string"))
    made = pipeline.LevelFlags(inputCols=["c"], outputCols=["f"], least=3).fit(df)
    names = made.stages[0].names("c")
    assert names == [*sorted(f"v{k}" for k in range(levels)), pipeline.INFREQUENT]  # null occurs once here
    other = spark.createDataFrame([(0, "v1"), (1, None), (2, "once"), (3, "new")], "id long, c string")
    got = {r["id"]: r["f"] for r in made.transform(other).collect()}
    assert all(v.size == levels + 1 for v in got.values()) and [list(got[k].indices) for k in range(4)] == [[names.index("v1")], [levels], [levels], [levels]]
    exact = pipeline.LevelFlags(inputCols=["c"], outputCols=["f"], least=3).fit(df.where("id >= 0"))
    assert {r["id"]: list(r["f"].indices) for r in exact.transform(other).collect()} == {0: [names.index("v1")], 1: [], 2: [], 3: []}
