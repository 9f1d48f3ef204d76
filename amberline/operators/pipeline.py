"""From raw columns to a fitted learner as one pipeline that can be saved and read again.

Each stage is an Estimator whose Model holds what the training rows taught it: a few numbers as params, and levels
of columns, of which there may be many, as a table beside the params. A fitted pipeline so never looks at the
rows that it is applied to, and the same object serves the validation rows, the test rows and later campaigns.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from amberline.functions.text import age_floor, blank_to_null, months_before
from amberline.operators import features
from amberline.operators.quantiles import quantiles
from amberline.operators.staging import running, staged

MISSING, INFREQUENT = "missing", "\x00infrequent"


def texts(name: str, doc: str) -> Any:
    return Param(Params._dummy(), name, doc, TypeConverters.toListString)


def numbers(name: str, doc: str) -> Any:
    return Param(Params._dummy(), name, doc, TypeConverters.toListFloat)


class Columns(Params):
    """``inputCols`` and the ``outputCols`` of the same places."""

    inputCols = texts("inputCols", "columns that are read")
    outputCols = texts("outputCols", "columns that are written, one for each that is read")

    def pairs(self) -> list[tuple[str, str]]:
        return list(zip(self.getOrDefault("inputCols"), self.getOrDefault("outputCols")))

    def given(self, **params: Any) -> Any:
        return self._set(**{k: v for k, v in params.items() if v is not None})


# labels and amounts


def labelled(df: DataFrame, target: str, amount: str, key: str, forbidden: tuple[str, ...] = features.FORBIDDEN) -> DataFrame:
    """Features without any forbidden column, and beside them ``_y`` (int), ``_amount`` (double) and ``_key``. An absent target or amount is an error here."""
    absent = [c for c in (target, amount) if c not in df.columns]
    if absent:
        raise ValueError(f"no columns {absent}")
    own = [c for c in df.columns if c not in {*forbidden, target, amount, key}]
    return df.select(*own, F.col(target).cast("int").alias("_y"), F.col(amount).cast("double").alias("_amount"), F.col(key).alias("_key"))


# policy


class Policy(Params):
    """Which raw columns become features, and how."""

    numeric = texts("numeric", "number columns taken as they are")
    categorical = texts("categorical", "text columns; blanks become null")
    dates = texts("dates", "YYMM columns that become months before the reference date, as <name>_months")
    ages = texts("ages", "numeric columns whose values at or below the floor are null")
    responses = Param(Params._dummy(), "responses", "pattern of the earlier campaigns' response columns, whose number becomes n_responses; empty: none", TypeConverters.toString)
    census = Param(Params._dummy(), "census", "whether the census block is taken", TypeConverters.toBoolean)
    censusCols = texts("censusCols", "columns of the census block")
    forbidden = texts("forbidden", "columns that must not reach a feature table")
    keep = texts("keep", "columns carried along: key, label, amount")
    responseCols = texts("responseCols", "response columns, as they were found when fitted")

    def defaults(self) -> None:
        self._setDefault(numeric=[], categorical=[], dates=[], ages=[], responses="", census=False, censusCols=[], forbidden=list(features.FORBIDDEN), keep=[], responseCols=[])

    def numbers_out(self) -> list[str]:
        """The number columns that come out, in order."""
        of = self.getOrDefault
        block = of("censusCols") if of("census") else []
        return [*of("numeric"), *(f"{c}_months" for c in of("dates")), *(["n_responses"] if of("responses") else []), *block]


class PolicyFrame(Estimator, Policy, DefaultParamsReadable, DefaultParamsWritable):
    """Selects, cleans and derives columns; row by row, so fitting only resolves names.

    Fitting raises if a column of the policy is absent, if a forbidden one is present, or if a response column
    belongs to the campaign that is predicted.
    """

    @keyword_only
    def __init__(self, *, numeric=None, categorical=None, dates=None, ages=None, responses=None, census=None, censusCols=None, forbidden=None, keep=None):
        super().__init__()
        self.defaults()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> PolicyFrameModel:
        of = self.getOrDefault
        needed = [*of("numeric"), *of("categorical"), *of("dates"), *of("keep"), *(of("censusCols") if of("census") else [])]
        absent = [c for c in needed if c not in df.columns]
        if absent:
            raise ValueError(f"the policy needs {len(absent)} columns that the table does not have: {absent[:10]}")
        leaks = [c for c in of("forbidden") if c in df.columns]
        if leaks:
            raise ValueError(f"{leaks} must not reach a feature table")
        found = features.response_columns(df.columns, of("responses")) if of("responses") else []
        return self._copyValues(PolicyFrameModel())._set(responseCols=found)


class PolicyFrameModel(Model, Policy, DefaultParamsReadable, DefaultParamsWritable):
    def __init__(self) -> None:
        super().__init__()
        self.defaults()

    def _transform(self, df: DataFrame) -> DataFrame:
        of = self.getOrDefault
        number = lambda c: F.col(c).cast("double")
        out: list[Column] = [F.col(c) for c in of("keep")]
        out += [(age_floor(number(c)) if c in of("ages") else number(c)).alias(c) for c in of("numeric")]
        out += [months_before(F.col(c)).cast("double").alias(f"{c}_months") for c in of("dates")]
        if of("responses"):
            none = F.lit(0.0)
            out.append((features.non_null_count(of("responseCols")).cast("double") if of("responseCols") else none).alias("n_responses"))
        out += [number(c).alias(c) for c in of("censusCols") if of("census")]
        return df.select(*out, *(blank_to_null(F.col(c).cast("string")).alias(c) for c in of("categorical")))


# numbers


class Medians(Estimator, Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Exact medians of the training rows in the place of nulls; a column without any value becomes 0."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super().__init__()
        self.given(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> MediansModel:
        found = quantiles(df, [c for c, _ in self.pairs()], [0.5])
        return self._copyValues(MediansModel())._set(values=[found[c][0] or 0.0 for c, _ in self.pairs()])


class MediansModel(Model, Columns, DefaultParamsReadable, DefaultParamsWritable):
    values = numbers("values", "median of each input")

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({o: F.coalesce(F.col(c).cast("double"), F.lit(v)) for (c, o), v in zip(self.pairs(), self.getOrDefault("values"))})


class Standardizer(Estimator, Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Mean 0 and population deviation 1 over the training rows; a constant column becomes 0."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super().__init__()
        self.given(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> StandardizerModel:
        fitted = features.Scaler.fit(df, [c for c, _ in self.pairs()]).values
        own = [fitted[c] for c, _ in self.pairs()]
        return self._copyValues(StandardizerModel())._set(means=[m or 0.0 for m, _ in own], deviations=[s or 1.0 for _, s in own])


class StandardizerModel(Model, Columns, DefaultParamsReadable, DefaultParamsWritable):
    means = numbers("means", "mean of each input")
    deviations = numbers("deviations", "population deviation of each input, 1 where there is none")

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({o: (F.col(c) - F.lit(m)) / F.lit(s) for (c, o), m, s in zip(self.pairs(), self.getOrDefault("means"), self.getOrDefault("deviations"))})


class Ordinal(Model, Columns, DefaultParamsReadable, DefaultParamsWritable):
    """The place of a level in a stated ``order``; null for null and for unknown levels. Learns nothing."""

    order = texts("order", "levels from the lowest")

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, order=None):
        super().__init__()
        self.given(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({o: features.ordinal(c, self.getOrDefault("order")).cast("double") for c, o in self.pairs()})


# levels


class TableWriter(MLWriter):
    def __init__(self, stage: LevelsModel):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession)
        self.stage.table.write.parquet(f"{path}/levels")


class TableReader(MLReader):
    def __init__(self, kind: type):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> LevelsModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        stage = self.kind()
        stage._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(stage, metadata)
        stage.table = self.sparkSession.read.schema(stage.SCHEMA).parquet(f"{path}/levels")
        return stage


class LevelsModel(Model, Columns, MLReadable, MLWritable):
    """A table ``column, level, value`` of any size, joined to the rows by level; Catalyst broadcasts it where it is small."""

    SCHEMA = "column string, level string, value double"
    table: DataFrame

    def write(self) -> TableWriter:
        return TableWriter(self)

    @classmethod
    def read(cls) -> TableReader:
        return TableReader(cls)

    def looked_up(self, df: DataFrame, level: dict[str, Column], other: dict[str, Column]) -> DataFrame:
        for c, o in self.pairs():
            own = self.table.where((F.col("column") == c) & F.col("level").isNotNull()).select(F.col("level").alias("_level"), F.col("value").alias("_value"))
            df = df.withColumn("_own", level[c]).join(own, F.col("_own") == F.col("_level"), "left").withColumn(o, F.coalesce("_value", other[c])).drop("_own", "_level", "_value")
        return df


class Frequencies(Estimator, Columns, DefaultParamsReadable, DefaultParamsWritable):
    """The share of a level among the training rows that have one; 0 for unseen levels and for null."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super().__init__()
        self.given(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> FrequenciesModel:
        tables = [features.frequency_table(df, c).select(F.lit(c).alias("column"), F.col("level").cast("string").alias("level"), F.col("share").alias("value")) for c, _ in self.pairs()]
        model = self._copyValues(FrequenciesModel())
        model.table = staged(reduce(DataFrame.unionByName, tables), "levels")
        return model


class FrequenciesModel(LevelsModel):
    def _transform(self, df: DataFrame) -> DataFrame:
        return self.looked_up(df, {c: F.col(c).cast("string") for c, _ in self.pairs()}, {c: F.lit(0.0) for c, _ in self.pairs()})


class LevelIndex(Estimator, Columns, DefaultParamsReadable, DefaultParamsWritable):
    """The place of a level among those of ``least`` training rows or more, in order of their names.

    Null is the level "missing". Levels under ``least`` share the place after the last; unseen levels go there too
    if there were any, and else to a place of their own that an encoder takes for no level at all. Names may be as
    many as there are rows: places come from a distributed order, and the table is stored with the model.
    """

    least = Param(Params._dummy(), "least", "training rows that a level needs for a place of its own", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, least=None):
        super().__init__()
        self._setDefault(least=10)
        self.given(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> LevelIndexModel:
        tables, sizes, rare = [], [], []
        for c, _ in self.pairs():
            counts = df.groupBy(F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias("level")).agg(F.count(F.lit(1)).alias("n"))
            counts = staged(counts.withColumn("kept", F.col("n") >= self.getOrDefault("least")), "levels")
            tables.append(running(counts.where("kept").select("level"), [F.asc("level")], {}, "k").select(F.lit(c).alias("column"), "level", (F.col("k") - 1).cast("double").alias("value")))
            kept, others = counts.agg(F.count_if("kept"), F.count_if(~F.col("kept"))).first()
            sizes.append(float(kept))
            rare.append(float(others > 0))
        model = self._copyValues(LevelIndexModel())._set(sizes=sizes, rare=rare)
        model.table = staged(reduce(DataFrame.unionByName, tables), "levels")
        return model


class LevelIndexModel(LevelsModel):
    sizes = numbers("sizes", "levels of each input that have a place of their own")
    rare = numbers("rare", "1 where there were rarer levels")

    def _transform(self, df: DataFrame) -> DataFrame:
        level = {c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for c, _ in self.pairs()}
        return self.looked_up(df, level, {c: F.lit(n) for (c, _), n in zip(self.pairs(), self.getOrDefault("sizes"))})

    def names(self, column: str) -> list[str]:
        """Names of a column's places, for reports; as many as there are."""
        k = [c for c, _ in self.pairs()].index(column)
        own = [r["level"] for r in self.table.where(F.col("column") == column).orderBy("value").select("level").collect()]
        return own + [INFREQUENT] * bool(self.getOrDefault("rare")[k])


class Flags(Estimator, Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Sparse 0/1 vectors of the places of levels, by Spark's own encoder: a fit of ``LevelIndex`` says how many places there are."""

    widths = numbers("widths", "places of each input")

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, widths=None):
        super().__init__()
        self.given(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> Model:
        encoder = OneHotEncoder(inputCols=self.getOrDefault("inputCols"), outputCols=self.getOrDefault("outputCols"), dropLast=True, handleInvalid="keep")
        spark, widths = df.sparkSession, self.getOrDefault("widths")
        fields = T.StructType([T.StructField(c, T.DoubleType()) for c, _ in self.pairs()])
        return encoder.fit(spark.createDataFrame([tuple(max(w - 1, 0.0) for w in widths)], fields))


# the whole


def preprocessing(numeric: list[str], categorical: list[str] = (), ordinal: dict[str, list[str]] | None = None, frequency: list[str] = (), scaled: bool = False, least: int = 10) -> list[Any]:
    """Stages from cleaned columns to the vector ``features``: numbers, flags, places, shares, in this order."""
    stages, parts = [Medians(inputCols=list(numeric), outputCols=[f"{c}_filled" for c in numeric])], [f"{c}_filled" for c in numeric]
    if categorical:
        stages.append(LevelFlags(inputCols=list(categorical), outputCols=[f"{c}_flags" for c in categorical], least=least))
    places = []
    for c, order in (ordinal or {}).items():
        stages += [Ordinal(inputCols=[c], outputCols=[f"{c}_place"], order=order), Medians(inputCols=[f"{c}_place"], outputCols=[f"{c}_filled"])]
        places.append(f"{c}_filled")
    shares = [f"{c}_share" for c in frequency]
    if shares:
        stages.append(Frequencies(inputCols=list(frequency), outputCols=shares))
    if scaled:
        unscaled = [*parts, *places, *shares]
        stages.append(Standardizer(inputCols=unscaled, outputCols=[f"{c}_scaled" for c in unscaled]))
        parts, places, shares = ([f"{c}_scaled" for c in some] for some in (parts, places, shares))
    return [*stages, VectorAssembler(inputCols=[*parts, *(f"{c}_flags" for c in categorical), *places, *shares], outputCol="features")]


class LevelFlags(Estimator, Columns, DefaultParamsReadable, DefaultParamsWritable):
    """``LevelIndex`` and ``Flags`` as one fitted pipeline."""

    least = LevelIndex.least

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, least=None):
        super().__init__()
        self._setDefault(least=10)
        self.given(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> Model:
        at = [f"{o}_at" for _, o in self.pairs()]
        index = LevelIndex(inputCols=self.getOrDefault("inputCols"), outputCols=at, least=self.getOrDefault("least")).fit(df)
        widths = [n + r for n, r in zip(index.getOrDefault("sizes"), index.getOrDefault("rare"))]
        return PipelineModel([index, Flags(inputCols=at, outputCols=self.getOrDefault("outputCols"), widths=widths).fit(df)])


def pipeline(policy: PolicyFrame, categorical: list[str] = (), ordinal: dict[str, list[str]] | None = None, frequency: list[str] = (), scaled: bool = False, learner: Any = None) -> Pipeline:
    """Policy, preprocessing and, if given, a Spark ML learner, fitted by one call on one table."""
    return Pipeline(stages=[policy, *preprocessing(policy.numbers_out(), categorical, ordinal, frequency, scaled), *([learner] if learner is not None else [])])
