"""Binary classifiers on MLlib: preparation, estimators, evaluation, storage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave import presets
from tallyweave.functions.columns import containing, present, quoted, starting, with_label
from tallyweave.functions.expressions import as_double
from tallyweave.operators import trees
from tallyweave.operators.catalog import leaf_sources
from tallyweave.operators.indexing import FrequencyIndexer
from tallyweave.sources.workspace import shared_folder, stored

# --- Fixed values: estimator settings ------------------------------------------------

SETTINGS = {
    "basic": {
        "RandomForest": {"numTrees": 20, "maxDepth": 10},
        "GradientBoosting": {"maxIter": 20, "maxDepth": 10},
        "LogisticRegression": {"maxIter": 20, "regParam": 0.01},
    },
    "tuned": {
        "RandomForest": {"numTrees": 50, "maxDepth": 15, "maxBins": 32, "minInstancesPerNode": 10},
        "GradientBoosting": {"maxIter": 50, "maxDepth": 10, "stepSize": 0.1},
        "LogisticRegression": {"maxIter": 100, "regParam": 0.01, "elasticNetParam": 0.1},
    },
}
GRIDS = {
    "RandomForest": {"numTrees": [20, 50], "maxDepth": [10, 15], "minInstancesPerNode": [5, 10]},
    "GradientBoosting": {"maxIter": [20, 50], "maxDepth": [5, 10], "stepSize": [0.05, 0.1]},
    "LogisticRegression": {"regParam": [0.001, 0.01, 0.1], "elasticNetParam": [0.0, 0.1, 0.5]},
}
ESTIMATORS = {
    "RandomForest": RandomForestClassifier,
    "GradientBoosting": GBTClassifier,
    "LogisticRegression": LogisticRegression,
}
SEEDED = ("RandomForest", "GradientBoosting")

# --- preparation ---------------------------------------------------------------------------


def class_sizes(df: DataFrame, target: str) -> DataFrame:
    return df.groupBy(F.col(quoted(target)).alias("label")).agg(F.count("*").alias("rows"))


def class_summary(df: DataFrame, target: str) -> DataFrame:
    """One row: classes and rows of the smallest class."""
    return class_sizes(df, target).agg(F.count("*").alias("classes"), F.min("rows").alias("smallest_class"))


def training_data(df: DataFrame, target: str, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The available features and the target as ``label``; rows without a target drop out.

    Numbers held as text become numbers. ``keep`` names columns to carry along, such as the
    key of the split.
    """
    names = list(dict.fromkeys([*present(df, keep), *present(df, features), target]))
    text = {c for c, t in df.dtypes if t == "string"}
    items = [
        as_double(c).alias(c) if c in presets.NUMERIC_TEXT and c in text and c not in keep else F.col(quoted(c))
        for c in names
    ]
    return with_label(df.select(*items).filter(F.col(quoted(target)).isNotNull()), target)


def prepared(
    df: DataFrame,
    target: str,
    features: Sequence[str],
    keep: Sequence[str] = (),
    min_class: int = presets.MIN_CLASS_ROWS,
) -> tuple[DataFrame, list[str]]:
    """Training data and its features; raises if they cannot train a classifier."""
    available = present(df, features)
    if not available:
        raise ValueError(f"no features available for {target}")
    if target not in df.columns:
        raise ValueError(f"no target column {target}")
    data = training_data(df, target, available, keep)
    sizes = class_summary(data, "label").first()
    if sizes.classes < 2:
        raise ValueError(f"{target} has fewer than two classes")
    if sizes.smallest_class < min_class:
        raise ValueError(f"smallest class of {target} has {sizes.smallest_class} rows")
    return data, available


def by_type(df: DataFrame, features: Sequence[str]) -> tuple[list[str], list[str]]:
    """Numeric and text features."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    numeric = [c for c in features if isinstance(kinds[c], (T.NumericType, T.BooleanType))]
    return numeric, [c for c in features if isinstance(kinds[c], T.StringType)]


def unit_hash(keys: Sequence[str]) -> Column:
    """Even number in [0, 1) fixed by the key, whatever the order or partition of the rows."""
    text = F.concat_ws("|", *[F.coalesce(F.col(quoted(k)).cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def hash_split(
    df: DataFrame, keys: Sequence[str], share: float = presets.TRAIN_SHARE
) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by the hash of the key; the same on every run."""
    return df.filter(unit_hash(keys) < share), df.filter(unit_hash(keys) >= share)


def spread_rows(df: DataFrame) -> DataFrame:
    """The rows, held, in as many partitions as their number keeps busy, for fits that pass over them many times.

    A scan makes partitions by the size of its files: a narrow table of millions of rows may come in two.
    A pass over few rows costs more to start in many tasks than it takes in one.
    """
    found = df.persist()
    rows, parts = found.count(), found.rdd.getNumPartitions()
    wanted = fit_partitions(rows, df.sparkSession.sparkContext.defaultParallelism)
    if wanted <= parts <= 2 * wanted:
        return found
    dealt = (found.coalesce(wanted) if wanted < parts else found.repartition(wanted)).persist()
    dealt.count()
    found.unpersist()
    return dealt


def fit_partitions(rows: int, cores: int) -> int:
    """One partition per 10,000 rows up to one a core; more only to keep them below 500,000 rows."""
    return max(1, min(cores, rows // 10_000), -(-rows // 500_000))


# --- feature selection -------------------------------------------------------------------------


def target_columns(df: DataFrame, limit: int | None = None) -> list[str]:
    return starting(df.columns, ["target_"], limit)


def _usable(columns: Sequence[str], target: str | None) -> list[str]:
    """Columns that are no target, no row key and share no source with the target."""
    leaking = leaf_sources(target) if target else set()
    return [
        c
        for c in columns
        if not c.startswith("target_") and c not in presets.WIDE_TABLE_KEYS and not leaf_sources(c) & leaking
    ]


def benchmark_features(df: DataFrame, target: str | None = None) -> list[str]:
    columns = _usable(df.columns, target)
    found = [c for terms in presets.BENCHMARK_FEATURES for c in containing(columns, terms)]
    return list(dict.fromkeys(found))[: presets.BENCHMARK_FEATURE_LIMIT]


def baseline_features(df: DataFrame, target: str | None = None) -> list[str]:
    return containing(_usable(df.columns, target), presets.BASELINE_FEATURES)


def automated_features(df: DataFrame, target: str | None = None) -> list[str]:
    return starting(_usable(df.columns, target), presets.AUTOMATED_FEATURES)


def ensemble_features(df: DataFrame, target: str | None = None) -> list[str]:
    columns = _usable(df.columns, target)
    found = [c for terms, limit in presets.ENSEMBLE_FEATURES for c in starting(columns, terms, limit)]
    return list(dict.fromkeys(found))


def relevant_features(df: DataFrame, target: str) -> list[str]:
    """Up to ten derived and five other columns, without keys, codes and targets."""
    excluded = [*presets.EXCLUDED_FEATURES, presets.CODE_SUFFIX]
    columns = [c for c in _usable(df.columns, target) if not any(p in c for p in excluded)]
    first = starting(columns, presets.PRIORITY_FEATURES)
    rest = [c for c in columns if c not in first]
    return first[: presets.PRIORITY_FEATURE_LIMIT] + rest[: presets.SECONDARY_FEATURE_LIMIT]


# --- estimators -----------------------------------------------------------------------------------


def feature_stages(numeric: Sequence[str], text: Sequence[str]) -> list:
    """Number texts by frequency, assemble, scale to unit deviation. Rows with unseen or null values drop out."""
    indexed = [f"{c}_indexed" for c in text]
    stages = []
    if text:
        stages.append(FrequencyIndexer(list(text), indexed))
    stages.append(VectorAssembler(inputCols=[*numeric, *indexed], outputCol="features", handleInvalid="skip"))
    stages.append(StandardScaler(inputCol="features", outputCol="scaled_features", withStd=True, withMean=False))
    return stages


def chosen(model_type: str, settings: str | Mapping) -> dict:
    return dict((SETTINGS[settings] if isinstance(settings, str) else settings)[model_type])


def classifier(model_type: str, settings: str | Mapping = "basic", suffix: str = "") -> Estimator:
    """Estimator of the named type; ``suffix`` ends the names of its output columns."""
    if model_type not in ESTIMATORS:
        raise ValueError(f"unknown model type: {model_type}")
    params = chosen(model_type, settings) | ({"seed": presets.SEED} if model_type in SEEDED else {})
    est = ESTIMATORS[model_type](
        featuresCol="scaled_features", labelCol="label", predictionCol=f"prediction{suffix}", **params
    )
    return est.setRawPredictionCol(f"rawPrediction{suffix}").setProbabilityCol(f"probability{suffix}")


def model_pipeline(
    df: DataFrame, features: Sequence[str], model_type: str, settings: str | Mapping = "basic"
) -> Pipeline:
    numeric, text = by_type(df, features)
    return Pipeline(stages=[*feature_stages(numeric, text), classifier(model_type, settings)])


def fitted(train: DataFrame, features: Sequence[str], model_type: str, settings: str | Mapping = "basic") -> PipelineModel:
    """The fitted :func:`model_pipeline`; what its feature stages make of the rows is held while the classifier is fitted."""
    *first, last = model_pipeline(train, features, model_type, settings).getStages()
    stages = Pipeline(stages=first).fit(train)
    ready = spread_rows(stages.transform(train).select("label", "scaled_features"))
    try:
        return PipelineModel([*stages.stages, *_fits(ready, {model_type: last}, settings).values()])
    finally:
        ready.unpersist()


def _fits(ready: DataFrame, estimators: Mapping[str, Estimator], settings: str | Mapping) -> dict[str, Model]:
    """Models of one set of rows by type; trees grow from the counted rows of a large table where they can."""
    known = {m for m in estimators if trees.fits(m, chosen(m, settings))}
    found = trees.counts(ready) if known else None
    try:
        return {
            m: trees.fitted(found, e, m, chosen(m, settings), presets.SEED) if found and m in known else e.fit(ready)
            for m, e in estimators.items()
        }
    finally:
        if found:
            found.release()


def cuts_lineage(spark: SparkSession) -> None:
    """Let iterative estimators checkpoint into the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


# --- tuning and evaluation ----------------------------------------------------------------------------


def auc_evaluator(raw: str = "rawPrediction") -> BinaryClassificationEvaluator:
    return BinaryClassificationEvaluator(labelCol="label", rawPredictionCol=raw, metricName="areaUnderROC")


def rank_auc(df: DataFrame, score: str, label: str = "label") -> DataFrame:
    """One row: ``auc``, the share of pairs of a positive and a negative row that the score puts in order.

    Ties count half. The rows are counted per score; the scores are range-partitioned and each partition
    starts from the negatives of those before it, so any number of distinct scores is exact.
    Rows without a score or a label take no part; a table of one class has no value.
    """
    known = df.where(F.col(quoted(score)).isNotNull() & F.col(quoted(label)).isin(0, 1))
    groups = known.groupBy(F.col(quoted(score)).alias("score")).agg(
        F.sum((F.col(quoted(label)) == 1).cast("long")).alias("positive"),
        F.sum((F.col(quoted(label)) == 0).cast("long")).alias("negative"),
    )
    placed = stored(groups.repartitionByRange("score").withColumn("part", F.spark_partition_id()), "scores")
    # one row a partition
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("part").agg(F.sum("negative").alias("own"))
    parts = parts.select("part", F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("earlier"))
    lower = Window.partitionBy("part").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    below = placed.withColumn("lower", F.coalesce(F.sum("negative").over(lower), F.lit(0))).join(F.broadcast(parts), "part")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    ordered = wide("positive") * (2 * (wide("lower") + wide("earlier")) + wide("negative"))
    sums = below.agg(F.sum(ordered).cast("double").alias("twice"), *[F.sum(c).cast("double").alias(c) for c in ("positive", "negative")])
    return sums.select(F.try_divide("twice", 2 * F.col("positive") * F.col("negative")).alias("auc"))


def accuracy_evaluator(prediction: str = "prediction") -> MulticlassClassificationEvaluator:
    return MulticlassClassificationEvaluator(labelCol="label", predictionCol=prediction, metricName="accuracy")


def scores(predictions: DataFrame, raw: str = "rawPrediction", prediction: str = "prediction") -> tuple[float, float]:
    """AUC and accuracy."""
    return auc_evaluator(raw).evaluate(predictions), accuracy_evaluator(prediction).evaluate(predictions)


def assembled_names(model: PipelineModel) -> list[str]:
    """Feature names in the order of the assembled vector."""
    assembler = next(s for s in model.stages if isinstance(s, VectorAssembler))
    return [c.removesuffix("_indexed") for c in assembler.getInputCols()]


def feature_importance(model: PipelineModel) -> list[tuple[str, float]]:
    """Importance per feature of a tree model; empty for others."""
    last = model.stages[-1]
    if not hasattr(last, "featureImportances"):
        return []
    return list(zip(assembled_names(model), [float(x) for x in last.featureImportances.toArray()]))


# --- ensemble --------------------------------------------------------------------------------------------


def vote(predictions: Sequence[str], rule: str = "any") -> Column:
    """1.0 if any model, or more than half of them, predicts 1."""
    total = reduce(add, [F.col(quoted(p)) for p in predictions])
    if rule == "any":
        return F.when(total >= 1.0, 1.0).otherwise(0.0)
    if rule == "majority":
        return F.when(total > len(predictions) / 2, 1.0).otherwise(0.0)
    raise ValueError(f"unknown vote rule: {rule}")


@dataclass
class Ensemble:
    """Classifiers over shared feature stages. Scoring adds columns to a row, joins nothing."""

    stages: PipelineModel
    models: dict[str, Model]
    rule: str = "any"

    def score(self, df: DataFrame) -> DataFrame:
        out = self.stages.transform(df)
        for model in self.models.values():
            out = model.transform(out)
        names = [f"prediction_{m}" for m in self.models]
        positive = [F.element_at(vector_items(f"probability_{m}"), 2) for m in self.models]
        return out.withColumns(
            {
                "ensemble_prediction": vote(names, self.rule),
                "ensemble_probability": reduce(add, positive) / F.lit(len(positive)),
            }
        )


def vector_items(c: str) -> Column:
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(F.col(c))


def fit_ensemble(
    train: DataFrame,
    features: Sequence[str],
    settings: str | Mapping = "basic",
    model_types: Sequence[str] = ("RandomForest", "GradientBoosting"),
    rule: str = "any",
) -> Ensemble:
    cuts_lineage(train.sparkSession)
    numeric, text = by_type(train, features)
    stages = Pipeline(stages=feature_stages(numeric, text)).fit(train)
    ready = spread_rows(stages.transform(train).select("label", "scaled_features"))
    try:
        models = _fits(ready, {m: classifier(m, settings, f"_{m}") for m in model_types}, settings)
    finally:
        ready.unpersist()
    return Ensemble(stages, models, rule)


# --- storage ---------------------------------------------------------------------------------------------------


def save_model(model: PipelineModel, path: str, metadata: Mapping[str, str]) -> None:
    """Fitted pipeline under ``path/model`` and its metadata as one JSON row beside it."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    row = spark.createDataFrame([(dict(metadata),)], "metadata map<string,string>")
    row.coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict[str, str]]:
    row = spark.read.schema("metadata map<string,string>").json(f"{path}/metadata").first()
    return PipelineModel.load(f"{path}/model"), dict(row.metadata)
