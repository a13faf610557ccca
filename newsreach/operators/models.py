"""Features, regressors and their storage on Spark ML."""

from __future__ import annotations

import json
import time
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark import SparkContext
from pyspark.ml import PipelineModel
from pyspark.ml.base import Model
from pyspark.ml.feature import OneHotEncoder, OneHotEncoderModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import (
    GBTRegressionModel,
    GBTRegressor,
    LinearRegression,
    LinearRegressionModel,
    RandomForestRegressor,
)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsreach import constants as K
from newsreach.functions.scoring import clip01, fill_category
from newsreach.functions.text import presence_flag
from newsreach.operators.evaluate import melt_models, rmse, spearman
from newsreach.operators.forest import PartedForest
from newsreach.operators.splits import split_sizes
from newsreach.sources.workspace import kept_path, materialize, release, shared_dir

CATEGORIES = ("category", "place")

# Spark's own number of bins; class columns with more ids get one per id
LEAST_BINS = 32

# MB of the counts that one task of a forest's pass holds
FOREST_MEMORY = 512

# Nodes of a forest that are on the driver at once, at most; a tree has them all at once
FOREST_NODES = 200_000

# Seeds of a forest's parts lie apart, as Spark adds the number of a partition
PART_SEEDS = 1_000_003


def features(df: DataFrame, vector: str = "embedding", title: str = "title", out: str = "features") -> DataFrame:
    """Vector, category, place and presence flag as one ML vector, in this order (M1)."""
    prepared = df.withColumns(
        {
            "category": fill_category("category"),
            "place": fill_category("place"),
            "presence": presence_flag(title).cast("double"),
            "__vector": array_to_vector(F.transform(vector, lambda x: x.cast("double"))),
        }
    )
    inputs = ["__vector", *CATEGORIES, "presence"]
    return VectorAssembler(inputCols=inputs, outputCol=out).transform(prepared).drop("__vector")


@dataclass(frozen=True)
class Encoder:
    """One-hot encoder whose widths come from the training rows (M2)."""

    widths: Mapping[str, int]
    model: OneHotEncoderModel


def fit_encoder(train: DataFrame) -> Encoder:
    """Learn the largest id of each class column (M2)."""
    top = train.agg(*[F.max(fill_category(c)).alias(c) for c in CATEGORIES]).first()
    widths = {c: int(top[c]) + 1 for c in CATEGORIES}
    coded = [f"__{c}_code" for c in CATEGORIES]
    # fitting needs one row that holds the largest ids
    sizes = train.sparkSession.createDataFrame(
        [tuple(float(widths[c] - 1) for c in CATEGORIES)], coded
    )
    encoder = OneHotEncoder(inputCols=coded, outputCols=[f"__{c}_hot" for c in CATEGORIES], dropLast=False)
    return Encoder(widths, encoder.fit(sizes))


def encode(df: DataFrame, encoder: Encoder, vector: str = "embedding", title: str = "title", out: str = "dense") -> DataFrame:
    """Vector, one-hot classes and presence flag; ids above the training maximum count as the maximum (M2)."""
    codes = {
        f"__{c}_code": F.greatest(F.least(fill_category(c), F.lit(width - 1)), F.lit(0)).cast("double")
        for c, width in encoder.widths.items()
    }
    prepared = df.withColumns(
        {
            **codes,
            "__presence": presence_flag(title).cast("double"),
            "__vector": array_to_vector(F.transform(vector, lambda x: x.cast("double"))),
        }
    )
    hot = [f"__{c}_hot" for c in CATEGORIES]
    dense = VectorAssembler(inputCols=["__vector", *hot, "__presence"], outputCol=out).transform(
        encoder.model.transform(prepared)
    )
    return dense.drop("__vector", "__presence", *codes, *hot)


def with_nominal_classes(train: DataFrame, column: str = "features") -> tuple[DataFrame, int]:
    """The rows with class ids declared as unordered, and the number of bins that trees need for them.

    Ids must not be negative. Vectors are laid out as by ``features``: classes before the presence flag.
    """
    found = train.agg(
        F.max(F.size(vector_to_array(column))).alias("size"), *[F.max(c).alias(c) for c in CATEGORIES], F.min(F.least(*CATEGORIES)).alias("least")
    ).first()
    if found["size"] is None:
        raise ValueError("no train rows")
    if found["least"] < 0:
        raise ValueError("class ids must not be negative")
    first = found["size"] - len(CATEGORIES) - 1
    nominal = [{"idx": first + i, "name": c, "num_vals": int(found[c]) + 1} for i, c in enumerate(CATEGORIES)]
    layout = {"ml_attr": {"attrs": {"nominal": nominal}, "num_attrs": found["size"]}}
    bins = max(LEAST_BINS, *[n["num_vals"] for n in nominal])
    return train.withColumn(column, F.col(column).alias(column, metadata=layout)), bins


def best_round(errors: Sequence[float], patience: int) -> tuple[int, bool]:
    """Round (from 1) of the least error before ``patience`` rounds without a better one; whether that end is reached."""
    best = 0
    for place, error in enumerate(errors):
        if error < errors[best]:
            best = place
        elif place - best >= patience:
            return best + 1, True
    return best + 1, False


def first_trees(model: GBTRegressionModel, rounds: int) -> GBTRegressionModel:
    """The boosted model of the first ``rounds`` trees and their weights."""
    if rounds >= model.getNumTrees:
        return model
    context = SparkContext._active_spark_context
    trees, weights = model._java_obj.trees(), model.treeWeights
    kind = context._jvm.org.apache.spark.ml.regression
    kept = context._gateway.new_array(kind.DecisionTreeRegressionModel, rounds)
    shares = context._gateway.new_array(context._jvm.double, rounds)
    for place in range(rounds):
        kept[place], shares[place] = trees[place], float(weights[place])
    cut = kind.GBTRegressionModel(model.uid, kept, shares)
    for name in ("featuresCol", "labelCol", "predictionCol"):
        cut.set(cut.getParam(name), model._java_obj.getOrDefault(model._java_obj.getParam(name)))
    found = GBTRegressionModel(cut)
    found._transfer_params_from_java()
    return found


def fit_gbt(
    df: DataFrame, target: str = "pv_score", column: str = "features", rounds: int = K.BOOST_ROUNDS, depth: int = 5,
    patience: int = K.BOOST_PATIENCE,
) -> Model:
    """Gradient-boosted trees on the train rows, up to the round that is best on the validation rows.

    Fits of doubling length go on until ``patience`` rounds have brought nothing better or ``rounds`` are reached.
    The trees of a shorter fit are the first ones of a longer fit, so the model is the longest one cut behind the best
    round. Without validation rows all ``rounds`` are fitted.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        # the residuals' lineage grows with every round
        context.setCheckpointDir(shared_dir(df.sparkSession))
    train, bins = with_nominal_classes(df.where(F.col("split") == "train"), column)
    valid = df.where(F.col("split") == "valid")

    def boosted(length: int) -> Model:
        return GBTRegressor(
            featuresCol=column, labelCol=target, predictionCol="gbt", maxIter=length, maxDepth=depth, stepSize=K.BOOST_STEP,
            subsamplingRate=K.BOOST_SUBSAMPLE, featureSubsetStrategy=K.BOOST_FEATURES, minInstancesPerNode=K.BOOST_MIN_LEAF,
            maxBins=bins, seed=K.SEED,
        ).fit(train)

    if valid.isEmpty():
        return boosted(rounds)
    length = min(rounds, patience + max(1, patience // 4))
    while True:
        model = boosted(length)
        best, ended = best_round(model.evaluateEachIteration(valid, "squared"), patience)
        if ended or length == rounds:
            return first_trees(model, best)
        length = min(rounds, 2 * length)


def forest_parts(rows: int, trees: int, depth: int) -> list[int]:
    """Trees of each part of a forest, so that no part has more than ``FOREST_NODES`` nodes if a tree has no more."""
    leaves = max(1, min(rows // K.FOREST_MIN_LEAF, 1 << depth))
    parts = -(-trees // max(1, FOREST_NODES // (2 * leaves)))
    return [trees // parts + (place < trees % parts) for place in range(parts)]


def fit_forest(
    df: DataFrame, target: str = "pv_score", column: str = "features", trees: int = K.FOREST_TREES, depth: int = 30
) -> Model | PartedForest:
    """Random forest on the train rows.

    The nodes that rows have reached are kept beside them, or every pass would send all trees to all tasks. Rows are dealt
    to all cores, and a pass splits as many nodes as ``FOREST_MEMORY`` holds. Spark grows and keeps the nodes on the
    driver, so a forest of more than ``FOREST_NODES`` is fitted and stored some trees at a time.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        # the lineage of the reached nodes grows with every level
        context.setCheckpointDir(shared_dir(df.sparkSession))
    train, bins = with_nominal_classes(df.where(F.col("split") == "train").select(column, target, *CATEGORIES), column)
    counts = forest_parts(train.count(), trees, depth)

    def grown(count: int, seed: int) -> Model:
        return RandomForestRegressor(
            featuresCol=column, labelCol=target, predictionCol="forest", numTrees=count, maxDepth=depth,
            featureSubsetStrategy=K.FOREST_FEATURES, minInstancesPerNode=K.FOREST_MIN_LEAF, maxBins=bins, seed=seed,
            cacheNodeIds=True, maxMemoryInMB=FOREST_MEMORY,
        ).fit(train.repartition(context.defaultParallelism))

    if len(counts) == 1:
        return grown(trees, K.SEED)
    paths = [kept_path(df.sparkSession, "forest-part") for _ in counts]
    for place, (path, count) in enumerate(zip(paths, counts)):
        grown(count, K.SEED + place * PART_SEEDS).save(path)
        release(df.sparkSession)
    return PartedForest(tuple(paths), tuple(counts), column, "forest")


def fit_ridge(
    df: DataFrame, target: str = "pv_score", column: str = "dense", alphas: Sequence[float] = K.RIDGE_ALPHAS
) -> tuple[LinearRegressionModel, float]:
    """Ridge regression; the penalty is the one with the lowest error on the validation rows.

    Spark divides the squared error by n and the target by its deviation (over n, not n - 1), hence the factor on alpha.
    """
    rows = materialize(df.where(F.col("split").isin("train", "valid")).select(column, target, "split"), "ridge-rows")
    train, valid = rows.where(F.col("split") == "train"), rows.where(F.col("split") == "valid")
    stats = train.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(target).alias("sd")).first()
    fitted: dict[float, LinearRegressionModel] = {}
    for alpha in alphas:
        fitted[alpha] = LinearRegression(
            featuresCol=column, labelCol=target, predictionCol="ridge", elasticNetParam=0.0,
            regParam=alpha * (stats["sd"] or 1.0) / max(stats["n"], 1), standardization=False,
        ).fit(train)
    # all candidates are compared in one pass over the validation rows
    scored = valid
    for i, model in enumerate(fitted.values()):
        scored = model.copy({model.predictionCol: f"__p{i}"}).transform(scored)
    names = [f"__p{i}" for i in range(len(fitted))]
    errors = {r["model"]: r["rmse"] for r in rmse(melt_models(scored, names, [target]), "pred", target, ["model"]).collect()}
    best = min(range(len(names)), key=lambda i: (errors.get(names[i], float("inf")), i))
    alpha = list(fitted)[best]
    return fitted[alpha], alpha


def predict(model: Model | PartedForest, df: DataFrame, out: str) -> DataFrame:
    """Predictions limited to 0..1."""
    return model.transform(df).withColumn(out, clip01(out))


def save_run(
    models: Mapping[str, Model | PartedForest], scored: DataFrame, path: str, meta: Mapping[str, object], target: str = "pv_score",
    encoder: Encoder | None = None,
) -> DataFrame:
    """Store fitted models below ``path`` with a table of run data, and give that table back.

    The one-hot ``encoder`` is stored with them, so that ``load_encoder`` makes new rows fit for the models.

    ``scored`` holds the predictions of every model and a ``split`` column; the table has the rank
    correlation of each model on the validation rows, split sizes, and ``meta``.
    """
    spark = scored.sparkSession
    for name, model in models.items():
        model.write().overwrite().save(f"{path}/{name}")
    if encoder is not None:
        encoder.model.write().overwrite().save(f"{path}/encoder")
        widths = spark.createDataFrame(list(encoder.widths.items()), "name string, width int")
        widths.coalesce(1).write.mode("overwrite").json(f"{path}/encoder-widths")
    valid = melt_models(scored.where(F.col("split") == "valid"), list(models), [target])
    quality = spearman(valid, "pred", target, ["model"]).select(
        F.concat(F.lit("valid_spearman_"), "model").alias("name"), F.col("spearman").cast("string").alias("value")
    )
    sizes = split_sizes(scored).select(F.concat(F.lit("rows_"), "split").alias("name"), F.col("rows").cast("string").alias("value"))
    given = spark.createDataFrame([(k, json.dumps(v)) for k, v in meta.items()], "name string, value string")
    quality.unionByName(sizes).unionByName(given).coalesce(1).write.mode("overwrite").json(f"{path}/meta")
    return spark.read.schema("name string, value string").json(f"{path}/meta")


def load_encoder(spark: SparkSession, path: str) -> Encoder:
    """Reload the encoder of a run stored below ``path``."""
    stored = {r["name"]: r["width"] for r in spark.read.schema("name string, width int").json(f"{path}/encoder-widths").collect()}
    return Encoder({c: stored[c] for c in CATEGORIES}, load_model(spark, f"{path}/encoder"))


def load_model(spark: SparkSession, path: str) -> Model | PartedForest:
    """Reload a stored model of any kind."""
    from pyspark.ml.util import DefaultParamsReader

    metadata = DefaultParamsReader.loadMetadata(path, spark)
    module, name = metadata["class"].rsplit(".", 1)
    classes = {
        "GBTRegressionModel": "pyspark.ml.regression", "RandomForestRegressionModel": "pyspark.ml.regression",
        "LinearRegressionModel": "pyspark.ml.regression", "OneHotEncoderModel": "pyspark.ml.feature",
        "PartedForest": "newsreach.operators.forest",
    }
    if name == "PipelineModel":
        return PipelineModel.load(path)
    loaded = __import__(classes[name], fromlist=[name])
    return getattr(loaded, name).load(path)


def timed(fit, *args, **kwargs) -> tuple[object, float]:
    """Result of a fit and its seconds, for the run data."""
    start = time.perf_counter()
    result = fit(*args, **kwargs)
    return result, time.perf_counter() - start
