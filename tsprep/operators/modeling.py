"""Training, search, comparison and prediction with Spark's regressors."""

from __future__ import annotations

import datetime as dt
import logging
import math
import random
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import (
    GBTRegressionModel,
    GBTRegressor,
    LinearRegression,
    LinearRegressionModel,
    RandomForestRegressionModel,
    RandomForestRegressor,
)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metrics import regression_metrics
from ..sources.sinks import register_model, registered_models

log = logging.getLogger(__name__)

# model name: estimator settings. L-BFGS leaves a history of steps; solver="normal" reads the
# samples once and leaves none. Early stop of the boosted trees comes from validationTol.
MODELS: dict[str, dict[str, Any]] = {
    "linear": {"regParam": 1e-5, "elasticNetParam": 0.0, "maxIter": 50, "solver": "l-bfgs"},
    "forest": {"numTrees": 20, "maxDepth": 6},
    "boosted": {"maxIter": 20, "maxDepth": 4, "stepSize": 0.1, "validationTol": 0.01},
}
# ranges of the random search: (kind, low, high)
SEARCH_SPACE: dict[str, dict[str, tuple[str, float, float]]] = {
    "linear": {"regParam": ("log", 1e-6, 1e-4), "elasticNetParam": ("uniform", 0.0, 1.0)},
    "forest": {"numTrees": ("int", 10, 40), "maxDepth": ("int", 3, 8)},
    "boosted": {
        "stepSize": ("log", 0.01, 0.3),
        "maxDepth": ("int", 2, 4),
        "subsamplingRate": ("uniform", 0.5, 0.9),
    },
}


def make_estimator(name: str, config: Mapping[str, Any] | None = None, seed: int = 42) -> Estimator:
    settings = {**MODELS[name], **(config or {})}
    common = dict(featuresCol="features", labelCol="target", predictionCol="predicted")
    if name == "linear":
        return LinearRegression(**common, **settings)
    if name == "forest":
        return RandomForestRegressor(**common, seed=seed, **settings)
    return GBTRegressor(**common, seed=seed, validationIndicatorCol="is_val", **settings)


def assemble(samples: DataFrame, features: Sequence[str]) -> DataFrame:
    """Add the feature vector. Rows with a missing feature stay, with a NULL vector."""
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in features])
    filled = samples.select(
        *[c for c in samples.columns if c not in features],
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features],
        complete.alias("__complete"),
    )
    vectors = VectorAssembler(inputCols=list(features), outputCol="__v").transform(filled)
    return vectors.withColumn("features", F.when(F.col("__complete"), F.col("__v"))).drop(
        "__v", "__complete", *features
    )


def _usable(assembled: DataFrame) -> DataFrame:
    return assembled.filter(F.col("features").isNotNull() & F.col("target").isNotNull())


def _training_rows(assembled: DataFrame, name: str) -> DataFrame:
    wanted = ["train", "val"] if name == "boosted" else ["train"]
    return (
        _usable(assembled)
        .filter(F.col("split").isin(wanted))
        .select("features", "target", (F.col("split") == "val").alias("is_val"))
    )


def train_model(
    assembled: DataFrame, name: str, config: Mapping[str, Any] | None = None, seed: int = 42
) -> Model:
    """Fit on the train rows; boosted trees also stop early on the val rows."""
    return make_estimator(name, config, seed).fit(_training_rows(assembled, name))


def predict(model: Model, assembled: DataFrame, split: str | None = "test") -> DataFrame:
    """Actual and predicted values; rows with missing features get a NULL prediction."""
    rows = assembled if split is None else assembled.filter(F.col("split") == split)
    known = model.transform(rows.filter(F.col("features").isNotNull()))
    unknown = rows.filter(F.col("features").isNull())
    unknown = unknown.withColumn("predicted", F.lit(None).cast("double"))
    both = known.unionByName(unknown)
    return both.drop("features").withColumnRenamed("target", "actual")


def evaluate(model: Model, assembled: DataFrame, split: str = "test") -> DataFrame:
    return regression_metrics(predict(model, assembled, split), "actual", "predicted")


def predictions(models: Sequence[Model], assembled: DataFrame) -> DataFrame:
    """Add ``predictions``, what each model gives for a row; NULL where a feature is missing.

    All models read a row in the same pass.
    """
    rows, names = assembled, [f"__p{i}" for i in range(len(models))]
    blank = F.lit(None).cast("array<double>")
    for model, name in zip(models, names):
        rows = model.copy().setFeaturesCol("features").setPredictionCol(name).transform(rows)
    return rows.withColumn(
        "predictions", F.when(F.col("features").isNotNull(), F.array(*names)).otherwise(blank)
    ).drop(*names)


def _staged_errors(model: RandomForestRegressionModel, assembled: DataFrame) -> DataFrame:
    """(step, split, value): the squared error of the forest's first trees, for each number of trees."""
    rows = _usable(assembled).filter(F.col("split").isin("train", "val"))
    sums = F.aggregate(
        "predictions",
        F.array().cast("array<double>"),
        lambda done, x: F.array_append(
            done, x + F.coalesce(F.get(done, F.size(done) - 1), F.lit(0.0))
        ),
    )
    staged = predictions(model.trees, rows).select("split", "target", F.posexplode(sums).alias("step", "sum"))
    error = F.col("target") - F.col("sum") / (F.col("step") + 1)
    return staged.groupBy("step", "split").agg(F.avg(error * error).alias("value"))


def training_history(model: Model, assembled: DataFrame, name: str) -> DataFrame:
    """(model, step, split, metric, value) per training step.

    Steps are the trees of boosted trees and forests, and the iterations of a linear model.
    """
    rows: list[tuple] = []
    if isinstance(model, GBTRegressionModel):
        for split in ("train", "val"):
            part = _usable(assembled).filter(F.col("split") == split).select("features", "target")
            losses = model.evaluateEachIteration(part, "squared")
            rows += [(name, i, split, "mse", float(v)) for i, v in enumerate(losses)]
    elif isinstance(model, RandomForestRegressionModel):
        errors = _staged_errors(model, assembled).orderBy("split", "step").collect()
        rows += [(name, r["step"], r["split"], "mse", r["value"]) for r in errors]
    elif isinstance(model, LinearRegressionModel) and model.hasSummary:
        steps = model.summary.objectiveHistory
        rows += [(name, i, "train", "objective", float(v)) for i, v in enumerate(steps)]
    schema = "model string, step int, split string, metric string, value double"
    return assembled.sparkSession.createDataFrame(rows, schema)


def draw_settings(name: str, n_trials: int, seed: int) -> list[dict[str, Any]]:
    rng = random.Random(seed)
    trials = []
    for _ in range(n_trials):
        drawn: dict[str, Any] = {}
        for parameter, (kind, low, high) in SEARCH_SPACE[name].items():
            if kind == "log":
                drawn[parameter] = math.exp(rng.uniform(math.log(low), math.log(high)))
            elif kind == "int":
                drawn[parameter] = rng.randint(int(low), int(high))
            else:
                drawn[parameter] = rng.uniform(low, high)
        trials.append(drawn)
    return trials


def _moments(x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Count, means and sums of products of deviations of the rows."""
    mean = x.mean(axis=0)
    return float(len(x)), mean, (x - mean).T @ (x - mean)


def _same_moments(training: DataFrame) -> DataFrame:
    """A few weighted rows with the total weight, means and covariances of features and target.

    They lie on both sides of the mean, along the columns of a root of the covariances.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y = batch["target"].to_numpy(zero_copy_only=False)
                x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
                n, mean, products = _moments(np.column_stack([x, y]).astype(np.float64))
                yield pa.RecordBatch.from_pydict({"n": [n], "mean": [mean], "products": [products.ravel()]})

    flat = training.select(vector_to_array("features").alias("x"), F.col("target").cast("double").alias("target"))
    parts = flat.mapInArrow(run, "n double, mean array<double>, products array<double>")
    found = parts.rdd.map(lambda r: (r["n"], np.array(r["mean"]), np.array(r["products"]))).treeReduce(_pooled)
    n, mean, width = found[0], found[1], len(found[1])
    root = _root(found[2].reshape(width, width) / n) * width**0.5
    points = [mean + sign * side for side in root.T for sign in (1.0, -1.0)]
    rows = [(Vectors.dense(p[:-1]), float(p[-1]), n / len(points)) for p in points]
    return training.sparkSession.createDataFrame(
        rows, training.select("features", "target").schema.add("weight", "double")
    )


def _pooled(a: tuple, b: tuple) -> tuple:
    """Moments of both parts; nothing is subtracted."""
    n, apart = a[0] + b[0], b[1] - a[1]
    between = np.outer(apart, apart).ravel() * (a[0] * b[0] / n)
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + between


def _root(covariance: np.ndarray) -> np.ndarray:
    """A lower triangle whose product with its transpose is the matrix; dependent columns add nothing."""
    root = np.zeros_like(covariance)
    for j in range(len(covariance)):
        rest = covariance[j:, j] - root[j:, :j] @ root[j, :j]
        if rest[0] > 1e-14 * covariance[j, j]:
            root[j:, j] = rest / rest[0] ** 0.5
    return root


def search(
    assembled: DataFrame,
    name: str,
    n_trials: int = 50,
    seed: int = 42,
    loss: str = "penalised_loss",
    config: Mapping[str, Any] | None = None,
) -> DataFrame:
    """Random search: one row per trial with its settings and validation loss, best first.

    The models of all trials are scored in one pass over the validation rows. ``config`` holds for
    every trial. The linear solver "normal" knows the samples by their means and covariances alone,
    which are gathered in one pass for all trials.
    """
    spark = assembled.sparkSession
    estimator = make_estimator(name, config, seed)
    trials = draw_settings(name, n_trials, seed)
    maps = [{estimator.getParam(k): v for k, v in t.items()} for t in trials]
    training = _training_rows(assembled, name)
    if name == "linear" and estimator.getSolver() == "normal":
        training, estimator = _same_moments(training), estimator.setWeightCol("weight")
    models = dict(estimator.fitMultiple(training, maps))
    rows = _usable(assembled).filter(F.col("split") == "val").select("features", "target")
    scored = predictions([models[i] for i in range(n_trials)], rows).select(
        F.col("target").alias("actual"), F.posexplode("predictions").alias("trial", "predicted")
    )
    losses = regression_metrics(scored, "actual", "predicted", by=["trial"]).select(
        "trial", F.col(loss).alias("loss")
    )
    drawn = [(name, i, {k: str(v) for k, v in t.items()}) for i, t in enumerate(trials)]
    settings = spark.createDataFrame(drawn, "model string, trial int, settings map<string,string>")
    return settings.join(losses, "trial", "left").select("model", "trial", "settings", "loss").orderBy(
        F.asc_nulls_last("loss"), "trial"
    )


def best_settings(trials: DataFrame, name: str) -> dict[str, Any]:
    """The model's base settings updated with the best trial's."""
    best = trials.orderBy(F.asc_nulls_last("loss"), "trial").first()
    kinds = {k: kind for k, (kind, _, _) in SEARCH_SPACE[name].items()}
    found = {k: int(v) if kinds[k] == "int" else float(v) for k, v in best.settings.items()}
    return {**MODELS[name], **found}


def leaderboard(
    assembled: DataFrame,
    names: Sequence[str] | None = None,
    configs: Mapping[str, Mapping[str, Any]] | None = None,
    loss: str = "penalised_loss",
) -> DataFrame:
    """Train each known model and put its test metrics in one table, best first."""
    parts = []
    for name in names or list(MODELS):
        if name not in MODELS:
            log.warning("Unknown model: %s", name)
            continue
        model = train_model(assembled, name, (configs or {}).get(name))
        metrics = evaluate(model, assembled, "test")
        parts.append(metrics.select(F.lit(name).alias("model"), *metrics.columns))
    if not parts:
        raise ValueError("no known model among the names given")
    return reduce(DataFrame.unionByName, parts).orderBy(loss)


def train_and_register(
    assembled: DataFrame,
    base: str,
    experiment: str,
    names: Sequence[str] | None = None,
    configs: Mapping[str, Mapping[str, Any]] | None = None,
    loss: str = "penalised_loss",
) -> DataFrame:
    """Train each named model and register it under ``base`` with its validation loss.

    Returns the experiment's entries; ``load_best_model`` gives the best one back, in any session.
    """
    spark = assembled.sparkSession
    for name in names or list(MODELS):
        model = train_model(assembled, name, (configs or {}).get(name))
        value = evaluate(model, assembled, "val").first()[loss]
        register_model(spark, base, experiment, name, model, value)
    return registered_models(spark, base).where(F.col("experiment") == experiment)


def train_best(
    assembled: DataFrame,
    names: Sequence[str] | None = None,
    configs: Mapping[str, Mapping[str, Any]] | None = None,
    loss: str = "penalised_loss",
) -> tuple[str, Model]:
    """Train each named model and keep the one with the lowest validation loss."""
    best: tuple[float, str, Model] | None = None
    for name in names or list(MODELS):
        model = train_model(assembled, name, (configs or {}).get(name))
        value = evaluate(model, assembled, "val").first()[loss]
        if value is not None and (best is None or value < best[0]):
            best = (value, name, model)
    if best is None:
        raise ValueError("no model could be validated")
    return best[1], best[2]


def run_log(
    spark: SparkSession,
    experiment: str,
    run: str,
    parameters: Mapping[str, Any],
    metrics: Mapping[str, float],
) -> DataFrame:
    """(experiment, run, kind, key, value, logged_at) of one run, to append to a log table."""
    now = dt.datetime.now().replace(microsecond=0)
    rows = [(experiment, run, "parameter", k, str(v), now) for k, v in parameters.items()]
    rows += [(experiment, run, "metric", k, str(v), now) for k, v in metrics.items()]
    schema = (
        "experiment string, run string, kind string, key string, value string, "
        "logged_at timestamp_ntz"
    )
    return spark.createDataFrame(rows, schema)
