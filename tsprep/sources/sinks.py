"""Results out: processed data, scalers, profiles, reports, models and logs."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Sequence

from pyspark.ml import Model, PipelineModel
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODEL_TABLE = "experiment string, model string, loss double, path string, saved_at timestamp_ntz"
_MOMENT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _stamped(base: str, name: str) -> str:
    now = dt.datetime.now().strftime("%Y%m%d_%H%M%S")
    return f"{base.rstrip('/')}/{name}_{now}"


def save_processed_data(
    df: DataFrame, name: str, base: str, format: str = "csv", partition_by: Sequence[str] = ()
) -> str:
    """Write to ``<base>/<name>_<yyyyMMdd_HHmmss>``; never overwrites. Returns the path."""
    path = _stamped(base, name)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if format == "csv":
        # all six decimals, where the default would keep three
        moments = dict.fromkeys(("timestampFormat", "timestampNTZFormat"), _MOMENT)
        writer = writer.options(header=True, escape='"', **moments)
    writer.format(format).save(path)
    return path


def save_scalers(scalers: DataFrame, base: str) -> dict[str, str]:
    """Write fitted scaler parameters, one folder per column; returns column to path."""
    base = base.rstrip("/")
    scalers.write.mode("overwrite").partitionBy("column").parquet(base)
    return {r["column"]: f"{base}/column={r['column']}" for r in scalers.collect()}


def load_scalers(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.parquet(base).select("column", "method", "center", "scale", "shift")


def save_profile(profile: DataFrame, base: str) -> str:
    path = _stamped(base, "profile_stats")
    profile.write.json(path)
    return path


def export_validation_report(results: DataFrame, base: str, format: str = "json") -> str:
    path = _stamped(base, "validation_report")
    results.write.format(format).save(path)
    return path


def export_training_history(history: DataFrame, base: str) -> str:
    path = _stamped(base, "training_history")
    history.write.json(path)
    return path


def save_comparison(leaderboard: DataFrame, base: str) -> str:
    path = _stamped(base, "results")
    leaderboard.write.json(path)
    return path


def save_model(model: Model, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(spark: SparkSession, path: str) -> Model:
    """Load a model of whatever class was saved at ``path``."""
    metadata = DefaultParamsReader.loadMetadata(path, spark)
    if metadata["class"].endswith("PipelineModel"):
        return PipelineModel.load(path)
    return DefaultParamsReader.loadParamsInstance(path, spark)


def register_model(
    spark: SparkSession, base: str, experiment: str, name: str, model: Model, loss: float | None
) -> str:
    """Save a fitted model under ``base`` and add it to the table of models there; returns its path.

    The row is written after the model, so whatever the table names can be loaded. Several writers may
    add to one table, and no entry is ever changed.
    """
    path = save_model(model, f"{base.rstrip('/')}/models/{name}-{uuid.uuid4().hex}")
    now = dt.datetime.now().replace(microsecond=0)
    entry = spark.createDataFrame([(experiment, name, loss, path, now)], MODEL_TABLE)
    entry.coalesce(1).write.mode("append").parquet(f"{base.rstrip('/')}/entries")
    return path


def registered_models(spark: SparkSession, base: str) -> DataFrame:
    """(experiment, model, loss, path, saved_at) of every model registered under ``base``."""
    return spark.read.schema(MODEL_TABLE).parquet(f"{base.rstrip('/')}/entries")


def load_best_model(
    spark: SparkSession, base: str, experiment: str | None = None
) -> tuple[str, Model]:
    """Name and model with the smallest loss; of equal ones the first saved, then by name and path.

    Models without a loss, or with NaN, are never the best.
    """
    known = registered_models(spark, base).where("loss IS NOT NULL AND NOT isnan(loss)")
    if experiment is not None:
        known = known.where(F.col("experiment") == experiment)
    best = known.orderBy("loss", "saved_at", "model", "path").first()
    if best is None:
        raise ValueError("no registered model has a loss")
    return best["model"], load_model(spark, best["path"])


def append_run_log(log: DataFrame, path: str) -> None:
    log.write.mode("append").parquet(path)
