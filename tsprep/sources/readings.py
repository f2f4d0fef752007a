"""Telemetry readings derived from the ``events`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SERIES = ("id_line",)
ORDER = ("ts", "event_id")
MEASURES = ("voltage", "current", "power")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: line, voltage, current, power and status, with gaps in each."""
    event, value = F.col("event_id"), F.col("value")
    voltage = F.lit(200) + value * F.lit(0.25)
    return table(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        F.concat(F.lit("LINE_"), F.lpad((F.col("user_id") % 20).cast("string"), 3, "0")).alias(
            "id_line"
        ),
        F.when(event % 20 != 7, voltage).alias("voltage"),
        F.when(event % 25 != 3, value).alias("current"),
        F.when(event % 30 != 11, voltage * value * F.lit(0.95)).alias("power"),
        F.when(event % 40 != 5, F.col("event_type")).alias("status"),
    )
