"""Sample telemetry for any number of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sample_telemetry(
    spark: SparkSession, hours: int = 1000, lines: int = 1, seed: int = 42
) -> DataFrame:
    """Hourly readings from 2024-01-01 with a daily wave and noise.

    About 5 % of rows lose all three measures; about 2 % get 1.5 times their voltage. Power is
    0.95 x voltage x current before both defects.
    """
    rows = spark.range(hours * lines)
    hour = F.col("id") % hours
    wave = F.sin(2 * F.pi() * hour / 24)
    noise = rows.select(
        (F.floor(F.col("id") / hours) + 1).alias("line"),
        hour.alias("hour"),
        (230 + 10 * wave + 2 * F.randn(seed)).alias("v"),
        F.greatest(F.lit(0.0), 100 + 50 * wave + 5 * F.randn(seed + 1)).alias("c"),
        (F.rand(seed + 2) < 0.05).alias("lost"),
        (F.rand(seed + 3) < 0.02).alias("odd"),
    )
    start = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'")
    kept = ~F.col("lost")
    return noise.select(
        (start + F.make_dt_interval(hours=F.col("hour").cast("int"))).alias("timestamp"),
        F.when(kept, F.when(F.col("odd"), F.col("v") * 1.5).otherwise(F.col("v"))).alias("voltage"),
        F.when(kept, F.col("c")).alias("current"),
        F.when(kept, F.col("v") * F.col("c") * 0.95).alias("power"),
        F.format_string("LINE_%03d", "line").alias("id_line"),
    )
