"""Regression metrics as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed bounds and weight of the voltage penalty
LOW, HIGH, WEIGHT = 180.0, 260.0, 0.1


def range_penalty(predicted: Column, low: float = LOW, high: float = HIGH) -> Column:
    """How far a prediction lies outside the bounds; NULL without a prediction."""
    zero = F.lit(0.0)
    outside = F.greatest(zero, F.lit(low) - predicted, predicted - F.lit(high))
    return F.when(predicted.isNotNull(), outside)


def _both(actual: str, predicted: str) -> tuple[Column, Column]:
    """Actual and predicted value, NULL unless both are known."""
    y, p = F.col(actual), F.col(predicted)
    known = y.isNotNull() & p.isNotNull()
    return F.when(known, y), F.when(known, p)


def metric_columns(
    actual: str, predicted: str, low: float = LOW, high: float = HIGH, weight: float = WEIGHT
) -> list[Column]:
    y, p = _both(actual, predicted)
    error = y - p
    square = error * error
    mse = F.avg(square)
    total = F.var_pop(y) * F.count(y)
    return [
        F.count(y).alias("rows"),
        F.count_if(y.isNull()).alias("skipped"),
        F.avg(F.abs(error)).alias("mae"),
        mse.alias("mse"),
        F.sqrt(mse).alias("rmse"),
        (F.avg(F.abs(F.try_divide(error, y))) * 100).alias("mape"),
        (1 - F.try_divide(F.sum(square), total)).alias("r2"),
        (mse + F.lit(weight) * F.avg(range_penalty(p, low, high))).alias("penalised_loss"),
    ]


def regression_metrics(
    df: DataFrame, actual: str, predicted: str, by: Sequence[str] = (), **bounds: float
) -> DataFrame:
    """mae, mse, rmse, mape (percent), r2 and range-penalised loss over all rows, or per group."""
    return df.groupBy(*by).agg(*metric_columns(actual, predicted, **bounds))
