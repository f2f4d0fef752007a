"""From readings to trained and evaluated regressors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.ml import Model
from pyspark.sql import DataFrame

from ..operators import modeling
from ..operators.impute import numeric_columns
from ..operators.ordered import MAX_SERIES_ROWS, Split, choose_split
from ..operators.sequences import chronological_split, pooled_features
from ..session import keep


def make_samples(
    df: DataFrame,
    window_size: int = 24,
    target: str = "voltage",
    features: Sequence[str] | None = None,
    train_ratio: float = 0.8,
    val_ratio: float = 0.1,
    series_by: Sequence[str] = ("id_line",),
    order_by: Sequence[str] = ("timestamp",),
    max_series_rows: int | Split = MAX_SERIES_ROWS,
) -> DataFrame:
    """Window features, target, split and feature vector of every sample.

    Written once: the training loops read it many times. The window features are written before the
    split as well, whose range shuffle reads its rows twice: for a sample and to move them.
    """
    split = choose_split(df, series_by, max_series_rows)
    pooled = keep(pooled_features(df, window_size, target, features, series_by, order_by, split))
    parted = chronological_split(pooled, train_ratio, val_ratio, series_by, order_by, split)
    names = [c for c in pooled.columns if c not in (*series_by, *order_by, "target")]
    return keep(modeling.assemble(parted, names))


def train_and_evaluate(
    df: DataFrame,
    name: str,
    overrides: Mapping[str, Any] | None = None,
    window_size: int = 24,
    target: str = "voltage",
    features: Sequence[str] | None = None,
    series_by: Sequence[str] = ("id_line",),
    order_by: Sequence[str] = ("timestamp",),
) -> tuple[Model, DataFrame, DataFrame]:
    """Train one model; returns it with its test metrics and its training history."""
    if name not in modeling.MODELS:
        raise ValueError(f"Unknown model type: {name}")
    if features is None:
        features = numeric_columns(df, exclude=order_by)
    samples = make_samples(
        df, window_size, target, features, series_by=series_by, order_by=order_by
    )
    model = modeling.train_model(samples, name, overrides)
    return (
        model,
        modeling.evaluate(model, samples, "test"),
        modeling.training_history(model, samples, name),
    )
