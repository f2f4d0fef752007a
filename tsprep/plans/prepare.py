"""Prepare a table: fill gaps, drop outliers, add features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import anomaly, features, impute
from ..operators.ordered import MAX_SERIES_ROWS, Split, choose_split
from ..operators.profile import compare_datasets
from ..session import keep

MEASURES = ("voltage", "current", "power")


def prepare(
    df: DataFrame,
    config: Mapping[str, Any],
    handle_missing: bool = True,
    detect_anomalies: bool = True,
    add_features: bool = True,
    measures: Sequence[str] = MEASURES,
    window_sizes: Sequence[int] = (6, 12, 24),
    functions: Sequence[str] = features.FUNCTIONS,
    key: str | Sequence[str] | None = None,
    series_by: Sequence[str] = ("id_line",),
    order_by: Sequence[str] = ("timestamp",),
    max_series_rows: int | Split = MAX_SERIES_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """The prepared table and a report ``(step, count, message)``.

    How to cut long series is decided once, on the input. The filled table is written once
    before the outlier statistics, which need a pass of their own.
    """
    split = choose_split(df, series_by, max_series_rows)
    ordered = dict(series_by=series_by, order_by=order_by, max_series_rows=split)
    counts = []
    if handle_missing:
        rules = config.get("missing_values", {})
        gaps = impute.missing_columns(df)
        for c in gaps:
            others = [m for m in measures if m != c]
            df = impute.apply_config_strategy(df, c, rules, others, key, **ordered)
        counts.append(("missing", len(gaps), f"{len(gaps)} columns with gaps filled"))
    if detect_anomalies:
        threshold = config.get("anomaly_detection", {}).get("statistical", {})
        limit = threshold.get("z_score_threshold", 3)
        flagged = anomaly.detect_global(keep(df), measures, limit)
        removed = flagged.agg(F.count_if("is_anomaly")).first()[0]
        df = anomaly.remove_outliers(flagged).select(*df.columns)
        counts.append(("anomalies", removed, f"{removed} outlying rows left out"))
    if add_features:
        names = config.get("feature_engineering", {})
        df = features.window_agg(df, measures, window_sizes, functions, **ordered)
        df = features.add_time_features(df, order_by[0], config=names)
        counts.append(("features", None, "calendar and window columns added"))
    report = df.sparkSession.createDataFrame(counts, "step string, count bigint, message string")
    return df, report


def compare_mean_filled(df: DataFrame, column: str, **options: Any) -> DataFrame:
    """Profile of the table before and after filling one column by its mean."""
    return compare_datasets(df, impute.fill_mean(df, column), **options)
