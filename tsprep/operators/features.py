"""Calendar and rolling-window features."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, WindowSpec
from pyspark.sql import functions as F

from ..functions.timing import CALENDAR_FEATURES, calendar_columns, parse_timestamp
from .ordered import MAX_SERIES_ROWS, Split, over_rows

FUNCTIONS = ("mean", "std", "min", "max")


def add_time_features(
    df: DataFrame,
    timestamp: str = "timestamp",
    features: Sequence[str] | None = None,
    config: Mapping[str, Any] | None = None,
    holidays: DataFrame | None = None,
) -> DataFrame:
    """Append calendar columns. Text timestamps are parsed first.

    The list comes from the argument, else from the configuration, else all five are added.
    ``holidays`` (one DATE column) replaces the weekend rule for ``is_holiday``.
    """
    if features is None:
        features = (config or {}).get("time_features", CALENDAR_FEATURES)
    moment = parse_timestamp(df, timestamp)
    base = [moment.alias(c) if c == timestamp else F.col(c) for c in df.columns]
    added = df.select(*base, *calendar_columns(moment, features))
    if holidays is None or "is_holiday" not in features:
        return added
    day = F.to_date(timestamp)
    days = holidays.select(F.col(holidays.columns[0]).cast("date").alias("__day")).distinct()
    joined = added.join(days, day == F.col("__day"), "left")
    return joined.withColumn("is_holiday", F.col("__day").isNotNull()).drop("__day")


_WINDOWED = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
_NEEDS = {"mean": ["mean"], "std": ["std"], "min": ["min"], "max": ["max"], "range": ["min", "max"]}


def window_agg(
    df: DataFrame,
    columns: str | Sequence[str],
    window_sizes: int | Sequence[int],
    functions: Sequence[str] = FUNCTIONS,
    series_by: Sequence[str] = ("id_line",),
    order_by: Sequence[str] = ("timestamp",),
    max_series_rows: int | Split = MAX_SERIES_ROWS,
) -> DataFrame:
    """Append ``<column>_roll<n>_<function>`` over the last n rows.

    A value is NULL unless all n rows have one. All windows share one shuffle, and each
    aggregate is computed once even if several functions use it.
    """
    columns = [columns] if isinstance(columns, str) else columns
    sizes = [window_sizes] if isinstance(window_sizes, int) else window_sizes
    functions = [f for f in functions if f in _NEEDS]
    needed = sorted({x for f in functions for x in _NEEDS[f]})

    def aggregates(w: WindowSpec) -> list[Column]:
        made = []
        for c in columns:
            for n in sizes:
                frame = w.rowsBetween(-(n - 1), 0)
                made.append(F.count(c).over(frame).alias(f"__{c}_{n}_count"))
                made += [_WINDOWED[x](c).over(frame).alias(f"__{c}_{n}_{x}") for x in needed]
        return made

    def value(c: str, n: int, function: str) -> Column:
        parts = [F.col(f"__{c}_{n}_{x}") for x in _NEEDS[function]]
        result = parts[1] - parts[0] if function == "range" else parts[0]
        return F.when(F.col(f"__{c}_{n}_count") == n, result).alias(f"{c}_roll{n}_{function}")

    windowed = over_rows(
        df, aggregates, series_by, order_by, before=max(sizes) - 1, max_series_rows=max_series_rows
    )
    added = [value(c, n, f) for c in columns for n in sizes for f in functions]
    return windowed.select(*df.columns, *added)


def feature_summary(spark: SparkSession, steps: Sequence[Mapping[str, Any]]) -> DataFrame:
    """The list of applied steps as a table (metadata only)."""
    now = dt.datetime.now().replace(microsecond=0)
    rows = [
        (
            s["operation"],
            s["input"],
            s["output"] if isinstance(s["output"], str) else ",".join(s["output"]),
            {k: str(v) for k, v in s.get("parameters", {}).items()},
            s.get("timestamp", now),
        )
        for s in steps
    ]
    return spark.createDataFrame(
        rows,
        "operation string, input_column string, output_column string, "
        "parameters map<string,string>, timestamp timestamp_ntz",
    )
