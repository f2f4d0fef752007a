"""All validation runs on one table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame

from ..operators import quality
from ..operators.ordered import MAX_SERIES_ROWS, Split


def quality_gate(
    df: DataFrame,
    config: Mapping[str, Any],
    schema: Mapping[str, tuple] = quality.TELEMETRY_SCHEMA,
    timestamp: str = "timestamp",
    series: str = "id_line",
    arrival: Sequence[str] | None = None,
    tie: Sequence[str] = (),
    missing_threshold: float = 0.1,
    max_gap_seconds: float = 3600.0,
    max_series_rows: int | Split = MAX_SERIES_ROWS,
) -> DataFrame:
    """Schema, rule set, missing shares and time continuity: one row per check and run.

    No key is needed: without ``arrival`` rows arrive as :func:`~tsprep.operators.quality.validate_increasing`
    says.

    The row-wise checks are aggregates over a pruned scan, so ``df`` is not cached: re-reading
    a few columns is cheaper than holding the table.
    """
    gaps = quality.validate_time_continuity(
        df, timestamp, max_gap_seconds, (series,), tie, max_series_rows
    )
    return quality.validation_summary(
        {
            "schema": quality.validate_schema(df, schema),
            "expectations": quality.validate_with_expectations(
                df, config, timestamp, arrival, series, max_series_rows
            ),
            "missing_values": quality.validate_missing_values(df, missing_threshold),
            "time_continuity": gaps,
        }
    )
