"""Validation checks.

Every check returns rows ``(check, columns, is_valid, evaluated, unexpected,
unexpected_fraction, detail)``. The ``*_violations`` functions return the offending rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timing import micros
from .ordered import MAX_SERIES_ROWS, Split, over_rows

RESULT = (
    "check string, columns string, is_valid boolean, evaluated bigint, unexpected bigint, "
    "unexpected_fraction double, detail string"
)

# the fixed telemetry schema: column, type, lowest and highest allowed value
TELEMETRY_SCHEMA = {
    "timestamp": ("timestamp_ntz", None, None),
    "voltage": ("double", 180.0, 260.0),
    "current": ("double", 0.0, 500.0),
    "power": ("double", 0.0, None),
    "id_line": ("string", None, None),
}


def in_range(value: Column, low: float | None, high: float | None) -> Column:
    """Inclusive on both sides; either bound may be missing; NULL stays NULL."""
    tests = [value >= F.lit(low)] if low is not None else []
    tests += [value <= F.lit(high)] if high is not None else []
    return reduce(lambda a, b: a & b, tests, F.when(value.isNotNull(), F.lit(True)))


def _result(
    check: str, columns: str, evaluated: Column, unexpected: Column, valid: Column, detail: Column
) -> Column:
    return F.struct(
        F.lit(check).alias("check"),
        F.lit(columns).alias("columns"),
        valid.alias("is_valid"),
        evaluated.cast("bigint").alias("evaluated"),
        unexpected.cast("bigint").alias("unexpected"),
        F.try_divide(unexpected.cast("double"), evaluated).alias("unexpected_fraction"),
        detail.cast("string").alias("detail"),
    )


def _one_pass(df: DataFrame, results: Sequence[Column]) -> DataFrame:
    return df.agg(F.array(*results).alias("r")).select(F.inline("r"))


def _none() -> Column:
    return F.lit(None).cast("string")


def coerce(df: DataFrame, schema: Mapping[str, tuple] = TELEMETRY_SCHEMA) -> DataFrame:
    """Cast declared columns to their types; values that do not fit become NULL."""
    return df.select(
        *[
            F.col(c).try_cast(schema[c][0]).alias(c) if c in schema else F.col(c)
            for c in df.columns
        ]
    )


def _schema_rules(df: DataFrame, schema: Mapping[str, tuple]) -> list[tuple[str, str, Column]]:
    """(rule, column, violated) for each declared column that exists."""
    rules = []
    for c, (kind, low, high) in schema.items():
        if c not in df.columns:
            continue
        cast = F.col(c).try_cast(kind)
        rules.append(("not_null", c, F.col(c).isNull()))
        rules.append(("type", c, F.col(c).isNotNull() & cast.isNull()))
        if low is not None:
            rules.append(("min", c, F.coalesce(cast < F.lit(low), F.lit(False))))
        if high is not None:
            rules.append(("max", c, F.coalesce(cast > F.lit(high), F.lit(False))))
    return rules


def validate_schema(df: DataFrame, schema: Mapping[str, tuple] = TELEMETRY_SCHEMA) -> DataFrame:
    """Required and extra columns, types after coercion, NULLs and ranges, in one pass."""
    rows = F.count(F.lit(1))
    zero, one = F.lit(0), F.lit(1)
    results = []
    for c in schema:
        there = c in df.columns
        results.append(
            _result(
                "schema:required", c, one, zero if there else one, F.lit(there), _none()
            )
        )
    for c in df.columns:
        if c not in schema:
            results.append(_result("schema:extra", c, one, one, F.lit(False), _none()))
    for rule, c, violated in _schema_rules(df, schema):
        bad = F.count_if(violated)
        results.append(_result(f"schema:{rule}", c, rows, bad, bad == 0, _none()))
    return _one_pass(df, results)


def schema_violations(
    df: DataFrame, key: str, schema: Mapping[str, tuple] = TELEMETRY_SCHEMA
) -> DataFrame:
    """(key, rule, column, value) for every failing cell."""
    cells = F.array(
        *[
            F.when(
                violated,
                F.struct(
                    F.lit(rule).alias("rule"),
                    F.lit(c).alias("column"),
                    F.col(c).cast("string").alias("value"),
                ),
            )
            for rule, c, violated in _schema_rules(df, schema)
        ]
    )
    return df.select(key, F.inline(F.array_compact(cells)))


def _range_rules(config: Mapping[str, Any]) -> dict[str, Mapping[str, Any]]:
    return {c: s for c, s in config.items() if isinstance(s, Mapping) and "min" in s}


def _range_result(c: str, spec: Mapping[str, Any]) -> Column:
    ok = in_range(F.col(c), spec["min"], spec.get("max"))
    known, bad = F.count(c), F.count_if(~ok)
    mostly = 1 - spec.get("missing_threshold", 0.1)
    share = F.try_divide((known - bad).cast("double"), known)
    valid = F.coalesce(share >= F.lit(mostly), F.lit(True))
    return _result("range", c, known, bad, valid, _none())


def validate_ranges(df: DataFrame, config: Mapping[str, Any]) -> DataFrame:
    """Column values between bounds, for at least 1 - missing_threshold of known values."""
    return _one_pass(df, [_range_result(c, s) for c, s in _range_rules(config).items()])


def range_violations(df: DataFrame, column: str, spec: Mapping[str, Any]) -> DataFrame:
    return df.filter(~in_range(F.col(column), spec["min"], spec.get("max")))


def _grouped(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    known = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in columns])
    return df.filter(known).groupBy(*columns).agg(F.count(F.lit(1)).alias("copies"))


def validate_unique(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """No two rows share all of ``columns``; every row of a shared group is unexpected."""
    n = F.col("copies")
    bad = F.coalesce(F.sum(F.when(n > 1, n)), F.lit(0))
    known = F.coalesce(F.sum(n), F.lit(0))
    result = _result("unique", ",".join(columns), known, bad, bad == 0, _none())
    return _one_pass(_grouped(df, columns), [result])


def unique_violations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The shared groups with their number of rows."""
    return _grouped(df, columns).filter(F.col("copies") > 1)


def _not_null_result(c: str) -> Column:
    bad = F.count_if(F.col(c).isNull())
    return _result("not_null", c, F.count(F.lit(1)), bad, bad == 0, _none())


def validate_not_null(df: DataFrame, column: str = "timestamp") -> DataFrame:
    return _one_pass(df, [_not_null_result(column)])


def not_null_violations(df: DataFrame, column: str = "timestamp") -> DataFrame:
    return df.filter(F.col(column).isNull())


def increasing_violations(
    df: DataFrame,
    column: str,
    arrival: Sequence[str] | None = None,
    series_by: Sequence[str] = (),
    max_series_rows: int | Split = MAX_SERIES_ROWS,
) -> DataFrame:
    """Rows smaller than the row that arrived just before, with that row's value."""
    stepped = _steps(df, column, arrival, series_by, max_series_rows)
    return stepped.filter(F.col(column) < F.col("previous"))


def _steps(
    df: DataFrame,
    column: str,
    arrival: Sequence[str] | None,
    series_by: Sequence[str],
    max_series_rows: int | Split,
) -> DataFrame:
    if arrival is None and "event_id" not in df.columns:
        df, arrival = df.withColumn("__place", F.monotonically_increasing_id()), ("__place",)
    arrival = list(arrival or ("event_id",))
    slim = df.select(*dict.fromkeys([*series_by, *arrival, column]))
    return over_rows(
        slim.filter(F.col(column).isNotNull()),
        lambda w: [F.lag(column).over(w).alias("previous")],
        series_by,
        arrival,
        before=1,
        max_series_rows=max_series_rows,
    )


def validate_increasing(
    df: DataFrame,
    column: str = "timestamp",
    arrival: Sequence[str] | None = None,
    series_by: Sequence[str] = (),
    max_series_rows: int | Split = MAX_SERIES_ROWS,
) -> DataFrame:
    """Each value is at least the one that arrived before it.

    ``arrival`` names the columns that tell the order of arrival. Without it that is ``event_id`` where
    there is one, else the order in which Spark reads the rows, that is of files and of rows in them.
    """
    stepped = _steps(df, column, arrival, series_by, max_series_rows)
    bad = F.count_if(F.col(column) < F.col("previous"))
    result = _result("increasing", column, F.count(F.lit(1)), bad, bad == 0, _none())
    return _one_pass(stepped, [result])


def _power_off(tolerance: float) -> Column:
    product = F.col("voltage") * F.col("current")
    return F.abs(F.col("power") - product) > F.lit(tolerance) * F.col("power")


def _power_result(tolerance: float) -> Column:
    off = _power_off(tolerance)
    known, bad = F.count(off), F.count_if(off)
    return _result("power", "power,voltage,current", known, bad, bad == 0, _none())


def validate_power(df: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """Power is voltage times current within ``tolerance`` of power, where all are known."""
    return _one_pass(df, [_power_result(tolerance)])


def power_violations(df: DataFrame, tolerance: float = 0.1) -> DataFrame:
    return df.filter(_power_off(tolerance))


def _missing_result(c: str, threshold: float) -> Column:
    rows, bad = F.count(F.lit(1)), F.count_if(F.col(c).isNull())
    share = F.try_divide(bad.cast("double"), rows)
    valid = F.coalesce(share <= F.lit(threshold), F.lit(True))
    return _result("missing", c, rows, bad, valid, _none())


def validate_missing_values(df: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Share of NULLs per column; a share above the threshold fails."""
    return _one_pass(df, [_missing_result(c, threshold) for c in df.columns])


def _gaps(
    df: DataFrame,
    timestamp: str,
    series_by: Sequence[str],
    tie: Sequence[str],
    max_series_rows: int | Split,
) -> DataFrame:
    order = [timestamp, *tie]
    stepped = _steps(df, timestamp, order, series_by, max_series_rows)
    now, before = micros(df, timestamp), F.col("previous")
    us = micros(stepped, "previous")
    return stepped.select(
        *series_by,
        before.alias("previous"),
        F.col(timestamp),
        F.when(before.isNotNull(), now - us).alias("gap_us"),
    )


def gap_violations(
    df: DataFrame,
    timestamp: str = "timestamp",
    max_gap_seconds: float = 3600.0,
    series_by: Sequence[str] = ("id_line",),
    tie: Sequence[str] = (),
    max_series_rows: int | Split = MAX_SERIES_ROWS,
) -> DataFrame:
    """(series, previous, timestamp, gap_us) of each gap longer than allowed."""
    gaps = _gaps(df, timestamp, series_by, tie, max_series_rows)
    return gaps.filter(F.col("gap_us") > F.lit(int(max_gap_seconds * 1_000_000)))


def validate_time_continuity(
    df: DataFrame,
    timestamp: str = "timestamp",
    max_gap_seconds: float = 3600.0,
    series_by: Sequence[str] = ("id_line",),
    tie: Sequence[str] = (),
    max_series_rows: int | Split = MAX_SERIES_ROWS,
) -> DataFrame:
    """Steps between neighbours in time; the detail is the longest step in microseconds."""
    gaps = _gaps(df, timestamp, series_by, tie, max_series_rows)
    bad = F.count_if(F.col("gap_us") > F.lit(int(max_gap_seconds * 1_000_000)))
    steps = F.count("gap_us")
    result = _result("gaps", timestamp, steps, bad, bad == 0, F.max("gap_us"))
    return _one_pass(gaps, [result])


def validate_with_expectations(
    df: DataFrame,
    config: Mapping[str, Any],
    timestamp: str = "timestamp",
    arrival: Sequence[str] | None = None,
    series: str = "id_line",
    max_series_rows: int | Split = MAX_SERIES_ROWS,
) -> DataFrame:
    """The rule set: ranges, uniqueness, NULLs, order and the power relation.

    All row-wise rules share one pass; uniqueness and order take one shuffle each.
    """
    rows = [_range_result(c, s) for c, s in _range_rules(config).items()]
    rows += [_not_null_result(timestamp), _power_result(0.1)]
    parts = [_one_pass(df, rows)]
    combinations = [list(c) for c in config.get("unique_combinations", [])]
    if [timestamp, series] not in combinations:
        combinations.append([timestamp, series])
    parts += [validate_unique(df, c) for c in combinations]
    parts.append(
        validate_increasing(df, timestamp, arrival, max_series_rows=max_series_rows)
    )
    return reduce(DataFrame.unionByName, parts)


def verdict(results: DataFrame) -> DataFrame:
    """One row: do all checks hold, how many were there, how many failed."""
    return results.agg(
        F.coalesce(F.bool_and("is_valid"), F.lit(True)).alias("is_valid"),
        F.count(F.lit(1)).alias("checks"),
        F.count_if(~F.col("is_valid")).alias("failed"),
    )


def validation_summary(runs: Mapping[str, DataFrame]) -> DataFrame:
    """Results of several runs in one table, named by ``run``."""
    named = [r.withColumn("run", F.lit(name)) for name, r in runs.items()]
    return reduce(DataFrame.unionByName, named)
