"""Scaling. Fitting is one aggregate; applying is plain arithmetic in the scan's stage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import exact_quantiles

# relative rank error of quantile sketches is one in SKETCH; every task sends one of this size
SKETCH = 1_000
METHODS = ("standard", "robust", "minmax")
PARAMETERS = "column string, method string, center double, scale double, shift double"


def fit_scalers(
    df: DataFrame, methods: Mapping[str, str], approximate: bool = False, **options: Any
) -> DataFrame:
    """One row per column: ``scaled = (value - center) / scale + shift``.

    Means, deviations and ranges of all columns come from a single pass. Exact quartiles take
    a count of the distinct values; ``approximate`` uses a fixed-size sketch in the same pass.
    """
    for method in methods.values():
        if method not in METHODS:
            raise ValueError(f"Unknown scaling method: {method}")
    low, high = options.get("quantile_range", (25.0, 75.0))
    shares = [low / 100, 0.5, high / 100]
    robust = [c for c, method in methods.items() if method == "robust"]
    exact = exact_quantiles(df, robust, shares) if robust and not approximate else {}
    wanted = [F.count(F.lit(1)).alias("rows")]
    for c, method in methods.items():
        if method == "standard":
            stats = [F.avg(c), F.stddev_pop(c)]
        elif method == "robust":
            sketch = F.percentile_approx(c, shares, SKETCH).cast("array<double>")
            stats = [sketch] if approximate else []
        else:
            stats = [F.min(c).cast("double"), F.max(c).cast("double")]
        wanted += [s.alias(f"{c}_{i}") for i, s in enumerate(stats)]
    row = df.agg(*wanted).first().asDict()
    for c, quartiles in exact.items():
        row[f"{c}_0"] = None if quartiles[0] is None else quartiles
    fitted = [(c, m, *_parameters(m, row, c, options)) for c, m in methods.items()]
    return df.sparkSession.createDataFrame(fitted, PARAMETERS)


def _parameters(method: str, row: Any, column: str, options: Mapping[str, Any]) -> tuple:
    first = row[f"{column}_0"]
    if first is None:
        return (None, None, None)
    if method == "standard":
        center = first if options.get("with_mean", True) else 0.0
        spread = row[f"{column}_1"] if options.get("with_std", True) else 1.0
        return center, spread or 1.0, 0.0
    if method == "robust":
        low, middle, high = first
        center = middle if options.get("with_centering", True) else 0.0
        spread = (high - low) if options.get("with_scaling", True) else 1.0
        return center, spread or 1.0, 0.0
    low, high = options.get("feature_range", (0.0, 1.0))
    width = (row[f"{column}_1"] - first) or 1.0
    return first, width / (high - low), float(low)


def apply_scalers(df: DataFrame, scalers: DataFrame) -> DataFrame:
    """Append ``<column>_scaled`` for each fitted column (a handful of rows)."""
    return df.select("*", *[_scaled(p).alias(f"{p['column']}_scaled") for p in scalers.collect()])


def _scaled(p: Mapping[str, Any]) -> Column:
    if p["center"] is None:
        return F.lit(None).cast("double")
    return (F.col(p["column"]) - F.lit(p["center"])) / F.lit(p["scale"]) + F.lit(p["shift"])


def scale(
    df: DataFrame, columns: str | Sequence[str], method: str = "standard", **options: Any
) -> DataFrame:
    columns = [columns] if isinstance(columns, str) else columns
    return apply_scalers(df, fit_scalers(df, dict.fromkeys(columns, method), **options))


def scale_by_config(df: DataFrame, methods: Mapping[str, str], **options: Any) -> DataFrame:
    """``methods`` is the configuration's ``scaling`` section: column to method."""
    return apply_scalers(df, fit_scalers(df, methods, **options))
