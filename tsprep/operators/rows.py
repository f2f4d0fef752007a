"""Choosing and changing rows and cells."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def known_rows(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull())


def missing_rows(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def listed_rows(df: DataFrame, column: str, values: Sequence[Any] | DataFrame) -> DataFrame:
    """Rows whose value is listed; a table of values is joined, a short list is a predicate."""
    if isinstance(values, DataFrame):
        listed = values.select(F.col(values.columns[0]).alias(column))
        return df.join(listed, column, "left_semi").select(*df.columns)
    return df.filter(F.col(column).isin(*values))


def unlisted_rows(df: DataFrame, column: str, values: Sequence[Any] | DataFrame) -> DataFrame:
    """The other rows, those with a NULL included."""
    if isinstance(values, DataFrame):
        listed = values.select(F.col(values.columns[0]).alias(column))
        return df.join(listed, column, "left_anti").select(*df.columns)
    return df.filter(~F.coalesce(F.col(column).isin(*values), F.lit(False)))


def overwrite_where(df: DataFrame, mask: Column, column: str, value: Any) -> DataFrame:
    """Set ``column`` where ``mask`` is true; a NULL mask keeps the cell."""
    return df.withColumn(column, F.when(mask, F.lit(value)).otherwise(F.col(column)))


def preview(df: DataFrame, order_by: Sequence[str], rows: int = 5) -> DataFrame:
    return df.orderBy(*order_by).limit(rows)
