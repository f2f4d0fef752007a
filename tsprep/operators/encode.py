"""Categorical encodings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import keep
from .ordered import MAX_SERIES_ROWS, Split, choose_split, positioned
from .ordered import SEQ


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Non-NULL values by falling frequency; equal counts by value."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(
        F.count(F.lit(1)).alias("count")
    )
    return counts.orderBy(F.desc("count"), column)


def keep_most_frequent(df: DataFrame, column: str, max_categories: int) -> DataFrame:
    """Replace all but the most frequent values, and NULL, by ``Other``."""
    top = [r[0] for r in value_counts(df, column).limit(max_categories).collect()]
    capped = F.when(F.col(column).isin(top), F.col(column)).otherwise(F.lit("Other"))
    return df.select(*[capped.alias(c) if c == column else F.col(c) for c in df.columns])


def encode_onehot(
    df: DataFrame,
    columns: str | Sequence[str],
    max_categories: int | None = None,
    max_columns: int | None = None,
) -> DataFrame:
    """Append one BOOLEAN ``<column>_<value>`` per value and ``<column>_nan``.

    The text ``nan`` counts as missing. Every value becomes a column: set ``max_categories`` for
    columns of many values, or ``max_columns`` to get an error instead of more columns than that. For
    columns without a bound use :func:`encode_onehot_sparse`.
    """
    columns = [columns] if isinstance(columns, str) else columns
    for c in columns:
        if max_categories:
            df = keep_most_frequent(df, c, max_categories)
        found = df.select(c).filter(F.col(c).isNotNull()).distinct()
        if max_columns is not None:
            found = found.limit(max_columns + 1)
        values = sorted(r[0] for r in found.collect())
        if max_columns is not None and len(values) > max_columns:
            raise ValueError(f"{c}: more than {max_columns} different values")
        flags = [
            F.col(c).eqNullSafe(F.lit(v)).alias(f"{c}_{v}") for v in values if str(v) != "nan"
        ]
        missing = F.col(c).isNull() | (F.col(c).cast("string") == "nan")
        df = df.select("*", *flags, missing.alias(f"{c}_nan"))
    return df


def categories(
    df: DataFrame, column: str, max_series_rows: int | Split = MAX_SERIES_ROWS
) -> DataFrame:
    """``value, code`` of every value, numbered in their order from 0; NULL and ``nan`` come last."""
    value = F.when(F.col(column).cast("string") != "nan", F.col(column))
    values = df.select(value.alias("value")).distinct()
    known = values.where("value IS NOT NULL")
    known = positioned(known, (), ["value"], choose_split(known, (), max_series_rows))
    known = keep(known.select("value", F.col(SEQ).alias("code")))
    missing = df.sparkSession.range(1).select(
        F.lit(None).cast(df.schema[column].dataType).alias("value"), F.lit(known.count()).cast("bigint").alias("code")
    )
    return known.unionByName(missing)


def encode_onehot_sparse(
    df: DataFrame, columns: str | Sequence[str], max_series_rows: int | Split = MAX_SERIES_ROWS
) -> DataFrame:
    """Append a sparse vector ``<column>_onehot`` of as many places as the column has values, and one more
    for missing ones.

    Codes come from :func:`categories` and are joined, so values never meet on the driver, however many
    there are; a row costs one number, not one column per value.
    """
    columns = [columns] if isinstance(columns, str) else columns
    for c in columns:
        codes = keep(categories(df, c, max_series_rows))
        size = codes.count()
        known = codes.where("value IS NOT NULL")
        code = F.coalesce("code", F.lit(size - 1)).cast("double").alias("__code")
        coded = df.join(known, df[c] == known["value"], "left").select(*[df[n] for n in df.columns], code)
        # fitting only looks for the largest code: one row holds it, as the size is known
        largest = df.sparkSession.range(1).select(F.lit(float(size - 1)).alias("__code"))
        encoder = OneHotEncoder(inputCol="__code", outputCol=f"{c}_onehot", dropLast=False).fit(largest)
        df = encoder.transform(coded).drop("__code")
    return df


def encode_label(
    df: DataFrame,
    columns: str | Sequence[str],
    order_by: Sequence[str],
    max_series_rows: int | Split = MAX_SERIES_ROWS,
) -> DataFrame:
    """Append ``<column>_encoded``: codes from 0 in order of first appearance, NULL included."""
    columns = [columns] if isinstance(columns, str) else columns
    for c in columns:
        first = F.min(F.struct(*order_by)).alias("__first")
        seen = df.groupBy(c).agg(first)
        split = choose_split(seen, (), max_series_rows)
        codes = positioned(seen, (), ["__first"], split).select(
            F.col(c).alias("__value"), F.col(SEQ).alias(f"{c}_encoded")
        )
        df = df.join(codes, df[c].eqNullSafe(codes["__value"]), "left").drop("__value")
    return df


def encode_categorical(
    df: DataFrame,
    columns: str | Sequence[str],
    method: str = "onehot",
    max_categories: int | None = None,
    order_by: Sequence[str] = ("timestamp",),
) -> DataFrame:
    if method == "onehot":
        return encode_onehot(df, columns, max_categories)
    if method == "label":
        return encode_label(df, columns, order_by)
    raise ValueError(f"Unknown encoding method: {method}")
