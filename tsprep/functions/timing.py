"""Column expressions on timestamps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parse_timestamp(df: DataFrame, column: str) -> Column:
    """The column as a timestamp; text that is no timestamp becomes NULL."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.col(column)
    return F.col(column).try_cast("timestamp_ntz")


def micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970 as BIGINT, independent of the session time zone for NTZ."""
    if isinstance(df.schema[column].dataType, T.TimestampType):
        return F.unix_micros(column)
    moment = F.col(column).cast("timestamp_ntz")
    epoch = F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")
    return F.timestamp_diff("MICROSECOND", epoch, moment)


CALENDAR_FEATURES = ("hour_sin_cos", "day_of_week", "month", "is_weekend", "is_holiday")


def calendar_columns(moment: Column, features: Sequence[str]) -> list[Column]:
    """Calendar columns in the order asked for. Monday is day 0."""
    angle = F.lit(2) * F.pi() * F.hour(moment) / F.lit(24)
    weekend = F.weekday(moment) >= 5
    known = {
        "hour_sin_cos": [F.sin(angle).alias("hour_sin"), F.cos(angle).alias("hour_cos")],
        "day_of_week": [F.weekday(moment).alias("day_of_week")],
        "month": [F.month(moment).alias("month")],
        "is_weekend": [weekend.alias("is_weekend")],
        "is_holiday": [weekend.alias("is_holiday")],
    }
    return [c for f in features for c in known.get(f, [])]
