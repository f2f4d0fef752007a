"""Sliding windows over series, chronological splits and pooled window features."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .impute import numeric_columns
from .ordered import MAX_SERIES_ROWS, SEQ, Split, choose_split, over_rows, positioned

SERIES = ("id_line",)
ORDER = ("timestamp",)


def make_sequences(
    df: DataFrame,
    window_size: int,
    target: str = "voltage",
    features: Sequence[str] | None = None,
    series_by: Sequence[str] = SERIES,
    order_by: Sequence[str] = ORDER,
    max_series_rows: int | Split = MAX_SERIES_ROWS,
) -> DataFrame:
    """Each row's target with the features of the ``window_size`` rows before it, in order.

    The first ``window_size`` rows of a series have too few rows before them and are left out.
    """
    features = list(features or numeric_columns(df, exclude=(target, *order_by)))
    step = F.struct(*dict.fromkeys([*order_by, *features]))  # a struct, so NULLs keep their place
    made = over_rows(
        df,
        lambda w: [F.collect_list(step).over(w.rowsBetween(-window_size, -1)).alias("sequence")],
        series_by,
        order_by,
        before=window_size,
        max_series_rows=max_series_rows,
    )
    return made.filter(F.size("sequence") == window_size).select(
        *series_by, *order_by, "sequence", F.col(target).alias("target")
    )


def pooled_features(
    df: DataFrame,
    window_size: int,
    target: str = "voltage",
    features: Sequence[str] | None = None,
    series_by: Sequence[str] = SERIES,
    order_by: Sequence[str] = ORDER,
    max_series_rows: int | Split = MAX_SERIES_ROWS,
) -> DataFrame:
    """Mean, std, min and max of each feature over the rows before, next to the target.

    The order inside the window does not matter: the window is treated as a set.
    """
    features = list(features or numeric_columns(df, exclude=(target, *order_by)))
    pools = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    names = [f"{c}_{p}" for c in features for p in pools]
    made = over_rows(
        df,
        lambda w: [
            F.count(F.lit(1)).over(w.rowsBetween(-window_size, -1)).alias("__rows"),
            *[
                pool(c).over(w.rowsBetween(-window_size, -1)).alias(f"{c}_{p}")
                for c in features
                for p, pool in pools.items()
            ],
        ],
        series_by,
        order_by,
        before=window_size,
        max_series_rows=max_series_rows,
    )
    return made.filter(F.col("__rows") == window_size).select(
        *series_by, *order_by, *names, F.col(target).alias("target")
    )


def chronological_split(
    samples: DataFrame,
    train_ratio: float = 0.8,
    val_ratio: float = 0.1,
    series_by: Sequence[str] = SERIES,
    order_by: Sequence[str] = ORDER,
    max_series_rows: int | Split = MAX_SERIES_ROWS,
) -> DataFrame:
    """Append ``split``: the first samples of a series train, the next validate, the rest test."""
    split = choose_split(samples, series_by, max_series_rows)
    rows = positioned(samples, series_by, order_by, split)
    if not series_by:
        total = samples.count()
        rows = rows.withColumn("__n", F.lit(total))
    elif split.long:
        sizes = samples.groupBy(*[F.col(s).alias(f"__s_{s}") for s in series_by]).agg(
            F.count(F.lit(1)).alias("__n")
        )
        same = reduce(
            lambda a, b: a & b, [F.col(s).eqNullSafe(F.col(f"__s_{s}")) for s in series_by]
        )
        rows = rows.join(sizes, same)
    else:
        rows = rows.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*series_by)))
    train = F.floor(F.lit(train_ratio) * F.col("__n"))
    val = F.floor(F.lit(val_ratio) * F.col("__n"))
    part = (
        F.when(F.col(SEQ) < train, "train").when(F.col(SEQ) < train + val, "val").otherwise("test")
    )
    return rows.select(*samples.columns, part.alias("split"))
