"""Exact quantiles of several columns without shuffling or holding all values.

A sketch over a sample of about a million rows brackets each quantile between two values. One
pass counts the rows below each bracket; only the rows inside, under one in a hundred, are
counted by value to find the exact ranks. At most two values per quantile reach the driver.
The sample only decides where to look: a rank outside its bracket is looked up in all rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import MAX_SERIES_ROWS, Split, running_sum

_ACCURACY = 10_000
_SAMPLE_ROWS = 1_000_000


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    shares: Sequence[float],
    max_series_rows: int | Split = MAX_SERIES_ROWS,
) -> dict[str, list[float | None]]:
    """Column to its quantiles, linear between neighbouring ranks; NULLs are ignored."""
    if not columns:
        return {}
    stats = [F.count(c).alias(f"{c}__n") for c in columns]
    for c in columns:
        value = F.col(c).cast("double")
        stats += [F.min(value).alias(f"{c}__min"), F.max(value).alias(f"{c}__max")]
    row = df.agg(*stats, F.count(F.lit(1)).alias("__rows")).first()
    # rank error of the sketch, and five standard errors of a sampled share
    slack, rows = 2 / _ACCURACY, df.select(*columns)
    if row["__rows"] > _SAMPLE_ROWS:
        slack += 2.5 / math.sqrt(_SAMPLE_ROWS)
        rows = rows.sample(_SAMPLE_ROWS / row["__rows"], seed=1)
    cuts = [max(0.0, p - slack) for p in shares] + [min(1.0, p + slack) for p in shares]
    sketched = rows.agg(
        *[F.percentile_approx(F.col(c).cast("double"), cuts, _ACCURACY).alias(c) for c in columns]
    ).first()
    targets, brackets = {}, {}
    for c in columns:
        for i, p in enumerate(shares):
            place = p * (row[f"{c}__n"] - 1)
            if place >= 0:
                targets[c, i] = (place, {math.floor(place), math.ceil(place)})
                q = sketched[c] or [row[f"{c}__min"]] * len(cuts)
                low = row[f"{c}__min"] if cuts[i] == 0 else q[i]
                high = q[len(shares) + i]
                brackets[c, i] = (low, row[f"{c}__max"] if cuts[len(shares) + i] == 1 else high)
    split = max_series_rows
    largest = max(row[f"{c}__n"] for c in columns)
    if not isinstance(split, Split) and 4 * slack * largest <= split:
        split = Split(False, split)  # a bracket holds about 2 * slack of the rows
    at = _values_at(df, brackets, targets, split)
    missed = {k for k, (_, ranks) in targets.items() if any((k, r) not in at for r in ranks)}
    if missed:
        whole = {(c, i): (row[f"{c}__min"], row[f"{c}__max"]) for c, i in missed}
        at |= _values_at(df, whole, {k: targets[k] for k in missed}, max_series_rows)
    found: dict[str, list[float | None]] = {c: [None] * len(shares) for c in columns}
    for (c, i), (place, _) in targets.items():
        low, high = at[(c, i), math.floor(place)], at[(c, i), math.ceil(place)]
        found[c][i] = low + (high - low) * (place - math.floor(place))
    return found


def _values_at(
    df: DataFrame,
    brackets: dict[tuple[str, int], tuple[float, float]],
    targets: dict[tuple[str, int], tuple[float, set[int]]],
    max_series_rows: int | Split,
) -> dict[tuple[tuple[str, int], int], float]:
    """((column, share), rank) to the value with that rank, where it is inside the bracket."""
    if not brackets:
        return {}
    keys = list(brackets)
    below = df.agg(
        *[F.count_if(F.col(k[0]) < brackets[k][0]).alias(str(i)) for i, k in enumerate(keys)]
    ).first()
    inside = F.array(
        *[
            F.when(
                F.col(k[0]).between(*brackets[k]),
                F.struct(F.lit(i).alias("bracket"), F.col(k[0]).cast("double").alias("value")),
            )
            for i, k in enumerate(keys)
        ]
    )
    values = (
        df.select(F.inline(F.array_compact(inside)))
        .groupBy("bracket", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ranked = running_sum(values, {"upto": "n"}, ("bracket",), ("value",), max_series_rows)
    ranks = F.array(
        *[
            F.array(*[F.lit(r - below[i]) for r in sorted(targets[k][1])]).cast("array<bigint>")
            for i, k in enumerate(keys)
        ]
    )
    covered = F.filter(
        ranks[F.col("bracket")],
        lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("n")),
    )
    rows = ranked.select("bracket", "value", F.explode(covered).alias("rank")).collect()
    return {(keys[r["bracket"]], r["rank"] + below[r["bracket"]]): r["value"] for r in rows}
