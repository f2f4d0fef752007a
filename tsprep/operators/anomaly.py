"""Outlier flags: global and rolling z-score, local outlier factor."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData, WindowSpec
from pyspark.sql import functions as F

from ..functions.timing import micros
from ..session import keep
from .nearest import nearest
from .ordered import MAX_SERIES_ROWS, Split, over_rows
from .quantiles import exact_quantiles

# a row of its cell, one seen a span later, and what lies between; an own row sorts before the past rows of
# the same place
_OWN, _PAST, _BETWEEN = 0, 1, 2
#: Rows of one call on arrays, and the most rows of a cell, several of which share a call.
BUNDLE_ROWS, CELL_ROWS = 50_000, 12_500


def any_flag(columns: Sequence[str]) -> Column:
    """True when any ``<column>_anomaly`` is true; NULL counts as false."""
    return reduce(
        lambda a, b: a | b,
        [F.coalesce(F.col(f"{c}_anomaly"), F.lit(False)) for c in columns],
        F.lit(False),
    )


def _outside(value: Column, mean: Column, std: Column, threshold: float) -> Column:
    far = F.abs(value - mean) > F.lit(threshold) * std
    return F.coalesce(far & (std > 0), F.lit(False))


def detect_global(
    df: DataFrame,
    columns: Sequence[str],
    threshold: float = 3.0,
    series_by: Sequence[str] = (),
) -> DataFrame:
    """Flag values over ``threshold`` sample deviations from the mean of their series."""
    stats = [F.avg(c).alias(f"__avg_{c}") for c in columns]
    stats += [F.stddev_samp(c).alias(f"__std_{c}") for c in columns]
    if series_by:
        # partial aggregation makes this small; a hot series on the left is for AQE to split
        fitted = df.groupBy(*[F.col(s).alias(f"__s_{s}") for s in series_by]).agg(*stats)
        same = reduce(
            lambda a, b: a & b, [F.col(s).eqNullSafe(F.col(f"__s_{s}")) for s in series_by]
        )
        joined = df.join(fitted, same, "left")
        mean, std = (lambda c: F.col(f"__avg_{c}")), (lambda c: F.col(f"__std_{c}"))
    else:
        row = df.agg(*stats).first()
        joined = df
        mean = lambda c: F.lit(row[f"__avg_{c}"]).cast("double")
        std = lambda c: F.lit(row[f"__std_{c}"]).cast("double")
    flags = [
        _outside(F.col(c), mean(c), std(c), threshold).alias(f"{c}_anomaly") for c in columns
    ]
    return joined.select(*df.columns, *flags).withColumn("is_anomaly", any_flag(columns))


def detect_rolling(
    df: DataFrame,
    columns: Sequence[str],
    threshold: float = 3.0,
    rolling_window: int = 24,
    hours: float | None = None,
    series_by: Sequence[str] = ("id_line",),
    order_by: Sequence[str] = ("timestamp",),
    max_series_rows: int | Split = MAX_SERIES_ROWS,
) -> DataFrame:
    """Flag values far from the trailing window that ends with their own row.

    The window is ``rolling_window`` rows, or a span of ``hours`` when given.
    """
    if hours is not None:
        flagged = _over_span(df, columns, threshold, hours, series_by, order_by, max_series_rows)
        return flagged.withColumn("is_anomaly", any_flag(columns))

    def aggregates(w: WindowSpec) -> list[Column]:
        frame = w.rowsBetween(-(rolling_window - 1), 0)
        return [
            f(c).over(frame).alias(f"__{n}_{c}")
            for c in columns
            for n, f in (("avg", F.avg), ("std", F.stddev_samp))
        ]

    windowed = over_rows(
        df, aggregates, series_by, order_by, rolling_window - 1, max_series_rows=max_series_rows
    )
    flags = [
        _outside(F.col(c), F.col(f"__avg_{c}"), F.col(f"__std_{c}"), threshold).alias(
            f"{c}_anomaly"
        )
        for c in columns
    ]
    return windowed.select(*df.columns, *flags).withColumn("is_anomaly", any_flag(columns))


def _over_span(
    df: DataFrame,
    columns: Sequence[str],
    threshold: float,
    hours: float,
    series_by: Sequence[str],
    order_by: Sequence[str],
    max_series_rows: int | Split,
) -> DataFrame:
    """Frames of a time span, merged from summaries of count, mean and squared deviations.

    Nothing is ever subtracted, so an extreme value cannot harm frames that do not hold it, and the
    work does not grow with the number of rows a span holds.
    """
    span = int(hours * 3_600_000_000)
    rows = max_series_rows.rows if isinstance(max_series_rows, Split) else max_series_rows
    series = list(series_by)
    timed = df.withColumn("__us", micros(df, order_by[0]))
    values = [F.col(c).cast("double") for c in columns]
    at_time = timed.where("__us IS NOT NULL").groupBy(*series, F.col("__us").alias("__x")).agg(
        *[F.count(v).cast("double").alias(f"n{i}") for i, v in enumerate(values)],
        *[F.coalesce(F.avg(v), F.lit(0.0)).alias(f"m{i}") for i, v in enumerate(values)],
        *[F.coalesce(F.var_pop(v) * F.count(v), F.lit(0.0)).alias(f"q{i}") for i, v in enumerate(values)],
    )
    frames = span_frames(keep(at_time), series, len(columns), span, max(1, min(rows, CELL_ROWS)))
    frames = frames.select(
        *[F.col(c).alias(f"__s_{c}") for c in series], F.col("__x"),
        *[F.col(f"m{i}").alias(f"__m{i}") for i in range(len(columns))],
        *[
            F.sqrt(F.try_divide(f"q{i}", F.when(F.col(f"n{i}") > 1, F.col(f"n{i}") - 1))).alias(f"__d{i}")
            for i in range(len(columns))
        ],
    )
    same = reduce(
        lambda a, b: a & b,
        [timed[c].eqNullSafe(frames[f"__s_{c}"]) for c in series],
        timed["__us"] == frames["__x"],
    )
    return timed.join(frames, same, "left").select(
        *[timed[c] for c in df.columns],
        *[
            _outside(F.col(c), F.col(f"__m{i}"), F.col(f"__d{i}"), threshold).alias(f"{c}_anomaly")
            for i, c in enumerate(columns)
        ],
    )


def span_frames(
    rows: DataFrame, series: Sequence[str], width: int, span: int, limit: int, own: bool = True
) -> DataFrame:
    """For each row of ``series, __x`` and summaries ``n, m, q`` the merged summary of the rows of its
    series from ``__x - span`` to ``__x``, or to just before ``__x`` without ``own``.

    ``__x`` is whole and occurs once in a series. It is cut into blocks as long as the span and these into
    cells, so many that none holds more than ``limit`` rows. A frame is the end of the cell one span
    before, cells in between and the beginning of the row's own cell: a row travels to its own cell and
    to the one a span later. The cells in between are frames too, over the table of cells.
    """
    number = _cells(rows, series, span, limit)
    away, cell = F.pmod("__x", F.lit(span)).alias("__away"), _cell(span, number).alias("__cell")
    names = [f"{x}{i}" for x in "nmq" for i in range(width)]
    placed = rows.select(*series, away, cell, *names)
    if number == 1:
        return _bundled(placed, None, series, width, span, 1, own)
    cells = keep(_cell_totals(placed, series, width))
    between = span_frames(cells, series, width, number - 1, limit, own=False)
    return _bundled(placed, between, series, width, span, number, own)


def _cell(span: int, number: int) -> Column:
    """The cell of ``__x``, of which a span has ``number``; one span later it is ``number`` more."""
    away = F.pmod("__x", F.lit(span))
    share = F.least(F.floor(away * F.lit(float(number)) / span), F.lit(number - 1))
    return F.expr(f"(__x - pmod(__x, {span}L)) div {span}L") * number + share.cast("bigint")


def _cells(rows: DataFrame, series: Sequence[str], span: int, limit: int) -> int:
    """Into how many cells a span is cut so that none holds more than ``limit`` rows."""
    number = 1
    while True:
        sizes = rows.groupBy(*series, _cell(span, number).alias("__cell")).agg(F.count(F.lit(1)).alias("n"))
        most = sizes.agg(F.max("n")).first()[0] or 0
        if most <= limit or number >= span:
            return number
        number = min(span, number * max(2, -(-2 * most // limit)))


def _parts(table: pa.Table, series: Sequence[str]) -> np.ndarray:
    """Numbers the series and cells of the rows, NULL keys included."""
    part = np.zeros(table.num_rows, np.int64)
    for name in (*series, "__cell"):
        codes = table[name].combine_chunks().dictionary_encode(null_encoding="encode").indices
        codes = codes.to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.unique(part * (codes.max(initial=0) + 1) + codes, return_inverse=True)[1]
    return part


def _summaries(table: pa.Table, width: int) -> list[np.ndarray]:
    """Arrays of counts, means and squared deviations, a column for each value."""
    return [
        np.column_stack([table[f"{x}{i}"].to_numpy() for i in range(width)]).astype(np.float64) for x in "nmq"
    ]


def _bundles(df: DataFrame, series: Sequence[str], total: int) -> GroupedData:
    """Cells dealt into groups of about ``BUNDLE_ROWS`` rows, each of which is one call on arrays."""
    groups = max(1, -(-total // BUNDLE_ROWS))
    return df.groupBy(F.pmod(F.xxhash64(*series, "__cell"), F.lit(groups)).alias("__group"))


def _cell_totals(placed: DataFrame, series: Sequence[str], width: int) -> DataFrame:
    """One row for each cell, whose number is its ``__x``."""

    def run(table: pa.Table) -> pa.Table:
        part = _parts(table, series)
        order = np.argsort(part, kind="stable")
        first = np.flatnonzero(np.diff(part[order], prepend=-1))
        n, m, q = (x[order] for x in _summaries(table, width))
        total = np.add.reduceat(n, first)
        mean = np.divide(np.add.reduceat(n * m, first), total, out=np.zeros_like(total), where=total > 0)
        apart = m - mean[part[order]]
        made = [total, mean, np.add.reduceat(q + n * apart * apart, first)]
        out = {c: table[c].take(pa.array(order[first])) for c in series}
        out["__x"] = table["__cell"].take(pa.array(order[first]))
        out |= {f"{x}{i}": pa.array(made[j][:, i]) for j, x in enumerate("nmq") for i in range(width)}
        return pa.table(out)

    return _bundles(placed, series, placed.count()).applyInArrow(run, _shape(placed, series, width))


def _shape(df: DataFrame, series: Sequence[str], width: int) -> str:
    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in series]
    return ", ".join([*kinds, "__x bigint", *[f"{x}{i} double" for x in "nmq" for i in range(width)]])


def _bundled(
    placed: DataFrame, between: DataFrame | None, series: Sequence[str], width: int, span: int, number: int,
    own: bool,
) -> DataFrame:
    """The frames of all own rows; ``between`` has one row for each cell."""
    names = [f"{x}{i}" for x in "nmq" for i in range(width)]
    kinds = F.explode(F.array(F.lit(_OWN), F.lit(_PAST))).alias("__kind")
    both = placed.select("*", kinds).withColumn(
        "__cell", F.col("__cell") + F.when(F.col("__kind") == _PAST, number).otherwise(0)
    )
    if between is not None:
        middle = between.select(
            *series, F.lit(0).cast("bigint").alias("__away"), F.col("__x").alias("__cell"), *names,
            F.lit(_BETWEEN).alias("__kind"),
        )
        both = both.unionByName(middle)

    def run(table: pa.Table) -> pa.Table:
        part, kind = _parts(table, series), table["__kind"].to_numpy()
        # the next past row begins a row's frame
        order = np.lexsort((kind, table["__away"].to_numpy(), part))
        part, kind = part[order], kind[order]
        values = [x[order] for x in _summaries(table, width)]
        mine, past = np.flatnonzero(kind == _OWN), np.flatnonzero(kind == _PAST)
        lower = merge_forward(*(x[mine] for x in values), part[mine])
        if not own:  # up to the row before
            same = (np.diff(part[mine], prepend=-1) == 0)[:, None]
            lower = [np.where(same, np.roll(x, 1, axis=0), 0.0) for x in lower]
        upper = merge_forward(*(x[past[::-1]] for x in values), part[past[::-1]])
        upper = [x[::-1] for x in upper]
        after = np.searchsorted(past, mine)
        there = np.append(past, len(part))[after]
        found = np.append(part, -1)[there] == part[mine]
        frame = [_taken(x, after, found) for x in upper]
        middle = np.flatnonzero(kind == _BETWEEN)
        if len(middle):
            at = np.full(part.max() + 1, -1)
            at[part[middle]] = np.arange(len(middle))
            at = at[part[mine]]
            frame = _joined(frame, [_taken(x[middle], at, at >= 0) for x in values])
        frame = _joined(frame, lower)
        picked = pa.array(order[mine])
        out = {c: table[c].take(picked) for c in series}
        cell, away = (table[c].take(picked).to_numpy() for c in ("__cell", "__away"))
        out["__x"] = pa.array(cell // number * span + away)
        out |= {f"{x}{i}": pa.array(frame[j][:, i]) for j, x in enumerate("nmq") for i in range(width)}
        return pa.table(out)

    return _bundles(both, series, placed.count()).applyInArrow(run, _shape(placed, series, width))


def _taken(x: np.ndarray, at: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Rows of ``x``, and empty ones where there is none."""
    out = np.zeros((len(at), x.shape[1]))
    out[there] = x[at[there]]
    return out


def _joined(a: Sequence[np.ndarray], b: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Summaries of both; the empty one has no rows."""
    (n1, m1, q1), (n2, m2, q2) = a, b
    total, apart = n1 + n2, m2 - m1
    share = np.divide(n2, total, out=np.zeros_like(n2), where=total > 0)
    return [total, m1 + apart * share, q1 + q2 + apart * apart * n1 * share]


def merge_forward(n: np.ndarray, m: np.ndarray, q: np.ndarray, part: np.ndarray) -> list[np.ndarray]:
    """For each row the merged summary of the rows of its part up to it, by doubling.

    Rows hold counts, means and squared deviations of several columns; parts are runs.
    """
    n, m, q = n.copy(), m.copy(), q.copy()
    step = 1
    while step < len(part):
        to = np.flatnonzero(part[step:] == part[:-step]) + step
        if not len(to):
            break
        n[to], m[to], q[to] = _joined(*([x[i] for x in (n, m, q)] for i in (to - step, to)))
        step *= 2
    return [n, m, q]


def anomaly_details(flagged: DataFrame, columns: Sequence[str], threshold: float = 3.0) -> DataFrame:
    """One row per column: flagged count, rate, smallest and largest flagged value."""
    aggregates = []
    for c in columns:
        hit = F.when(F.col(f"{c}_anomaly"), F.col(c))
        aggregates.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count_if(f"{c}_anomaly").alias("flagged"),
                F.try_divide(F.count_if(f"{c}_anomaly"), F.count(F.lit(1))).alias("rate"),
                F.min(hit).cast("double").alias("min_flagged"),
                F.max(hit).cast("double").alias("max_flagged"),
                F.lit(float(threshold)).alias("threshold"),
            )
        )
    return flagged.agg(F.array(*aggregates).alias("d")).select(F.inline("d"))


def remove_outliers(flagged: DataFrame) -> DataFrame:
    """Drop flagged rows; a NULL flag keeps the row."""
    return flagged.filter(~F.coalesce(F.col("is_anomaly"), F.lit(False)))


def removed_count(flagged: DataFrame) -> DataFrame:
    return flagged.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("is_anomaly").alias("removed")
    )


def flag_top_share(scored: DataFrame, score: str, contamination: float) -> DataFrame:
    """Flag scores above the (1 - contamination) percentile."""
    cut = exact_quantiles(scored, [score], [1 - contamination])[score][0]
    over = F.col(score) > F.lit(cut).cast("double")
    return scored.withColumn("is_anomaly", F.coalesce(over, F.lit(False)))


def local_outlier_factor(
    df: DataFrame,
    columns: Sequence[str],
    key: str | None = None,
    k: int = 20,
    contamination: float = 0.1,
) -> DataFrame:
    """Append ``lof`` and ``is_anomaly``. Rows with a NULL coordinate get NULL and no flag.

    Of equally distant neighbours those with the smaller ``key`` count; without one it is ``event_id``
    where there is one, else the smaller place.

    Rows at the same place have the same factor, so all steps run on distinct places; a
    place with many copies counts as that many neighbours without ever pairing them.
    """
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    at = F.struct(*[F.col(c).cast("double").alias(c) for c in columns])
    if key is None:
        key = "event_id" if "event_id" in df.columns else "__place"
    donors = df.filter(complete).withColumn("__place", at)
    found = nearest(None, donors, columns, k + 1, key, F.col("__place"))
    # the nearest entry is the row itself, or a copy of it, which counts the same
    others = F.slice("neighbours", 2, k)
    graph = keep(
        found.select(
            *columns,
            F.transform(
                others, lambda n: F.struct(n["distance"].alias("d"), n["payload"].alias("at"))
            ).alias("near"),
        )
    )
    reach_of = graph.select(
        F.struct(*columns).alias("at"), F.try_element_at("near", F.lit(-1))["d"].alias("kdist")
    )
    pairs = graph.select(F.struct(*columns).alias("me"), F.inline("near"))
    reach = pairs.join(reach_of, "at").groupBy("me").agg(
        (1 / (F.avg(F.greatest("kdist", "d")) + F.lit(1e-10))).alias("lrd")
    )
    density = keep(reach)
    around = pairs.join(density.select(F.col("me").alias("at"), "lrd"), "at")
    around = around.groupBy("me").agg(F.avg("lrd").alias("around"))
    factor = around.join(density, "me").select(
        *[F.col("me")[c].alias(f"__{c}") for c in columns],
        (F.col("around") / F.col("lrd")).alias("lof"),
    )
    same = reduce(
        lambda a, b: a & b,
        [F.col(c).cast("double") == F.col(f"__{c}") for c in columns],
    )
    scored = df.join(factor, same, "left").select(*df.columns, "lof")
    return flag_top_share(keep(scored), "lof", contamination)
