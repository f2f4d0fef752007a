"""Windows over ordered series of any length.

A plain ``Window.partitionBy(series)`` puts one series into one task. That is the best
plan while every series is short, and it fails when one line holds a third of the table or
when there is no series key at all. The functions here look at the longest series first:

* short series: one shuffle on the series key, ordinary windows;
* long series: rows get their exact position by a range shuffle (which balances any key or
  time distribution), and windows run over equally long chunks of that position. Rows near a
  chunk border are copied to the neighbouring chunk, and unlimited look-backs pass through a
  table with one row per chunk, which is scanned in blocks and then block by block.

Both ways return the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import keep

# a longer series is cut; small chunks spread it well, and there is one carry row per chunk
MAX_SERIES_ROWS = 250_000
CHUNK_ROWS = 50_000
# chunks are scanned in blocks of this many, then the blocks: a scan over all of a table without a
# series key sees one row per 200 million
BLOCK_CHUNKS = 4_096

SEQ = "__seq"
_PART, _POS, _AT, _CHUNK, _HOME = "__part", "__pos", "__at", "__chunk", "__home"
_BLOCK = "__block"


class Split(NamedTuple):
    """Whether series must be cut into chunks, and how many rows a chunk holds."""

    long: bool
    rows: int


def choose_split(
    df: DataFrame, series_by: Sequence[str], max_series_rows: int | Split = MAX_SERIES_ROWS
) -> Split:
    """Count the longest series (an aggregate over the key columns only)."""
    if isinstance(max_series_rows, Split):
        return max_series_rows
    if series_by:
        sizes = df.groupBy(*series_by).agg(F.count(F.lit(1)).alias("n"))
        longest = sizes.agg(F.max("n")).first()[0] or 0
    else:
        longest = df.count()
    return Split(longest > max_series_rows, max(1, min(max_series_rows, CHUNK_ROWS)))


def number_rows(
    df: DataFrame, series_by: Sequence[str], order_by: Sequence[str], name: str = SEQ
) -> DataFrame:
    """Add ``name``, the 0-based position of each row inside its series.

    No task sees more than one range of the sort order, however skewed keys or times are.
    The ranged rows are written once, because range bounds come from a sample and both uses
    below must see the same bounds.
    """
    spark = df.sparkSession
    keys = [*series_by, *order_by]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = keep(
        df.repartitionByRange(parts, *keys)
        .sortWithinPartitions(*keys)
        .withColumn(_PART, F.spark_partition_id())
        .withColumn(_POS, F.monotonically_increasing_id())
    )
    by_part = Window.partitionBy(*series_by).orderBy(_PART)
    starts = ranged.groupBy(*series_by, _PART).agg(
        F.min(_POS).alias("__first"), F.count(F.lit(1)).alias("__rows")
    )
    earlier = F.sum("__rows").over(by_part.rowsBetween(Window.unboundedPreceding, -1))
    # written as well: Spark then knows its size before it joins, and the rows need not move again
    starts = keep(
        starts.select(
            *[F.col(c).alias(f"__s_{c}") for c in series_by],
            F.col(_PART).alias("__p"),
            (F.coalesce(earlier, F.lit(0)) - F.col("__first")).alias("__shift"),
        )
    )
    same = reduce(
        lambda a, b: a & b,
        [ranged[c].eqNullSafe(starts[f"__s_{c}"]) for c in series_by],
        ranged[_PART] == starts["__p"],
    )
    return ranged.join(starts, same).select(
        *[ranged[c] for c in df.columns], (F.col(_POS) + F.col("__shift")).alias(name)
    )


def positioned(
    df: DataFrame, series_by: Sequence[str], order_by: Sequence[str], split: Split
) -> DataFrame:
    if split.long:
        return number_rows(df, series_by, order_by)
    w = Window.partitionBy(*series_by).orderBy(*order_by)
    return df.withColumn(SEQ, (F.row_number().over(w) - 1).cast("bigint"))


def over_rows(
    df: DataFrame,
    make_columns: Callable[[WindowSpec], Sequence[Column]],
    series_by: Sequence[str],
    order_by: Sequence[str],
    before: int = 0,
    after: int = 0,
    max_series_rows: int | Split = MAX_SERIES_ROWS,
) -> DataFrame:
    """Append window columns that look at most ``before`` rows back and ``after`` ahead."""
    split = choose_split(df, series_by, max_series_rows)
    if not split.long:
        w = Window.partitionBy(*series_by).orderBy(*order_by)
        return df.select("*", *make_columns(w))
    rows = max(split.rows, before, after)
    seq = F.col(_AT)
    home = F.floor(seq / rows)
    offset = seq - home * rows
    chunks = F.array_compact(
        F.array(
            home,
            F.when(offset >= rows - before, home + 1),
            F.when((offset < after) & (home > 0), home - 1),
        )
    )
    spread = (
        number_rows(df, series_by, order_by, _AT)
        .withColumn(_HOME, home)
        .withColumn(_CHUNK, F.explode(chunks))
    )
    w = Window.partitionBy(*series_by, _CHUNK).orderBy(_AT)
    windowed = spread.select("*", *make_columns(w))
    return windowed.filter(F.col(_CHUNK) == F.col(_HOME)).drop(_AT, _HOME, _CHUNK)


def carry(
    df: DataFrame,
    forward: dict[str, Column],
    backward: dict[str, Column],
    series_by: Sequence[str],
    order_by: Sequence[str],
    split: Split,
) -> DataFrame:
    """Append the nearest non-NULL value at or before (``forward``) or at or after
    (``backward``) each row, however far away. ``df`` comes from :func:`positioned`."""
    up_to_here = (Window.unboundedPreceding, 0)
    if not split.long:
        w = Window.partitionBy(*series_by)
        # a preceding frame on the descending order: a following frame would be quadratic
        asc = w.orderBy(*order_by).rowsBetween(*up_to_here)
        desc = w.orderBy(*[F.col(c).desc() for c in order_by]).rowsBetween(*up_to_here)
        return df.select(
            "*",
            *[F.last(c, True).over(asc).alias(n) for n, c in forward.items()],
            *[F.last(c, True).over(desc).alias(n) for n, c in backward.items()],
        )
    chunked = df.withColumn(_CHUNK, F.floor(F.col(SEQ) / split.rows))
    w = Window.partitionBy(*series_by, _CHUNK)
    asc = w.orderBy(SEQ).rowsBetween(*up_to_here)
    desc = w.orderBy(F.col(SEQ).desc()).rowsBetween(*up_to_here)
    inside = chunked.select(
        "*",
        *[F.last(c, True).over(asc).alias(f"__in_{n}") for n, c in forward.items()],
        *[F.last(c, True).over(desc).alias(f"__in_{n}") for n, c in backward.items()],
    )
    edges = chunked.groupBy(*series_by, _CHUNK).agg(
        *[F.max_by(c, F.when(c.isNotNull(), F.col(SEQ))).alias(n) for n, c in forward.items()],
        *[F.min_by(c, F.when(c.isNotNull(), F.col(SEQ))).alias(n) for n, c in backward.items()],
    )
    edges = keep(_carried(edges, list(forward), list(backward), series_by))
    return _beside(inside, edges, series_by).select(
        *df.columns,
        *[F.coalesce(f"__in_{n}", f"__out_{n}").alias(n) for n in [*forward, *backward]],
    )


def running_sum(
    df: DataFrame,
    sums: dict[str, str],
    series_by: Sequence[str],
    order_by: Sequence[str],
    max_series_rows: int | Split = MAX_SERIES_ROWS,
) -> DataFrame:
    """Append, for each ``name: value`` of ``sums``, the sum of the value over this row and all
    earlier rows of the series."""
    split = choose_split(df, series_by, max_series_rows)
    up_to_here = (Window.unboundedPreceding, 0)
    if not split.long:
        w = Window.partitionBy(*series_by).orderBy(*order_by).rowsBetween(*up_to_here)
        return df.select("*", *[F.sum(v).over(w).alias(n) for n, v in sums.items()])
    chunked = number_rows(df, series_by, order_by).withColumn(
        _CHUNK, F.floor(F.col(SEQ) / split.rows)
    )
    w = Window.partitionBy(*series_by, _CHUNK).orderBy(SEQ).rowsBetween(*up_to_here)
    inside = chunked.select("*", *[F.sum(v).over(w).alias(f"__in_{n}") for n, v in sums.items()])
    edges = chunked.groupBy(*series_by, _CHUNK).agg(*[F.sum(v).alias(n) for n, v in sums.items()])
    edges = keep(_summed(edges, list(sums), series_by))
    return _beside(inside, edges, series_by).select(
        *df.columns, *[(F.col(f"__in_{n}") + F.col(f"__out_{n}")).alias(n) for n in sums]
    )


def _carried(
    edges: DataFrame, forward: Sequence[str], backward: Sequence[str], series_by: Sequence[str]
) -> DataFrame:
    """Of one row per chunk, the nearest non-NULL values of the chunks before and after it."""
    others = (Window.unboundedPreceding, -1)

    def scan(rows: DataFrame, at: str, *within: str) -> DataFrame:
        w = Window.partitionBy(*series_by, *within)
        asc = w.orderBy(at).rowsBetween(*others)
        desc = w.orderBy(F.col(at).desc()).rowsBetween(*others)
        return rows.select(
            *series_by, at, *within,
            *[F.last(n, True).over(asc).alias(n) for n in forward],
            *[F.last(n, True).over(desc).alias(n) for n in backward],
        )

    edges = edges.withColumn(_BLOCK, F.floor(F.col(_CHUNK) / BLOCK_CHUNKS))
    where = {n: F.when(F.col(n).isNotNull(), F.col(_CHUNK)) for n in (*forward, *backward)}
    blocks = edges.groupBy(*series_by, _BLOCK).agg(
        *[F.max_by(n, where[n]).alias(n) for n in forward],
        *[F.min_by(n, where[n]).alias(n) for n in backward],
    )
    return _two_levels(
        scan(edges, _CHUNK, _BLOCK), scan(blocks, _BLOCK), [*forward, *backward], series_by,
        lambda inside, outside: F.coalesce(inside, outside),
    )


def _summed(edges: DataFrame, names: Sequence[str], series_by: Sequence[str]) -> DataFrame:
    """Of one row per chunk, the sums over the chunks before it."""

    def scan(rows: DataFrame, at: str, *within: str) -> DataFrame:
        w = Window.partitionBy(*series_by, *within).orderBy(at)
        earlier = w.rowsBetween(Window.unboundedPreceding, -1)
        before = [F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) for n in names]
        return rows.select(*series_by, at, *within, *before)

    edges = edges.withColumn(_BLOCK, F.floor(F.col(_CHUNK) / BLOCK_CHUNKS))
    blocks = edges.groupBy(*series_by, _BLOCK).agg(*[F.sum(n).alias(n) for n in names])
    return _two_levels(
        scan(edges, _CHUNK, _BLOCK), scan(blocks, _BLOCK), names, series_by,
        lambda inside, outside: inside + outside,
    )


def _two_levels(
    inside: DataFrame,
    blocks: DataFrame,
    names: Sequence[str],
    series_by: Sequence[str],
    merge: Callable[[Column, Column], Column],
) -> DataFrame:
    """What a chunk sees in its block merged with what its block sees, named to stand ``_beside`` rows."""
    outside = blocks.select(
        *[F.col(c).alias(f"__s_{c}") for c in series_by],
        F.col(_BLOCK).alias("__c"),
        *[F.col(n).alias(f"__far_{n}") for n in names],
    )
    both = _beside(inside, outside, series_by, _BLOCK)
    return both.select(
        *[inside[c].alias(f"__s_{c}") for c in series_by],
        inside[_CHUNK].alias("__c"),
        *[merge(inside[n], F.col(f"__far_{n}")).alias(f"__out_{n}") for n in names],
    )


def _beside(
    rows: DataFrame, edges: DataFrame, series_by: Sequence[str], at: str = _CHUNK
) -> DataFrame:
    """Join each row to the edge row of its chunk or block; NULL series keys count as equal."""
    same = reduce(
        lambda a, b: a & b,
        [rows[c].eqNullSafe(edges[f"__s_{c}"]) for c in series_by],
        rows[at] == edges["__c"],
    )
    return rows.join(edges, same, "left")
