"""Profiles, summaries, comparisons and correlations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import keep
from .impute import numeric_columns
from .ordered import MAX_SERIES_ROWS, Split, running_sum
from .quantiles import exact_quantiles

# relative rank error of quantile sketches is one in SKETCH; every task sends one of this size
SKETCH = 1_000
# Approximate profiles show values that make up this share of a column's known rows. The sketch that
# finds them is off by at most 3.5 / 16,384 of the rows, so none of them is missed.
FREQUENT = 0.001
_TRACKED, _RETURNED, _OFF = 12_288, 2_000, 3.5 / 16_384


def named(column: str) -> Column:
    """The column of that very name, whatever characters are in it."""
    return F.col("`" + column.replace("`", "``") + "`")


def profile_table(df: DataFrame) -> DataFrame:
    """Rows, columns, missing cells and duplicate rows (copies beyond the first).

    Fingerprints of 16 bytes are counted first; only rows whose fingerprint occurs again are then
    counted whole, so a table without copies never travels.
    """
    nulls = sum((named(c).isNull().cast("bigint") for c in df.columns), F.lit(0).cast("bigint"))
    totals = df.agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(nulls), F.lit(0)).alias("missing_cells")
    )
    marks = [F.xxhash64(F.lit(i), *_printable(df)).alias(f"__print{i}") for i in (1, 2)]
    marked = df.select("*", *marks)
    prints = marked.groupBy("__print1", "__print2").agg(F.count(F.lit(1)).alias("__n"))
    again = marked.join(prints.where("__n > 1").drop("__n"), ["__print1", "__print2"], "left_semi")
    groups = again.groupBy(*map(named, df.columns)).agg(F.count(F.lit(1)).alias("__n"))
    zero = F.lit(0).cast("bigint")
    copies = groups.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicate_rows"))
    both = totals.withColumn("duplicate_rows", zero).unionByName(
        copies.select("duplicate_rows", zero.alias("rows"), zero.alias("missing_cells"))
    )
    return both.agg(
        F.sum("rows").alias("rows"),
        F.lit(len(df.columns)).cast("bigint").alias("columns"),
        F.sum("missing_cells").alias("missing_cells"),
        F.sum("duplicate_rows").alias("duplicate_rows"),
    )


def _printable(df: DataFrame) -> list[Column]:
    """NULL told from every value, and both zeros alike, as grouping has it."""
    out = []
    for f in df.schema.fields:
        c = named(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(c == 0, F.lit(0.0)).otherwise(c)
        out += [named(f.name).isNull(), c]
    return out


def _unpivot(row: DataFrame, columns: Sequence[str], names: Sequence[str]) -> DataFrame:
    """One wide row ``<number of the column>__<statistic>`` to one row per column."""
    per_column = [
        F.struct(F.lit(c).alias("column"), *[F.col(f"{i}__{n}").alias(n) for n in names])
        for i, c in enumerate(columns)
    ]
    return row.select(F.inline(F.array(*per_column)))


def _statistics(
    df: DataFrame, c: str, minimal: bool, exact: dict[str, list] | None
) -> dict[str, Column]:
    """Booleans are numbers 0 and 1; dates and times have only a smallest and a largest value."""
    field = df.schema[c].dataType
    none = F.lit(None).cast("double")
    known = named(c)
    if isinstance(field, T.NumericType):
        x = known.cast("double")
    elif isinstance(field, T.BooleanType):
        x = known.cast("int").cast("double")
    else:
        x = none
    moment = none.cast("timestamp")
    if isinstance(field, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        moment = known.cast("timestamp")
    length = F.length(known) if isinstance(field, T.StringType) else none.cast("int")
    stats = {
        "count": F.count(known),
        "missing": F.count_if(known.isNull()),
        "mean": F.avg(x),
        "std": F.stddev_samp(x),
        "min": F.min(x),
        "max": F.max(x),
        "zeros": F.count_if(x == 0),
        "negatives": F.count_if(x < 0),
        "skewness": F.skewness(x),
        "kurtosis": F.kurtosis(x),
        "min_length": F.min(length).cast("bigint"),
        "mean_length": F.avg(length),
        "max_length": F.max(length).cast("bigint"),
        "earliest": F.min(moment),
        "latest": F.max(moment),
    }
    if not minimal:
        shares = [0.25, 0.5, 0.75]
        sketch = F.percentile_approx(x, shares, SKETCH)
        for i, name in enumerate(("q25", "q50", "q75")):
            stats[name] = sketch[i] if exact is None else F.lit(exact.get(c, [None] * 3)[i])
            stats[name] = stats[name].cast("double")
        if exact is None:
            # of sets and the like, which have no distinct values in Spark, the text counts
            plain = known if isinstance(field, T.AtomicType) else _text(df, c)
            stats["distinct"] = F.approx_count_distinct(plain)
    return stats


def _text(df: DataFrame, c: str) -> Column:
    field = df.schema[c].dataType
    if isinstance(field, (T.MapType, T.VariantType)):
        return F.to_json(named(c))
    return named(c).cast("string")


def _value_table(df: DataFrame, only: dict[str, list[int]] | None = None) -> DataFrame:
    """(column, value as text, rows): all columns counted in one shuffle.

    With ``only``, of each column just the values with one of these hashes: others never travel.
    """
    columns = list(df.columns if only is None else only)
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), _text(df, c).alias("value")) for c in columns]
    )
    cells = df.select(F.inline(cells)).filter(F.col("value").isNotNull())
    if only is not None:
        mark, of = F.xxhash64("value"), F.col("column")
        wanted = [(of == c) & mark.isin(hashes) for c, hashes in only.items()]
        cells = cells.filter(reduce(lambda a, b: a | b, wanted))
    return cells.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def _frequent_values(df: DataFrame, row: Row, top: int) -> DataFrame | None:
    """Exact counts of the values that may be among the ``top`` ones with at least ``FREQUENT`` rows.

    ``row`` holds each column's sketch of hashes, a few thousand numbers whatever the table's size.
    """
    only = {}
    for i, c in enumerate(df.columns):
        rows = row[f"{i}__count"]
        found = sorted(((x["count"], x["item"]) for x in row[f"{i}__sketch"]), reverse=True)
        least = max(FREQUENT, found[top - 1][0] / rows if len(found) >= top else 0) - 2 * _OFF
        if hashes := [item for n, item in found if n >= least * rows]:
            only[c] = hashes
    if not only:
        return None
    least = F.coalesce(
        *[F.when(F.col("column") == c, FREQUENT * row[f"{i}__count"]) for i, c in enumerate(df.columns)]
    )
    return _value_table(df, only).filter(F.col("n") >= least)


def profile_columns(
    df: DataFrame, minimal: bool = False, approximate: bool = True, top: int = 5
) -> DataFrame:
    """One row per column.

    ``minimal`` leaves out quartiles, distinct counts and top values. ``approximate`` uses
    fixed-size sketches for quartiles and distinct counts, and shows the most frequent values among
    those that hold at least a thousandth of the known rows: a sketch finds them, a second pass counts
    them exactly. The exact forms cost memory and a shuffle that grow with the number of distinct
    values.
    """
    exact = None
    if not minimal and not approximate:
        exact = exact_quantiles(df, numeric_columns(df), [0.25, 0.5, 0.75])
    stats = [_statistics(df, c, minimal, exact) for c in df.columns]
    names = list(stats[0])
    wanted = [s.alias(f"{i}__{n}") for i, of in enumerate(stats) for n, s in of.items()]
    if minimal:
        return _unpivot(df.agg(*wanted), df.columns, names)
    if approximate:
        marked = [
            F.when(_text(df, c).isNotNull(), F.xxhash64(_text(df, c))).alias(f"__mark{i}")
            for i, c in enumerate(df.columns)
        ]
        sketches = [
            F.expr(
                f"approx_top_k(__mark{i}, {_RETURNED}, {_TRACKED}) FILTER (WHERE __mark{i} IS NOT NULL)"
            ).alias(f"{i}__sketch")
            for i in range(len(df.columns))
        ]
        wide = df.select("*", *marked).agg(*wanted, *sketches)
        row = wide.first()
        wide = df.sparkSession.createDataFrame([row], wide.schema)
        values = _frequent_values(df, row, top)
    else:
        wide, values = df.agg(*wanted), _value_table(df)
    profile = _unpivot(wide, df.columns, names)
    if values is None:
        return profile.withColumn("top_values", F.lit(None).cast("array<string>"))
    w = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    frequent = (
        values.withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= top)
        .groupBy("column")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "value", "n"))).alias("t"))
        .select(
            F.col("column").alias("__c"),
            F.transform(
                "t", lambda r: F.concat(r["value"], F.lit("="), r["n"].cast("string"))
            ).alias("top_values"),
        )
    )
    profile = profile.join(frequent, F.col("column") == F.col("__c"), "left").drop("__c")
    if not approximate:
        distinct = values.groupBy(F.col("column").alias("__c")).agg(
            F.count(F.lit(1)).alias("distinct")
        )
        profile = profile.join(distinct, F.col("column") == F.col("__c"), "left").drop("__c")
        profile = profile.withColumn("distinct", F.coalesce("distinct", F.lit(0)))
    return profile


def describe(
    df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False
) -> DataFrame:
    """count, mean, std, min, quartiles and max of the numeric columns."""
    columns = list(columns or numeric_columns(df))
    shares = [0.25, 0.5, 0.75]
    exact = None if approximate else exact_quantiles(df, columns, shares)
    names = ("count", "mean", "std", "min", "25%", "50%", "75%", "max")
    wide = []
    for i, c in enumerate(columns):
        if exact is None:
            sketch = F.percentile_approx(named(c), shares, SKETCH).cast("array<double>")
            q = [sketch[j] for j in range(3)]
        else:
            q = [F.lit(x).cast("double") for x in exact[c]]
        x = named(c)
        stats = (
            F.count(x), F.avg(x), F.stddev_samp(x), F.min(x).cast("double"),
            q[0], q[1], q[2], F.max(x).cast("double"),
        )
        wide += [s.alias(f"{i}__{n}") for n, s in zip(names, stats)]
    return _unpivot(df.agg(*wide), columns, names)


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Equal-width bins between the smallest and largest value; the last one is closed."""
    low, high = df.agg(F.min(column).cast("double"), F.max(column).cast("double")).first()
    if low is None:
        return df.sparkSession.createDataFrame(
            [], "bin bigint, lower double, upper double, count bigint"
        )
    width = (high - low) / bins or 1.0
    at = F.floor((F.col(column) - F.lit(low)) / F.lit(width))
    counts = (
        df.filter(F.col(column).isNotNull())
        .groupBy(F.least(at, F.lit(bins - 1)).alias("__bin"))
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    every = df.sparkSession.range(bins).select(F.col("id").alias("bin"))
    return every.join(counts, F.col("bin") == F.col("__bin"), "left").select(
        "bin",
        (F.lit(low) + F.col("bin") * F.lit(width)).alias("lower"),
        (F.lit(low) + (F.col("bin") + 1) * F.lit(width)).alias("upper"),
        F.coalesce("__n", F.lit(0)).alias("count"),
    )


def summarize(
    df: DataFrame, target: str | None = None, approximate: bool = True, categories: int | None = None
) -> DataFrame:
    """The column profile in long form, with each column's association to ``target``.

    Numeric columns get their Pearson correlation with the target; text columns get the mean
    target of each of their values, or of the ``categories`` most frequent ones if that is given.
    """
    parts = _long(profile_columns(df, approximate=approximate))
    if target is None:
        return parts
    numeric = [c for c in numeric_columns(df) if c != target]
    if numeric:
        wide = df.agg(*[_corr(c, target).alias(c) for c in numeric])
        pairs = [
            F.struct(
                F.lit(c).alias("column"), F.lit("target_corr").alias("statistic"),
                F.col(c).alias("value"),
            )
            for c in numeric
        ]
        parts = parts.unionByName(wide.select(F.inline(F.array(*pairs))))
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if text:
        cells = F.array(
            *[F.struct(F.lit(c).alias("column"), F.col(c).alias("v")) for c in text]
        )
        means = (
            df.select(F.col(target).cast("double").alias("__y"), F.inline(cells))
            .filter(F.col("v").isNotNull())
            .groupBy("column", "v")
            .agg(F.count(F.lit(1)).alias("n"), F.avg("__y").alias("value"))
        )
        if categories is not None:
            w = Window.partitionBy("column").orderBy(F.desc("n"), "v")
            means = means.withColumn("rank", F.row_number().over(w))
            means = means.filter(F.col("rank") <= categories)
        parts = parts.unionByName(
            means.select("column", F.concat(F.lit("target_mean:"), "v").alias("statistic"), "value")
        )
    return parts


def _corr(a: str, b: str) -> Column:
    """Pearson correlation over rows where both are known; NULL for a constant side."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = (F.when(both, F.col(c).cast("double")) for c in (a, b))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def _long(profile: DataFrame) -> DataFrame:
    """Moments become seconds since 1970."""
    names = [c for c in profile.columns if c not in ("column", "top_values")]
    cells = F.array(
        *[
            F.struct(F.lit(n).alias("statistic"), F.col(n).cast("double").alias("value"))
            for n in names
        ]
    )
    return profile.select("column", F.inline(cells)).filter(F.col("value").isNotNull())


def compare_datasets(
    first: DataFrame,
    second: DataFrame,
    labels: tuple[str, str] = ("Original", "Modified"),
    minimal: bool = False,
    approximate: bool = True,
) -> DataFrame:
    """Both profiles side by side: ``value_<label>`` for each, and their difference."""
    a, b = (f"value_{x}" for x in labels)
    sides = [
        _long(profile_columns(df, minimal, approximate)).withColumnRenamed("value", name)
        for df, name in ((first, a), (second, b))
    ]
    joined = sides[0].join(sides[1], ["column", "statistic"], "full")
    return joined.withColumn("delta", F.col(b) - F.col(a))


def correlation_pearson(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """All column pairs in one pass, as rows (column_a, column_b, correlation)."""
    columns = list(columns or numeric_columns(df))
    pairs = list(combinations_with_replacement(columns, 2))
    wide = df.agg(*[_corr(a, b).alias(f"__{i}") for i, (a, b) in enumerate(pairs)])
    return _matrix(wide, pairs)


def _matrix(wide: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    cells = [
        F.struct(
            F.lit(x).alias("column_a"), F.lit(y).alias("column_b"),
            F.col(f"__{i}").alias("correlation"),
        )
        for i, (a, b) in enumerate(pairs)
        for x, y in {(a, b), (b, a)}
    ]
    return wide.select(F.inline(F.array(*cells)))


def correlation_spearman(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    max_series_rows: int | Split = MAX_SERIES_ROWS,
) -> DataFrame:
    """Pearson correlation of average ranks over the rows where both columns are known.

    Equal rows are counted first and travel once. A value has one rank for each other column, among the
    rows where that column is known too; ranks come from running sums over the distinct values.
    """
    columns = list(columns or numeric_columns(df))
    count = range(len(columns))
    pairs = list(combinations_with_replacement(columns, 2))
    rows = df.select(*[F.col(c).cast("double").alias(f"__v{i}") for i, c in enumerate(columns)])
    ranked = keep(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("__n")))
    # for each column its values, with the number of rows that hold them beside each column
    known = [F.when(F.col(f"__v{j}").isNotNull(), F.col("__n")).alias(f"m{j}") for j in count]
    cells = [F.struct(F.lit(i).alias("column"), F.col(f"__v{i}").alias("v")) for i in count]
    totals = ranked.select(F.inline(F.array(*cells)), *known).where("v IS NOT NULL")
    totals = totals.groupBy("column", "v").agg(*[F.coalesce(F.sum(f"m{j}"), F.lit(0)).alias(f"m{j}") for j in count])
    upto = {f"upto{j}": f"m{j}" for j in count}
    summed = running_sum(keep(totals), upto, ("column",), ("v",), max_series_rows)
    rank = [F.col(f"upto{j}") - (F.col(f"m{j}") - 1) / F.lit(2.0) for j in count]
    ranks = keep(summed.select("column", "v", F.array(*rank).alias("rank")))
    for i in count:
        of = ranks.where(F.col("column") == i).select(F.col("v").alias(f"__v{i}"), F.col("rank").alias(f"__r{i}"))
        ranked = ranked.join(of, f"__v{i}", "left")

    def correlation(i: int, j: int) -> Column:
        both = F.col(f"__v{i}").isNotNull() & F.col(f"__v{j}").isNotNull()
        n = F.when(both, F.col("__n"))
        x, y = F.col(f"__r{i}")[j], F.col(f"__r{j}")[i]
        rows = F.sum(n)
        mean_x, mean_y = F.sum(n * x) / rows, F.sum(n * y) / rows
        # ranks average (rows + 1) / 2, so centred sums need no second pass
        cov = F.sum(n * x * y) / rows - mean_x * mean_y
        var_x = F.sum(n * x * x) / rows - mean_x * mean_x
        var_y = F.sum(n * y * y) / rows - mean_y * mean_y
        return F.try_divide(cov, F.sqrt(var_x * var_y))

    at = {c: i for i, c in enumerate(columns)}
    wide = ranked.agg(*[correlation(at[a], at[b]).alias(f"__{i}") for i, (a, b) in enumerate(pairs)])
    return _matrix(wide, pairs)
