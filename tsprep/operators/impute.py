"""Missing-value operators. Rows stay; only NULLs of the named column change."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.timing import micros
from ..session import keep
from .nearest import nearest
from .ordered import MAX_SERIES_ROWS, SEQ, Split, carry, choose_split, over_rows, positioned

log = logging.getLogger(__name__)

SERIES = ("id_line",)
ORDER = ("timestamp",)


def missing_columns(df: DataFrame) -> list[str]:
    """Names of the columns with at least one NULL, in one pass."""
    seen = df.agg(*[F.max(F.col(c).isNull()).alias(c) for c in df.columns]).first()
    return [c for c in df.columns if seen[c]]


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in exclude
    ]


def _replace(df: DataFrame, column: str, value: Column, columns: Sequence[str]) -> DataFrame:
    return df.select(*[value.alias(c) if c == column else F.col(c) for c in columns])


def fill_constant(df: DataFrame, column: str, value: int | float | str) -> DataFrame:
    return df.fillna({column: value})


def fill_mean(df: DataFrame, column: str) -> DataFrame:
    mean = df.agg(F.avg(column)).first()[0]
    return df if mean is None else df.fillna({column: mean})


def fill_forward(
    df: DataFrame,
    column: str,
    limit: int | None = None,
    series_by: Sequence[str] = SERIES,
    order_by: Sequence[str] = ORDER,
    max_series_rows: int | Split = MAX_SERIES_ROWS,
) -> DataFrame:
    """Take the last known value, at most ``limit`` rows back."""
    if limit is not None:
        filled = over_rows(
            df,
            lambda w: [F.last(column, True).over(w.rowsBetween(-limit, 0)).alias("__fill")],
            series_by,
            order_by,
            before=limit,
            max_series_rows=max_series_rows,
        )
    else:
        split = choose_split(df, series_by, max_series_rows)
        rows = positioned(df, series_by, order_by, split)
        filled = carry(rows, {"__fill": F.col(column)}, {}, series_by, order_by, split)
    return _replace(filled, column, F.col("__fill"), df.columns)


def fill_backward(
    df: DataFrame,
    column: str,
    limit: int | None = None,
    series_by: Sequence[str] = SERIES,
    order_by: Sequence[str] = ORDER,
    max_series_rows: int | Split = MAX_SERIES_ROWS,
) -> DataFrame:
    """Take the next known value, at most ``limit`` rows ahead."""
    if limit is not None:
        filled = over_rows(
            df,
            lambda w: [F.first(column, True).over(w.rowsBetween(0, limit)).alias("__fill")],
            series_by,
            order_by,
            after=limit,
            max_series_rows=max_series_rows,
        )
    else:
        split = choose_split(df, series_by, max_series_rows)
        rows = positioned(df, series_by, order_by, split)
        filled = carry(rows, {}, {"__fill": F.col(column)}, series_by, order_by, split)
    return _replace(filled, column, F.col("__fill"), df.columns)


def interpolate(
    df: DataFrame,
    column: str,
    method: str = "time",
    limit: int | None = None,
    order: int = 2,
    series_by: Sequence[str] = SERIES,
    order_by: Sequence[str] = ORDER,
    max_series_rows: int | Split = MAX_SERIES_ROWS,
) -> DataFrame:
    """Fill gaps between known values, at most ``limit`` rows after the previous one.

    ``linear`` treats rows as equally spaced; every other method uses the first ``order_by``
    column as abscissa. ``linear`` and ``time`` carry the last value past the end;
    ``slinear``, ``nearest`` and ``polynomial`` leave both ends NULL.
    """
    if method == "pad":
        return fill_forward(df, column, limit, series_by, order_by, max_series_rows)
    if method not in ("linear", "time", "slinear", "nearest", "polynomial"):
        raise ValueError(f"Unknown interpolation method: {method}")
    split = choose_split(df, series_by, max_series_rows)
    rows = positioned(df, series_by, order_by, split)
    known = F.col(column).isNotNull()
    if method == "polynomial":
        rows = _with_points(rows, column, order, series_by, order_by, split)
        extra = [F.col("__points").alias("points")]
    else:
        extra = []
    at = F.col(SEQ) if method == "linear" else micros(df, order_by[0])
    here = F.when(
        known,
        F.struct(F.col(column).alias("v"), at.alias("x"), F.col(SEQ).alias("seq"), *extra),
    )
    rows = carry(rows, {"__prev": here}, {"__next": here}, series_by, order_by, split)
    prev, nxt = F.col("__prev"), F.col("__next")
    part = F.try_divide(at - prev["x"], nxt["x"] - prev["x"])
    line = F.coalesce(prev["v"] + (nxt["v"] - prev["v"]) * part, prev["v"])
    if method in ("linear", "time"):
        inside = F.when(nxt.isNull(), prev["v"]).otherwise(line)
    elif method == "slinear":
        inside = F.when(nxt.isNotNull(), line)
    elif method == "nearest":
        closer = F.when(at - prev["x"] <= nxt["x"] - at, prev["v"]).otherwise(nxt["v"])
        inside = F.when(nxt.isNotNull(), closer)
    else:
        inside = F.when(nxt.isNotNull(), _polynomial(prev["points"], at, order))
    reach = prev.isNotNull()
    if limit is not None:
        reach = reach & (F.col(SEQ) - prev["seq"] <= limit)
    value = F.when(known, F.col(column)).when(reach, inside)
    return _replace(rows, column, value, df.columns)


def _with_points(
    rows: DataFrame,
    column: str,
    order: int,
    series_by: Sequence[str],
    order_by: Sequence[str],
    split: Split,
) -> DataFrame:
    """Give each known row the ``order`` + 1 known points before the gap that follows it
    (itself included) and as many after."""
    point = F.struct(micros(rows, order_by[0]).alias("x"), F.col(column).cast("double").alias("v"))
    known = over_rows(
        rows.filter(F.col(column).isNotNull()),
        lambda w: [F.collect_list(point).over(w.rowsBetween(-order, order + 1)).alias("__points")],
        series_by,
        order_by,
        before=order,
        after=order + 1,
        max_series_rows=split,
    )
    gaps = rows.filter(F.col(column).isNull())
    return known.unionByName(gaps, allowMissingColumns=True)


def _polynomial(points: Column, at: Column, order: int) -> Column:
    """Lagrange polynomial through the ``order`` + 1 points nearest to ``at``; the earlier
    point wins a tie. Abscissas are taken relative to ``at`` and in hours."""
    hour = F.lit(3.6e9)
    ranked = F.array_sort(
        F.transform(
            points,
            lambda p: F.struct(
                F.abs(p["x"] - at).alias("gap"),
                p["x"].alias("x"),
                ((p["x"] - at) / hour).alias("t"),
                p["v"].alias("v"),
            ),
        )
    )
    near = F.slice(ranked, 1, order + 1)
    terms = F.transform(
        near,
        lambda p: F.aggregate(
            F.filter(near, lambda q: q["x"] != p["x"]),
            p["v"],
            lambda acc, q: acc * F.try_divide(-q["t"], p["t"] - q["t"]),
        ),
    )
    total = F.aggregate(terms, F.lit(0.0), lambda acc, term: acc + term)
    return F.when(F.size(near) == order + 1, total)


def knn_impute(
    df: DataFrame,
    target: str,
    features: Sequence[str] | None = None,
    key: str | Sequence[str] | None = None,
    k: int = 5,
    weights: str = "uniform",
) -> DataFrame:
    """Fill feature gaps, then target gaps, from the k nearest rows that have the value.

    Distances skip missing coordinates and are rescaled by the share present. Ties go to the
    smaller ``key``, then to the earlier row; without a key, ``event_id`` is used where there is one.
    Rows stay as they are in number and order of columns, whatever their keys. A row without any common coordinate gets the column mean. Each pattern of
    present features among the gaps is a search of its own, so name the features that matter
    when a table has many columns with gaps.
    """
    if key is None:
        key = ("event_id",) if "event_id" in df.columns else ()
    keys = [key] if isinstance(key, str) else list(key)
    features = list(features or numeric_columns(df, exclude=(target, *keys)))
    names, key = df.columns, "__row"
    row = F.struct(*keys, F.monotonically_increasing_id().alias("__place"))
    df = keep(df.withColumn(key, row))
    columns = [*features, target]
    groups = (
        df.groupBy(F.array(*[F.col(c).isNotNull() for c in columns]).alias("has"))
        .agg(F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(c) for c in columns])
        .collect()
    )  # at most 2 ** len(columns) rows
    has = [(tuple(g.has), g.rows, g.asDict()) for g in groups]
    means = {}
    for i, c in enumerate(columns):
        known = sum(n for h, n, _ in has if h[i])
        means[c] = sum(g[c] for h, _, g in has if h[i]) / known if known else None

    found = {}
    for i, f in enumerate(features):
        others = [c for c in features if c != f]

        def pick(h: tuple, i: int = i) -> tuple:
            return tuple(x for j, x in enumerate(h[:-1]) if j != i)

        gaps = {pick(h) for h, _, _ in has if not h[i]}
        donors = {pick(h) for h, _, _ in has if h[i]}
        if gaps:
            # always from the original gaps: the features are filled side by side
            side = df.select(key, *features)
            found[f] = _knn_column(side, f, others, gaps, donors, key, k, weights)
    full = tuple(means[f] is not None for f in features)
    gaps = {full} if any(not h[-1] for h, _, _ in has) else set()
    donors = {full} if any(h[-1] for h, _, _ in has) else set()
    if not gaps:
        return df.select(*names)
    table = _gaps_filled(df.select(key, *columns), found, means, key, write=any(full))
    values = _knn_column(table, target, features, gaps, donors, key, k, weights)
    return _gaps_filled(df, {target: values}, means, key).select(*names)


def _gaps_filled(
    df: DataFrame,
    found: Mapping[str, DataFrame | None],
    means: Mapping[str, float | None],
    key: str,
    write: bool = False,
) -> DataFrame:
    """Fill the gaps of each column by what was ``found`` for their keys, else by the mean.

    Only rows with a gap are moved, and with ``write`` written; the others stay in the scan.
    """
    if not found:
        return df
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in found])
    gaps, known = df.filter(~complete), df.filter(complete)
    for c, hits in found.items():
        met, none, mean = [], [], F.lit(means[c])
        if hits is not None:
            gaps = gaps.join(hits, F.col(key) == F.col("__key"), "left")
            met, none = [F.col("__value")], [F.lit(None).cast("double")]
        gaps = _replace(gaps, c, F.coalesce(c, *met, mean), df.columns)
        # nothing to fill, but the same type as the gaps
        known = _replace(known, c, F.coalesce(c, *none, mean), df.columns)
    return known.unionByName(keep(gaps) if write else gaps)


def _knn_column(
    df: DataFrame,
    target: str,
    coords: Sequence[str],
    gaps_have: set[tuple],
    donors_have: set[tuple],
    key: str,
    k: int,
    weights: str,
) -> DataFrame | None:
    """``__key, __value`` of the gaps of ``target``; None when no donor shares a coordinate with them.

    ``gaps_have`` and ``donors_have`` list which coordinates are present together. A gap meets the donors
    of each pattern in the coordinates both have. All pairs of patterns are groups of one search, in which
    the other coordinates are 0 on both sides.
    """
    groups: dict[tuple[int, int], int] = {}
    of_gap: dict[int, list[int]] = {}
    of_donor: dict[int, list[int]] = {}
    for has in map(_mask, sorted(gaps_have)):
        for d in map(_mask, sorted(donors_have)):
            if has & d:
                number = groups.setdefault((has, has & d), len(groups))
                of_donor.setdefault(d, []).append(number)
                if number not in of_gap.setdefault(has, []):
                    of_gap[has].append(number)
    if not groups:
        return None
    common = [c for _, c in groups]
    present = reduce(
        Column.__add__, [F.col(c).isNotNull().cast("int") * (1 << i) for i, c in enumerate(coords)]
    )
    spread = df.withColumn("__gap", F.col(target).isNull()).withColumn("__mask", present)

    def rows(side: Column, numbers: dict[int, list[int]], *more: str) -> DataFrame:
        of = F.create_map(*[F.lit(x) for m, ns in numbers.items() for x in (m, ns)])
        some = spread.filter(side).withColumn("__group", F.explode(F.try_element_at(of, F.col("__mask"))))
        used = F.get(F.array(*[F.lit(c) for c in common]), F.col("__group"))
        at = [
            F.when(used.bitwiseAND(F.lit(1 << i)) != 0, F.col(c).cast("double")).otherwise(0.0).alias(f"__c{i}")
            for i, c in enumerate(coords)
        ]
        return some.select(key, "__group", *at, *more)

    axes = [f"__c{i}" for i in range(len(coords))]
    gaps, donors = rows(F.col("__gap"), of_gap), rows(~F.col("__gap"), of_donor, target)
    hits = nearest(gaps, donors, axes, k, key, F.col(target), "__group")
    scales = [((len(coords) + 1) / c.bit_count()) ** 0.5 for c in common]
    scale = F.get(F.array(*[F.lit(x) for x in scales]), F.col("__group"))
    hits = hits.select(key, _rescaled("neighbours", scale).alias("near")).filter("near IS NOT NULL")
    # one row per gap and donor pattern: at most 2 ** len(coords) lists of k
    near = F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k)
    found = hits.groupBy(key).agg(near.alias("near"))
    return found.select(F.col(key).alias("__key"), _weighted("near", weights).alias("__value"))


def _mask(pattern: Sequence[bool]) -> int:
    return sum(1 << i for i, present in enumerate(pattern) if present)


def _rescaled(neighbours: str, scale: Column) -> Column:
    return F.transform(
        neighbours,
        lambda n: F.struct((n["distance"] * scale).alias("d"), n["key"].alias("key"), n["payload"].alias("v")),
    )


def _weighted(near: str, weights: str) -> Column:
    """Mean of ``v`` over the sorted neighbours, uniform or by inverse distance."""
    if weights not in ("uniform", "distance"):
        raise ValueError(f"Unknown weights: {weights}")
    exact = F.filter(near, lambda n: n["d"] == 0)
    use = F.col(near)
    if weights == "distance":
        use = F.when(F.size(exact) > 0, exact).otherwise(use)
    one = F.lit(1.0)

    def weight(n: Column) -> Column:
        if weights == "uniform":
            return one
        return F.when(n["d"] == 0, one).otherwise(F.try_divide(one, n["d"]))

    total = F.aggregate(use, F.lit(0.0), lambda acc, n: acc + n["v"] * weight(n))
    mass = F.aggregate(use, F.lit(0.0), lambda acc, n: acc + weight(n))
    return F.try_divide(total, mass)


def rf_impute(
    df: DataFrame,
    target: str,
    features: Sequence[str] | None = None,
    n_estimators: int = 100,
    random_state: int = 42,
    max_depth: int = 8,
) -> DataFrame:
    """Predict the gaps with a random forest fitted on the rows that have the target."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import Imputer, VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    features = list(features or numeric_columns(df, exclude=(target,)))
    medians = [f"__m_{f}" for f in features]
    stages = [
        Imputer(strategy="median", inputCols=features, outputCols=medians),
        VectorAssembler(inputCols=medians, outputCol="__x", handleInvalid="keep"),
        RandomForestRegressor(
            featuresCol="__x",
            labelCol=target,
            predictionCol="__y",
            numTrees=n_estimators,
            seed=random_state,
            maxDepth=max_depth,
        ),
    ]
    rows = df.select(
        "*", *[F.col(f).cast("double").alias(f"__d_{f}") for f in features]
    )
    stages[0].setInputCols([f"__d_{f}" for f in features])
    model = Pipeline(stages=stages).fit(rows.filter(F.col(target).isNotNull()))
    predicted = model.transform(rows)
    return _replace(predicted, target, F.coalesce(target, "__y"), df.columns)


def model_impute(
    df: DataFrame,
    target: str,
    features: Sequence[str] | None = None,
    method: str = "knn",
    key: str | Sequence[str] | None = None,
    **options: Any,
) -> DataFrame:
    """Fill by a model; options that belong to the other model are left aside."""
    if method == "knn":
        k = options.get("n_neighbors", 5)
        return knn_impute(df, target, features, key, k, options.get("weights", "uniform"))
    if method == "rf":
        if features is None:
            keys = [key] if isinstance(key, str) else list(key or ("event_id",))
            features = numeric_columns(df, exclude=(target, *keys))
        own = ("n_estimators", "random_state", "max_depth")
        return rf_impute(df, target, features, **{o: options[o] for o in own if o in options})
    raise ValueError(f"no model is called {method!r}: knn and rf are")


def apply_config_strategy(
    df: DataFrame,
    column: str,
    config: Mapping[str, Mapping[str, Any]],
    features: Sequence[str] | None = None,
    key: str | Sequence[str] | None = None,
    series_by: Sequence[str] = SERIES,
    order_by: Sequence[str] = ORDER,
    max_series_rows: int | Split = MAX_SERIES_ROWS,
) -> DataFrame:
    """Fill ``column`` as the configuration's ``missing_values`` section says."""
    if column not in config:
        log.warning("the configuration has no rule for %s; it stays as it is", column)
        return df
    rule = config[column]
    ordered = dict(series_by=series_by, order_by=order_by, max_series_rows=max_series_rows)
    strategy, limit = rule["strategy"], rule.get("limit")
    if strategy == "constant":
        return fill_constant(df, column, rule["value"])
    if strategy == "interpolate":
        method, order = rule.get("method", "time"), rule.get("order", 2)
        return interpolate(df, column, method, limit, order, **ordered)
    if strategy == "forward_fill":
        return fill_forward(df, column, limit, **ordered)
    if strategy == "backward_fill":
        return fill_backward(df, column, limit, **ordered)
    if strategy == "model_impute":
        options = dict(rule.get("parameters", {}))
        for name in ("n_neighbors", "weights", "n_estimators", "random_state"):
            if name in rule:
                options.setdefault(name, rule[name])
        return model_impute(df, column, features, rule.get("method", "knn"), key, **options)
    log.warning("%s: strategy %s is not known; the column stays as it is", column, strategy)
    return df


def imputation_summary(
    before: DataFrame, after: DataFrame, steps: Mapping[str, Mapping[str, Any]]
) -> DataFrame:
    """One row per filled column: method, gaps before, gaps filled, gaps left, parameters."""
    spark = before.sparkSession

    def gaps(df: DataFrame, name: str) -> DataFrame:
        counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in steps])
        pairs = F.array(
            *[F.struct(F.lit(c).alias("column"), F.col(c).alias(name)) for c in steps]
        )
        return counts.select(F.inline(pairs))

    methods = spark.createDataFrame(
        [
            (
                c,
                "_".join(str(s[x]) for x in ("strategy", "method") if x in s),
                {k: str(v) for k, v in s.items() if k not in ("strategy", "method")},
            )
            for c, s in steps.items()
        ],
        "column string, method string, parameters map<string,string>",
    )
    return (
        methods.join(gaps(before, "missing_count"), "column")
        .join(gaps(after, "still_missing"), "column")
        .select(
            "column",
            "method",
            "missing_count",
            (F.col("missing_count") - F.col("still_missing")).alias("filled_count"),
            "still_missing",
            "parameters",
        )
    )
