"""Scaling, encoding, calendar and rolling features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsprep.operators import encode, features, scale
from tsprep.sources.readings import MEASURES, ORDER, SERIES, readings, table

from .common import LINE, READINGS, WHOLE, settled, settled_column

SIZES = (6, 12, 24)
FUNCTIONS = ("mean", "std", "min", "max", "range")
AXIS = dict(series_by=SERIES, order_by=ORDER)


def _scale(method: str, columns: tuple[str, ...], **options):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = scale.scale(table(spark, sf, "lineitem"), columns, method, **options)
        return df.select(
            "l_orderkey", "l_linenumber",
            *[settled_column(f"{c}_scaled") for c in columns],
        )

    return run


def scale_by_config(spark: SparkSession, sf: str) -> DataFrame:
    config = {"voltage": "standard", "current": "robust", "power": "minmax"}
    df = scale.scale_by_config(readings(spark, sf), config)
    return df.select(
        "event_id", *[settled_column(f"{c}_scaled") for c in config]
    )


def scaler_parameters(spark: SparkSession, sf: str) -> DataFrame:
    config = {"voltage": "standard", "current": "robust", "power": "minmax"}
    fitted = scale.fit_scalers(readings(spark, sf), config)
    return fitted.select(
        "column", "method", *[F.round(c, 6).alias(c) for c in ("center", "scale", "shift")]
    )


def onehot(spark: SparkSession, sf: str) -> DataFrame:
    df = encode.encode_onehot(readings(spark, sf), "status")
    return df.drop("ts", "id_line", *MEASURES)


def onehot_capped(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select("p_partkey", "p_type")
    df = encode.encode_onehot(part, "p_type", max_categories=2)
    # which values are kept depends on the data: name the flags that are set
    flags = [c for c in df.columns if c.startswith("p_type_")]
    names = F.concat_ws(",", *[F.when(F.col(c), F.lit(c)) for c in flags])
    return df.select("p_partkey", "p_type", names.alias("flags_set"))


def onehot_wide(spark: SparkSession, sf: str) -> DataFrame:
    """A vector of as many places as there are customers with an order, from a column of ids."""
    orders = table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 7 > 0, F.col("o_custkey")).alias("customer")
    )
    df = encode.encode_onehot_sparse(orders, "customer", max_series_rows=100)
    parts = F.from_json(
        F.to_json(F.struct("customer_onehot")),
        "customer_onehot struct<size: bigint, indices: array<bigint>, values: array<double>>",
    )["customer_onehot"]
    return df.select("o_orderkey", "customer", parts["size"].alias("size"), parts["indices"][0].alias("place"),
                     F.size(parts["indices"]).cast("bigint").alias("set"), parts["values"][0].alias("value"))


def label_encode(spark: SparkSession, sf: str) -> DataFrame:
    df = encode.encode_label(readings(spark, sf), "status", ORDER)
    return df.select("event_id", "status", "status_encoded")


def label_encode_many(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    df = encode.encode_label(orders, "o_custkey", ["o_orderdate", "o_orderkey"], 100)
    return df.select("o_orderkey", "o_custkey_encoded")


def time_features(spark: SparkSession, sf: str) -> DataFrame:
    df = features.add_time_features(readings(spark, sf), "ts")
    return df.select(
        "event_id", settled_column("hour_sin"), settled_column("hour_cos"),
        F.col("day_of_week").cast("bigint"), F.col("month").cast("bigint"),
        "is_weekend", "is_holiday",
    )


def time_features_text(spark: SparkSession, sf: str) -> DataFrame:
    """Timestamps given as text."""
    text = readings(spark, sf).withColumn("ts", F.col("ts").cast("string"))
    df = features.add_time_features(text, "ts", ["day_of_week", "month"])
    return df.select(
        "event_id", "ts", F.col("day_of_week").cast("bigint"), F.col("month").cast("bigint")
    )


def holiday_join(spark: SparkSession, sf: str) -> DataFrame:
    """Days are holidays when as many orders fell on the same day of an earlier year."""
    orders = table(spark, sf, "orders")
    days = orders.select(
        F.make_date(F.lit(2024), F.month("o_orderdate"), F.least(F.day("o_orderdate"), F.lit(28)))
        .alias("day"),
        "o_totalprice",
    )
    days = days.groupBy("day").agg(F.max("o_totalprice").alias("top"))
    days = days.filter(F.col("top") > 490000).select("day")
    df = features.add_time_features(readings(spark, sf), "ts", ["is_holiday"], holidays=days)
    return df.select("event_id", "is_holiday")


def _rounded(df: DataFrame, sizes, functions) -> DataFrame:
    names = [f"{c}_roll{n}_{f}" for c in MEASURES for n in sizes for f in functions]
    return df.select("event_id", *[settled_column(c) for c in names])


def rolling_features(spark: SparkSession, sf: str) -> DataFrame:
    df = features.window_agg(readings(spark, sf), MEASURES, SIZES, FUNCTIONS, **AXIS)
    return _rounded(df, SIZES, FUNCTIONS)


def rolling_features_cut(spark: SparkSession, sf: str) -> DataFrame:
    df = features.window_agg(
        readings(spark, sf), MEASURES, SIZES, FUNCTIONS, **AXIS, max_series_rows=100
    )
    return _rounded(df, SIZES, FUNCTIONS)


def rolling_features_global(spark: SparkSession, sf: str) -> DataFrame:
    df = features.window_agg(
        readings(spark, sf), MEASURES, SIZES, FUNCTIONS, (), ORDER, max_series_rows=500
    )
    return _rounded(df, SIZES, FUNCTIONS)


QUERIES = {
    "scale_standard": _scale("standard", ("l_quantity", "l_extendedprice")),
    "scale_robust": _scale("robust", ("l_quantity", "l_extendedprice")),
    "scale_minmax": _scale("minmax", ("l_quantity", "l_discount")),
    "scale_minmax_range": _scale("minmax", ("l_tax",), feature_range=(-1.0, 1.0)),
    "scale_by_config": scale_by_config,
    "scaler_parameters": scaler_parameters,
    "onehot": onehot,
    "onehot_capped": onehot_capped,
    "onehot_wide": onehot_wide,
    "label_encode": label_encode,
    "label_encode_many": label_encode_many,
    "time_features": time_features,
    "time_features_text": time_features_text,
    "holiday_join": holiday_join,
    "rolling_features": rolling_features,
    "rolling_features_cut": rolling_features_cut,
    "rolling_features_global": rolling_features_global,
}


def _rolling_sql(over: str) -> str:
    made = []
    for c in MEASURES:
        for n in SIZES:
            w = f"({over} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
            sql = {
                "mean": f"avg({c}) OVER {w}",
                "std": f"stddev_samp({c}) OVER {w}",
                "min": f"min({c}) OVER {w}",
                "max": f"max({c}) OVER {w}",
                "range": f"max({c}) OVER {w} - min({c}) OVER {w}",
            }
            made += [
                settled(f"CASE WHEN count({c}) OVER {w} = {n} THEN {sql[f]} END")
                + f" AS {c}_roll{n}_{f}"
                for f in FUNCTIONS
            ]
    return f"WITH {READINGS} SELECT event_id, {', '.join(made)} FROM readings"


def _scale_sql(**columns: str) -> str:
    made = ", ".join(f"{settled(sql)} AS {c}_scaled" for c, sql in columns.items())
    return f"SELECT l_orderkey, l_linenumber, {made} FROM lineitem"


def _standard(c: str) -> str:
    return f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()"


def _robust(c: str) -> str:
    q = "quantile_cont({c}, {p}) OVER ()"
    low, mid, high = (q.format(c=c, p=p) for p in (0.25, 0.5, 0.75))
    return f"({c} - {mid}) / ({high} - {low})"


def _minmax(c: str) -> str:
    return f"({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ())"


ORACLE = {
    "scale_standard": _scale_sql(
        l_quantity=_standard("l_quantity"), l_extendedprice=_standard("l_extendedprice")
    ),
    "scale_robust": _scale_sql(
        l_quantity=_robust("l_quantity"), l_extendedprice=_robust("l_extendedprice")
    ),
    "scale_minmax": _scale_sql(l_quantity=_minmax("l_quantity"), l_discount=_minmax("l_discount")),
    "scale_minmax_range": _scale_sql(l_tax=f"{_minmax('l_tax')} * 2 - 1"),
    "scale_by_config": f"""WITH {READINGS} SELECT event_id,
      {settled(_standard("voltage"))} AS voltage_scaled,
      {settled(_robust("current"))} AS current_scaled,
      {settled(_minmax("power"))} AS power_scaled FROM readings""",
    "scaler_parameters": f"""WITH {READINGS}
      SELECT 'voltage' AS column, 'standard' AS method, round(avg(voltage), 6) AS center,
             round(stddev_pop(voltage), 6) AS scale, CAST(0 AS DOUBLE) AS shift FROM readings
      UNION ALL SELECT 'current', 'robust', round(quantile_cont(current, 0.5), 6),
             round(quantile_cont(current, 0.75) - quantile_cont(current, 0.25), 6), 0 FROM readings
      UNION ALL SELECT 'power', 'minmax', round(min(power), 6), round(max(power) - min(power), 6), 0
      FROM readings""",
    "onehot": f"""WITH {READINGS} SELECT event_id, status,
      status IS NOT DISTINCT FROM 'click' AS status_click,
      status IS NOT DISTINCT FROM 'error' AS status_error,
      status IS NOT DISTINCT FROM 'purchase' AS status_purchase,
      status IS NOT DISTINCT FROM 'signup' AS status_signup,
      status IS NOT DISTINCT FROM 'view' AS status_view,
      status IS NULL AS status_nan FROM readings""",
    "onehot_capped": """WITH
      top AS (SELECT p_type FROM part GROUP BY p_type ORDER BY count(*) DESC, p_type LIMIT 2),
      capped AS (SELECT p_partkey,
        CASE WHEN p_type IN (SELECT p_type FROM top) THEN p_type ELSE 'Other' END AS p_type
        FROM part)
      SELECT p_partkey, p_type, 'p_type_' || p_type AS flags_set FROM capped""",
    "onehot_wide": """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 > 0 THEN o_custkey END AS customer
        FROM orders),
      codes AS (SELECT customer, row_number() OVER (ORDER BY customer) - 1 AS place
        FROM (SELECT DISTINCT customer FROM o WHERE customer IS NOT NULL)),
      n AS (SELECT count(*) AS n FROM codes)
      SELECT o_orderkey, customer, n + 1 AS size, coalesce(place, n) AS place,
        CAST(1 AS BIGINT) AS set, CAST(1 AS DOUBLE) AS value FROM n, o LEFT JOIN codes USING (customer)""",
    "label_encode": f"""WITH {READINGS},
      seen AS (SELECT status, min((ts, event_id)) AS first FROM readings GROUP BY status),
      codes AS (SELECT status, row_number() OVER (ORDER BY first) - 1 AS code FROM seen)
      SELECT event_id, r.status, code AS status_encoded
      FROM readings r JOIN codes c ON r.status IS NOT DISTINCT FROM c.status""",
    "label_encode_many": """WITH
      seen AS (SELECT o_custkey, min((o_orderdate, o_orderkey)) AS first FROM orders GROUP BY 1),
      codes AS (SELECT o_custkey, row_number() OVER (ORDER BY first) - 1 AS code FROM seen)
      SELECT o_orderkey, code AS o_custkey_encoded FROM orders JOIN codes USING (o_custkey)""",
    "time_features": f"""WITH {READINGS} SELECT event_id,
      {settled("sin(2 * pi() * hour(ts) / 24)")} AS hour_sin,
      {settled("cos(2 * pi() * hour(ts) / 24)")} AS hour_cos,
      isodow(ts) - 1 AS day_of_week, month(ts) AS month,
      isodow(ts) >= 6 AS is_weekend, isodow(ts) >= 6 AS is_holiday FROM readings""",
    "time_features_text": f"""WITH {READINGS} SELECT event_id, ts, isodow(ts) - 1 AS day_of_week,
      month(ts) AS month FROM readings""",
    "holiday_join": f"""WITH {READINGS},
      days AS (SELECT make_date(2024, month(o_orderdate), least(day(o_orderdate), 28)) AS day
               FROM orders GROUP BY 1 HAVING max(o_totalprice) > 490000)
      SELECT event_id, CAST(ts AS DATE) IN (SELECT day FROM days) AS is_holiday FROM readings""",
    "rolling_features": _rolling_sql(LINE),
    "rolling_features_cut": _rolling_sql(LINE),
    "rolling_features_global": _rolling_sql(WHOLE),
}
