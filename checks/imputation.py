"""Missing-value operators on the readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsprep.operators import impute as op
from tsprep.sources.readings import ORDER, SERIES, readings

from .common import LINE, READINGS, WHOLE

CONFIG = {
    "voltage": {"strategy": "interpolate", "method": "time", "limit": 24},
    "current": {"strategy": "model_impute", "method": "knn", "n_neighbors": 5},
    "power": {"strategy": "forward_fill", "limit": 12},
}
AXIS = dict(series_by=SERIES, order_by=ORDER)
# small enough to cut every series, so that the plan for long series is checked as well
CUT = dict(max_series_rows=100)


def _out(df: DataFrame, *columns: str) -> DataFrame:
    return df.select("event_id", *[F.round(c, 6).alias(c) for c in columns])


def fill_constant(spark: SparkSession, sf: str) -> DataFrame:
    df = op.fill_constant(readings(spark, sf), "status", "UNKNOWN")
    return _out(op.fill_constant(df, "voltage", -1.0), "voltage").join(
        df.select("event_id", "status"), "event_id"
    )


def fill_forward(spark: SparkSession, sf: str) -> DataFrame:
    return _out(op.fill_forward(readings(spark, sf), "voltage", **AXIS), "voltage")


def fill_forward_limit(spark: SparkSession, sf: str) -> DataFrame:
    return _out(op.fill_forward(readings(spark, sf), "power", 1, **AXIS, **CUT), "power")


def fill_backward(spark: SparkSession, sf: str) -> DataFrame:
    df = op.fill_backward(readings(spark, sf), "voltage", **AXIS, **CUT)
    return _out(op.fill_backward(df, "power", 1, **AXIS), "voltage", "power")


def fill_forward_whole(spark: SparkSession, sf: str) -> DataFrame:
    df = op.fill_forward(readings(spark, sf), "voltage", series_by=(), order_by=ORDER, **CUT)
    return _out(df, "voltage")


def fill_mean(spark: SparkSession, sf: str) -> DataFrame:
    return _out(op.fill_mean(readings(spark, sf), "voltage"), "voltage")


def _interpolate(method: str, **options):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _out(
            op.interpolate(readings(spark, sf), "voltage", method, **AXIS, **options), "voltage"
        )

    return run


def interpolate_whole(spark: SparkSession, sf: str) -> DataFrame:
    df = op.interpolate(
        readings(spark, sf), "voltage", "time", 24, series_by=(), order_by=ORDER, **CUT
    )
    return _out(df, "voltage")


def knn_impute(spark: SparkSession, sf: str) -> DataFrame:
    df = op.knn_impute(readings(spark, sf), "current", ["voltage", "power"], "event_id", 5)
    return _out(df, "current")


def knn_impute_repeated_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Keys that repeat, or are NULL, leave the number of rows and the known values alone."""
    df = readings(spark, sf)
    key = F.when(F.col("event_id") % 10 != 0, F.floor(F.col("event_id") / 3)).alias("event_id")
    df = df.select(key, "voltage", "current", "power")
    out = op.knn_impute(df, "current", ["voltage", "power"], "event_id", 5)
    return out.agg(
        F.count("*").alias("n_rows"),
        F.count("event_id").alias("n_keys"),
        F.count_if(F.col("current").isNull()).alias("n_gaps"),
        F.count_if(F.col("voltage").isNull()).alias("n_voltage_gaps"),
    )


def knn_impute_distance(spark: SparkSession, sf: str) -> DataFrame:
    df = op.knn_impute(
        readings(spark, sf), "current", ["voltage", "power"], "event_id", 5, "distance"
    )
    return _out(df, "current")


def rf_impute(spark: SparkSession, sf: str) -> DataFrame:
    return _out(op.rf_impute(readings(spark, sf), "current", ["voltage", "power"]), "current")


def _by_config(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    before = after = readings(spark, sf)
    for column in CONFIG:
        after = op.apply_config_strategy(
            after, column, CONFIG, features=["voltage", "power"], **AXIS
        )
    return before, after


def impute_by_config(spark: SparkSession, sf: str) -> DataFrame:
    return _out(_by_config(spark, sf)[1], "voltage", "current", "power")


def imputation_summary(spark: SparkSession, sf: str) -> DataFrame:
    before, after = _by_config(spark, sf)
    summary = op.imputation_summary(before, after, CONFIG)
    limit = F.coalesce(F.col("parameters")["limit"], F.col("parameters")["n_neighbors"])
    return summary.withColumn("parameter", limit).drop("parameters")


QUERIES = {
    "fill_constant": fill_constant,
    "fill_forward": fill_forward,
    "fill_forward_limit": fill_forward_limit,
    "fill_forward_whole": fill_forward_whole,
    "fill_backward": fill_backward,
    "fill_mean": fill_mean,
    "interpolate_linear": _interpolate("linear", limit=24, **CUT),
    "interpolate_time": _interpolate("time", limit=24),
    "interpolate_time_whole": interpolate_whole,
    "interpolate_polynomial": _interpolate("polynomial"),
    "interpolate_polynomial_cut": _interpolate("polynomial", **CUT),
    "interpolate_nearest": _interpolate("nearest"),
    "interpolate_slinear": _interpolate("slinear"),
    "interpolate_pad": _interpolate("pad", limit=2),
    "knn_impute": knn_impute,
    "knn_impute_distance": knn_impute_distance,
    "knn_impute_repeated_keys": knn_impute_repeated_keys,
    "rf_impute": rf_impute,
    "impute_by_config": impute_by_config,
    "imputation_summary": imputation_summary,
}


def _known(column: str, axis: str, over: str, source: str = "readings") -> str:
    """prev/next known point of each row: value v, abscissa x and row number n."""
    point = f"CASE WHEN {column} IS NOT NULL THEN {{'v': {column}, 'x': {axis}, 'n': n}} END"
    before, after = "UNBOUNDED PRECEDING AND CURRENT ROW", "CURRENT ROW AND UNBOUNDED FOLLOWING"
    return f"""numbered AS (SELECT *, row_number() OVER ({over}) AS n FROM {source}),
    around AS (
      SELECT *,
        last_value({point} IGNORE NULLS) OVER ({over} ROWS BETWEEN {before}) AS p,
        first_value({point} IGNORE NULLS) OVER ({over} ROWS BETWEEN {after}) AS q
      FROM numbered)"""


_US = "CAST(epoch_us(ts) AS DOUBLE)"
_LINE_VALUE = "p.v + (q.v - p.v) * ((AXIS - p.x) / nullif(q.x - p.x, 0))"


def _interpolated(value: str, axis: str, limit: int | None, over: str = LINE) -> str:
    near = "" if limit is None else f"AND n - p.n <= {limit}"
    return f"""WITH {READINGS}, {_known("voltage", axis, over)}
    SELECT event_id, round(CASE WHEN voltage IS NOT NULL THEN voltage
        WHEN p IS NOT NULL {near} THEN {value.replace("AXIS", axis)} END, 6) AS voltage
    FROM around"""


_CARRY = f"CASE WHEN q IS NULL THEN p.v ELSE coalesce({_LINE_VALUE}, p.v) END"
_INSIDE = f"CASE WHEN q IS NOT NULL THEN coalesce({_LINE_VALUE}, p.v) END"
_CLOSER = "CASE WHEN q IS NOT NULL THEN CASE WHEN AXIS - p.x <= q.x - AXIS THEN p.v ELSE q.v END END"


def _fill(column: str, pick: str, frame: str, over: str = LINE) -> str:
    return f"""round({pick}({column} IGNORE NULLS) OVER ({over} ROWS BETWEEN {frame}), 6)"""


_POLYNOMIAL = f"""WITH {READINGS},
  known AS (SELECT id_line, ts, event_id, voltage AS v, {_US} AS x,
                   row_number() OVER ({LINE}) AS k FROM readings WHERE voltage IS NOT NULL),
  gaps AS (SELECT r.event_id, r.id_line, {_US} AS x,
                  (SELECT max(k) FROM known b WHERE b.id_line = r.id_line
                     AND (b.ts, b.event_id) < (r.ts, r.event_id)) AS k
           FROM readings r WHERE voltage IS NULL),
  near AS (SELECT g.event_id, p.x, p.v, (p.x - g.x) / 3.6e9 AS t,
                  row_number() OVER (PARTITION BY g.event_id ORDER BY abs(p.x - g.x), p.x) AS r
           FROM gaps g JOIN known p ON p.id_line = g.id_line AND p.k BETWEEN g.k - 2 AND g.k + 3
           WHERE EXISTS (SELECT 1 FROM known e WHERE e.id_line = g.id_line AND e.k = g.k + 1)),
  three AS (SELECT a.event_id, sum(a.v * (-b.t) / (a.t - b.t) * (-c.t) / (a.t - c.t)) AS v
            FROM near a
            JOIN near b ON b.event_id = a.event_id AND b.r <= 3 AND b.r <> a.r
            JOIN near c ON c.event_id = a.event_id AND c.r <= 3 AND c.r <> a.r AND c.r > b.r
            WHERE a.r <= 3 GROUP BY a.event_id)
  SELECT r.event_id, round(coalesce(r.voltage, three.v), 6) AS voltage
  FROM readings r LEFT JOIN three USING (event_id)"""


def _ordered_mean(weight: str) -> str:
    """Weighted mean of list ``l`` of {d, v}, added up in list order."""
    return f"""list_reduce([CAST(0 AS DOUBLE)] || list_transform(l, lambda z: z.v * {weight}),
        lambda a, b: a + b)
      / list_reduce([CAST(0 AS DOUBLE)] || list_transform(l, lambda z: {weight}),
        lambda a, b: a + b)"""


def _knn(weights: str) -> str:
    uniform = _ordered_mean("CAST(1 AS DOUBLE)")
    inverse = _ordered_mean("(1 / z.d)")
    exact = "list_filter(l, lambda z: z.d = 0)"

    def mean() -> str:
        if weights == "uniform":
            return uniform
        hits = uniform.replace("(l,", f"({exact},")
        return f"CASE WHEN len({exact}) > 0 THEN {hits} ELSE {inverse} END"

    def near(gaps: str, donors: str, square: str, scale: str, value: str) -> str:
        return f"""(SELECT event_id, {mean()} AS v FROM (
          SELECT g.event_id,
            arg_min({{'d': sqrt({square}) * {scale}, 'v': p.{value}}},
                    {{'d': sqrt({square}), 'k': p.event_id}}, 5) AS l
          FROM (SELECT * FROM {gaps}) g, (SELECT * FROM {donors}) p GROUP BY g.event_id))"""

    both = "voltage IS NOT NULL AND power IS NOT NULL"
    return f"""
    fv AS {near("readings WHERE voltage IS NULL AND power IS NOT NULL", f"readings WHERE {both}",
                "(g.power - p.power) * (g.power - p.power)", "sqrt(2)", "voltage")},
    fp AS {near("readings WHERE power IS NULL AND voltage IS NOT NULL", f"readings WHERE {both}",
                "(g.voltage - p.voltage) * (g.voltage - p.voltage)", "sqrt(2)", "power")},
    filled AS (
      SELECT r.event_id, r.current,
        coalesce(r.voltage, fv.v, (SELECT avg(voltage) FROM readings)) AS x,
        coalesce(r.power, fp.v, (SELECT avg(power) FROM readings)) AS y
      FROM readings r LEFT JOIN fv USING (event_id) LEFT JOIN fp USING (event_id)),
    fc AS {near("filled WHERE current IS NULL", "filled WHERE current IS NOT NULL",
                "((g.x - p.x) * (g.x - p.x) + (g.y - p.y) * (g.y - p.y))", "sqrt(1.5)",
                "current")}"""


_KNN_OUT = """SELECT r.event_id, round(coalesce(r.current, fc.v), 6) AS current
    FROM readings r LEFT JOIN fc USING (event_id)"""

# voltage first, then current from the k nearest, then power: as in CONFIG
_CONFIGURED = f"""WITH {READINGS.replace("readings AS", "raw AS")},
  {_known("voltage", _US, LINE, "raw")},
  readings AS (
    SELECT event_id, ts, id_line, current, power,
      CASE WHEN voltage IS NOT NULL THEN voltage
           WHEN p IS NOT NULL AND n - p.n <= 24 THEN {_CARRY.replace("AXIS", _US)} END AS voltage
    FROM around),
  {_knn("uniform")},
  done AS (SELECT r.event_id, r.voltage, coalesce(r.current, fc.v) AS current,
      last_value(power IGNORE NULLS) OVER ({LINE} ROWS BETWEEN 12 PRECEDING AND CURRENT ROW)
        AS power
    FROM readings r LEFT JOIN fc USING (event_id))"""

ORACLE = {
    "knn_impute_repeated_keys": f"""WITH {READINGS}
      SELECT count(*) AS n_rows, count(*) FILTER (event_id % 10 <> 0) AS n_keys,
             CAST(0 AS BIGINT) AS n_gaps, count(*) FILTER (voltage IS NULL) AS n_voltage_gaps
      FROM readings""",
    "fill_constant": f"""WITH {READINGS} SELECT event_id, round(coalesce(voltage, -1), 6) AS voltage,
      coalesce(status, 'UNKNOWN') AS status FROM readings""",
    "fill_forward": f"""WITH {READINGS} SELECT event_id,
      {_fill("voltage", "last_value", "UNBOUNDED PRECEDING AND CURRENT ROW")} AS voltage
      FROM readings""",
    "fill_forward_limit": f"""WITH {READINGS} SELECT event_id,
      {_fill("power", "last_value", "1 PRECEDING AND CURRENT ROW")} AS power FROM readings""",
    "fill_forward_whole": f"""WITH {READINGS} SELECT event_id,
      {_fill("voltage", "last_value", "UNBOUNDED PRECEDING AND CURRENT ROW", WHOLE)} AS voltage
      FROM readings""",
    "fill_backward": f"""WITH {READINGS} SELECT event_id,
      {_fill("voltage", "first_value", "CURRENT ROW AND UNBOUNDED FOLLOWING")} AS voltage,
      {_fill("power", "first_value", "CURRENT ROW AND 1 FOLLOWING")} AS power FROM readings""",
    "fill_mean": f"""WITH {READINGS} SELECT event_id,
      round(coalesce(voltage, (SELECT avg(voltage) FROM readings)), 6) AS voltage FROM readings""",
    "interpolate_linear": _interpolated(_CARRY, "CAST(n AS DOUBLE)", 24),
    "interpolate_time": _interpolated(_CARRY, _US, 24),
    "interpolate_time_whole": _interpolated(_CARRY, _US, 24, WHOLE),
    "interpolate_polynomial": _POLYNOMIAL,
    "interpolate_polynomial_cut": _POLYNOMIAL,
    "interpolate_nearest": _interpolated(_CLOSER, _US, None),
    "interpolate_slinear": _interpolated(_INSIDE, _US, None),
    "interpolate_pad": f"""WITH {READINGS} SELECT event_id,
      {_fill("voltage", "last_value", "2 PRECEDING AND CURRENT ROW")} AS voltage FROM readings""",
    "knn_impute": f"WITH {READINGS}, {_knn('uniform')} {_KNN_OUT}",
    "knn_impute_distance": f"WITH {READINGS}, {_knn('distance')} {_KNN_OUT}",
    "impute_by_config": f"""{_CONFIGURED} SELECT event_id, round(voltage, 6) AS voltage,
      round(current, 6) AS current, round(power, 6) AS power FROM done""",
    "imputation_summary": f"""{_CONFIGURED},
      b AS (SELECT count(*) - count(voltage) AS v, count(*) - count(current) AS c,
                   count(*) - count(power) AS p FROM raw),
      a AS (SELECT count(*) - count(voltage) AS v, count(*) - count(current) AS c,
                   count(*) - count(power) AS p FROM done)
      SELECT 'voltage' AS column, 'interpolate_time' AS method, b.v AS missing_count,
             b.v - a.v AS filled_count, a.v AS still_missing, '24' AS parameter FROM a, b
      UNION ALL SELECT 'current', 'model_impute_knn', b.c, b.c - a.c, a.c, '5' FROM a, b
      UNION ALL SELECT 'power', 'forward_fill', b.p, b.p - a.p, a.p, '12' FROM a, b""",
}
