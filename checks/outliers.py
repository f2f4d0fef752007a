"""Outlier flags on the readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsprep.operators import anomaly, isolation
from tsprep.sources.readings import MEASURES, ORDER, SERIES, readings

from .common import LINE, READINGS, WHOLE

AXIS = dict(series_by=SERIES, order_by=ORDER)
FLAGS = [f"{c}_anomaly" for c in MEASURES]


def _flags(df: DataFrame) -> DataFrame:
    return df.select("event_id", *FLAGS, "is_anomaly")


def zscore_global(spark: SparkSession, sf: str) -> DataFrame:
    return _flags(anomaly.detect_global(readings(spark, sf), MEASURES, 3.0))


def zscore_per_line(spark: SparkSession, sf: str) -> DataFrame:
    return _flags(anomaly.detect_global(readings(spark, sf), MEASURES, 3.0, SERIES))


def zscore_rolling(spark: SparkSession, sf: str) -> DataFrame:
    return _flags(anomaly.detect_rolling(readings(spark, sf), MEASURES, 3.0, 24, **AXIS))


def zscore_rolling_whole(spark: SparkSession, sf: str) -> DataFrame:
    df = readings(spark, sf)
    return _flags(
        anomaly.detect_rolling(
            df, MEASURES, 3.0, 24, series_by=(), order_by=ORDER, max_series_rows=500
        )
    )


def _rolling_hours(**options):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = readings(spark, sf)
        return _flags(anomaly.detect_rolling(df, MEASURES, 3.0, hours=24, **AXIS, **options))

    return run


SPIKES = {50: 1e9, 3_000: 1e12, 5_000: -1e9}


def _spiked(columns: dict[int, float]) -> str:
    cases = " ".join(f"WHEN event_id = {k} THEN CAST({v} AS double)" for k, v in columns.items())
    return f"CASE {cases} ELSE voltage END"


def _rolling_spikes(**options):
    """Spikes of very different size: frames without one must not feel it."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = readings(spark, sf).withColumn("voltage", F.expr(_spiked(SPIKES)))
        df = anomaly.detect_rolling(df, ["voltage"], 3.0, hours=24, **AXIS, **options)
        return df.select("event_id", "voltage_anomaly", "is_anomaly")

    return run


def anomaly_details(spark: SparkSession, sf: str) -> DataFrame:
    flagged = anomaly.detect_global(readings(spark, sf), MEASURES, 3.0)
    df = anomaly.anomaly_details(flagged, MEASURES, 3.0)
    return df.select(
        "column", "flagged", F.round("rate", 6).alias("rate"),
        F.round("min_flagged", 6).alias("min_flagged"),
        F.round("max_flagged", 6).alias("max_flagged"), "threshold",
    )


def remove_outliers(spark: SparkSession, sf: str) -> DataFrame:
    flagged = anomaly.detect_global(readings(spark, sf), MEASURES, 3.0)
    return anomaly.remove_outliers(flagged).select(
        "event_id", "id_line", *[F.round(c, 6).alias(c) for c in MEASURES]
    )


def removed_count(spark: SparkSession, sf: str) -> DataFrame:
    return anomaly.removed_count(anomaly.detect_global(readings(spark, sf), MEASURES, 3.0))


def lof(spark: SparkSession, sf: str) -> DataFrame:
    df = anomaly.local_outlier_factor(readings(spark, sf), ["voltage", "current"], "event_id", 20)
    return df.select("event_id", F.round("lof", 4).alias("lof"), "is_anomaly")


def isolation_forest(spark: SparkSession, sf: str) -> DataFrame:
    df = isolation.isolation_forest(readings(spark, sf), list(MEASURES), "event_id")
    return df.select("event_id", F.round("score", 6).alias("score"), "is_anomaly")


QUERIES = {
    "zscore_global": zscore_global,
    "zscore_per_line": zscore_per_line,
    "zscore_rolling": zscore_rolling,
    "zscore_rolling_whole": zscore_rolling_whole,
    "zscore_rolling_hours": _rolling_hours(),
    "zscore_rolling_hours_cut": _rolling_hours(max_series_rows=100),
    "zscore_rolling_spikes": _rolling_spikes(),
    "zscore_rolling_spikes_cut": _rolling_spikes(max_series_rows=100),
    "anomaly_details": anomaly_details,
    "remove_outliers": remove_outliers,
    "removed_count": removed_count,
    "lof": lof,
    "isolation_forest": isolation_forest,
}


def _z(c: str, over: str) -> str:
    """The threshold is compared without dividing, as a zero deviation flags nothing."""
    return f"""coalesce(abs({c} - avg({c}) OVER {over}) > 3 * stddev_samp({c}) OVER {over}
      AND stddev_samp({c}) OVER {over} > 0, false)"""


def _flagged(over: str) -> str:
    flags = ", ".join(f"{_z(c, over)} AS {c}_anomaly" for c in MEASURES)
    return f"""WITH {READINGS}, flagged AS (
      SELECT *, {flags} FROM readings),
    f AS (SELECT *, voltage_anomaly OR current_anomaly OR power_anomaly AS is_anomaly
          FROM flagged)"""


def _flags_sql(over: str) -> str:
    return f"{_flagged(over)} SELECT event_id, {', '.join(FLAGS)}, is_anomaly FROM f"


_HOURS = "(PARTITION BY id_line ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW)"

_SPIKED = f"""WITH {READINGS}, spiked AS (SELECT event_id, ts, id_line, {_spiked(SPIKES)} AS voltage FROM readings)
  SELECT event_id, {_z("voltage", _HOURS)} AS voltage_anomaly, voltage_anomaly AS is_anomaly FROM spiked"""

ORACLE = {
    "zscore_rolling_spikes": _SPIKED,
    "zscore_rolling_spikes_cut": _SPIKED,
    "zscore_global": _flags_sql("()"),
    "zscore_per_line": _flags_sql("(PARTITION BY id_line)"),
    "zscore_rolling": _flags_sql(f"({LINE} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)"),
    "zscore_rolling_whole": _flags_sql(f"({WHOLE} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)"),
    "zscore_rolling_hours": _flags_sql(_HOURS),
    "zscore_rolling_hours_cut": _flags_sql(_HOURS),
    "anomaly_details": f"{_flagged('()')} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS column, count(*) FILTER ({c}_anomaly) AS flagged,
        round(count(*) FILTER ({c}_anomaly) / count(*), 6) AS rate,
        round(min({c}) FILTER ({c}_anomaly), 6) AS min_flagged,
        round(max({c}) FILTER ({c}_anomaly), 6) AS max_flagged,
        CAST(3 AS DOUBLE) AS threshold FROM f"""
        for c in MEASURES
    ),
    "remove_outliers": f"""{_flagged("()")} SELECT event_id, id_line, round(voltage, 6) AS voltage,
      round(current, 6) AS current, round(power, 6) AS power FROM f WHERE NOT is_anomaly""",
    "removed_count": f"""{_flagged("()")}
      SELECT count(*) AS rows, count(*) FILTER (is_anomaly) AS removed FROM f""",
    "lof": f"""WITH {READINGS},
      full_rows AS (SELECT event_id, voltage AS x, current AS y FROM readings
                    WHERE voltage IS NOT NULL AND current IS NOT NULL),
      near AS (SELECT a.event_id, arg_min(
          {{'d': sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 'o': b.event_id}},
          {{'d': sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 'o': b.event_id}},
          20) AS l FROM full_rows a JOIN full_rows b ON a.event_id <> b.event_id
        GROUP BY a.event_id),
      items AS (SELECT event_id, unnest(l) AS n FROM near),
      flat AS (SELECT event_id, n.d AS d, n.o AS o FROM items),
      kd AS (SELECT event_id, max(d) AS kdist FROM flat GROUP BY event_id),
      lrd AS (SELECT f.event_id, 1 / (avg(greatest(kdist, d)) + 1e-10) AS lrd
              FROM flat f JOIN kd ON kd.event_id = f.o GROUP BY f.event_id),
      factor AS (SELECT f.event_id, avg(o.lrd) / any_value(m.lrd) AS lof
                 FROM flat f JOIN lrd o ON o.event_id = f.o JOIN lrd m ON m.event_id = f.event_id
                 GROUP BY f.event_id),
      cut AS (SELECT quantile_cont(lof, 0.9) AS q FROM readings LEFT JOIN factor USING (event_id))
      SELECT event_id, round(lof, 4) AS lof, coalesce(lof > q, false) AS is_anomaly
      FROM cut, readings LEFT JOIN factor USING (event_id)""",
}
