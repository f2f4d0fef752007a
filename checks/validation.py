"""Validation checks on the readings and on copies of them with known defects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsprep.operators import quality
from tsprep.plans import quality_gate
from tsprep.session import shared_folder
from tsprep.sources.readings import readings

from .common import READINGS, settled, settled_column

RULES = {
    "voltage": {"min": 180, "max": 260},
    "current": {"min": 0, "max": 500},
    "power": {"min": 0},
    "unique_combinations": [["timestamp", "id_line"]],
}


def telemetry(spark: SparkSession, sf: str) -> DataFrame:
    return readings(spark, sf).withColumnRenamed("ts", "timestamp")


def defective(spark: SparkSession, sf: str) -> DataFrame:
    """Repeated rows, backward steps and wrong power values, as in DEFECTS below."""
    df = telemetry(spark, sf)
    event = F.col("event_id")
    back = F.col("timestamp") - F.expr("INTERVAL 2 HOURS")
    df = df.withColumn("timestamp", F.when(event % 333 == 1, back).otherwise(F.col("timestamp")))
    doubled = F.when(event % 17 == 0, F.col("power") * 2).otherwise(F.col("power"))
    df = df.withColumn("power", doubled)
    return df.unionByName(df.filter(event % 500 == 0))


def _out(results: DataFrame, *more: str) -> DataFrame:
    return results.select(
        *more, "check", "columns", "is_valid", "evaluated", "unexpected",
        settled_column("unexpected_fraction"), "detail",
    )


def validate_schema(spark: SparkSession, sf: str) -> DataFrame:
    return _out(quality.validate_schema(telemetry(spark, sf).drop("status")))


def schema_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Voltage as text, so that the types have to be coerced."""
    df = telemetry(spark, sf).withColumn("voltage", F.col("voltage").cast("string"))
    found = quality.schema_violations(df, "event_id")
    return found.select(
        "event_id", "rule", "column", F.round(F.col("value").cast("double"), 6).alias("value")
    )


def schema_coerce(spark: SparkSession, sf: str) -> DataFrame:
    """Text columns with words in them, cast to the declared types."""
    df = telemetry(spark, sf).select(
        "event_id",
        F.col("timestamp").cast("string"),
        F.coalesce(F.col("voltage").cast("string"), F.col("status")).alias("voltage"),
    )
    return quality.coerce(df).select("event_id", "timestamp", F.round("voltage", 6).alias("voltage"))


def validate_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return _out(quality.validate_ranges(telemetry(spark, sf), RULES))


def range_violations(spark: SparkSession, sf: str) -> DataFrame:
    found = quality.range_violations(telemetry(spark, sf), "voltage", RULES["voltage"])
    return found.select("event_id", F.round("voltage", 6).alias("voltage"))


def validate_unique(spark: SparkSession, sf: str) -> DataFrame:
    clean = quality.validate_unique(telemetry(spark, sf), ["timestamp", "id_line"])
    bad = quality.validate_unique(defective(spark, sf), ["timestamp", "id_line"])
    return _out(clean.unionByName(bad))


def unique_violations(spark: SparkSession, sf: str) -> DataFrame:
    return quality.unique_violations(defective(spark, sf), ["timestamp", "id_line"])


def validate_not_null(spark: SparkSession, sf: str) -> DataFrame:
    df = telemetry(spark, sf)
    return _out(
        quality.validate_not_null(df, "timestamp").unionByName(
            quality.validate_not_null(df, "status")
        )
    )


def validate_increasing(spark: SparkSession, sf: str) -> DataFrame:
    clean, bad = telemetry(spark, sf), defective(spark, sf).distinct()
    return _out(
        quality.validate_increasing(clean).unionByName(
            quality.validate_increasing(bad, max_series_rows=500)
        )
    )


def increasing_violations(spark: SparkSession, sf: str) -> DataFrame:
    bad = defective(spark, sf).distinct()
    return quality.increasing_violations(bad, "timestamp", ["event_id"])


def validate_power(spark: SparkSession, sf: str) -> DataFrame:
    clean = quality.validate_power(telemetry(spark, sf))
    return _out(clean.unionByName(quality.validate_power(defective(spark, sf))))


def power_violations(spark: SparkSession, sf: str) -> DataFrame:
    return quality.power_violations(defective(spark, sf)).select("event_id")


def validate_missing(spark: SparkSession, sf: str) -> DataFrame:
    return _out(quality.validate_missing_values(telemetry(spark, sf), 0.045))


def validate_gaps(spark: SparkSession, sf: str) -> DataFrame:
    df = telemetry(spark, sf)
    return _out(
        quality.validate_time_continuity(df, tie=["event_id"], max_series_rows=100).unionByName(
            quality.validate_time_continuity(df, max_gap_seconds=864000.0, series_by=())
        )
    )


def gap_violations(spark: SparkSession, sf: str) -> DataFrame:
    return quality.gap_violations(telemetry(spark, sf), max_gap_seconds=36000.0)


def gate(spark: SparkSession, sf: str) -> DataFrame:
    results = quality_gate.quality_gate(defective(spark, sf), RULES, tie=["event_id"])
    return _out(results, "run")


def gate_verdict(spark: SparkSession, sf: str) -> DataFrame:
    """All rules at once, on rows that keep them and on rows that break most."""
    found = [quality.validate_with_expectations(t(spark, sf), RULES) for t in (telemetry, defective)]
    verdicts = [quality.verdict(f).withColumn("rows", F.lit(n)) for n, f in zip(("clean", "defective"), found)]
    return verdicts[0].unionByName(verdicts[1])


def gate_five_columns(spark: SparkSession, sf: str) -> DataFrame:
    """The gate on timestamp, voltage, current, power and id_line alone, with no key."""
    # written in order of arrival, as rows without a key have no other
    path = shared_folder(spark)
    rows = telemetry(spark, sf).coalesce(1).sortWithinPartitions("event_id").select(*_FIVE)
    rows.write.parquet(path)
    return _out(quality_gate.quality_gate(spark.read.parquet(path), RULES), "run")


QUERIES = {
    "validate_schema": validate_schema,
    "schema_violations": schema_violations,
    "schema_coerce": schema_coerce,
    "validate_ranges": validate_ranges,
    "range_violations": range_violations,
    "validate_unique": validate_unique,
    "unique_violations": unique_violations,
    "validate_not_null": validate_not_null,
    "validate_increasing": validate_increasing,
    "increasing_violations": increasing_violations,
    "validate_power": validate_power,
    "power_violations": power_violations,
    "validate_missing": validate_missing,
    "validate_gaps": validate_gaps,
    "gap_violations": gap_violations,
    "quality_gate": gate,
    "quality_gate_five_columns": gate_five_columns,
    "quality_verdict": gate_verdict,
}

_T = f"""{READINGS}, t AS (SELECT event_id, ts AS "timestamp", id_line, voltage, current, power,
  status FROM readings)"""
_DEFECTS = f"""{_T}, changed AS (SELECT event_id,
    CASE WHEN event_id % 333 = 1 THEN "timestamp" - INTERVAL 2 HOUR ELSE "timestamp" END
      AS "timestamp", id_line, voltage, current,
    CASE WHEN event_id % 17 = 0 THEN power * 2 ELSE power END AS power, status FROM t),
  d AS (SELECT * FROM changed UNION ALL SELECT * FROM changed WHERE event_id % 500 = 0)"""


def _row(check: str, columns: str, source: str, n: str, bad: str, valid: str = "bad = 0",
         detail: str = "CAST(NULL AS VARCHAR)") -> str:
    return f"""SELECT '{check}' AS check, '{columns}' AS columns, {valid} AS is_valid,
      CAST(n AS BIGINT) AS evaluated, CAST(bad AS BIGINT) AS unexpected,
      {settled("bad / n")} AS unexpected_fraction, {detail} AS detail
      FROM (SELECT {n} AS n, {bad} AS bad, max(gap) AS gap FROM {source})"""


def _plain(check: str, columns: str, source: str, n: str, bad: str, valid: str = "bad = 0") -> str:
    return _row(check, columns, f"(SELECT *, 0 AS gap FROM {source})", n, bad, valid)


def _range(c: str, low: float, high: float | None, source: str) -> str:
    test = f"{c} < {low}" + ("" if high is None else f" OR {c} > {high}")
    return _plain("range", c, source, f"count({c})", f"count(*) FILTER ({test})",
                  "(n - bad) / n >= 0.9")


def _ranges(source: str) -> list[str]:
    return [_range("voltage", 180, 260, source), _range("current", 0, 500, source),
            _range("power", 0, None, source)]


def _unique(source: str) -> str:
    groups = f"""(SELECT count(*) AS c FROM {source} GROUP BY "timestamp", id_line)"""
    return _plain("unique", "timestamp,id_line", groups, "sum(c)", "coalesce(sum(c) FILTER (c > 1), 0)")


def _increasing(source: str) -> str:
    steps = f"""(SELECT "timestamp" AS ts,
      lag("timestamp") OVER (ORDER BY event_id) AS b FROM {source})"""
    return _plain("increasing", "timestamp", steps, "count(*)", "count(*) FILTER (ts < b)")


def _power(source: str) -> str:
    off = "abs(power - voltage * current) > 0.1 * power"
    return _plain("power", "power,voltage,current", source, f"count({off})",
                  f"count(*) FILTER ({off})")


def _not_null(c: str, source: str) -> str:
    return _plain("not_null", c, source, "count(*)", f"count(*) - count({c})")


def _missing(c: str, source: str, threshold: float) -> str:
    return _plain("missing", c, source, "count(*)", f"count(*) - count({c})",
                  f"bad / n <= {threshold}")


def _gap(source: str, over: str, limit: int) -> str:
    steps = f"""(SELECT epoch_us("timestamp") - lag(epoch_us("timestamp")) OVER ({over}) AS gap
      FROM {source})"""
    return _row("gaps", "timestamp", steps, "count(gap)", f"count(*) FILTER (gap > {limit})",
                detail="CAST(gap AS VARCHAR)")


_BY_LINE = 'PARTITION BY id_line ORDER BY "timestamp", event_id'
_SCHEMA = [("timestamp", None, None), ("voltage", 180, 260), ("current", 0, 500),
           ("power", 0, None), ("id_line", None, None)]


def _schema(source: str, extra: list[str]) -> list[str]:
    rows = [
        f"""SELECT 'schema:required' AS check, '{c}' AS columns, true AS is_valid,
        CAST(1 AS BIGINT) AS evaluated, CAST(0 AS BIGINT) AS unexpected,
        {settled("CAST(0 AS DOUBLE)")} AS unexpected_fraction, CAST(NULL AS VARCHAR) AS detail"""
        for c, _, _ in _SCHEMA
    ]
    rows += [
        f"SELECT 'schema:extra', '{c}', false, 1, 1, {settled('CAST(1 AS DOUBLE)')}, NULL"
        for c in extra
    ]
    for c, low, high in _SCHEMA:
        q = f'"{c}"'
        rows.append(_plain("schema:not_null", c, source, "count(*)", f"count(*) - count({q})"))
        rows.append(_plain("schema:type", c, source, "count(*)", "0"))
        if low is not None:
            rows.append(_plain("schema:min", c, source, "count(*)", f"count(*) FILTER ({q} < {low})"))
        if high is not None:
            rows.append(_plain("schema:max", c, source, "count(*)", f"count(*) FILTER ({q} > {high})"))
    return rows


def _all(prefix: str, rows: list[str]) -> str:
    return f"WITH {prefix} " + " UNION ALL ".join(rows)


def _named(run: str, rows: list[str]) -> str:
    return f"SELECT *, '{run}' AS run FROM (" + " UNION ALL ".join(rows) + ")"


def _rules(source: str) -> list[str]:
    return [*_ranges(source), _not_null("timestamp", source), _power(source), _unique(source), _increasing(source)]


_FIVE = ["timestamp", "voltage", "current", "power", "id_line"]
_COLUMNS = ["event_id", "timestamp", "id_line", "voltage", "current", "power", "status"]

ORACLE = {
    "validate_schema": _all(_T, _schema("t", ["event_id"])),
    "schema_violations": _all(
        _T,
        [
            f"SELECT event_id, 'not_null' AS rule, '{c}' AS column, CAST(NULL AS DOUBLE) AS value"
            f" FROM t WHERE {c} IS NULL"
            for c in ("voltage", "current", "power")
        ]
        + ["SELECT event_id, 'max', 'voltage', round(voltage, 6) FROM t WHERE voltage > 260"],
    ),
    "schema_coerce": f'WITH {_T} SELECT event_id, "timestamp", round(voltage, 6) AS voltage FROM t',
    "validate_ranges": _all(_T, _ranges("t")),
    "range_violations": f"""WITH {_T} SELECT event_id, round(voltage, 6) AS voltage FROM t
      WHERE voltage < 180 OR voltage > 260""",
    "validate_unique": _all(_DEFECTS, [_unique("t"), _unique("d")]),
    "unique_violations": f"""WITH {_DEFECTS} SELECT "timestamp", id_line, count(*) AS copies FROM d
      GROUP BY ALL HAVING count(*) > 1""",
    "validate_not_null": _all(_T, [_not_null('timestamp', "t"), _not_null("status", "t")]),
    "validate_increasing": _all(_DEFECTS, [_increasing("t"), _increasing("changed")]),
    "increasing_violations": f"""WITH {_DEFECTS} SELECT event_id, "timestamp", previous FROM (
      SELECT event_id, "timestamp", lag("timestamp") OVER (ORDER BY event_id) AS previous
      FROM changed) WHERE "timestamp" < previous""",
    "validate_power": _all(_DEFECTS, [_power("t"), _power("d")]),
    "power_violations": f"""WITH {_DEFECTS} SELECT event_id FROM d
      WHERE abs(power - voltage * current) > 0.1 * power""",
    "validate_missing": _all(_T, [_missing(f'"{c}"', "t", 0.045).replace(f"'\"{c}\"'", f"'{c}'")
                                  for c in _COLUMNS]),
    "validate_gaps": _all(
        _T, [_gap("t", _BY_LINE, 3_600_000_000), _gap("t", 'ORDER BY "timestamp"', 864_000_000_000)]
    ),
    "gap_violations": f"""WITH {_T} SELECT id_line, previous, "timestamp", gap_us FROM (
      SELECT id_line, "timestamp", lag("timestamp") OVER ({_BY_LINE}) AS previous,
        epoch_us("timestamp") - lag(epoch_us("timestamp")) OVER ({_BY_LINE}) AS gap_us FROM t)
      WHERE gap_us > 36000000000""",
    "quality_gate": _all(
        _DEFECTS,
        [
            _named("schema", _schema("d", ["event_id", "status"])),
            _named(
                "expectations",
                _rules("d"),
            ),
            _named(
                "missing_values",
                [_missing(f'"{c}"', "d", 0.1).replace(f"'\"{c}\"'", f"'{c}'") for c in _COLUMNS],
            ),
            _named("time_continuity", [_gap("d", _BY_LINE, 3_600_000_000)]),
        ],
    ),
    "quality_gate_five_columns": _all(
        _T,
        [
            _named("schema", _schema("t", [])),
            _named("expectations", _rules("t")),
            _named(
                "missing_values",
                [_missing(f'"{c}"', "t", 0.1).replace(f"'\"{c}\"'", f"'{c}'") for c in _FIVE],
            ),
            _named("time_continuity", [_gap("t", _BY_LINE, 3_600_000_000)]),
        ],
    ),
    "quality_verdict": _all(
        _DEFECTS,
        [
            f"""SELECT '{name}' AS rows, bool_and(is_valid) AS is_valid, count(*) AS checks,
            count(*) FILTER (NOT is_valid) AS failed FROM ({" UNION ALL ".join(_rules(source))})"""
            for name, source in (("clean", "t"), ("defective", "d"))
        ],
    ),
}
