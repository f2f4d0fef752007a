"""Profiles, comparisons and correlations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsprep.operators import impute, profile
from tsprep.operators.encode import value_counts as counted
from tsprep.session import shared_folder
from tsprep.sources import sinks
from tsprep.sources.readings import MEASURES, readings, table

from .common import READINGS, settled, settled_column

LINE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def profile_table(spark: SparkSession, sf: str) -> DataFrame:
    """Readings without their unique columns, so that copies exist."""
    df = readings(spark, sf).select("id_line", "current", "status")
    return profile.profile_table(df)


STATISTICS = (
    "count missing mean std min max zeros negatives skewness kurtosis min_length mean_length "
    "max_length"
).split()


def profile_columns(spark: SparkSession, sf: str) -> DataFrame:
    df = readings(spark, sf).drop("ts", "event_id")
    out = profile.profile_columns(df, approximate=False)
    floats = ["mean", "std", "min", "max", "skewness", "kurtosis", "q25", "q50", "q75"]
    return out.select(
        "column", "count", "missing", "zeros", "negatives", "min_length", "max_length",
        "distinct", *[settled_column(c) for c in [*floats, "mean_length"]],
        F.array_join("top_values", ";").alias("top_values"),
    )


def profile_default(spark: SparkSession, sf: str) -> DataFrame:
    """Every column of the readings and a yes-or-no one, by sketches; what the sketches estimate is left out."""
    df = readings(spark, sf).withColumn("high.current", F.col("current") > 50)
    out = profile.profile_columns(df)
    moment = "yyyy-MM-dd HH:mm:ss"
    return out.select(
        "column", "count", "missing", "zeros", "negatives", "min_length", "max_length",
        *[settled_column(c) for c in ("mean", "std", "min", "max")],
        F.date_format("earliest", moment).alias("earliest"),
        F.date_format("latest", moment).alias("latest"),
        F.array_join("top_values", ";").alias("top_values"),
    )


def _minimal(out: DataFrame) -> DataFrame:
    return out.select(
        "column", "count", "missing", settled_column("mean"), settled_column("std"),
        "min", "max", "zeros", "negatives", "min_length", settled_column("mean_length"),
        "max_length",
    )


def profile_minimal(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "customer").select("c_acctbal", "c_mktsegment")
    return _minimal(profile.profile_columns(df, minimal=True))


def describe(spark: SparkSession, sf: str) -> DataFrame:
    out = profile.describe(table(spark, sf, "lineitem"), LINE_COLUMNS)
    names = [c for c in out.columns if c not in ("column", "count")]
    return out.select("column", "count", *[settled_column(c) for c in names])


def histogram(spark: SparkSession, sf: str) -> DataFrame:
    out = profile.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 20)
    return out.select("bin", settled_column("lower"), settled_column("upper"), "count")


def value_counts(spark: SparkSession, sf: str) -> DataFrame:
    return counted(table(spark, sf, "customer"), "c_mktsegment")


def summarize(spark: SparkSession, sf: str) -> DataFrame:
    df = readings(spark, sf).select("voltage", "current", "status")
    out = profile.summarize(df, "current", approximate=False)
    keep = F.col("statistic").like("target%") | F.col("statistic").isin("count", "mean", "distinct")
    return out.filter(keep).select("column", "statistic", settled_column("value"))


def compare_imputed(spark: SparkSession, sf: str) -> DataFrame:
    before = readings(spark, sf).select("voltage", "current")
    after = impute.fill_mean(before, "voltage").drop("current")
    out = profile.compare_datasets(before, after, minimal=True)
    shown = F.col("statistic").isin("count", "missing", "mean", "std", "min", "max")
    return out.filter(shown).select(
        "column", "statistic",
        *[settled_column(c) for c in ("value_Original", "value_Modified", "delta")],
    )


def correlation_pearson(spark: SparkSession, sf: str) -> DataFrame:
    out = profile.correlation_pearson(readings(spark, sf), list(MEASURES))
    return out.select("column_a", "column_b", settled_column("correlation"))


def _spearman(**options):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        out = profile.correlation_spearman(readings(spark, sf), list(MEASURES), **options)
        return out.select("column_a", "column_b", settled_column("correlation"))

    return run


def profile_saved(spark: SparkSession, sf: str) -> DataFrame:
    """A profile saved as JSON and read again."""
    df = table(spark, sf, "customer").select("c_acctbal", "c_mktsegment")
    made = profile.profile_columns(df, minimal=True)
    out = spark.read.schema(made.schema).json(sinks.save_profile(made, shared_folder(spark)))
    return _minimal(out)


def correlation_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Columns that do not follow from each other, by values and by ranks."""
    df = table(spark, sf, "lineitem").select(*LINE_COLUMNS)
    parts = {"pearson": profile.correlation_pearson(df), "spearman": profile.correlation_spearman(df)}
    made = [
        p.select(F.lit(n).alias("method"), "column_a", "column_b", settled_column("correlation"))
        for n, p in parts.items()
    ]
    return made[0].unionByName(made[1])


QUERIES = {
    "profile_saved": profile_saved,
    "correlation_lines": correlation_lines,
    "profile_table": profile_table,
    "profile_columns": profile_columns,
    "profile_default": profile_default,
    "profile_minimal": profile_minimal,
    "describe": describe,
    "histogram": histogram,
    "value_counts": value_counts,
    "summarize": summarize,
    "compare_datasets": compare_imputed,
    "correlation_pearson": correlation_pearson,
    "correlation_spearman": _spearman(),
    "correlation_spearman_cut": _spearman(max_series_rows=500),
}


def _moments(c: str) -> str:
    """Skewness and excess kurtosis from central moments."""
    return f"""(SELECT avg(({c} - m) ** 3) / avg(({c} - m) ** 2) ** 1.5 AS skewness,
      avg(({c} - m) ** 4) / avg(({c} - m) ** 2) ** 2 - 3 AS kurtosis
      FROM readings, (SELECT avg({c}) AS m FROM readings))"""


def _top(c: str, text: str) -> str:
    return f"""(SELECT string_agg(v || '=' || n, ';' ORDER BY n DESC, v) AS top_values FROM (
      SELECT {text} AS v, count(*) AS n FROM readings WHERE {c} IS NOT NULL
      GROUP BY 1 ORDER BY n DESC, v LIMIT 5))"""


def _profile_numeric(c: str) -> str:
    quartiles = ", ".join(
        settled(f"quantile_cont({c}, {p})") + f" AS {n}"
        for n, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))
    )
    # whole numbers print with one decimal in both engines
    return f"""SELECT '{c}' AS column, s.*, {settled("skewness")} AS skewness,
      {settled("kurtosis")} AS kurtosis, top_values
      FROM (SELECT count({c}) AS count, count(*) - count({c}) AS missing,
        count(*) FILTER ({c} = 0) AS zeros, count(*) FILTER ({c} < 0) AS negatives,
        CAST(NULL AS BIGINT) AS min_length, CAST(NULL AS BIGINT) AS max_length,
        count(DISTINCT {c}) AS distinct,
        {settled(f"avg({c})")} AS mean, {settled(f"stddev_samp({c})")} AS std,
        {settled(f"min({c})")} AS min, {settled(f"max({c})")} AS max, {quartiles},
        CAST(NULL AS DOUBLE) AS mean_length FROM readings) s,
      {_moments(c)}, {_top(c, f"CAST({c} AS VARCHAR)")}"""


def _profile_text(c: str) -> str:
    none = "CAST(NULL AS DOUBLE)"
    return f"""SELECT '{c}' AS column, s.*, {none} AS skewness, {none} AS kurtosis, top_values
      FROM (SELECT count({c}) AS count, count(*) - count({c}) AS missing,
        0 AS zeros, 0 AS negatives, min(length({c})) AS min_length,
        max(length({c})) AS max_length, count(DISTINCT {c}) AS distinct,
        {none} AS mean, {none} AS std, {none} AS min, {none} AS max,
        {none} AS q25, {none} AS q50, {none} AS q75,
        {settled(f"avg(length({c}))")} AS mean_length FROM readings) s, {_top(c, c)}"""


def _pair_rank(a: str, b: str) -> str:
    return f"""SELECT '{a}' AS column_a, '{b}' AS column_b, {settled("corr(x, y)")} AS correlation
      FROM (SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2 AS x,
                   rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2 AS y
            FROM readings WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""


def _profile_default(c: str, kind: str) -> str:
    """Values that hold a thousandth of the known rows have exact counts."""
    none, moment = "CAST(NULL AS DOUBLE)", "CAST(NULL AS VARCHAR)"
    x = {"number": c, "flag": f"CAST({c} AS INT)"}.get(kind, none)
    text = f"CAST({c} AS VARCHAR)"
    length = f"length({c})" if kind == "text" else "CAST(NULL AS BIGINT)"
    first, last = (
        (f"strftime({f}({c}), '%Y-%m-%d %H:%M:%S')" if kind == "moment" else moment) for f in ("min", "max")
    )
    moments = ", ".join(
        settled(f"{f}({x})") + f" AS {n}"
        for n, f in {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}.items()
    )
    return f"""SELECT '{c.strip('"')}' AS column, s.*,
      (SELECT string_agg(v || '=' || n, ';' ORDER BY n DESC, v) FROM (
        SELECT {text} AS v, count(*) AS n FROM flagged WHERE {c} IS NOT NULL GROUP BY 1
        HAVING count(*) >= CAST(0.001 AS DOUBLE) * (SELECT count({c}) FROM flagged)
        ORDER BY n DESC, v LIMIT 5)) AS top_values
      FROM (SELECT count({c}) AS count, count(*) - count({c}) AS missing,
        count(*) FILTER ({x} = 0) AS zeros, count(*) FILTER ({x} < 0) AS negatives,
        min({length}) AS min_length, max({length}) AS max_length, {moments},
        {first} AS earliest, {last} AS latest FROM flagged) s"""


_PROFILED = {
    "event_id": "number", "ts": "moment", "id_line": "text", "voltage": "number", "current": "number",
    "power": "number", "status": "text", '"high.current"': "flag",
}

_PAIRS = [(a, b) for a in MEASURES for b in MEASURES]
_SPEARMAN = f"WITH {READINGS} " + " UNION ALL ".join(_pair_rank(a, b) for a, b in _PAIRS)


def _compare(c: str, after: str) -> str:
    stats = {
        "count": "count({c})", "missing": "count(*) - count({c})", "mean": "avg({c})",
        "std": "stddev_samp({c})", "min": "min({c})", "max": "max({c})",
    }
    made = []
    for n, q in stats.items():
        old, new = q.format(c="o"), q.format(c="n")
        new = new if after else "CAST(NULL AS DOUBLE)"
        made.append(
            f"SELECT '{c}' AS column, '{n}' AS statistic,"
            f" {settled(old)} AS \"value_Original\", {settled(new)} AS \"value_Modified\","
            f" {settled(f'({new}) - ({old})')} AS delta"
            f" FROM (SELECT {c} AS o, {after or 'NULL'} AS n FROM readings)"
        )
    return " UNION ALL ".join(made)


ORACLE = {
    "profile_table": f"""WITH {READINGS}, g AS (
        SELECT id_line, current, status, count(*) AS n FROM readings GROUP BY ALL)
      SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(3 AS BIGINT) AS columns,
        (SELECT CAST(sum((current IS NULL)::INT + (status IS NULL)::INT) AS BIGINT) FROM readings)
          AS missing_cells,
        CAST(sum(n) - count(*) AS BIGINT) AS duplicate_rows FROM g""",
    "profile_columns": f"WITH {READINGS} "
    + " UNION ALL BY NAME ".join(
        [*[_profile_numeric(c) for c in MEASURES], *[_profile_text(c) for c in ("id_line", "status")]]
    ),
    "profile_default": f"""WITH {READINGS}, flagged AS (
        SELECT *, current > 50 AS "high.current" FROM readings) """
    + " UNION ALL BY NAME ".join(_profile_default(c, kind) for c, kind in _PROFILED.items()),
    "profile_minimal": f"""SELECT 'c_acctbal' AS column, count(*) AS count, CAST(0 AS BIGINT) AS missing,
        {settled("avg(c_acctbal)")} AS mean, {settled("stddev_samp(c_acctbal)")} AS std,
        min(c_acctbal) AS min, max(c_acctbal) AS max,
        count(*) FILTER (c_acctbal = 0) AS zeros, count(*) FILTER (c_acctbal < 0) AS negatives,
        CAST(NULL AS BIGINT) AS min_length, CAST(NULL AS DOUBLE) AS mean_length,
        CAST(NULL AS BIGINT) AS max_length FROM customer
      UNION ALL SELECT 'c_mktsegment', count(*), 0, NULL, NULL, NULL, NULL, 0, 0,
        min(length(c_mktsegment)), {settled("avg(length(c_mktsegment))")},
        max(length(c_mktsegment)) FROM customer""",
    "describe": " UNION ALL ".join(
        f"SELECT '{c}' AS column, count({c}) AS count, {settled(f'avg({c})')} AS mean,"
        f" {settled(f'stddev_samp({c})')} AS std, {settled(f'min({c})')} AS min,"
        + "".join(
            f" {settled(f'quantile_cont({c}, {p})')} AS \"{n}\","
            for n, p in (("25%", 0.25), ("50%", 0.5), ("75%", 0.75))
        )
        + f" {settled(f'max({c})')} AS max FROM lineitem"
        for c in LINE_COLUMNS
    ),
    "histogram": f"""WITH b AS (SELECT min(l_extendedprice) AS lo,
        (max(l_extendedprice) - min(l_extendedprice)) / 20 AS w FROM lineitem),
      c AS (SELECT least(CAST(floor((l_extendedprice - lo) / w) AS BIGINT), 19) AS bin,
              count(*) AS n FROM lineitem, b GROUP BY 1)
      SELECT r.range AS bin, {settled("lo + r.range * w")} AS lower,
        {settled("lo + (r.range + 1) * w")} AS upper, coalesce(n, 0) AS count
      FROM range(20) r CROSS JOIN b LEFT JOIN c ON c.bin = r.range""",
    "value_counts": """SELECT c_mktsegment, count(*) AS count FROM customer
      GROUP BY 1 ORDER BY 2 DESC, 1""",
    "summarize": f"""WITH {READINGS}
      SELECT 'voltage' AS column, 'target_corr' AS statistic,
        {settled("corr(voltage, current)")} AS value FROM readings
      UNION ALL SELECT 'status', 'target_mean:' || status, {settled("avg(current)")}
        FROM readings WHERE status IS NOT NULL GROUP BY status"""
    + "".join(
        f" UNION ALL SELECT '{c}', 'count', {settled(f'count({c})')} FROM readings"
        f" UNION ALL SELECT '{c}', 'distinct', {settled(f'count(DISTINCT {c})')} FROM readings"
        + (
            ""
            if c == "status"
            else f" UNION ALL SELECT '{c}', 'mean', {settled(f'avg({c})')} FROM readings"
        )
        for c in ("voltage", "current", "status")
    ),
    "compare_datasets": f"WITH {READINGS} "
    + _compare("voltage", "coalesce(voltage, (SELECT avg(voltage) FROM readings))")
    + " UNION ALL "
    + _compare("current", ""),
    "correlation_pearson": f"WITH {READINGS} "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b,"
        f" {settled(f'corr({a}, {b})')} AS correlation FROM readings"
        for a, b in _PAIRS
    ),
    "correlation_lines": " UNION ALL ".join(
        f"SELECT '{m}' AS method, '{a}' AS column_a, '{b}' AS column_b, {settled('corr(x, y)')} AS correlation FROM "
        + (
            f"(SELECT {a} AS x, {b} AS y FROM lineitem)"
            if m == "pearson"
            else f"(SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2 AS x,"
            f" rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2 AS y FROM lineitem)"
        )
        for m in ("pearson", "spearman")
        for a in LINE_COLUMNS
        for b in LINE_COLUMNS
    ),
    "correlation_spearman": _SPEARMAN,
    "correlation_spearman_cut": _SPEARMAN,
}
ORACLE["profile_saved"] = ORACLE["profile_minimal"]
