"""Profiles: names with dots, kinds of columns, frequent values among many rare ones."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tsprep.operators import profile


def test_frequent_values_among_rare_ones(spark):
    """Counts are exact, and no value with a thousandth of the rows is missed."""
    df = spark.range(60_000, numPartitions=7).select(
        F.when(F.col("id") % 5 == 0, F.col("id") % 35)
        .when(F.col("id") % 1_000 < 2, F.lit(-1))
        .otherwise(F.col("id") + 100)
        .alias("v"),
        F.col("id").alias("unique"),
    )
    expected = Counter(r["v"] for r in df.collect())
    rows = {r["column"]: r for r in profile.profile_columns(df, top=8).collect()}
    best = sorted(((-n, str(v)) for v, n in expected.items() if n >= 60))[:8]
    assert rows["v"]["top_values"] == [f"{v}={-n}" for n, v in best]
    assert rows["unique"]["top_values"] is None


def test_kinds_of_columns(spark):
    df = spark.sql("""
        SELECT * FROM VALUES
          (TIMESTAMP_NTZ '2024-01-02 03:04:05', DATE '2024-02-01', true, array(1), CAST(NULL AS INT)),
          (TIMESTAMP_NTZ '2023-01-02 03:04:05', NULL, false, array(1), NULL),
          (NULL, DATE '2024-03-01', true, NULL, NULL) AS t(`a.moment`, `day`, `on off`, `l``i.st`, none)
    """)
    for approximate in (True, False):
        rows = {r["column"]: r for r in profile.profile_columns(df, approximate=approximate).collect()}
        assert str(rows["a.moment"]["earliest"]) == "2023-01-02 03:04:05"
        assert str(rows["day"]["latest"]) == "2024-03-01 00:00:00"
        flag = rows["on off"]
        assert (flag["min"], flag["max"], flag["zeros"], round(flag["mean"], 4)) == (0.0, 1.0, 1, 0.6667)
        assert flag["top_values"] == ["true=2", "false=1"]
        assert rows["l`i.st"]["top_values"] == ["[1]=2"] and rows["l`i.st"]["distinct"] == 1
        assert rows["none"]["count"] == 0 and rows["none"]["top_values"] is None
    minimal = {r["column"]: r for r in profile.profile_columns(df, minimal=True).collect()}
    assert minimal["a.moment"]["count"] == 2
    assert profile.profile_table(df).first()["missing_cells"] == 6


def test_empty_table_and_describe_of_dotted_names(spark):
    df = spark.createDataFrame([], "`x.y` double, s string, `x__y` int")
    rows = profile.profile_columns(df).collect()
    assert {r["column"] for r in rows} == {"x.y", "s", "x__y"} and all(r["count"] == 0 for r in rows)
    full = spark.createDataFrame([(1.0,), (3.0,)], "`x.y` double")
    assert profile.describe(full, approximate=True).first()["mean"] == 2.0


def test_summary_and_comparison_hold_moments(spark):
    df = spark.sql("SELECT TIMESTAMP '1970-01-01 00:00:10' AS t, 1 AS x")
    got = {(r["column"], r["statistic"]): r["value"] for r in profile.summarize(df).collect()}
    assert got["t", "earliest"] == 10.0
    both = profile.compare_datasets(df, df.select("x")).where("statistic = 'latest'").first()
    assert both["value_Original"] == 10.0 and both["value_Modified"] is None


def test_rank_correlation_reads_rows_once(spark):
    """However many pairs of columns there are; gaps and equal values as by hand."""
    rows = [(i, None if i % 7 == 3 else float(i * i % 11), None if i % 5 == 1 else float(i % 4)) for i in range(60)]
    seen = spark.sparkContext.accumulator(0)

    def note(v):
        seen.add(1)
        return v

    noted = F.udf(note, "double", useArrow=False)
    df = spark.createDataFrame(rows, "a long, b double, c double").withColumn("a", noted(F.col("a").cast("double")))
    got = {(r[0], r[1]): r[2] for r in profile.correlation_spearman(df, ["a", "b", "c"]).collect()}
    assert seen.value == 60
    for (x, i), (y, j) in [(p, q) for p in zip("abc", range(3)) for q in zip("abc", range(3))]:
        both = [(float(r[i]), float(r[j])) for r in rows if r[i] is not None and r[j] is not None]
        ranks = [[sum(w < v for w in s) + (s.count(v) + 1) / 2 for v in s] for s in zip(*both)]
        assert abs(got[x, y] - np.corrcoef(*ranks)[0, 1]) < 1e-9
