import datetime as dt

from conftest import line

from tsprep.operators import profile, quality
from tsprep.plans.quality_gate import quality_gate

T0 = dt.datetime(2024, 1, 1)


def _telemetry(spark, rows):
    return spark.createDataFrame(
        rows,
        "event_id long, timestamp timestamp_ntz, voltage double, current double, power double, "
        "id_line string",
    )


def _rows(df):
    return {(r["check"], r["columns"]): r for r in df.collect()}


def test_clean_and_defective_tables(spark):
    clean = _telemetry(
        spark, [(i, T0 + dt.timedelta(hours=i), 230.0, 10.0, 2300.0, "a") for i in range(5)]
    )
    assert quality.verdict(quality.validate_schema(clean.drop("event_id"))).first().is_valid
    rules = {"voltage": {"min": 180, "max": 260}, "unique_combinations": []}
    results = quality_gate(clean, rules)
    bad = {(r["check"], r["columns"]) for r in results.filter("NOT is_valid").collect()}
    assert bad == {("schema:extra", "event_id")}

    rows = [
        (0, T0, 300.0, 10.0, 3000.0, "a"),
        (1, T0, 230.0, -1.0, 9999.0, "a"),
        (2, T0 - dt.timedelta(hours=3), None, 10.0, 1.0, None),
    ]
    broken = _rows(quality_gate(_telemetry(spark, rows), rules))
    for check in (
        ("schema:max", "voltage"), ("schema:min", "current"), ("schema:not_null", "id_line"),
        ("range", "voltage"), ("unique", "timestamp,id_line"), ("increasing", "timestamp"),
        ("power", "power,voltage,current"), ("missing", "voltage"),
    ):
        assert not broken[check].is_valid, check
    assert broken["unique", "timestamp,id_line"].unexpected == 2
    assert broken["power", "power,voltage,current"].evaluated == 2


def test_wrong_types_and_missing_columns(spark):
    df = spark.createDataFrame([("x", "1.5"), ("2.5", None)], "voltage string, current string")
    results = _rows(quality.validate_schema(df))
    assert results["schema:type", "voltage"].unexpected == 1
    assert not results["schema:required", "power"].is_valid
    found = {(r.rule, r.column) for r in quality.schema_violations(
        df.withColumnRenamed("current", "power").selectExpr("*", "1 AS k"), "k").collect()}
    assert ("type", "voltage") in found and ("not_null", "power") in found
    assert [r.voltage for r in quality.coerce(df).collect()] == [None, 2.5]


def test_share_of_valid_values(spark):
    df = line(spark, [1] * 9 + [99, None])
    spec = {"x": {"min": 0, "max": 10}}
    assert quality.validate_ranges(df, spec).first().is_valid
    strict = {"x": {"min": 0, "max": 10, "missing_threshold": 0.05}}
    assert not quality.validate_ranges(df, strict).first().is_valid
    assert quality.validate_ranges(line(spark, [None]), spec).first().is_valid


def test_gap_is_strict(spark):
    hour = 3_600_000_000
    stamps = [0, hour, 2 * hour + 1]
    df = spark.createDataFrame([(s,) for s in stamps], "us long").selectExpr(
        "TIMESTAMP_NTZ '2024-01-01 00:00:00' + us * INTERVAL '0.000001' SECOND AS timestamp",
        "'a' AS id_line",
    )
    for cut in (1_000_000, 1):
        result = quality.validate_time_continuity(df, max_series_rows=cut).first()
        assert (result.evaluated, result.unexpected) == (2, 1)
        assert int(result.detail) == hour + 1
        assert quality.gap_violations(df, max_series_rows=cut).first().gap_us == hour + 1
    empty = quality.validate_time_continuity(df.limit(0)).first()
    assert empty.is_valid and empty.evaluated == 0


def test_rows_with_all_keys_missing_are_ignored(spark):
    df = spark.createDataFrame([(None, None), (None, None), (1, None), (1, None)], "a int, b int")
    assert quality.validate_unique(df, ["a", "b"]).first().unexpected == 2


def test_table_profile(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (None, "b"), (2, None)], "x int, s string")
    got = profile.profile_table(df).first()
    assert tuple(got) == (5, 2, 3, 2)
    empty = profile.profile_table(df.limit(0)).first()
    assert tuple(empty) == (0, 2, 0, 0)


def test_profiles_of_edge_columns(spark):
    df = spark.createDataFrame([(5.0, None), (5.0, None)], "c double, n double")
    for approximate in (True, False):
        rows = {r["column"]: r for r in profile.profile_columns(df, approximate=approximate).collect()}
        assert rows["c"].std == 0 and rows["c"].q50 == 5 and rows["c"].distinct == 1
        assert rows["n"].missing == 2 and rows["n"].q50 is None and rows["n"].distinct == 0
    assert profile.histogram(df, "n").count() == 0
    assert [r["count"] for r in profile.histogram(df, "c", 4).orderBy("bin").collect()] == [2, 0, 0, 0]
    corr = profile.correlation_pearson(df, ["c", "n"]).collect()
    assert len(corr) == 4
    assert all(r.correlation is None for r in profile.correlation_spearman(df, ["c", "n"]).collect())


def test_compare_keeps_columns_of_one_side(spark):
    a = spark.createDataFrame([(1.0, 2.0)], "x double, y double")
    out = profile.compare_datasets(a, a.select("x"), minimal=True)
    y = out.filter("`column` = 'y' AND statistic = 'mean'").first()
    assert y.value_Original == 2.0 and y.value_Modified is None
