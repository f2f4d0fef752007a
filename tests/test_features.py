import math
import random

import numpy as np
import pandas as pd
import pytest
from conftest import line, series
from pyspark.sql import functions as F

from tsprep.operators import encode, features, scale
from tsprep.operators.quantiles import exact_quantiles


def _cats(spark):
    rows = [(i, v) for i, v in enumerate(["a", "a", "b", "c", None])]
    return spark.createDataFrame(rows, "i int, c string")


@pytest.mark.parametrize("method", ["standard", "robust", "minmax"])
def test_constant_column(spark, method):
    df = spark.createDataFrame([(5.0,)] * 4, "x double")
    assert {r.x_scaled for r in scale.scale(df, "x", method).collect()} == {0.0}


def test_scaled_moments_and_options(spark):
    rng = random.Random(0)
    values = [rng.gauss(7, 3) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    z = np.array(series(scale.scale(df, "x"), "x_scaled", ["x"]))
    assert abs(z.mean()) < 1e-9 and abs(z.std() - 1) < 1e-9
    raw = series(scale.scale(df, "x", with_mean=False, with_std=False), "x_scaled", ["x"])
    assert raw == sorted(values)
    r = series(scale.scale(df, "x", "robust", quantile_range=(10, 90)), "x_scaled", ["x"])
    low, mid, high = np.percentile(values, [10, 50, 90])
    assert np.allclose(r, (np.sort(values) - mid) / (high - low))
    m = series(scale.scale(df, "x", "minmax", feature_range=(-1, 1)), "x_scaled", ["x"])
    assert m[0] == -1 and m[-1] == pytest.approx(1)


def test_all_missing_column_and_unknown_method(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    for method in scale.METHODS:
        assert scale.scale(df, "x", method).filter("x_scaled IS NOT NULL").count() == 0
    with pytest.raises(ValueError):
        scale.scale(df, "x", "log")


@pytest.mark.parametrize("cut", [1_000_000, 50])
def test_exact_quantiles_equal_numpy(spark, cut):
    rng = random.Random(1)
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    a = [rng.choice([0.0, rng.random()]) for _ in range(2003)]  # half the rows are one value
    b = [None if rng.random() < 0.3 else rng.gauss(0, 1e6) for _ in a]
    df = spark.createDataFrame(list(zip(a, b)), "a double, b double")
    got = exact_quantiles(df, ["a", "b"], shares, cut)
    assert np.allclose(got["a"], np.quantile(a, shares))
    assert np.allclose(got["b"], np.quantile([v for v in b if v is not None], shares))


def test_onehot(spark):
    df = encode.encode_onehot(_cats(spark), "c")
    assert df.columns == ["i", "c", "c_a", "c_b", "c_c", "c_nan"]
    assert [tuple(r)[2:] for r in df.orderBy("i").collect()][-1] == (False, False, False, True)
    with pytest.raises(ValueError):
        encode.encode_categorical(df, "c", "hash")


def test_onehot_with_a_cap(spark):
    df = encode.encode_onehot(_cats(spark), "c", max_categories=1)
    assert df.columns == ["i", "c", "c_Other", "c_a", "c_nan"]
    rows = df.orderBy("i").collect()
    assert [r.c for r in rows] == ["a", "a", "Other", "Other", "Other"]
    assert not any(r.c_nan for r in rows)


@pytest.mark.parametrize("cut", [1_000_000, 1])
def test_label_codes_follow_first_appearance(spark, cut):
    df = encode.encode_label(_cats(spark), "c", ["i"], cut)
    assert [r.c_encoded for r in df.orderBy("i").collect()] == [0, 0, 1, 2, 3]


def test_calendar(spark):
    df = line(spark, list(range(24 * 9)))
    got = features.add_time_features(df).toPandas().sort_values("timestamp")
    t = got["timestamp"]
    assert np.allclose(got["hour_sin"], np.sin(2 * np.pi * t.dt.hour / 24))
    assert (got["day_of_week"] == t.dt.dayofweek).all()
    assert (got["is_weekend"] == t.dt.dayofweek.isin([5, 6])).all()
    assert (got["is_holiday"] == got["is_weekend"]).all()
    only = features.add_time_features(df, config={"time_features": ["month"]})
    assert only.columns == [*df.columns, "month"]


def test_holiday_table(spark):
    days = spark.sql("SELECT DATE '2024-01-02' AS d UNION ALL SELECT DATE '2024-01-02'")
    df = features.add_time_features(line(spark, range(48)), features=["is_holiday"], holidays=days)
    assert df.count() == 48 and df.filter("is_holiday").count() == 24


def test_calendar_runs_on_a_stream(spark, tmp_path):
    line(spark, range(30)).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id_line string, timestamp timestamp_ntz, x double").parquet(
        str(tmp_path / "in")
    )
    out = features.add_time_features(stream)
    query = out.writeStream.format("memory").queryName("calendar").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("calendar").filter("hour_sin IS NOT NULL").count() == 30


@pytest.mark.parametrize("cut", [1_000_000, 10, 1])
def test_rolling_equals_pandas(spark, cut):
    rng = random.Random(2)
    values = [None if rng.random() < 0.05 else rng.random() for _ in range(90)]
    names = ["mean", "std", "min", "max", "range"]
    df = features.window_agg(line(spark, values), "x", [1, 6, 12], names, max_series_rows=cut)
    got = df.toPandas().sort_values("timestamp").reset_index(drop=True)
    for n in (1, 6, 12):
        roll = pd.Series(values, dtype=float).rolling(n)
        want = {f: getattr(roll, f)() for f in names[:4]}
        want["range"] = want["max"] - want["min"]
        for f in names:
            assert np.allclose(got[f"x_roll{n}_{f}"], want[f], equal_nan=True, atol=1e-9)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rolling_takes_one_shuffle(spark, sf):
    from tsprep.sources.readings import MEASURES, ORDER, SERIES, readings

    df = features.window_agg(
        readings(spark, sf), MEASURES, [6, 12, 24], ["mean", "std"], SERIES, ORDER
    )
    plan = _plan(df)
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1
    assert "props" not in plan  # unused columns are not read


def test_cut_rolling_has_no_single_task(spark, sf):
    from tsprep.sources.readings import ORDER, readings

    df = features.window_agg(readings(spark, sf), "voltage", 6, ["mean"], (), ORDER, 100)
    # the only single-task step is over the table of ranges
    windows = [x for x in _plan(df).splitlines() if "SinglePartition" in x]
    assert len(windows) <= 1


def test_feature_log(spark):
    log = features.feature_summary(
        spark, [{"operation": "encoding", "input": "c", "output": ["c_a", "c_nan"]}]
    )
    assert log.first().output_column == "c_a,c_nan"


def test_value_counts(spark):
    rows = encode.value_counts(_cats(spark), "c").collect()
    assert [(r.c, r["count"]) for r in rows] == [("a", 2), ("b", 1), ("c", 1)]


def test_text_nan_is_missing(spark):
    df = spark.createDataFrame([("nan",), (None,), ("a",)], "c string")
    out = encode.encode_onehot(df, "c")
    assert out.columns == ["c", "c_a", "c_nan"]
    assert sorted(r.c_nan for r in out.collect()) == [False, True, True]


def test_sparse_onehot(spark):
    from tsprep.operators.encode import encode_onehot_sparse

    rows = [(1, "b"), (2, None), (3, "a"), (4, "nan"), (5, "b"), (6, "c")]
    df = spark.createDataFrame(rows, "id int, s string")
    got = {r["id"]: r["s_onehot"] for r in encode_onehot_sparse(df, "s", 2).collect()}
    assert {i: (v.size, list(v.indices)) for i, v in got.items()} == {
        1: (4, [1]), 2: (4, [3]), 3: (4, [0]), 4: (4, [3]), 5: (4, [1]), 6: (4, [2]),
    }
    none = encode_onehot_sparse(df.limit(0), "s")
    assert none.collect() == [] and none.columns == ["id", "s", "s_onehot"]
    only_missing = encode_onehot_sparse(df.where("s IS NULL"), "s").collect()
    assert [(r["s_onehot"].size, list(r["s_onehot"].indices)) for r in only_missing] == [(1, [0])]


def test_copies_by_fingerprint(spark):
    from tsprep.operators.profile import profile_table

    nan = float("nan")
    rows = [(0.0, "x"), (-0.0, "x"), (nan, None), (nan, None), (None, None), (1.0, "")] + [(2.0, "y")] * 5
    df = spark.createDataFrame(rows, "d double, s string")
    assert tuple(profile_table(df).first()) == (11, 2, 4, 6)
    assert tuple(profile_table(df.limit(0)).first()) == (0, 2, 0, 0)
    plan = profile_table(df)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
