import math
import random

import numpy as np
import pandas as pd
import pytest
from conftest import line, series
from pyspark.sql import functions as F

from tsprep.operators import impute as op

RUNS = [None, None, 1, None, None, None, 4, None, None]
# whole series, and cut into chunks of two rows
CUTS = [1_000_000, 2]


@pytest.mark.parametrize("cut", CUTS)
@pytest.mark.parametrize("limit", [None, 1, 2, 5])
def test_fills_equal_pandas(spark, limit, cut):
    df, s = line(spark, RUNS), pd.Series(RUNS, dtype=float)
    for ours, theirs in ((op.fill_forward, s.ffill), (op.fill_backward, s.bfill)):
        got = series(ours(df, "x", limit, max_series_rows=cut))
        want = theirs(limit=limit)
        assert got == [None if math.isnan(v) else v for v in want]


@pytest.mark.parametrize("cut", CUTS)
@pytest.mark.parametrize("limit", [None, 1, 2, 5])
@pytest.mark.parametrize("method", ["linear", "time"])
def test_interpolation_equals_pandas(spark, method, limit, cut):
    hours = [0, 1, 2, 5, 6, 10, 11, 12, 20]
    rows = [("a", h, None if v is None else float(v)) for h, v in zip(hours, RUNS)]
    df = spark.createDataFrame(rows, "id_line string, hour int, x double").selectExpr(
        "id_line",
        "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, hour) AS timestamp",
        "x",
    )
    index = pd.Timestamp("2024-01-01") + pd.to_timedelta(hours, "h")
    want = pd.Series(RUNS, index=index, dtype=float).interpolate(method, limit=limit)
    got = series(op.interpolate(df, "x", method, limit, max_series_rows=cut))
    assert [v is None for v in got] == list(want.isna())
    assert np.allclose([v for v in got if v is not None], want.dropna())


@pytest.mark.parametrize("cut", CUTS)
def test_polynomial_is_exact_on_a_parabola(spark, cut):
    values = [float(i * i) for i in range(12)]
    gaps = [None if i in (3, 4, 7, 9) else v for i, v in enumerate(values)]
    got = series(op.interpolate(line(spark, gaps), "x", "polynomial", max_series_rows=cut))
    assert np.allclose(got, values)


def test_polynomial_leaves_ends_and_too_few_points(spark):
    ends = op.interpolate(line(spark, [None, 0, None, 4, 9, None]), "x", "polynomial")
    assert series(ends)[0] is None and series(ends)[-1] is None
    few = op.interpolate(line(spark, [1, None, 3]), "x", "polynomial")
    assert series(few) == [1.0, None, 3.0]


def test_nearest_and_slinear_leave_both_ends(spark):
    df = line(spark, RUNS)
    assert series(op.interpolate(df, "x", "nearest")) == [None, None, 1, 1, 1, 4, 4, None, None]
    assert series(op.interpolate(df, "x", "slinear"))[2:7] == [1, 1.75, 2.5, 3.25, 4]
    with pytest.raises(ValueError):
        op.interpolate(df, "x", "cubic")


def test_lines_do_not_leak(spark):
    df = line(spark, [1, None], "a").union(line(spark, [None, 2], "b"))
    assert series(op.fill_forward(df, "x")) == [1, 1, None, 2]
    assert series(op.fill_backward(df, "x")) == [1, None, 2, 2]


def test_all_missing_and_empty_tables(spark):
    df = line(spark, [None, None])
    for filled in (
        op.fill_forward(df, "x"), op.interpolate(df, "x"), op.fill_mean(df, "x"),
        op.interpolate(df, "x", "polynomial"),
    ):
        assert series(filled) == [None, None]
    assert op.fill_forward(df.limit(0), "x").count() == 0


def test_null_line_is_a_line_of_its_own(spark):
    df = line(spark, [1, None, None], None)
    for cut in CUTS:
        assert series(op.fill_forward(df, "x", max_series_rows=cut)) == [1, 1, 1]


def test_no_series_equals_one_constant_series(spark):
    rng = random.Random(1)
    df = line(spark, [rng.choice([None, rng.random()]) for _ in range(300)])
    for cut in (1_000_000, 7):
        whole = op.interpolate(df, "x", "linear", 3, series_by=(), max_series_rows=cut)
        keyed = op.interpolate(df, "x", "linear", 3, max_series_rows=cut)
        assert series(whole) == series(keyed)


def test_known_values_never_change_and_rows_stay(spark):
    rng = random.Random(2)
    values = [rng.choice([None, rng.random()]) for _ in range(200)]
    df = line(spark, values)
    for method in ("linear", "time", "slinear", "nearest", "polynomial"):
        got = series(op.interpolate(df, "x", method))
        assert len(got) == 200
        assert all(g == v for g, v in zip(got, values) if v is not None)


def test_partition_count_does_not_matter(spark):
    rng = random.Random(3)
    df = line(spark, [rng.choice([None, rng.random()]) for _ in range(400)])
    results = [series(op.fill_forward(df.repartition(n), "x", 2)) for n in (1, 8, 50)]
    assert results[0] == results[1] == results[2]


def test_hot_line_is_cut(spark):
    """A third of the rows in one line: same rows as the plain window."""
    rng = random.Random(4)
    hot = line(spark, [rng.choice([None, rng.random()]) for _ in range(600)], "hot")
    df = hot
    for i in range(12):
        df = df.union(line(spark, [rng.choice([None, rng.random()]) for _ in range(100)], f"l{i}"))
    plain = series(op.interpolate(df, "x", "time", 2))
    assert plain == series(op.interpolate(df, "x", "time", 2, max_series_rows=150))


def _brute(rows, target, coords, k, weights):
    known = [r for r in rows if r[target] is not None]
    out = {}
    for r in rows:
        if r[target] is not None:
            out[r["event_id"]] = r[target]
            continue
        near = []
        for d in known:
            both = [c for c in coords if r[c] is not None and d[c] is not None]
            if both:
                total = sum((r[c] - d[c]) ** 2 for c in both)
                near.append((math.sqrt((len(coords) + 1) / len(both) * total), d["event_id"], d))
        near = sorted(near, key=lambda n: n[:2])[:k]
        if not near:
            out[r["event_id"]] = sum(d[target] for d in known) / len(known)
        elif weights == "uniform":
            out[r["event_id"]] = sum(n[2][target] for n in near) / len(near)
        else:
            exact = [n for n in near if n[0] == 0]
            pairs = [(1.0, n) for n in exact] or [(1 / n[0], n) for n in near]
            out[r["event_id"]] = sum(w * n[2][target] for w, n in pairs) / sum(w for w, _ in pairs)
    return out


def _knn_table(n, seed, spread):
    rng = random.Random(seed)
    return [
        {
            "event_id": i,
            **{
                c: None if rng.random() < 0.2 else float(rng.randint(0, spread))
                for c in ("a", "b", "c", "t")
            },
        }
        for i in range(n)
    ]


@pytest.mark.parametrize("weights", ["uniform", "distance"])
@pytest.mark.parametrize("spread", [4, 1000])
def test_knn_equals_brute_force(spark, weights, spread):
    """Three features with gaps of every pattern; a small spread gives many equal places."""
    rows = _knn_table(120, 5, spread)
    df = spark.createDataFrame(
        [tuple(r.values()) for r in rows],
        "event_id long, a double, b double, c double, t double",
    )
    got = op.knn_impute(df, "t", ["a", "b", "c"], "event_id", 3, weights)
    got = {r.event_id: r.t for r in got.collect()}
    filled = {f: _brute(rows, f, [c for c in "abc" if c != f], 3, weights) for f in "abc"}
    whole = [
        {"event_id": r["event_id"], "t": r["t"], **{f: filled[f][r["event_id"]] for f in "abc"}}
        for r in rows
    ]
    want = _brute(whole, "t", list("abc"), 3, weights)
    assert got.keys() == want.keys()
    wrong = [k for k in want if not math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-9)]
    assert not wrong


def test_knn_by_hand(spark):
    rows = [
        (1, 0.0, 0.0, 10.0), (2, 1.0, 0.0, 20.0), (3, 10.0, 0.0, 30.0), (4, 11.0, 0.0, 40.0),
        (5, 0.4, 0.0, None), (6, 10.6, None, 60.0),
    ]
    df = spark.createDataFrame(rows, "event_id long, a double, b double, t double")
    got = {r.event_id: r.t for r in op.knn_impute(df, "t", ["a", "b"], k=2).collect()}
    assert got[5] == 15.0
    one = {r.event_id: r.t for r in op.knn_impute(df, "t", ["a", "b"], k=50).collect()}
    assert one[5] == pytest.approx(32.0)  # fewer donors than k: all five of them


def test_knn_with_nothing_to_compare(spark):
    rows = [(1, None, 4.0), (2, None, 6.0), (3, None, None)]
    df = spark.createDataFrame(rows, "event_id long, a double, t double")
    got = {r.event_id: r.t for r in op.knn_impute(df, "t", ["a"]).collect()}
    assert got == {1: 4.0, 2: 6.0, 3: 5.0}


def test_forest_fills_all_gaps_only(spark):
    rows = [(i, float(i % 10), None if i % 7 == 0 else 3.0 * (i % 10)) for i in range(200)]
    df = spark.createDataFrame(rows, "event_id long, a double, t double")
    got = {r.event_id: r.t for r in op.rf_impute(df, "t", ["a"], n_estimators=10).collect()}
    assert all(got[i] == t for i, _, t in rows if t is not None)
    assert all(abs(got[i] - 3 * (i % 10)) < 3 for i, _, t in rows if t is None)


def test_strategies_by_config(spark, caplog):
    df = line(spark, RUNS)
    rules = {"x": {"strategy": "backward_fill", "limit": 1}}
    assert series(op.apply_config_strategy(df, "x", rules))[1] == 1
    assert op.apply_config_strategy(df, "hour", rules) is df
    assert op.apply_config_strategy(df, "x", {"x": {"strategy": "magic"}}) is df
    constant = {"x": {"strategy": "constant", "value": 7.0}}
    assert series(op.apply_config_strategy(df, "x", constant))[0] == 7.0
    # the number of neighbours counts on either level of the configuration
    table = spark.createDataFrame(
        [(1, 0.0, 1.0), (2, 1.0, 2.0), (3, 2.0, 9.0), (4, 0.1, None)],
        "event_id long, a double, t double",
    )
    for rule in ({"n_neighbors": 1}, {"parameters": {"n_neighbors": 1}}):
        config = {"t": {"strategy": "model_impute", "method": "knn", **rule}}
        got = op.apply_config_strategy(table, "t", config, ["a"])
        assert got.filter("event_id = 4").first().t == 1.0


def test_missing_columns(spark):
    assert op.missing_columns(line(spark, RUNS)) == ["x"]
    assert op.missing_columns(line(spark, [1, 2])) == []


def test_copies_are_cut_before_the_shuffle(spark):
    """A place with many copies sends at most k rows per task."""
    from tsprep.operators.nearest import _points

    item = F.struct(F.col("id").alias("key"), F.lit(1).alias("payload")).alias("item")
    rows = spark.range(1000).select(F.lit(0).alias("__g"), (F.col("id") % 3).cast("double").alias("__x0"), item)
    points = _points(rows, ["__x0"], 4)
    plan = points._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert sorted(len(r["items"]) for r in points.collect()) == [4, 4, 4]


def test_knn_keeps_rows_of_repeated_and_missing_keys(spark):
    rows = [(1, 1.0, 5.0), (1, 2.0, None), (2, 3.0, 7.0), (None, 4.0, None), (3, 5.0, 9.0)]
    df = spark.createDataFrame(rows, "event_id int, x double, y double")
    got = op.knn_impute(df, "y", ["x"], "event_id", 2)
    assert sorted(r.y for r in got.collect()) == [5.0, 6.0, 7.0, 8.0, 9.0]
    assert got.columns == df.columns


def test_options_of_the_other_model_are_left_aside(spark):
    df = spark.createDataFrame([(float(i), float(i) if i % 3 else None) for i in range(30)], "x double, y double")
    filled = op.model_impute(df, "y", ["x"], "rf", n_neighbors=5, n_estimators=3)
    assert filled.where("y IS NULL").count() == 0


def test_nearest_neighbours_move_only_rows_with_a_gap(spark):
    """Rows without a gap reach the result from the scan, without a join or a shuffle."""
    rows = [(i, i * 1.0 if i % 3 else None, i * 2.0 if i % 4 else None, i * 3.0 if i % 5 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id int, a double, b double, t double")
    out = op.knn_impute(df, "t", ["a", "b"], "event_id", 1)
    assert {r.event_id: r.t for r in out.collect() if r.event_id % 5} == {r[0]: r[3] for r in rows if r[0] % 5}
    assert out.filter("t IS NULL").count() == 0
    plan = out._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() == "Project":
        plan = plan.children().head()
    assert plan.nodeName() == "Union"
    assert "Join" not in plan.children().head().toString()
