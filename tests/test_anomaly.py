import math
import random

import numpy as np
import pytest
from conftest import line, series
from pyspark.sql import functions as F

from tsprep.operators import anomaly, isolation


def test_constant_and_missing_values_are_not_flagged(spark):
    df = line(spark, [5.0] * 30 + [None])
    for flagged in (anomaly.detect_global(df, ["x"]), anomaly.detect_rolling(df, ["x"])):
        assert flagged.filter("is_anomaly").count() == 0
    assert anomaly.remove_outliers(anomaly.detect_global(df, ["x"])).count() == 31


def test_one_spike(spark):
    values = [float(i % 3) for i in range(60)]
    values[50] = 100.0
    df = line(spark, values)
    flagged = anomaly.detect_global(df, ["x"])
    assert [r.x for r in flagged.filter("is_anomaly").collect()] == [100.0]
    rolling = anomaly.detect_rolling(df, ["x"])
    assert [r.x for r in rolling.filter("is_anomaly").collect()] == [100.0]
    details = anomaly.anomaly_details(flagged, ["x"]).first()
    assert (details.flagged, details.min_flagged) == (1, 100.0)
    assert anomaly.removed_count(flagged).first().removed == 1


def test_null_flag_keeps_the_row(spark):
    df = spark.createDataFrame([(1, None), (2, True), (3, False)], "i int, is_anomaly boolean")
    assert [r.i for r in anomaly.remove_outliers(df).orderBy("i").collect()] == [1, 3]


def _lof(points, k):
    """Factor of each point by comparing all pairs; ties go to the smaller key."""
    n = len(points)
    d = np.sqrt(((points[:, None, :] - points[None, :, :]) ** 2).sum(axis=2))
    near = [sorted((d[i, j], j) for j in range(n) if j != i)[:k] for i in range(n)]
    kdist = np.array([x[-1][0] for x in near])
    lrd = np.array([1 / (np.mean([max(kdist[j], x) for x, j in near[i]]) + 1e-10) for i in range(n)])
    return np.array([np.mean([lrd[j] for _, j in near[i]]) / lrd[i] for i in range(n)])


@pytest.mark.parametrize("spread", [6, 1000])
def test_lof_equals_brute_force(spark, spread):
    """A small spread gives many rows at the same place; one cluster is much denser."""
    rng = random.Random(3)
    rows = [(i, float(rng.randint(0, spread)), float(rng.randint(0, spread))) for i in range(150)]
    rows += [(150 + i, 500 + rng.random(), 500 + rng.random()) for i in range(80)]
    df = spark.createDataFrame(rows, "event_id long, a double, b double")
    got = anomaly.local_outlier_factor(df, ["a", "b"], k=5).orderBy("event_id").collect()
    want = _lof(np.array([r[1:] for r in rows]), 5)
    assert np.allclose([r.lof for r in got], want, rtol=1e-6)


def _grid(spark):
    rows = [(5 * i + j, float(i), float(j)) for i in range(5) for j in range(5)]
    return spark.createDataFrame([*rows, (99, 50.0, 50.0)], "event_id long, a double, b double")


def test_far_point_ranks_first(spark):
    lof = anomaly.local_outlier_factor(_grid(spark), ["a", "b"], k=4)
    assert lof.orderBy(F.desc("lof")).first().event_id == 99
    forest = isolation.isolation_forest(_grid(spark), ["a", "b"])
    assert forest.orderBy(F.desc("score")).first().event_id == 99
    assert [r.event_id for r in forest.filter("is_anomaly").collect()].count(99) == 1


def test_forest_does_not_depend_on_partitions(spark):
    rng = random.Random(5)
    rows = [(i, rng.gauss(0, 1), None if i % 9 == 0 else rng.gauss(0, 1)) for i in range(600)]
    df = spark.createDataFrame(rows, "event_id long, a double, b double")
    results = [
        isolation.isolation_forest(df.repartition(n), ["a", "b"], trees=20).orderBy("event_id").collect()
        for n in (1, 7)
    ]
    assert results[0] == results[1]
    assert all((r.score is None) == (r.b is None) for r in results[0])
    assert not any(r.is_anomaly for r in results[0] if r.b is None)


def test_average_path():
    assert isolation.average_path(1) == 0 and isolation.average_path(2) == 1
    assert math.isclose(isolation.average_path(256), 10.2448, abs_tol=1e-3)


def test_span_frames_of_a_burst(spark):
    """Rows of one moment share a frame; cut and uncut agree."""
    values = [1.0, 2.0, 1.5, 1.2, 90.0, 1.1, 1.4, 1.3]
    df = line(spark, values * 5).union(line(spark, values * 5))
    results = [
        series(anomaly.detect_rolling(df, ["x"], 1.5, hours=6, max_series_rows=cut), "is_anomaly",
               ("timestamp", "x"))
        for cut in (1_000_000, 4)
    ]
    assert results[0] == results[1] and any(results[0])


def _span_by_hand(rows, hours, threshold):
    """Two passes over each frame, in whole numbers of hours."""
    flags = []
    for t, x in rows:
        frame = [v for u, v in rows if t - hours <= u <= t and v is not None]
        std = np.std(frame, ddof=1) if len(frame) > 1 else 0
        flags.append(bool(x is not None and std > 0 and abs(x - np.mean(frame)) > threshold * std))
    return flags


@pytest.mark.parametrize("spike", [1e9, 1e12, None])
@pytest.mark.parametrize("max_rows", [250_000, 64])
def test_span_frames_forget_spikes(spark, spike, max_rows):
    """An outlier long after a huge one is found as if the huge one had never been."""
    rng = np.random.default_rng(4)
    values = [float(v) for v in rng.normal(230, 2, 600)]
    values[450], values[300] = 260.0, None
    if spike:
        values[10] = spike
    rows = [(i // 2 if 100 <= i < 140 else i, v) for i, v in enumerate(values)]
    rows.sort(key=lambda r: r[0])
    data = [("a", t, v, i) for i, (t, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "id_line string, hour int, x double, n int").selectExpr(
        "id_line", "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, hour) AS timestamp", "x", "n"
    )
    found = anomaly.detect_rolling(df, ["x"], 3.0, hours=24, max_series_rows=max_rows)
    got = [r["x_anomaly"] for r in found.orderBy("n").collect()]
    assert got == _span_by_hand(rows, 24, 3.0) and got[next(i for i, r in enumerate(rows) if r[1] == 260.0)]


def test_summaries_merge_like_one_pass():
    rng = np.random.default_rng(5)
    x = rng.normal(1e6, 1, (40, 2))
    part = np.repeat([0, 1, 2], [7, 30, 3])
    n, m, q = anomaly.merge_forward(np.ones_like(x), x, np.zeros_like(x), part)
    for i in range(40):
        held = x[: i + 1][part[: i + 1] == part[i]]
        assert np.allclose([n[i], m[i], q[i]], [[len(held)] * 2, held.mean(0), held.var(0) * len(held)])


@pytest.mark.parametrize("limit", [3, 1_000])
def test_frames_of_cells(spark, limit):
    """However finely a span is cut, frames hold the same rows; lines may be NULL, times before 1970."""
    rng, span = np.random.default_rng(6), 50
    times = {k: sorted(set(rng.integers(-300, 300, 120).tolist() + list(range(40, 60)))) for k in ("a", None)}
    rows = [(k, x, 1.0, float(x % 7), 0.0) for k, xs in times.items() for x in xs]
    df = spark.createDataFrame(rows, "id_line string, __x long, n0 double, m0 double, q0 double")
    got = anomaly.span_frames(df, ["id_line"], 1, span, limit).collect()
    assert sorted((str(r[0]), r[1]) for r in got) == sorted((str(r[0]), r[1]) for r in rows)
    for line_id, x, *found in got:
        held = np.array([float(u % 7) for u in times[line_id] if x - span <= u <= x])
        assert np.allclose(found, [len(held), held.mean(), held.var() * len(held)])


def test_a_call_on_arrays_holds_a_bounded_number_of_rows(spark, monkeypatch):
    """A dense line is cut by time, though it is shorter than the longest series left whole."""
    rows = [("a", x, 1.0, 1.0, 0.0) for x in range(4_000)]
    df = spark.createDataFrame(rows, "id_line string, __x long, n0 double, m0 double, q0 double")
    monkeypatch.setattr(anomaly, "BUNDLE_ROWS", 100)
    seen, deal = [], anomaly._bundles
    monkeypatch.setattr(anomaly, "_bundles", lambda d, *rest: seen.append(deal(d, *rest)) or seen[-1])
    got = anomaly.span_frames(df, ["id_line"], 1, 3_000, 50)
    assert {r["n0"] for r in got.where("__x >= 3000").collect()} == {3_001.0}
    assert max(r["count"] for g in seen for r in g.count().collect()) < 1_000
