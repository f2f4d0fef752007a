import random

import numpy as np
import pytest
from conftest import line, series
from pyspark.sql import functions as F

from tsprep.functions.metrics import regression_metrics
from tsprep.operators import modeling, sequences
from tsprep.plans import training
from tsprep.sources import sinks


@pytest.mark.parametrize("cut", [1_000_000, 5])
def test_sequences(spark, cut):
    values = [1, None, 3, 4, 5, 6]
    df = sequences.make_sequences(line(spark, values), 2, "x", ["x"], max_series_rows=cut)
    rows = df.orderBy("timestamp").collect()
    assert [[s.x for s in r.sequence] for r in rows] == [[1, None], [None, 3], [3, 4], [4, 5]]
    assert [r.target for r in rows] == [3, 4, 5, 6]


@pytest.mark.parametrize("n", [0, 1, 9, 10, 101])
@pytest.mark.parametrize("cut", [1_000_000, 7])
def test_split_sizes(spark, n, cut):
    df = line(spark, range(n)).union(line(spark, range(20), "b"))
    parts = sequences.chronological_split(df, max_series_rows=cut)
    sizes = {r["split"]: r["count"] for r in parts.filter("id_line = 'a'").groupBy("split").count().collect()}
    train, val = int(0.8 * n), int(0.1 * n)
    want = {"train": train, "val": val, "test": n - train - val}
    assert sizes == {k: v for k, v in want.items() if v}
    order = [r["split"] for r in parts.filter("id_line = 'a'").orderBy("timestamp").collect()]
    assert order == ["train"] * train + ["val"] * val + ["test"] * (n - train - val)


def test_pooled_features_ignore_the_order_inside_a_window(spark):
    a = sequences.pooled_features(line(spark, [1, 2, 3, 9]), 3, "x", ["x"]).first()
    b = sequences.pooled_features(line(spark, [3, 1, 2, 9]), 3, "x", ["x"]).first()
    assert (a.x_mean, a.x_std, a.x_min, a.x_max) == (b.x_mean, b.x_std, b.x_min, b.x_max)


def test_metrics(spark):
    rows = [(1.0, 2.0), (0.0, 1.0), (4.0, None), (None, 3.0), (3.0, 3.0)]
    got = regression_metrics(spark.createDataFrame(rows, "y double, p double"), "y", "p").first()
    assert (got.rows, got.skipped) == (3, 2)
    assert got.mae == pytest.approx(2 / 3) and got.mse == pytest.approx(2 / 3)
    assert got.mape == pytest.approx(50.0)  # a zero actual value is left out
    assert got.penalised_loss == pytest.approx(2 / 3 + 0.1 * 178)
    constant = spark.createDataFrame([(5.0, 4.0), (5.0, 6.0)], "y double, p double")
    assert regression_metrics(constant, "y", "p").first().r2 is None


@pytest.fixture(scope="module")
def samples(spark):
    rng = random.Random(1)
    df = line(spark, [200 + 10 * np.sin(i / 4) + rng.random() for i in range(400)])
    df = df.withColumn("x", F.when(F.col("hour") % 50 == 7, None).otherwise(F.col("x")))
    return training.make_samples(df, 6, "x", ["x"])


def test_models_beat_the_mean(spark, samples, tmp_path):
    board = modeling.leaderboard(samples, ["linear", "boosted", "unknown"])
    assert {r.model for r in board.collect()} == {"linear", "boosted"}
    assert all(r.r2 > 0.3 for r in board.collect())
    name, best = modeling.train_best(samples, ["linear", "boosted"])
    assert name in ("linear", "boosted") and best.numFeatures == 4
    model = modeling.train_model(samples, "boosted")
    path = sinks.save_model(model, str(tmp_path / "model"))
    again = sinks.load_model(spark, path)
    first = modeling.predict(model, samples).orderBy("timestamp").collect()
    assert first == modeling.predict(again, samples).orderBy("timestamp").collect()
    history = modeling.training_history(model, samples, "boosted")
    assert {r["split"] for r in history.collect()} == {"train", "val"}
    saved = sinks.export_training_history(history, str(tmp_path))
    assert spark.read.json(saved).count() == history.count()


def test_history_of_a_forest_is_that_of_its_first_trees(samples):
    model = modeling.train_model(samples, "forest", {"numTrees": 5})
    got = {(r["split"], r["step"]): r["value"] for r in modeling.training_history(model, samples, "forest").collect()}
    usable = samples.filter("features IS NOT NULL AND target IS NOT NULL")
    for split in ("train", "val"):
        rows = usable.filter(F.col("split") == split).select("features", "target").collect()
        each = np.array([[tree.predict(r.features) for tree in model.trees] for r in rows])
        target = np.array([r.target for r in rows])
        for step in range(5):
            want = np.mean((target - each[:, : step + 1].mean(axis=1)) ** 2)
            assert got[split, step] == pytest.approx(want)
    assert len(got) == 10
    default = modeling.training_history(modeling.train_model(samples, "linear"), samples, "linear")
    assert default.count() > 1


@pytest.mark.parametrize("name", ["linear", "forest", "boosted"])
def test_search_gives_the_loss_of_each_trial(samples, name):
    for row in modeling.search(samples, name, 2, seed=3).collect():
        settings = modeling.draw_settings(name, 2, 3)[row.trial]
        assert row.settings == {k: str(v) for k, v in settings.items()} and row.model == name
        model = modeling.train_model(samples, name, settings, seed=3)
        assert row.loss == pytest.approx(modeling.evaluate(model, samples, "val").first().penalised_loss)


def test_search_is_repeatable_and_updates_the_settings(samples):
    trials = modeling.search(samples, "linear", 3, seed=7)
    rows = trials.collect()
    assert [r.loss for r in rows] == sorted(r.loss for r in rows)
    assert modeling.draw_settings("linear", 3, 7) == modeling.draw_settings("linear", 3, 7)
    best = modeling.best_settings(trials, "linear")
    assert 1e-6 <= best["regParam"] <= 1e-4 and best["maxIter"] == 50


def test_train_and_evaluate(spark):
    df = line(spark, [200 + i % 5 for i in range(150)]).drop("hour")
    model, metrics, history = training.train_and_evaluate(
        df, "linear", {"solver": "l-bfgs"}, 5, "x", ["x"]
    )
    assert metrics.first().rows > 0 and history.count() > 1
    with pytest.raises(ValueError):
        training.train_and_evaluate(df, "transformer")


def test_registry_gives_back_the_best_model(spark, samples, tmp_path):
    base = str(tmp_path)
    entries = modeling.train_and_register(samples, base, "a", ["linear", "boosted"])
    best = entries.orderBy("loss").first()["model"]
    model = modeling.train_model(samples, best)
    for loss in (None, float("nan")):
        sinks.register_model(spark, base, "b", best, model, loss)
    with pytest.raises(ValueError):
        sinks.load_best_model(spark, base, "b")
    name, loaded = sinks.load_best_model(spark, base)
    assert name == best and sinks.registered_models(spark, base).count() == 4
    rows = [modeling.predict(m, samples).orderBy("timestamp").collect() for m in (model, loaded)]
    assert [r["predicted"] for r in rows[0]] == pytest.approx([r["predicted"] for r in rows[1]], nan_ok=True)


def test_equal_losses_go_to_the_first_name(spark, samples, tmp_path):
    model = modeling.train_model(samples, "linear")
    for name in ("b", "a"):
        sinks.register_model(spark, str(tmp_path), "x", name, model, 1.0)
    saved = sinks.registered_models(spark, str(tmp_path)).orderBy("saved_at", "model").first()
    assert sinks.load_best_model(spark, str(tmp_path))[0] == saved["model"]


def test_search_by_the_normal_solver_reads_samples_once(spark, samples):
    """The trials share one pass, and get the models that each would get from the samples."""
    seen = spark.sparkContext.accumulator(0)

    def note(v):
        seen.add(1)
        return v

    noted = samples.withColumn("target", F.udf(note, "double", useArrow=False)(F.col("target").cast("double")))
    found = modeling.search(noted, "linear", n_trials=6, config={"solver": "normal"}).collect()
    assert seen.value <= 3 * samples.count()
    trial = found[0]
    config = {"solver": "normal", **{k: float(v) for k, v in trial["settings"].items()}}
    alone = modeling.evaluate(modeling.train_model(samples, "linear", config), samples, "val").first()
    assert abs(alone["penalised_loss"] - trial["loss"]) < 1e-6 * abs(trial["loss"])


def test_window_features_are_made_once(spark, monkeypatch):
    """The split's range shuffle reads its rows twice, so these have to come from files."""
    plans = []
    split = training.chronological_split

    def seen(samples, *args):
        plans.append(samples._jdf.queryExecution().optimizedPlan().toString())
        return split(samples, *args)

    monkeypatch.setattr(training, "chronological_split", seen)
    samples = training.make_samples(line(spark, range(40)), 3, "x", ["x"], max_series_rows=10)
    assert samples.count() == 37
    assert len(plans) == 1 and "Window" not in plans[0]
