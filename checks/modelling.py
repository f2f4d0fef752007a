"""Windows, splits, metrics and models on the readings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsprep.functions.metrics import regression_metrics as metrics
from tsprep.operators import modeling, sequences as op
from tsprep.operators.ordered import over_rows
from tsprep.plans import training
from tsprep.session import shared_folder
from tsprep.sources import sinks
from tsprep.sources.readings import MEASURES, ORDER, SERIES, readings

from .common import LINE, READINGS, WHOLE, settled, settled_column

AXIS = dict(series_by=SERIES, order_by=ORDER)


def _flat(df: DataFrame) -> DataFrame:
    """Sequences as text of row ids and as sums."""
    return df.select(
        "event_id",
        F.array_join(F.transform("sequence", lambda s: s["event_id"].cast("string")), ",").alias(
            "rows"
        ),
        F.round(
            F.aggregate(
                "sequence", F.lit(0.0),
                lambda acc, s: acc + F.coalesce(s["voltage"], F.lit(0.0)),
            ), 4,
        ).alias("voltage_sum"),
        F.round("target", 6).alias("target"),
    )


def sequence_windows(spark: SparkSession, sf: str) -> DataFrame:
    df = op.make_sequences(readings(spark, sf), 24, "voltage", list(MEASURES), **AXIS)
    return _flat(df)


def sequence_windows_whole(spark: SparkSession, sf: str) -> DataFrame:
    df = op.make_sequences(
        readings(spark, sf), 24, "voltage", list(MEASURES), (), ORDER, max_series_rows=500
    )
    return _flat(df)


def _split(**options):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        slim = readings(spark, sf).select("id_line", "ts", "event_id", "voltage")
        samples = op.pooled_features(slim, 24, "voltage", ["voltage"], **AXIS)
        df = op.chronological_split(samples, **{**AXIS, **options})
        return df.select("event_id", "split")

    return run


def pooled_window_features(spark: SparkSession, sf: str) -> DataFrame:
    df = op.pooled_features(readings(spark, sf), 24, "voltage", list(MEASURES), **AXIS)
    names = [f"{c}_{p}" for c in MEASURES for p in ("mean", "std", "min", "max")]
    return df.select("event_id", *[settled_column(c) for c in names])


def _naive(spark: SparkSession, sf: str) -> DataFrame:
    """Predict each value by the one before it on the line."""
    return over_rows(
        readings(spark, sf),
        lambda w: [F.lag("voltage").over(w).alias("v"), F.lag("current").over(w).alias("c")],
        SERIES, ORDER, before=1,
    )


METRICS = ("mae", "mse", "rmse", "mape", "r2", "penalised_loss")


def regression_metrics(spark: SparkSession, sf: str) -> DataFrame:
    df = metrics(_naive(spark, sf), "voltage", "v")
    return df.select("rows", "skipped", *[settled_column(m) for m in METRICS])


def regression_metrics_per_line(spark: SparkSession, sf: str) -> DataFrame:
    df = metrics(_naive(spark, sf), "current", "c", by=SERIES, low=0.0, high=40.0, weight=0.5)
    return df.select("id_line", "rows", "skipped", *[settled_column(m) for m in METRICS])


def penalised_loss(spark: SparkSession, sf: str) -> DataFrame:
    """The loss alone, with bounds that the predictions do leave."""
    df = metrics(_naive(spark, sf), "voltage", "v", by=SERIES, low=202.0, high=210.0)
    return df.select("id_line", settled_column("penalised_loss"))


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    slim = readings(spark, sf)
    return training.make_samples(slim, 24, "voltage", list(MEASURES), **AXIS)


def train_predict(spark: SparkSession, sf: str) -> DataFrame:
    samples = _samples(spark, sf)
    model = modeling.train_model(samples, "boosted")
    return modeling.predict(model, samples, "test")


def training_history(spark: SparkSession, sf: str) -> DataFrame:
    samples = _samples(spark, sf)
    parts = [
        modeling.training_history(modeling.train_model(samples, name), samples, name)
        for name in modeling.MODELS
    ]
    return reduce(DataFrame.unionByName, parts)


def hyperparameter_search(spark: SparkSession, sf: str) -> DataFrame:
    return modeling.search(_samples(spark, sf), "linear", config={"solver": "normal"})


def model_leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    return modeling.leaderboard(_samples(spark, sf))


#: Least squares without a penalty, which SQL can compute too.
PLAIN = {"regParam": 0.0, "solver": "normal"}


def _voltage_samples(spark: SparkSession, sf: str) -> DataFrame:
    return training.make_samples(readings(spark, sf), 24, "voltage", ["voltage"], **AXIS)


def train_predict_linear(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions of least squares on window features, for the rows of all splits."""
    samples = _voltage_samples(spark, sf)
    model = modeling.train_model(samples, "linear", PLAIN)
    predicted = modeling.predict(model, samples, None)
    # two ways of solving differ by about 1e-7
    return predicted.select("event_id", "split", settled_column("predicted", 2))


def train_and_evaluate(spark: SparkSession, sf: str) -> DataFrame:
    """The whole chain from readings to test metrics."""
    _, found, _ = training.train_and_evaluate(
        readings(spark, sf), "linear", PLAIN, 24, "voltage", ["voltage"], **AXIS
    )
    return found.select("rows", "skipped", *[settled_column(m, 3) for m in METRICS])


def comparison_saved(spark: SparkSession, sf: str) -> DataFrame:
    """A comparison of models, saved and read again."""
    board = modeling.leaderboard(_voltage_samples(spark, sf), ["linear"], {"linear": PLAIN})
    path = sinks.save_comparison(board, shared_folder(spark))
    found = spark.read.schema(board.schema).json(path)
    return found.select("model", "rows", "skipped", *[settled_column(m, 3) for m in METRICS])


def model_registry(spark: SparkSession, sf: str) -> DataFrame:
    """Test rows with whether the best registered model gives them what the lowest loss gave before saving."""
    samples, base = _voltage_samples(spark, sf), shared_folder(spark)
    names = ["linear", "forest"]
    entries = modeling.train_and_register(samples, base, "first", names, {"linear": PLAIN})
    sinks.register_model(
        spark, base, "second", "linear", modeling.train_model(samples, "linear", PLAIN), -1.0
    )
    name, loaded = sinks.load_best_model(spark, base, "first")
    lowest = entries.orderBy("loss").first()["model"]
    before = modeling.predict(
        modeling.train_model(samples, lowest, PLAIN if lowest == "linear" else None), samples
    )
    after = modeling.predict(loaded, samples)
    both = before.select("event_id", "predicted").join(
        after.select("event_id", F.col("predicted").alias("again")), "event_id"
    )
    near = F.abs(F.col("predicted") - F.col("again")) < 1e-6
    same = F.when(F.col("predicted").isNull(), F.col("again").isNull()).otherwise(near)
    return both.select(
        "event_id", (same & F.lit(name == lowest)).alias("same"),
        F.lit(entries.count()).cast("bigint").alias("models"),
    )


def history_saved(spark: SparkSession, sf: str) -> DataFrame:
    """History of a forest, saved and read again; its last step is the error of the whole forest."""
    samples = _voltage_samples(spark, sf)
    model = modeling.train_model(samples, "forest")
    history = modeling.training_history(model, samples, "forest")
    found = spark.read.schema(history.schema).json(
        sinks.export_training_history(history, shared_folder(spark))
    )
    whole = reduce(
        DataFrame.unionByName,
        [
            modeling.evaluate(model, samples, s).select(F.lit(s).alias("split"), F.col("mse").alias("whole"))
            for s in ("train", "val")
        ],
    )
    last = F.max_by("value", "step")
    steps = found.groupBy("model", "split").agg(F.count("*").alias("steps"), last.alias("last"))
    near = F.abs(F.col("last") - F.col("whole")) < 1e-6 * F.col("whole")
    return steps.join(whole, "split").select("model", "split", "steps", near.alias("last_is_whole"))


QUERIES = {
    "sequences": sequence_windows,
    "sequences_whole": sequence_windows_whole,
    "chronological_split": _split(),
    "chronological_split_cut": _split(max_series_rows=100),
    "chronological_split_whole": _split(series_by=(), max_series_rows=500),
    "pooled_window_features": pooled_window_features,
    "regression_metrics": regression_metrics,
    "regression_metrics_per_line": regression_metrics_per_line,
    "penalised_loss": penalised_loss,
    "train_predict": train_predict,
    "train_predict_linear": train_predict_linear,
    "train_and_evaluate": train_and_evaluate,
    "comparison_saved": comparison_saved,
    "model_registry": model_registry,
    "history_saved": history_saved,
    "training_history": training_history,
    "hyperparameter_search": hyperparameter_search,
    "model_leaderboard": model_leaderboard,
}


def _sequence_sql(over: str) -> str:
    w = f"({over} ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)"
    return f"""WITH {READINGS}, s AS (SELECT event_id, voltage,
        list(event_id) OVER {w} AS l, sum(voltage) OVER {w} AS v, count(*) OVER {w} AS n
        FROM readings)
      SELECT event_id, array_to_string(l, ',') AS rows,
        round(coalesce(v, 0), 4) AS voltage_sum, round(voltage, 6) AS target
      FROM s WHERE n = 24"""


def _split_sql(over: str, part: str) -> str:
    return f"""WITH {READINGS}, s AS (SELECT event_id, ts, id_line,
        row_number() OVER ({LINE}) AS r FROM readings),
      n AS (SELECT event_id, row_number() OVER ({over}) - 1 AS i, count(*) OVER ({part}) AS n
            FROM s WHERE r > 24)
      SELECT event_id, CASE WHEN i < floor(CAST(0.8 AS DOUBLE) * n) THEN 'train'
        WHEN i < floor(CAST(0.8 AS DOUBLE) * n) + floor(CAST(0.1 AS DOUBLE) * n) THEN 'val'
        ELSE 'test' END AS split FROM n"""


def _pooled_sql() -> str:
    w = f"({LINE} ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)"
    sql = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}
    made = ", ".join(
        f"{settled(f'{f}({c}) OVER {w}')} AS {c}_{p}" for c in MEASURES for p, f in sql.items()
    )
    return f"""WITH {READINGS} SELECT * EXCLUDE (n) FROM (
      SELECT event_id, {made}, count(*) OVER {w} AS n FROM readings) WHERE n = 24"""


def _metrics_sql(y: str, low: float, high: float, weight: float, by: str) -> str:
    key = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    penalty = f"avg(greatest(0, {low} - p) + greatest(0, p - {high})) FILTER (p IS NOT NULL)"
    return f"""WITH {READINGS}, naive AS (
        SELECT id_line, {y} AS a, lag({y}) OVER ({LINE}) AS b FROM readings),
      k AS (SELECT id_line, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a END AS y,
              CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN b END AS p FROM naive)
      SELECT {key}count(y) AS rows, count(*) - count(y) AS skipped,
        {settled("avg(abs(y - p))")} AS mae, {settled("avg((y - p) * (y - p))")} AS mse,
        {settled("sqrt(avg((y - p) * (y - p)))")} AS rmse,
        {settled("avg(abs((y - p) / nullif(y, 0))) * 100")} AS mape,
        {settled("1 - sum((y - p) * (y - p)) / nullif(var_pop(y) * count(y), 0)")} AS r2,
        {settled(f"avg((y - p) * (y - p)) + CAST({weight} AS DOUBLE) * {penalty}")}
          AS penalised_loss
      FROM k {group}"""


def _least_squares_sql() -> str:
    """``fitted``: samples with the prediction of least squares, found by making features orthogonal one by one."""
    w = f"({LINE} ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)"
    names = ["f0", "f1", "f2", "f3"]
    made = ", ".join(
        f"{f}(voltage) OVER {w} AS {n}" for f, n in zip(("avg", "stddev_samp", "min", "max"), names)
    )
    fits = "split = 'train' AND y IS NOT NULL AND f0 IS NOT NULL AND f1 IS NOT NULL"
    share = "floor(CAST(0.8 AS DOUBLE) * n)"
    steps = [
        f"""WITH {READINGS}, s AS (SELECT event_id, ts, id_line, voltage AS y, {made},
          row_number() OVER ({LINE}) AS r FROM readings),
        i AS (SELECT *, row_number() OVER ({LINE}) - 1 AS i, count(*) OVER (PARTITION BY id_line) AS n
              FROM s WHERE r > 24),
        p AS (SELECT *, CASE WHEN i < {share} THEN 'train'
                WHEN i < {share} + floor(CAST(0.1 AS DOUBLE) * n) THEN 'val' ELSE 'test' END AS split FROM i),
        g0 AS (SELECT event_id, split, y, ({fits}) AS fit, avg(y) FILTER ({fits}) OVER () AS predicted, """
        + ", ".join(f"{n} - avg({n}) FILTER ({fits}) OVER () AS {n}" for n in names)
        + " FROM p)"
    ]
    for k, now in enumerate(names):
        square = f"sum({now} * {now}) FILTER (fit) OVER ()"
        later = "".join(
            f", {n} - {now} * sum({now} * {n}) FILTER (fit) OVER () / {square} AS {n}" for n in names[k + 1 :]
        )
        steps.append(
            f"""g{k + 1} AS (SELECT event_id, split, y, fit,
            predicted + {now} * sum({now} * y) FILTER (fit) OVER () / {square} AS predicted{later} FROM g{k})"""
        )
    return ", ".join([*steps, "fitted AS (SELECT * FROM g4)"])


def _fitted_metrics_sql(more: str = "") -> str:
    both = "y IS NOT NULL AND p IS NOT NULL"
    low = "avg(greatest(0, 180 - p) + greatest(0, p - 260)) FILTER (p IS NOT NULL)"
    return f"""{_least_squares_sql()}, k AS (SELECT CASE WHEN {both} THEN y END AS y, CASE WHEN {both} THEN p END AS p
        FROM (SELECT y, predicted AS p FROM fitted WHERE split = 'test'))
      SELECT {more}count(y) AS rows, count(*) - count(y) AS skipped,
        {settled("avg(abs(y - p))", 3)} AS mae, {settled("avg((y - p) * (y - p))", 3)} AS mse,
        {settled("sqrt(avg((y - p) * (y - p)))", 3)} AS rmse,
        {settled("avg(abs((y - p) / nullif(y, 0))) * 100", 3)} AS mape,
        {settled("1 - sum((y - p) * (y - p)) / nullif(var_pop(y) * count(y), 0)", 3)} AS r2,
        {settled(f"avg((y - p) * (y - p)) + CAST(0.1 AS DOUBLE) * {low}", 3)} AS penalised_loss FROM k"""


ORACLE = {
    "train_predict_linear": f"""{_least_squares_sql()}
      SELECT event_id, split, {settled("predicted", 2)} AS predicted FROM fitted""",
    "train_and_evaluate": _fitted_metrics_sql(),
    "comparison_saved": _fitted_metrics_sql("'linear' AS model, "),
    "model_registry": f"""{_least_squares_sql()}
      SELECT event_id, true AS same, CAST(2 AS BIGINT) AS models FROM fitted WHERE split = 'test'""",
    "history_saved": """SELECT 'forest' AS model, unnest(['train', 'val']) AS split,
      CAST(20 AS BIGINT) AS steps, true AS last_is_whole""",
    "sequences": _sequence_sql(LINE),
    "sequences_whole": _sequence_sql(WHOLE),
    "chronological_split": _split_sql(LINE, "PARTITION BY id_line"),
    "chronological_split_cut": _split_sql(LINE, "PARTITION BY id_line"),
    "chronological_split_whole": _split_sql(WHOLE, ""),
    "pooled_window_features": _pooled_sql(),
    "regression_metrics": _metrics_sql("voltage", 180, 260, 0.1, ""),
    "regression_metrics_per_line": _metrics_sql("current", 0, 40, 0.5, "id_line"),
    "penalised_loss": f"""SELECT id_line, penalised_loss
      FROM ({_metrics_sql("voltage", 202, 210, 0.1, "id_line")})""",
}
