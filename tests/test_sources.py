import datetime as dt

import pytest
from pyspark.errors import AnalysisException

from tsprep.operators import quality, scale
from tsprep.plans.prepare import compare_mean_filled, prepare
from tsprep.sources import codepages, delimited, sinks
from tsprep.sources.telemetry import sample_telemetry


def _write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_formats_are_detected_per_file(spark, tmp_path):
    _write(tmp_path / "a.csv", "n;v\nJürgen;1\nNaN;2\n", "iso-8859-1")
    _write(tmp_path / "b.csv", "n,v\nZoë,NA\nx y,4\n")
    _write(tmp_path / "c.csv", "﻿n|v\nplain|5.5\n")
    found = delimited.detect_format(spark, str(tmp_path)).collect()
    got = {r.path.rsplit("/", 1)[1]: (r.encoding, r.delimiter) for r in found}
    assert got == {
        "a.csv": ("ISO-8859-1", ";"), "b.csv": ("UTF-8", ","), "c.csv": ("UTF-8", "|"),
    }
    rows = delimited.load_csv(spark, str(tmp_path)).collect()
    assert {(r.n, r.v) for r in rows} == {
        ("Jürgen", 1.0), (None, 2.0), ("Zoë", None), ("x y", 4.0), ("plain", 5.5),
    }


WORDS = {
    "windows-1252": ["tensión", "año", "Müller – „größer“", "élève déjà"],
    "ISO-8859-1": ["tensión", "año", "Müller größer", "élève déjà"],
    "windows-1251": ["напряжение", "ток", "Линия №5 «Север»", "МОСКВА и область"],
    "windows-1253": ["τάση", "ρεύμα", "Καλημέρα κόσμε", "γραμμή"],
    "KOI8-R": ["напряжение", "ток", "Привет, мир", "линия"],
    "Shift_JIS": ["電圧", "電流", "これは日本語です", "ソース表"],
    "EUC-JP": ["電圧", "電流", "これは日本語です", "ライン"],
    "GB18030": ["电压", "电流", "这是中文文本", "线路一"],
    "EUC-KR": ["전압", "전류", "한국어 텍스트", "라인"],
    "Big5": ["電壓", "電流", "這是中文文本", "線路"],
    "UTF-8": ["напряжение", "電流", "Müller", "線路"],
}


def test_code_pages(spark, tmp_path):
    """Names and texts come out right whatever the file was written in."""
    for page, (a, b, *texts) in WORDS.items():
        (tmp_path / page).mkdir()
        rows = "\n".join(f'"{t}; x";{i}' for i, t in enumerate(texts))
        _write(tmp_path / page / "f.csv", f"{a};{b}\n{rows}\nplain;9\n", page)
    found = delimited.detect_format(spark, [str(tmp_path / p) for p in WORDS]).collect()
    assert {r.path.rsplit("/", 2)[1]: (r.encoding, r.delimiter) for r in found} == {p: (p, ";") for p in WORDS}
    for page, (a, b, *texts) in WORDS.items():
        df = delimited.load_csv(spark, str(tmp_path / page))
        assert df.columns == [a, b]
        assert {tuple(r) for r in df.collect()} == {("plain", 9), *((f"{t}; x", i) for i, t in enumerate(texts))}


def test_separators_inside_quotes(spark, tmp_path):
    """The first lines decide by their fields outside quotes, after decoding."""
    cases = {
        "a": ('"volts, low, high, peak";amps\n"1,5";2\n', "utf-8", ";", ["volts, low, high, peak", "amps"]),
        "b": ("tensión;año;línea\n1;2;3\n", "iso-8859-1", ";", ["tensión", "año", "línea"]),
        "c": ("a, b|c;d|e\n1|2|3\n", "utf-16", "|", ["a, b", "c;d", "e"]),
        "d": ("only\n1,5\n", "utf-8", ",", ["only"]),
        "e": ("x;y,z\n1;2,5\n3;4\n", "utf-8", ";", ["x", "y,z"]),
    }
    for name, (text, encoding, delimiter, columns) in cases.items():
        path = _write(tmp_path / f"{name}.csv", text, encoding)
        assert delimited.detect_format(spark, path).first().delimiter == delimiter, name
        assert delimited.load_csv(spark, path).columns == columns, name


def test_fields_are_counted_outside_quotes():
    text = 'a,b\n"x, ""y"", z",1\n"over\ntwo lines",2\n5" pipe,3\n"cut off'
    assert codepages.field_counts(text, ",") == [2, 2, 2, 2]
    assert codepages.field_counts("", ",") == [] and codepages.choose_delimiter("") == ","
    assert codepages.field_counts('"one, not closed', ",") == [1]


def test_types_and_missing_tokens(spark, tmp_path):
    path = _write(
        tmp_path / "t.csv",
        "i,d,b,s,empty,big,when\n1,1.5,true,x,,9223372036854775808,2024-01-02 03:04:05\n"
        "n/a,1e3,False,null,NA,1,bad\n",
    )
    df = delimited.load_csv(spark, path, parse_dates=["when"])
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    assert kinds == {
        "i": "bigint", "d": "double", "b": "boolean", "s": "string", "empty": "double",
        "big": "double", "when": "timestamp_ntz",
    }
    first, second = df.collect()
    assert first.when == dt.datetime(2024, 1, 2, 3, 4, 5)
    assert (second.i, second.s, second.empty, second.when) == (None, None, None, None)
    declared = delimited.load_csv(spark, path, "UTF-8", ",", "i int, s string")
    assert declared.columns == ["i", "s"] and declared.first().i == 1


def test_missing_file(spark, tmp_path):
    with pytest.raises(AnalysisException):
        delimited.load_csv(spark, str(tmp_path / "nothing.csv"))


def test_saving_never_overwrites(spark, tmp_path):
    df = spark.range(3)
    path = sinks.save_processed_data(df, "x", str(tmp_path), "parquet")
    assert spark.read.parquet(path).count() == 3
    parted = sinks.save_processed_data(
        df.selectExpr("id", "id % 2 AS p"), "y", str(tmp_path), "csv", ["p"]
    )
    assert spark.read.csv(parted, header=True).columns == ["id", "p"]


def test_scalers_and_reports_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 9.0)], "a double, b double")
    fitted = scale.fit_scalers(df, {"a": "standard", "b": "minmax"})
    paths = sinks.save_scalers(fitted, str(tmp_path / "s"))
    assert set(paths) == {"a", "b"}
    again = scale.apply_scalers(df, sinks.load_scalers(spark, str(tmp_path / "s")))
    assert {(r.a_scaled, r.b_scaled) for r in again.collect()} == {(-1.0, 0.0), (1.0, 1.0)}
    results = quality.validate_missing_values(df)
    path = sinks.export_validation_report(results, str(tmp_path), "parquet")
    assert spark.read.parquet(path).count() == 2
    assert spark.read.json(sinks.save_profile(results, str(tmp_path))).count() == 2


def test_sample_telemetry(spark):
    df = sample_telemetry(spark, 500, 3)
    assert df.count() == 1500 and df.select("id_line").distinct().count() == 3
    lost = df.filter("voltage IS NULL")
    assert 0.02 < lost.count() / 1500 < 0.09 and lost.filter("power IS NOT NULL").count() == 0
    assert sample_telemetry(spark, 500, 3).exceptAll(df).count() == 0
    assert quality.validate_time_continuity(df).first().is_valid


def test_prepare_steps_are_optional(spark):
    df = sample_telemetry(spark, 200, 2)
    config = {
        "missing_values": {
            "voltage": {"strategy": "interpolate", "method": "time", "limit": 24},
            "power": {"strategy": "forward_fill", "limit": 12},
        }
    }
    done, report = prepare(df, config, window_sizes=[6], functions=["mean"])
    steps = {r.step: r["count"] for r in report.collect()}
    assert set(steps) == {"missing", "anomalies", "features"}
    assert done.count() == 400 - steps["anomalies"] and "hour_sin" in done.columns
    plain, report = prepare(df, config, False, False, False)
    assert plain.columns == df.columns and report.count() == 0
    cut, _ = prepare(df, config, window_sizes=[6], functions=["mean"], max_series_rows=50)
    assert cut.exceptAll(done).count() == 0 and cut.count() == done.count()
    compared = compare_mean_filled(df, "voltage", minimal=True)
    gaps = compared.filter("`column` = 'voltage' AND statistic = 'missing'").first()
    assert gaps.value_Original > 0 and gaps.value_Modified == 0


def test_csv_files_with_other_column_orders_and_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y.z\n1,2\n3,4\n")
    (tmp_path / "b.csv").write_text("y.z,x\n20,10\n")
    (tmp_path / "c.csv").write_text('x,y.z\n5,"a ""b"", c\nd"\n')
    got = delimited.load_csv(spark, f"{tmp_path}/*.csv").collect()
    assert {tuple(r) for r in got} == {(1, "2"), (3, "4"), (10, "20"), (5, 'a "b", c\nd')}
    got = delimited.load_csv(spark, f"{tmp_path}/a.csv", header=False, multiLine=True).collect()
    assert len(got) == 3


def test_default_strategies_on_five_columns(spark):
    df = sample_telemetry(spark, 120, 2)
    config = {"missing_values": {"current": {"strategy": "model_impute", "method": "knn"}}}
    done, _ = prepare(df, config, detect_anomalies=False, add_features=False)
    assert done.count() == 240 and done.where("current IS NULL").count() == 0
