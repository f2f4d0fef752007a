import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tsprep.session import get_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf():
    return SF


def line(spark, values, name="a", start=0, column="x"):
    """One line with a value per hour; None stays NULL."""
    rows = [(name, start + i, None if v is None else float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"id_line string, hour int, {column} double")
    return df.selectExpr(
        "id_line",
        "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, hour) AS timestamp",
        column,
        "hour",
    )


def series(df, column="x", order=("id_line", "timestamp")):
    return [r[column] for r in df.orderBy(*order).collect()]
