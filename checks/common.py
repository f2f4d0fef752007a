"""SQL text and rounding shared by the checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

READINGS = """readings AS (
  SELECT event_id, ts,
         concat('LINE_', lpad(CAST(user_id % 20 AS VARCHAR), 3, '0')) AS id_line,
         CASE WHEN event_id % 20 <> 7 THEN 200 + value * CAST(0.25 AS DOUBLE) END AS voltage,
         CASE WHEN event_id % 25 <> 3 THEN value END AS current,
         CASE WHEN event_id % 30 <> 11
              THEN (200 + value * CAST(0.25 AS DOUBLE)) * value * CAST(0.95 AS DOUBLE) END AS power,
         CASE WHEN event_id % 40 <> 5 THEN event_type END AS status
  FROM events)"""

# order of the rows of one line, and of the whole table
LINE = "PARTITION BY id_line ORDER BY ts, event_id"
WHOLE = "ORDER BY ts, event_id"

# Means of two-decimal values often end exactly half-way between two rounded values, where
# the last bit of a sum decides. A small shift moves them off the half on both sides.
OFF_HALF = "1.234e-7"


def settled(sql: str, digits: int = 4) -> str:
    return f"(round({sql} + CAST({OFF_HALF} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE))"


def settled_column(name: str, digits: int = 4) -> Column:
    return (F.round(F.col(name) + F.lit(float(OFF_HALF)), digits) + F.lit(0.0)).alias(name)
