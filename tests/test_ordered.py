"""Carried values and running sums over many chunks and many blocks of chunks."""

import random

import pytest
from pyspark.sql import functions as F

from tsprep.operators import ordered


@pytest.mark.parametrize("series_by", [(), ("s",)])
@pytest.mark.parametrize("per_block", [1, 2, 3, 4_096])
def test_scans_in_blocks(spark, monkeypatch, series_by, per_block):
    """Three rows a chunk, so that gaps and sums reach over several blocks."""
    monkeypatch.setattr(ordered, "BLOCK_CHUNKS", per_block)
    rng = random.Random(per_block)
    rows = [
        (rng.choice(["a", "a", "a", None]), i, rng.randint(1, 9) if rng.random() < 0.1 else None, rng.randint(0, 5))
        for i in range(90)
    ]
    df = spark.createDataFrame(rows, "s string, i int, v int, w int")
    split = ordered.Split(True, 3)
    placed = ordered.positioned(df, series_by, ("i",), split)
    carried = ordered.carry(placed, {"last": F.col("v")}, {"next": F.col("v")}, series_by, ("i",), split)
    summed = ordered.running_sum(df, {"upto": "w"}, series_by, ("i",), split)
    got = {r["i"]: (r["last"], r["next"]) for r in carried.collect()}
    sums = {r["i"]: r["upto"] for r in summed.collect()}
    assert len(got) == len(sums) == 90
    for s, i, _, _ in rows:
        same = [r for r in rows if not series_by or r[0] == s]
        before = [r[2] for r in same if r[1] <= i and r[2] is not None]
        after = [r[2] for r in same if r[1] >= i and r[2] is not None]
        assert got[i] == (before[-1] if before else None, after[0] if after else None)
        assert sums[i] == sum(r[3] for r in same if r[1] <= i)


def test_empty_table(spark):
    df = spark.createDataFrame([], "s string, i int, v int")
    split = ordered.Split(True, 3)
    placed = ordered.positioned(df, (), ("i",), split)
    assert ordered.carry(placed, {"last": F.col("v")}, {}, (), ("i",), split).collect() == []
    assert ordered.running_sum(df, {"upto": "v"}, (), ("i",), split).collect() == []


def test_positions_meet_their_rows_without_a_shuffle(spark):
    """The starts of the ranges are files of a known size, so the rows stay where they are."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "40000")
    try:
        df = spark.range(200_000).selectExpr("id % 3 AS s", "id AS i", "cast(hash(id) AS string) AS v")
        numbered = ordered.number_rows(df, ("s",), ("i",))
        plan = numbered._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
        assert numbered.filter(f"{ordered.SEQ} <> floor(i / 3)").count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
