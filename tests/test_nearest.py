"""Neighbour search against brute force, on one task's curves and on cut ones, and its growth."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tsprep.operators import nearest as N


def by_hand(queries, donors, k):
    out = {}
    for q, g, *at in queries:
        rows = [(float(np.sqrt(sum((a - b) ** 2 for a, b in zip(at, d[2:])))), d[0]) for d in donors if d[1] == g]
        out[q] = sorted(rows)[:k]
    return out


def points(n, dims, seed):
    """A third in one spot, a third in a dense cluster, the rest spread out; ties and copies."""
    rng = np.random.default_rng(seed)
    spread = rng.integers(-50, 50, (n, dims)).astype(float)
    spread[: n // 3] = 7.0
    spread[n // 3 : 2 * n // 3] = 20 + rng.integers(0, 30, (2 * n // 3 - n // 3, dims)) / 1024
    return [(i, i % 2, *map(float, x)) for i, x in enumerate(spread)]


def frame(spark, rows, dims):
    return spark.createDataFrame(rows, "id long, g int, " + ", ".join(f"c{i} double" for i in range(dims)))


@pytest.mark.parametrize("dims", [1, 2, 3])
@pytest.mark.parametrize("rows_of_a_curve", [100_000, 40])
def test_like_brute_force(spark, monkeypatch, dims, rows_of_a_curve):
    monkeypatch.setattr(N, "_CURVE_ROWS", rows_of_a_curve)
    monkeypatch.setattr(N, "FAN", 4)
    donors, queries = points(300, dims, 1), points(60, dims, 2)
    coords = [f"c{i}" for i in range(dims)]
    found = N.nearest(
        frame(spark, queries, dims), frame(spark, donors, dims), coords, 4, "id", F.col("id"), "g"
    )
    got = {r["id"]: [(n["distance"], n["key"]) for n in r["neighbours"]] for r in found.collect()}
    assert got == by_hand(queries, donors, 4)
    alone = N.nearest(None, frame(spark, donors, dims), coords, 3, "id", F.col("id"), "g")
    mine = {tuple(r[c] for c in ["g", *coords]): [(n["distance"], n["key"]) for n in r["neighbours"]] for r in alone.collect()}
    wanted = by_hand(donors, donors, 3)
    assert mine == {tuple(d[1:]): wanted[d[0]] for d in donors}


def test_fewer_donors_than_wanted(spark):
    donors = frame(spark, [(1, 0, 0.0, 0.0), (2, 0, 5.0, 5.0)], 2)
    queries = frame(spark, [(9, 0, 1.0, 1.0), (8, 1, 1.0, 1.0)], 2)
    got = {r["id"]: r["neighbours"] for r in N.nearest(queries, donors, ["c0", "c1"], 5, "id", F.col("id"), "g").collect()}
    assert [n["key"] for n in got[9]] == [1, 2] and got[8] is None
    none = N.nearest(queries, donors.limit(0), ["c0", "c1"], 5, "id", F.col("id"), "g")
    assert all(r["neighbours"] is None for r in none.collect())


def test_leaves_per_place_stay_flat(spark, monkeypatch):
    """16 times the points, half of them in clusters a millionth as wide: the same number of leaves a place."""
    seen = []
    descend = N._descend
    monkeypatch.setattr(N, "_descend", lambda *a: seen.append(descend(*a)) or seen[-1])
    monkeypatch.setattr(N, "_CURVE_ROWS", 2_000)
    mean = []
    for n in (3_000, 48_000):
        rng = np.random.default_rng(n)
        at = rng.random((n, 2))
        at[: n // 2] = 0.3 + rng.integers(0, 3, (n // 2, 1)) * 0.2 + rng.random((n // 2, 2)) * 1e-6
        df = spark.createDataFrame([(i, 0, *map(float, x)) for i, x in enumerate(at)], "id long, g int, c0 double, c1 double")
        N.nearest(None, df, ["c0", "c1"], 6, "id", F.col("id"))
        mean.append(seen[-1].count() / n)
    assert mean[0] < 12 and mean[1] < 1.5 * mean[0]
