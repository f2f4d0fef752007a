"""Singular values, whitening against an eigendecomposition, exact deviations and odd vectors."""

import numpy as np
import pytest

from tsprep.llm import queries, whitening
from tsprep.llm.bidiagonal import bidiagonalise, right_singular, squared_singular_values
from tsprep.llm.whitening import COMPONENTS, usable, whiten

RNG = np.random.default_rng(8)
SCHEMA = "vec_id bigint, embedding array<float>, component string, v int"


def orthogonal(n):
    return np.linalg.qr(RNG.normal(size=(n, n)))[0]


CASES = {
    "random": RNG.normal(size=(64, 64)),
    "graded": RNG.normal(size=(64, 40)) * np.logspace(0, -9, 40),
    "low rank": RNG.normal(size=(30, 4)) @ RNG.normal(size=(4, 20)),
    "zero columns": np.hstack([RNG.normal(size=(30, 5)), np.zeros((30, 3))]),
    "equal": 3 * orthogonal(17),
    "clusters": np.diag(np.repeat([5.0, 3.0, 1.0], 8)) @ orthogonal(24),
    "near": np.diag(1 + 1e-9 * np.arange(24)) @ orthogonal(24),
    "zero": np.zeros((5, 5)),
    "one": np.full((3, 1), 2.0),
}


@pytest.mark.parametrize("name", CASES)
def test_singular_vectors(name):
    r = np.linalg.qr(CASES[name], mode="r")
    values, vectors = right_singular(r)
    wanted = np.linalg.svd(r, compute_uv=False) ** 2
    top = max(wanted[0], 1e-300)
    assert np.abs(values - wanted).max() <= 1e-13 * top
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-9
    assert np.abs(r.T @ (r @ vectors) - vectors * values).max() <= 1e-10 * top


def test_bidiagonal_form():
    r = CASES["random"]
    diag, above, w = bidiagonalise(r)
    b = np.diag(diag) + np.diag(above, 1)
    assert np.allclose(b.T @ b, w.T @ r.T @ r @ w, atol=1e-11)


def test_small_values_keep_their_relative_accuracy():
    """Known singular values over 24 powers of ten: a dense method would lose the small ones."""
    diag = np.logspace(0, -12, 13)
    above = diag[:-1] * 1e-3
    exact = right_singular(np.diag(diag) + np.diag(above, 1))[0]
    assert np.allclose(squared_singular_values(diag, above), exact, rtol=1e-13, atol=0)
    # the product of the squared values is the squared determinant, to relative precision
    assert np.isclose(np.log(exact).sum(), 2 * np.log(diag).sum(), rtol=1e-14)


def by_hand(vectors, components=COMPONENTS):
    x = np.floor(64 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    centred = (n * x - s) / n
    e, w = np.linalg.eigh(centred.T @ centred / n)
    e, w = e[::-1][:components], w[:, ::-1][:, :components]
    return n, ((n * x - s) ** 2).sum(axis=1), centred @ w / np.sqrt(e), e / np.trace(centred.T @ centred / n)


def check(rows, vectors):
    n, deviation, whitened, explained = by_hand(vectors)
    got = {}
    for r in rows:
        got.setdefault(r["component"], []).append(r)
    assert len(got) == whitened.shape[1]
    for c, part in got.items():
        part.sort(key=lambda r: r["vec_id"])
        assert [r["deviation"] for r in part] == deviation.tolist()
        mine, theirs = np.array([r["whitened"] for r in part]), whitened[:, c - 1]
        assert min(np.abs(mine - theirs).max(), np.abs(mine + theirs).max()) < 1e-6
        assert {r["n"] for r in part} == {n}
        assert np.isclose(part[0]["explained"], explained[c - 1], rtol=1e-10)
    assert len({r["identity_error"] for r in rows}) == 1 and rows[0]["identity_error"] < 1e-9


def test_whole_table(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    check(queries.op13_embedding_whitening(spark, sf).collect(), [r["embedding"] for r in table])


def test_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(whitening, "TRIANGLES", 1)  # a tree of many levels
    good = RNG.normal(size=(300, 3)) * [5, 2, 1]
    good[17] = 0
    bad = [None, [], [None, 1.0, 2.0], [1.0, float("nan"), 0.0], [float("inf"), 1.0, 2.0], [1.0, 2.0], [3e30] * 3]
    rows = [(i, v.tolist(), "x", 1) for i, v in enumerate(good)]
    rows += [(1000 + i, v, None, None) for i, v in enumerate(bad)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(20)
    check(whiten(frame).collect(), good)


def test_no_variance_and_repeated_rows(spark):
    rows = [(i % 2, [float(i % 3), 1.0, 7.0], "x", 1) for i in range(9)] + [(None, [0.0, 1.0, 7.0], "x", 1)]
    got = whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 30 and {r["n"] for r in got} == {10}
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in got)
    same = whiten(spark.createDataFrame([(1, [1.0, 2.0], "x", 1)], SCHEMA)).collect()
    assert [(r["deviation"], r["whitened"], r["explained"]) for r in same] == [(0, None, 0.0)] * 2


def test_exact_beyond_64_bits(spark):
    rows = [(i, [i * 1e12, 1.0], "x", 1) for i in range(4)]
    got = whiten(spark.createDataFrame(rows, SCHEMA)).where("component = 1").collect()
    assert got[0]["deviation"] is None and got[0]["whitened"] is not None


def test_empty_tables(spark):
    none = whiten(spark.createDataFrame([], SCHEMA))
    assert none.collect() == [] and none.columns[:2] == ["vec_id", "component"]
    assert usable(spark.createDataFrame([(1, None, "x", 1)], SCHEMA))[1] == 0
    assert whiten(spark.createDataFrame([(1, None, "x", 1)], SCHEMA)).collect() == []
