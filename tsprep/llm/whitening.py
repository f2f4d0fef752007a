"""Whitening of embeddings: rows are reduced to one triangle, whose singular vectors whiten them.

Blocks of centred rows are reduced by QR inside the tasks, the triangles are reduced by QR again in a
tree until a handful is left, and the last one goes through :mod:`tsprep.llm.bidiagonal`. Nothing
but numbers whose count depends on the dimensions reaches the driver.
"""

from __future__ import annotations

import decimal
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsprep.llm.bidiagonal import right_singular
from tsprep.llm.common import column
from tsprep.session import keep

#: Fixed values of the grid on which entries are counted: ``floor(64 * entry) + 1000000``.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Entries beyond this have no exact place on the grid in double precision.
LARGEST = 2.0**44
#: Directions that vary less than this, against the first, count as not varying at all.
FLAT = 1e-11
#: Bytes of triangles that one task or the driver reduces at once.
TRIANGLES = 64 * 2**20


class Moments(NamedTuple):
    """Number of rows, and the exact sum of every dimension."""

    n: int
    sums: list[int]


class Whitening(NamedTuple):
    """Directions as columns, their variances (falling) and the variance of all."""

    moments: Moments
    directions: np.ndarray
    variances: np.ndarray
    total: float


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """``vec_id, v`` of the rows that take part, and their number of dimensions."""
    v = column(vector_col).cast("array<double>")
    rows = vectors.select(column(id_col).alias("vec_id"), v.alias("v"))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", _finite))
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"))
    most = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    d = most["d"] if most else 0
    return rows.where(F.size("v") == d), d


def _grid(batch: pa.RecordBatch, d: int) -> np.ndarray:
    values = batch.column(batch.schema.get_field_index("v")).flatten().to_numpy(zero_copy_only=False)
    return np.floor(SCALE * values.reshape(-1, d)).astype(np.int64) + SHIFT


def _centred(x: np.ndarray, moments: Moments) -> np.ndarray:
    """``n * x - sums``, exact: in 64 bits if they suffice, else in Python's integers."""
    if moments.n * (int(np.abs(x).max(initial=0)) + 1) < 2**61:
        return moments.n * x - np.array(moments.sums, np.int64)
    return moments.n * x.astype(object) - np.array(moments.sums, object)


def fit_moments(rows: DataFrame, d: int) -> Moments:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(d, object)
        for batch in batches:
            x = _grid(batch, d)
            for start in range(0, len(x), 8192):  # 8192 entries below 2**51 cannot overflow
                sums += x[start : start + 8192].sum(axis=0)
            n += len(x)
        parts = {
            "dim": pa.array(range(d), pa.int32()),
            "n": pa.array([n] * d, pa.int64()),
            "s": pa.array([decimal.Decimal(int(s)) for s in sums], pa.decimal128(38, 0)),
        }
        yield pa.RecordBatch.from_pydict(parts)

    parts = rows.select("v").mapInArrow(run, "dim int, n bigint, s decimal(38, 0)")
    found = parts.groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("dim").collect()
    return Moments(found[0]["n"] if found else 0, [int(r["s"]) for r in found])


def triangle(rows: DataFrame, moments: Moments) -> np.ndarray:
    """R of the QR factorisation of all centred rows."""
    d = len(moments.sums)

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for batch in batches:
            block = _centred(_grid(batch, d), moments).astype(float) / moments.n
            r = np.linalg.qr(np.vstack([r, block]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_pydict({"r": pa.array([r.tobytes()], pa.binary())})

    def reduce_triangles(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"r": [_merge(group["r"], d).tobytes()]})

    several = max(2, min(64, TRIANGLES // (8 * d * d)))
    level = keep(rows.select("v").mapInArrow(reduce_rows, "r binary"))
    left = level.count()
    while left > several:
        group = F.pmod(F.xxhash64("r"), F.lit(-(-left // several)))
        level = keep(level.groupBy(group.alias("g")).applyInPandas(reduce_triangles, "r binary"))
        left = level.count()
    return _merge([row["r"] for row in level.collect()], d)


def _merge(parts: list[bytes] | pd.Series, d: int) -> np.ndarray:
    stacked = np.vstack([np.frombuffer(p).reshape(-1, d) for p in parts] or [np.zeros((0, d))])
    r = np.linalg.qr(np.vstack([stacked, np.zeros((max(0, d - len(stacked)), d))]), mode="r")
    return r


def fit_whitening(rows: DataFrame, d: int) -> Whitening:
    """Directions in which the rows vary, on the grid, by falling variance (divisor n)."""
    moments = fit_moments(rows, d)
    values, directions = right_singular(triangle(rows, moments))
    # either sign is right; the entry of largest size is made positive, so that refits agree
    lead = np.take_along_axis(directions, np.abs(directions).argmax(axis=0)[None], axis=0)
    directions = directions * np.where(lead < 0, -1.0, 1.0)
    variances = values / moments.n
    return Whitening(moments, directions, variances, float(variances.sum()))


def _factors(fit: Whitening, components: int) -> tuple[np.ndarray, int]:
    """Matrix from centred rows to whitened ones; directions without variance are left out."""
    e = fit.variances[:components]
    live = int((e > FLAT**2 * e[0]).sum()) if len(e) and e[0] > 0 else 0
    return fit.directions[:, :live] / np.sqrt(e[:live]), live


def identity_error(rows: DataFrame, fit: Whitening, components: int = COMPONENTS) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity."""
    d, (factors, live) = len(fit.moments.sums), _factors(fit, components)
    if not live:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products = np.zeros((live + 1, live))
        for batch in batches:
            z = _centred(_grid(batch, d), fit.moments).astype(float) / fit.moments.n @ factors
            products += np.vstack([z.T @ z, z.sum(axis=0)])
        at = pa.array(range(products.size), pa.int32())
        yield pa.RecordBatch.from_pydict({"at": at, "s": pa.array(products.ravel())})

    sums = rows.select("v").mapInArrow(run, "at int, s double").groupBy("at").agg(F.sum("s").alias("s"))
    flat = [r["s"] for r in sums.orderBy("at").collect()]
    sums = np.array(flat).reshape(live + 1, live) / fit.moments.n
    return float(np.abs(sums[:live] - np.outer(sums[live], sums[live]) - np.eye(live)).max())


def whitener(fit: Whitening, error: float, components: int) -> Callable:
    d, (factors, live) = len(fit.moments.sums), _factors(fit, components)
    k = min(components, d)
    explained = fit.variances[:k] / fit.total if fit.total > 0 else np.zeros(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            exact = _centred(_grid(batch, d), fit.moments)
            z = np.full((len(exact), k), np.nan)
            z[:, :live] = exact.astype(float) / fit.moments.n @ factors
            if int(np.abs(exact).max(initial=0)) ** 2 * d < 2**63:
                deviation = pa.array((exact * exact).sum(axis=1).astype(np.int64), pa.int64())
            else:
                whole = (sum(int(x) ** 2 for x in row) for row in exact)
                deviation = pa.array([w if w < 2**63 else None for w in whole], pa.int64())
            here = len(exact)
            each = pa.array(np.repeat(np.arange(here), k))
            yield pa.RecordBatch.from_pydict(
                {
                    "vec_id": batch.column(batch.schema.get_field_index("vec_id")).take(each),
                    "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), here)),
                    "n": pa.array(np.full(here * k, fit.moments.n, np.int64)),
                    "deviation": deviation.take(each),
                    "whitened": pa.array(z.ravel(), from_pandas=True),
                    "explained": pa.array(np.tile(explained, here)),
                    "identity_error": pa.array(np.full(here * k, error)),
                }
            )

    return run


def whiten(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    components: int = COMPONENTS,
) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` a row and component.

    Entries are first put on the grid. Left out are vectors that are NULL or empty, hold a NULL, a
    NaN, an infinity or an entry of ``LARGEST`` or more, and vectors of another length than the most
    frequent one (of equally frequent ones the longest). Ids are passed through: NULL and repeated
    ids are rows like any other, and repeated vectors count each time. A direction in which nothing
    varies has NULL for ``whitened``. ``deviation`` is exact, and NULL where 64 bits do not hold it.
    No usable vector, no row. Of equal variances the directions are any orthogonal ones.
    """
    rows, d = usable(vectors, id_col, vector_col)
    kind = rows.schema["vec_id"].dataType.simpleString()
    shape = (
        f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, "
        "explained double, identity_error double"
    )
    if d == 0:
        return vectors.sparkSession.createDataFrame([], shape)
    fit = fit_whitening(rows, d)
    error = identity_error(rows, fit, components)
    return rows.mapInArrow(whitener(fit, error, components), shape)
