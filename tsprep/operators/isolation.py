"""Isolation forest: trees grow in parallel on small samples, all rows are scored."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import keep
from .anomaly import flag_top_share

_NODE = "tree int, node int, axis int, cut double, left int, right int, path double"


def average_path(n: float) -> float:
    """Mean depth of an unsuccessful search among ``n`` rows."""
    if n <= 1:
        return 0.0
    harmonic = np.log(n - 1) + np.euler_gamma if n > 2 else 1.0
    return 2 * harmonic - 2 * (n - 1) / n


def _grow(columns: Sequence[str], depth: int, seed: int):
    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        tree = int(rows["tree"].iloc[0])
        rng = np.random.default_rng([seed, tree])
        data = rows.sort_values("place")[list(columns)].to_numpy(float)
        nodes: list[list] = []
        pending = [(data, 0, -1, "left")]
        while pending:
            part, level, parent, side = pending.pop()
            node = len(nodes)
            nodes.append([tree, node, -1, 0.0, -1, -1, 0.0])
            if parent >= 0:
                nodes[parent][4 if side == "left" else 5] = node
            spread = np.flatnonzero(np.ptp(part, axis=0) > 0) if len(part) > 1 else []
            if level >= depth or len(spread) == 0:
                nodes[node][6] = level + average_path(len(part))
                continue
            axis = int(rng.choice(spread))
            cut = float(rng.uniform(part[:, axis].min(), part[:, axis].max()))
            below = part[:, axis] <= cut
            if below.all():
                below = part[:, axis] < part[:, axis].max()
                cut = float(part[below, axis].max())
            nodes[node][2:4] = [axis, cut]
            pending += [(part[~below], level + 1, node, "right"), (part[below], level + 1, node, "left")]
        return pd.DataFrame(nodes, columns=["tree", "node", "axis", "cut", "left", "right", "path"])

    return grow


def grow_forest(
    df: DataFrame,
    columns: Sequence[str],
    key: str,
    trees: int = 100,
    sample_rows: int = 256,
    seed: int = 42,
) -> DataFrame:
    """The forest as one row per node: at most ``trees`` x 2 x ``sample_rows`` rows.

    Which rows a tree sees depends only on hashes of the key, so the result does not change
    with the partitioning. A pool of fixed expected size is drawn in the scan; each tree draws
    about twice ``sample_rows`` of the pool and takes the first of them.
    """
    complete = df.select(key, *[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    total = complete.count()
    if total == 0:
        raise ValueError("no complete rows to grow trees on")
    bucket = 1_000_000_000
    share = min(1.0, 1.5 * trees * sample_rows / total)
    drawn = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(bucket)) < F.lit(int(share * bucket))
    pool_rows = max(1.0, share * total)
    chance = min(1.0, 2 * sample_rows / pool_rows)
    draw = F.xxhash64(key, "tree", F.lit(seed))
    pool = (
        complete.filter(drawn)
        .select(key, *columns, F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
        .withColumn("draw", F.pmod(draw, F.lit(bucket)))
        .filter(F.col("draw") < int(chance * bucket))
    )
    # a fixed number of tasks, so that the few rows are not merged into one
    tasks = min(trees, complete.sparkSession.sparkContext.defaultParallelism)
    w = Window.partitionBy("tree").orderBy("draw", key)
    sample = (
        pool.repartition(tasks, "tree")
        .withColumn("place", F.row_number().over(w))
        .filter(F.col("place") <= sample_rows)
    )
    depth = int(np.ceil(np.log2(max(2, min(sample_rows, total)))))
    return (
        sample.select("tree", "place", *columns)
        .groupBy("tree")
        .applyInPandas(_grow(columns, depth, seed), _NODE)
    )


def score(df: DataFrame, forest: DataFrame, columns: Sequence[str], sample_rows: int) -> DataFrame:
    """Append ``score`` between 0 and 1; NULL where a column is NULL."""
    nodes = forest.orderBy("tree", "node").toPandas()
    groups = [g for _, g in nodes.groupby("tree")]
    tables = [
        tuple(g[c].to_numpy() for c in ("axis", "cut", "left", "right", "path")) for g in groups
    ]
    sizes = sample_rows
    shared = df.sparkSession.sparkContext.broadcast((tables, average_path(sizes)))

    @F.pandas_udf("double")
    def rate(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        trees, norm = shared.value
        for part in parts:
            data = part.to_numpy(float)
            whole = ~np.isnan(data).any(axis=1)
            rows = np.arange(int(whole.sum()))
            values = data[whole]
            total = np.zeros(len(rows))
            for axis, cut, left, right, path in trees:
                at = np.zeros(len(rows), int)
                while True:
                    inner = axis[at] >= 0
                    if not inner.any():
                        break
                    here = at[inner]
                    below = values[rows[inner], axis[here]] <= cut[here]
                    at[inner] = np.where(below, left[here], right[here])
                total += path[at]
            out = np.full(len(data), np.nan)
            out[whole] = 2.0 ** (-(total / len(trees)) / norm) if norm > 0 else 0.5
            yield pd.Series(out)

    rated = rate(F.struct(*[F.col(c).cast("double").alias(c) for c in columns]))
    return df.withColumn("score", F.nanvl(rated, F.lit(None).cast("double")))


def isolation_forest(
    df: DataFrame,
    columns: Sequence[str],
    key: str = "event_id",
    contamination: float = 0.1,
    random_state: int = 42,
    trees: int = 100,
    sample_rows: int = 256,
) -> DataFrame:
    """Append ``score`` and flag the top ``contamination`` share of it."""
    forest = keep(grow_forest(df, columns, key, trees, sample_rows, random_state))
    rows = df.select(*columns).dropna().count()
    scored = score(df, forest, columns, min(sample_rows, rows))
    return flag_top_share(keep(scored), "score", contamination)
