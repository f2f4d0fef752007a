"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsprep.session import keep


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links (a, b)``; root is the smallest node reachable.

    Each round hooks every node to its smallest neighbour, follows the hooks to their ends by
    doubling and replaces the nodes of the links by those ends. Links inside one component vanish,
    so the table shrinks from round to round. Rounds are written to the shared folder, so a
    lost executor costs one round at most. NULL ends and loops are left out; no links, no rows.
    """
    edges = keep(links.where("a <> b").select("a", "b").distinct())
    roots = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy(F.col("a").alias("node")).agg(
            F.least(F.min("b"), F.first("a")).alias("root")
        )
        hook = _follow(keep(hook))
        new = _relabel(_relabel(edges, hook, "a"), hook, "b").where("a <> b").distinct()
        roots = hook if roots is None else keep(_relabel(roots, hook, "root"))
        edges = keep(new)
    if roots is None:
        kind = links.schema["a"].dataType
        return links.sparkSession.createDataFrame([], "node bigint, root bigint").select(
            F.col("node").cast(kind), F.col("root").cast(kind)
        )
    return roots


def _relabel(df: DataFrame, hook: DataFrame, name: str) -> DataFrame:
    to = hook.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    rest = [c for c in df.columns if c != name]
    joined = df.join(to, df[name] == to["_node"], "left")
    return joined.select(*rest, F.coalesce("_root", name).alias(name))


def _follow(hook: DataFrame) -> DataFrame:
    """Hooks point to smaller nodes or to the node itself; point all of them to the end."""
    while True:
        up = hook.select(F.col("node").alias("_node"), F.col("root").alias("_up"))
        longer = keep(
            hook.join(up, hook["root"] == up["_node"]).select(
                "node", F.col("_up").alias("root"), (F.col("_up") != F.col("root")).alias("moved")
            )
        )
        hook = longer.select("node", "root")
        if longer.where("moved").isEmpty():
            return hook
