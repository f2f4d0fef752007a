"""Prefix tree of conversations: which openings they share, and what sharing them saves.

A node is a distinct sequence of first turns, known by a 128-bit digest that is built by exclusive or
from digests of position and turn, so prefixes of any length come from a running window. Sums over
subtrees come from an Euler tour: an enter and an exit arc per node, linked into one list, ranked
by contracting blocks of arcs inside tasks until one arc is left, and differences of the prefix
sums at both arcs of a node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsprep.llm.common import column, whole_text
from tsprep.operators.ordered import (
    CHUNK_ROWS, MAX_SERIES_ROWS, SEQ, choose_split, number_rows, over_rows, positioned,
)
from tsprep.session import keep

#: Arcs that one task contracts at a time.
BLOCK = 32_768
#: Of the contract's query: conversations of one hundred share an opening of less than six turns.
GROUP, OPENINGS = 100, 6

_NODE = ["n1", "n2", "depth"]
_WEIGHTS = ["rank", "leaves", "saved"]


def _digests(*parts: str | Column) -> list[Column]:
    """Two independent 64-bit digests."""
    return [F.xxhash64(*parts), F.xxhash64(F.lit(0x9E3779B97F4A7C15 - 2**64), *parts)]


def turns_in_order(
    conversations: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    max_series_rows: int = MAX_SERIES_ROWS,
) -> DataFrame:
    """``conv_id, pos, t1, t2, chars``: every turn's position from 1, digests and code points.

    Turns without a conversation are left out. NULL roles and texts are empty; a NULL turn number
    comes first; turns of equal number come in the order of their digests, repeated ones count.
    """
    rows = conversations.select(
        column(conv_col).alias("conv_id"),
        column(turn_col).alias("turn"),
        whole_text(role_col).alias("role"),
        whole_text(text_col).alias("text"),
    ).where("conv_id IS NOT NULL")
    t1, t2 = _digests("role", "text")
    rows = rows.select(
        "conv_id", "turn", t1.alias("t1"), t2.alias("t2"), F.char_length("text").cast("bigint").alias("chars")
    )
    split = choose_split(rows, ["conv_id"], max_series_rows)
    placed = positioned(rows, ["conv_id"], ["turn", "t1", "t2"], split)
    return placed.select("conv_id", (F.col(SEQ) + 1).alias("pos"), "t1", "t2", "chars")


def rebuild(turns: DataFrame) -> DataFrame:
    """``turns`` with ``total``, each conversation after the opening of the first one of its hundred.

    Conversation c starts with the first h turns of ``c - c % GROUP`` and goes on with its own after
    its first h, with ``h = crc32(c) % OPENINGS``. One that is left without turns has a row
    whose ``pos`` is NULL.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % OPENINGS).alias("h")
    lengths = turns.groupBy("conv_id").agg(F.count("*").alias("len"))
    firsts = lengths.select(F.col("conv_id").alias("base"), F.col("len").alias("base_len"))
    each = lengths.select("*", h, (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"))
    each = each.join(firsts, "base", "left")
    taken = F.least("h", F.coalesce("base_len", F.lit(0)))
    each = each.withColumn("k", taken)
    each = keep(each.withColumn("total", F.col("k") + F.greatest(F.col("len") - F.col("h"), F.lit(0))))

    opening = turns.where(F.col("pos") < OPENINGS).where(F.col("conv_id") % GROUP == 0)
    opening = opening.withColumnRenamed("conv_id", "base")
    shared = each.join(opening, "base").where("pos <= h")
    own = turns.join(each, "conv_id").where("pos > h").withColumn("pos", F.expr("pos - h + k"))
    none = each.where("total = 0").select(
        "conv_id", *(F.lit(None).cast("bigint").alias(c) for c in ("pos", "t1", "t2", "chars")), "total"
    )
    columns = ["conv_id", "pos", "t1", "t2", "chars", "total"]
    return shared.select(columns).unionByName(own.select(columns)).unionByName(none)


def as_they_are(turns: DataFrame) -> DataFrame:
    """``turns`` with ``total``, the number of turns of the conversation."""
    lengths = turns.groupBy("conv_id").agg(F.count("*").alias("total"))
    return turns.join(lengths, "conv_id")


def _paths(turns: DataFrame, max_series_rows: int) -> DataFrame:
    """``conv_id, depth, x1, x2, n1, n2, chars, total``: the node after every turn.

    A conversation that is longer than ``max_series_rows`` is cut into chunks of positions, and what
    comes before a chunk passes through a table with one row per chunk.
    """
    x1, x2 = _digests("pos", "t1", "t2")
    rows = turns.where("pos IS NOT NULL").select(
        "conv_id", F.col("pos").alias("depth"), x1.alias("x1"), x2.alias("x2"), "chars", "total"
    )
    running = [F.bit_xor(f"x{i}") for i in (1, 2)]
    longest = rows.agg(F.max("total")).first()[0] or 0
    if longest <= max_series_rows:
        w = Window.partitionBy("conv_id").orderBy("depth")
        return rows.select("*", *(x.over(w).alias(f"n{i}") for i, x in enumerate(running, 1)))
    size = max(1, min(max_series_rows, CHUNK_ROWS))
    rows = keep(rows.withColumn("chunk", F.floor((F.col("depth") - 1) / size)))
    totals = rows.groupBy("conv_id", "chunk").agg(*(x.alias(f"c{i}") for i, x in enumerate(running, 1)))
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        "conv_id",
        "chunk",
        *(F.coalesce(F.bit_xor(f"c{i}").over(earlier), F.lit(0)).alias(f"b{i}") for i in (1, 2)),
    )
    w = Window.partitionBy("conv_id", "chunk").orderBy("depth")
    rows = rows.select("*", *(x.over(w).alias(f"w{i}") for i, x in enumerate(running, 1)))
    rows = rows.join(carried, ["conv_id", "chunk"])
    joined = [F.col(f"w{i}").bitwiseXOR(F.col(f"b{i}")).alias(f"n{i}") for i in (1, 2)]
    return rows.select("conv_id", "depth", "x1", "x2", "chars", "total", *joined)


def _nodes(turns: DataFrame, paths: DataFrame) -> DataFrame:
    """One row per node, numbered by smallest member and depth, with the digest of its parent."""
    nodes = paths.groupBy(*_NODE).agg(
        F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"),
        F.first("x1").alias("x1"),
        F.first("x2").alias("x2"),
        F.first("chars").alias("chars"),
    )
    members = turns.groupBy("conv_id").agg(F.lit(1).alias("one"))
    zero = F.lit(0).cast("bigint")
    root = members.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select("*", *(zero.alias(c) for c in ["n1", "n2", "depth", "x1", "x2", "chars"]))
    return number_rows(nodes.unionByName(root), [], ["conv_id", "depth"], "node")


def _linked(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``parent, parent_conv_id, next`` (sibling), ``first`` (child) and ``n_children``.

    The root is the first of all, so children of the root need no look-up, however many they are.
    """
    root = nodes.where("node = 0").select(F.col("conv_id").alias("root_conv"))
    above = nodes.select(
        F.col("n1").alias("p1"),
        F.col("n2").alias("p2"),
        (F.col("depth") + 1).alias("below"),
        F.col("node").alias("parent"),
        F.col("conv_id").alias("parent_conv_id"),
    )
    up = nodes.withColumn("q1", F.col("n1").bitwiseXOR(F.col("x1"))).withColumn("q2", F.col("n2").bitwiseXOR(F.col("x2")))
    deep = up.where("depth > 1").join(
        above.where("below > 1"),
        (F.col("q1") == F.col("p1")) & (F.col("q2") == F.col("p2")) & (F.col("depth") == F.col("below")),
    )
    first_conv = root.first()
    flat = up.where("depth <= 1").withColumns(
        {
            "parent": F.when(F.col("depth") == 1, F.lit(0).cast("bigint")),
            "parent_conv_id": F.when(F.col("depth") == 1, F.lit(first_conv[0] if first_conv else None)).cast(
                nodes.schema["conv_id"].dataType
            ),
        }
    )
    columns = ["node", "conv_id", *_NODE, "n_convs", "chars", "parent", "parent_conv_id"]
    tree = keep(deep.select(columns).unionByName(flat.select(columns)))
    tree = over_rows(tree, lambda w: [F.lead("node").over(w).alias("next")], ["parent"], ["node"], after=1)
    tree = keep(tree)
    children = tree.where("parent IS NOT NULL").groupBy(F.col("parent").alias("_parent"))
    children = children.agg(F.min("node").alias("first"), F.count("*").alias("n_children"))
    return tree.join(children, tree["node"] == children["_parent"], "left").drop("_parent")


def euler_arcs(tree: DataFrame) -> DataFrame:
    """``arc, succ, rank, leaves, saved``: node v is entered by arc 2v and left by arc 2v + 1.

    ``succ`` is the arc after it in the tour, NULL at its end; the weights lie on enter arcs.
    """
    node, zero, one = F.col("node"), F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    inside = F.coalesce(F.col("first") * 2, node * 2 + 1)
    after = F.coalesce(F.col("next") * 2, F.col("parent") * 2 + 1)
    leaf = F.col("first").isNull().cast("bigint")
    enter = F.struct(
        (node * 2).alias("arc"), inside.alias("succ"), one.alias("rank"), leaf.alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
    )
    leave = F.struct(
        (node * 2 + 1).alias("arc"), after.alias("succ"), one.alias("rank"), zero.alias("leaves"), zero.alias("saved")
    )
    return tree.select(F.inline(F.array(enter, leave)))


def contract(arc: np.ndarray, succ: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """Chains among the arcs at hand: for each arc the index of its chain's first arc and the weights
    from there up to it; for each chain the index of its first arc, its successor and its weights.

    ``arc`` is sorted; ``succ`` holds -1 for none. Pointers are doubled, so a chain of n arcs takes
    log n rounds.
    """
    n = len(arc)
    at = np.minimum(np.searchsorted(arc, succ), n - 1)
    here = arc[at] == succ
    head, offset = np.arange(n), np.zeros_like(weights)
    head[at[here]] = np.flatnonzero(here)
    offset[at[here]] = weights[here]
    while True:
        further = head[head]
        if (further == head).all():
            break
        offset += offset[head]
        head = further
    last = np.flatnonzero(~here)
    return head, offset, head[last], succ[last], offset[last] + weights[last]


def _contract_blocks(arcs: DataFrame) -> DataFrame:
    """Every arc with its ``head`` and the weights from there; heads also with their chain's."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("arc", ignore_index=True)
        arc = group["arc"].to_numpy()
        succ = group["succ"].fillna(-1).to_numpy(np.int64)
        head, offset, first, after, total = contract(arc, succ, group[_WEIGHTS].to_numpy())
        out = pd.DataFrame({"arc": arc, "head": arc[head]})
        out[[f"off_{w}" for w in _WEIGHTS]] = offset
        chain = np.zeros((len(arc), 4), np.int64)
        chain[first] = np.column_stack([after, total])
        out["succ"] = pd.array(np.where(chain[:, 0] < 0, -1, chain[:, 0]), "Int64")
        out.loc[chain[:, 0] < 0, "succ"] = pd.NA
        out[_WEIGHTS] = chain[:, 1:]
        return out

    names = ["arc", "head", *(f"off_{w}" for w in _WEIGHTS), "succ", *_WEIGHTS]
    return arcs.groupBy("block").applyInPandas(run, ", ".join(f"{c} bigint" for c in names))


def _contract_pairs(arcs: DataFrame, turn: int) -> DataFrame:
    """The same by coins: an arc that shows heads takes in a successor that shows tails.

    A quarter of all arcs go, wherever they lie. The coin is a hash, so no look-up is needed to see it.
    """

    def coin(name: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(turn), name), F.lit(2))

    taken = arcs.where(coin("arc") == 1).select(
        F.col("arc").alias("_arc"), F.col("succ").alias("_succ"), *(F.col(w).alias(f"_{w}") for w in _WEIGHTS)
    )
    takers = arcs.where(coin("arc") == 0).select(
        F.col("arc").alias("_head"), F.col("succ").alias("_to"), *(F.col(w).alias(f"off_{w}") for w in _WEIGHTS)
    )
    pairs = keep(taken.join(takers, taken["_arc"] == takers["_to"]))
    none = F.lit(None).cast("bigint")
    zero = F.lit(0).cast("bigint")
    gone = pairs.select(
        F.col("_arc").alias("arc"), F.col("_head").alias("head"), *(f"off_{w}" for w in _WEIGHTS),
        none.alias("succ"), *(zero.alias(w) for w in _WEIGHTS),
    )
    longer = pairs.select("_head", "_succ", *(f"_{w}" for w in _WEIGHTS))
    stay = arcs.join(pairs.select("_arc"), arcs["arc"] == F.col("_arc"), "left_anti")
    stay = stay.join(longer, stay["arc"] == longer["_head"], "left")
    took = F.col("_head").isNotNull()
    stay = stay.select(
        "arc", F.col("arc").alias("head"), *(zero.alias(f"off_{w}") for w in _WEIGHTS),
        F.when(took, F.col("_succ")).otherwise(F.col("succ")).alias("succ"),
        *((F.col(w) + F.coalesce(f"_{w}", zero)).alias(w) for w in _WEIGHTS),
    )
    return gone.unionByName(stay)


def rank_list(arcs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``arc, rank, leaves, saved``: the sums of the weights of all arcs before it in the list.

    Each round deals the arcs that are left into equal blocks, in order of their numbers, and
    contracts the chains inside a block in one task; near arcs have near numbers, so one or two rounds
    suffice. If a round takes away less than a quarter, pairs are contracted by coins next, so
    no order needs more than a logarithmic number of rounds. Then the rounds are undone in turn.
    """
    levels: list[DataFrame] = []
    left = keep(arcs)
    n, coins = left.count(), False
    while n:
        if coins:
            level = keep(_contract_pairs(left, len(levels)))
        else:
            dense = number_rows(left, [], ["arc"], "_at") if n > block else left.withColumn("_at", F.lit(0))
            level = keep(_contract_blocks(dense.withColumn("block", F.floor(F.col("_at") / block)).drop("_at")))
        levels.append(level)
        left = level.where("arc = head").select("arc", "succ", *_WEIGHTS)
        before, n = n, left.count()
        if n == 1:
            break
        coins = not coins and 4 * n > 3 * before
    ranked = None
    for level in reversed(levels):
        offset = level.select("arc", "head", *(f"off_{w}" for w in _WEIGHTS))
        if ranked is None:
            ranked = offset.select("arc", *(F.col(f"off_{w}").alias(w) for w in _WEIGHTS))
            continue
        above = ranked.withColumnRenamed("arc", "_arc")
        joined = offset.join(above, offset["head"] == above["_arc"])
        ranked = joined.select("arc", *((F.col(w) + F.col(f"off_{w}")).alias(w) for w in _WEIGHTS))
    return left.select("arc", *_WEIGHTS) if ranked is None else ranked


def _ends(turns: DataFrame, paths: DataFrame) -> DataFrame:
    """``n1, n2, depth, ends_sha256`` of the nodes at which conversations end.

    Members are sorted by range, so those of a hot node are joined to long texts in many tasks; the
    digest itself runs over these texts in order, without holding them.
    """
    zero = F.lit(0).cast("bigint")
    ends = paths.where("depth = total").select(*_NODE, "conv_id")
    ends = ends.unionByName(turns.where("pos IS NULL").select(*(zero.alias(c) for c in _NODE), "conv_id"))
    kind = turns.schema["conv_id"].dataType.simpleString()

    def join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.column_stack([batch.column(c).to_numpy() for c in range(3)])
            ids = batch.column(3).to_pylist()
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]) if len(ids) else []
            runs = [",".join(map(str, ids[s:e])) for s, e in zip(starts, [*starts[1:], len(ids)])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(pa.array(starts, pa.int64())) for c in range(4)] + [pa.array(runs, pa.string())],
                [*_NODE, "low", "ids"],
            )

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            out = []
            for *mine, _, ids in batch.itertuples(index=False):
                if mine == key:
                    state.update(b"," + ids.encode())
                    continue
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = mine, hashlib.sha256(ids.encode())
            yield pd.DataFrame(out, columns=[*_NODE, "ends_sha256"])
        if key is not None:
            yield pd.DataFrame([(*key, state.hexdigest())], columns=[*_NODE, "ends_sha256"])

    order = [*_NODE, "conv_id"]
    shape = "n1 bigint, n2 bigint, depth bigint"
    runs = ends.repartitionByRange(*order).sortWithinPartitions(*order)
    runs = runs.mapInArrow(join_ids, f"{shape}, low {kind}, ids string")
    runs = runs.repartition(*_NODE).sortWithinPartitions(*_NODE, "low")
    return runs.mapInPandas(digest, f"{shape}, ends_sha256 string")


def prefix_trie(turns: DataFrame, block: int = BLOCK, max_series_rows: int = MAX_SERIES_ROWS) -> DataFrame:
    """One row per node of the prefix tree of ``turns (conv_id, pos, t1, t2, chars, total)``:
    ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256,
    enter, exit``.

    ``conv_id`` is the smallest member, ``n_leaves`` counts the childless nodes below (itself
    included), ``saved_tokens`` sums ``(n_convs - 1) * chars`` over the subtree, ``ends_sha256`` is over
    the ids of the members that end there, ``enter`` and ``exit`` are places in the Euler tour. The
    root, of depth 0, has no parent. Without conversations there are no nodes.
    """
    turns = keep(turns)
    paths = keep(_paths(turns, max_series_rows))
    tree = keep(_linked(keep(_nodes(turns, paths))))
    ranked = rank_list(euler_arcs(tree), block)
    node = F.floor(F.col("arc") / 2).alias("_node")
    out = [F.max(F.when(F.col("arc") % 2 == 1, F.col(w))).alias(f"{w}_out") for w in _WEIGHTS]
    into = [F.max(F.when(F.col("arc") % 2 == 0, F.col(w))).alias(f"{w}_in") for w in _WEIGHTS]
    sums = ranked.groupBy(node).agg(*out, *into)
    joined = tree.join(sums, tree["node"] == sums["_node"]).join(_ends(turns, paths), _NODE, "left")
    return joined.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"),
        (F.col("leaves_out") - F.col("leaves_in")).alias("n_leaves"),
        (F.col("saved_out") - F.col("saved_in")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        F.col("rank_in").alias("enter"),
        F.col("rank_out").alias("exit"),
    )


#: crc32 of the decimal id, a bit at a time: DuckDB has no such function.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(
    [[ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0] FOR c IN string_split(conv_id::VARCHAR, '')])),
    lambda a, b: CASE WHEN xor(a, b) & 1 = 1 THEN xor(xor(a, b) >> 1, 3988292384) ELSE xor(a, b) >> 1 END))"""


def oracle_sql() -> str:
    return f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER
               (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p
           FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, count(*) AS len FROM t GROUP BY conv_id),
c AS (SELECT conv_id, len, ({_CRC}) % {OPENINGS} AS h, conv_id - conv_id % {GROUP} AS base FROM l),
e AS (SELECT c.*, least(h, coalesce(b.len, 0)) AS k FROM c LEFT JOIN l b ON b.conv_id = c.base),
u AS (SELECT e.conv_id, t.p AS d, role, text FROM e JOIN t ON t.conv_id = base AND p <= h
      UNION ALL SELECT conv_id, p - h + k, role, text FROM e JOIN t USING (conv_id) WHERE p > h),
s AS (SELECT conv_id, d, length(text) AS chars, sha256(string_agg(sha256(role) || sha256(text), '')
          OVER (PARTITION BY conv_id ORDER BY d)) AS key FROM u
      UNION ALL SELECT conv_id, 0, 0, '' FROM e),
n AS (SELECT key, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars
      FROM s GROUP BY key, d),
up AS (SELECT n.key, n.d, s.key AS pkey FROM n JOIN s ON s.conv_id = n.conv_id AND s.d = n.d - 1),
kids AS (SELECT pkey AS key, count(*) AS n_children FROM up GROUP BY pkey),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (key)),
sub AS (SELECT s.key, count(*) FILTER (n_children = 0) AS n_leaves,
               sum((n_convs - 1) * f.chars) AS saved_tokens
        FROM f JOIN s ON s.conv_id = f.conv_id AND s.d <= f.d GROUP BY s.key),
last AS (SELECT conv_id, max_by(key, d) AS key FROM s GROUP BY conv_id),
ends AS (SELECT key, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM last GROUP BY key)
SELECT f.conv_id, f.d AS depth, m.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves,
       saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM f JOIN sub USING (key) LEFT JOIN up USING (key) LEFT JOIN n m ON m.key = up.pkey
LEFT JOIN ends ON ends.key = f.key"""
