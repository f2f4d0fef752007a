"""Exact k nearest neighbours without comparing all pairs.

1. Rows with equal coordinates become one point that keeps its ``k`` smallest keys; no row
   with a larger key can be among the k nearest, since ties go to the smaller key.
2. Points are sorted along a Z-order curve. Its steps follow the quantiles of each axis and are even
   inside them, fine enough that no two places share one. The points just before and after a place
   hold ``k`` donors, so their k-th distance is an upper bound for the true one; a second curve,
   shifted by a third, tightens the bound where the first one breaks.
3. Runs of the first curve are the leaves of a tree of bounding boxes, runs of leaves their parents, and
   so on. Each place goes down from the root into the boxes that its ball touches. A leaf holds a
   fixed number of points, so a dense cluster beside a sparse place is passed by box by box.

Leaves and levels follow the number of points, so what a place looks at stays the same as a table
grows. The bound only decides how far to look, never which donors count. Several searches, for example
in different coordinates, run as one: rows meet only those of their own ``group``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import keep
from .ordered import SEQ, Split, carry, over_rows, positioned

_BINS = 256
_SAMPLE_ROWS = 100_000
# rows of a group that one task sorts; a longer curve is cut, and a second one is worth its cost
_CURVE_ROWS = 100_000
#: Points of a leaf, and children of an inner box.
LEAF, FAN = 32, 128
# a level of at most so many boxes is sent to every task
_SMALL_LEVEL = 2_048
_SLACK = 1 + 1e-9
_G, _Z = "__g", "__z"


def nearest(
    queries: DataFrame | None,
    donors: DataFrame,
    coords: Sequence[str],
    k: int,
    donor_key: str,
    payload: Column,
    group: str | None = None,
) -> DataFrame:
    """Append ``neighbours`` to ``queries``: up to k structs (distance, key, payload), sorted.

    All coordinates must be non-NULL on both sides. Without ``queries`` the result has one row
    per distinct place of the donors, and a place is its own nearest neighbour. With ``group``, a column
    of both sides, only donors of the query's group count.
    """
    axes = [f"__x{i}" for i in range(len(coords))]
    as_axes = [F.col(c).cast("double").alias(a) for c, a in zip(coords, axes)]
    of = (F.col(group) if group else F.lit(0)).alias(_G)
    item = F.struct(F.col(donor_key).alias("key"), payload.alias("payload"))
    points = keep(_points(donors.select(of, *as_axes, item.alias("item")), axes, k))
    places = None if queries is None else queries.select(of, *as_axes).distinct()
    found = _in_tree(places, points, axes, k)
    if queries is None:
        named = [F.col(_G).alias(group)] if group else []
        return found.select(*named, *[F.col(a).alias(c) for a, c in zip(axes, coords)], "neighbours")
    tagged = queries.select("*", of, *as_axes)
    return tagged.join(found, [_G, *axes], "left").select(*queries.columns, "neighbours")


def _points(rows: DataFrame, axes: Sequence[str], k: int) -> DataFrame:
    """One row per distinct place with its first k items in key order."""
    w = Window.partitionBy(_G, *axes).orderBy("item.key")
    first = rows.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= k)
    return first.groupBy(_G, *axes).agg(F.array_sort(F.collect_list("item")).alias("items"))


def _square(axes: Sequence[str], p: Column) -> Column:
    """Squared distance between this row's place and the place in struct ``p``."""
    return reduce(Column.__add__, [(F.col(a) - p[a]) * (F.col(a) - p[a]) for a in axes])


def _touches(axes: Sequence[str]) -> Column:
    """Whether the ball around this row's place reaches the row's box."""
    gaps = [F.greatest(F.col(f"lo{a}") - F.col(a), F.col(a) - F.col(f"hi{a}"), F.lit(0.0)) for a in axes]
    reach = F.col("radius") * F.lit(_SLACK)
    return reduce(Column.__add__, [g * g for g in gaps]) <= reach * reach


def _in_tree(places: DataFrame | None, points: DataFrame, axes: Sequence[str], k: int) -> DataFrame:
    shape = points.groupBy(_G).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    shape = shape.first()
    if not shape["n"]:  # no donors at all
        empty = points.select(_G, *axes, F.array().cast("array<string>").alias("neighbours"))
        return empty.limit(0)
    split = Split(shape["most"] > _CURVE_ROWS, _CURVE_ROWS)
    cuts = _cuts(points, shape["n"], axes)
    curves = [_curve(cuts, axes, shift) for shift in ((0.0, 1 / 3) if split.long else (0.0,))]
    levels, sizes = _boxes(curves[0](points), axes, split)
    looking = _with_radius(places, points, curves, axes, k, split, levels[-1])
    return _first_k(_descend(looking, levels, sizes, axes), axes, k)


def _descend(looking: DataFrame, levels: list[DataFrame], sizes: list[int], axes: Sequence[str]) -> DataFrame:
    """Each place with the leaves that its ball touches."""
    # the root of a group has number 0 on the highest level
    frontier = looking.withColumn("node", F.lit(0).cast("bigint"))
    for level, size in list(zip(levels, sizes))[-2::-1]:
        boxes = level.select(
            F.col(_G).alias("__box_g"), F.floor(F.col("node") / FAN).alias("__up"),
            F.col("node").alias("__down"), *[f"{e}{a}" for a in axes for e in ("lo", "hi")],
            *(["points"] if level is levels[0] else []),
        )
        if level is not levels[0] and size <= _SMALL_LEVEL:
            boxes = F.broadcast(boxes)
        met = frontier.join(boxes, (F.col(_G) == F.col("__box_g")) & (F.col("node") == F.col("__up")))
        columns = [_G, *axes, "radius", F.col("__down").alias("node")]
        frontier = met.where(_touches(axes)).select(*columns, *(["points"] if level is levels[0] else []))
    return frontier


def _first_k(met: DataFrame, axes: Sequence[str], k: int) -> DataFrame:
    hits = met.select(_G, *axes, "radius", F.explode("points").alias("p"))
    hits = hits.withColumn("distance", F.sqrt(_square(axes, F.col("p"))))
    hits = hits.filter(F.col("distance") <= F.col("radius") * F.lit(_SLACK))
    hits = hits.select(_G, *axes, "distance", F.inline("p.items"))
    w = Window.partitionBy(_G, *axes).orderBy("distance", "key")
    first = hits.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= k)
    near = F.array_sort(F.collect_list(F.struct("__rank", "distance", "key", "payload")))
    near = F.transform(near, lambda n: n.dropFields("__rank"))
    return first.groupBy(_G, *axes).agg(near.alias("neighbours"))


def _boxes(curve: DataFrame, axes: Sequence[str], split: Split) -> tuple[list[DataFrame], list[int]]:
    """Levels of the tree, leaves first, and their sizes; the last one has one box per group.

    A box is ``node`` of its group and covers the boxes ``FAN * node`` and on of the level below.
    """
    placed = positioned(curve, [_G], [_Z, *axes], split)
    ends = [(e, f, a) for a in axes for e, f in (("lo", F.min), ("hi", F.max))]
    leaves = placed.groupBy(_G, F.floor(F.col(SEQ) / LEAF).alias("node")).agg(
        *[f(a).alias(f"{e}{a}") for e, f, a in ends],
        F.collect_list(F.struct(*axes, "items")).alias("points"),
    )
    levels, sizes = [keep(leaves)], []
    while True:
        size, last = levels[-1].agg(F.count(F.lit(1)), F.max("node")).first()
        sizes.append(size)
        if last == 0 and len(levels) > 1:
            return levels, sizes
        up = levels[-1].groupBy(_G, F.floor(F.col("node") / FAN).alias("node"))
        levels.append(keep(up.agg(*[f(f"{e}{a}").alias(f"{e}{a}") for e, f, a in ends])))


def _with_radius(
    places: DataFrame | None, points: DataFrame, curves: list, axes: Sequence[str], k: int, split: Split,
    roots: DataFrame,
) -> DataFrame:
    """Give each place a radius that surely holds k donors, or all of its group if there are fewer."""
    point = F.struct(*axes, F.size("items").alias("n")).alias("at")
    squares = F.flatten(F.transform("near", lambda p: F.array_repeat(_square(axes, p), p["n"])))
    square = F.try_element_at(F.array_sort(squares), F.lit(k))
    found = points.select(_G, *axes) if places is None else places
    found = found.withColumn("square", F.lit(None).cast("double"))
    for curve in curves:
        if places is None:
            both = curve(found.join(points.select(_G, *axes, point), [_G, *axes]))
            near = over_rows(
                both, lambda w: [F.collect_list("at").over(w.rowsBetween(-k, k)).alias("near")],
                [_G], [_Z, *axes], k, k, split,
            )
        else:
            near = _around(curve(points.select(_G, *axes, point)), curve(found), axes, k, split)
        found = keep(near.select(_G, *axes, F.least("square", square).alias("square")))
    # too few points: look as far as the farthest corner of the group's box
    box = roots.select(F.col(_G).alias("__box_g"), *[f"{e}{a}" for a in axes for e in ("lo", "hi")])
    far = [F.greatest(F.abs(F.col(a) - F.col(f"lo{a}")), F.abs(F.col(a) - F.col(f"hi{a}"))) for a in axes]
    corner = reduce(Column.__add__, [c * c for c in far])
    cornered = found.where("square IS NULL").join(box, F.col(_G) == F.col("__box_g"))
    radius = F.sqrt("square").alias("radius")
    return found.where("square IS NOT NULL").select(_G, *axes, radius).unionByName(
        cornered.withColumn("square", corner).select(_G, *axes, radius)
    )


def _around(points: DataFrame, places: DataFrame, axes: Sequence[str], k: int, split: Split) -> DataFrame:
    """Add to places the k points before and the k points after them on the curve."""
    order = [_Z, *axes]
    ring = over_rows(
        points,
        lambda w: [
            F.collect_list("at").over(w.rowsBetween(-(k - 1), 0)).alias("before"),
            F.collect_list("at").over(w.rowsBetween(0, k - 1)).alias("after"),
        ],
        [_G], order, k - 1, k - 1, split,
    )
    both = ring.select(_G, *order, "before", "after").unionByName(
        places.withColumn("__place", F.lit(True)), allowMissingColumns=True
    )
    placed = positioned(both, [_G], order, split)
    beside = carry(
        placed, {"__b": F.col("before")}, {"__a": F.col("after")}, [_G], order, split
    ).filter("__place")
    none = F.array().cast(ring.schema["before"].dataType)
    near = F.array_distinct(F.concat(*[F.coalesce(F.col(s), none) for s in ("__b", "__a")]))
    return beside.withColumn("near", near)


def _cuts(points: DataFrame, total: int, axes: Sequence[str]) -> list[list[float]]:
    """Quantiles of each axis. They only balance the work, so a sample is enough."""
    sample = points.select(*axes)
    if total > _SAMPLE_ROWS:
        sample = sample.sample(_SAMPLE_ROWS / total, seed=1)
    found = sample.approxQuantile(list(axes), [i / _BINS for i in range(_BINS + 1)], 0.001)
    return [sorted(set(c)) or [0.0] for c in found]


def _curve(cuts: list[list[float]], axes: Sequence[str], shift: float) -> Callable[[DataFrame], DataFrame]:
    """A function that adds ``__z``, the place on a curve that is shifted by a share of each axis."""
    bits = min(20, 60 // len(axes))
    inf = float("inf")
    bins, names = [f"__at{a}" for a in axes], [f"__b{a}" for a in axes]
    bucket = Bucketizer(
        inputCols=list(axes), outputCols=bins, splitsArray=[[-inf, *c, inf] for c in cuts], handleInvalid="keep"
    )
    steps = []
    for a, at, c in zip(axes, bins, cuts):
        # even steps between two cuts; the outermost ones close the axis
        ends, at = F.array(*[F.lit(x) for x in c]), F.col(at).cast("int")
        at = F.greatest(F.least(at, F.lit(len(c) - 1)), F.lit(min(1, len(c) - 1)))
        low, high = F.get(ends, F.greatest(at - 1, F.lit(0))), F.get(ends, at)
        share = F.coalesce(F.try_divide(F.col(a) - low, high - low), F.lit(0.0))
        share = F.greatest(F.least(share, F.lit(1.0)), F.lit(0.0))
        even = ((at - 1 + share) / max(1, len(c) - 1) + shift) / (4 / 3)
        steps.append(F.greatest(F.floor(even * ((1 << bits) - 1)), F.lit(0)).cast("bigint"))

    def add(df: DataFrame) -> DataFrame:
        z = " | ".join(
            f"shiftleft(shiftright({b}, {bit}) & 1, {bit * len(names) + i})"
            for bit in range(bits)
            for i, b in enumerate(names)
        )
        binned = bucket.transform(df).select(*df.columns, *[s.alias(b) for s, b in zip(steps, names)])
        return binned.select(*df.columns, F.expr(z).alias(_Z))

    return add
