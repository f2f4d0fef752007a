"""Near-duplicate groups by min-max hashing.

Every permutation of the shingles keeps both its smallest and its largest value: two signature
entries for one hash evaluation, each equal in two documents with a probability of their Jaccard
similarity. Runs of entries form bands; documents that agree in a band are candidates, and the full
sets decide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsprep.llm.common import id_and_text
from tsprep.llm.components import connected_components
from tsprep.session import keep

WORDS_PER_SHINGLE = 5
ROWS = 5
BANDS = 40
SEED = 20_240_501
#: Members of one bucket that meet in one task when an unsettled bucket is searched through, and bytes
#: of their shingle hashes.
BLOCK, BLOCK_BYTES = 1_024, 8 * 2**20
#: Signature entries of the sketches that are compared there.
SKETCH = 1_024


def words(text: str) -> list[bytes]:
    """Words between the bytes 0x20 and 0x09-0x0D, with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingles(parts: list[bytes], size: int = WORDS_PER_SHINGLE) -> set[tuple[bytes, ...]]:
    """Distinct runs of ``size`` words; all of them as one if there are fewer; none of none."""
    if not parts:
        return set()
    if len(parts) < size:
        return {tuple(parts)}
    return set(zip(*(parts[i:] for i in range(size))))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class MinMax:
    """Signatures of ``rows * bands`` entries from half as many permutations."""

    def __init__(self, rows: int = ROWS, bands: int = BANDS, size: int = WORDS_PER_SHINGLE):
        if rows * bands % 2:
            raise ValueError("rows * bands must be even")
        rng = np.random.default_rng(SEED)
        half = rows * bands // 2
        self.rows, self.bands, self.size = rows, bands, size
        self.factor = rng.integers(0, 2**31, (half, 1)).astype(np.uint32) * 2 + np.uint32(1)
        self.shift = rng.integers(0, 2**32, (half, 1)).astype(np.uint32)
        self.place = rng.integers(0, 2**63, size).astype(np.uint64) * 2 + np.uint64(1)
        self.entry = rng.integers(0, 2**63, rows).astype(np.uint64) * 2 + np.uint64(1)
        self.band = rng.integers(0, 2**63, bands).astype(np.uint64)

    def fingerprints(self, parts: list[bytes]) -> np.ndarray:
        """Distinct 64-bit hashes of the shingles."""
        n = len(parts)
        if not n:
            return np.empty(0, np.uint64)
        code = np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64, n)
        short = min(n, self.size)
        total = np.zeros(n - short + 1, np.uint64)
        for i in range(short):
            total += code[i : n - short + 1 + i] * self.place[i]
        return np.unique(_mix(total + np.uint64(short)))

    def signature(self, prints: np.ndarray) -> np.ndarray:
        """The smallest value under each permutation, then the largest."""
        low = np.full(len(self.factor), 2**32 - 1, np.uint32)
        high = np.zeros(len(self.factor), np.uint32)
        keys = (prints >> np.uint64(32)).astype(np.uint32)
        for start in range(0, len(keys), 1024):
            value = keys[None, start : start + 1024] * self.factor
            value += self.shift
            np.minimum(low, value.min(axis=1), out=low)
            np.maximum(high, value.max(axis=1), out=high)
        return np.concatenate([low, high])

    def band_keys(self, signature: np.ndarray) -> np.ndarray:
        """One key per band; bands never share keys but by chance."""
        entries = signature.reshape(self.bands, self.rows).astype(np.uint64)
        return _mix((entries * self.entry).sum(axis=1, dtype=np.uint64) ^ self.band)


def describe(docs: DataFrame, scheme: MinMax) -> DataFrame:
    """``doc_id, n_shingles``, the ``digest`` of the words and the ``bands`` of every document."""

    def run(batch: pd.Series) -> pd.DataFrame:
        rows = []
        for text in batch:
            parts = words(text)
            prints = scheme.fingerprints(parts)
            keys = scheme.band_keys(scheme.signature(prints)).view(np.int64)
            rows.append((len(prints), hashlib.sha256(b" ".join(parts)).digest(), keys))
        return pd.DataFrame(rows, columns=["n_shingles", "digest", "bands"])

    describe_text = F.pandas_udf(run, "n_shingles bigint, digest binary, bands array<bigint>")
    return docs.select("doc_id", describe_text("text").alias("d")).select("doc_id", "d.*")


def confirm(pairs: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full shingle sets reach the similarity."""
    kind = pairs.schema["a"].dataType.simpleString()
    side = texts.select(F.col("node").alias("_node"), F.col("text").alias("_text"))
    named = pairs.join(side, pairs["a"] == side["_node"]).select("a", "b", F.col("_text").alias("x"))
    named = named.join(side, named["b"] == side["_node"]).select("a", "b", "x", F.col("_text").alias("y"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, None
        for batch in batches:
            hit = []
            for x, y in zip(batch["x"], batch["y"]):
                if y != last:
                    last, held = y, shingles(words(y), size)
                other = shingles(words(x), size)
                both = len(held & other)
                hit.append(100 * both >= percent * (len(held) + len(other) - both) and both > 0)
            yield batch.loc[hit, ["a", "b"]]

    return named.mapInPandas(run, f"a {kind}, b {kind}")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = 75,
    rows: int = ROWS,
    bands: int = BANDS,
    shingle_words: int = WORDS_PER_SHINGLE,
) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Two documents are linked if ``100 * shared >= percent * union`` of their distinct shingles;
    ``component_id`` is the smallest id reachable. With ``rows`` entries a band and ``bands`` bands,
    a pair of similarity s is found with probability ``1 - (1 - s**rows)**bands``: 0.99998 at 0.75.

    Documents of the same words are one node, so copies are never paired. In a bucket all
    nodes meet its smallest one first, and in further rounds another one, as long as that
    halves what is open. Buckets that still hold several components are then searched through in
    blocks, whose tasks return no more links than they join components. A NULL text is empty; a text without words has no shingles and is
    linked with nothing. Rows that share an id are one node. A NULL id is linked with nothing,
    its ``component_id`` is NULL and it is kept.
    """
    texts = id_and_text(docs, id_col, text_col)
    scheme = MinMax(rows, bands, shingle_words)
    known = keep(describe(texts, scheme))
    full = known.where("doc_id IS NOT NULL AND n_shingles > 0")
    node_of = keep(full.groupBy("digest").agg(F.min("doc_id").alias("node")))
    same = full.select("digest", "doc_id").join(node_of, "digest").select("doc_id", "node")
    nodes = full.join(node_of, "digest").where("doc_id = node").select("node", "bands")
    shared = keep(_shared_buckets(keep(nodes)))
    pairs = keep(
        shared.where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct()
    )
    texts = texts.select(F.col("doc_id").alias("node"), "text")
    texts = keep(texts.join(shared.select("node").distinct(), "node", "left_semi"))
    links = keep(
        confirm(pairs, texts, percent, shingle_words).unionByName(_one_id(same))
    )
    roots = connected_components(links)
    open_rows = keep(_open_buckets(shared, roots))
    left, turn = open_rows.count(), 0
    while left:
        turn += 1
        tried = keep(_meet_pivot(open_rows, turn).join(pairs, ["a", "b"], "left_anti"))
        pairs = pairs.unionByName(tried)
        links = links.unionByName(keep(confirm(tried, texts, percent, shingle_words)))
        roots = connected_components(links)
        open_rows = keep(_open_buckets(shared, roots))
        before, left = left, open_rows.count()
        if 2 * left > before:
            break
    if left:
        rest = keep(_search_blocks(open_rows, texts, percent, scheme))
        links = links.unionByName(keep(confirm(rest.distinct(), texts, percent, shingle_words)))
        roots = connected_components(links)
    roots = roots.withColumnRenamed("node", "_node")
    mine = (
        same.join(roots, same["node"] == roots["_node"], "left")
        .groupBy(F.col("doc_id").alias("_id"))
        .agg(F.min(F.coalesce("root", "node")).alias("_root"))
    )
    out = known.join(mine, known["doc_id"] == mine["_id"], "left")
    component = F.coalesce("_root", "doc_id")
    return out.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def _shared_buckets(nodes: DataFrame) -> DataFrame:
    """``key, node, low`` for the buckets of several nodes; ``low`` is the smallest of them."""
    rows_of = nodes.select("node", F.explode("bands").alias("key"))
    several = (
        rows_of.groupBy("key")
        .agg(F.min("node").alias("low"), F.max("node").alias("high"))
        .where("low < high")
        .select("key", "low")
    )
    return rows_of.join(several, "key").select("key", "node", "low")


def _one_id(same: DataFrame) -> DataFrame:
    """Links between the nodes of rows that share an id but not their words."""
    spread = same.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("high"))
    return (
        same.join(spread.where("b < high"), "doc_id")
        .where("node <> b")
        .select(F.col("node").alias("a"), "b")
    )


def _open_buckets(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """``key, node, root`` for the members of buckets that hold several components."""
    at = shared.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    ends = at.groupBy("key").agg(F.min("root").alias("_low"), F.max("root").alias("_high"))
    return at.join(ends.where("_low < _high").select("key"), "key")


def _meet_pivot(open_rows: DataFrame, turn: int) -> DataFrame:
    """Pairs ``(a, b)``, a > b, of each member and its bucket's pivot in another component.

    The pivot comes first by a hash that changes with ``turn`` but not with the bucket, so the buckets
    of one group share a few pivots.
    """
    pivot = F.min_by(F.struct("node", "root"), F.xxhash64(F.lit(turn), "node")).alias("_pivot")
    met = open_rows.join(open_rows.groupBy("key").agg(pivot), "key").where("root <> _pivot.root")
    return met.select(
        F.greatest("node", "_pivot.node").alias("a"), F.least("node", "_pivot.node").alias("b")
    ).distinct()


def _sketches(texts: DataFrame, scheme: MinMax) -> DataFrame:
    """``node, sketch, prints``: the last byte of each of ``SKETCH`` signature entries, and the sorted
    hashes of all shingles."""
    fine = MinMax(2, SKETCH // 2, scheme.size)
    kind = texts.schema["node"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            prints = [fine.fingerprints(words(t)) for t in batch["text"]]
            sketches = [fine.signature(p).astype(np.uint8).tobytes() for p in prints]
            yield pd.DataFrame(
                {"node": batch["node"], "sketch": sketches, "prints": [p.tobytes() for p in prints]}
            )

    return texts.mapInPandas(run, f"node {kind}, sketch binary, prints binary")


def _search_blocks(open_rows: DataFrame, texts: DataFrame, percent: int, scheme: MinMax) -> DataFrame:
    """Links ``(a, b)``, a > b, that join all linked components inside each bucket.

    Members outside a bucket's largest component are dealt into blocks i, all members into blocks j,
    and every i meets every j in a task: a large component with a few strangers costs its own
    size. There sketches rule most pairs out. Their bar lies five standard deviations below the wanted
    similarity: a pair right at it is lost once in 3 million. Full sets of hashes decide about the
    others, and a link is returned only if it joins two components within the task, so a task
    returns fewer links than it has members.
    """
    share = percent / 100
    least = share - 5 * (share * (1 - share) / SKETCH) ** 0.5
    members = texts.join(open_rows.select("node").distinct(), "node", "left_semi")
    sketches = keep(_sketches(members, scheme))
    sizes = open_rows.join(sketches.select("node", F.octet_length("prints").alias("bytes")), "node")
    parts = sizes.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    buckets = parts.groupBy("key").agg(
        F.max_by("root", F.struct("n", "root")).alias("main"),
        *(F.sum(c).alias(f"all_{c}") for c in ("n", "bytes")),
        *((F.sum(c) - F.max_by(c, F.struct("n", "root"))).alias(f"few_{c}") for c in ("n", "bytes")),
    )

    def blocks(which: str) -> Column:
        by_rows, by_bytes = F.col(f"{which}_n") / BLOCK, F.col(f"{which}_bytes") / BLOCK_BYTES
        return F.ceil(F.greatest(by_rows, by_bytes)).cast("int")

    buckets = buckets.select("key", "main", blocks("few").alias("rows"), blocks("all").alias("columns"))
    at = open_rows.join(keep(buckets), "key")

    def dealt(n: str) -> Column:
        return F.pmod(F.xxhash64("node"), F.col(n)).cast("int")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    few = at.where("root <> main").withColumn("i", dealt("rows")).withColumn("j", every("columns"))
    many = at.withColumn("j", dealt("columns")).withColumn("i", every("rows"))
    names = ["key", "i", "j", "node", "root", "main"]
    both = few.withColumn("few", F.lit(True)).select(*names, "few").unionByName(
        many.withColumn("few", F.lit(False)).select(*names, "few")
    )
    both = both.join(sketches, "node")
    both = both.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
    kind = open_rows.schema["node"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in runs_of(batches, ["key", "i", "j"]):
            a, b = spanning_links(group, least, percent)
            yield pd.DataFrame({"a": a, "b": b})

    return both.mapInPandas(run, f"a {kind}, b {kind}")


def spanning_links(group: pd.DataFrame, least: float, percent: int) -> tuple[list, list]:
    """Links between ``few`` and other rows of different roots, without those that join nothing new."""
    few = group["few"].to_numpy()
    node, root = group["node"].to_numpy(), group["root"].to_numpy()
    sketch = np.frombuffer(b"".join(group["sketch"]), np.uint8).reshape(len(group), -1)
    prints = [np.frombuffer(p, np.uint64) for p in group["prints"]]
    size = np.fromiter(map(len, prints), np.int64, len(group))
    names, part = np.unique(root, return_inverse=True)
    others, sketches = np.flatnonzero(~few), sketch[~few]
    from_few = (root != group["main"].to_numpy())[others]
    out_a, out_b = [], []
    for x in np.flatnonzero(few):
        small, large = np.minimum(size[others], size[x]), np.maximum(size[others], size[x])
        # a pair of two of the few meets in both orders of their blocks: look at it once
        fit = (part[others] != part[x]) & (100 * small >= percent * large) & (~from_few | (node[others] < node[x]))
        fit[fit] = (sketches[fit] == sketch[x]).mean(axis=1) >= least
        for y in others[fit]:
            if part[x] == part[y]:
                continue
            shared = len(np.intersect1d(prints[x], prints[y], assume_unique=True))
            if 100 * shared >= percent * (size[x] + size[y] - shared):
                part[part == part[y]] = part[x]
                out_a.append(max(node[x], node[y]))
                out_b.append(min(node[x], node[y]))
    return out_a, out_b


def runs_of(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Runs of equal ``by`` in sorted batches; a run may cross batches."""
    held = None
    for batch in batches:
        if held is not None:
            batch = pd.concat([held, batch], ignore_index=True)
        if not len(batch):
            continue
        key = batch[by]
        starts = np.flatnonzero((key != key.shift()).any(axis=1).to_numpy())
        for start, end in zip(starts, starts[1:]):
            yield batch.iloc[start:end]
        held = batch.iloc[starts[-1] :]
    if held is not None and len(held):
        yield held
