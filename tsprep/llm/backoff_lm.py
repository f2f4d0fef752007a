"""Documents scored by an n-gram model with stupid backoff.

A word given those before it scores its n-gram's share among the n-grams of the words before; if the
corpus holds the n-gram less than ``min_count`` times, ``alpha`` times the score by one word less, down
to the word's own share. All words count, unless a vocabulary bounds them: then the others are one
unknown word. N-grams are keyed by their words' numbers.

Pairs move once. A task cuts its texts with Arrow and scores what the bounded tables answer: words with
a number, and pairs of the most frequent ones. The other pairs go, packed by bucket, to where all
occurrences of a pair meet: a pair of numbered words by itself, one with a rare word by that word, whose own
count then follows from the same rows, and one of two rare words by either, each adding the part that it
knows. Sums by document come back. Longer n-grams are exploded, meet their counts hashed by their words'
numbers and are summed by document.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tsprep.llm.common import Memo, id_and_text, whole_text
from tsprep.llm.minhash import words
from tsprep.session import keep

#: Words that get small numbers and whose counts every task gets; rarer ones are met by shuffle.
NUMBERED = 65_536
#: N-grams of this many most frequent words (fewer above order 2) are counted in one bounded table
#: that every task gets; any other pair makes up less than 1 / FREQUENT of all pairs, so no key is hot.
FREQUENT = 512
ALPHA = 0.4
MIN_COUNT = 2
#: Bytes of text that are cut into words at once.
TEXT_BYTES = 4 * 2**20
#: Words of all texts for each bucket of pairs, and the fewest buckets; a bucket is counted at once.
BUCKET_WORDS, BUCKETS = 2**20, 64
#: What a row of packed numbers holds: what its task scored, pairs of numbered words, pairs with a rare
#: word, pairs with a rare word before.
SCORED, NUMBERS, RARE, RARE_BEFORE = range(4)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows that follow one another with about ``TEXT_BYTES`` of text."""
    ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False), dtype=np.int64)
    cuts = np.flatnonzero(np.diff(ends // TEXT_BYTES, prepend=0))
    for start, end in zip([0, *cuts], [*cuts, len(batch)]):
        if end > start:
            yield batch.slice(start, end - start)


def _cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts one after another, and the position of each one's text."""
    found = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, at = found.flatten(), pc.list_parent_indices(found)
    full = pc.not_equal(flat, "")
    return flat.filter(full), at.filter(full).to_numpy()


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``word, n`` over all documents; words lie between 0x20 and 0x09-0x0D, A-Z in lower case."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                parts = (_cut(part.column("text"))[0].value_counts() for part in _slices(batch))
                found = pa.concat_tables(pa.table(p.flatten(), ["word", "n"]) for p in parts)
                found = found.group_by("word", use_threads=False).aggregate([("n", "sum")])
                yield from found.rename_columns(["word", "n"]).to_batches()

    texts = docs.select(whole_text(text_col).alias("text"))
    found = texts.mapInArrow(run, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most: int) -> list[Row]:
    """Words and counts of the highest classes of frequency that hold at most ``most`` words, falling.

    Classes are fine steps of the logarithm, so the driver gets one number a class, then only the words
    that are taken.
    """
    stepped = counts.withColumn("step", F.floor(F.log2("n") * 16).cast("int"))
    sizes = {r["step"]: r["n"] for r in stepped.groupBy("step").agg(F.count("*").alias("n")).collect()}
    taken, least = 0, None
    for step in sorted(sizes, reverse=True):
        if taken + sizes[step] > most:
            break
        taken, least = taken + sizes[step], step
    if least is None:
        return []
    found = stepped.where(F.col("step") >= least).select("word", "n").collect()
    return sorted(found, key=lambda r: (-r["n"], r["word"]))


def _hashed(word: bytes) -> int:
    """A negative number of 63 bits; two words share one with probability 2**-63."""
    return -1 - (int.from_bytes(blake2b(word, digest_size=8).digest(), "little") >> 1)


class Words:
    """Numbers frequent words by falling frequency from 1 on; others by hash, or all 0 (unknown)."""

    def __init__(self, frequent: list[str], whole: bool):
        self.number = {w.encode("utf-8"): i for i, w in enumerate(frequent, 1)}
        self.size = len(frequent) + 1
        self.whole = whole
        self.other = Memo(_hashed)

    def numbers(self, text: str) -> np.ndarray:
        parts = words(text)
        get = self.number.get
        if not self.whole:
            return np.fromiter((get(w, 0) for w in parts), np.int64, len(parts))
        other = self.other
        return np.fromiter((get(w) or other[w] for w in parts), np.int64, len(parts))

    def grams(self, x: np.ndarray, order: int) -> tuple[list[np.ndarray], np.ndarray]:
        """Each distinct run of words up to every word, the last word first, and how often it is there.

        Where a text has not begun yet, ``size`` stands for the word.
        """
        y = np.concatenate([np.full(order - 1, self.size), x])
        if self.whole:
            ids = np.unique(y, return_inverse=True)[1]
            base = int(ids.max()) + 1
        else:
            ids, base = y, self.size + 1
        key = ids[: len(x)]
        for j in range(1, order):
            if j > 1:  # numbered anew, so that keys of any order fit
                key = np.unique(key, return_inverse=True)[1]
            key = key * base + ids[j : j + len(x)]
        _, at, n = np.unique(key, return_index=True, return_counts=True)
        return [y[at + order - 1 - j] for j in range(order)], n


def _names(order: int) -> list[str]:
    """``c0`` is the word, ``c1`` the one before it, and so on."""
    return [f"c{j}" for j in range(order)]


def _frequent_grams(texts: DataFrame, model: Words, order: int, few: int) -> DataFrame:
    """``c0, ..., n`` of n-grams of the unknown and the most frequent words, counted in each batch first."""
    names = _names(order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            total = np.zeros(few**order, np.int64)
            for text in batch["text"]:
                x = model.numbers(text)
                if len(x) < order:
                    continue
                all_, key = np.ones(len(x) - order + 1, bool), np.zeros(len(x) - order + 1, np.int64)
                for j in range(order):
                    part = x[j : len(x) - order + 1 + j]
                    all_ &= (part >= 0) & (part < few)
                    key = key * few + part
                total += np.bincount(key[all_], minlength=len(total))
            seen = np.flatnonzero(total)
            columns = {c: seen // few**j % few for j, c in enumerate(names)}
            yield pd.DataFrame(columns | {"n": total[seen]})

    counted = texts.mapInPandas(run, ", ".join(f"{c} bigint" for c in [*names, "n"]))
    return counted.groupBy(*names).agg(F.sum("n").alias("n"))


def _exploded(texts: DataFrame, model: Words, order: int) -> DataFrame:
    """``doc, c0, ..., m``: how often each document holds each n-gram, shorter ones at its start."""
    names = _names(order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 500):
                docs, parts, times = [], [[] for _ in names], []
                some = batch.iloc[start : start + 500]
                for doc, text in zip(some["doc"], some["text"]):
                    x = model.numbers(text)
                    if not len(x):
                        continue
                    found, n = model.grams(x, order)
                    docs.append(np.full(len(n), doc))
                    times.append(n)
                    for part, column in zip(parts, found):
                        part.append(column)
                if docs:
                    columns = {c: np.concatenate(p) for c, p in zip(names, parts)}
                    yield pd.DataFrame(
                        {"doc": np.concatenate(docs), **columns, "m": np.concatenate(times)}
                    )

    return texts.mapInPandas(run, "doc bigint, " + ", ".join(f"{c} bigint" for c in [*names, "m"]))


def _all_below(names: list[str], most: int) -> Column:
    out = F.lit(True)
    for c in names:
        out = out & F.col(c).between(0, most - 1)
    return out


def _met(rows: DataFrame, names: list[str], near: DataFrame, far: DataFrame | None, is_near: Column) -> DataFrame:
    """``rows`` with ``n`` of the words in ``names``, from the bounded table where ``is_near``."""
    if far is None:
        return rows.join(F.broadcast(near), names)
    met = rows.where(is_near).join(F.broadcast(near), names)
    return met.unionByName(rows.where(~is_near).join(far, names))


def _packed(x: np.ndarray) -> bytes:
    """Eight bytes a number, all first bytes first: those that are mostly equal compress to nearly nothing."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(parts: pa.ChunkedArray, at: np.ndarray, summed: bool = False) -> np.ndarray:
    """The numbers of some rows, one row's after the other's; each row's sums so far if ``summed``."""
    found = [np.zeros(0, np.int64)]
    for i in at:
        x = np.frombuffer(parts[int(i)].as_buffer(), np.uint8).reshape(8, -1).T.copy().view(np.int64).ravel()
        found.append(np.cumsum(x) if summed else x)
    return np.concatenate(found)


def _times(key: np.ndarray) -> np.ndarray:
    """How often each entry is there."""
    codes = pd.factorize(key)[0]
    return np.bincount(codes)[codes]


class Pairs:
    """Scores of words after the one before, in the task of a text and in that of a bucket of pairs.

    The text's task scores each word as if its pair were not found, except for the count of a word without
    number; the bucket's task adds the difference.
    """

    def __init__(self, top: list[str], counts: list[int], total: int, whole: bool, alpha: float, min_count: int):
        self.top = pa.array(top, pa.string())
        #: also stands for the word before a text's first
        self.size = len(top) + 1
        self.whole, self.min_count = whole, min_count
        counts = np.array([total - sum(counts), *counts, 1], np.int64)
        self.log_n = np.log(np.maximum(counts, 1))
        self.log_total, self.log_alpha = np.log(max(total, 1)), np.log(alpha)
        self.buckets = max(BUCKETS, total // BUCKET_WORDS)

    def known(self, words: pa.Array) -> np.ndarray:
        """Numbers from 1 on; 0 for the other words."""
        at = pc.index_in(words, value_set=self.top.cast(words.type))
        return pc.fill_null(at, -1).to_numpy().astype(np.int64) + 1

    def numbers(self, words: pa.Array) -> np.ndarray:
        """The other words by hash, as negative numbers of 63 bits, if all words count."""
        if not self.whole:
            return self.known(words)
        found = words.dictionary_encode()
        number = self.known(found.dictionary)
        rare = number == 0
        names = found.dictionary.filter(pa.array(rare)).cast(pa.binary()).to_numpy(zero_copy_only=False)
        hashes = pd.util.hash_array(names, categorize=False)
        number[rare] = -1 - (hashes >> np.uint64(1)).astype(np.int64)
        return number[found.indices.to_numpy()]

    def hot_counts(self, texts: DataFrame, few: int) -> np.ndarray:
        """How often each pair of numbers below ``few`` is there, at ``before * few + word``."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = np.zeros(few * few, np.int64)
            for batch in batches:
                for part in _slices(batch):
                    words, at = _cut(part.column("text"))
                    x = self.known(words)
                    if self.whole:
                        x[x == 0] = few
                    two = (x[1:] < few) & (x[:-1] < few) & (at[1:] == at[:-1])
                    counts += np.bincount((x[:-1] * few + x[1:])[two], minlength=len(counts))
            seen = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], ["pair", "n"])

        found = texts.select("text").mapInArrow(run, "pair bigint, n bigint")
        found = found.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
        out = np.zeros(few * few, np.int64)
        out[found["pair"].to_numpy()] = found["n"].to_numpy()
        return out

    def rows(self, part: pa.RecordBatch, order: int, hot: np.ndarray, few: int) -> Iterator[tuple]:
        """``bucket, kind, doc, word, before, score`` of some texts, packed."""
        doc = part.column("doc").to_numpy(zero_copy_only=False)
        words, at = _cut(part.column("text"))
        word = self.numbers(words)
        del words
        first = np.ones(len(word), bool)
        before = np.full(len(word), self.size)
        if order > 1:
            first[1:] = at[1:] != at[:-1]
            before[1:] = word[:-1]
            before[first] = self.size
        known, known_before = word >= 0, before >= 0
        score = self.log_n[np.where(known, word, self.size)]  # 0 for rare ones
        score += np.where(first, 0.0, self.log_alpha) - self.log_total
        is_hot = known & (word < few) & known_before & (before < few)
        i = np.flatnonzero(is_hot)
        n = hot[before[i] * few + word[i]]
        i, n = i[n >= self.min_count], n[n >= self.min_count]
        score[i] = np.log(n) - self.log_n[before[i]]

        sums = np.bincount(at, score, len(doc)).astype(np.float64)  # whole numbers if there are no words
        n_words, n_unknown = np.bincount(at, minlength=len(doc)), np.bincount(at[word == 0], minlength=len(doc))
        ids = np.diff(doc, prepend=0)
        yield int(doc[0] % self.buckets), SCORED, _packed(ids), _packed(n_words), _packed(n_unknown), _packed(sums)

        del score
        for kind, some in (
            (NUMBERS, known & known_before & ~first & ~is_hot),
            (RARE, ~known),
            (RARE_BEFORE, ~known_before),
        ):
            i = np.flatnonzero(some)
            bucket = self._bucket(kind, word[i], before[i])
            # numbers of 16 bits are sorted by counting
            by_bucket = np.argsort(bucket.astype(np.uint16 if self.buckets < 2**16 else np.int64), kind="stable")
            i, bucket = i[by_bucket], bucket[by_bucket]
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            for start, end in zip(cuts, [*cuts[1:], len(i)]):
                j = i[start:end]
                ids = np.diff(doc[at[j]], prepend=0)
                yield int(bucket[start]), kind, _packed(ids), _packed(word[j]), _packed(before[j]), b""

    def _bucket(self, kind: int, word: np.ndarray, before: np.ndarray) -> np.ndarray:
        if kind == RARE:
            return word % self.buckets
        if kind == RARE_BEFORE:
            return before % self.buckets
        pair = self._pair(word, before).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (pair >> np.uint64(32)).astype(np.int64) % self.buckets

    def _pair(self, word: np.ndarray, before: np.ndarray) -> np.ndarray:
        return before * (self.size + 1) + word

    def scores(self, rows: pa.Table) -> pa.Table:
        """``doc, score, n_words, n_unknown`` of one bucket."""
        kinds = rows["kind"].to_numpy()
        docs, words, befores = {}, {}, {}
        for kind in range(4):
            at = np.flatnonzero(kinds == kind)
            docs[kind], words[kind], befores[kind] = (
                _unpacked(rows[c], at, summed=c == "doc") for c in ("doc", "word", "before")
            )
            if kind == SCORED:
                scored = _unpacked(rows["score"], at).view(np.float64)
        found, more = [], []

        word, before = words[NUMBERS], befores[NUMBERS]
        n = _times(self._pair(word, before))
        i = n >= self.min_count
        found.append(docs[NUMBERS][i])
        more.append(np.log(n[i]) - self._unless_found(word[i]) - self.log_n[before[i]])

        # each occurrence of a rare word is a row of RARE, so these rows tell its count
        owner, of_owner = pd.factorize(np.concatenate([words[RARE], befores[RARE_BEFORE]]))
        own, own_before = owner[: len(words[RARE])], owner[len(words[RARE]) :]
        log_own = np.log(np.maximum(np.bincount(own, minlength=len(of_owner)), 1))

        before = befores[RARE]
        n = self._times_with(own, before)
        log_before = self.log_n[np.where(before >= 0, before, self.size)]  # 0 for rare ones
        up = np.log(n) - log_before - self.log_alpha + self.log_total
        is_found = (n >= self.min_count) & (before != self.size)
        found.append(docs[RARE])
        more.append(np.where(is_found, up, log_own[own]))

        word = words[RARE_BEFORE]
        n = self._times_with(own_before, word)
        i = n >= self.min_count
        word, n = word[i], n[i]
        up = np.where(word >= 0, np.log(n) - self._unless_found(np.where(word >= 0, word, 0)), 0.0)
        found.append(docs[RARE_BEFORE][i])
        more.append(up - log_own[own_before[i]])

        at, ids = pd.factorize(np.concatenate([docs[SCORED], *found]))
        here = at[: len(scored)]
        columns = {
            "doc": ids,
            "score": np.bincount(at, np.concatenate([scored, *more]), len(ids)).astype(np.float64),
            "n_words": np.bincount(here, words[SCORED], len(ids)).astype(np.int64),
            "n_unknown": np.bincount(here, befores[SCORED], len(ids)).astype(np.int64),
        }
        return pa.table(columns)

    def _unless_found(self, word: np.ndarray) -> np.ndarray:
        return self.log_alpha + self.log_n[word] - self.log_total

    @staticmethod
    def _times_with(owner: np.ndarray, other: np.ndarray) -> np.ndarray:
        codes, of_codes = pd.factorize(other)
        return _times(owner * (len(of_codes) + 1) + codes)


def _pair_scores(texts: DataFrame, pairs: Pairs, order: int, few: int) -> DataFrame:
    """``doc, score, n_words, n_unknown`` of every document by pairs, or by single words."""
    # ids travel as plain numbers, so a missing one gets a number that is not there
    low, high = texts.agg(F.min("doc"), F.max("doc")).first()
    absent = 0 if high is None else high + 1 if high < 2**63 - 1 else low - 1
    texts = texts.select(F.coalesce("doc", F.lit(absent).cast("bigint")).alias("doc"), "text")
    hot = pairs.hot_counts(texts, few) if order > 1 else np.zeros(few * few, np.int64)
    names = ["bucket", "kind", "doc", "word", "before", "score"]
    types = [pa.int32(), pa.int32(), *[pa.binary()] * 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                columns = zip(*pairs.rows(part, order, hot, few))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    dealt = texts.mapInArrow(
        run, "bucket int, kind int, doc binary, word binary, before binary, score binary"
    )
    met = dealt.groupBy("bucket").applyInArrow(
        lambda rows: pairs.scores(rows), "doc bigint, score double, n_words bigint, n_unknown bigint"
    )
    sums = met.groupBy("doc").agg(*(F.sum(c).alias(c) for c in ("score", "n_words", "n_unknown")))
    return sums.withColumn("doc", F.nullif("doc", F.lit(absent).cast("bigint")))


def backoff_scores(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: int | None = None,
    alpha: float = ALPHA,
    min_count: int = MIN_COUNT,
    frequent: int = FREQUENT,
    order: int = 2,
    numbered: int = NUMBERED,
) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_unknown, log_score, mean_log_score``.

    The model is counted on all documents, the scored ones, for n-grams of up to ``order`` words. All
    words count; given ``vocabulary``, only so many most frequent ones (ties in alphabetical order)
    and the rest as one. A text without words, or NULL, scores 0 with a mean of NULL.
    Ids must be whole numbers; rows that share an id are scored as one document.
    """
    if order < 1:
        raise ValueError("order must be at least 1")
    texts = id_and_text(docs, id_col, text_col).select(F.col("doc_id").cast("bigint").alias("doc"), "text")
    counts = keep(word_counts(docs, text_col))
    total = counts.agg(F.sum("n")).first()[0] or 0
    whole = vocabulary is None
    if whole:
        top = frequent_words(counts, numbered)
    else:
        top = counts.orderBy(F.desc("n"), "word").limit(vocabulary).collect()
    top, known = [r["word"] for r in top], [r["n"] for r in top]
    few = min(frequent, len(top) + 1, max(1, int(2 ** (18 / order))))
    if order <= 2:
        sums = _pair_scores(texts, Pairs(top, known, total, whole, alpha, min_count), order, few)
    else:
        one = docs.sparkSession.createDataFrame(
            list(enumerate([total - sum(known), *known])), "c0 bigint, n bigint"
        )
        model = Words(top, whole)
        rest = _rare(counts, model) if whole else None
        sums = _gram_scores(texts, model, one, rest, total, alpha, min_count, few, order)
    n = F.coalesce("n_words", F.lit(0))
    score = F.coalesce("score", F.lit(0.0))
    return sums.select(
        F.col("doc").alias("doc_id"),
        n.alias("n_words"),
        F.coalesce("n_unknown", F.lit(0)).alias("n_unknown"),
        score.alias("log_score"),
        F.when(n > 0, score / n).alias("mean_log_score"),
    )


def _gram_scores(
    texts: DataFrame,
    model: Words,
    one: DataFrame,
    rest: DataFrame | None,
    total: int,
    alpha: float,
    min_count: int,
    few: int,
    order: int,
) -> DataFrame:
    """``doc, score, n_words, n_unknown`` of every document by n-grams of at least three words."""
    # x is a row's score so far; of is_context rows only the count of c0, ... is still to be divided by
    every = _exploded(texts, model, order).withColumns({"x": F.lit(0.0), "is_context": F.lit(False)})
    unknown = F.when(F.col("c0") == 0, F.col("m")).otherwise(0)
    # rows whose words are all numbered, and the others
    near, far, done = None, None, []
    for k in range(order, 1, -1):
        names = _names(k)
        # a text's first words have shorter n-grams, which wait for their turn
        waits = F.col(names[-1]) == model.size
        frequent_only = _all_below(names, few)
        if k == order:
            hot = F.broadcast(keep(_frequent_grams(texts, model, k, few)))
            at_once = frequent_only | waits & (F.col("c0") >= 0)
            near = every.where(at_once).join(hot, names, "left").withColumn("unknown", unknown)
            by_words = F.sum("m").over(Window.partitionBy(*names))
            far = every.where(~at_once).withColumn("n", by_words).withColumn("unknown", unknown)
        else:
            table = _exploded(texts, model, k).where(~waits)
            table = keep(table.groupBy(*names).agg(F.sum("m").alias("n")))
            rows = keep(near.unionByName(far))
            met = _met(rows.where(~waits), names, table.where(frequent_only), table.where(~frequent_only), frequent_only)
            begun = rows.where(waits).withColumn("n", F.lit(None).cast("bigint"))
            ended = met.where("is_context").withColumn("x", F.col("x") - F.log("n"))
            done.append(ended.select("doc", "m", "unknown", "x"))
            near, far = begun, met.where("NOT is_context")
        found = ~waits & (F.col("n") >= min_count)
        x = F.col("x") + F.when(waits, 0.0).when(found, F.log("n")).otherwise(F.log(F.lit(alpha)))
        left = [F.when(found, F.col(f"c{j + 1}")).otherwise(F.col(f"c{j}")).alias(f"c{j}") for j in range(k - 1)]
        near, far = (
            rows.select("doc", "m", "unknown", x.alias("x"), found.alias("is_context"), *left)
            for rows in (near, far)
        )
    numbered_only = F.col("c0") >= 0
    rows = keep(near.unionByName(far))
    met = _met(rows, ["c0"], one, rest, numbered_only)
    share = F.log(F.col("n") / F.lit(float(total)))
    x = F.col("x") + F.when(F.col("is_context"), -F.log("n")).otherwise(share)
    done.append(met.select("doc", "m", "unknown", x.alias("x")))
    scored = done[0]
    for more in done[1:]:
        scored = scored.unionByName(more)
    sums = scored.groupBy("doc").agg(
        F.sum(F.col("x") * F.col("m")).alias("score"),
        F.sum("m").alias("n_words"),
        F.sum("unknown").alias("n_unknown"),
    )
    everyone = texts.select(F.col("doc").alias("id")).distinct()
    out = everyone.join(sums, everyone["id"].eqNullSafe(sums["doc"]), "left")
    return out.select(F.col("id").alias("doc"), "score", "n_words", "n_unknown")


def _rare(counts: DataFrame, model: Words) -> DataFrame:
    """``c0, n`` of the words without a small number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = [w.encode("utf-8") for w in batch["word"]]
            c0 = np.fromiter((model.number.get(w) or _hashed(w) for w in keys), np.int64, len(keys))
            yield pd.DataFrame({"c0": c0, "n": batch["n"]})[c0 < 0]

    rare = counts.mapInPandas(run, "c0 bigint, n bigint")
    return rare.groupBy("c0").agg(F.sum("n").alias("n"))
