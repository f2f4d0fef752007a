"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line is described by its own statistics and those of its
neighbours; the chain adds how likely good follows good. A document's score is the mean
probability of good over its lines, by forward-backward, weighted with their lengths.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsprep.llm.common import column, id_and_text

#: Labelled documents that the model is fitted on, chosen by a hash of their id.
SAMPLE_DOCS = 3_000
#: Documents with more lines stay out of the sample, which is held by the driver.
SAMPLE_LINES = 2_000
THRESHOLD = 0.7
#: Added to the length of a line where lengths are weights, so that empty lines have some.
WEIGHT = 1.0

_CLASSES = 8  # of bytes: see _CLASS_OF


def _class_table() -> np.ndarray:
    kind = np.full(256, 6, np.uint8)  # other signs
    kind[ord("a") : ord("z") + 1] = 0
    kind[128:] = 0  # bytes of letters outside ASCII
    kind[ord("A") : ord("Z") + 1] = 1
    kind[ord("0") : ord("9") + 1] = 2
    kind[[ord(c) for c in " \t\r\v\f\n"]] = 3
    kind[[ord(c) for c in ".,;:'\"-()?"]] = 4
    kind[ord("!")] = 5
    kind[ord("|")] = 7
    return kind


_CLASS_OF = _class_table()
OWN = _CLASSES + 4
#: Of a line and of the lines before and after it, with flags for the ends, and the constant.
FEATURES = 3 * OWN + 3


def line_statistics(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and byte length of every line of a text; an empty text has one line."""
    lines = text.split("\n")
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass") + b"\n", np.uint8)
    ends = np.flatnonzero(raw == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = ends - starts
    kinds = _CLASS_OF[raw]
    own = np.zeros((len(lines), OWN), np.float32)
    per_byte = 1 / (size + 16)  # shares of a few bytes say little
    for k in range(_CLASSES):
        share = np.add.reduceat(kinds == k, starts, dtype=np.int64) - (k == 3)  # less the line's end
        own[:, k] = share * per_byte
    for i, line in enumerate(lines):
        words = line.split()
        n = len(words)
        own[i, _CLASSES] = (len(set(words)) + 4) / (n + 4)
        own[i, _CLASSES + 1] = sum(map(str.__eq__, words, words[1:])) / (n + 4)
        own[i, _CLASSES + 2] = min(size[i] / max(n, 1), 40) / 10
    own[:, _CLASSES + 3] = np.log1p(size) / 8
    return own, size


def with_neighbours(own: np.ndarray) -> np.ndarray:
    out = np.zeros((len(own), FEATURES), np.float32)
    out[:, :OWN] = own
    out[1:, OWN : 2 * OWN] = own[:-1]
    out[:-1, 2 * OWN : 3 * OWN] = own[1:]
    out[0, 3 * OWN] = 1
    out[-1, 3 * OWN + 1] = 1
    out[:, 3 * OWN + 2] = 1
    return out


def marginals(emit: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Probabilities of the states of each line and of each pair of neighbours, and log Z."""
    n = len(emit)
    ahead, back = np.empty((n, 2)), np.zeros((n, 2))
    scale = np.empty(n)
    force = np.exp(move)
    step = np.exp(emit - emit.max(axis=1, keepdims=True))
    row = step[0]
    for t in range(n):
        if t:
            row = (ahead[t - 1] @ force) * step[t]
        scale[t] = row.sum()
        ahead[t] = row / scale[t]
    back[-1] = 1
    for t in range(n - 2, -1, -1):
        back[t] = force @ (step[t + 1] * back[t + 1]) / scale[t + 1]
    pairs = (
        ahead[:-1, :, None]
        * force
        * (step[1:] * back[1:] / scale[1:, None])[:, None, :]
    )
    return ahead * back, pairs, float(np.log(scale).sum() + emit.max(axis=1).sum())


@dataclass
class Chain:
    """Weights of the state "good" over "bad", and of the moves between the two."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    move: np.ndarray

    def good(self, own: np.ndarray) -> np.ndarray:
        x = (with_neighbours(own) - self.mean) / self.spread
        emit = np.zeros((len(x), 2))
        emit[:, 1] = x @ self.weights
        return marginals(emit, self.move)[0][:, 1]

    def score(self, text: str) -> float:
        own, size = line_statistics(text)
        weight = size + WEIGHT
        return float(np.clip(self.good(own) @ weight / weight.sum(), 0, 1))


def fit_chain(documents: list[np.ndarray], labels: list[int], rounds: int = 120) -> Chain:
    """Maximise the likelihood of the labels, that of a document being that of all its lines.

    Every document weighs the same, however many lines it has. Adam over all documents; without
    any document the chain says 0.5.
    """
    if not documents:
        flat = np.zeros(FEATURES)
        return Chain(flat, np.ones(FEATURES), flat, np.zeros((2, 2)))
    x = np.concatenate([with_neighbours(d) for d in documents]).astype(np.float64)
    mean, spread = x.mean(axis=0), x.std(axis=0)
    mean[-1], spread[spread < 1e-6] = 0, 1
    x = (x - mean) / spread
    sizes = np.array([len(d) for d in documents])
    order = np.argsort(-sizes, kind="stable")
    sizes, y = sizes[order], np.array(labels)[order]
    starts = np.concatenate([[0], np.cumsum([len(d) for d in documents])[:-1]])[order]
    # documents by falling size: those with a line t are the first live[t] ones
    live = np.array([(sizes > t).sum() for t in range(sizes[0])])
    theta = np.zeros(FEATURES + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    share = 1 / (len(sizes) * sizes)
    for step in range(1, rounds + 1):
        emit = x @ theta[:FEATURES]
        gradient = _gradient(x, emit, theta[FEATURES:].reshape(2, 2), starts, sizes, live, y, share)
        gradient -= 1e-4 * theta
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        theta += 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Chain(mean, spread, theta[:FEATURES], theta[FEATURES:].reshape(2, 2))


def _gradient(x, emit, move, starts, sizes, live, y, share) -> np.ndarray:
    """Of the mean log-likelihood: seen less expected features and moves, for all chains at once."""
    longest = sizes[0]
    force = np.exp(move)
    ahead, step, scale = [], [], []
    for t in range(longest):
        k = live[t]
        e = emit[starts[:k] + t]
        s = np.exp(np.stack([np.zeros(k), e], axis=1) - np.maximum(e, 0)[:, None])
        row = s if t == 0 else (ahead[t - 1][:k] @ force) * s
        total = row.sum(axis=1, keepdims=True)
        ahead.append(row / total)
        step.append(s)
        scale.append(total)
    expected = np.zeros(len(x))
    seen = np.zeros(len(x))
    moves = np.zeros((2, 2))
    back = np.ones((live[-1], 2))
    for t in range(longest - 1, -1, -1):
        k = live[t]
        if t < longest - 1:
            j = live[t + 1]
            onward = step[t + 1] * back[:j] / scale[t + 1]
            both = ahead[t][:j, :, None] * force * onward[:, None, :]
            moves -= (both * share[:j, None, None]).sum(axis=0)
            same = np.bincount(y[:j], weights=share[:j], minlength=2)
            moves += np.diag(same)
            now = np.ones((k, 2))
            now[:j] = onward @ force.T
            back = now
        at = starts[:k] + t
        expected[at] = (ahead[t] * back)[:, 1] * share[:k]
        seen[at] = y[:k] * share[:k]
    return np.concatenate([x.T @ (seen - expected), moves.ravel()])


def training_rows(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample_docs: int
) -> DataFrame:
    """``label, n, own``: the line statistics of a bounded sample of labelled documents.

    Rows whose ``crc32(id as text) mod 4`` is 2 never take part, nor do NULL ids or labels.
    """
    known = labels.select(column(id_col).alias("_id"), column(label_col).cast("int").alias("label"))
    known = known.where(F.col("label").isin(0, 1) & ~held_out(F.col("_id")))
    known = known.groupBy("_id").agg(F.max("label").alias("label"))
    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(sample_docs)
    texts = id_and_text(docs, id_col, text_col)
    rows = texts.join(F.broadcast(sample), texts["doc_id"] == sample["_id"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [line_statistics(t)[0] for t in batch["text"]]
            out = pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"]})
            out["n"] = [len(f) for f in found]
            out["own"] = [f.tobytes() for f in found]
            yield out[out["n"] <= SAMPLE_LINES]

    kind = texts.schema["doc_id"].dataType.simpleString()
    columns = f"doc_id {kind}, label int, n int, own binary"
    return rows.select("doc_id", "text", "label").mapInPandas(run, columns)


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample_docs: int = SAMPLE_DOCS,
) -> Chain:
    """Fit the chain on at most ``sample_docs`` labelled documents."""
    rows = training_rows(docs, labels, id_col, text_col, label_col, sample_docs).toPandas()
    rows = rows.sort_values(["doc_id", "label"], kind="stable")
    documents = [np.frombuffer(b, np.float32).reshape(n, OWN) for b, n in zip(rows["own"], rows["n"])]
    return fit_chain(documents, list(rows["label"]))


def quality_score(chain: Chain):
    """The score of a text column, as a vectorised function; NULL scores as the empty text."""

    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([chain.score(t or "") for t in texts], dtype="float64")

    return F.pandas_udf(score, "double")


def score_quality(
    docs: DataFrame,
    chain: Chain,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    Whole texts are scored; NULL counts as empty, and an empty text is one empty line. The
    score looks at nothing but the text, so repeated rows score alike. ``held_out`` of a NULL id
    is false.
    """
    texts = id_and_text(docs, id_col, text_col)
    return texts.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        quality_score(chain)("text").alias("score"),
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
