"""Sequence packing by minimum bin slack.

Documents become runs of token ids. Whole windows are cut off first; what is left of each document
goes to a pool. A window takes the multiset of pool lengths whose sum comes closest to its capacity:
reachable sums are the bits of an integer, one layer for each distinct length, and counts are
read back from the layers.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tsprep.llm.common import id_and_text, latin_words, space_split

CAPACITY = 4096
END_ID = 2
#: Pieces that wait for a window in each task.
POOL = 256
MEMO = 500_000


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length give the largest sum up to ``capacity``."""
    mask, layers, reach = (1 << (capacity + 1)) - 1, [], 1
    for length, count in sorted(counts.items(), reverse=True):
        layers.append((length, count, reach))
        step = 1
        while count:
            take = min(step, count)
            reach |= (reach << (length * take)) & mask
            count, step = count - take, step * 2
        if reach >> capacity:
            break
    total = reach.bit_length() - 1
    chosen = {}
    for length, count, before in reversed(layers):
        n = 0
        while not before >> total & 1:
            total, n = total - length, n + 1
        if n:
            chosen[length] = n
    return chosen


class Packer:
    """Takes documents one by one, gives pieces ``(doc, start, length, crc, doc tokens, window, offset)``."""

    def __init__(self, first_window: int, capacity: int = CAPACITY, pool: int = POOL):
        self.next, self.capacity, self.most = first_window, capacity, pool
        self.pool: dict[int, list[tuple]] = defaultdict(list)
        self.waiting, self.tokens = 0, 0

    def add(self, doc, ids: bytes) -> Iterator[tuple]:
        total = len(ids) // 4
        whole = total - total % self.capacity
        for start in range(0, whole, self.capacity):
            yield self._piece((doc, start, ids[4 * start : 4 * (start + self.capacity)], total), 0)
            self.next += 1
        if total > whole:
            self._wait((doc, whole, ids[4 * whole :], total))
        while self.waiting >= self.most and self.tokens >= self.capacity:
            yield from self._window(self.capacity)

    def finish(self) -> Iterator[tuple]:
        """The rest; windows at the end have a power of two tokens, so they need no padding."""
        while self.tokens:
            size = min(self.capacity, 1 << (self.tokens.bit_length() - 1))
            yield from self._window(size)

    def _wait(self, piece: tuple) -> None:
        size = len(piece[2]) // 4
        self.pool[size].append(piece)
        self.waiting, self.tokens = self.waiting + 1, self.tokens + size

    def _pop(self, size: int) -> tuple:
        piece = self.pool[size].pop()
        if not self.pool[size]:
            del self.pool[size]
        self.waiting, self.tokens = self.waiting - 1, self.tokens - size
        return piece

    def _window(self, size: int) -> Iterator[tuple]:
        """One full window; a slack that no length fits is filled by cutting a piece."""
        offset = 0
        for length, n in fill({k: len(v) for k, v in self.pool.items() if k <= size}, size).items():
            for _ in range(n):
                yield self._piece(self._pop(length), offset)
                offset += length
        if offset < size:
            doc, start, ids, total = self._pop(max(self.pool))
            cut = size - offset
            yield self._piece((doc, start, ids[: 4 * cut], total), offset)
            self._wait((doc, start + cut, ids[4 * cut :], total))
        self.next += 1

    def _piece(self, piece: tuple, offset: int) -> tuple:
        doc, start, ids, total = piece
        return doc, start, len(ids) // 4, zlib.crc32(ids), total, self.next, offset


class WordIds:
    """Little-endian 32-bit ids of a text whose tokenizer drops white space and marks ends of words.

    Ids are remembered by run without white space, and by word.
    """

    def __init__(self, path: str, end_id: int | None, memo: int = MEMO):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.end = b"" if end_id is None else np.uint32(end_id).tobytes()
        self.runs: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        # what was remembered before the last time a half was full; what is met again moves back
        self.older_runs: dict[str, bytes] = {}
        self.older_words: dict[str, bytes] = {}
        self.half = max(1, memo // 2)

    def __call__(self, texts: Iterable[str]) -> Iterator[bytes]:
        for text in texts:
            parts = space_split(text)
            self.learn(parts)
            yield b"".join(map(self.runs.__getitem__, parts)) + self.end

    def learn(self, parts: list[str]) -> None:
        new = set(parts).difference(self.runs)
        if len(self.runs) + len(new) > self.half:
            self.older_runs, self.runs, new = self.runs, {}, set(parts)
        again = new & self.older_runs.keys()
        self.runs.update(zip(again, map(self.older_runs.__getitem__, again)))
        new -= again
        cut = {}
        for run in new:
            found = None if any(t in run for t in self.special) else latin_words(run)
            if found is None:
                ids = self.tokenizer.encode(run, add_special_tokens=False).ids
                self.runs[run] = np.array(ids, "<u4").tobytes()
            else:
                cut[run] = found
        unknown = {w for found in cut.values() for w in found}
        unknown = unknown.difference(self.words)
        if len(self.words) + len(unknown) > self.half:
            self.older_words, self.words = self.words, {}
            unknown = {w for found in cut.values() for w in found}
        again = unknown & self.older_words.keys()
        self.words.update(zip(again, map(self.older_words.__getitem__, again)))
        self._learn_words(list(unknown - again))
        for run, found in cut.items():
            self.runs[run] = b"".join(map(self.words.__getitem__, found))

    def _learn_words(self, words: list[str]) -> None:
        for start in range(0, len(words), 1_000):
            some = words[start : start + 1_000]
            ids = np.array(
                self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, "<u4"
            )
            ends = (np.flatnonzero(self.ends_word[ids]) + 1).tolist()
            raw = ids.tobytes()
            for word, a, b in zip(some, [0, *ends], ends, strict=False):
                self.words[word] = raw[4 * a : 4 * b]


@cache
def word_ids(path: str, end_id: int | None) -> WordIds:
    """One for all tasks of a Python worker."""
    return WordIds(path, end_id)


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = "word_bpe_49k.json",
    capacity: int = CAPACITY,
    end_id: int | None = END_ID,
    pool: int = POOL,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Every id of every document lies in one piece. All sequences hold ``capacity`` tokens, except
    the last few of each task, which hold smaller powers of two; so none is padded.
    A NULL or empty text is its ``end_id`` alone; without one it has no piece. Rows
    that repeat an id are packed each for itself. Tasks pack on their own, in memory bounded by
    ``pool`` pieces, without a shuffle; a lost task gives the same pieces again.
    """
    texts = id_and_text(docs, id_col, text_col)
    kind = texts.schema["doc_id"].dataType
    # as text, ids next to NULLs stay what they are
    texts = texts.withColumn("doc_id", F.col("doc_id").cast("string"))
    path = public_tokenizers.path(tokenizer)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = word_ids(path, end_id)
        packer = Packer(TaskContext.get().partitionId() << 36, capacity, pool)
        for batch in batches:
            ids = encode(batch["text"])
            yield pd.DataFrame(
                [x for doc, i in zip(batch["doc_id"], ids) for x in packer.add(doc, i)],
                columns=names,
            )
        yield pd.DataFrame(list(packer.finish()), columns=names)

    longs = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    packed = texts.mapInPandas(run, f"doc_id string, {longs}, sequence_id bigint, offset bigint")
    return packed.withColumn("doc_id", F.col("doc_id").cast(kind))
