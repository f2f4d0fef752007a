"""Byte-level BPE with a lexicon of frequent words.

The frequent words of the corpus and their ids are compiled into a minimal acyclic transducer:
states with the same continuations are one, and the numbers on a word's path add up to its place in
the list of ids. Tasks map the file into memory. Words it lacks are merged pair by pair, so
ids are those of the tokenizer whatever the lexicon holds.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import re
import struct
import uuid
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import regex
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsprep.llm.common import SPACE, SPACED_RUN, Memo, id_and_text, whole_text
from tsprep.session import keep, shared_folder

#: Words in the lexicon; more of them only save merging.
LEXICON = 20_000
LONGEST_WORD = 40
#: Texts between spaces, and words, that a Python worker remembers: about 200 MB.
MEMO = 800_000
WORD_MEMO = 200_000

# Fixed value: how byte-level tokenizers of this kind cut text into words.
_WORDS = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
#: Where cutting at single spaces could cut a run of white space.
_UNEVEN = re.compile(f"[{SPACE.replace(' ', '')}] |  ")


def byte_letters() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, spare = [], 256
    for byte in range(256):
        letters.append(chr(byte if byte in plain else spare))
        spare += byte not in plain
    return letters


class Merger:
    """Exact byte-pair merging by the tokenizer's rules."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.base = [vocab[c] for c in byte_letters()]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for i, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.rank.setdefault((vocab[a], vocab[b]), (i, vocab[a + b]))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        of = {c: i for i, c in enumerate(byte_letters())}
        raw = {i: bytes(of[c] for c in token) for token, i in vocab.items()}
        raw |= {i: t.encode() for t, i in self.special.items()}
        self.raw = [raw.get(i, b"") for i in range(max(raw) + 1)]
        made = {new: i for i, new in self.rank.values()}
        # Merging any two neighbours that spell a token is the same as merging by the list of
        # pairs if each token comes from one pair and its own symbols merge to it.
        if len(made) == len(self.rank) and all(self._pairwise(self.raw[t]) == [t] for t in made):
            at = {i: n for n, i in enumerate([*self.base, *sorted(made, key=made.get)])}
            self.token = list(at)
            self.quick = tiktoken.Encoding(
                "words", pat_str="(?s).+", special_tokens={},
                mergeable_ranks={self.raw[i]: n for i, n in at.items()},
            )
        else:
            self.quick = None
        names = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None

    def merge(self, word: str) -> list[int]:
        """What merging pair by pair ends with."""
        if self.quick:
            return [self.token[n] for n in self.quick.encode_ordinary(word)]
        return self._pairwise(word.encode("utf-8"))

    def _pairwise(self, word: bytes) -> list[int]:
        """The same by merging the first pair of the lowest rank again and again."""
        parts = [self.base[b] for b in word]
        if len(parts) > 100:
            return self._merge_long(parts)
        get = self.rank.get
        found = [get(p, _NEVER) for p in zip(parts, parts[1:])]
        while found:
            best = min(found)
            if best is _NEVER:
                break
            i = found.index(best)  # the first of equal pairs
            parts[i : i + 2] = [best[1]]
            del found[i]
            if i:
                found[i - 1] = get((parts[i - 1], parts[i]), _NEVER)
            if i < len(found):
                found[i] = get((parts[i], parts[i + 1]), _NEVER)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same with a heap of pairs and links to the neighbours."""
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (found := self.rank.get((parts[i], parts[j]))):
                heapq.heappush(heap, (found[0], i, parts[i], parts[j], found[1]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, left, right, new = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j >= n or parts[j] != right:
                continue
            parts[i], parts[j] = new, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [p for p in parts if p >= 0]

    def encode(self, text: str) -> list[int]:
        """Ids of a text, special strings being one id each."""
        out: list[int] = []
        for piece in self.cut.split(text) if self.cut else [text]:
            if piece in self.special:
                out.append(self.special[piece])
            else:
                for word in _WORDS.findall(piece):
                    out += self.merge(word)
        return out


_NEVER = (1 << 60, -1)
_MARKS = frozenset(".,;:!?")


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The transducer of sorted words as one block: four numbers, then the arrays.

    Words come in order, so once a word leaves a state it never changes again; it is then
    replaced by an equal state if there is one. An edge's number is how many words lie before
    the words that pass it.
    """
    words = sorted(entries)
    known: dict[tuple, int] = {}
    sizes: list[int] = []
    edges: list[list[tuple[int, int]]] = []
    ends: list[bool] = []

    def settle(state: list) -> int:
        key = (state[0], tuple(state[1]))
        if key not in known:
            known[key] = len(edges)
            edges.append(state[1])
            ends.append(state[0])
            sizes.append(state[0] + sum(sizes[t] for _, t in state[1]))
        return known[key]

    path: list[list] = [[False, []]]
    last = b""
    for word in [*words, None]:
        common = 0
        if word is not None:
            while common < min(len(word), len(last)) and word[common] == last[common]:
                common += 1
        for i in range(len(path) - 1, common, -1):
            path[i - 1][1].append((last[i - 1], settle(path.pop())))
        if word is not None:
            path += [[False, []] for _ in word[common:]]
            path[-1][0] = True
            last = word
    root = settle(path[0])
    first, labels, targets, numbers = [0], bytearray(), [], []
    for end, out in zip(ends, edges):
        number = int(end)
        for label, target in out:
            labels.append(label)
            targets.append(target)
            numbers.append(number)
            number += sizes[target]
        first.append(len(labels))
    ids = [entries[w] for w in words]
    where = np.cumsum([0, *map(len, ids)])
    head = [root, len(edges), len(labels), len(words)]
    flat = [head, first, targets, numbers, ends, where, [i for x in ids for i in x]]
    return b"".join(np.array(x, "<u4").tobytes() for x in flat) + bytes(labels)


class Lexicon:
    """Look-ups in a compiled lexicon, mapped from its file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.block = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        self.root, states, edges, words = np.frombuffer(self.block, "<u4", 4).tolist()
        at = 4
        parts = []
        for n in (states + 1, edges, edges, states, words + 1):
            parts.append(memoryview(self.block)[4 * at : 4 * (at + n)].cast("I"))
            at += n
        self.first, self.targets, self.numbers, self.ends, self.where = parts
        self.ids = memoryview(self.block)[4 * at : 4 * (at + self.where[words])].cast("I")
        self.labels = 4 * (at + self.where[words])

    def get(self, word: bytes) -> list[int] | None:
        packed = self.packed(word)
        return None if packed is None else np.frombuffer(packed, "<u4").tolist()

    def packed(self, word: bytes) -> bytes | None:
        """The word's ids as little-endian unsigned 32-bit numbers."""
        state, number, first, labels = self.root, 0, self.first, self.labels
        for i in range(len(word)):
            edge = self.block.find(
                word[i : i + 1], labels + first[state], labels + first[state + 1]
            )
            if edge < 0:
                return None
            edge -= labels
            number += self.numbers[edge]
            state = self.targets[edge]
        if not self.ends[state]:
            return None
        return self.ids[self.where[number] : self.where[number + 1]].tobytes()


def frequent_words(docs: DataFrame, text_col: str, count: int) -> list[str]:
    """Frequent texts between spaces of all documents, at most ``count``.

    Those in the highest classes of frequency that fit. Classes are fine steps of the logarithm, so
    the driver gets one number a class, then only the words that are taken. Words seen once save nothing.
    """
    words = docs.select(F.explode(F.split(whole_text(text_col), " ")).alias("word"))
    words = words.where(F.length("word").between(1, LONGEST_WORD))
    counts = words.groupBy("word").agg(F.count("*").alias("n")).where("n > 1")
    kept = keep(counts.select("word", F.floor(F.log2("n") * 16).cast("int").alias("step")))
    sizes = {r["step"]: r["n"] for r in kept.groupBy("step").agg(F.count("*").alias("n")).collect()}
    taken, least = 0, None
    for step in sorted(sizes, reverse=True):
        taken += sizes[step]
        if taken > count:
            break
        least = step
    if least is None:
        return []
    return sorted(r["word"] for r in kept.where(F.col("step") >= least).select("word").collect())


def publish_lexicon(spark: SparkSession, words: list[str], merger: Merger) -> str:
    """Compile the words, each after a space, and hand the file to all executors; its name.

    What the tokenizer cuts off a word, such as a comma, is a word of its own.
    """
    cut = {part for w in words for part in _WORDS.findall(f" {w}")}
    entries = {part.encode("utf-8"): merger.merge(part) for part in cut}
    block = compile_lexicon(entries)
    path = f"{shared_folder(spark)}/lexicon-{uuid.uuid4().hex}.bin"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stream = files.create(target)
    stream.write(bytearray(block))
    stream.close()
    spark.sparkContext.addFile(path)
    return path.rpartition("/")[2]


class Codec:
    """Encodes whole texts; look-ups and merges of words are remembered, as packed ids."""

    def __init__(self, merger: Merger, lexicon: Lexicon):
        self.merger, self.lexicon = merger, lexicon
        self.after_space = Memo(self._after_space, MEMO)
        self.spaced = Memo(self._pack, WORD_MEMO)
        self.word = Memo(self._ids, WORD_MEMO)
        self.decimal = [str(i) for i in range(len(merger.raw))]

    def _ids(self, word: str) -> bytes:
        packed = self.lexicon.packed(word.encode("utf-8"))
        if packed is None:
            ids = self.merger.merge(word)
            packed = struct.pack(f"<{len(ids)}I", *ids)
        return packed

    def _pack(self, piece: str) -> bytes:
        return b"".join(map(self.word.__getitem__, _WORDS.findall(piece)))

    def _after_space(self, word: str) -> bytes:
        """Latin letters are one word, a mark after them another; the rest is cut by pattern."""
        if word.isalpha() and max(word) < "\u0250":
            return self._ids(f" {word}")
        stem, mark = word[:-1], word[-1:]
        if mark in _MARKS and stem.isalpha() and max(stem) < "\u0250":
            return self.after_space[stem] + self.word[mark]
        return self._pack(f" {word}")

    def _plain(self, text: str) -> list[bytes]:
        """Packed ids, part by part, of a text without special strings."""
        if _UNEVEN.search(text):
            return list(map(self.spaced.__getitem__, SPACED_RUN.findall(text)))
        first, *rest = text.split(" ")
        return [self._pack(first), *map(self.after_space.__getitem__, rest)]

    def encode(self, text: str) -> np.ndarray:
        cut, special = self.merger.cut, self.merger.special
        if cut and cut.search(text):
            found = []
            for piece in cut.split(text):
                if piece in special:
                    found.append(struct.pack("<I", special[piece]))
                else:
                    found += self._plain(piece)
        else:
            found = self._plain(text)
        return np.frombuffer(b"".join(found), "<u4")

    def listed(self, ids: list[int]) -> str:
        """Ids as decimals joined by commas."""
        return ",".join(map(self.decimal.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.merger.raw.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(1)
def codec_for(path: str, lexicon: str) -> Codec:
    """One for all tasks of a Python worker."""
    return Codec(Merger(path), Lexicon(SparkFiles.get(lexicon)))


def encode_decode(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = "byte_bpe_50k.json",
    lexicon_words: int = LEXICON,
    with_ids: bool = False,
) -> DataFrame:
    """One row per document: ``doc_id, n_tokens, ids_sha256, decoded_sha256``, ids on request.

    NULL and empty texts have no ids and decode to the empty text. The lexicon is compiled from
    the most frequent words of all documents; its size is bounded by ``lexicon_words``.
    """
    spark = docs.sparkSession
    path = public_tokenizers.path(tokenizer)
    words = frequent_words(docs, text_col, lexicon_words)
    name = publish_lexicon(spark, words, Merger(path))
    names = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else ())]

    def run(batch: pd.Series) -> pd.DataFrame:
        codec, rows = codec_for(path, name), []
        for text in batch:
            packed = codec.encode(text)
            ids = packed.tolist()
            digest = hashlib.sha256(codec.listed(ids).encode()).hexdigest()
            back = hashlib.sha256(codec.decode(ids).encode("utf-8")).hexdigest()
            rows.append((len(ids), digest, back, *([packed.astype("i4")] if with_ids else ())))
        return pd.DataFrame(rows, columns=names)

    schema = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    coded = F.pandas_udf(run, schema + (", ids array<int>" if with_ids else ""))
    texts = id_and_text(docs, id_col, text_col)
    return texts.select("doc_id", coded("text").alias("c")).select("doc_id", "c.*")
