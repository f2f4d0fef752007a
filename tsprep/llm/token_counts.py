"""Exact token counts of every prefix, by dynamic programming over prefixes.

For each prefix of a word there is exactly one token that its encoding ends with: the one that
ends there and stands next to the last token of the prefix before it. Two tokens stand side by side
if no merge across their border comes before a merge inside them. So one pass over a word
counts all its prefixes, and counts of words add up over a text: truncations and budgets are
look-ups.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tsprep.llm.bpe_lexicon import byte_letters
from tsprep.llm.common import Memo, id_and_text, latin_words, space_split

LIMIT = 2048
MEMO = 400_000

_LETTERS = dict(enumerate(byte_letters()))
# Fixed value: words of three letters that the tokenizer parts when their last one is missing.
_PARTED = frozenset(("'re", "'ve", "'ll"))


class PrefixCounts:
    """Counts for a BPE tokenizer that drops white space and marks the ends of words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab = model["vocab"]
        self.made: dict[str, int] = {}
        self.halves: dict[str, tuple[str, str]] = {}
        self.rank: dict[tuple[str, str], int] = {}
        for i, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.rank[a, b] = i
            self.made.setdefault(a + b, i)
            self.halves.setdefault(a + b, (a, b))
        usable = [t for t in self.vocab if self._usable(t)]
        inner = {t for t in usable if not (self.end and t.endswith(self.end))}
        final = {t.removesuffix(self.end) for t in usable if t.endswith(self.end)}
        self.inner, self.final = inner, final
        self.longest = max(map(len, inner | final))
        self.tokenizer = Tokenizer.from_file(path)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = set(special)
        self.cut = re.compile("(" + "|".join(map(re.escape, special)) + ")")
        self.beside = Memo(lambda pair: self.stands(*pair))
        self.of_word = Memo(self._count_word, MEMO)
        self.of_run = Memo(self._count_run, MEMO)
        self.of_prefixes = Memo(self._word_prefixes, 20_000)

    def stands(self, left: str, right: str) -> bool:
        """Whether merging both tokens' symbols ends with just these two tokens."""
        made, before = self.made, 1 << 60
        while True:
            if self.rank.get((left, right), before) < before:
                return False
            a, b = made.get(left, -1), made.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:  # undo the later merge; equal merges happen from left to right
                before, left = a, self.halves[left][1]
            else:
                before, right = b + 1, self.halves[right][0]

    def _usable(self, token: str) -> bool:
        """Whether the token is what its own symbols merge to."""
        parts = list(token.removesuffix(self.end))
        if token.endswith(self.end) and self.end and parts:
            parts[-1] += self.end
        while len(parts) > 1:
            rank, i = min((self.rank.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                return False
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return True

    def _last(self, word: str, i: int, last: list[str], tokens: set[str], suffix: str) -> int:
        """Start of the token that the prefix of length i ends with."""
        for j in range(max(0, i - self.longest), i):
            token = word[j:i]
            if token in tokens and (not j or self.beside[last[j], token + suffix]):
                return j
        raise ValueError(f"no token ends at {i} in {word!r}")

    def _open(self, word: str, stop: int) -> tuple[list[str], list[int]]:
        """Last token and number of tokens of every prefix that the word goes on after."""
        last, counts = [""], [0]
        for i in range(1, stop):
            j = self._last(word, i, last, self.inner, "")
            last.append(word[j:i])
            counts.append(counts[j] + 1)
        return last, counts

    def prefixes(self, word: str) -> list[int]:
        """Tokens of each prefix of a word in the tokenizer's letters, from length 0 on."""
        last, counts = self._open(word, len(word))
        return [0] + [
            counts[self._last(word, i, last, self.final, self.end)] + 1
            for i in range(1, len(word) + 1)
        ]

    def _count_word(self, word: str) -> int:
        if word in self.final:
            return 1
        last, counts = self._open(word, len(word))
        return counts[self._last(word, len(word), last, self.final, self.end)] + 1

    def words(self, run: str) -> list[str]:
        """Words of a run without white space, in the tokenizer's letters."""
        found = latin_words(run)
        if found is not None:
            if run.isascii():
                return found
            return [w.encode().decode("latin-1").translate(_LETTERS) for w in found]
        clean = self.tokenizer.normalizer.normalize_str(run)
        return [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(clean)]

    def _count_run(self, run: str) -> int:
        if not self.cut.search(run):
            return sum(map(self.of_word.__getitem__, self.words(run)))
        pieces = [p for p in self.cut.split(run) if p]
        return sum(1 if p in self.special else self._count_run(p) for p in pieces)

    def _word_prefixes(self, word: str) -> list[int]:
        if word in _PARTED:  # cut short, the apostrophe is a word of its own
            mark = self.of_word["'"]
            return [0, mark, mark + self.of_word[word[1]], self.of_word[word]]
        return self.prefixes(word)

    def inside(self, run: str) -> list[int]:
        """Tokens of each prefix of a run without white space, from length 0 on."""
        if self.cut.search(run):
            out, total, before = [0], 0, ""
            for piece in filter(None, self.cut.split(run)):
                if piece in self.special:  # any shorter cut of it is plain text and joins what is before
                    without = total - (self._count_run(before) if before else 0)
                    out += [without + self._count_run(before + piece[:n]) for n in range(1, len(piece))]
                    total, before = total + 1, ""
                    out.append(total)
                else:
                    out += [total + n for n in self.inside(piece)[1:]]
                    total, before = out[-1], piece
            return out
        normal = self.tokenizer.normalizer.normalize_str
        letters = [normal(c).encode().decode("latin-1").translate(_LETTERS) for c in run]
        words = self.words(run)
        if "".join(letters) != "".join(words) or any(map(unicodedata.combining, run)):
            # characters change each other here, so every cut is a text of its own
            return [0, *(self._count_run(run[:n]) for n in range(1, len(run) + 1))]
        by_letter, total = [0], 0
        for word in words:
            by_letter += [total + n for n in self.of_prefixes[word][1:]]
            total = by_letter[-1]
        out, at = [0], 0
        for part in letters:
            at += len(part)
            out.append(by_letter[at])
        return out

    def everywhere(self, text: str) -> list[int]:
        """Tokens of the text cut after each of its characters."""
        out, total = [], 0
        for run in space_split(text):
            start = text.index(run, len(out))
            out += [total] * (start - len(out))
            out += [total + n for n in self.inside(run)[1:]]
            total = out[-1]
        return out + [total] * (len(text) - len(out))

    def count(self, text: str) -> int:
        return sum(map(self.of_run.__getitem__, space_split(text)))

    def runs(self, text: str) -> tuple[list[int], list[int]]:
        """Where runs without white space end, and the tokens of the text up to there."""
        ends, counts, at, total = [], [], 0, 0
        for run in space_split(text):
            at = text.index(run, at) + len(run)
            total += self.of_run[run]
            ends.append(at)
            counts.append(total)
        return ends, counts

    def longest_prefix(self, text: str, budget: int) -> int:
        """Characters of the longest prefix of at most ``budget`` tokens.

        Past the last whole run that fits, cuts within the next one are tried; a cut can have more
        tokens than a longer one.
        """
        fit, total, at = 0, 0, 0
        for run in space_split(text):
            start = text.index(run, at)
            at = start + len(run)
            if total + self.of_run[run] <= budget:
                total, fit = total + self.of_run[run], at
                continue
            cuts = self.inside(run)
            inside = [n for n in range(1, len(run)) if total + cuts[n] <= budget]
            return start + inside[-1] if inside else (start if total <= budget and budget >= 0 else fit)
        return len(text)


@cache
def prefix_counts(path: str) -> PrefixCounts:
    """One for all tasks of a Python worker."""
    return PrefixCounts(path)


def count_tokens(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = "word_bpe_49k.json",
    limit: int = LIMIT,
) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_tokens, over_limit``; NULL is empty, with 0 tokens."""
    path = public_tokenizers.path(tokenizer)
    texts = id_and_text(docs, id_col, text_col)

    def run(batch: pd.Series) -> pd.Series:
        counts = prefix_counts(path)
        return pd.Series([counts.count(t) for t in batch], dtype="int64")

    counted = texts.select(
        "doc_id",
        F.octet_length("text").cast("bigint").alias("n_bytes"),
        F.pandas_udf(run, "bigint")("text").alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def token_prefixes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = "word_bpe_49k.json",
) -> DataFrame:
    """``doc_id, ends, counts, inside``: tokens up to each place where a run ends, and after each character.

    Store it once: ``tokens_at`` and ``longest_cut`` answer from it how long any cut text is and where
    to cut for a budget, ``tokens_before`` how long it is cut between runs only.
    """
    path = public_tokenizers.path(tokenizer)
    texts = id_and_text(docs, id_col, text_col)
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = prefix_counts(path)
        for batch in batches:
            found = [counts.runs(t) for t in batch["text"]]
            ends, totals = [e for e, _ in found], [c for _, c in found]
            inside = [counts.everywhere(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ends": ends, "counts": totals, "inside": inside})

    return texts.mapInPandas(run, f"doc_id {kind}, ends array<int>, counts array<bigint>, inside array<int>")


def tokens_at(place: Column) -> Column:
    """Tokens of the text cut after ``place`` characters, within a run too, from stored prefixes."""
    last = F.least(place, F.size("inside"))
    return F.when(last > 0, F.get("inside", last - 1)).otherwise(F.lit(0)).cast("bigint")


def longest_cut(budget: Column) -> Column:
    """Characters of the longest prefix of at most ``budget`` tokens, from stored prefixes."""
    fits = F.transform("inside", lambda n, i: F.when(n <= budget, i + 1))
    return F.coalesce(F.array_max(fits), F.lit(0))


def tokens_before(place: Column) -> Column:
    """Tokens of the text cut after the last run that ends by ``place``, from stored prefixes."""
    fitting = F.size(F.filter("ends", lambda e: e <= place))
    return F.when(fitting > 0, F.element_at("counts", fitting)).otherwise(F.lit(0).cast("bigint"))


def truncate(
    docs: DataFrame,
    budget: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = "word_bpe_49k.json",
) -> DataFrame:
    """``doc_id, text``: the longest prefix of each text that keeps to the budget of tokens."""
    path = public_tokenizers.path(tokenizer)
    texts = id_and_text(docs, id_col, text_col)
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = prefix_counts(path)
        for batch in batches:
            batch["text"] = [t[: counts.longest_prefix(t, budget)] for t in batch["text"]]
            yield batch

    return texts.mapInPandas(run, f"doc_id {kind}, text string")
