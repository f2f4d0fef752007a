"""Columns and helpers that the operators of this package share."""

from __future__ import annotations

import re

import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of Unicode's White_Space property, as a character class.
SPACE = (
    "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
)

#: ``str.split`` also cuts at these four, which are no white space to the tokenizers.
_ONLY_SPLIT = re.compile("[\x1c-\x1f]")
SPACED_RUN = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
_NOT_SPACE_RUN = re.compile(f"[^{SPACE}]+")


def space_split(text: str) -> list[str]:
    """Runs without white space."""
    return _NOT_SPACE_RUN.findall(text) if _ONLY_SPLIT.search(text) else text.split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_text(name: str) -> Column:
    """Text with NULL as the empty text."""
    return F.coalesce(column(name).cast("string"), F.lit(""))


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the identifier and the text, so that other columns can have any names."""
    return docs.select(column(id_col).alias("doc_id"), whole_text(text_col).alias("text"))


# Fixed value: how tokenizers that mark the ends of words cut text without white space.
_RUN_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def latin_words(run: str) -> list[str] | None:
    """Words in lower case of a run without white space; None unless all its letters are Latin.

    Latin letters have one form and one lower case, so no normaliser is needed.
    """
    if run.isprintable() and max(run) < "\u0250":
        return _RUN_WORDS.findall(run.lower())
    return None


class Memo(dict):
    """Results by key, filled by ``make``; at most ``limit`` of them are held.

    Words follow a long-tailed distribution, so a bounded memo answers nearly every look-up. When
    half the limit is full, those results become the older half and the former older half goes;
    what is asked for again moves back. The limit bounds memory only: a missing result is made again.
    """

    def __init__(self, make, limit: int = 300_000):
        super().__init__()
        self.make, self.half, self.older = make, max(1, limit // 2), {}

    def __missing__(self, key):
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value
