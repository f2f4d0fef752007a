"""Documents to training sequences: good ones, without copies and near copies, packed.

Each stage reads what the one before it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsprep.llm.common import table
from tsprep.llm.exact_dedup import drop_exact_duplicates
from tsprep.llm.minhash import near_duplicates
from tsprep.llm.packing import pack
from tsprep.llm.quality_crf import THRESHOLD, fit_quality, quality_score
from tsprep.session import keep


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts.

    NULL and empty texts are scored like any other, on whole texts of any length; each row is judged
    by itself, so repeated rows share their fate. No documents or no labels: no or all-alike scores.
    """
    chain = fit_quality(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality_score(chain)(F.col("text").cast("string")) >= THRESHOLD)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id; NULL and empty texts are equal.

    Of rows that repeat both id and text one stays.
    """
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id.

    A document without an id belongs to no group and stays; so do all texts without words. Rows that
    share an id are one document: if it goes, all of them go.
    """
    others = near_duplicates(docs).where("NOT kept").select("doc_id")
    return docs.join(others, "doc_id", "left_anti").select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences; a NULL or empty text is its end token alone, a long one many pieces."""
    return pack(docs)


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("packing", packing),
]

#: Hashing, training and packing have no counterpart in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir))
    return docs
