"""The registered queries of this package, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsprep.llm.backoff_lm import ALPHA, MIN_COUNT, backoff_scores
from tsprep.llm.bpe_lexicon import encode_decode
from tsprep.llm.common import table
from tsprep.llm.cross_polytope import nearest
from tsprep.llm.exact_dedup import exact_duplicates
from tsprep.llm.html_content import main_text
from tsprep.llm import line_dedup, prefix_trie
from tsprep.llm.license_scan import TEMPLATES, oracle_sql, scan_licenses
from tsprep.llm.minhash import near_duplicates
from tsprep.llm.packing import pack
from tsprep.llm.quality_crf import fit_quality, score_quality
from tsprep.llm.token_counts import count_tokens
from tsprep.llm.whitening import whiten
from tsprep.session import keep


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op7_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"))


def op8_cross_polytope_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_html_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op9_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = backoff_scores(table(spark, sf_dir, "documents"))
    rounded = {c: F.round(c, 6) for c in ("log_score", "mean_log_score")}
    return scores.withColumns(rounded)


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.turns_in_order(table(spark, sf_dir, "conversations"))
    rebuilt = prefix_trie.rebuild(keep(turns))
    return prefix_trie.prefix_trie(rebuilt).drop("enter", "exit")


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digests(table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup,
        op2_license_scan,
        op3_token_counts,
        op4_html_content,
        op5_exact_dedup,
        op6_packing,
        op7_quality_crf,
        op8_cross_polytope_neighbours,
        op9_backoff_lm,
        op10_bpe_codec,
        op11_conversation_trie,
        op12_line_dedup,
        op13_embedding_whitening,
    )
}

ORACLE = {
    "op2_license_scan": oracle_sql(TEMPLATES),
    "op11_conversation_trie": prefix_trie.oracle_sql(),
    "op12_line_dedup": line_dedup.oracle_sql(),
    "op9_backoff_lm": f"""
WITH w AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                         'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]+') IF x <> ''] AS ws
           FROM documents),
k AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w),
one AS (SELECT word, count(*) AS n FROM k GROUP BY word),
g AS (SELECT doc_id, i, word, lag(word) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM k),
two AS (SELECT before, word, count(*) AS n FROM g WHERE before IS NOT NULL GROUP BY before, word),
s AS (SELECT g.doc_id, g.word,
             CASE WHEN g.before IS NULL THEN ln(a.n / (SELECT count(*) FROM k))
                  WHEN two.n >= {MIN_COUNT} THEN ln(two.n / b.n)
                  ELSE ln({ALPHA} * a.n / (SELECT count(*) FROM k)) END AS x
      FROM g JOIN one a ON g.word = a.word LEFT JOIN one b ON g.before = b.word
      LEFT JOIN two ON g.before = two.before AND g.word = two.word),
t AS (SELECT doc_id, count(*) AS n, sum(x) AS score FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_words, CAST(0 AS BIGINT) AS n_unknown,
       round(coalesce(score, 0), 6) AS log_score, round(score / n, 6) AS mean_log_score
FROM documents LEFT JOIN t USING (doc_id)""",
    "op5_exact_dedup": """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))""",
}
