"""Lines that many documents share, dropped from all but one, in DataFrame functions only.

Hashes of lines are dealt out by range and sorted by document and position inside each range, so one
pass over a range sees the occurrences of a line next to each other, the document that keeps it
first. What comes back are keep bitmaps, one per document, not texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsprep.llm.common import column, id_and_text, whole_text
from tsprep.session import keep

MIN_CHARS = 20
MIN_DOCS = 3
#: Hashes fall into so many slots when hot ones are looked for. A hash is hot above ``HOT_ROWS`` rows
#: and two slots' fair share, so there are at most half as many hot hashes as slots.
SLOTS = 4_096
HOT_ROWS = 2_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ENDS = " \t\n\x0b\x0c\r"


def _lower_latin(text: Column) -> Column:
    """A-Z in lower case and nothing else; ``lower`` does just that in plain ASCII."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_rows(texts: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``key, doc_id, part, pos``: a row for every line of at least ``min_chars`` code points.

    ``part`` stands for the text, so that rows that share an id keep bitmaps of their own.
    """
    line = F.posexplode(lines_of(_lower_latin(F.col("text")))).alias("pos", "line")
    rows = texts.where("doc_id IS NOT NULL AND text <> ''")
    rows = rows.select("doc_id", F.xxhash64("text").alias("part"), line)
    rows = rows.withColumn("line", F.btrim("line", F.lit(_ENDS)))
    rows = rows.where(F.char_length("line") >= min_chars)
    return rows.select(F.unhex(F.md5("line")).alias("key"), "doc_id", "part", "pos")


def hot_lines(rows: DataFrame) -> DataFrame | None:
    """``key, docs, top`` of the hot hashes, at most ``SLOTS / 2``; None if there are none.

    Counts of slots say where hot hashes can be; only rows of those slots are counted by hash. All
    counts are combined before the shuffle, so a line in every document costs no more than another.
    """
    slot = F.pmod(F.xxhash64("key"), F.lit(SLOTS))
    sizes = {r["slot"]: r["n"] for r in rows.groupBy(slot.alias("slot")).agg(F.count("*").alias("n")).collect()}
    least = HOT_ROWS + 2 * sum(sizes.values()) // SLOTS
    crowded = [s for s, n in sizes.items() if n > least]
    if not crowded:
        return None
    inside = rows.where(slot.isin(crowded))
    hot = inside.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > least).select("key")
    found = inside.join(F.broadcast(hot), "key", "left_semi")
    return keep(
        found.groupBy("key").agg(F.count_distinct("doc_id").alias("docs"), F.max("doc_id").alias("top"))
    )


def repeated_lines(rows: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``doc_id, part, pos`` of the lines to drop.

    A line found in at least ``min_docs`` documents stays in the one with the largest id only.
    """
    gone = (F.col("docs") >= min_docs) & (F.col("doc_id") < F.col("top"))
    hot = hot_lines(rows)
    rest = rows if hot is None else rows.join(F.broadcast(hot), "key", "left_anti")
    same = Window.partitionBy("key")
    ordered = same.orderBy(F.desc("doc_id"), "part", "pos")
    # the range partitioning already has all rows of a hash in one place: no further exchange
    ranged = rest.repartitionByRange("key")
    before = F.lag("doc_id").over(ordered)
    streamed = ranged.select(
        "key",
        "doc_id",
        "part",
        "pos",
        F.first("doc_id").over(ordered).alias("top"),
        (before.isNull() | (before != F.col("doc_id"))).cast("int").alias("_new"),
    ).withColumn("docs", F.sum("_new").over(same))
    drops = streamed.where(gone).select("doc_id", "part", "pos")
    if hot is not None:
        hot_drops = rows.join(F.broadcast(hot), "key").where(gone)
        drops = drops.unionByName(hot_drops.select("doc_id", "part", "pos"))
    return drops


def keep_bitmaps(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
) -> DataFrame:
    """``doc_id, part, n_dropped, bitmap`` of every document that loses a line.

    ``bitmap`` holds ``(word, bits)`` in order: bit i of word w is 1 if line ``64 * w + i`` stays.
    Words in which all lines stay are left out. ``part`` is ``xxhash64`` of the text.

    A line's key has spaces, tabs and line ends stripped at both ends and A-Z in lower case. Documents
    are counted by id: rows that share an id are one document, and repeated rows change nothing. A
    document that repeats a line inside itself loses all of them or none. Rows without an id are
    neither counted nor changed. NULL and empty texts are one empty line and lose nothing.
    """
    rows = keep(line_rows(id_and_text(docs, id_col, text_col), min_chars))
    drops = repeated_lines(rows, min_docs)
    word = F.expr("CAST(pos DIV 64 AS int)").alias("word")
    words = drops.groupBy("doc_id", "part", word).agg(F.expr("bit_or(shiftleft(1L, pos % 64))").alias("gone"))
    return words.groupBy("doc_id", "part").agg(
        F.sum(F.bit_count("gone")).alias("n_dropped"),
        F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("gone").alias("bits")))).alias("bitmap"),
    )


#: Words of a bitmap in order, those that were left out included.
_DENSE = """flatten(transform(bitmap, (e, i) -> concat(
    array_repeat(-1L, e.word - if(i = 0, 0, bitmap[i - 1].word + 1)), array(e.bits))))"""


def _kept(lines: Column, dense: Column) -> Column:
    def stays(_: Column, i: Column) -> Column:
        bits = F.coalesce(F.get(dense, F.shiftright(i, 6)), F.lit(-1).cast("bigint"))
        return F.getbit(bits, i % 64) == 1

    return F.array_join(F.filter(lines, stays), "\n")


def drop_repeated_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
) -> DataFrame:
    """``doc_id, n_lines, n_dropped, text`` of every row: the lines that stay, joined by line ends.

    See :func:`keep_bitmaps` for odd input; each row comes back once, whatever its id.
    """
    found = keep_bitmaps(docs, id_col, text_col, min_chars, min_docs)
    found = found.withColumnsRenamed({"doc_id": "_id", "part": "_part"})
    mine = docs.select(column(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    mine = mine.withColumn("part", F.xxhash64("text"))
    same = (mine["doc_id"] == found["_id"]) & (mine["part"] == found["_part"])
    joined = mine.join(found, same, "left")
    # a lambda's variable is worked out once a row; a column would be put into the inner lambda whole
    lines = F.transform(F.array(F.expr(_DENSE)), lambda dense: _kept(lines_of(F.col("text")), dense))[0]
    return joined.select(
        "doc_id",
        F.size(lines_of(F.col("text"))).cast("bigint").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("bigint").alias("n_dropped"),
        F.when(F.col("bitmap").isNull(), F.col("text")).otherwise(lines).alias("text"),
    )


def line_digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` of every document."""
    return drop_repeated_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )


def oracle_sql(min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> str:
    ends = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d),
k AS (SELECT *, translate(trim(line, {ends}), '{_UPPER}', '{_LOWER}') AS key FROM l),
many AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= {min_chars}
         GROUP BY key HAVING count(DISTINCT doc_id) >= {min_docs}),
j AS (SELECT k.*, top IS NOT NULL AND doc_id < top AS gone FROM k LEFT JOIN many USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id"""
