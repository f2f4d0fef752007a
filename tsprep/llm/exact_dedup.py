"""Exact duplicates by a stateful stream.

Documents arrive as events of a stream: digest, identifier and where the content lies. The state
is keyed by the digest, kept on disk (RocksDB, with its snapshots in the shared folder) and never
expires. Whoever hits a digest is compared with the retained document byte by byte.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tsprep.llm.common import column, whole_text
from tsprep.session import keep, shared_folder

#: Copies that are compared with one copy of the retained text.
COPIES = 256

_STORE = "spark.sql.streaming.stateStore"
#: State on disk; without space allocated ahead, of which each partition's store takes some MB.
_ON_DISK = {
    f"{_STORE}.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    f"{_STORE}.rocksdb.allowFAllocate": "false",
}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _located(docs: DataFrame, id_col: str, text_col: str, digest) -> tuple[DataFrame, bool]:
    """``doc_id, text, path, place, digest``; whether place is that of a row in a file."""
    wanted = [column(id_col).alias("doc_id"), whole_text(text_col).alias("text")]
    try:
        file_row = [
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.row_index").alias("place"),
        ]
        out, in_files = docs.select(*wanted, *file_row), True
    except AnalysisException:  # not a table of files
        row = [F.lit("").alias("path"), F.monotonically_increasing_id().alias("place")]
        out, in_files = docs.select(*wanted, *row), False
    return out.withColumn("digest", digest(F.col("text"))), in_files


def retained(spark: SparkSession, events: str, bytes_per_batch: int) -> DataFrame:
    """Run the stream over the table ``events``; its state: ``digest, last, group_size``."""
    state = shared_folder(spark)
    before = {key: spark.conf.get(key, None) for key in _ON_DISK}
    for key, value in _ON_DISK.items():
        spark.conf.set(key, value)
    try:
        source = spark.readStream.schema(spark.read.parquet(events).schema)
        groups = (
            source.option("maxBytesPerTrigger", bytes_per_batch)
            .parquet(events)
            .groupBy("digest")
            .agg(F.max(F.struct("doc_id", "path", "place")).alias("last"), F.count("*").alias("n"))
        )
        query = (
            groups.writeStream.format("noop")
            .outputMode("update")
            .option("checkpointLocation", state)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
    kept = spark.read.format("statestore").load(state)
    buffer = kept.schema["value"].dataType.fieldNames()
    return kept.select(
        F.col("key").getField("digest").alias("digest"),
        F.col("value").getField(buffer[0]).alias("last"),
        F.col("value").getField(buffer[1]).alias("group_size"),
    )


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest=sha256,
    bytes_per_batch: int = 64 * 2**30,
) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical; NULL counts as empty. Of equal texts the row with the largest
    id stays, of rows that repeat this id one; a NULL id counts as the smallest. ``digest`` maps
    a text column to the state's key. Texts of one digest that differ are grouped by the
    text itself, so a weak digest costs time and never a wrong row.
    """
    return _named(_verdicts(docs, id_col, text_col, digest, bytes_per_batch))


def drop_exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest=sha256,
    bytes_per_batch: int = 64 * 2**30,
) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    if not _located(docs, id_col, text_col, digest)[1]:
        docs = keep(docs)
    stay = _verdicts(docs, id_col, text_col, digest, bytes_per_batch).where("kept")
    stay = stay.select(F.struct("path", "place").alias("_at"))
    at = F.struct(F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    named = [column(c) for c in docs.columns]
    rows = docs.select(F.struct(*named).alias("_row"), at.alias("_is"))
    return rows.join(stay, rows["_is"] == stay["_at"], "left_semi").select("_row.*")


def _verdicts(
    docs: DataFrame, id_col: str, text_col: str, digest, bytes_per_batch: int
) -> DataFrame:
    """``doc_id, path, place, sha, keep_id, group_size, kept`` of every row."""
    spark = docs.sparkSession
    located, in_files = _located(docs, id_col, text_col, digest)
    sha = F.sha2(F.col("text").cast("binary"), 256).alias("sha")
    path = shared_folder(spark)
    located.select("doc_id", "digest", "path", "place", sha).write.parquet(path)
    events = spark.read.parquet(path)
    if events.isEmpty():
        unseen = {"keep_id": F.col("doc_id"), "group_size": F.lit(1), "kept": F.lit(True)}
        return events.withColumns(unseen)
    last = F.struct("doc_id", "path", "place")
    wanted = ["doc_id", "path", "place", "sha", "keep_id", "group_size", "kept"]
    marked = keep(
        events.join(retained(spark, path, bytes_per_batch), "digest")
        .withColumn("kept", last.eqNullSafe(F.col("last")))
        .withColumn("keep_id", F.col("last.doc_id"))
        .drop("last")
    )
    clash = keep(_differing(located, marked.where("group_size > 1"), in_files))
    if clash.isEmpty():
        return marked.select(wanted)
    by_text = keep(located.join(clash, "digest", "left_semi").withColumn("sha", sha))
    groups = by_text.groupBy("digest", "text").agg(
        F.max(last).alias("last"), F.count("*").alias("group_size")
    )
    split = (
        by_text.join(groups, ["digest", "text"])
        .withColumn("kept", last.eqNullSafe(F.col("last")))
        .withColumn("keep_id", F.col("last.doc_id"))
    )
    whole = marked.join(clash, "digest", "left_anti").select(wanted)
    return whole.unionByName(split.select(wanted))


def _differing(located: DataFrame, hits: DataFrame, in_files: bool) -> DataFrame:
    """Digests of which some text is not the retained one, byte for byte."""
    on = ["path", "place"] if in_files else ["doc_id", "digest"]
    # Copies of one text are dealt over parts of a group, each with the retained text.
    at = hits.select(
        *on,
        F.col("digest").alias("of"),
        "kept",
        F.ceil(F.col("group_size") / COPIES).cast("int").alias("parts"),
        F.xxhash64("path", "place").alias("any"),
    )
    if not in_files:
        at = at.groupBy(*on, "of", "kept", "parts").agg(F.min("any").alias("any"))
    found = located.select(*on, "text").join(at, on)
    mine = found.where("kept").select(
        "of", F.col("text").alias("retained"), F.explode(F.expr("sequence(0, parts - 1)")).alias("part")
    )
    others = found.where("NOT kept").select(
        "of", "text", F.pmod("any", "parts").cast("int").alias("part")
    )
    return (
        others.join(mine, ["of", "part"])
        .where(F.col("text").cast("binary") != F.col("retained").cast("binary"))
        .select(F.col("of").alias("digest"))
        .distinct()
    )


def _named(df: DataFrame) -> DataFrame:
    return df.select(
        "doc_id",
        "keep_id",
        F.col("group_size").cast("bigint").alias("group_size"),
        "kept",
        F.col("sha").alias("text_sha256"),
    )
