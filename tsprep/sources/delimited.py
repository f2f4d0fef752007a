"""Delimited text in, with encoding, delimiter, missing tokens and types detected."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import keep
from .codepages import PAGES, choose_delimiter, line_costs

# fixed values: texts that mean "missing"
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
#: Lines from the start of a file that tell its delimiter.
FIRST_LINES = 20
# fixed values: byte-order marks
MARKS = {"EFBBBF": "UTF-8", "FFFE": "UTF-16LE", "FEFF": "UTF-16BE"}
# fixed values: what Spark reads without being told that all of Java's code pages may be used
_SPARK_READS = {"ISO-8859-1", "US-ASCII", "UTF-8", "UTF-16", "UTF-16BE", "UTF-16LE", "UTF-32"}
ALL_PAGES = "spark.sql.legacy.javaCharsets"
_PLAIN, _EXTENDED = "ISO-8859-1", "windows-1252"


def named(column: str) -> Column:
    """The column of that very name, whatever characters are in it."""
    return F.col("`" + column.replace("`", "``") + "`")


def detect_format(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(path, encoding, delimiter) of every file.

    A file with a byte-order mark has the encoding it names, one whose bytes are all valid
    UTF-8 is UTF-8, any other has the code page under which its lines look most like text, see
    :mod:`tsprep.sources.codepages`; ISO-8859-1 if that is windows-1252 without its additions. The
    delimiter splits the first lines, decoded, into equally many fields outside quotes. Files are
    split among tasks and combined by aggregates, so their size does not matter.
    """
    return _formats(spark, path).select("path", "encoding", "delimiter")


def _formats(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """The formats with the header line in hex, and whether a quoted text goes over a line's end."""
    lines = spark.read.text([path] if isinstance(path, str) else list(path)).select(
        F.col("_metadata.file_path").alias("path"),
        F.struct(
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("place"),
        F.col("value"),
    )
    found = lines.groupBy("path").agg(
        F.min("place").alias("start"),
        F.min_by("value", "place").alias("first"),
        F.bool_and(F.is_valid_utf8("value")).alias("valid"),
        F.bool_or(F.length(F.regexp_replace("value", '[^"]', "")) % 2 == 1).alias("broken"),
    )
    header = F.hex("first")
    encoding = F.when(F.col("valid"), "UTF-8")
    for mark, name in MARKS.items():
        encoding = F.when(header.startswith(mark), name).otherwise(encoding)
    found = found.select("path", "start", header.alias("header"), "broken", encoding.alias("encoding"))
    found = keep(found)
    unknown = found.where("encoding IS NULL").select("path")
    if not unknown.isEmpty():
        pages = _code_pages(lines.join(unknown, "path", "left_semi"))
        found = found.join(pages, "path", "left").withColumn("encoding", F.coalesce("encoding", "page"))
    return _with_delimiters(found, lines)


def _code_pages(lines: DataFrame) -> DataFrame:
    """``path, page``: costs of all lines with bytes outside ASCII, summed by file."""
    names = [f"c{i}" for i in range(len(PAGES))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                costs = pd.DataFrame([line_costs(raw) for raw in batch["value"]], columns=names)
                costs["extended"] = [any(0x80 <= x < 0xA0 for x in raw) for raw in batch["value"]]
                costs = costs.groupby(batch["path"].to_numpy())
                yield costs.sum().rename_axis("path").reset_index().astype({"extended": "int64"})

    # the reader replaces what is no UTF-8 only when it shows a text, so bytes are whole
    other = lines.where(F.col("value").rlike(r"[^\x00-\x7F]"))
    other = other.select("path", F.col("value").cast("binary").alias("value"))
    shape = ", ".join(f"{n} double" for n in names)
    sums = other.mapInPandas(run, f"path string, {shape}, extended bigint")
    sums = sums.groupBy("path").agg(*[F.sum(n).alias(n) for n in [*names, "extended"]])
    best = F.least(*[F.struct(F.round(n, 6), F.lit(i).alias("i")) for i, n in enumerate(names)])["i"]
    page = F.element_at(F.array(*[F.lit(p) for p in PAGES]), best + 1)
    plain = (page == _EXTENDED) & (F.col("extended") == 0)
    return sums.select("path", F.when(plain, _PLAIN).otherwise(page).alias("page"))


def _with_delimiters(found: DataFrame, lines: DataFrame) -> DataFrame:
    """Add the delimiter that suits the first lines of each file, a bounded number."""
    at = lines.where("place.block = 0").join(found.select("path", "start"), "path")
    early = at.where(F.col("place.row") < F.col("start.row") + FIRST_LINES)
    heads = early.groupBy("path").agg(
        F.sort_array(F.collect_list(F.struct("place.row", F.col("value").cast("binary").alias("raw")))).alias("lines")
    )
    heads = heads.join(found.drop("start"), "path").select(
        "path", "encoding", "header", "broken", F.col("lines.raw").alias("lines")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # lines were cut at their ends in bytes: put together they decode as the file does
            texts = [b"\n".join(ls) for ls in batch["lines"]]
            decoded = [t.decode(e, "replace").lstrip("\ufeff") for t, e in zip(texts, batch["encoding"])]
            yield batch.drop(columns="lines").assign(delimiter=[choose_delimiter(t) for t in decoded])

    chosen = heads.mapInPandas(
        run, "path string, encoding string, header string, broken boolean, delimiter string"
    )
    return chosen.select("path", "encoding", "delimiter", "header", "broken")


def normalise_missing(df: DataFrame, tokens: Sequence[str] = NA_TOKENS) -> DataFrame:
    """Missing tokens and NaN become NULL."""
    cleaned = []
    for f in df.schema.fields:
        c = named(f.name)
        if isinstance(f.dataType, T.StringType):
            c = F.when(~F.trim(c).isin(*tokens), c)
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c)
        cleaned.append(c.alias(f.name))
    return df.select(*cleaned)


def infer_types(df: DataFrame) -> dict[str, str]:
    """The narrowest of BIGINT, DOUBLE, BOOLEAN and STRING that holds every text, in one pass."""
    # the patterns keep failing casts, which are slow, away from ordinary words
    patterns = {
        "bigint": r"^[+-]?\d{1,19}$",
        "double": r"(?i)^[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf|infinity)$",
        "boolean": r"(?i)^(true|false)$",
    }
    kinds = list(patterns)

    def fits(c: str, kind: str) -> Column:
        text = F.trim(named(c))
        ok = F.when(text.rlike(patterns[kind]), text.try_cast(kind).isNotNull()).otherwise(False)
        return F.bool_and(named(c).isNull() | ok).alias(f"{c}__{kind}")

    checks = [fits(c, k) for c in df.columns for k in kinds]
    known = [F.count(named(c)).alias(f"{c}__n") for c in df.columns]
    row = df.agg(*checks, *known).first()
    types = {}
    for c in df.columns:
        good = [k for k in kinds if row[f"{c}__{k}"]] if row[f"{c}__n"] else ["double"]
        types[c] = good[0] if good else "string"
    return types


def load_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    encoding: str | None = None,
    delimiter: str | None = None,
    schema: str | T.StructType | None = None,
    parse_dates: Sequence[str] = (),
    **options: Any,
) -> DataFrame:
    """Read delimited text with a header.

    What is not given is detected: encoding and delimiter per file, types over all rows. Give
    ``schema`` for large inputs; values that do not fit it become NULL. A missing path raises.
    Other options go to Spark's CSV reader and win over what is chosen here. Files are read
    together if format and header line agree, and joined by the names of their columns. A quote
    inside quoted text is doubled; text over several lines is found by lines with an odd number of
    quotes, and such files are not split. For code pages beyond ISO-8859-1 and Unicode the session's
    ``spark.sql.legacy.javaCharsets`` is switched on.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if encoding is None or delimiter is None:
        alike = ["encoding", "delimiter", "header", "broken"]
        found = keep(_formats(spark, path))
        groups = found.groupBy(*alike).agg(F.min("path").alias("one")).collect()
        sources = []
        for g in groups:
            paths = [path] if isinstance(path, str) else list(path)
            if len(groups) > 1:  # one entry per file, as any reader's file list
                same = [F.col(c).eqNullSafe(F.lit(g[c])) for c in alike]
                paths = [r["path"] for r in found.where(reduce(Column.__and__, same)).collect()]
            lines = g.broken or g.encoding.startswith("UTF-16")
            sources.append((encoding or g.encoding, delimiter or g.delimiter, lines, paths))
    else:
        paths = [path] if isinstance(path, str) else list(path)
        sources = [(encoding, delimiter, encoding.startswith("UTF-16"), paths)]
    if any(enc.upper() not in _SPARK_READS for enc, *_ in sources):
        spark.conf.set(ALL_PAGES, "true")  # for good, as plans are made later
    text = None
    for enc, sep, lines, paths in sources:
        chosen = {"header": True, "sep": sep, "encoding": enc, "multiLine": lines, "escape": '"'}
        part = spark.read.options(**{**chosen, **options}).csv(paths)
        text = part if text is None else text.unionByName(part, allowMissingColumns=True)
    text = normalise_missing(text)
    types = infer_types(text) if schema is None else {f.name: f.dataType for f in schema.fields}
    types.update(dict.fromkeys(parse_dates, "timestamp_ntz"))
    trimmed = [
        named(c).alias(c)
        if types[c] in ("string", T.StringType())
        else F.trim(named(c)).try_cast(types[c]).alias(c)
        for c in text.columns
        if c in types
    ]
    return normalise_missing(text.select(*trimmed))
