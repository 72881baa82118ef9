"""Landed upload files as rows: ledgers with a header line, plain text lines.

Every reader gives ``file_id`` (the file name) and a position inside the file,
``line_block`` then ``line_no``: the byte where the row's split starts and the
row's place in the task that read it. Large files are read in splits, so one
file never has to fit a task.
"""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.functions.headers import normalise_headers
from tallyfold.functions.identifiers import text_or_blank
from tallyfold.sources.delimited import read_delimited
from tallyfold.operators.keyed import first_per_key

POSITION = ["line_block", "line_no"]
META = ["file_id", *POSITION]


def with_position(df: DataFrame) -> DataFrame:
    """Rows of a table already carry ``line_no``; they have one block."""
    return df if "line_block" in df.columns else df.withColumn("line_block", F.lit(0).cast("long"))


def _file_columns() -> list[Column]:
    return [
        # The whole path: files of one name in two folders are two files.
        F.col("_metadata.file_path").alias("file_id"),
        F.col("_metadata.file_block_start").alias("line_block"),
        F.monotonically_increasing_id().alias("line_no"),
    ]


def scan_table(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    where: Column | None = None,
) -> DataFrame:
    """Parquet scan whose filter and columns reach the reader."""
    df = spark.read.parquet(path)
    if where is not None:
        df = df.filter(where)
    return df.select(*columns) if columns else df


def scan_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    column: str,
    lower: int,
    upper: int,
    partitions: int,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """Operational table read in parallel ranges of an integer key."""
    return spark.read.jdbc(
        url, table, column=column, lowerBound=lower, upperBound=upper,
        numPartitions=partitions, properties=properties or {},
    )


def read_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    lines = spark.read.text(list(paths))
    return lines.select(*_file_columns(), F.col("value").alias("text"))


def header_lines(spark: SparkSession, paths: Sequence[str]) -> dict[str, str]:
    """First line of each file of an upload. Only first splits are looked at,
    and each task passes on one line per file."""
    heads = (
        spark.read.text(list(paths))
        .filter("_metadata.file_block_start = 0")
        .select(F.col("_metadata.file_path").alias("path"), "value", F.monotonically_increasing_id().alias("n"))
    )
    first = first_per_key(heads, ["path"], [F.col("n")])
    return {r["path"]: r["value"].lstrip("\ufeff") for r in first.select("path", "value").collect()}


def separator_of(header: str) -> str:
    return "\t" if "\t" in header else ","


def header_of(line: str) -> list[str]:
    return normalise_headers(next(csv.reader([line], delimiter=separator_of(line)), []))


def _clean(df: DataFrame, meta: Sequence[str]) -> DataFrame:
    """Blanks for nulls, trimmed text; rows with nothing in them go."""
    names = [c for c in df.columns if c not in meta]
    cleaned = df.select(*meta, *[text_or_blank(F.col(f"`{c}`")).alias(c) for c in names])
    return cleaned.filter(F.concat(*[F.col(f"`{c}`") for c in names]) != "") if names else cleaned


def read_books_delimited(spark: SparkSession, paths: Sequence[str]) -> list[DataFrame]:
    """Ledger text files, one frame per distinct header: tab-separated if the
    header line has a tab, comma-separated otherwise. Records are read by
    ``read_delimited``: in splits, quoted line breaks kept; ``line_no`` is the
    record's first line in its file."""
    groups: dict[str, list[str]] = {}
    for path, header in sorted(header_lines(spark, paths).items()):
        groups.setdefault(header, []).append(path)
    frames = []
    for header, members in groups.items():
        names = header_of(header)
        # Read in splits; a quoted field with line breaks stays one record.
        rows = read_delimited(spark, members, names, sep=separator_of(header))
        named = [n for n in names if not _unnamed(n)]
        frames.append(_clean(rows.select(*META, *[F.col(f"`{n}`") for n in named]), META))
    return frames


def _unnamed(name: str) -> bool:
    return name.startswith("col") and name[3:].isdigit()


def parse_ledger_lines(lines: DataFrame, header: str) -> DataFrame:
    """The same for lines that are already a table: file_id, line_no, text."""
    names = header_of(header)
    schema = ", ".join(f"`{n}` string" for n in names)
    options = {"sep": separator_of(header), "quote": '"', "escape": '"'}
    rows = with_position(lines).withColumn("_row", F.from_csv("text", schema, options))
    named = [n for n in names if not _unnamed(n)]
    return _clean(rows.select(*META, *[F.col(f"_row.`{n}`").alias(n) for n in named]), META)


def read_books_table(rows: DataFrame) -> DataFrame:
    """A landed spreadsheet: file_id and line_no beside the sheet's columns."""
    placed = with_position(rows)
    sheet = [c for c in placed.columns if c not in META]
    renamed = placed.select(
        *META, *[F.col(f"`{c}`").alias(n) for c, n in zip(sheet, normalise_headers(sheet), strict=True)]
    )
    return _clean(renamed, META)


def read_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Whole files as bytes, for hashing: file_id, path, size_bytes, content."""
    files = spark.read.format("binaryFile").load(list(paths))
    return files.select(
        F.col("_metadata.file_path").alias("file_id"),
        "path", F.col("length").alias("size_bytes"), "content",
    )
