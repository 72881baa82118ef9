"""Delimited files read in splits, records that straddle lines or splits joined.

Spark's CSV reader either reads a file in splits and breaks a quoted field
that holds a line break into two bad rows, or (``multiLine``) reads each file
whole in one task. This reader does neither:

1. the file's lines come from the split-aware text reader, numbered by their
   place in the file (a table of one row per split gives each split's offset);
2. each line's quote parity is its count of ``"`` mod 2 (a doubled quote inside
   a field counts twice and changes nothing);
3. the parity before a line is a prefix sum in two levels: per block of
   ``BLOCK_LINES`` lines (a small table, one row per block, summed over the
   file), then within the block; no window ever holds more than a block;
4. a line whose parity before and own parity are even is a record; the other
   lines' records are numbered by the same two-level prefix count, their lines
   gathered in order and joined by ``\\n``; then ``from_csv`` parses. Blocks
   without any such line (most, mostly) are not shuffled.

The result equals parsing the whole file in one task with the same options,
for every split size. Line ends inside a quoted field come back as ``\\n``
(the text reader drops \\r\\n and \\r alike). The first record of a file is its
header and is dropped. A quote left open at the end of a file joins all lines
after it into one last record, as a one-task parser would read to the end.
Empty records (blank lines) give no row.

Columns: file_id, line_block (the split start of the record's first line),
line_no (the record's first line in its file, from 0), then the fields.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyfold.sources.warehouse import stage

BLOCK_LINES = 65536


def _numbered(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    lines = spark.read.text(list(paths)).select(
        F.col("_metadata.file_path").alias("file_id"),
        F.col("_metadata.file_block_start").alias("line_block"),
        F.monotonically_increasing_id().alias("_mid"),
        F.col("value").alias("text"),
    )
    # A split is read whole by one task: its lines have consecutive numbers there.
    splits = lines.groupBy("file_id", "line_block").agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("file_id").orderBy("line_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    placed = lines.join(splits, ["file_id", "line_block"])
    return placed.select(
        "file_id", "line_block", (F.col("_mid") - F.col("_first") + F.col("_offset")).alias("line_index"), "text"
    )


def prefix_sum(df: DataFrame, value: str, out: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """``out``: the sum of ``value`` over the file's lines before this one
    (``line_index`` order), in two levels so that no window holds a whole file."""
    df = df.withColumn("_blk", F.floor(F.col("line_index") / F.lit(block_lines)))
    blocks = df.groupBy("file_id", "_blk").agg(F.sum(value).alias("_bsum"))
    earlier = Window.partitionBy("file_id").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file_id", "_blk", F.coalesce(F.sum("_bsum").over(earlier), F.lit(0)).alias("_bbefore"))
    inside = Window.partitionBy("file_id", "_blk").orderBy("line_index").rowsBetween(Window.unboundedPreceding, -1)
    summed = df.join(blocks, ["file_id", "_blk"]).withColumn(
        out, F.col("_bbefore") + F.coalesce(F.sum(value).over(inside), F.lit(0))
    )
    return summed.drop("_blk", "_bbefore")


def records(lines: DataFrame, quote: str = '"', block_lines: int = BLOCK_LINES) -> DataFrame:
    """file_id, line_block, line_no, record (lines of one record joined by \\n)
    from numbered lines.

    In a block that no quote is open before and that has no line of odd parity,
    every line is a record; a table of one row per block tells these. Only the
    lines of other blocks are shuffled, and of them only the lines of records
    of several lines are numbered and gathered.
    """
    parity = (F.length("text") - F.length(F.replace(F.col("text"), F.lit(quote), F.lit("")))) % 2
    marked = lines.withColumns({"_q": parity, "_blk": F.floor(F.col("line_index") / F.lit(block_lines))})
    blocks = marked.groupBy("file_id", "_blk").agg(F.sum("_q").alias("_bsum"))
    earlier = Window.partitionBy("file_id").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_bsum").over(earlier), F.lit(0))
    # One row per block, read by both branches below.
    blocks = stage(blocks.select("file_id", "_blk", (before % 2).alias("_bopen"), "_bsum"), "quote-blocks")
    quiet = (F.col("_bopen") == 0) & (F.col("_bsum") == 0)
    placed = marked.join(blocks, ["file_id", "_blk"])
    alone = placed.filter(quiet)
    inside = Window.partitionBy("file_id", "_blk").orderBy("line_index").rowsBetween(Window.unboundedPreceding, -1)
    opened = (F.col("_bopen") + F.coalesce(F.sum("_q").over(inside), F.lit(0))) % 2
    other = placed.filter(~quiet).withColumn("_open", opened)
    whole = (F.col("_open") == 0) & (F.col("_q") == 0)
    out = ["file_id", "line_block", F.col("line_index").alias("line_no"), F.col("text").alias("record")]
    parts = other.filter(~whole).select("file_id", "line_block", "line_index", "text", (F.col("_open") == 0).cast("long").alias("_start"))
    numbered = prefix_sum(parts, "_start", "_starts_before", block_lines)
    grouped = numbered.groupBy("file_id", (F.col("_starts_before") + F.col("_start")).alias("_record")).agg(
        F.min(F.struct("line_index", "line_block")).alias("_first"),
        F.sort_array(F.collect_list(F.struct("line_index", "text"))).alias("_lines"),
    )
    joined = grouped.select(
        "file_id",
        F.col("_first.line_block").alias("line_block"),
        F.col("_first.line_index").alias("line_no"),
        F.array_join(F.col("_lines.text"), "\n").alias("record"),
    )
    return alone.select(*out).unionByName(other.filter(whole).select(*out)).unionByName(joined)


def read_delimited(
    spark: SparkSession,
    paths: Sequence[str],
    names: Sequence[str],
    sep: str = ",",
    quote: str = '"',
    block_lines: int = BLOCK_LINES,
) -> DataFrame:
    """Fields ``names`` (all strings) of every record after each file's header."""
    schema = ", ".join(f"`{n}` string" for n in names)
    options = {"sep": sep, "quote": quote, "escape": quote}
    recs = records(_numbered(spark, paths), quote, block_lines)
    recs = recs.filter((F.col("line_no") > 0) & (F.col("record") != ""))
    row: Column = F.from_csv(F.col("record"), schema, options)
    return recs.select("file_id", "line_block", "line_no", *[row[n].alias(n) for n in names])
