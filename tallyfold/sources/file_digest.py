"""Digest of a text file in ordered pieces, equal for every split size.

A file is never one cell: its lines are read by Spark's split-aware text
reader, numbered by their place in the file (a split's offset within its file
comes from the line counts of the splits before it, a table of one row per
split), cut into leaves of ``LEAF_LINES`` consecutive lines, and hashed as a
tree: a leaf is the sha256 of its lines joined by ``\\n``; while a file has
more than one node, every ``FANOUT`` consecutive ones become the sha256 of
their concatenated hex digests. The last node is the file's digest. How the
file is split into tasks changes nothing, and no task holds more than one leaf
of lines (the tree above the leaves holds 64 characters a node).

Lines are what Spark's text reader gives: line ends (\\n, \\r\\n, \\r) are not
part of the digest, so two files that differ only in them have one digest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LEAF_LINES = 4096
FANOUT = 8


def numbered_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """file_id, line_index (from 0, the line's place in its file), text."""
    lines = spark.read.text(list(paths)).select(
        F.col("_metadata.file_path").alias("file_id"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("_mid"),
        F.col("value").alias("text"),
    )
    # One row per split: a split is read whole by one task, so its lines have consecutive numbers there.
    splits = lines.groupBy("file_id", "block").agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("file_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    placed = lines.join(splits, ["file_id", "block"])
    return placed.select("file_id", (F.col("_mid") - F.col("_first") + F.col("_offset")).alias("line_index"), "text")


def tree_digest(lines: DataFrame, leaf_lines: int = LEAF_LINES) -> DataFrame:
    """file_id, file_hash, n_lines, n_bytes (UTF-8 bytes of the lines) from
    numbered lines (file_id, line_index, text)."""
    leaves = lines.groupBy("file_id", F.floor(F.col("line_index") / leaf_lines).alias("idx")).agg(
        F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_index", "text"))), lambda r: r["text"]), "\n"), 256).alias("h"),
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(F.octet_length("text")).alias("n_bytes"),
    )
    sizes = leaves.groupBy("file_id").agg(F.sum("n_lines").alias("n_lines"), F.sum("n_bytes").alias("n_bytes"))
    level = leaves.select("file_id", "idx", "h")
    done = []
    while True:
        counts = level.groupBy("file_id").agg(F.count(F.lit(1)).alias("_k"))
        one = counts.where("_k = 1").select("file_id")
        done.append(level.join(one, "file_id", "left_semi").select("file_id", "h"))
        busy = level.join(counts.where("_k > 1").select("file_id"), "file_id", "left_semi")
        if not busy.limit(1).count():
            break
        level = busy.groupBy("file_id", F.floor(F.col("idx") / FANOUT).alias("idx")).agg(
            F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "h"))), lambda r: r["h"]), ""), 256).alias("h")
        )
    roots = done[0]
    for more in done[1:]:
        roots = roots.unionByName(more)
    return roots.withColumnRenamed("h", "file_hash").join(sizes, "file_id")


def file_digests(spark: SparkSession, paths: Sequence[str], leaf_lines: int = LEAF_LINES) -> DataFrame:
    """file_id, path, file_hash, n_lines, size_bytes of text files, read in
    splits; ``size_bytes`` is the file's length as stored. Empty files are
    not listed by Spark's readers and have no row."""
    sizes = spark.read.format("binaryFile").load(list(paths)).select(
        F.col("_metadata.file_path").alias("file_id"), "path", F.col("length").alias("size_bytes")
    )
    digests = tree_digest(numbered_lines(spark, paths), leaf_lines)
    return sizes.join(digests.drop("n_bytes"), "file_id", "left").select(
        "file_id", "path", F.coalesce("file_hash", F.sha2(F.lit(""), 256)).alias("file_hash"),
        F.coalesce("n_lines", F.lit(0)).alias("n_lines"), "size_bytes",
    )
