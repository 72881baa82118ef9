"""Uploads and append-only tables as streams of files.

Both run with ``availableNow``: one call takes in what has arrived since the
last one and ends; the checkpoint replaces the high-water mark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tallyfold.plans.jobs import ingest_books, ingest_statement_text
from tallyfold.sources.warehouse import Store

FILE_NAMES = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)


def stream_append_sync(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    sink: str,
    checkpoint: str,
    name_filter: str | None = None,
    transform: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Copy new files of an append-only table to the warehouse, each once."""
    reader = spark.readStream.schema(schema)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    rows = reader.parquet(source)
    rows = transform(rows) if transform else rows
    query = (
        rows.writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def stream_ingest_uploads(
    store: Store, landing_dir: str, checkpoint: str, kind: str = "books", files_per_batch: int = 100
) -> None:
    """Take in every text file that has appeared in the landing folder. Content
    already in the ledger, or twice in a batch, is left out by its hash, so a
    batch that is run again stores nothing twice."""
    ingest = {"books": ingest_books, "statement": ingest_statement_text}[kind]

    def one_batch(batch: DataFrame, _batch_id: int) -> None:
        paths = [r[0] for r in batch.select("path").collect()]
        if paths:
            ingest(store, paths)

    arrived = (
        store.spark.readStream.format("binaryFile")
        .schema(FILE_NAMES)
        .option("pathGlobFilter", "*.txt")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(landing_dir)
        .select("path")
    )
    query = (
        arrived.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
