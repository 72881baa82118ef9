"""Staging and column helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.session import new_scratch


def stage(df: DataFrame, name: str) -> DataFrame:
    """The frame written under ``spark.checkpoint.dir`` and read back: its
    lineage is cut, and a lost executor costs one read."""
    path = new_scratch(df.sparkSession, f"llm-{name}")
    # The shuffles behind a written table are read by nobody afterwards; without this
    # their files stay on the executors' disks until the driver happens to collect garbage.
    conf, free = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(free)
    conf.set(free, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(free, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Bytes of texts that go to Python at a time, about; longer texts go alone.
BATCH_BYTES = 8 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """The frame, in a session whose Arrow batches are bounded by bytes and not
    by rows alone: ten thousand long texts would fill a worker's memory."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def text_of(column: str = "text"):
    """Null text counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def text_chunks(column: pa.Array, limit: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows whose UTF-8 bytes stay near ``limit``: first row, end row,
    their bytes and the row offsets within them. A longer text comes alone and
    whole, so memory follows the longest text and not the batch."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, off, values = column.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        end = min(n, max(end, first + 1))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end
