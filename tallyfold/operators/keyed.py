"""One row per key, ids without a global sort, and fill-down in bounded groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ID_BUCKETS = 4096
BLOCK_BITS = 12


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row of each key in the given order.

    Written as row_number() = 1, which Spark turns into a per-task group limit
    before the shuffle: a key with any number of copies sends at most one row
    per map task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


def last_per_key(df: DataFrame, keys: Sequence[str], position: Sequence[str]) -> DataFrame:
    return first_per_key(df, keys, [F.col(p).desc() for p in position])


def assign_ids(
    df: DataFrame,
    unique_by: Sequence[str],
    id_col: str,
    start: Column | int = 0,
    buckets: int = ID_BUCKETS,
) -> DataFrame:
    """Unique ids above ``start`` for rows that ``unique_by`` identifies.

    Rows fall into hash buckets of about equal size and are numbered inside
    their bucket; bucket b takes the ids start+b+1, then every ``buckets``-th.
    That needs one shuffle, no count and no global order. Ids may have gaps,
    and depend on the rows alone, not on how tasks were scheduled or retried.
    """
    bucket = F.pmod(F.xxhash64(*unique_by), F.lit(buckets))
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy(*unique_by))
    base = F.lit(start) if isinstance(start, int) else start
    number = base + (within - 1).cast("long") * buckets + F.col("_bucket") + 1
    return df.withColumn("_bucket", bucket).withColumn(id_col, number.cast("long")).drop("_bucket")


def carry_forward(
    df: DataFrame,
    group: str,
    position: str,
    value: str,
    level_bits: Sequence[int] = (BLOCK_BITS, 2 * BLOCK_BITS, 32 + BLOCK_BITS),
) -> DataFrame:
    """Fill nulls of ``value`` with the last non-null one at or before the row,
    per ``group`` in ``position`` order (``position`` a non-negative long).

    A plain window would put a whole group into one task. Here rows are filled
    inside blocks of 2^12 positions; each block's last value is filled over
    blocks the same way, level by level, and the value a block starts with is
    joined back. Only the top level is ordered per group as a whole, and it
    has one row per 2^44 positions.
    """
    bits, rest = level_bits[0], level_bits[1:]
    block = F.shiftright(F.col(position), bits)
    blocked = df.withColumn("_block", block)
    upto = Window.partitionBy(group, "_block").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    filled = blocked.withColumn("_own", F.last(value, ignorenulls=True).over(upto))
    ends = _last_value(blocked, [group, "_block"], position, value)
    starts = _starts(ends, group, value, bits, rest)
    return (
        filled.join(starts, [group, "_block"], "left")
        .withColumn(value, F.coalesce("_own", "_start"))
        .drop("_block", "_own", "_start")
    )


def _last_value(df: DataFrame, keys: list[str], position: str, value: str) -> DataFrame:
    """Last known value of every group, null where it has none. Only rows with
    a value are sorted for it; the groups themselves come from a hash distinct."""
    known = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.max_by(value, position).alias(value))
    return df.select(*keys).distinct().join(known, keys, "left")


def _starts(ends: DataFrame, group: str, value: str, bits: int, rest: Sequence[int]) -> DataFrame:
    """Value in force when each block begins: (group, _block, _start)."""
    if not rest:
        before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        return ends.select(group, "_block", F.last(value, ignorenulls=True).over(before).alias("_start"))
    up = rest[0] - bits
    raised = ends.withColumn("_up", F.shiftright(F.col("_block"), up))
    before = (
        Window.partitionBy(group, "_up").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    inside = raised.withColumn("_in", F.last(value, ignorenulls=True).over(before))
    upper_ends = _last_value(
        raised.withColumnRenamed("_block", "_b"), [group, "_up"], "_b", value
    ).withColumnRenamed("_up", "_block")
    upper = _starts(upper_ends, group, value, rest[0], rest[1:]).withColumnsRenamed(
        {"_block": "_up", "_start": "_from"}
    )
    return inside.join(upper, [group, "_up"], "left").select(
        group, "_block", F.coalesce("_in", "_from").alias("_start")
    )
