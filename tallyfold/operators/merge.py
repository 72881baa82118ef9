"""Upserts and change detection as joins; nothing here writes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_df(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    update_cols: Sequence[str],
    insert: bool = True,
    delete_missing: bool = False,
) -> DataFrame:
    """New content of ``target``: rows with a source row take its
    ``update_cols``; source rows without a target row are added (``insert``);
    target rows without a source row go (``delete_missing``).

    Both sides are unique on ``keys``, so no key can be hot, and each side is
    shuffled once.
    """
    keys, updated = list(keys), set(update_cols)
    columns = target.columns
    given = [c for c in columns if c in source.columns and c not in keys]
    src = source.select(*keys, *[F.col(c).alias(f"_s_{c}") for c in given], F.lit(True).alias("_src"))
    tgt = target.withColumn("_tgt", F.lit(True))
    how = {
        (True, False): "full",
        (True, True): "right",
        (False, False): "left",
        (False, True): "inner",
    }[(insert, delete_missing)]
    joined = tgt.join(src, keys, how)

    def pick(name: str):
        if name in keys:
            return F.col(name)
        if name not in given:
            return F.col(name)
        if name in updated:
            return F.when(F.col("_src"), F.col(f"_s_{name}")).otherwise(F.col(name)).alias(name)
        return F.when(F.col("_tgt"), F.col(name)).otherwise(F.col(f"_s_{name}")).alias(name)

    return joined.select(*[pick(c) for c in columns])


def replace_by_key(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Delete every target row whose key the source has, then add the source."""
    kept = target.join(source.select(*keys).distinct(), list(keys), "left_anti")
    return kept.select(*target.columns).unionByName(source.select(*target.columns))


def insert_absent(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Source rows whose key the target does not have."""
    known = target.select(*keys).distinct()
    return source.join(known, list(keys), "left_anti")


def _comparable(name: str, tolerance: Mapping[str, str]) -> Column:
    if name in tolerance:
        return F.coalesce(F.col(name).cast("decimal(25,4)"), F.lit(0).cast("decimal(25,4)"))
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def differing_blocks(
    current: DataFrame,
    stored: DataFrame,
    block: Sequence[str],
    keys: Sequence[str],
    compare_cols: Sequence[str],
    tolerance: Mapping[str, str] | None = None,
) -> DataFrame:
    """Blocks of keys whose compared values are not the same on both sides,
    told by two 64-bit fingerprints per block. Each side is scanned and
    partially aggregated; no row is shuffled."""
    tolerance = tolerance or {}

    def prints(df: DataFrame, tag: str) -> DataFrame:
        values = [F.col(k) for k in keys] + [_comparable(c, tolerance) for c in compare_cols]
        return df.groupBy(*block).agg(
            F.bit_xor(F.xxhash64(*values)).alias(f"{tag}1"),
            F.bit_xor(F.xxhash64(F.lit("second"), *values)).alias(f"{tag}2"),
        )

    both = prints(current, "c").join(prints(stored, "s"), list(block), "full")
    same = F.equal_null("c1", "s1") & F.equal_null("c2", "s2")
    return both.filter(~same).select(*block)


def changed_rows(
    current: DataFrame,
    stored: DataFrame,
    keys: Sequence[str],
    compare_cols: Sequence[str],
    tolerance: Mapping[str, str] | None = None,
    block: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Current rows that are stored under the same key with other values.

    Text compares with null equal to blank; columns in ``tolerance`` compare
    as numbers and differ only beyond it. With ``block`` (named columns over
    the key) only blocks whose fingerprints differ are joined row by row.
    """
    tolerance = tolerance or {}
    columns = current.columns
    if block:
        current, stored = current.withColumns(dict(block)), stored.withColumns(dict(block))
        names = list(block)
        open_blocks = differing_blocks(current, stored, names, keys, compare_cols, tolerance)
        current = current.join(open_blocks, names, "left_semi")
        stored = stored.join(open_blocks, names, "left_semi")
    old = stored.select(*keys, *[_comparable(c, tolerance).alias(f"_o_{c}") for c in compare_cols])
    differs = F.lit(False)
    for name in compare_cols:
        new_value, old_value = _comparable(name, tolerance), F.col(f"_o_{name}")
        if name in tolerance:
            differs = differs | (F.abs(new_value - old_value) > F.lit(tolerance[name]).cast("decimal(10,4)"))
        else:
            differs = differs | (new_value != old_value)
    return current.join(old, list(keys)).filter(differs).select(*columns)
