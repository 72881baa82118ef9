"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key is hot when it holds more than 1/HOT_SHARE of the fact rows, so there
# are fewer than HOT_SHARE hot keys however large the data is: that is the
# proven bound on the one table this module broadcasts.
HOT_SHARE = 1000


def hot_keys(counts: DataFrame, on: Sequence[str], n: str = "n") -> DataFrame:
    """Keys above the hot share, with the number of slices each is cut into.

    ``counts`` holds one row per key with its row count ``n``.
    """
    total = counts.agg(F.sum(n).alias("total")).scalar()
    slices = F.ceil(F.col(n) * HOT_SHARE / total).cast("int")
    return counts.filter(F.col(n) * HOT_SHARE > total).select(*on, slices.alias("_slices"))


def lookup_join(
    fact: DataFrame,
    dim: DataFrame,
    on: Sequence[str],
    spread_by: Sequence[str] = (),
    how: str = "left",
    counts: DataFrame | None = None,
) -> DataFrame:
    """Equi-join a fact to a lookup that is unique on the keys, ``left`` or ``inner``.

    Catalyst picks the join; the oversized partitions of a sort-merge join are
    split by adaptive execution at run time (see the session settings), and
    counting keys beforehand would mean computing the fact twice.

    A caller that has rows per key anyway passes them as ``counts``: the rows
    of each hot key are then cut into slices by a hash of ``spread_by``
    (columns that identify a fact row) and the lookup's row of that key is
    repeated per slice, whatever adaptive execution decides. Rows with a null
    key match nothing and are spread the same way.
    """
    on = list(on)
    if counts is None:
        return fact.join(dim, on, how)
    hot = F.broadcast(hot_keys(counts.dropna(subset=on), on))
    hashed = F.xxhash64(*spread_by)
    no_key = F.lit(False)
    for name in on:
        no_key = no_key | F.col(name).isNull()
    sliced = (
        fact.join(hot, on, "left")
        .withColumn(
            "_slice",
            F.when(no_key, F.pmod(hashed, F.lit(HOT_SHARE)))
            .when(F.col("_slices").isNotNull(), F.pmod(hashed, F.col("_slices")))
            .otherwise(F.lit(0))
            .cast("int"),
        )
        .drop("_slices")
    )
    repeated = (
        dim.join(hot, on, "left")
        .withColumn(
            "_slice",
            F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_slices"), F.lit(1)) - 1)),
        )
        .drop("_slices")
    )
    return sliced.join(repeated, [*on, "_slice"], how).drop("_slice")


def key_any_join(
    left: DataFrame,
    right: DataFrame,
    left_keys: tuple[Column, Column],
    right_key: str,
    value: str,
    dedupe: bool = False,
) -> DataFrame:
    """``left LEFT JOIN right ON k1 = right_key OR k2 = right_key`` without a
    nested loop. ``right`` is unique on ``right_key`` and supplies one column.

    A left row that both keys match comes out twice, as the disjunction says;
    ``dedupe`` keeps the first key's match only. ``matched_by`` tells which:
    first, second, or ``both`` on the second of two rows. Both equi-joins read
    the same shuffled ``right``.
    """
    first, second = left_keys
    keyed = left.withColumn("_k1", first).withColumn("_k2", second)
    keyed = keyed.withColumn("_k2", F.when(~F.equal_null("_k1", "_k2"), F.col("_k2")))
    # Values are wrapped, so that a null one still counts as a match.
    r1 = right.select(F.col(right_key).alias("_k1"), F.struct(value).alias("_m1"))
    r2 = right.select(F.col(right_key).alias("_k2"), F.struct(value).alias("_m2"))
    both = keyed.join(r1, "_k1", "left").join(r2, "_k2", "left")
    m1, m2 = F.col("_m1"), F.col("_m2")

    def match(m: Column, by: Column) -> Column:
        return F.when(m.isNotNull(), F.struct(m[value].alias("value"), by.alias("by")))

    hit1 = match(m1, F.lit("first"))
    hit2 = match(m2, F.when(m1.isNotNull(), "both").otherwise("second"))
    if dedupe:
        matched = both.withColumn("_m", F.coalesce(hit1, hit2))
    else:
        matched = both.withColumn("_m", F.explode_outer(F.array_compact(F.array(hit1, hit2))))
    return matched.withColumns({value: F.col("_m.value"), "matched_by": F.col("_m.by")}).drop(
        "_k1", "_k2", "_m1", "_m2", "_m"
    )
