"""Mixing sources to target weights by Sainte-Lague apportionment.

The corpus is cut into equal-token blocks. Each source's target is turned into
a whole number of blocks by highest quotients target / (2k - 1), and each
source's blocks are dealt to its shards the same way by shard size. Within a
shard the documents stand in a seeded order, their tokens are cut into blocks
in that order, and the shard's quota takes blocks from the start, going round
again when the shard is used up. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyfold.llm.tables import stage, text_of

# Tokens of a block.
BLOCK = 8
# A document, source or shard is taken so many times at most.
MAX_REPEATS = 3
# Documents of a shard, about; a source has as many shards as it needs.
SHARD_DOCS = 2000
SEED = 20240
# Fixed value: the weights of the sources in order, repeated.
WEIGHTS = (1, 2, 3)


def word_count(text: Column) -> Column:
    r"""Number of ``[^\x20\x09-\x0D]+``."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def apportion(rows: DataFrame, group: list[str], seats: str, share: str, cap: str, order: list[Column], out: str) -> DataFrame:
    """Whole seats per row by Sainte-Lague within each ``group``: ``seats`` in
    all, in proportion to ``share``, at most ``cap`` for a row.

    All seats that any outcome within half a seat a row of the exact shares
    gives for sure are dealt by division; the few left go to the highest
    quotients, ties by ``order``.
    """
    whole = W.partitionBy(*group)
    total, n = F.sum(share).over(whole), F.count("*").over(whole)
    rows = rows.withColumns({"__total": total, "__n": n})
    sure_seats = F.greatest(F.col(seats) - F.col("__n") / 2, F.lit(0.0))
    reach_seats = F.col(seats) + F.col("__n") / 2 + 1
    exact = F.when(F.col("__total") > 0, F.col(share) / F.col("__total")).otherwise(F.lit(0.0))
    rows = rows.withColumns(
        {
            "__sure": F.least(F.floor(exact * sure_seats + 0.5), F.col(cap)).cast("long"),
            "__reach": F.least(F.floor(exact * reach_seats + 0.5), F.col(cap)).cast("long"),
        }
    )
    rows = rows.withColumn("__left", F.col(seats) - F.sum("__sure").over(whole))
    key = F.struct(*order)
    asked = rows.withColumn("__key", key).select(
        *group, "__key", "__left", share, F.explode(F.expr("if(__reach > __sure, sequence(__sure + 1, __reach), array())")).alias("__seat")
    )
    quotient = F.col(share) / (2 * F.col("__seat") - 1)
    ranked = asked.withColumn("__rank", F.row_number().over(whole.orderBy(quotient.desc(), "__key", "__seat")))
    won = ranked.filter(F.col("__rank") <= F.col("__left")).groupBy(*group, "__key").agg(F.count("*").alias("__won"))
    keyed = rows.withColumn("__key", key)
    same = [keyed[c].eqNullSafe(won[c]) for c in [*group, "__key"]]
    joined = keyed.join(won, same, "left").select(*(keyed[c] for c in keyed.columns), F.coalesce(won["__won"], F.lit(0)).alias("__won"))
    return joined.withColumn(out, F.col("__sure") + F.col("__won")).drop("__total", "__n", "__sure", "__reach", "__left", "__key", "__won")


def source_targets(sources: DataFrame) -> DataFrame:
    """Adds ``target`` to (source, source_size): the weights share all sizes,
    no target passes ``MAX_REPEATS`` times its source's size, and what is over
    is shared anew by weight.

    With the sources in order of size / weight, those up to some point are at
    their bound and the rest share what is left by weight; running sums find
    the point. One row a source: the list of sources is the mix's own
    configuration, so its windows see thousands of rows, not the corpus.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*(F.lit(w).cast("long") for w in WEIGHTS))
    rows = sources.withColumn("rank", F.row_number().over(by_name))
    rows = rows.withColumn("weight", F.element_at(weights, ((F.col("rank") - 1) % len(WEIGHTS) + 1).cast("int")))
    bound = MAX_REPEATS * F.col("source_size")
    every = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = W.orderBy(bound / F.col("weight"), "rank").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns(
        {
            "__all": F.sum("source_size").over(every),
            "__weights": F.sum("weight").over(every),
            "__bound_before": F.coalesce(F.sum(bound).over(before), F.lit(0)),
            "__weight_before": F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    )
    # What a unit of weight gets if all sources before this one are at their bound.
    level = (F.col("__all") - F.col("__bound_before")) / (F.col("__weights") - F.col("__weight_before")).cast("double")
    fits = bound >= level * F.col("weight")
    first_fit = F.min(F.when(fits, F.struct(bound / F.col("weight"), "rank", level.alias("level")))).over(every)
    rows = rows.withColumn("__level", first_fit["level"])
    target = F.least(bound.cast("double"), F.col("__level") * F.col("weight"))
    return rows.withColumn("target", F.coalesce(target, bound.cast("double"))).select("source", "source_size", "rank", "target")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, shard, shard_quota, taken)
    per row.

    ``size`` counts words; ``taken`` is how many the mix takes of the row,
    repeats counted, never over ``MAX_REPEATS * size``. Rows are placed by a
    seeded hash of id and text, so reruns agree; equal rows are told apart by
    their count, which any order of them gives. Null or empty texts have size
    0 and give nothing; a null source is a source of its own, last in order; a
    null id is an id like any other. A source's words come within a few blocks
    of its target. An empty table gives no rows. Other columns are ignored.
    """
    text = text_of(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        word_count(text).alias("size"),
        F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(text.cast("binary")))).alias("place"),
    )
    rows = stage(rows, "mix-sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    shards_of = sources.select(F.col("source").alias("s"), F.greatest(F.lit(1), F.ceil(F.col("docs") / SHARD_DOCS)).cast("long").alias("n_shards"))
    shard = F.pmod(F.conv(F.substring("place", 1, 8), 16, 10).cast("long"), F.col("n_shards"))
    # One row a source on the right, which is the mix's configuration.
    rows = rows.join(F.broadcast(shards_of), F.col("source").eqNullSafe(F.col("s"))).withColumn("shard", shard).drop("s", "n_shards")

    targets = source_targets(sources.select("source", "source_size"))
    blocks = targets.withColumns(
        {
            "__one": F.lit(1),
            "blocks": F.round(F.sum("target").over(W.partitionBy(F.lit(1))) / BLOCK).cast("long"),
            "most": F.floor(MAX_REPEATS * F.col("source_size") / BLOCK).cast("long"),
        }
    )
    quotas = apportion(blocks, ["__one"], "blocks", "target", "most", [F.col("rank")], "quota")
    quotas = quotas.select(F.col("source").alias("s"), "source_size", "target", "quota")

    shards = rows.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"))
    shards = shards.join(F.broadcast(quotas), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    shards = shards.withColumn("most", F.floor(MAX_REPEATS * F.col("shard_size") / BLOCK).cast("long"))
    shards = apportion(shards, ["source"], "quota", "shard_size", "most", [F.col("shard")], "shard_quota")
    shards = shards.select(F.col("source").alias("s"), F.col("shard").alias("k"), "shard_size", "source_size", "target", "shard_quota")

    in_order = W.partitionBy("source", "shard").orderBy("place").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = rows.withColumn("until", F.sum("size").over(in_order))
    full = placed.join(shards, F.col("source").eqNullSafe(F.col("s")) & (F.col("shard") == F.col("k")))
    words = F.col("shard_quota") * BLOCK
    rounds = F.when(F.col("shard_size") > 0, F.floor(words / F.col("shard_size"))).otherwise(F.lit(0)).cast("long")
    rest = words - rounds * F.col("shard_size")
    part = F.least(F.greatest(rest - (F.col("until") - F.col("size")), F.lit(0)), F.col("size"))
    return full.select(
        "doc_id", "source", "size", "source_size", "target", "shard", "shard_quota", (rounds * F.col("size") + part).cast("long").alias("taken")
    )
