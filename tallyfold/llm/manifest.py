"""Merkle manifest of a document table, with nested-interval labels.

Method: every node of the hash tree carries the interval of leaf ranks it
covers, [lo, hi). A parent is the hash of up to ``FANOUT`` consecutive nodes of
one level. Ancestors are attached by containment joins bucketed by level (the
parent of a node at level k is the node of level k + 1 in bucket idx div
FANOUT whose interval contains the node's), and a node's siblings are the other
children of its parent: the parent's interval minus its own, split into the
part before it (left) and after it (right).

At scale: leaf ranks come from a range-partitioned sort and per-task offsets
(no window over a group, so a language with a third of all rows is cut over
many tasks); each level groups at most ``FANOUT`` nodes and is an eighth of the
one below; proofs are passed down from the root by joins whose every key has at
most ``FANOUT`` rows. Levels are written under the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.tables import stage

FANOUT = 8
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def field(column: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value
    (integers in decimal)."""
    value = column.cast("string")
    return F.when(column.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_of(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.concat(field(doc_id), field(source), field(lang), field(n_chars), field(text)), 256)


def tampered(doc_id: Column) -> Column:
    """Rows whose text a test of the proofs changes: 3 divides the unsigned
    crc32 of the decimal doc_id (a null doc_id: never)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 0, F.lit(False))


def _same(name: str, other: str) -> Column:
    """Null-safe equality of two differently named columns."""
    return F.col(name).eqNullSafe(F.col(other))


def ranked(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """``df`` with ``idx``: its rank (from 0) within ``group`` by ``order``.

    A range-partitioned sort numbers rows within each task; the counts per task
    and group (one row each) give every task's offset within its group.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(group).asc_nulls_first(), *order]
    numbered = stage(
        df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_mid", F.monotonically_increasing_id()),
        "manifest-sorted",
    )
    numbered = numbered.withColumn("_task", F.shiftright("_mid", 33))
    per_task = numbered.groupBy(F.col(group).alias("_pg"), F.col("_task").alias("_pt")).agg(
        F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    before = Window.partitionBy("_pg").orderBy("_pt").rowsBetween(Window.unboundedPreceding, -1)
    per_task = per_task.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    joined = numbered.join(per_task, _same(group, "_pg") & (F.col("_task") == F.col("_pt")))
    return joined.select(
        *(c for c in numbered.columns if c not in ("_mid", "_task")),
        (F.col("_mid") - F.col("_first") + F.col("_before")).alias("idx"),
    )


def build_levels(nodes: DataFrame, group: str) -> list[DataFrame]:
    """Levels of one tree per ``group`` over ``nodes`` (idx, h, any payload).

    Each level has ``group``, idx, lo, hi, h, left and right (concatenated
    hashes of the siblings before and after the node, empty at a top node),
    top (the node is the last one left of its group), and the payload at level 0.
    """
    current = stage(nodes.withColumn("lo", F.col("idx")).withColumn("hi", F.col("idx") + 1), "manifest-level")
    levels = []
    while True:
        sizes = current.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
        busy_groups = sizes.where(F.col("_n") > 1).select(F.col(group).alias("_bg"))
        tops = current.join(busy_groups, _same(group, "_bg"), "left_anti")
        tops = tops.withColumn("left", F.lit("")).withColumn("right", F.lit("")).withColumn("top", F.lit(True))
        if not busy_groups.limit(1).count():
            levels.append(tops)
            return levels
        busy = current.join(busy_groups, _same(group, "_bg"), "left_semi")
        parents = busy.groupBy(group, F.floor(F.col("idx") / FANOUT).alias("idx")).agg(
            F.sort_array(F.collect_list(F.struct("lo", "hi", "h"))).alias("kids"),
            F.min("lo").alias("lo"),
            F.max("hi").alias("hi"),
        )
        parents = stage(parents.withColumn("h", F.sha2(F.array_join(F.col("kids.h"), ""), 256)), "manifest-level")
        up = parents.select(
            F.col(group).alias("_pg"), F.col("idx").alias("_pidx"), F.col("lo").alias("_plo"), F.col("hi").alias("_phi"), "kids"
        )
        contains = (
            _same(group, "_pg")
            & (F.floor(F.col("idx") / FANOUT) == F.col("_pidx"))
            & (F.col("_plo") <= F.col("lo"))
            & (F.col("hi") <= F.col("_phi"))
        )
        children = busy.join(up, contains).select(
            *busy.columns,
            F.array_join(F.transform(F.filter("kids", lambda k: k["hi"] <= F.col("lo")), lambda k: k["h"]), "").alias("left"),
            F.array_join(F.transform(F.filter("kids", lambda k: k["lo"] >= F.col("hi")), lambda k: k["h"]), "").alias("right"),
            F.lit(False).alias("top"),
        )
        levels.append(stage(children.unionByName(tops), "manifest-level"))
        current = parents.drop("kids")


def pass_down(levels: list[DataFrame], group: str, top_paths: DataFrame, carry: list[str]) -> DataFrame:
    """Level 0 of ``levels`` with ``path``: the (left, right) siblings of the
    node and of each ancestor, from the node up, followed by its top node's path
    in ``top_paths`` (``group``, path and the ``carry`` columns)."""
    above = None
    for level in reversed(levels):
        tops = level.where("top")
        heads = top_paths.select(F.col(group).alias("_tg"), F.col("path").alias("_tpath"), *carry)
        tops = tops.join(heads, _same(group, "_tg")).select(*level.columns, F.col("_tpath").alias("path"), *carry)
        if above is not None:
            inner = level.where(~F.col("top"))
            up = above.select(
                F.col(group).alias("_pg"),
                F.col("idx").alias("_pidx"),
                F.col("lo").alias("_plo"),
                F.col("hi").alias("_phi"),
                F.col("path").alias("_ppath"),
                *carry,
            )
            contains = (
                _same(group, "_pg")
                & (F.floor(F.col("idx") / FANOUT) == F.col("_pidx"))
                & (F.col("_plo") <= F.col("lo"))
                & (F.col("hi") <= F.col("_phi"))
            )
            inner = inner.join(up, contains).select(
                *level.columns,
                F.concat(F.array(F.struct(F.col("left").alias("left"), F.col("right").alias("right"))), F.col("_ppath")).alias("path"),
                *carry,
            )
            tops = tops.unionByName(inner)
        above = stage(tops, "manifest-path")
    return above


PATH_TYPE = "array<struct<left:string,right:string>>"


def manifest(docs: DataFrame) -> DataFrame:
    """One row per document: its leaf, its language's subroot, the root, the
    hash of its proof, and the root folded from a tampered copy.

    A leaf is the sha256 (lowercase hex) of doc_id, source, lang, n_chars and
    text, each written by ``field``. Per lang, leaves ascend by doc_id (nulls
    first; equal doc_ids by leaf); while a level has more than one node, every
    ``FANOUT`` consecutive ones (the last run may be shorter, even one) become
    the hash of their concatenated hex digests. What remains is the lang's
    subroot (a lone leaf is its own). Subroots, by lang (null first, UTF-8
    bytewise), give the root the same way. proof_sha256: sha256 of the
    siblings' digests level by level, leaf up to root, left to right within a
    level (of the empty string if there are none). folded_root: the root folded
    from the leaf of the tampered row (``tampered``: A-Z of the text lower-cased,
    null text stays) or else the original leaf, with the original siblings;
    verified: folded_root equals root.

    Defined cases: null in any column is written ``-``; empty and long texts
    are hashed whole; repeated rows are separate leaves; an empty table gives
    no rows; only doc_id, source, lang, n_chars and text are read, so other
    columns, whatever their names, do not matter.
    """
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"),
        F.col("n_chars").cast("long").alias("n_chars"),
        F.col("text").cast("string").alias("text"),
    )
    changed = F.when(tampered(F.col("doc_id")), F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    leaves = base.select(
        "doc_id",
        "lang",
        leaf_of(*(F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))).alias("h"),
        leaf_of(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), changed).alias("leaf_t"),
    )
    leaves = ranked(leaves, "lang", [F.col("doc_id").asc_nulls_first(), F.col("h")])
    leaf_levels = build_levels(leaves, "lang")

    subroots = leaf_levels[0].sparkSession.createDataFrame([], "lang string, h string")
    for level in leaf_levels:
        subroots = subroots.unionByName(level.where("top").select("lang", "h"))
    subroots = subroots.withColumn("_all", F.lit(0))
    subroots = ranked(subroots, "_all", [F.col("lang").asc_nulls_first()])
    root_levels = build_levels(subroots, "_all")
    # One group: its only top node is on the last level.
    root_top = root_levels[-1].where("top").select("_all", F.array().cast(PATH_TYPE).alias("path"), F.col("h").alias("root"))
    in_root = pass_down(root_levels, "_all", root_top, ["root"])
    lang_tops = in_root.select("lang", "path", "root", F.col("h").alias("subroot"))
    placed = pass_down(leaf_levels, "lang", lang_tops, ["root", "subroot"])

    folded = F.aggregate("path", F.col("leaf_t"), lambda acc, x: F.sha2(F.concat(x["left"], acc, x["right"]), 256))
    return placed.select(
        "doc_id",
        F.col("h").alias("leaf"),
        "subroot",
        "root",
        F.sha2(F.array_join(F.transform("path", lambda x: F.concat(x["left"], x["right"])), ""), 256).alias("proof_sha256"),
        folded.alias("folded_root"),
        (folded == F.col("root")).alias("verified"),
        "lang",
        F.size("path").alias("depth"),
    )
