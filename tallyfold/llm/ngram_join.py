"""Similarity join of documents on the Jaccard index of their word shingles.

Method: universe partition with the pigeonhole principle. Two sets with
``J >= t`` and sizes x, y differ in at most ``H = (1-t)/(1+t) * (x+y)``
elements. The hash universe is cut into segments, as many as the size band
(sizes of one power of two) needs, so that at least one segment of two linked
sets agrees. A cost model deals the difference budget to the segments of a
band: either exact segments (one signature each), or segments that may differ
by one element (the segment's one-deletion neighbourhood, one signature for
each element more), which pays where sets are so small that exact segments
would hold next to nothing. Exact bands have spare segments; a set drops as
many of its least telling segments (fewest elements) as the spare allows, by an order that both
sides share, so the least dropped agreeing segment is kept on both sides.
Every candidate is verified on its whole sets; no link is lost.

A set also has a sketch: the parity of its elements in each of 1024 cells. Two
sets differ in at least as many elements as their sketches do in cells, so a
pair whose sketches differ by more than ``H`` is none, and the join drops it
before it becomes a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyfold.llm.components import connected_components
from tallyfold.llm.hashing import U, mix, salt, shingle_sets
from tallyfold.llm.tables import bounded_batches, stage, text_chunks, text_of

# How many rows the list of a segment with at most one element is taken to
# hold, against one for any other: the cost model's only guess. It moves cost,
# not results.
WEAK_LIST = 200
# Cells of a parity sketch.
CELLS = 1024


class SegmentPlan:
    """Segments, allocation and kept signatures by set size for one threshold
    (a fraction ``percent / 100``)."""

    def __init__(self, percent: int):
        if not 50 <= percent <= 99:
            raise ValueError("the threshold must be 50 to 99 percent")
        self.percent = percent
        self._bands: dict[int, tuple[str, int]] = {}

    def budget(self, x: int, y: int) -> int:
        """Most elements in which linked sets of these sizes differ."""
        return (100 - self.percent) * (x + y) // (100 + self.percent)

    def largest_partner(self, size: int) -> int:
        return size * 100 // self.percent

    def band(self, b: int) -> tuple[str, int]:
        """Kind of signature and number of segments of the sizes 2**b to
        2**(b+1)-1."""
        if b in self._bands:
            return self._bands[b]
        low, high = 1 << b, (2 << b) - 1
        need = self.budget(high, high) + 1
        exact = need + -(-need // 10) + 1
        deletion = (need + 1) // 2
        size = (low + high) // 2
        kept = min(exact, self.budget(size, min(high, self.largest_partner(size))) + 1)

        def weak(m: int) -> float:
            """Expected segments of ``m`` with at most one of ``size`` elements."""
            return m * (1 - 1 / m) ** size + size * (1 - 1 / m) ** (size - 1) if m > 1 else 0.0

        costs = {
            # The weakest segments are the ones dropped.
            "exact": kept + WEAK_LIST * max(0.0, weak(exact) - (exact - kept)),
            "deletion": size + deletion + WEAK_LIST * weak(deletion),
        }
        kind = min(costs, key=costs.get)
        self._bands[b] = kind, exact if kind == "exact" else deletion
        return self._bands[b]

    def schemes(self, size: int) -> list[tuple[int, str, int, int]]:
        """(band, kind, segments, difference budget) a set of this size is
        indexed in: its own band, and the next one if a partner may lie there."""
        own, top = int(size).bit_length() - 1, self.largest_partner(size)
        out = []
        for b in range(own, top.bit_length()):
            budget = self.budget(size, min(top, (2 << b) - 1))
            if budget:
                out.append((b, *self.band(b), budget))
        return out

    def signatures(self, own: np.ndarray) -> np.ndarray:
        """Signatures of a set given as sorted distinct hashes."""
        out = []
        for b, kind, m, budget in self.schemes(len(own)) if len(own) else []:
            segment = ((own >> U(32)) * U(m)) >> U(32)
            start = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
            sums, index = np.add.reduceat(own, start), segment[start]
            base = U(salt(b, m))
            if kind == "deletion":
                which = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(own))))
                empty = np.setdiff1d(np.arange(m, dtype=U), index)
                index = np.concatenate([index, index[which], empty])
                sums = np.concatenate([sums, sums[which] - own, np.zeros(len(empty), U)])
                out.append(np.unique(mix(mix(sums) + mix(index + base))))
                continue
            count = np.diff(np.append(start, len(own)))
            signature = mix(mix(sums) + mix(index + base))
            keep = min(budget + 1, m)
            if len(signature) < keep:
                empty = np.setdiff1d(np.arange(m, dtype=U), index)
                signature = np.concatenate([signature, mix(mix(np.zeros(len(empty), U)) + mix(empty + base))])
                count = np.concatenate([count, np.zeros(len(empty), np.int64)])
            out.append(signature[np.lexsort((signature, -count))[:keep]])
        return np.concatenate(out) if out else np.zeros(0, U)


def node_of(own: np.ndarray) -> int:
    """Hash of the whole set; 0 only for the empty one."""
    if not len(own):
        return 0
    return int(np.int64(mix(np.array([mix(own).sum(dtype=U) + U(len(own))], U)).view(np.int64)[0])) or 1


def sketch_of(own: np.ndarray) -> np.ndarray:
    """Parity of the elements in each cell, as longs."""
    odd = np.bincount((own & U(CELLS - 1)).astype(np.int64), minlength=CELLS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    cut = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64)))


def _marks(plan: SegmentPlan, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            ids, texts = batch.columns
            for first, end, data, offsets in text_chunks(texts):
                sets = shingle_sets(data, offsets, words)
                nodes = [node_of(s) for s in sets]
                # Of equal sets in a task the first alone is indexed.
                new = []
                for k, node in enumerate(nodes):
                    if node and node not in seen:
                        seen.add(node)
                        new.append(k)
                marks, cells = [np.zeros(0, np.int64)] * len(sets), [np.zeros(0, np.int64)] * len(sets)
                for k in new:
                    marks[k], cells[k] = plan.signatures(sets[k]).view(np.int64), sketch_of(sets[k])
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(first, end - first),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(nodes, pa.int64()),
                        _lists(marks),
                        _lists(cells),
                    ],
                    names=["doc_id", "n_shingles", "node", "marks", "sketch"],
                )

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.columns[0]):
                sets = shingle_sets(data, offsets, words)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([node_of(s) for s in sets], pa.int64()), _lists([s.view(np.int64) for s in sets])],
                    names=["node", "elements"],
                )

    return run


def shingle_marks(docs: DataFrame, percent: int = 80, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, node, marks, sketch) per row: set size, hash of the
    set, its signatures and its sketch (both empty for all but one of the equal
    sets in a task)."""
    chosen = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return chosen.mapInArrow(_marks(SegmentPlan(percent), words), "doc_id long, n_shingles long, node long, marks array<long>, sketch array<long>")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int, words: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) of nodes whose sets reach the threshold."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = asked.join(nodes.select("node", "rep"), "node").select(F.col("rep").alias("doc_id")).distinct()
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    texts = chosen.join(wanted, "doc_id", "left_semi").select("text")
    sets = stage(texts.mapInArrow(_sets(words), "node long, elements array<long>").dropDuplicates(["node"]), "sets")
    left = sets.select(F.col("node").alias("a"), F.col("elements").alias("xs"))
    right = sets.select(F.col("node").alias("b"), F.col("elements").alias("ys"))
    both = pairs.join(left, "a").join(right, "b")
    same = F.size(F.array_intersect("xs", "ys"))
    union = F.size("xs") + F.size("ys") - same
    return both.filter(100 * same >= percent * union).select("a", "b")


def near_duplicate_groups(
    docs: DataFrame, percent: int = 80, words: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs``.

    Two documents are linked when 100 * common shingles >= percent * all
    shingles of the two; component_id is the least id reachable by links, the
    own one included. Equal sets are one node, however many rows share it. In
    the list of a signature each node is first compared with the least node
    (one pair a row, not all pairs); then only nodes of lists that still hold
    several components are compared across those components. So all links
    between components are known, and those within one need not be.

    Null or empty text, or no words: no shingles, linked with nothing. Rows
    with a null id come back with a null component and take no part. Rows that
    share an id count as one document. Other columns are ignored; an empty
    table gives no rows.
    """
    marks = stage(shingle_marks(docs, percent, words, id_col, text_col), "marks")
    known = marks.filter("doc_id is not null and n_shingles > 0")
    nodes = stage(known.groupBy("node").agg(F.min("doc_id").alias("rep")), "nodes")
    # Rows of a null id are indexed too, if theirs is the first of its set; they only cost a comparison.
    listed = marks.select("node", F.explode("marks").alias("mark"))
    in_order = W.partitionBy("mark").orderBy("node")
    members = listed.withColumns({"centre": F.first("node").over(in_order), "before": F.lag("node").over(in_order)})
    members = stage(members.filter("before != node").select("mark", "node", "centre"), "lists")
    lists = members.unionByName(members.select("mark", F.col("centre").alias("node"), "centre").distinct())

    stars = stage(members.select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    links = stage(_verified(stars, nodes, docs, percent, words, id_col, text_col), "links")
    groups = connected_components(links)

    open_lists = lists.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_marks = open_lists.groupBy("mark").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    rest = open_lists.join(open_marks.select("mark"), "mark", "left_semi").select("mark", "node", "component")
    sketches = marks.filter(F.size("sketch") > 0).select("node", F.col("n_shingles").alias("n"), *(F.col("sketch")[k].alias(f"s{k}") for k in range(CELLS // 64)))
    sketches = sketches.join(rest.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
    # Two nodes are compared in the first of the lists they share, and in no other.
    shared = rest.groupBy("node").agg(F.sort_array(F.collect_list("mark")).alias("marks"))
    rest = stage(rest.join(sketches.join(shared, "node"), "node"), "open-lists")
    one = rest.select("mark", *(F.col(c).alias(f"{c}_a") for c in rest.columns if c != "mark"))
    two = rest.select("mark", *(F.col(c).alias(f"{c}_b") for c in rest.columns if c != "mark"))
    apart = sum((F.bit_count(F.col(f"s{k}_a").bitwiseXOR(F.col(f"s{k}_b"))) for k in range(CELLS // 64)), F.lit(0))
    near = (100 + percent) * apart <= (100 - percent) * (F.col("n_a") + F.col("n_b"))
    once = F.get(F.array_intersect("marks_a", "marks_b"), F.lit(0)) == one["mark"]
    across = one.join(two, (one["mark"] == two["mark"]) & (F.col("component_a") < F.col("component_b")) & F.when(near, once))
    across = across.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()
    across = stage(across.join(stars, ["a", "b"], "left_anti"), "across")
    more = _verified(across, nodes, docs, percent, words, id_col, text_col)
    # Rows of one id with different sets are one document.
    same_id = known.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a < b")
    same_id = known.join(same_id.select("doc_id", "a"), "doc_id").select("a", F.col("node").alias("b")).filter("a < b")
    groups = connected_components(links.unionByName(more).unionByName(same_id))

    placed = nodes.select("node", "rep").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_node = placed.join(least, "component").select("node", "component_id")
    return marks.join(by_node, "node", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component_id")), F.col("doc_id"))).alias(
            "component_id"
        ),
    )
