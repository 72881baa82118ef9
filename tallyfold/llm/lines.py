"""Line deduplication by range partitions and one streaming pass.

Every line becomes (hash of its key, document, position). The rows are dealt
to range partitions by hash and document, and sorted there by hash, document
and position, so a line that a third of all documents share spreads over many
partitions. One pass over a partition counts the documents of each hash and
lets go of a row as soon as its fate is known; it holds the rows of fewer than
``min_docs`` documents. Only the first and the last hash of a partition may go
on in another one: their rows come out undecided with a count, and at most two
counts a partition settle them. What returns to the documents is a compressed
bitmap of the lines to keep, not text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.llm.tables import bounded_batches, stage, text_of

# What is stripped from a line's ends, and the letters that are lower-cased.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

DROP, UNDECIDED, COUNT = 0, 1, 2
_FATES = "kind int, h1 long, h2 long, doc long, txt long, pos int, part int, lead boolean, n long"
_COLUMNS = ["h1", "h2", "doc", "txt", "pos"]


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _identity(id_col: str, text_col: str) -> list[Column]:
    """A document is told by its id and its text, so that rows which share an
    id, or have none, keep lines of their own."""
    ids = F.col(id_col).cast("long")
    return [F.coalesce(ids, F.lit(-(2**63))).alias("doc"), F.xxhash64(text_of(text_col)).alias("txt")]


class _Fates:
    """State of one partition's pass."""

    def __init__(self, min_docs: int, keep_first: bool, part: int):
        self.min_docs, self.keep_first, self.part = min_docs, keep_first, part
        self.key = None
        self.opening = True  # the open group is the partition's first
        self.out: list[tuple] = []

    def emit(self, kind: int, key, doc, txt, pos, lead: bool = False, n: int = 0) -> None:
        size = len(doc)
        if size:
            leads = np.zeros(size, bool)
            leads[0] = lead
            self.out.append((np.full(size, kind, np.int32), np.full(size, key[0]), np.full(size, key[1]), doc, txt, pos, leads, np.full(size, n, np.int64)))

    def count(self) -> None:
        zero = np.zeros(1, np.int64)
        self.emit(COUNT, self.key, zero, zero, np.zeros(1, np.int32), n=self.docs)

    def add(self, key, doc, txt, pos) -> None:
        """More rows of one hash, in order."""
        if key != self.key:
            self.close(last=False)
            self.opening = self.key is None
            self.key, self.docs, self.last, self.held, self.decided, self.begun = key, 0, None, [], False, False
        steps = int(((doc[1:] != doc[:-1]) | (txt[1:] != txt[:-1])).sum())
        self.docs += steps + (self.last != (doc[0], txt[0]))
        self.last = (doc[-1], txt[-1])
        if self.opening:
            self.emit(UNDECIDED, key, doc, txt, pos, lead=not self.begun)
            self.begun = True
        elif self.decided:
            self.emit(DROP, key, doc, txt, pos)
        else:
            self.held.append((doc, txt, pos))
            if self.docs >= self.min_docs:
                self.decided = True
                rows = [np.concatenate(x)[int(self.keep_first) :] for x in zip(*self.held, strict=True)]
                self.held = []
                self.emit(DROP, key, *rows)

    def close(self, last: bool) -> None:
        if self.key is None:
            return
        if self.opening:
            self.count()
        elif last:
            if self.held:
                self.emit(UNDECIDED, self.key, *[np.concatenate(x) for x in zip(*self.held, strict=True)], lead=True)
            self.count()

    def batch(self, h1, h2, doc, txt, pos) -> None:
        start = np.flatnonzero(np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]))
        end = np.append(start[1:], len(h1))
        key = (int(h1[0]), int(h2[0]))
        self.add(key, doc[: end[0]], txt[: end[0]], pos[: end[0]])
        if len(start) == 1:
            return
        # Groups that lie whole within the batch.
        step = np.concatenate([[1], (doc[1:] != doc[:-1]) | (txt[1:] != txt[:-1])]).astype(np.int64)
        step[start] = 1
        docs = np.add.reduceat(step, start)
        for g in np.flatnonzero(docs[1:-1] >= self.min_docs) + 1:
            a, b = start[g] + int(self.keep_first), end[g]
            self.emit(DROP, (h1[start[g]], h2[start[g]]), doc[a:b], txt[a:b], pos[a:b])
        a = start[-1]
        self.add((int(h1[a]), int(h2[a])), doc[a:], txt[a:], pos[a:])

    def take(self) -> Iterator[pa.RecordBatch]:
        if self.out:
            kind, h1, h2, doc, txt, pos, lead, n = (np.concatenate(x) for x in zip(*self.out, strict=True))
            self.out = []
            part = np.full(len(kind), self.part, np.int32)
            columns = [kind, h1, h2, doc, txt, pos, part, lead, n]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["kind", "h1", "h2", "doc", "txt", "pos", "part", "lead", "n"])


def _stream(min_docs: int, keep_first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fates = _Fates(min_docs, keep_first, TaskContext.get().partitionId())
        for batch in batches:
            if batch.num_rows:
                fates.batch(*(c.to_numpy(zero_copy_only=False) for c in batch.columns))
                yield from fates.take()
        fates.close(last=True)
        yield from fates.take()

    return run


@F.pandas_udf(T.BinaryType())
def _bitmap(dropped: pd.Series) -> pd.Series:
    """Bit per line up to the last one dropped, 1 to keep; lines after it stay."""

    def pack(positions) -> bytes:
        keep = np.ones(int(max(positions)) + 1, bool)
        keep[np.asarray(positions)] = False
        return zlib.compress(np.packbits(keep).tobytes() + bytes([-len(keep) % 8]))

    return dropped.map(pack)


@F.pandas_udf(T.StringType())
def _kept(text: pd.Series, bitmap: pd.Series) -> pd.Series:
    def join(line_text, packed):
        if packed is None or line_text is None:
            return line_text
        raw = zlib.decompress(packed)
        bits = np.unpackbits(np.frombuffer(raw[:-1], np.uint8))
        bits = bits[: len(bits) - raw[-1]]
        lines = line_text.split("\n")
        return "\n".join([x for x, bit in zip(lines, bits, strict=False) if bit] + lines[len(bits) :])

    return pd.Series([join(t, b) for t, b in zip(text, bitmap, strict=True)], dtype=object)


def line_bitmaps(
    docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc, txt, n_dropped, bitmap): the documents that lose lines, told by id
    (the least long for a null id) and hash of the text."""
    rows = docs.select(*_identity(id_col, text_col), F.posexplode(F.split(text_of(text_col), "\n", -1)).alias("pos", "line"))
    rows = rows.withColumn("line", line_key(F.col("line"))).filter(F.length("line") >= min_chars)
    rows = rows.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "doc", "txt", "pos")
    dealt = rows.repartitionByRange("h1", "h2", "doc", "txt").sortWithinPartitions(*_COLUMNS)
    # Written, since two readers must see the same partitions.
    fates = stage(dealt.mapInArrow(_stream(min_docs, keep_first), _FATES), "line-fates")
    totals = fates.filter(F.col("kind") == COUNT).groupBy("h1", "h2").agg(F.sum("n").alias("total"), F.min("part").alias("first_part"))
    # At most two hashes a partition, so the broadcast is bounded by the number of partitions.
    settled = fates.filter(F.col("kind") == UNDECIDED).join(F.broadcast(totals), ["h1", "h2"]).filter(F.col("total") >= min_docs)
    if keep_first:
        settled = settled.filter(~(F.col("lead") & (F.col("part") == F.col("first_part"))))
    drops = fates.filter(F.col("kind") == DROP).select("doc", "txt", "pos").unionByName(settled.select("doc", "txt", "pos"))
    by_doc = drops.groupBy("doc", "txt").agg(F.collect_set("pos").alias("dropped"))
    return by_doc.select("doc", "txt", F.size("dropped").cast("long").alias("n_dropped"), _bitmap("dropped").alias("bitmap"))


def drop_repeated_lines(
    docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` (before) and ``n_dropped``.

    A line's key is the line without blanks at its ends, in lower case (A-Z).
    Keys of at least ``min_chars`` characters found in at least ``min_docs``
    documents lose all their lines; with ``keep_first`` the first line by
    document and position stays. Rows that are equal in id and text count as
    one document and are treated alike. A null or empty text is one empty
    line, which has no key. Other columns pass through; an empty table gives
    no rows.
    """
    bitmaps = line_bitmaps(docs, min_docs, min_chars, keep_first, id_col, text_col)
    bitmaps = bitmaps.select(*(F.col(c).alias(f"__line_{c}") for c in bitmaps.columns))
    doc, txt = _identity(id_col, text_col)
    own = bounded_batches(docs).withColumns({"__doc": doc, "__txt": txt})
    joined = own.join(bitmaps, (F.col("__doc") == F.col("__line_doc")) & (F.col("__txt") == F.col("__line_txt")), "left")
    text = text_of(text_col)
    touched = F.col("__line_bitmap").isNotNull()
    return joined.select(
        *docs.columns,
        F.when(touched, _kept(F.when(touched, text), F.col("__line_bitmap"))).otherwise(text).alias("kept_text"),
        (F.length(text) - F.length(F.translate(text, "\n", "")) + 1).cast("long").alias("n_lines"),
        F.coalesce("__line_n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
    )


KEPT_SQL = """
with lines as (
    select rid, doc_id, line, pos,
           translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
    from (select rid, doc_id, unnest(parts) as line, generate_subscripts(parts, 1) as pos
          from (select row_number() over () as rid, doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents))
), common as (
    select key from lines where length(key) >= 1 group by key having count(distinct doc_id) >= 10
)
select doc_id, count(*) as n_lines, count(c.key) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where c.key is null), '')) as kept_sha256
from lines l left join common c on l.key = c.key
group by rid, doc_id
"""
