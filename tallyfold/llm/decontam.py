"""Benchmark decontamination by the q-gram lemma.

Texts and benchmark items are compared in a plain form (Latin capitals lower-cased, runs
of anything but letters, digits and non-ASCII bytes turned into one space). An
item is cut into overlapping windows. If a stretch of a document is within
``e`` edits of a window of length n, the two share at least n - q + 1 - q*e
q-grams, and these lie in a band of ``e`` neighbouring diagonals. So: hash all
q-grams of a document at once, look them up in the items' q-grams, count them
by window and diagonal band (bands overlap by half, so that any ``e``
neighbouring diagonals lie within one), keep the bands that reach the bound,
and verify those by an alignment inside the band. Nothing is shuffled: the
items are a query set of bounded size, and larger ones pass in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.hashing import LOWER, U
from tallyfold.llm.tables import bounded_batches, text_chunks, text_of

Q = 12
WINDOW = 96
STRIDE = 32
# One edit allowed for so many characters of a window.
CHARS_PER_EDIT = 16
# Items with a plain form shorter than this are no evidence of anything.
MIN_ITEM = 40
# Bytes of item text that one pass over the documents takes, which bounds what is broadcast.
BLOCK_BYTES = 4 << 20
_FILTER_BITS = 22

_PLAIN = LOWER.copy()
_PLAIN[[b for b in range(128) if not (chr(b).isalnum())]] = 32


def plain(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Plain form of the bytes, and where each of its bytes came from."""
    mapped = _PLAIN[data]
    # Capitals of two-byte Latin letters (C3 80 to C3 9E, but for the multiplication sign).
    mapped[1:][(data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)] += 32
    blank = mapped == 32
    keep = np.ones(len(data), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    where = np.flatnonzero(keep)
    return mapped[where], where


def grams(data: np.ndarray) -> np.ndarray:
    """Hash of the Q bytes from each position on."""
    if len(data) < Q:
        return np.zeros(0, U)
    x = data.astype(np.uint32)
    two = x[:-1] | (x[1:] << np.uint32(8))
    four = two[:-2] | (two[2:] << np.uint32(16))
    n = len(data) - Q + 1
    a, b, c = (four[k : k + n].astype(U) for k in (0, 4, 8))
    mixed = ((a | (b << U(32))) * U(0x9E3779B97F4A7C15)) ^ (c * U(0xC2B2AE3D27D4EB4F))
    mixed ^= mixed >> U(29)
    return mixed * U(0xBF58476D1CE4E5B9)


class ItemIndex:
    """The q-grams of a block of items, with their windows."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids: list[int] = []
        self.windows: list[tuple[int, int, int]] = []  # item, start, length
        self.texts: list[bytes] = []
        gram, window, at = [], [], []
        for item, text in items:
            form = plain(np.frombuffer(text.encode(), np.uint8))[0]
            form = np.frombuffer(form.tobytes().strip(), np.uint8)
            if len(form) < MIN_ITEM:
                continue
            k = len(self.ids)
            self.ids.append(item)
            self.texts.append(form.tobytes())
            hashes = grams(form)
            length = min(WINDOW, len(form))
            starts = sorted({*range(0, len(form) - length + 1, STRIDE), len(form) - length})
            for start in starts:
                inner = np.arange(start, start + length - Q + 1)
                gram.append(hashes[inner])
                window.append(np.full(len(inner), len(self.windows)))
                at.append(inner - start)
                self.windows.append((k, start, length))
        self.length = np.array([w[2] for w in self.windows], np.int64)
        self.edits = np.minimum(self.length // CHARS_PER_EDIT, (self.length - Q) // Q)
        self.bound = self.length - Q + 1 - Q * self.edits
        self.gram = np.concatenate(gram) if gram else np.zeros(0, U)
        order = np.argsort(self.gram, kind="stable")
        self.gram = self.gram[order]
        self.window = (np.concatenate(window) if window else np.zeros(0, np.int64))[order]
        self.at = (np.concatenate(at) if at else np.zeros(0, np.int64))[order]
        self.seen = np.zeros(1 << _FILTER_BITS, bool)
        self.seen[self.gram >> U(64 - _FILTER_BITS)] = True

    @classmethod
    def shared(cls, state) -> ItemIndex:
        """The index whose plain arrays were broadcast."""
        index = cls.__new__(cls)
        index.__dict__ = state.value
        return index

    def candidates(self, form: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, first diagonal, width) of the bands that reach the bound;
        a diagonal is a position in ``form`` less one in the window."""
        none = (np.zeros(0, np.int64),) * 3
        hashes = grams(form)
        hit = np.flatnonzero(self.seen[hashes >> U(64 - _FILTER_BITS)])
        if not len(hit) or not len(self.gram):
            return none
        low = np.searchsorted(self.gram, hashes[hit], side="left")
        found = self.gram[np.minimum(low, len(self.gram) - 1)] == hashes[hit]
        hit, low = hit[found], low[found]
        # A band's hits lie within the longest stretch that a window may match.
        span = WINDOW + WINDOW // CHARS_PER_EDIT
        near = np.searchsorted(hit, hit + span) - np.searchsorted(hit, hit - span)
        enough = near >= int(self.bound.min())
        hit, low = hit[enough], low[enough]
        if not len(hit):
            return none
        count = np.searchsorted(self.gram, hashes[hit], side="right") - low
        entry = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        window, diagonal = self.window[entry], np.repeat(hit, count) - self.at[entry]
        width = 2 * (self.edits[window] + 1)
        shift = diagonal + WINDOW  # not negative
        out = []
        for half in (0, 1):
            band = (shift + half * (width // 2)) // width
            keys, total = np.unique(window * (1 << 40) + band, return_counts=True)
            which = keys >> 40
            good = total >= self.bound[which]
            keys, which = keys[good], which[good]
            wide = 2 * (self.edits[which] + 1)
            first = (keys & ((1 << 40) - 1)) * wide - half * (wide // 2) - WINDOW
            out.append((which, first, wide))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def verify(self, text: bytes, window: int, first: int, width: int) -> tuple[int, int, int] | None:
        """(edits, start, end) of the best stretch of ``text`` in the band
        whose edits are within the window's budget."""
        k, start, length = self.windows[window]
        pattern = self.texts[k][start : start + length]
        budget = int(self.edits[window])
        a, b = max(0, first - budget), min(len(text), first + width + length + budget)
        whole = text.find(pattern, a, b)
        if whole >= 0:
            return 0, whole, whole + length
        if not budget:
            return None
        # Alignment with free ends in the text, over the band's diagonals only.
        # Cell d of row i stands for text position first - budget + d + i.
        cells = width + 2 * budget + 1
        base = first - budget
        far = length + 1
        row = np.zeros(cells, np.int64)
        place = base + np.arange(cells)
        row[(place < 0) | (place > len(text))] = far
        raw = np.frombuffer(text, np.uint8)
        ramp = np.arange(cells)
        origin = ramp.copy()
        for i in range(1, length + 1):
            at = base + ramp + i  # text position after taking at - 1
            valid = (at >= 1) & (at <= len(text))
            same = np.zeros(cells, bool)
            same[valid] = raw[at[valid] - 1] == pattern[i - 1]
            diagonal = row + ~same
            up = np.append(row[1:], far) + 1
            best = np.where(diagonal <= up, diagonal, up)
            came = np.where(diagonal <= up, origin, np.append(origin[1:], 0))
            best[~valid & (at != 0)] = far
            # Insertions run along the row: a running minimum of best - position.
            slope = best - ramp
            least = np.minimum.accumulate(slope)
            source = np.maximum.accumulate(np.where(slope == least, ramp, 0))
            row, origin = least + ramp, came[source]
        end = int(np.argmin(row))
        if row[end] > budget:
            return None
        return int(row[end]), max(0, base + int(origin[end])), min(len(text), base + end + length)

    def matches(self, form: np.ndarray) -> dict[int, tuple[int, int, int, int]]:
        """item -> (windows found, fewest edits, start, end) in a plain form."""
        which, first, width = self.candidates(form)
        found: dict[int, dict[int, tuple[int, int, int]]] = {}
        text = form.tobytes() if len(which) else b""
        for w, f, d in zip(which.tolist(), first.tolist(), width.tolist(), strict=True):
            if match := self.verify(text, w, f, d):
                own = found.setdefault(self.windows[w][0], {})
                had = own.get(w, match)
                own[w] = (min(had[0], match[0]), min(had[1], match[1]), max(had[2], match[2]))
        return {
            k: (len(own), min(m[0] for m in own.values()), min(m[1] for m in own.values()), max(m[2] for m in own.values()))
            for k, own in found.items()
        }

    def suspects(self, form: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows of a run of texts that a band may lie in."""
        which, first, width = self.candidates(form)
        if not len(which):
            return np.zeros(0, np.int64)
        low = np.searchsorted(offsets, first, side="right") - 1
        high = np.searchsorted(offsets, first + width + self.length[which], side="right") - 1
        # All rows in between but those too short for any window; a blank may have gone at either end.
        rows = np.flatnonzero(np.diff(offsets) + 2 >= int((self.length - self.edits).min()))
        begin = np.searchsorted(rows, low)
        count = np.searchsorted(rows, high, side="right") - begin
        inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.unique(rows[np.repeat(begin, count) + inner])

    def rows(self, column: pa.Array) -> Iterator[tuple[int, dict[int, tuple[int, int, int, int]]]]:
        """(row, matches by item with code-point spans) of the rows that have any."""
        for begin, _, data, offsets in text_chunks(column):
            form, where = plain(data)
            for row in self.suspects(form, np.searchsorted(where, offsets)).tolist():
                own = data[offsets[row] : offsets[row + 1]]
                own_form, own_where = plain(own)
                hits = self.matches(own_form)
                if hits:
                    points = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])
                    place = np.append(own_where, len(own))
                    yield begin + row, {k: (n, e, int(points[place[s]]), int(points[place[t]])) for k, (n, e, s, t) in hits.items()}


def item_blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> Iterator:
    """Broadcast indexes of the items, as many as their size asks for. Items
    with a null id or text are left out."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text")).dropna()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // BLOCK_BYTES)
    for k in range(blocks):
        own = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        # A block holds about BLOCK_BYTES of text, whatever the size of the table.
        yield spark.sparkContext.broadcast(vars(ItemIndex([(r[0], r[1]) for r in own.sort("item", "text").toLocalIterator()])))


def contaminated_passages(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """(doc_id, item_id, n_windows, edits, start, end): one row per document
    row and benchmark item that it holds a passage of.

    ``n_windows`` counts the item's windows found, ``edits`` is the fewest of
    one of them, ``start`` and ``end`` (code points, end exclusive) span all.
    Null or empty texts and items of fewer than ``MIN_ITEM`` plain characters
    match nothing; a null document id is carried through; repeated rows give
    repeated results, repeated items count each. An empty table on either side
    gives no rows. Other columns are ignored.
    """
    schema = "doc_id long, item_id long, n_windows long, edits long, start long, end long"
    chosen = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))

    def search(index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = ItemIndex.shared(index)
            for batch in batches:
                ids = batch.column(0).to_pylist()
                rows = [(ids[r], items.ids[k], *m) for r, hits in items.rows(batch.column(1)) for k, m in sorted(hits.items())]
                if rows:
                    columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "n_windows", "edits", "start", "end"])

        return run

    out = None
    for index in item_blocks(benchmark, item_col, item_text_col):
        part = chosen.mapInArrow(search(index), schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a passage of a benchmark item; all
    columns stay as they are. Null and empty texts stay."""

    def clean(index):
        @F.pandas_udf("boolean")
        def flag(text: pd.Series) -> pd.Series:
            out = np.ones(len(text), bool)
            out[[r for r, _ in ItemIndex.shared(index).rows(pa.array(text, pa.large_string(), from_pandas=True))]] = False
            return pd.Series(out)

        return flag

    bounded_batches(docs)
    for index in item_blocks(benchmark, item_col, item_text_col):
        docs = docs.filter(clean(index)(text_of(text_col)))
    return docs
