"""Packing of tokenized documents into sequences of a fixed length.

Method: bounded-space online best fit. A task holds at most ``open_bins``
sequences open; a bitset keyed by free space (bit ``f`` set while some open
sequence has exactly ``f`` free places) finds the tightest sequence a piece
fits in with one shift and one lowest-bit search. When a piece fits in none and
all places are taken, the fullest open sequence closes first.

At scale: the documents are packed where they are read, in doc_id order within
each input split (a sort inside the partition, no shuffle), so a task holds one
document's ids and ``open_bins`` counters at a time. What stays open at the end
of the tasks (at most ``open_bins`` per task) is packed once more as whole
items by the same rule in groups of ``GROUP`` tasks, so few sequences are left
part-filled however many splits there are. Sequence numbers carry the task's
partition number and are the same on every rerun of a task.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.tables import bounded_batches, stage

CAPACITY = 4096
OPEN_BINS = 64
END_ID = 1
# Tasks whose open sequences are packed together in the second round.
GROUP = 64

PIECES = (
    "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, "
    "n_ids long, open boolean"
)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class BestFit:
    """Bounded-space online best fit over sequences of ``capacity`` places.

    ``place(size)`` returns (sequence number, offset). A piece goes to the open
    sequence with the least free space that still holds it; ties go to the
    sequence that reached that free space last. Without one, a new sequence
    opens; if ``open_bins`` are open already, the fullest closes first. A
    sequence that becomes full closes at once and does not take an open place.
    """

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, first: int = 0):
        if capacity < 1 or open_bins < 1:
            raise ValueError("capacity and open_bins must be positive")
        self.capacity, self.open_bins = capacity, open_bins
        self.mask = 0  # bit f: some open sequence has f free places
        self.by_free: dict[int, list[int]] = {}
        self.free_of: dict[int, int] = {}
        self.next = first

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        seq = bins.pop()
        if not bins:
            del self.by_free[free]
            self.mask &= ~(1 << free)
        del self.free_of[seq]
        return seq

    def _put(self, seq: int, free: int) -> None:
        self.by_free.setdefault(free, []).append(seq)
        self.mask |= 1 << free
        self.free_of[seq] = free

    def place(self, size: int) -> tuple[int, int]:
        if not 0 < size <= self.capacity:
            raise ValueError(f"a piece of {size} does not fit sequences of {self.capacity}")
        fits = self.mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            seq = self._take(free)
        else:
            free = self.capacity
            if size < free and len(self.free_of) >= self.open_bins:
                fullest = self.mask & -self.mask
                self._take(fullest.bit_length() - 1)
            seq, self.next = self.next, self.next + 1
        if free > size:
            self._put(seq, free - size)
        return seq, self.capacity - free

    def open_sequences(self) -> dict[int, int]:
        """Open sequence -> places used."""
        return {seq: self.capacity - free for seq, free in self.free_of.items()}


# White space as the tokenizer's own patterns see it (the Unicode White_Space
# property); Arrow, as str.split(), also splits at U+001C to U+001F, which it does not.
WHITE = regex.compile(r"[\p{White_Space}]+")
NOT_WHITE_TO_IT = re.compile("[\x1c-\x1f]")
# Below U+0250, where a letter's lower case is one letter (but for U+0130; some lie
# beyond) and nothing composes: the tokenizer's own cut of a run between white space, lower-cased.
LETTERS = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u02af\u2c65\u2c66"
NUMBERS = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
WORDS = re.compile(f"\n|'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\n{LETTERS}{NUMBERS}]+")
# What is left to the tokenizer as it is: other characters, and what may be a special token.
ODD = re.compile("<\\||[\u0085\u00a0\u0130]|[^\x00-\u024f]")
WORD_END = "</w>"
# Words that are encoded as one text.
JOINED = 4096


def _word_tokenizer(tokenizer):
    """The tokenizer for words cut and lower-cased already, a space between them: the
    same model, without the steps that change nothing in them and without its cache,
    which only costs where every word is new."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    spec = json.loads(tokenizer.to_str())["model"]
    if spec.pop("type") != "BPE":
        return tokenizer
    spec["merges"] = [tuple(m.split(" ") if isinstance(m, str) else m) for m in spec["merges"]]
    given = {k: v for k, v in spec.items() if v is not None}
    plain = Tokenizer(models.BPE(**given, cache_capacity=0))
    byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), byte_level])
    return plain


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places ``start``, ``start + 1``, ... of every run, one after another."""
    after = np.cumsum(sizes)
    total = int(after[-1]) if len(after) else 0
    small = total < 1 << 31 and (not len(starts) or int(starts.max()) + total < 1 << 31)
    kind = np.int32 if small else np.int64
    return np.repeat((starts - (after - sizes)).astype(kind), sizes) + np.arange(total, dtype=kind)


class ChunkIds:
    """Ids of texts, each word encoded once per Python worker.

    Exact for a tokenizer whose normalizer lower-cases, works character by character
    (NFC composes nothing across a space) and whose pre-tokenizer drops white
    space, so that no token spans it: the ids of a text are the ids of its runs
    between white space (chunks) in order, and a chunk's are those of its words.
    ``word_bpe_49k`` is such a tokenizer. The memo is cleared when it holds
    ``limit`` words or ``limit_ids`` ids.

    A batch's distinct chunks are cut into words by ``WORDS``, the tokenizer's own
    pattern for the characters below U+0250. A chunk with others, or with what may
    be a special token, counts as one word and is encoded alone. Other new words
    are encoded together, ``JOINED`` to a text with a space between them. A token
    that ends a word says so in its name (``</w>``), so the ids fall into words;
    if these are not as many as expected, each word is encoded alone.

    The ids lie in one array; a word's number gives their place and length
    there, and a batch's ids are gathered at once.
    """

    def __init__(self, tokenizer, limit: int = 1 << 20, limit_ids: int = 1 << 24):
        self.tokenizer, self.limit, self.limit_ids = tokenizer, limit, limit_ids
        self.words = _word_tokenizer(tokenizer)
        vocab = tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(WORD_END)]] = True
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.flat, self.start, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _alone(self, words: list[str]) -> tuple[list[np.ndarray], list[int]]:
        encoded = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        ids = [np.asarray(e.ids, np.uint32) for e in encoded]
        return ids, [len(i) for i in ids]

    def _together(self, words: list[str]) -> tuple[list[np.ndarray], list[int]]:
        ids = np.asarray(self.words.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.ends[ids])
        if len(ends) != len(words) or ends[-1] != len(ids) - 1:
            return self._alone(words)
        return [ids], np.diff(ends, prepend=-1).tolist()

    def _numbers(self, words: list[str], encode) -> np.ndarray:
        """The words' numbers; new words are learnt by ``encode``."""
        new = [w for w in words if w not in self.number]
        if new:
            runs, sizes = [self.flat], []
            for first in range(0, len(new), JOINED):
                ids, size = encode(new[first : first + JOINED])
                runs.extend(ids)
                sizes.extend(size)
            before = len(self.number)
            self.number.update(zip(new, range(before, before + len(new))))
            self.flat, self.size = np.concatenate(runs), np.append(self.size, np.array(sizes, np.int64))
            self.start = np.cumsum(self.size) - self.size
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def _words_of(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all the chunks' words in order, and how many each chunk has."""
        together = pa.ListArray.from_arrays(pa.array([0, len(chunks)], pa.int32()), chunks)
        text = pc.binary_join(together, pa.scalar("\n", chunks.type))[0].as_py()
        odd = []
        if ODD.search(text):
            found = text.split("\n")
            odd = [k for k, c in enumerate(found) if ODD.search(c)]
            alone = self._numbers([found[k] for k in odd], self._alone)
            for k in odd:
                found[k] = ""
            text = "\n".join(found)
        # A line break before each chunk, the first in the dictionary therefore.
        cut = pa.array(WORDS.findall("\n" + text.lower()), pa.large_string()).dictionary_encode()
        which = cut.indices.to_numpy()
        numbers = self._numbers(cut.dictionary.to_pylist()[1:], self._together)
        words = numbers[which[which > 0] - 1]
        count = np.diff(np.flatnonzero(which == 0), append=len(which)) - 1
        if odd:
            words = np.insert(words, np.cumsum(count)[odd], alone)
            count[odd] = 1
        return words, count

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        # Lower-casing is the tokenizer's own, but for special tokens' text.
        texts = [t.lower() if t.isascii() and "<|" not in t else t for t in texts]
        if any(map(NOT_WHITE_TO_IT.search, texts)):
            parts = pa.array([WHITE.split(t) for t in texts], pa.large_list(pa.large_string()))
        else:
            parts = pc.utf8_split_whitespace(pa.array(texts, pa.large_string()))
            parts = parts.cast(pa.large_list(pa.large_string()))
        if len(self.number) > self.limit or len(self.flat) > self.limit_ids:
            self._clear()
        chunks = parts.flatten().dictionary_encode()
        words, count = self._words_of(chunks.dictionary)
        # The distinct chunks' ids, then those of all chunks as they come.
        size = self.size[words]
        flat = self.flat[_runs(self.start[words], size)]
        after = np.append(0, np.append(0, np.cumsum(size))[np.cumsum(count)])
        which = chunks.indices.to_numpy(zero_copy_only=False)
        size = np.diff(after)[which]
        ids = flat[_runs(after[which], size)]
        cuts = np.append(0, np.cumsum(size))[parts.offsets.to_numpy()]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


@lru_cache(maxsize=1)
def _chunk_ids(tokenizer_file: str) -> tuple:
    """The tokenizer and its memo, kept from one task to the next in a Python
    worker; what a memo holds changes no ids."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_file)
    return tok, ChunkIds(tok)


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _first_round(tokenizer_file: str, capacity: int, open_bins: int, by_chunks: bool):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        tok, chunked = _chunk_ids(tokenizer_file)

        def encode(texts):
            if by_chunks:
                return chunked(texts)
            return [np.asarray(e.ids, np.int64) for e in tok.encode_batch(texts, add_special_tokens=False)]

        part = TaskContext.get().partitionId()
        fit = BestFit(capacity, open_bins, first=part << 32)
        for batch in batches:
            if batch.empty:
                continue
            texts = batch["text"].where(batch["text"].notna(), "").tolist()
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "n_ids")}
            for doc, enc in zip(batch["doc_id"].tolist(), encode(texts)):
                ids = np.append(enc, END_ID)
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    chunk = ids[start : start + capacity]
                    seq, offset = fit.place(len(chunk))
                    out["doc_id"].append(doc)
                    out["piece"].append(piece)
                    out["start"].append(start)
                    out["length"].append(len(chunk))
                    out["ids_crc32"].append(_crc(chunk))
                    out["sequence_id"].append(seq)
                    out["offset"].append(offset)
                    out["n_ids"].append(len(ids))
            frame = pd.DataFrame(out)
            frame["doc_id"] = pd.array(frame["doc_id"], dtype="Int64")
            frame["open"] = False
            yield frame
        # The sequences still open here are packed again with other tasks'.
        still = fit.open_sequences()
        if still:
            yield pd.DataFrame(
                {
                    "doc_id": pd.array([None] * len(still), dtype="Int64"),
                    "piece": -1,
                    "start": 0,
                    "length": list(still.values()),
                    "ids_crc32": 0,
                    "sequence_id": list(still.keys()),
                    "offset": 0,
                    "n_ids": 0,
                    "open": True,
                }
            )

    return pack


def _second_round(capacity: int, open_bins: int):
    def repack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("sequence_id", kind="stable")
        first = int(group["sequence_id"].iloc[0]) | (1 << 31)
        fit = BestFit(capacity, open_bins, first=first)
        moved = [fit.place(int(used)) for used in group["length"]]
        return pd.DataFrame(
            {
                "old": group["sequence_id"].to_numpy(),
                "new": [seq for seq, _ in moved],
                "shift": [offset for _, offset in moved],
            }
        )

    return repack


def pack_documents(
    docs: DataFrame,
    tokenizer_file: str | None = None,
    capacity: int = CAPACITY,
    open_bins: int = OPEN_BINS,
    by_chunks: bool = True,
) -> DataFrame:
    """One row per piece of a document in its sequence.

    A document's ids are its text's ids by the tokenizer in ``tokenizer_file``
    (``word_bpe_49k.json`` of ``public_tokenizers`` by default, no special
    tokens added) followed by ``END_ID``. Documents of more than ``capacity``
    ids are cut into pieces of ``capacity``; the last may be shorter. Columns:
    doc_id, piece (from 0), start (ids of the document before the piece),
    length, ids_crc32 (unsigned crc32 of the ids as little-endian unsigned
    32-bit integers), sequence_id, offset (the piece's first place in its
    sequence; the pieces of a sequence fill it from 0 without gaps), n_ids
    (the document's ids).

    Defined cases: a null or empty text has the one id ``END_ID``; a null
    doc_id is packed like any other and keeps its null; repeated rows are
    packed each; an empty table gives no rows; columns besides doc_id and text
    are ignored, whatever their names. Texts are tokenized whole; with
    ``by_chunks`` (right for tokenizers as ``ChunkIds`` describes), each run
    between white space is tokenized once per Python worker and its ids reused.
    """
    tokenizer_file = tokenizer_file or default_tokenizer()
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = ordered.sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.length("text"), "text"
    )
    first = stage(
        bounded_batches(ordered).mapInPandas(_first_round(tokenizer_file, capacity, open_bins, by_chunks), PIECES),
        "packed",
    )
    placed = first.where(~F.col("open")).drop("open")
    leftovers = first.where(F.col("open")).select("sequence_id", "length")
    moves = leftovers.groupBy((F.shiftright("sequence_id", 32) / GROUP).cast("long").alias("g")).applyInPandas(
        _second_round(capacity, open_bins), "old long, new long, shift long"
    )
    moved = placed.join(moves, placed["sequence_id"] == moves["old"], "left")
    return moved.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        F.coalesce("new", "sequence_id").alias("sequence_id"),
        (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
        "n_ids",
    )
