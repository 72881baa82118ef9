"""Alignment of two tokenizations of the same texts.

Method: per document, the tokens of each tokenizer and the bytes they cover
form a token-byte incidence matrix in compressed sparse rows, built by hand
(row pointers are the tokens' byte ends, column indices the byte offsets). The
row-by-row product of Gustavson, A times B transposed, gives every pair of an A
token and a B token that share a byte (a link) with the number of bytes they
share. Offsets where both tokenizations end a token cut the text into groups;
the token-group incidence matrices of A and B are block diagonal, and their
product, whose non-zeros are counted per group, gives the shared-group links.

At scale: the per-document work is a task's. With the default vocabularies a
text's distinct chunks (runs from space to space, which end groups) are aligned
once and put together per text; with others, one text at a time. The corpus-wide count of an id pair (documents that hold it linked) is a grouping
of one row per document and distinct id pair, combined map-side; the counts
return to the links by a join on the pair, where Spark's adaptive plan splits
hot pairs. Nothing travels to the driver.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.tables import bounded_batches, stage

# Pairs of ids travel as one number: A id times 2**PAIR_BITS plus B id.
PAIR_BITS = 20

ALIGNED = pa.schema(
    [
        ("_row", pa.int64()),
        ("doc_id", pa.int64()),
        ("n_a", pa.int64()),
        ("n_b", pa.int64()),
        ("n_groups", pa.int64()),
        ("n_links", pa.int64()),
        ("n_shared", pa.int64()),
        ("groups_sha256", pa.string()),
        ("pair_key", pa.list_(pa.int64())),
        ("pair_n", pa.list_(pa.int64())),
    ]
)
SPARK_SCHEMA = (
    "_row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_shared long, "
    "groups_sha256 string, pair_key array<long>, pair_n array<long>"
)


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def a_encoder(vocab_file: str):
    """(encode, pieces) for A. ``byte_bpe_50k.json`` is run by tiktoken over
    the same vocabulary in its rank form (``byte_bpe_50k.tiktoken`` beside it,
    with the split pattern the tokenizer files name): the same ids, several
    times faster. Other vocabularies go through ``tokenizers``."""
    import base64

    ranks_file = vocab_file[: -len(".json")] + ".tiktoken" if vocab_file.endswith(".json") else ""
    if ranks_file and os.path.exists(ranks_file):
        import public_tokenizers
        import tiktoken

        with open(ranks_file, "rb") as handle:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in handle if line.strip())}
        enc = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        pieces = [b""] * (max(ranks.values()) + 2)
        for piece, rank in ranks.items():
            pieces[rank] = piece
        return (lambda text: enc.encode_ordinary(text)), pieces
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocab_file)
    tok.encode_special_tokens = True
    return (lambda text: tok.encode(text, add_special_tokens=False).ids), a_pieces(vocab_file)


def byte_level_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level BPE vocabularies: printable bytes
    (33-126, 161-172, 174-255) stand for themselves, the others in order for
    the code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {b: chr(b) for b in shown}
    extra = 0
    for b in range(256):
        if b not in chars:
            chars[b] = chr(256 + extra)
            extra += 1
    return {c: b for b, c in chars.items()}


def flat_table(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pieces' bytes in one array, each piece's start and length."""
    lengths = np.fromiter((len(p) for p in pieces), np.int64, len(pieces))
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    flat = np.frombuffer(b"".join(pieces), np.uint8)
    return flat, starts, lengths


def a_pieces(vocab_file: str) -> list[bytes]:
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocab_file)
    alphabet = byte_level_alphabet()
    out = []
    for i in range(tok.get_vocab_size()):
        token = tok.id_to_token(i) or ""
        out.append(bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode())
    return out


def b_pieces(model_file: str) -> list[bytes]:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    out = []
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            out.append(bytes([int(piece[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i):
            out.append(b"")
        else:
            out.append(piece.replace("▁", " ").encode())
    return out


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The bytes of the tokens ``ids`` in order."""
    lens = lengths[ids]
    total = int(lens.sum())
    before = np.cumsum(lens) - lens
    pos = np.arange(total, dtype=np.int64) - np.repeat(before, lens) + np.repeat(starts[ids], lens)
    return flat[pos]


def csr_product(
    a_ptr: np.ndarray, a_idx: np.ndarray, bt_ptr: np.ndarray, bt_idx: np.ndarray, n_cols: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gustavson's row product of two 0/1 matrices in CSR: for every non-zero
    (i, k) of the left matrix, row k of the right one is added into row i.
    Returns the rows, columns and values of the non-zeros of the product, by
    row and then column."""
    rows = np.repeat(np.arange(len(a_ptr) - 1, dtype=np.int64), np.diff(a_ptr))
    lens = bt_ptr[a_idx + 1] - bt_ptr[a_idx]
    out_rows = np.repeat(rows, lens)
    before = np.cumsum(lens) - lens
    at = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(before, lens) + np.repeat(bt_ptr[a_idx], lens)
    cols = bt_idx[at]
    keys, values = np.unique(out_rows * n_cols + cols, return_counts=True)
    return keys // n_cols, keys % n_cols, values


_NAMES: dict[int, np.ndarray] = {}
_SEPARATORS = np.array([",", "|", ";", "\n"], dtype=object)


def _names(size: int) -> np.ndarray:
    """Decimal names of the ids below ``size``."""
    if size not in _NAMES:
        _NAMES[size] = np.array([str(i) for i in range(size)], dtype=object)
    return _NAMES[size]


def _written(a_ids, b_ids, group_a, group_b, start_a, start_b, last=None) -> str:
    """``a1,a2|b1;a3|b2,b3``: each group's A ids, then its B ids. A token's
    place in the string follows from its group's starts, with no sort. After the
    groups numbered in ``last`` comes a line break instead of ``;``."""
    n_a, n_b = len(a_ids), len(b_ids)
    top = int(max(a_ids.max(), b_ids.max())) + 1
    names = _names(max(1 << 16, 1 << (top - 1).bit_length()))
    items = np.empty(n_a + n_b, dtype=object)
    place_a = np.arange(n_a) + start_b[group_a]
    place_b = np.arange(n_b) + start_a[group_b + 1]
    items[place_a] = names[a_ids]
    items[place_b] = names[b_ids]
    group = np.empty(n_a + n_b, np.int64)
    group[place_a], group[place_b] = group_a, group_b
    side = np.zeros(n_a + n_b, np.int8)
    side[place_b] = 1
    between = np.full(len(start_a) - 1, 2, np.int8)
    if last is not None:
        between[last] = 3
    kind = np.where(group[1:] != group[:-1], between[group[:-1]], np.where(side[1:] != side[:-1], 1, 0))
    parts = np.empty(2 * (n_a + n_b) - 1, dtype=object)
    parts[0::2] = items
    parts[1::2] = _SEPARATORS[kind]
    return "".join(parts.tolist())


class Alignment:
    """The alignment of one text's tokens: links and groups; ``of`` gives None where
    either tokenization's bytes differ from the text's (or there are no tokens)."""

    @classmethod
    def of(cls, a_ids: np.ndarray, b_ids: np.ndarray, a_table, b_table, target: bytes) -> Alignment | None:
        if not len(a_ids) or not len(b_ids):
            return None
        want = np.frombuffer(target, np.uint8)
        a_bytes = gather(*a_table, a_ids)
        b_bytes = gather(*b_table, b_ids)
        if len(a_bytes) != len(want) or len(b_bytes) != len(want) or (a_bytes != want).any() or (b_bytes != want).any():
            return None
        la, lb = a_table[2][a_ids], b_table[2][b_ids]
        if (la == 0).any() or (lb == 0).any():
            return None
        return cls(a_ids, b_ids, la, lb)

    def __init__(self, a_ids: np.ndarray, b_ids: np.ndarray, la: np.ndarray, lb: np.ndarray):
        self.a_ids, self.b_ids = a_ids, b_ids
        self.end_a, self.end_b = np.cumsum(la), np.cumsum(lb)
        total = int(self.end_a[-1])
        # Token-byte incidence in CSR: A (tokens x bytes), B transposed (bytes x tokens).
        a_ptr = np.concatenate([[0], self.end_a]).astype(np.int64)
        a_idx = np.arange(total, dtype=np.int64)
        bt_ptr = np.arange(total + 1, dtype=np.int64)
        bt_idx = np.repeat(np.arange(len(b_ids), dtype=np.int64), lb)
        self.ta, tb, _shared_bytes = csr_product(a_ptr, a_idx, bt_ptr, bt_idx, len(b_ids))
        self.pairs = (a_ids[self.ta].astype(np.int64) << PAIR_BITS) | b_ids[tb].astype(np.int64)
        # Groups: cut where both end a token.
        self.cuts = np.intersect1d(self.end_a, self.end_b, assume_unique=True)
        self.group_a = np.searchsorted(self.cuts, self.end_a)
        self.group_b = np.searchsorted(self.cuts, self.end_b)
        size_a = np.bincount(self.group_a, minlength=len(self.cuts))
        size_b = np.bincount(self.group_b, minlength=len(self.cuts))
        # Token-group incidences are block diagonal: their product has size_a * size_b non-zeros per group.
        self.shared = size_a * size_b
        self.start_a = np.concatenate([[0], np.cumsum(size_a)])
        self.start_b = np.concatenate([[0], np.cumsum(size_b)])

    def written(self, last=None) -> str:
        return _written(self.a_ids, self.b_ids, self.group_a, self.group_b, self.start_a, self.start_b, last)


def _row(n_a: int, n_b: int, n_groups: int, n_shared: int, links: np.ndarray, written: str) -> dict:
    pairs, counts = np.unique(links, return_counts=True)
    return {
        "n_a": n_a,
        "n_b": n_b,
        "n_groups": n_groups,
        "n_links": len(links),
        "n_shared": n_shared,
        "groups_sha256": hashlib.sha256(written.encode()).hexdigest(),
        "pair_key": pairs,
        "pair_n": counts.astype(np.int64),
    }


def align_one(a_ids: np.ndarray, b_ids: np.ndarray, a_table, b_table, target: bytes) -> dict | None:
    """The alignment of one text, or None where either tokenization's bytes
    differ from ``target`` (or there are no tokens)."""
    got = Alignment.of(a_ids, b_ids, a_table, b_table, target)
    if got is None:
        return None
    return _row(len(a_ids), len(b_ids), len(got.cuts), int(got.shared.sum()), got.pairs, got.written())


# A space between a character that is not one and one that is not white space: in
# space + text, A's pattern starts a match there whatever stands before, and no piece of
# B holds a space after another character. Both tokenizations end a token before it.
BETWEEN = re.compile(r"(?<=[^ ]) (?=\S)")
# Texts that fall at every space or not at all need no such care.
CARE = re.compile(r" \s| \Z|\A ")
# Characters of chunks that are aligned together, and of texts put together at a time, about.
LOT_CHARS, TURN_CHARS = 1 << 15, 1 << 21


def lots(sizes: list[int], limit: int) -> list[tuple[int, int]]:
    """First and end of runs of items whose sizes come to about ``limit``."""
    which = np.cumsum(sizes, dtype=np.int64) // limit
    firsts = np.flatnonzero(np.diff(which, prepend=-1)).tolist()
    return list(zip(firsts, [*firsts[1:], len(which)]))


class ChunkAligner:
    """Alignments of texts, each distinct chunk (run between the cuts of ``BETWEEN``)
    tokenized and aligned once while it is remembered.

    Exact for ``byte_bpe_50k`` (its pattern never matches across such a cut and does
    not look back) and ``piece_bpe_32k`` (no normalization, a space before the text,
    no piece with a space after another character): a text's tokens are its chunks'
    in order, each with the space before it, and every cut ends a group. The texts'
    columns are sums, and their links and written groups the chunks' in order. A chunk
    whose bytes do not come out as they went in sends its texts to ``align_one`` whole.

    New chunks are aligned together, a space between them, where the cuts of such a
    text are these spaces; others alone. The memo is cleared when it holds ``limit``
    chunks or ``limit_links`` links.
    """

    COUNTS = ("n_a", "n_b", "n_groups", "n_shared", "n_links", "wrong")

    def __init__(self, encode_a, encode_b, a_table, b_table, limit: int = 1 << 18, limit_links: int = 1 << 22):
        self.encode_a, self.encode_b, self.a_table, self.b_table = encode_a, encode_b, a_table, b_table
        self.limit, self.limit_links = limit, limit_links
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.counts = np.zeros((0, len(self.COUNTS)), np.int64)
        self.links, self.start = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.written = np.zeros(0, object)

    def tokens(self, text: str) -> tuple:
        """What ``align_one`` needs of a text."""
        a_ids = np.asarray(self.encode_a(" " + text), np.int64)
        b_ids = np.asarray(self.encode_b(text), np.int64)
        return a_ids, b_ids, self.a_table, self.b_table, (" " + text).encode()

    def _lot(self, chunks: list[str]) -> list[tuple[np.ndarray, np.ndarray, list[str]]]:
        """Counts, links and written groups of chunks that are aligned together."""
        got = Alignment.of(*self.tokens(" ".join(chunks)))
        if got is not None:
            ends = np.cumsum([len(c.encode()) + 1 for c in chunks])
            last = np.searchsorted(got.cuts, ends)
            if (got.cuts[last] == ends).all():
                last_a = np.searchsorted(got.end_a, ends)
                counts = np.zeros((len(chunks), len(self.COUNTS)), np.int64)
                counts[:, 0] = np.diff(last_a, prepend=-1)
                counts[:, 1] = np.diff(np.searchsorted(got.end_b, ends), prepend=-1)
                counts[:, 2] = np.diff(last, prepend=-1)
                counts[:, 3] = np.diff(np.cumsum(got.shared)[last], prepend=0)
                counts[:, 4] = np.diff(np.searchsorted(got.ta, last_a, side="right"), prepend=0)
                return [(counts, got.pairs, got.written(last).split("\n"))]
        if len(chunks) > 1:
            half = len(chunks) // 2
            return self._lot(chunks[:half]) + self._lot(chunks[half:])
        return [(np.array([[0, 0, 0, 0, 0, 1]], np.int64), np.zeros(0, np.int64), [""])]

    def _numbers(self, chunks: list[str]) -> np.ndarray:
        """The chunks' numbers in the memo, new ones learnt."""
        if len(self.number) > self.limit or len(self.links) > self.limit_links:
            self._clear()
        new = [c for c in chunks if c not in self.number]
        if new:
            alone = [c for c in new if not c or " " in c or c[0].isspace()]
            if alone:
                kept = set(alone)
                new = [c for c in new if c not in kept]
            together = [new[a:b] for a, b in lots([len(c) + 1 for c in new], LOT_CHARS)]
            counts, links, written = [self.counts], [self.links], [self.written]
            for part in together + [[c] for c in alone]:
                for of_each, in_order, groups in self._lot(part):
                    counts.append(of_each)
                    links.append(in_order)
                    written.append(np.array(groups, object))
            before = len(self.number)
            self.number.update(zip(new + alone, range(before, before + len(new) + len(alone))))
            self.counts, self.links, self.written = map(np.concatenate, (counts, links, written))
            sizes = self.counts[:, 4]
            self.start = np.cumsum(sizes) - sizes
        return np.fromiter(map(self.number.__getitem__, chunks), np.int64, len(chunks))

    def __call__(self, texts: list[str]) -> list[dict | None]:
        """``align_one`` of each text, none of them empty."""
        return [row for a, b in lots([len(t) for t in texts], TURN_CHARS) for row in self._rows(texts[a:b])]

    def _rows(self, texts: list[str]) -> list[dict | None]:
        if any(map(CARE.search, texts)):
            cut = [BETWEEN.split(t) if CARE.search(t) else t.split(" ") for t in texts]
            parts = pa.array(cut, pa.large_list(pa.large_string()))
        else:
            parts = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        chunks = parts.flatten().dictionary_encode()
        which = self._numbers(chunks.dictionary.to_pylist())[chunks.indices.to_numpy()]
        at = parts.offsets.to_numpy()
        sums = [np.diff(np.append(0, np.cumsum(column[which]))[at]).tolist() for column in self.counts.T]
        rows = []
        for text, first, end, n_a, n_b, n_groups, n_shared, _, wrong in zip(texts, at[:-1], at[1:], *sums):
            if wrong:
                rows.append(align_one(*self.tokens(text)))
                continue
            of = which[first:end]
            size = self.counts[of, 4]
            after = np.cumsum(size)
            links = self.links[np.repeat(self.start[of] - (after - size), size) + np.arange(after[-1])]
            rows.append(_row(n_a, n_b, n_groups, n_shared, links, ";".join(self.written[of].tolist())))
        return rows


def _aligner(a_file: str, b_file: str, by_chunks: bool):
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece

        encode_a, pieces_a = a_encoder(a_file)
        tok_b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        a_table, b_table = flat_table(pieces_a), flat_table(b_pieces(b_file))
        chunked = ChunkAligner(encode_a, lambda text: tok_b.encode(text, out_type=int), a_table, b_table)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            filled = [i for i, text in enumerate(texts) if text]
            if by_chunks:
                found = dict(zip(filled, chunked([texts[i] for i in filled])))
            else:
                found = {i: align_one(*chunked.tokens(texts[i])) for i in filled}
            cols = {k: [] for k in ("n_a", "n_b", "n_groups", "n_links", "n_shared", "groups_sha256", "pair_key", "pair_n")}
            for i in range(len(texts)):
                got = found.get(i)
                for k in cols:
                    if got is not None:
                        cols[k].append(got[k])
                    elif k == "groups_sha256":
                        cols[k].append("")
                    elif k in ("pair_key", "pair_n"):
                        cols[k].append(np.zeros(0, np.int64))
                    else:
                        cols[k].append(0)
            lists = {}
            for k in ("pair_key", "pair_n"):
                lengths = np.fromiter((len(x) for x in cols[k]), np.int64, len(texts))
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32 if lengths.sum() < 2**31 else np.int64)
                values = np.concatenate(cols[k]) if cols[k] else np.zeros(0, np.int64)
                lists[k] = (pa.ListArray if offsets.dtype == np.int32 else pa.LargeListArray).from_arrays(offsets, values)
                if offsets.dtype != np.int32:
                    lists[k] = lists[k].cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_row"),
                    batch.column("doc_id"),
                    *(pa.array(cols[k], pa.int64()) for k in ("n_a", "n_b", "n_groups", "n_links", "n_shared")),
                    pa.array(cols["groups_sha256"], pa.string()),
                    lists["pair_key"],
                    lists["pair_n"],
                ],
                schema=ALIGNED,
            )

    return align


def align_tokenizers(docs: DataFrame, a_file: str | None = None, b_file: str | None = None) -> DataFrame:
    """One row per document: how its tokens by A (byte-level BPE over space +
    text) and B (sentencepiece over the text, which adds the space) align.

    Neither adds special tokens, and their strings inside a text are plain text.
    Columns: doc_id, n_a, n_b, n_groups (runs between offsets where both end a
    token), n_links (A-B token occurrence pairs whose bytes overlap), n_shared
    (A-B token pairs in one group), n_best (links whose id pair's corpus-wide
    count, the documents holding that pair linked, is the highest among pairs
    of the same A id, ties included), count_sum (the links' counts summed),
    groups_sha256 (sha256 of ``a1,a2|b1;a3|b2,b3``: decimal ids per group).

    Defined cases: a null or empty text, or one whose joined A or B token
    bytes are not space + text, has zeros and groups_sha256 ''; a null doc_id
    is aligned like others and keeps its null; repeated rows count as separate
    documents; an empty table gives no rows; other columns are ignored,
    whatever their names. Every text is tokenized to its end; by the default
    vocabularies, each run between cuts that are safe for both (``ChunkAligner``)
    is tokenized and aligned once while remembered, by others every text whole.
    """
    if a_file is None or b_file is None:
        a_default, b_default = default_files()
        a_file, b_file = a_file or a_default, b_file or b_default
    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
    )
    by_chunks = (a_file, b_file) == default_files()
    aligned = stage(bounded_batches(rows).mapInArrow(_aligner(a_file, b_file, by_chunks), SPARK_SCHEMA), "aligned")
    links = aligned.select("_row", F.explode(F.arrays_zip("pair_key", "pair_n")).alias("p")).select(
        "_row", F.col("p.pair_key").alias("key"), F.col("p.pair_n").alias("n")
    )
    counts = links.groupBy("key").agg(F.count(F.lit(1)).alias("cnt"))
    top = counts.groupBy(F.shiftright("key", PAIR_BITS).alias("a")).agg(F.max("cnt").alias("top"))
    scored = counts.join(top, F.shiftright(counts["key"], PAIR_BITS) == top["a"]).select(
        "key", "cnt", (F.col("cnt") == F.col("top")).alias("best")
    )
    per_doc = (
        links.join(scored, "key")
        .groupBy("_row")
        .agg(
            F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"),
            F.sum(F.col("n") * F.col("cnt")).alias("count_sum"),
        )
    )
    result = aligned.drop("pair_key", "pair_n").join(per_doc, "_row", "left")
    return result.select(
        "doc_id",
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"),
        "groups_sha256",
        "n_shared",
    )
