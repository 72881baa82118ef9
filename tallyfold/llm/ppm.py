"""Language-model scoring by prediction by partial matching over bytes.

The model is a trie of byte contexts of up to five bytes, counted over all
training texts. A byte's probability comes from its longest context that has
seen it; on the way down each context pays an escape (method D: kinds seen /
twice the times seen; a byte seen c times has (2c - 1) / twice), and the symbols that a longer context has seen are
excluded in the shorter ones; below the empty context all bytes not seen are
equal. Since the exclusions depend on the contexts alone, all sums are made
once.

No gram is dropped, and the grams never meet on one machine. A text is scored
by look-ups for the frequent grams, whose probabilities are one table of fixed
size. All others it asks for by a shuffle: grams are dealt by the two nearest
bytes of their context, so a task has whole all contexts of two bytes and more
that end in them; the shorter ones are at most 65,536 pairs and go to all.

Beside it stands a word model (add-one unigrams), whose counts never meet on
one machine: the counts of frequent words are one short table, rare words are
dealt by hash and each sends a document the correction it needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.hashing import LOWER, U, words
from tallyfold.llm.tables import bounded_batches, stage, text_chunks, text_of

# Bytes of the longest context.
ORDER = 5
# Frequent grams whose probabilities are broadcast at most (about 50 MB). Which grams these are moves cost, not results.
MOST_GRAMS = 1 << 21
# Grams that one task holds of those dealt out, about.
TASK_GRAMS = 1 << 19
# Words whose counts are kept together, taken from about so many documents. Which words these are moves cost, not results.
FREQUENT, SAMPLE_DOCS = 1 << 15, 4000
# What stands before a text, and the symbol after it, which no UTF-8 text holds.
PAD, END = 10, 255


class Lookup:
    """Positions of 64-bit keys in a sorted-by-hash table."""

    def __init__(self, keys: np.ndarray):
        hashed = keys * U(0x9E3779B97F4A7C15)
        self.order = np.argsort(hashed).astype(np.int32)
        self.hashed = hashed[self.order]
        self.bits = max(1, int(len(keys)).bit_length())
        bucket = (self.hashed >> U(64 - self.bits)).astype(np.int64)
        self.start = np.searchsorted(bucket, np.arange((1 << self.bits) + 1)).astype(np.int32)
        self.longest = int(np.diff(self.start).max()) if len(keys) else 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key in the table, -1 where it is none of it."""
        hashed = keys * U(0x9E3779B97F4A7C15)
        bucket = (hashed >> U(64 - self.bits)).astype(np.int64)
        at, end = self.start[bucket], self.start[bucket + 1]
        out = np.full(len(keys), -1, np.int64)
        open_rows = np.flatnonzero(at < end)
        for _ in range(self.longest):
            here = at[open_rows]
            same = self.hashed[here] == hashed[open_rows]
            out[open_rows[same]] = self.order[here[same]]
            at[open_rows] += 1
            open_rows = open_rows[~same & (here + 1 < end[open_rows])]
            if not len(open_rows):
                break
        return out


def byte_stream(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(grams, start): for every byte of every row, and its end, the byte and
    its context as one number (the byte lowest, then the nearest), and where
    each row starts among them."""
    rows = len(offsets) - 1
    n = len(data)
    row = np.repeat(np.arange(rows), np.diff(offsets))
    stream = np.full(n + rows * (ORDER + 1), PAD, np.uint8)
    stream[np.arange(n) + (row + 1) * ORDER + row] = LOWER[data]
    ends = offsets[1:] + np.arange(1, rows + 1) * ORDER + np.arange(rows)
    stream[ends] = END
    grams = stream[ORDER:].astype(U)
    for back in range(1, ORDER + 1):
        grams |= stream[ORDER - back : len(stream) - back].astype(U) << U(8 * back)
    real = np.ones(len(stream), bool)
    begin = offsets[:-1] + np.arange(rows) * (ORDER + 1)
    for k in range(ORDER):
        real[begin + k] = False
    return grams[real[ORDER:]], offsets[:-1] + np.arange(rows)


class PartialMatching:
    """The trie's tables, from sorted (gram, count). Where these are the grams
    of some nearest two bytes of context only, ``pairs`` has the sorted (context
    byte and symbol, count) of all."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, pairs: tuple[np.ndarray, np.ndarray] | None = None):
        self.top = Lookup(grams)
        counts = counts.astype(np.float64)
        self.symbols: list[tuple[np.ndarray, np.ndarray]] = []
        self.nodes: list[dict[str, np.ndarray]] = []
        tables = {ORDER: (grams, counts)}
        for k in range(ORDER - 1, -1, -1):
            keys, inverse = np.unique(tables[k + 1][0] & U((1 << 8 * (k + 1)) - 1), return_inverse=True)
            tables[k] = keys, np.bincount(inverse, tables[k + 1][1], len(keys))
            if k == 1 and pairs is not None:
                tables[k] = pairs
        for k in range(ORDER + 1):
            keys, n = tables[k]
            start = np.flatnonzero(np.concatenate([[True], keys[1:] >> U(8) != keys[:-1] >> U(8)])) if len(keys) else np.zeros(0, np.int64)
            times = np.add.reduceat(n, start) if len(keys) else n
            kinds = np.diff(np.append(start, len(keys))).astype(np.float64)
            node = {"key": keys[start] >> U(8), "enter": np.log10(2 * times), "escape": np.log10(kinds / (2 * times))}
            if k:
                # What the next shorter context holds once this one's symbols are excluded.
                shorter_keys, shorter_n = tables[k - 1]
                there = np.searchsorted(shorter_keys, keys & U((1 << 8 * k) - 1))
                shared = np.add.reduceat(shorter_n[there], start) if len(keys) else n
                owner = np.searchsorted(self.nodes[k - 1]["key"], node["key"] & U((1 << 8 * (k - 1)) - 1))
                rest_times = np.maximum(self.times[owner] - shared, 0.0)
                rest_kinds = self.kinds[owner] - kinds
                some = (rest_times > 0) & (rest_kinds > 0)
                node["rest"] = np.log10(np.where(some, 2 * rest_times, 1.0))
                node["rest_escape"] = np.where(some, np.log10(np.where(some, rest_kinds / np.where(some, 2 * rest_times, 1.0), 1.0)), 0.0)
            self.times, self.kinds = times, kinds
            self.symbols.append((keys, np.log10(2 * n - 1)))
            self.nodes.append(node)
        start_of = np.searchsorted(self.nodes[ORDER]["key"], grams >> U(8))
        self.seen = self.symbols[ORDER][1] - self.nodes[ORDER]["enter"][start_of] if len(grams) else counts
        # Whoever asks for a byte below the longest contexts knows it is in none of them.
        self.symbols[ORDER] = grams[:0], counts[:0]
        self.unseen = -np.log10(256.0 - len(tables[0][0]))
        del self.times, self.kinds

    def log10(self, grams: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's byte after its context."""
        at = self.top.find(grams)
        out = np.where(at >= 0, self.seen[at], 0.0) if len(self.seen) else np.zeros(len(grams))
        left = np.flatnonzero(at < 0)
        if len(left):
            keys, inverse = np.unique(grams[left], return_inverse=True)
            out[left] = self._rare(keys)[inverse]
        return out

    def _rare(self, grams: np.ndarray) -> np.ndarray:
        out = np.zeros(len(grams))
        above = np.full(len(grams), -1, np.int64)  # the node that has escaped to this order
        open_rows = np.arange(len(grams))
        for k in range(ORDER, -1, -1):
            if not len(open_rows) or not len(self.nodes[k]["key"]):
                continue
            own = grams[open_rows]
            context, node_keys = (own >> U(8)) & U((1 << 8 * k) - 1), self.nodes[k]["key"]
            node = np.minimum(np.searchsorted(node_keys, context), len(node_keys) - 1)
            there = node_keys[node] == context
            keys, logs = self.symbols[k]
            gram = own & U((1 << 8 * (k + 1)) - 1)
            if k < ORDER:
                symbol = np.minimum(np.searchsorted(keys, gram), len(keys) - 1)
                found = there & (keys[symbol] == gram)
                used = logs[symbol]
            else:
                found, used = np.zeros(len(own), bool), np.zeros(len(own))
            first = above[open_rows] < 0
            if k < ORDER:
                up = self.nodes[k + 1]
                rest, rest_escape = up["rest"][above[open_rows]], up["rest_escape"][above[open_rows]]
            else:
                rest = rest_escape = np.zeros(len(own))
            step = np.where(
                found,
                used - np.where(first, self.nodes[k]["enter"][node], rest),
                np.where(first, self.nodes[k]["escape"][node], rest_escape),
            )
            out[open_rows[there]] += step[there]
            above[open_rows[there]] = node[there]
            open_rows = open_rows[~found]
        out[open_rows] += self.unseen
        return out


GRAM, WORD, DOCS = 0, 1, 2


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)


def _count(frequent: np.ndarray):
    """Counts of grams, frequent words and documents of a partition's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(frequent)
        often = np.zeros(len(frequent), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        held = docs = 0
        for batch in batches:
            docs += batch.num_rows
            for _, _, data, offsets in text_chunks(batch.column(0)):
                keys, n = np.unique(byte_stream(data, offsets)[0], return_counts=True)
                parts.append((keys, n))
                held += len(keys)
                if held > 1 << 21:
                    parts = [_merged(parts)]
                    held = len(parts[0][0]) // 2
                at = lookup.find(words(data, offsets)[0])
                often += np.bincount(at[at >= 0], minlength=len(frequent))
        keys, n = _merged(parts) if parts else (np.zeros(0, U), np.zeros(0, np.int64))
        seen = np.flatnonzero(often)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([np.full(len(keys), GRAM), np.full(len(seen), WORD), [DOCS]]).astype(np.int32)),
                pa.array(np.concatenate([keys.view(np.int64), frequent[seen].view(np.int64), [0]])),
                pa.array(np.concatenate([n, often[seen], [docs]]).astype(np.int64)),
            ],
            names=["kind", "key", "n"],
        )

    return run


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [np.unique(words(data, offsets)[0], return_counts=True) for _, _, data, offsets in text_chunks(batch.column(0))]
        if parts:
            keys, n = _merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["h", "n"])


def _rare_words(frequent: np.ndarray):
    """(word, document, times, times in training) of the words that are not frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(frequent)
        for batch in batches:
            doc, txt, train = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 3))
            for begin, _, data, offsets in text_chunks(batch.column(2)):
                hashes, row = words(data, offsets)
                rare = lookup.find(hashes) < 0
                keys, row, n = _by_row(hashes[rare], row[rare])
                row = row + begin
                columns = [keys.view(np.int64), doc[row], txt[row], n, np.where(train[row], n, 0)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h", "doc", "txt", "n", "trained"])

    return run


def _by_row(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    start = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])])) if len(row) else np.zeros(0, np.int64)
    return hashes[start], row[start], np.diff(np.append(start, len(row))).astype(np.int64)


def _corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a document's own guess of a rare word's count (its own uses, if it
    is in training) is off by. Rows come sorted by word; a group that a batch
    cuts waits for its rest. One row without a document counts the words that
    training has seen."""

    def settle(h, doc, txt, n, trained):
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        total = np.add.reduceat(trained, start)
        count = np.repeat(total, np.diff(np.append(start, len(h))))
        off = count != trained
        delta = n[off] * (np.log10(count[off] + 1.0) - np.log10(trained[off] + 1.0))
        known = n[off] * (trained[off] == 0)
        seen = int((total > 0).sum())
        columns = [(doc[off], None), (txt[off], None), (delta, 0.0), (known, 0), (np.zeros(off.sum(), np.int64), seen)]
        arrays = [pa.concat_arrays([pa.array(c), pa.array([last], pa.array(c).type)]) for c, last in columns]
        return pa.RecordBatch.from_arrays(arrays, names=["doc", "txt", "delta", "known", "words"])

    waiting: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
        last = int(np.searchsorted(rows[0], rows[0][-1]))
        if waiting and waiting[0][0][0] == rows[0][-1]:
            waiting.append(rows)
            continue
        whole = tuple(np.concatenate([*(w[k] for w in waiting), rows[k][:last]]) for k in range(5))
        if len(whole[0]):
            yield settle(*whole)
        waiting = [tuple(r[last:] for r in rows)]
    if waiting:
        yield settle(*(np.concatenate([w[k] for w in waiting]) for k in range(5)))


def _scores(model: dict, frequent: np.ndarray, logs: np.ndarray, known: np.ndarray):
    """Per row: words, known words and log10(count + 1) summed as far as it can
    tell alone, the byte model's score of the frequent grams, and the other grams
    with the times it has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(frequent)
        top = Lookup.__new__(Lookup)
        top.__dict__ = model.value["top"]
        seen = np.append(model.value["seen"], 0.0)  # the last is that of position -1
        for batch in batches:
            train = batch.column(5).to_numpy(zero_copy_only=False)
            for begin, end, data, offsets in text_chunks(batch.column(3)):
                rows = end - begin
                hashes, row = words(data, offsets)
                at = lookup.find(hashes)
                often = at >= 0
                total = np.bincount(row[often], logs[at[often]], rows)
                n_known = np.bincount(row[often], known[at[often]], rows)
                _, rare_row, n = _by_row(hashes[~often], row[~often])
                own = train[begin:end][rare_row]
                total += np.bincount(rare_row, np.where(own, n * np.log10(n + 1.0), 0.0), rows)
                n_known += np.bincount(rare_row, np.where(own, n, 0), rows)
                grams, start = byte_stream(data, offsets)
                at = top.find(grams)
                score = np.add.reduceat(seen[at], start)
                rare = np.flatnonzero(at < 0)
                keys, rare_row, n = _by_row(grams[rare], np.searchsorted(start, rare, side="right") - 1)
                cut = pa.array(np.searchsorted(rare_row, np.arange(rows + 1)).astype(np.int32))
                columns = [pa.array(x) for x in (np.bincount(row, minlength=rows).astype(np.int64), n_known.astype(np.int64), total, score)]
                columns += [pa.ListArray.from_arrays(cut, pa.array(x)) for x in (keys.view(np.int64), n)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(begin, rows) for k in (0, 1, 2, 4)), *columns],
                    names=["doc_id", "doc", "txt", "held_out", "n_words", "n_known", "total", "score", "key", "n"],
                )

    return run


def _rare_grams(pairs):
    """(document, score) of the grams that documents ask for. A task's rows are
    the counted grams of its contexts, then the ones asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: list[tuple[np.ndarray, np.ndarray]] = []
        trie = None
        for batch in batches:
            asked, key, n, doc, txt = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            first = int(np.searchsorted(asked, 1))
            if first:
                counted.append((key[:first].view(U), n[:first]))
            if first == len(key):
                continue
            if trie is None:
                keys, counts = (np.concatenate([c[k] for c in counted]) if counted else np.zeros(0, (U, np.int64)[k]) for k in (0, 1))
                order = np.argsort(keys)
                trie = PartialMatching(keys[order], counts[order], pairs.value)
                counted.clear()
            score = n[first:] * trie.log10(key[first:].view(U))
            yield pa.RecordBatch.from_arrays([pa.array(doc[first:]), pa.array(txt[first:]), pa.array(score)], names=["doc", "txt", "score"])

    return run


def fit_trie(counts: DataFrame, most: int = MOST_GRAMS) -> dict:
    """Look-up of the frequent grams among (key, n) and their log10
    probabilities, which follow from all grams of their contexts; the counts'
    histogram, finer than a twentieth, finds the least count whose grams fit.
    ``grams`` is how many there are in all."""
    level = F.floor(F.log2("n") * 16)
    sizes = {int(r[0]): int(r[1]) for r in counts.groupBy(level.alias("level")).count().collect()}
    total, cut = 0, max(sizes, default=0) + 1
    for n in sorted(sizes, reverse=True):
        if total + sizes[n] > most:
            break
        total, cut = total + sizes[n], n
    times = F.sum("n").over(Window.partitionBy(F.shiftright("key", 8)))  # of a context: 256 rows at most
    found = counts.withColumn("times", times).filter(level >= cut).toArrow()
    grams, n, times = (found.column(c).to_numpy() for c in ("key", "n", "times"))
    return {"top": vars(Lookup(grams.view(U))), "seen": np.log10(2.0 * n - 1) - np.log10(2.0 * times), "grams": sum(sizes.values())}


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)
    per row.

    Held out are the rows whose id's text has a CRC-32 of 2 modulo 7; all
    others are learned from. ``base_score`` is the add-one unigram log10
    probability of the words and one end, ``score`` that of the bytes (A-Z
    lower-cased) and one end under the byte model. Null or empty texts have
    the end alone; a row with a null id is learned from; repeated rows count
    as often as they are there; an empty table gives no rows. Other columns
    are ignored.
    """
    ids, text = F.col(id_col).cast("long"), text_of(text_col)
    rows = bounded_batches(docs).select(
        ids.alias("doc_id"),
        F.coalesce(ids, F.lit(-(2**63))).alias("doc"),
        F.xxhash64(text).alias("txt"),
        text.alias("text"),
        F.coalesce(F.crc32(ids.cast("string")) % 7 == 2, F.lit(False)).alias("held_out"),
    ).withColumn("train", ~F.col("held_out"))
    sc = docs.sparkSession.sparkContext

    total = rows.count()
    some = rows.sample(False, min(1.0, SAMPLE_DOCS / max(1, total)), seed=7).select("text")
    ranked = some.mapInArrow(_word_counts, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(FREQUENT)
    frequent = np.sort(np.array([r[0] for r in ranked.select("h").collect()], np.int64).view(U))

    counted = rows.filter("train").select("text").mapInArrow(_count(frequent), "kind int, key long, n long")
    counts = stage(counted.groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    grams = counts.filter(F.col("kind") == GRAM).select("key", "n")
    trie = fit_trie(grams)
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-trie["grams"] // TASK_GRAMS))
    trie = sc.broadcast(trie)
    pairs = grams.groupBy(F.col("key").bitwiseAND(0xFFFF).alias("key")).agg(F.sum("n").alias("n")).sort("key").toArrow()
    pairs = sc.broadcast((pairs.column("key").to_numpy().view(U), pairs.column("n").to_numpy().astype(np.float64)))
    known = {r[0]: r[1] for r in counts.filter(F.col("kind") == WORD).select("key", "n").collect()}
    often = np.array([known.get(int(k), 0) for k in frequent.view(np.int64)], np.int64)
    scored = rows.select("doc_id", "doc", "txt", "text", "held_out", "train").mapInArrow(
        _scores(trie, frequent, np.log10(often + 1.0), (often > 0).astype(np.int64)),
        "doc_id long, doc long, txt long, held_out boolean, n_words long, n_known long, total double, score double, key array<long>, n array<long>",
    )
    scored = stage(scored, "scores")

    rare = rows.select("doc", "txt", "text", "train").mapInArrow(_rare_words(frequent), "h long, doc long, txt long, n long, trained long")
    dealt = rare.repartition("h").sortWithinPartitions("h")
    offs = dealt.mapInArrow(_corrections, "doc long, txt long, delta double, known long, words long")

    asked = scored.select("doc", "txt", F.explode(F.arrays_zip("key", "n")).alias("gram")).select(F.lit(1).alias("asked"), "gram.key", "gram.n", "doc", "txt")
    none = F.lit(0).cast("long")
    both = grams.select(F.lit(0).alias("asked"), "key", "n", none.alias("doc"), none.alias("txt")).unionByName(asked)
    dealt = both.repartition(tasks, F.shiftright("key", 8).bitwiseAND(0xFFFF)).sortWithinPartitions("asked")
    rest = dealt.mapInArrow(_rare_grams(pairs), "doc long, txt long, score double")
    rest = rest.select("doc", "txt", F.lit(0.0).alias("delta"), none.alias("known"), none.alias("words"), F.col("score").alias("rest"))
    sums = offs.withColumn("rest", F.lit(0.0)).unionByName(rest).groupBy("doc", "txt").agg(*(F.sum(c).alias(c) for c in ("delta", "known", "words", "rest")))
    sums = stage(sums, "corrections")

    trained = scored.filter("not held_out").agg(F.sum("n_words"), F.count("*")).first()
    ends = trained[1] or 0
    n = (trained[0] or 0) + ends
    v = (sums.agg(F.sum("words")).first()[0] or 0) + int((often > 0).sum()) + (1 if ends else 0)

    # Equal rows have summed their corrections; each takes its share.
    copies = scored.groupBy("doc", "txt").agg(F.count("*").alias("copies"))
    per_row = sums.filter("doc is not null").join(copies, ["doc", "txt"])
    per_row = per_row.select(
        F.col("doc").alias("d"), F.col("txt").alias("t"), (F.col("delta") / F.col("copies")).alias("delta"), (F.col("known") / F.col("copies")).cast("long").alias("more"), (F.col("rest") / F.col("copies")).alias("rest")
    )
    joined = scored.join(per_row, (F.col("doc") == F.col("d")) & (F.col("txt") == F.col("t")), "left")
    tokens = F.col("n_words") + 1
    zero = F.lit(0)
    base = F.col("total") + F.coalesce("delta", F.lit(0.0)) + F.log10(F.lit(ends + 1.0)) - tokens * F.log10(F.lit(float(n + v + 1)))
    return joined.select(
        "doc_id",
        "held_out",
        tokens.alias("n_tokens"),
        (F.col("n_known") + F.coalesce("more", zero) + F.lit(1 if ends else 0)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (F.col("score") + F.coalesce("rest", F.lit(0.0))).alias("score"),
    )
