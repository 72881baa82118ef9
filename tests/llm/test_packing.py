"""Best-fit packing against a plain list-scan best fit and the tokenizer itself."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfold.llm.packing import END_ID, BestFit, default_tokenizer, pack_documents


def plain_best_fit(sizes, capacity, open_bins):
    """The same rule by scanning a list of open sequences."""
    open_, placed, nxt = [], [], 0  # open_: [seq, free, reached]
    clock = 0
    for size in sizes:
        fits = [b for b in open_ if b[1] >= size]
        if fits:
            least = min(b[1] for b in fits)
            b = max((b for b in fits if b[1] == least), key=lambda b: b[2])
            open_.remove(b)
            seq, free = b[0], b[1]
        else:
            free = capacity
            if size < capacity and len(open_) >= open_bins:
                least = min(b[1] for b in open_)
                open_.remove(max((b for b in open_ if b[1] == least), key=lambda b: b[2]))
            seq, nxt = nxt, nxt + 1
        placed.append((seq, capacity - free))
        if free > size:
            clock += 1
            open_.append([seq, free - size, clock])
    return placed


@pytest.mark.parametrize("seed", range(6))
def test_bitset_best_fit_equals_list_scan(seed):
    rng = random.Random(seed)
    capacity, open_bins = rng.choice([(16, 2), (64, 4), (4096, 64)])
    sizes = [rng.randint(1, capacity) if rng.random() < 0.2 else rng.randint(1, max(1, capacity // 5)) for _ in range(600)]
    fit = BestFit(capacity, open_bins)
    assert [fit.place(s) for s in sizes] == plain_best_fit(sizes, capacity, open_bins)
    assert len(fit.open_sequences()) <= open_bins


def test_piece_that_fills_a_sequence_closes_it_without_evicting():
    fit = BestFit(10, 1)
    assert fit.place(3) == (0, 0)
    assert fit.place(10) == (1, 0)
    assert fit.place(7) == (0, 3)
    with pytest.raises(ValueError):
        fit.place(11)


def check_packing(rows, out, capacity):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(default_tokenizer())
    expected = {}
    for doc, text in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [END_ID]
        pieces = [ids[i : i + capacity] for i in range(0, len(ids), capacity)]
        expected.setdefault(doc, []).append(
            [(k, k * capacity, len(p), zlib.crc32(np.asarray(p, "<u4").tobytes())) for k, p in enumerate(pieces)]
        )
    got = {}
    for r in out:
        got.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    for doc, lists in expected.items():
        assert sorted(got[doc]) == sorted(p for pieces in lists for p in pieces)
    assert set(got) == set(expected)
    seqs = {}
    for r in out:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        parts.sort()
        at = 0
        for offset, length in parts:
            assert offset == at
            at += length
        assert at <= capacity
    return seqs


def test_packing_covers_every_id_once(spark):
    rng = random.Random(3)
    words = "alpha beta gamma Delta <|endoftext|> é 中文 x1".split()
    rows = [(None, None), (1, ""), (2, None), (3, "one"), (3, "one"), (4, " ".join(rng.choice(words) for _ in range(3000)))]
    rows += [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 200)))) for i in range(5, 120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    df = df.withColumn("sequence_id", F.lit("clash")).withColumn("open", F.lit(1))
    out = pack_documents(df, capacity=256, open_bins=3).collect()
    seqs = check_packing(rows, out, 256)
    total = sum(r.length for r in out)
    # Online with three open sequences: filled to 85 percent or more here.
    assert total >= 0.85 * 256 * len(seqs)


def test_packing_of_the_given_table_and_reruns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    first = pack_documents(docs).collect()
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    check_packing(rows, first, 4096)
    again = pack_documents(docs).collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, again))


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_chunk_ids_equal_whole_text_ids():
    from tokenizers import Tokenizer

    from tallyfold.llm.packing import ChunkIds

    tok = Tokenizer.from_file(default_tokenizer())
    texts = ["ΟΔΟΣ ΟΔΟΣ.", "İstanbul İ", "a\x1cb c\x1fd", "a b　c", "e ́x", "x<|endoftext|>y <|startoftext|>",
             "  lead trail  ", "中文 字", "ﬁ ﬂ ①", "A​B", "tab\there\r\nnew", "it's don't", "", "Hello hello HELLO"]
    chunked = ChunkIds(tok, limit=3)
    for _ in range(2):
        got = chunked(texts)
        assert [g.tolist() for g in got] == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_chunks_encoded_together_equal_the_tokenizer():
    """New chunks go to the tokenizer many to a text, not one by one, and come
    out with the ids each has alone, whatever the words in them."""
    from tokenizers import Tokenizer

    from tallyfold.llm import packing

    tok, texts_sent = Tokenizer.from_file(packing.default_tokenizer()), []

    class Counting:
        def __getattr__(self, name):
            def call(texts, **kw):
                texts_sent.extend(texts)
                return getattr(tok, name)(texts, **kw)

            return call if name.startswith("encode_batch") else getattr(tok, name)

    texts = [
        "plain words, once. and (again)", "it's we'll ''s 'S 'RE' don't 12a3 _x_", "İSTANBUL ΣΊΣ ǅ ﬁ ²x",
        "a<|endoftext|>b <| <|startoftext|>", "", "  ", "no break em", "\x1cone\x1ftwo three", " ".join(f"word{k} w{chr(97 + k % 26)}x" for k in range(500)),
    ]
    chunked = packing.ChunkIds(Counting())
    for lot in (texts[:3], texts[3:], texts):
        assert [a.tolist() for a in chunked(lot)] == [tok.encode(t, add_special_tokens=False).ids for t in lot]
    assert len(texts_sent) < 40


def test_words_are_learnt_once_whatever_stands_beside_them():
    """A word next to other punctuation is not encoded anew, and the cut into
    words is the tokenizer's own for every character below U+0250."""
    from tokenizers import Tokenizer

    from tallyfold.llm import packing

    tok = Tokenizer.from_file(packing.default_tokenizer())
    stems = [f"st{chr(97 + k // 26)}é{chr(97 + k % 26)}" for k in range(300)]
    chunked = packing.ChunkIds(tok)
    chunked([" ".join(f"{w} {w}, ({w}) {w}. {w}'s" for w in stems)])
    assert len(chunked.number) <= 300 + 10
    low = [chr(k) for k in range(0x250)]
    texts = ["".join(low), " ".join(low), " ".join(f"a{c}1{c}'{c}S{c}" for c in low), "x 中y <|endoftext|> z 中y"]
    texts += [t.translate({k: None for k in (0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x130)}) for t in texts]
    for t in texts:
        assert chunked([t])[0].tolist() == tok.encode(t, add_special_tokens=False).ids
