"""Tokenizer alignment against a brute-force pairing of byte ranges."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfold.llm.alignment import a_pieces, align_tokenizers, b_pieces, csr_product, default_files


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a_file, b_file = default_files()
    a = Tokenizer.from_file(a_file)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=b_file), a_pieces(a_file), b_pieces(b_file)


def brute(rows, tokenizers):
    a, b, ap, bp = tokenizers
    per = []
    for doc, text in rows:
        if not text:
            per.append((doc, None))
            continue
        target = (" " + text).encode()
        ai = a.encode(" " + text, add_special_tokens=False).ids
        bi = b.encode(text, out_type=int)
        if b"".join(ap[i] for i in ai) != target or b"".join(bp[i] for i in bi) != target or not ai or not bi:
            per.append((doc, None))
            continue
        ra, at = [], 0
        for i in ai:
            ra.append((at, at + len(ap[i])))
            at += len(ap[i])
        rb, at = [], 0
        for i in bi:
            rb.append((at, at + len(bp[i])))
            at += len(bp[i])
        links = [(x, y) for x in range(len(ai)) for y in range(len(bi)) if ra[x][0] < rb[y][1] and rb[y][0] < ra[x][1]]
        cuts = sorted({e for _, e in ra} & {e for _, e in rb})
        groups = []
        for k, cut in enumerate(cuts):
            lo = cuts[k - 1] if k else 0
            ga = [str(ai[x]) for x in range(len(ai)) if lo < ra[x][1] <= cut]
            gb = [str(bi[y]) for y in range(len(bi)) if lo < rb[y][1] <= cut]
            groups.append(",".join(ga) + "|" + ",".join(gb))
        per.append((doc, (len(ai), len(bi), len(cuts), [(ai[x], bi[y]) for x, y in links], ";".join(groups))))
    count = Counter()
    for _, got in per:
        if got:
            count.update(set(got[3]))
    top = {}
    for (x, y), c in count.items():
        top[x] = max(top.get(x, 0), c)
    out = []
    for doc, got in per:
        if got is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
            continue
        na, nb, ng, links, written = got
        out.append((doc, na, nb, ng, len(links), sum(count[l] == top[l[0]] for l in links), sum(count[l] for l in links),
                    hashlib.sha256(written.encode()).hexdigest()))
    return sorted(out, key=repr)


COLS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_csr_product_equals_dense():
    rng = np.random.default_rng(3)
    a = rng.random((7, 9)) < 0.3
    b = rng.random((9, 5)) < 0.4
    a_ptr = np.concatenate([[0], np.cumsum(a.sum(1))])
    a_idx = np.nonzero(a)[1]
    b_ptr = np.concatenate([[0], np.cumsum(b.sum(1))])
    b_idx = np.nonzero(b)[1]
    r, c, v = csr_product(a_ptr, a_idx, b_ptr, b_idx, 5)
    dense = a.astype(int) @ b.astype(int)
    assert sorted(zip(r.tolist(), c.tolist(), v.tolist())) == sorted(
        (i, j, int(dense[i, j])) for i, j in zip(*np.nonzero(dense))
    )


def test_alignment_equals_brute_force(spark, tokenizers):
    rng = random.Random(11)
    words = ["the", "The", "tokenization", "naïve", "中文字", "<|endoftext|>", "<s>", "  ", "\n", "x1y2", "🙂", "über"]
    rows = [(None, None), (1, ""), (2, " "), (3, "a  b\n\nc"), (3, "a  b\n\nc"), (4, " nbsp\tTab")]
    rows += [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 40)))) for i in range(5, 80)]
    rows.append((99, "long " * 2000))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("_row", F.lit("x"))
    got = sorted((tuple(r) for r in align_tokenizers(df.repartition(3)).select(*COLS).collect()), key=repr)
    assert got == brute(rows, tokenizers)
    assert sum(1 for r in got if r[1] == 0) >= 2


def test_given_table(spark, tokenizers):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in align_tokenizers(frame).select(*COLS).collect()), key=repr)
    assert got == brute(rows, tokenizers)


def test_empty_table(spark):
    assert align_tokenizers(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_chunks_aligned_once_equal_whole_texts(tokenizers):
    """Texts put together from remembered chunks have the rows of texts aligned
    whole, whatever the white space, and repeated words are not tokenized again."""
    from tallyfold.llm.alignment import ChunkAligner, a_encoder, align_one, flat_table

    encode_a, pieces = a_encoder(default_files()[0])
    _, b, _, bp = tokenizers
    sent = []

    def counted(text):
        sent.append(text)
        return b.encode(text, out_type=int)

    tables = flat_table(pieces), flat_table(bp)
    rng = random.Random(5)
    parts = ["the", "naïve", "中文字", "x1y2", "it's", "'s", ").", "▁", "▁a", "<s>", "🙂", "́", "\x00", "\x1c", "<0x0A>", "1 000"]
    spaces = [" ", " ", " ", " ", "", "  ", "\n", " \n", "\n ", "\t ", "  ", "  ", "　 ", "\x1f ", " \x85", "\r\n\r\n "]
    texts = ["".join(rng.choice(parts) + rng.choice(spaces) for _ in range(rng.randrange(1, 25))) for _ in range(400)]
    texts = [rng.choice(["", "", " ", "\n", "  "]) + t for t in texts] + [" ", "\n", "▁", "plain words alone", "words alone plain"]
    chunked = ChunkAligner(encode_a, counted, *tables)
    for lot in (texts, texts[:7], ["plain words alone"]):
        for text, got in zip(lot, chunked(lot)):
            want = align_one(np.asarray(encode_a(" " + text), np.int64), np.asarray(b.encode(text, out_type=int), np.int64),
                             *tables, (" " + text).encode())
            assert (got is None) == (want is None)
            for k in want or ():
                assert np.array_equal(got[k], want[k])
    sent.clear()
    many = [" ".join(rng.choice(["alpha", "beta", "gamma,", "delta."]) for _ in range(500)) for _ in range(20)]
    chunked(many)
    assert sum(map(len, sent)) < 100
