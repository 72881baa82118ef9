"""Merkle manifest against a plain recursive version over Python lists."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from tallyfold.llm.manifest import manifest

FANOUT = 8


def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def field(v):
    if v is None:
        return "-"
    v = str(v)
    return f"{len(v.encode())}:{v}"


def leaf(doc, source, lang, n, text):
    return H("".join(field(x) for x in (doc, source, lang, n, text)))


def tree(hashes):
    """Levels of hashes, leaves first, up to one node."""
    levels = [list(hashes)]
    while len(levels[-1]) > 1:
        cur = levels[-1]
        levels.append([H("".join(cur[i : i + FANOUT])) for i in range(0, len(cur), FANOUT)])
    return levels


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        start = i - i % FANOUT
        run = level[start : start + FANOUT]
        k = i - start
        out.append(("".join(run[:k]), "".join(run[k + 1 :])))
        i //= FANOUT
    return out


def brute(rows):
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append((r, leaf(*r)))
    langs = sorted(by_lang, key=lambda l: (l is not None, (l or "").encode()))
    subs, lang_trees = [], {}
    for lang in langs:
        items = sorted(by_lang[lang], key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        levels = tree([h for _, h in items])
        lang_trees[lang] = (items, levels)
        subs.append(levels[-1][0])
    top = tree(subs)
    root = top[-1][0]
    out = []
    for li, lang in enumerate(langs):
        items, levels = lang_trees[lang]
        for i, (r, h) in enumerate(items):
            path = siblings(levels, i) + siblings(top, li)
            doc, source, _, n, text = r
            t = text
            if doc is not None and zlib.crc32(str(doc).encode()) % 3 == 0 and text is not None:
                t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            f = leaf(doc, source, lang, n, t)
            for left, right in path:
                f = H(left + f + right)
            out.append((doc, h, levels[-1][0], root, H("".join(a + b for a, b in path)), f, f == root))
    return sorted(out, key=repr)


COLS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def run(spark, rows, **extra):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    for name, value in extra.items():
        df = df.withColumn(name, F.lit(value))
    return sorted((tuple(r) for r in manifest(df).select(*COLS).collect()), key=repr)


def test_manifest_equals_plain_tree(spark):
    rng = random.Random(7)
    langs = ["en", "de", None, "ß", "Ärger", "z"]
    rows = [(None, None, None, None, None), (5, "s", "en", 3, "Abc"), (5, "s", "en", 3, "Abc"), (6, "s", "de", 0, "")]
    rows += [(i, rng.choice(["a", None, "bb"]), "en" if i % 3 else rng.choice(langs), i, "Text " * (i % 7) + "ÄB" * (i % 2))
             for i in range(7, 700)]
    rows.append((10_000, "x", "solo", 1, "LONG " * 50_000))
    got = run(spark, rows, h="clash", idx=1, lo=2, path="p", top=True)
    assert got == brute(rows)
    assert any(not r[6] for r in got) and any(r[6] for r in got)


def test_single_row_and_single_lang(spark):
    rows = [(3, "a", "en", 1, "A")]
    assert run(spark, rows) == brute(rows)
    rows = [(i, "a", "en", 1, "x") for i in range(9)]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = sorted((tuple(r) for r in manifest(docs).select(*COLS).collect()), key=repr)
    assert got == brute(rows)
