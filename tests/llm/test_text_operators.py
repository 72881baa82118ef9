"""Operators on documents against brute-force versions and messy tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfold.llm import decontam, digest, pii, ppm
from tallyfold.llm.components import connected_components
from tallyfold.llm.hashing import shingle_sets, words
from tallyfold.llm.lines import drop_repeated_lines
from tallyfold.llm.mixing import BLOCK, mix_sources
from tallyfold.llm.ngram_join import SegmentPlan, near_duplicate_groups, node_of, sketch_of

SMALL = "/root/testdata/sf0.001"
# Every row has columns whose names the operators use inside.
CLASHING = ["node", "mark", "component", "doc", "txt", "pos", "kind", "bucket", "k", "h", "size", "rank", "place"]
VOCABULARY = "alpha beta gamma delta Epsilon zeta eta theta iota kappa lambda mu nu xi".split()


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def tokens(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", lower(text or "")) if w]


def messy_rows(seed=5, n=120):
    rng = random.Random(seed)
    texts = ["", None, "   \n\t ", "one", "One", "one two", "é ü\nß", "x " * 3000, "a\n\nb\n"]
    base = [" ".join(rng.choice(VOCABULARY) for _ in range(rng.randrange(3, 60))) for _ in range(25)]
    while len(texts) < n:
        own = rng.choice(base).split(" ")
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            own[rng.randrange(len(own))] = rng.choice(VOCABULARY)
        if rng.random() < 0.5:
            own.insert(rng.randrange(len(own)), "\ncommon LINE here \n")
        texts.append(" ".join(own))
    rows = [(k, t, rng.choice(["a", "b", None, "Z"])) for k, t in enumerate(texts)]
    return rows + [rows[10], rows[10], rows[0], (None, "no id at all here", "a"), (None, None, None)]


def frame(spark, rows, parts=5):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return df.withColumns({c: F.lit("clash") for c in CLASHING}).repartition(parts)


@pytest.fixture(scope="module")
def messy(spark):
    return frame(spark, messy_rows()).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, messy_rows()).filter("false")


# hashing


def test_word_hashes_tell_words_apart_and_nothing_else():
    texts = ["The the", "", " a\tb\x0bc ", "ab", "é É", "ab ab", "\x1fq"]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    hashes, row = words(data, np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    found = [(int(r), w) for r, t in enumerate(texts) for w in tokens(t)]
    assert [r for r, _ in found] == row.tolist()
    assert len(set(hashes.tolist())) == len({w for _, w in found})
    by_word = {}
    for (_, w), h in zip(found, hashes.tolist(), strict=True):
        assert by_word.setdefault(w, h) == h


# near duplicates


def brute_groups(rows, words_, percent):
    sets = {}
    for k, (i, t, *_) in enumerate(rows):
        w = tokens(t)
        sets[k] = {tuple(w[j : j + words_]) for j in range(len(w) - words_ + 1)} if len(w) >= words_ else ({tuple(w)} if w else set())
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    keys = [k for k in sets if sets[k] and rows[k][0] is not None]
    for a in keys:
        for b in keys:
            same = len(sets[a] & sets[b])
            if a < b and 100 * same >= percent * len(sets[a] | sets[b]):
                x, y = find(rows[a][0]), find(rows[b][0])
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(sets[k]), find(i) if i is not None else None) for k, (i, *_) in enumerate(rows)), key=repr)


@pytest.mark.parametrize(("words_", "percent"), [(4, 85), (2, 60)])
def test_near_duplicates_are_those_of_all_pairs(messy, words_, percent):
    got = near_duplicate_groups(messy, percent, words_).collect()
    assert sorted(map(tuple, got), key=repr) == brute_groups([tuple(r)[:3] for r in messy.collect()], words_, percent)


def test_near_duplicates_of_nothing(empty):
    assert near_duplicate_groups(empty).count() == 0


def test_a_document_given_by_two_texts_is_one(spark):
    rows = [(1, "a b c d e f", None), (7, "a b c d e f", None), (7, "u v w x y z", None), (9, "u v w x y z", None)]
    assert {r[0]: r[2] for r in near_duplicate_groups(frame(spark, rows)).collect()} == {1: 1, 7: 1, 9: 1}


@pytest.mark.parametrize("percent", [70, 80, 85, 95])
def test_linked_sets_share_a_signature(percent):
    rng, plan = np.random.default_rng(percent), SegmentPlan(percent)
    linked = 0
    for _ in range(1500):
        size = int(rng.integers(1, rng.choice([8, 40, 300, 2000])))
        common = rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2)
        extra = [rng.integers(0, 1 << 63, rng.integers(0, 2 + size // 8), dtype=np.uint64) for _ in range(2)]
        a, b = (np.unique(np.concatenate([common, e])) for e in extra)
        same = len(np.intersect1d(a, b))
        if 100 * same >= percent * (len(a) + len(b) - same) and node_of(a) != node_of(b):
            linked += 1
            assert np.intersect1d(plan.signatures(a), plan.signatures(b)).size
            apart = int(np.bitwise_count((sketch_of(a) ^ sketch_of(b)).view(np.uint64)).sum())
            assert apart <= plan.budget(len(a), len(b))
    assert linked > 40


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(400, 470)] + [(900, k) for k in range(901, 960)]
    edges += [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r[0]: r[1] for r in got.collect()} == {x: find(x) for x in parent}


# lines


def brute_lines(rows, min_docs, min_chars, keep_first):
    def key(line):
        return lower(line.strip(" \t\n\x0b\x0c\r"))

    docs = sorted({(-(2**63) if i is None else i, t or "") for i, t, *_ in rows}, key=lambda d: d[0])
    where = {}
    for d in docs:
        for p, line in enumerate(d[1].split("\n")):
            if len(key(line)) >= min_chars:
                where.setdefault(key(line), []).append((d, p))
    common = {k: places for k, places in where.items() if len({d for d, _ in places}) >= min_docs}
    kept = {}
    for d in docs:
        kept[d] = [x for p, x in enumerate(d[1].split("\n")) if key(x) not in common or (keep_first and common[key(x)][0] == (d, p))]
    return common, kept


@pytest.mark.parametrize("keep_first", [False, True])
def test_lines_by_brute_force(spark, messy, keep_first):
    rows = [tuple(r)[:3] for r in messy.collect()]
    _, kept = brute_lines(rows, 4, 1, keep_first)
    got = drop_repeated_lines(messy, min_docs=4, keep_first=keep_first).collect()
    assert len(got) == len(rows)
    ids = Counter(i for i, *_ in rows)
    for r in got:
        text = r["text"] or ""
        assert r["n_lines"] == text.count("\n") + 1
        if not keep_first or ids[r["doc_id"]] == 1:
            own = kept[-(2**63) if r["doc_id"] is None else r["doc_id"], text]
            assert r["kept_text"] == "\n".join(own)
            assert r["n_dropped"] == r["n_lines"] - len(own)


@pytest.mark.parametrize("keep_first", [False, True])
def test_a_line_of_all_documents_spreads_over_partitions(spark, keep_first):
    rows = [(k, f"shared\nown {k}\nshared", None) for k in range(400)] + [(k, f"pair {k // 2}", None) for k in range(400, 420)]
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["doc_id"]: r["kept_text"] for r in drop_repeated_lines(frame(spark, rows), min_docs=3, keep_first=keep_first).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    want = {k: f"own {k}" for k in range(400)} | {k: f"pair {k // 2}" for k in range(400, 420)}
    if keep_first:
        want[0] = "shared\nown 0"
    assert got == want


def test_lines_of_nothing(empty):
    assert drop_repeated_lines(empty).count() == 0


# decontamination


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.read.parquet(f"{SMALL}/benchmark.parquet")


def test_passages_are_found_with_their_place_and_nothing_else(spark, benchmark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r[0]: r[1] for r in docs.select("doc_id", "text").collect()}
    items = {r[0]: r[1] for r in benchmark.collect()}
    found = {(r["doc_id"], r["item_id"]): r for r in decontam.contaminated_passages(docs, benchmark).collect()}
    want = {(d, i) for d, t in texts.items() for i, x in items.items() if x in t}
    assert want and want == set(found)
    for (d, i), r in found.items():
        assert items[i][5:-5] in texts[d][r["start"] : r["end"]]
    clean = {r[0] for r in decontam.drop_contaminated(docs, benchmark).select("doc_id").collect()}
    assert clean == set(texts) - {d for d, _ in want}


def test_edited_passages(spark, benchmark):
    rng = random.Random(4)
    rows, items = [], [tuple(r) for r in benchmark.collect()]
    for i, text in items:
        own = list(text.upper() if i % 2 else text.replace(" ", " - "))
        for _ in range(len(text) // 40):
            own[rng.randrange(len(own))] = rng.choice(["q", "", "zz"])
        rows.append((i, "é word before " * 3 + "".join(own) + " and after. " * 4, None))
    got = decontam.contaminated_passages(frame(spark, rows), benchmark)
    assert {(i, i) for i, _ in items} <= {(r["doc_id"], r["item_id"]) for r in got.collect()}


@pytest.mark.parametrize("empties", [2, 3, 40])
def test_a_short_item_beside_empty_texts_is_found(spark, empties):
    item = "the seven small boats left a quiet harbour at dawn"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    texts = ["some other text before it", item, *["", None, "a"] * empties, item.upper(), *[""] * empties, "and a text that comes after"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    want = {k for k, t in enumerate(texts) if t and t.lower() == item}
    assert {r["doc_id"] for r in decontam.contaminated_passages(docs, items).collect()} == want
    assert {r["doc_id"] for r in decontam.drop_contaminated(docs, items).select("doc_id").collect()} == set(range(len(texts))) - want


def test_decontamination_of_messy_tables(spark, messy, empty, benchmark):
    assert decontam.contaminated_passages(messy, benchmark).count() == 0
    assert decontam.drop_contaminated(messy, benchmark).count() == messy.count()
    assert decontam.contaminated_passages(empty, benchmark).count() == 0
    assert decontam.contaminated_passages(messy, benchmark.filter("false")).count() == 0
    short = spark.createDataFrame([(1, "too short"), (None, "x" * 90), (3, None), (4, "y " * 60)], "item_id long, text string")
    docs = frame(spark, [(None, "y " * 70, None), (2, "x" * 99, None)])
    assert [r["item_id"] for r in decontam.contaminated_passages(docs, short).collect()] == [4]


def test_banded_alignment_gives_the_edit_distance():
    rng = random.Random(9)
    item = "".join(rng.choice("abcdefgh ") for _ in range(90)).strip().replace("  ", "xx") + "q"
    index = decontam.ItemIndex([(1, item)])
    for _ in range(60):
        own = list(item)
        for _ in range(rng.randrange(0, 6)):
            at = rng.randrange(5, len(own) - 5)
            own[at : at + 1] = rng.choice([["z"], [], ["z", own[at]]])
        text = f"before {''.join(own)} after".encode()
        best = [[0] * (len(text) + 1)]
        for x in item.encode():
            row = [best[-1][0] + 1]
            for j, y in enumerate(text):
                row.append(min(best[-1][j] + (x != y), best[-1][j + 1] + 1, row[-1] + 1))
            best.append(row)
        want, budget = min(best[-1]), int(index.edits[0])
        got = index.verify(text, 0, 7 - budget - 1, 2 * (budget + 1))
        assert (got is None and want > budget) or got[0] == want


# mixing


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    total, bound = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in bound)
        share = sum(weight[s] for s in names if s not in bound)
        target = {s: 3 * sizes[s] if s in bound else rest * weight[s] / share for s in names}
        over = {s for s in names if target[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return target
        bound |= over


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mix_comes_near_its_targets(spark, seed):
    rng = random.Random(seed)
    rows = [(k, "w " * rng.randrange(0, 90), rng.choice(["a", "a", "a", "a", "B", "c", None, "é"])) for k in range(1500)]
    rows += [(2000, "tiny source", "tiny"), (2001, "", "nothing"), (None, "x y z", "a")]
    got = mix_sources(frame(spark, rows)).toPandas()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(tokens(t))
    targets = brute_targets(dict(sizes))
    for s, target in targets.items():
        own = got[got.source.isna()] if s is None else got[got.source == s]
        assert abs(own.target.iloc[0] - target) < 1e-6 and (own.source_size == sizes[s]).all()
        assert abs(own.taken.sum() - target) <= 2 * BLOCK
    assert ((got.taken >= 0) & (got.taken <= 3 * got["size"])).all()
    again = mix_sources(frame(spark, rows, parts=3)).toPandas()
    assert Counter(zip(got.doc_id.fillna(-1), got.taken, strict=True)) == Counter(zip(again.doc_id.fillna(-1), again.taken, strict=True))


def test_mix_of_messy_tables(messy, empty):
    got = mix_sources(messy).toPandas()
    assert len(got) == messy.count() and (got.taken <= 3 * got["size"]).all()
    assert mix_sources(empty).count() == 0


def test_quotas_follow_the_highest_quotients(spark):
    from tallyfold.llm.mixing import apportion

    rng = random.Random(8)
    shares = [rng.randrange(1, 4000) for _ in range(40)]
    for seats in (0, 1, 7, 333):
        df = spark.createDataFrame([(1, k, s, seats, 10**6) for k, s in enumerate(shares)], "g int, k int, share long, seats long, cap long")
        got = {r["k"]: r["q"] for r in apportion(df, ["g"], "seats", "share", "cap", [F.col("k")], "q").collect()}
        won = Counter()
        for _ in range(seats):
            won[max(range(len(shares)), key=lambda k: (shares[k] / (2 * won[k] + 1), -k))] += 1
        assert got == {k: won[k] for k in range(len(shares))}


# personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            fits = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 14 <= len(digits) <= 19 and pii.luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }
            if fits[kind]:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans_are_those_of_the_patterns():
    rng, automaton = random.Random(3), pii.anchors()
    pieces = ["1", "22", "3", ".", "-", " ", "@", "a", "b.c", "+", "(", ")", "255.", "4111111111111111", "+1 (555) 123-4567", "x@y.z", "é", "😀"]
    for _ in range(20000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(0, 25)))
        assert [s for s in pii.spans(text, automaton) if s[0] in pii.BASE_KINDS] == base_spans(text)


def test_added_spans_and_long_runs():
    automaton = pii.anchors()
    text = 'see ftp://joe:pw@host.example/x, Account no: DE44 5001 0517 5407 3249 31 and token = "0123456789abcdef0123"'
    kinds = {k: text[a:b] for k, a, b in pii.spans(text, automaton)}
    assert kinds["url"] == "ftp://joe:pw@host.example/x,"[:-1] + ","
    assert kinds["secret"] == "0123456789abcdef0123" and kinds["account"].startswith("DE44 5001")
    for run in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+" * 100_000, "@" * 100_000, "a@" * 100_000):
        pii.spans(run, automaton)


def test_personal_data_of_messy_tables(spark, messy, empty):
    rows = pii.personal_spans(messy).collect()
    assert len(rows) == messy.count() and all(r["spans"] == [] for r in rows)
    assert pii.personal_spans(empty).count() == 0
    one = pii.personal_spans(frame(spark, [(None, "mail é.x@y.zz now", None)]))
    assert one.select(pii.written()).first()[0] == "email:6:13" and one.first()["doc_id"] is None


# fingerprints


@pytest.mark.parametrize("rows_in_bucket", [1, 7, 500])
def test_edited_texts(spark, messy, monkeypatch, rows_in_bucket):
    monkeypatch.setattr(digest, "BUCKET_ROWS", rows_in_bucket)
    rows = sorted(((r[0], r[1] or "") for r in messy.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    want = Counter()
    for (i, text), (_, following) in zip(rows, [*rows[1:], rows[0]], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        a, b, c = (digest.digest(t.encode()) for t in (text, edited, following))
        want[i, len(text), hashlib.sha256(edited.encode()).hexdigest(), a.hex(), b.hex(), digest.likeness(a, b), digest.likeness(a, c)] += 1
    got = digest.edited_fingerprints(messy)
    assert Counter(map(tuple, got.collect())) == want


def test_digests(spark, empty):
    assert digest.digest(b"") == bytes(65) and digest.likeness(bytes(65), bytes(65)) == 1.0
    assert digest.edited_fingerprints(empty).count() == 0
    only = digest.edited_fingerprints(frame(spark, [(3, "abcdef", None)])).first()
    assert only["near_next"] == 1.0 and only["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest()
    text = b"some words that go on for a while, and then stop without a reason " * 3
    assert digest.likeness(digest.digest(text), digest.digest(text[:-9] + b"a change.")) > 0.6
    assert digest.likeness(digest.digest(text), digest.digest(bytes(reversed(text)))) < 0.6


# language model


def test_probabilities_of_all_bytes_sum_to_one():
    raw = [t.encode() for t in ["The cat sat on the mat.", "", "A cat ate\nthe rat", "éé"]]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    grams, counts = np.unique(ppm.byte_stream(data, offsets)[0], return_counts=True)
    for own, n in ((grams, counts), (grams[:3], counts[:3]), (grams[:0], counts[:0])):
        model = ppm.PartialMatching(own, n)
        for context in [*(int(g) >> 8 for g in grams), *(int.from_bytes(f"{c}".encode()[:5], "big") for c in ("  the", "zzzzz", "xxcat"))]:
            p = 10 ** model.log10(np.array([context << 8 | b for b in range(256)], np.uint64))
            assert abs(p.sum() - 1) < 1e-9


def test_scores_by_brute_force(spark, messy, monkeypatch):
    monkeypatch.setattr(ppm, "FREQUENT", 4)
    rows = [(r[0], r[1]) for r in messy.collect()]
    used = [[*tokens(t), "\0end"] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    count = Counter(w for h, u in zip(held, used, strict=True) if not h for w in u)
    n, v = sum(count.values()), len(count)
    want = sorted(
        ((i, h, len(u), sum(count[w] > 0 for w in u), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in u)) for (i, _), h, u in zip(rows, held, used, strict=True)),
        key=repr,
    )
    got = ppm.score_texts(messy).collect()
    have = sorted((tuple(r)[:6] for r in got), key=repr)
    assert [w[:5] for w in want] == [h[:5] for h in have]
    assert all(math.isclose(w[5], h[5], rel_tol=1e-9) for w, h in zip(sorted(want, key=repr), have, strict=True))
    assert all(r["score"] < 0 for r in got)


def test_model_beats_words_on_texts_it_has_not_seen(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    held = ppm.score_texts(df).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]


def test_scores_of_nothing(spark, empty):
    assert ppm.score_texts(empty).count() == 0
    only_held = frame(spark, [(i, "some words", None) for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2])
    rows = ppm.score_texts(only_held).collect()
    assert rows and all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0 for r in rows)


def test_a_full_trie_drops_its_rarest(spark):
    counts = spark.createDataFrame([(k + 256 * k, 1 + k % 3) for k in range(60)], "key long, n long")
    model = ppm.fit_trie(counts, most=25)
    assert len(model["top"]["order"]) == 20


def test_scores_need_no_gram_among_the_frequent(spark, messy, monkeypatch):
    rows = [(r[0], r[1] or "") for r in messy.collect()] + [(k, f"свое слово {k} " * 3, None)[:2] for k in range(900, 930)]
    rows += [rows[-1]] * 2

    def stream(texts):
        raw = [t.encode() for t in texts]
        return ppm.byte_stream(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))

    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    model = ppm.PartialMatching(*np.unique(stream([t for (_, t), h in zip(rows, held, strict=True) if not h])[0], return_counts=True))
    want = sorted((str(i), float(model.log10(stream([t])[0]).sum())) for i, t in rows)
    for most in (0, 60, 1 << 21):
        monkeypatch.setattr(ppm.fit_trie, "__defaults__", (most,))
        got = sorted((str(r["doc_id"]), r["score"]) for r in ppm.score_texts(frame(spark, [(i, t, None) for i, t in rows])).collect())
        assert [g[0] for g in got] == [w[0] for w in want]
        assert all(math.isclose(g[1], w[1], rel_tol=1e-9) for g, w in zip(got, want, strict=True))


def test_shingles_of_short_texts():
    raw = [b"a b c", b"A  B\tC", b"a b", b"", b" "]
    sets = shingle_sets(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]), 4)
    assert [len(s) for s in sets] == [1, 1, 1, 0, 0] and sets[0][0] == sets[1][0] != sets[2][0]
