"""Web pages, URLs, the quality classifier, the pipeline and the registered
queries."""

import itertools
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tallyfold.llm import checks, decontam, html, quality, urls
from tallyfold.llm.tables import stage

SMALL = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "benchmark", "labels")


# main text


def test_minimum_cut_is_minimal():
    rng = random.Random(6)
    for _ in range(300):
        n = rng.randrange(1, 8)
        gain = [rng.randrange(-9, 10) for _ in range(n)]
        edges = [(a, b, rng.randrange(0, 7)) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.5]

        def cost(keep, gain=gain, edges=edges):
            lost = sum(abs(g) for g, k in zip(gain, keep, strict=True) if (g > 0) != k and g)
            return lost + sum(c for a, b, c in edges if keep[a] != keep[b])

        best = min(cost(k) for k in itertools.product([False, True], repeat=n))
        assert cost(html.minimum_cut(gain, edges)) == best


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
<header><h1>Site</h1><ul><li><a href=/>Home</a></ul></header><div id="cookie-banner">We use cookies.</div>
<div class="wrap"><div class="post-content"><h1>Head &amp; line</h1><!-- no --><p>First   <b>bold</b>&nbsp;part<br>and &#233; more.
<p>Second &lt;b&gt; para<div class="ad-slot">Buy now.</div><script>var x = "</p>";</script><ul><li>Item one</li><li>Two</ul>
<table><tr><td>a<td>b</table></div><div class="sidebar"><p>A side text, long enough to look like a sentence, really.</p></div>
<section id="comments"><article class="comment"><p>A reader writes that this was nice to read, thank you.</p></article></section></div>
<form>Search <input></form><footer>&copy; me</footer>"""


def test_main_text_of_a_page():
    assert html.main_text(PAGE) == "Head & line\nFirst bold part and é more.\nSecond <b> para\nItem one\nTwo\na\nb"


def test_pages_without_marks_or_with_broken_markup():
    plain = "<div><p>One long paragraph of text, with a sentence that ends properly and has many words in it.</p><p>Short.</p><a href=x>more</a></div>"
    assert html.main_text(plain) == "One long paragraph of text, with a sentence that ends properly and has many words in it.\nShort."
    for broken in ("", "<", "<p", "<article><p>x", "</div></p>", "<a href='", "<!-- open", "<script>never closed", "<" * 5000, "&amp;" * 10):
        html.main_text(broken)
    assert html.main_text("<article><p>x") == "x"
    long = "<article>" + "<p>Some words here.</p>" * 3000 + "</article>"
    assert html.main_text(long).count("\n") == 2999


def test_articles_of_the_given_pages(spark):
    import html as decode

    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    raw = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in html.extract_text(pages).collect():
        article = re.search("<article>(.*?)</article>", raw[r["page_id"]], re.DOTALL)[1]
        blocks = [" ".join(decode.unescape(re.sub("<[^>]+>", "", b)).split()) for b in re.split("</?(?:p|h1)>", article.replace("<br>", " "))]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_messy_pages(spark):
    rows = [(None, None, None), (1, "u", ""), (1, "u", PAGE), (1, "u", PAGE), (2, None, "<p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html.extract_text(df).collect()
    assert sorted(r["n_chars"] for r in got) == [0, 0, 0, *[len(html.main_text(PAGE))] * 2]
    assert html.extract_text(df.filter("false")).count() == 0


# URLs


def brute_verdicts(rows):
    """(host, path, rule, score, verdict) of each URL, by plain loops."""
    parts = []
    for url in rows:
        m = re.match("(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [
            (len(rule), rule, says)
            for says, rule in urls.RULES
            if (host == rule.partition("/")[0] or host.endswith("." + rule.partition("/")[0])) and path.startswith("/" + rule.partition("/")[2])
        ]
        parts.append((host, path, *max(fits, default=(0, None, None))[1:]))

    def numbers(url):
        rest = re.sub("[A-Z]", lambda c: c[0].lower(), re.sub("^(?s:.*?)://", "", url or "", count=1))
        return [0, 0, *(urls.SIGNS.find("0" if c.isascii() and c.isdigit() else c) + 3 for c in rest), 1]

    def fixed(seq):
        return [x if x >= 3 or k in (0, 1, len(seq) - 1) else 2 for k, x in enumerate(seq)]

    triples = [list(zip(s, s[1:], s[2:], strict=False)) for s in (fixed(numbers(u)) for u in rows)]
    size = urls.SYMBOLS

    def model(says):
        from collections import Counter

        n3 = Counter(t for own, p in zip(triples, parts, strict=True) if p[3] == says for t in own)
        n2, n1, ab, b = Counter(), Counter(), Counter(), Counter()
        for (x, y, z), n in n3.items():
            n2[y, z] += n
            n1[z] += n
            ab[x, y] += n
        kinds_ab, kinds_b = Counter((x, y) for x, y, _ in n3), Counter(y for y, _ in n2)
        for (y, _), n in n2.items():
            b[y] += n
        total = sum(n1.values())

        def p(x, y, z):
            p0 = (n1[z] + 1) / (total + size)
            p1 = (n2[y, z] + kinds_b[y] * p0) / (b[y] + kinds_b[y]) if b[y] else p0
            return (n3[x, y, z] + kinds_ab[x, y] * p1) / (ab[x, y] + kinds_ab[x, y]) if ab[x, y] else p1

        return p

    yes, no = model("allow"), model("block")
    scores = [sum(math.log(yes(*t)) - math.log(no(*t)) for t in own) / len(own) for own in triples]
    return parts, scores


def test_urls_by_brute_force(spark):
    given = [r[0] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("url").collect()]
    odd = [None, "", "nourl", "a://b", "x://y?z", "HTTP://Example.COM/EN/", "p://q://r/s", "http://net/fr/", "http://u.net/fr", "http://é.COM/ü\n?x", "://"]
    rows = given + odd
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string").withColumns({"says": F.lit(1), "codes": F.lit(2)})
    got = {r["page_id"]: r for r in urls.judge_urls(df).collect()}
    parts, scores = brute_verdicts(rows)
    undecided = []
    for k, ((host, path, rule, says), score) in enumerate(zip(parts, scores, strict=True)):
        r = got[k]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert math.isclose(r["score"], score, abs_tol=1e-9)
        if says:
            assert r["verdict"] == says
        else:
            undecided.append((r["score"], r["verdict"]))
    allowed = [s for s, v in undecided if v == "allow"]
    assert allowed and min(allowed) > max(s for s, v in undecided if v == "block")


def test_threshold_has_the_least_error():
    rng = random.Random(1)
    for _ in range(20):
        bins = [(b, rng.randrange(0, 30), rng.randrange(0, 30)) for b in rng.sample(range(urls.BINS), 25)]
        cut = (urls._threshold(bins) + urls.LIMIT) / (2 * urls.LIMIT) * urls.BINS
        yes, no = sum(b[1] for b in bins), sum(b[2] for b in bins)

        def error(at, bins=bins, yes=yes, no=no):
            return sum(y for b, y, _ in bins if b < at) / yes + sum(n for b, _, n in bins if b >= at) / no

        assert math.isclose(error(cut), min(error(k) for k in range(urls.BINS + 1)), abs_tol=1e-9)


def test_urls_without_a_model(spark):
    df = spark.createDataFrame([(1, "http://a.org/x"), (2, "http://a.com/x")], "page_id long, url string")
    assert {r["verdict"] for r in urls.judge_urls(df).collect()} == {"allow"}
    assert urls.judge_urls(df.filter("false")).count() == 0


def test_url_filter_runs_no_python(spark):
    plan = checks.QUERIES["op9_url_filter"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    plan += checks.QUERIES["op7_source_mix"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


# quality




def test_quality_of_documents_not_fitted_on(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    grades = quality.graded(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))
    model = quality.fit_quality(docs, grades.filter("doc_id % 3 != 0"))
    assert (np.diff(model.thresholds) > 0).all()
    test = quality.with_quality(docs, model).join(grades.filter("doc_id % 3 = 0"), "doc_id").select("grade", "quality_score.*").toPandas()
    good = test.grade >= quality.GOOD_GRADE
    assert (test.accepted == good).mean() > 0.98 and test.accepted[good].mean() > 0.99
    assert test.groupby("grade").expected_grade.mean().is_monotonic_increasing


def test_ordinal_regression_recovers_an_order():
    rng = np.random.default_rng(0)
    x = rng.normal(size=800)
    grade = np.digitize(2 * x + rng.logistic(size=800) * 0.5, [-1.5, 0.0, 1.5])
    model = quality.fit_ordinal(np.arange(800), np.zeros(800, np.int64), x, grade, 3)
    assert (np.diff(model.thresholds) > 0).all() and np.corrcoef(model.tails(model.weights[0] * x).sum(axis=1), grade)[0, 1] > 0.8


def test_quality_of_messy_tables(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (None, ""), (3, "a " * 20000), (4, "fine words")], "doc_id long, text string").withColumn("grade", F.lit("x"))
    labels = spark.createDataFrame([(1, 1, None), (None, 1, 0), (4, None, 1), (3, 0, 1), (4, 1, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit_quality(docs, quality.graded(labels))
    assert quality.with_quality(docs, model).select("quality_score.accepted").dropna().count() == 5
    none = quality.fit_quality(docs, quality.graded(labels.filter("false")))
    assert none is None and quality.with_quality(docs, none).filter("quality_score.accepted").count() == 5
    assert quality.with_quality(docs.filter("false"), model).count() == 0
    assert quality.fit_quality(docs.filter("false"), quality.graded(labels)) is None


# pipeline and queries


def test_each_stage_by_brute_force(spark):
    from test_text_operators import brute_groups, brute_lines, tokens

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    tables = [docs]
    for name, step in corpus_pipeline.STAGES:
        tables.append(stage(step(spark, tables[-1], SMALL), "test"))
        assert name and (len(tables) > 5 or tables[-1].columns == columns)
    rows = [[tuple(r) for r in t.select("doc_id", "text").collect()] for t in tables[:5]]
    full, good, lines, unique, clean = ({i: t for i, t in r} for r in rows)

    bad = {r[0] for r in spark.read.parquet(f"{SMALL}/labels.parquet").filter("quality = 0").select("doc_id").collect()}
    rated = {r[0] for r in spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id").collect()}
    assert {i for i in rated if i not in good} == bad

    _, kept = brute_lines(rows[1], 10, 1, True)
    want = {i: "\n".join(x) for (i, t), x in kept.items() if tokens("\n".join(x)) or not tokens(t)}
    assert lines == want

    assert set(unique) == {i for i, _, c in brute_groups(rows[2], 5, 80) if i == c}
    assert all(unique[i] == lines[i] for i in unique)

    def plain(text):
        return decontam.plain(np.frombuffer(text.encode(), np.uint8))[0].tobytes().strip()

    items = [plain(r[0]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("text").collect()]
    leaks = {i for i, t in unique.items() if any(x in plain(t) for x in items)}
    assert set(clean) == set(unique) - leaks

    mixed = tables[5].toPandas()
    assert sorted(mixed.doc_id) == sorted(clean) and all(n == len(tokens(clean[i])) for i, n in zip(mixed.doc_id, mixed["size"], strict=True))


def test_registered():
    names = entry.queries()
    assert {int(n[2:].split("_")[0]) for n in names if re.match(r"op\d+_", n)} == set(range(1, 14))
    assert names["pipeline"] is corpus_pipeline.run


@pytest.mark.parametrize("name", sorted(checks.SQL))
def test_query_by_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    want = con.sql(checks.SQL[name]).df()
    got = checks.QUERIES[name](spark, SMALL).toPandas()
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    assert sorted(map(tuple, got[columns].values.tolist())) == sorted(map(tuple, want[columns].values.tolist()))


@pytest.mark.parametrize("name", ["op2_personal_data", "op3_fingerprints", "op4_html_extraction", "op6_language_model", "op8_quality_classifier"])
def test_queries_cover_their_table(spark, name):
    got = checks.QUERIES[name](spark, SMALL)
    table = "pages" if name.startswith("op4") else "documents"
    assert got.count() == spark.read.parquet(f"{SMALL}/{table}.parquet").count()
