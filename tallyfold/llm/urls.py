"""URL filter: rules by host and path, and for the rest a character language
model ratio.

Two Markov models of URL characters are built from the URLs that the rules
allow and those they block. Both are of variable order: a character's
probability after two others is smoothed with that after one, and that with
its frequency (Witten-Bell). Over an alphabet of 40 symbols there are 64,000
groups of three, so the difference of the two log probabilities is one table
of fixed size, which every URL sums up and divides by its length. The threshold
is calibrated on the rule-decided URLs. DataFrame functions only.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyfold.llm.tables import stage

# The rules (verdict, host and path).
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Symbols of the models: 0 is the start, 1 the end, 2 any other character; a digit counts as 0.
SIGNS = LOWER + "0.-/?=&_%#:"
SYMBOLS = len(SIGNS) + 3
# Bins of the calibration's histogram, over scores of -LIMIT to LIMIT a character.
BINS, LIMIT = 2000, 10.0


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(slash + rest)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def _symbols(url: Column) -> Column:
    """Symbol numbers of a URL without its scheme, with two starts before and an end after it."""
    rest = F.translate(F.regexp_replace(url, r"^(?s).*?://", ""), UPPER + "123456789", LOWER + "0" * 9)
    signs = F.filter(F.split(rest, ""), lambda c: c != "")
    inner = F.transform(signs, lambda c: F.greatest(F.instr(F.lit(SIGNS), c) + 2, F.lit(2)))
    return F.concat(F.array(F.lit(0), F.lit(0)), inner, F.array(F.lit(1)))


def _codes(symbols: Column) -> Column:
    """Number of each group of three symbols."""
    return F.transform(
        F.sequence(F.lit(0), F.size(symbols) - 3),
        lambda k: (F.get(symbols, k) * SYMBOLS + F.get(symbols, k + 1)) * SYMBOLS + F.get(symbols, k + 2),
    )


def log_ratios(counts: DataFrame) -> DataFrame:
    """(code, ratio) of every group of three symbols, from (code, yes, no)
    counts: log P(c | ab) under the allowed URLs less that under the blocked.

    A group of the three numbers is 64,000 rows whatever the corpus.
    """
    cells = counts.sparkSession.range(SYMBOLS**3).withColumnRenamed("id", "code")
    rows = cells.join(counts, "code", "left").fillna(0, ["yes", "no"])
    rows = rows.withColumns({"ab": F.floor(F.col("code") / SYMBOLS), "bc": F.col("code") % SYMBOLS**2})
    rows = rows.withColumns({"b": F.col("ab") % SYMBOLS, "c": F.col("code") % SYMBOLS})
    logs = {}
    for side in ("yes", "no"):
        after = W.partitionBy("ab")
        rows = rows.withColumn(f"bc_{side}", F.sum(side).over(W.partitionBy("bc")))
        rows = rows.withColumns(
            {
                f"ab_{side}": F.sum(side).over(after),
                f"kinds_{side}": F.sum((F.col(side) > 0).cast("long")).over(after),
                # Each pair bc is there once for every first symbol.
                f"b_{side}": F.sum(f"bc_{side}").over(W.partitionBy("b")) / SYMBOLS,
                f"b_kinds_{side}": F.sum((F.col(f"bc_{side}") > 0).cast("long")).over(W.partitionBy("b")) / SYMBOLS,
                f"c_{side}": F.sum(side).over(W.partitionBy("c")),
            }
        )
        total = F.sum(side).over(W.partitionBy(F.lit(1)))
        rows = rows.withColumn(f"p0_{side}", (F.col(f"c_{side}") + 1) / (total + SYMBOLS))
        seen_b = F.col(f"b_{side}") + F.col(f"b_kinds_{side}")
        p1 = F.when(seen_b > 0, (F.col(f"bc_{side}") + F.col(f"b_kinds_{side}") * F.col(f"p0_{side}")) / seen_b).otherwise(F.col(f"p0_{side}"))
        rows = rows.withColumn(f"p1_{side}", p1)
        seen_ab = F.col(f"ab_{side}") + F.col(f"kinds_{side}")
        logs[side] = F.log(F.when(seen_ab > 0, (F.col(side) + F.col(f"kinds_{side}") * F.col(f"p1_{side}")) / seen_ab).otherwise(F.col(f"p1_{side}")))
    return rows.select("code", (logs["yes"] - logs["no"]).alias("ratio"))


def _threshold(bins: list[tuple[int, int, int]]) -> float:
    """The cut with the least mean of the two error shares, from (bin, allowed,
    blocked) counts; among equal ones the middle of the longest run."""
    yes, no = sum(b[1] for b in bins) or 1, sum(b[2] for b in bins) or 1
    by_bin = {b: (y, n) for b, y, n in bins}
    below_yes = below_no = 0
    best, runs = math.inf, []
    for cut in range(BINS + 1):
        error = below_yes / yes + 1 - below_no / no
        if error < best - 1e-12:
            best, runs = error, [[cut, cut]]
        elif error <= best + 1e-12:
            runs[-1][1:] = [cut] if runs[-1][1] == cut - 1 else runs[-1][1:]
            if runs[-1][1] != cut:
                runs.append([cut, cut])
        y, n = by_bin.get(cut, (0, 0))
        below_yes, below_no = below_yes + y, below_no + n
    low, high = max(runs, key=lambda r: r[1] - r[0])
    return (low + high) / 2 / BINS * 2 * LIMIT - LIMIT


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """(page_id, url, host, path, rule, score, verdict) per row.

    A rule fits its host and all subdomains if the path starts with its path;
    the longest wins. Other URLs are allowed if their score, the mean log
    ratio a character, reaches the calibrated threshold. A null URL or one
    without ``://`` has empty host and path, and is scored as it stands (null
    as empty). If the rules allow nothing or block nothing there is no model:
    scores are 0 and such URLs are allowed. Null ids pass through, repeated
    rows come out as often, other columns are ignored, and an empty table
    gives no rows.
    """
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("__text"), F.col(url_col).cast("string").alias("url"))
    rows = rows.withColumns({"host": host_of(F.col("__text")), "path": path_of(F.col("__text"))})
    name, says = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": name, "says": says, "codes": _codes(_symbols(F.col("__text")))}).drop("__text")
    rows = stage(rows, "urls")

    grams = rows.filter("says is not null").select(F.explode("codes").alias("code"), (F.col("says") == "allow").cast("long").alias("y"))
    counts = grams.groupBy("code").agg(F.sum("y").alias("yes"), F.sum(1 - F.col("y")).alias("no"))
    counts = stage(counts, "url-grams")
    sums = counts.agg(F.sum("yes"), F.sum("no")).first()
    if not (sums[0] and sums[1]):
        score, threshold = F.lit(0.0), 0.0
    else:
        # 64,000 numbers at any size of the corpus, so they may travel as one constant.
        table = [r[0] for r in log_ratios(counts).sort("code").select("ratio").collect()]
        ratio = F.from_json(F.lit(json.dumps(table)), "array<double>")
        summed = F.aggregate("codes", F.lit(0.0), lambda total, code: total + F.get(ratio, code))
        score = summed / F.size("codes")
        bin_of = F.floor((F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT - 1e-9), score)) + LIMIT) / (2 * LIMIT) * BINS)
        decided = rows.filter("says is not null").select(bin_of.cast("int").alias("bin"), (F.col("says") == "allow").cast("long").alias("y"))
        bins = decided.groupBy("bin").agg(F.sum("y"), F.sum(1 - F.col("y"))).collect()
        threshold = _threshold([tuple(b) for b in bins])
    scored = rows.withColumn("score", score)
    verdict = F.coalesce("says", F.when(F.col("score") >= threshold, "allow").otherwise("block"))
    return scored.select("page_id", "url", "host", "path", "rule", "score", verdict.alias("verdict"))
