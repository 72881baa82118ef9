"""Joins, keyed picks, merges and paging against brute force."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tallyfold.operators import joins, keyed, merge, paging


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_join_slices_hot_keys(spark, no_broadcast, how):
    rng = random.Random(3)
    facts = [(i, 1 if i % 3 == 0 else (None if i % 10 == 1 else rng.randrange(2, 900))) for i in range(3000)]
    fact = spark.createDataFrame(facts, "id long, k long")
    dim = spark.createDataFrame([(k, f"v{k}") for k in range(1, 600)], "k long, v string")
    counts = fact.groupBy("k").agg(F.count("*").alias("n"))
    sliced = joins.lookup_join(fact, dim, ["k"], ["id"], how, counts=counts)
    assert rows(sliced, "id", "k", "v") == rows(fact.join(dim, "k", how), "id", "k", "v")
    hot = joins.hot_keys(counts.dropna(subset=["k"]), ["k"]).collect()
    assert 1 in {r["k"] for r in hot} and len(hot) < joins.HOT_SHARE
    slices = {r["k"]: r["_slices"] for r in hot}
    assert slices[1] > 300


def test_lookup_join_leaves_small_lookups_to_broadcast(spark):
    fact = spark.range(1000).withColumn("k", F.col("id") % 7)
    dim = spark.createDataFrame([(k, k) for k in range(7)], "k long, v long")
    counts = fact.groupBy("k").agg(F.count("*").alias("n"))
    assert "BroadcastHashJoin" in plan_of(joins.lookup_join(fact, dim, ["k"], ["id"], counts=counts))


def test_key_any_join_equals_disjunction(spark):
    rng = random.Random(5)
    left = spark.createDataFrame(
        [(i, rng.choice([None, f"k{rng.randrange(40)}"]), rng.choice([None, f"k{rng.randrange(40)}"])) for i in range(300)],
        "id long, a string, b string",
    )
    right = spark.createDataFrame([(f"k{k}", None if k % 9 == 0 else k) for k in range(0, 40, 2)], "key string, v long")
    got = joins.key_any_join(left, right, (F.col("a"), F.col("b")), "key", "v")
    expected = left.join(right, (left.a == right.key) | (left.b == right.key), "left").select("id", "a", "b", "v")
    assert rows(got, "id", "a", "b", "v") == rows(expected)
    plan = plan_of(got)
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    once = joins.key_any_join(left, right, (F.col("a"), F.col("b")), "key", "v", dedupe=True)
    assert once.count() == 300


def test_first_and_last_per_key_limit_before_the_shuffle(spark):
    df = spark.createDataFrame([(i % 5, i, f"r{i}") for i in range(200)], "k long, pos long, v string")
    assert rows(keyed.first_per_key(df, ["k"], [F.col("pos")]), "v") == [("r0",), ("r1",), ("r2",), ("r3",), ("r4",)]
    last = keyed.last_per_key(df, ["k"], ["pos"])
    assert {r[0] for r in rows(last, "v")} == {"r195", "r196", "r197", "r198", "r199"}
    plan = plan_of(last)
    assert plan.count("WindowGroupLimit") >= 2 and "Partial" in plan


def test_assign_ids(spark):
    df = spark.range(5000).withColumn("name", F.concat(F.lit("n"), F.col("id")))
    once = keyed.assign_ids(df.repartition(3), ["name"], "new_id", 100, buckets=16)
    again = keyed.assign_ids(df.repartition(7), ["name"], "new_id", 100, buckets=16)
    assert rows(once) == rows(again)
    ids = [r[-1] for r in rows(once)]
    assert len(set(ids)) == 5000 and min(ids) > 100 and max(ids) < 100 + 2 * 5000


@pytest.mark.parametrize("levels", [(2, 4, 6), (1, 2, 20), (12, 24, 44)])
def test_carry_forward_equals_plain_fill(spark, levels):
    rng = random.Random(sum(levels))
    data = []
    for g in "abc":
        last = None
        for pos in sorted(rng.sample(range(400), 150)):
            value = f"{g}{pos}" if rng.random() < 0.1 else None
            last = value or last
            data.append((g, pos, value, last))
    df = spark.createDataFrame(data, "g string, pos long, v string, expected string").repartition(5)
    got = keyed.carry_forward(df, "g", "pos", "v", levels)
    assert got.count() == len(data)
    assert got.filter(~F.equal_null("v", "expected")).count() == 0


def test_carry_forward_across_pages(spark):
    pages = [(1 << 32) + 5, (2 << 32) + 1, (5000 << 32) + 3, (9000 << 32) + 1]
    df = spark.createDataFrame(
        [("f", pages[0], "h1"), ("f", pages[1], None), ("f", pages[2], "h2"), ("f", pages[3], None)],
        "g string, pos long, v string",
    )
    got = {r["pos"]: r["v"] for r in keyed.carry_forward(df, "g", "pos", "v").collect()}
    assert [got[p] for p in pages] == ["h1", "h1", "h2", "h2"]


TARGET = [(1, "a", 10), (2, "b", 20), (3, "c", None)]
SOURCE = [(2, "B", 21), (3, "C", 33), (4, "D", 40)]


@pytest.mark.parametrize(
    "insert,delete,expected",
    [
        (True, False, [(1, "a", 10), (2, "b", 21), (3, "c", 33), (4, "D", 40)]),
        (False, False, [(1, "a", 10), (2, "b", 21), (3, "c", 33)]),
        (True, True, [(2, "b", 21), (3, "c", 33), (4, "D", 40)]),
        (False, True, [(2, "b", 21), (3, "c", 33)]),
    ],
)
def test_merge_df(spark, insert, delete, expected):
    target = spark.createDataFrame(TARGET, "id long, name string, n long")
    source = spark.createDataFrame(SOURCE, "id long, name string, n long")
    assert rows(merge.merge_df(target, source, ["id"], ["n"], insert, delete)) == expected


def test_merge_takes_null_from_the_source(spark):
    target = spark.createDataFrame([(1, "x")], "id long, note string")
    source = spark.createDataFrame([(1, None)], "id long, note string")
    assert rows(merge.merge_df(target, source, ["id"], ["note"])) == [(1, None)]


def test_changed_rows(spark):
    new = spark.createDataFrame([(1, "1.001", "a"), (2, "1.002", "a"), (3, "1.000", "b"), (4, "1.000", None), (5, "9", "x")], "id long, n string, s string")
    old = spark.createDataFrame([(1, "1.000", "a"), (2, "1.000", "a"), (3, "1.000", "a"), (4, "1.000", "")], "id long, n string, s string")
    new, old = (df.withColumn("n", F.col("n").cast("decimal(15,3)")) for df in (new, old))
    for block in (None, {"_b": F.floor(F.col("id") / 2)}):
        got = merge.changed_rows(new, old, ["id"], ["n", "s"], {"n": "0.001"}, block)
        assert [r[0] for r in rows(got)] == [2, 3]
        assert got.columns == ["id", "n", "s"]
    open_blocks = merge.differing_blocks(
        new.withColumn("b", F.col("id")), old.withColumn("b", F.col("id")), ["b"], ["id"], ["n", "s"], {"n": "0.001"}
    )
    assert [r[0] for r in rows(open_blocks)] == [1, 2, 3, 5]


def test_pages(spark):
    df = spark.range(95)
    assert [r[0] for r in paging.page_of(df, [F.col("id")], page=2, per_page=40).collect()] == list(range(40, 80))
    assert paging.page_of(df, [F.col("id")], page=0, per_page=9999).count() == 95
    assert paging.clamp(0, 9999) == (1, 500) and paging.clamp(3, 0) == (3, 1)
    assert tuple(paging.page_total(df, 1, 40).first()) == (95, 1, 40, 3)
    assert paging.page_total(df.limit(0), 1, 40).first()["pages"] == 1
