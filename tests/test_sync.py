"""Warehouse: incremental sync equals a full recompute, marks, snapshots, catalog."""

import datetime
from decimal import Decimal

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tallyfold.plans import sync
from tallyfold.plans.summary import tds_summary_fy
from tallyfold.sources import warehouse
from tallyfold.sources.schemas import OPERATIONAL
from tallyfold.streaming.jobs import stream_append_sync

TABLES = ["cust_master", "income_records", "form26as_records", "audit_logs"]


@pytest.fixture(scope="module")
def tables(domain):
    """Stored copies with ids from 1, as the operational tables have."""
    return {t: warehouse.stage(domain.table(t)) for t in TABLES}


@pytest.fixture
def store(spark, tmp_path):
    return warehouse.warehouse_store(spark, str(tmp_path / "wh"))


def full(tables):
    return {
        "income_records": sync.books_with_customer(tables["income_records"], tables["cust_master"]),
        "form26as_records": sync.statement_with_customer(tables["form26as_records"], tables["cust_master"]),
        "cust_master": sync.customers_for_warehouse(tables["cust_master"]),
        "audit_logs": tables["audit_logs"],
        "tds_summary": tds_summary_fy(tables["cust_master"], tables["income_records"], tables["form26as_records"]),
    }


def same(store, tables):
    for name, frame in full(tables).items():
        stored = store.read(name)
        expected = frame.select(*stored.columns)
        assert stored.count() == expected.count(), name
        assert stored.exceptAll(expected).count() == 0, name


def test_incremental_equals_full(store, tables):
    first = {
        **tables,
        "income_records": tables["income_records"].filter("income_id < 900").withColumn(
            "tds_rate", F.when(F.col("income_id") % 2 == 0, F.col("tds_rate")).otherwise(F.lit(1).cast("decimal(5,2)"))
        ),
        "cust_master": tables["cust_master"].withColumn(
            "gstin_number", F.when(F.col("cust_id") % 3 != 0, F.col("gstin_number"))
        ),
        "audit_logs": tables["audit_logs"].filter("log_id < 500"),
        "form26as_records": tables["form26as_records"].filter("record_id < 700"),
    }
    sync.sync_all(store, first)
    done = {r["table_name"]: r for r in sync.sync_all(store, tables).collect()}
    same(store, tables)
    assert done["income_records"]["merged"] > 0 and done["cust_master"]["merged"] > 0
    again = sync.sync_all(store, tables)
    assert again.agg(F.sum("appended") + F.sum("merged")).first()[0] == 0
    same(store, tables)


def test_append_is_not_repeated_when_the_mark_was_lost(store, tables):
    sync.sync_audit(store, tables["audit_logs"])
    count = store.read("audit_logs").count()
    store.replace_partitions("sync_marks", store.read("sync_marks").withColumn("last_id", F.lit(-1).cast("long")))
    sync.sync_audit(store, tables["audit_logs"])
    assert store.read("audit_logs").count() == count


def test_marks_never_decrease(store):
    assert sync.get_mark(store, "t") == -1
    sync.set_mark(store, "t", 10, 1)
    sync.set_mark(store, "u", 3, 1)
    sync.set_mark(store, "t", 4, 2)
    assert (sync.get_mark(store, "t"), sync.get_mark(store, "u")) == (10, 3)
    assert store.read("sync_marks").count() == 2


def test_deleted_customers_go_only_on_request(store, tables):
    sync.sync_customers(store, tables["cust_master"])
    fewer = tables["cust_master"].filter("cust_id <> 5")
    sync.sync_customers(store, fewer)
    assert store.read("cust_master").filter("cust_id = 5").count() == 1
    sync.sync_customers(store, fewer, delete_missing=True)
    assert store.read("cust_master").count() == fewer.count()


def test_superseded_invoices_leave_the_warehouse(store, tables):
    books, people = tables["income_records"].filter("income_id < 300"), tables["cust_master"]
    sync.sync_books(store, books, people)
    # A re-upload replaces invoices by new ones with new ids.
    again = books.filter("income_id % 7 <> 0").unionByName(
        books.filter("income_id % 7 = 0").withColumn("income_id", F.col("income_id") + 10_000_000)
    )
    sync.sync_books(store, again, people, delete_missing=True)
    assert rows(store.read("income_records"), "income_id", "doc_number") == rows(sync.books_with_customer(again, people), "income_id", "doc_number")


def test_legacy_mode_ignores_changes_of_other_columns(store, tables):
    args = (tables["cust_master"], tables["income_records"], tables["form26as_records"])
    sync.sync_summary(store, *args)
    credit = tables["form26as_records"].withColumn("tds_credited", (F.col("tds_credited") + 1).cast("decimal(15,2)"))
    assert sync.sync_summary(store, *args[:2], credit, legacy=True)["merged"] == 0
    assert sync.sync_summary(store, *args[:2], credit)["merged"] > 0


def test_full_merge_updates_and_inserts(store, tables):
    rows_now = sync.books_with_customer(tables["income_records"], tables["cust_master"])
    store.append("income_records", rows_now.filter("income_id < 500").withColumn("upload_ref", F.lit("OLD")))
    sync.merge_all_books(store, rows_now)
    stored = store.read("income_records")
    assert stored.exceptAll(rows_now.select(*stored.columns)).count() == 0 and stored.count() == rows_now.count()


def test_scope_push_by_customer(store, tables):
    year = "1997-98"
    sync.sync_scope_fy(store, tables, year)
    changed = {**tables, "income_records": tables["income_records"].withColumn("upload_ref", F.lit("NEW"))}
    some = [r[0] for r in tables["income_records"].filter(F.col("fin_year") == year).select("cust_id").distinct().limit(3).collect()]
    sync.sync_scope_fy(store, changed, "FY " + year, some)
    new = store.read("income_records").filter("upload_ref = 'NEW'")
    assert {r[0] for r in new.select("cust_id").distinct().collect()} == set(some)
    assert store.read("income_records").count() == tables["income_records"].filter(F.col("fin_year") == year).count()


def test_snapshots_keep_days_apart(spark, tables, tmp_path):
    root = str(tmp_path / "snap")
    for day in ("2024-01-01", "2024-01-02", "2024-01-02"):
        sync.snapshot_all(spark, root, tables, day)
    n = tables["cust_master"].count()
    got = dict(rows(spark.read.parquet(f"{root}/cust_master").groupBy(F.col("snapshot_date").cast("string")).count()))
    assert got == {"2024-01-01": n, "2024-01-02": n}
    types = dict(spark.read.parquet(f"{root}/income_records").dtypes)
    assert types["gross_amt"] == "double" and types["doc_date"] == "string"


def test_merge_reads_touched_partitions_only(spark, store, tables):
    store.append("income_records", sync.books_with_customer(tables["income_records"], tables["cust_master"]))
    touched = spark.createDataFrame([("1997-98", 0)], "fin_year string, cust_bucket long")
    frame = store.in_partitions("income_records", touched)
    assert {r[0] for r in frame.select("fin_year").distinct().collect()} == {"1997-98"}
    before = {p.name: sorted(f.name for f in p.rglob("*.parquet")) for p in _partitions(store)}
    delta = store.read("income_records").filter("fin_year = '1997-98'").limit(3).withColumn("tds_section", F.lit("X"))
    store.merge("income_records", warehouse.stage(delta), ["income_id", "fin_year"], ["tds_section"], insert=False)
    after = {p.name: sorted(f.name for f in p.rglob("*.parquet")) for p in _partitions(store)}
    assert [p for p in before if before[p] != after[p]] == ["fin_year=1997-98"]
    assert store.read("income_records").filter("tds_section = 'X'").count() == 3


def _partitions(store):
    from pathlib import Path

    return sorted(p for p in Path(store.path("income_records")).iterdir() if p.is_dir() and "=" in p.name)


def test_customer_buckets_narrow_a_rewrite(spark, tables, tmp_path):
    store = warehouse.warehouse_store(spark, str(tmp_path / "buckets"), buckets=4)
    now = sync.books_with_customer(tables["income_records"], tables["cust_master"])
    store.append("income_records", now)
    files = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet") if "income_records" in str(p)}
    one = store.read("income_records").filter("fin_year = '1997-98'").limit(1).withColumn("tds_section", F.lit("X"))
    store.merge("income_records", warehouse.stage(one), ["income_id", "fin_year"], ["tds_section"], insert=False)
    left = {p for p in tmp_path.rglob("*.parquet") if "income_records" in str(p)} & set(files)
    gone = {p.parent for p in files if p not in left}
    assert len(gone) == 1
    assert store.read("income_records").count() == now.count()
    sync.sync_scope_fy(store, {**tables, "income_records": tables["income_records"].filter("cust_id < 20")}, "1997-98")
    year = store.read("income_records").filter("fin_year = '1997-98'")
    assert year.count() == now.filter("fin_year = '1997-98' and cust_id < 20").count()


def test_declared_tables_read_what_was_stored(spark, store, tables):
    sync.sync_customers(store, tables["cust_master"])
    names = warehouse.declare_warehouse(spark, "wh_test", store.root)
    warehouse.declare_warehouse(spark, "wh_test", store.root)
    try:
        assert {t.name for t in spark.catalog.listTables("wh_test")} == set(names)
        spark.sql("msck repair table wh_test.cust_master")
        assert spark.table("wh_test.cust_master").count() == tables["cust_master"].count()
    finally:
        spark.sql("drop database wh_test cascade")


def test_export_csv(spark, tmp_path):
    df = spark.createDataFrame([('say "hi", all', None, 1)], "`Customer Name` string, note string, n int")
    warehouse.export_csv(df, str(tmp_path / "out"))
    files = [p.read_text() for p in sorted((tmp_path / "out").glob("part-*.csv"))]
    header = "Customer Name,note,n\n"
    assert all(text.startswith(header) for text in files)
    assert "".join(text[len(header):] for text in files) == '"say ""hi"", all",,1\n'


def test_stream_append_copies_each_file_once(spark, tables, tmp_path):
    source, sink, mark = (str(tmp_path / n) for n in ("src", "out", "cp"))
    logs = tables["audit_logs"]
    logs.filter("log_id < 300").write.parquet(source)
    stream_append_sync(spark, source, logs.schema, sink, mark)
    logs.filter("log_id >= 300").write.mode("append").parquet(source)
    for _ in range(2):
        stream_append_sync(spark, source, logs.schema, sink, mark)
    assert spark.read.parquet(sink).count() == logs.count()


@pytest.fixture
def shared_tan(spark):
    """Statement rows of a TAN that four customers carry, of one that a single
    customer carries, of an unknown and of no TAN; a year is null or blank."""
    people = spark.createDataFrame(
        [(k, f"C{k}", f"Name {k}", "AAAA00001A" if k < 4 else f"AAAA0000{k}B" if k < 6 else None) for k in range(8)],
        "cust_id long, cust_code string, cust_name string, tan_number string",
    )
    tans = [" aaaa00001a", "AAAA00004B", "ZZZZ00000Z", None]
    years = ["2021-22", "2022-23", None, "", "2023-24"]
    statement = spark.createDataFrame(
        [(k, years[k % 5], tans[k % 4], f"Deductor {k}", "194C", datetime.date(2022, 5, 1), Decimal(k), Decimal(k) / 10) for k in range(40)],
        OPERATIONAL["form26as_records"],
    )
    return statement, people


def test_statement_rows_are_repeated_in_the_write_only(spark, store, shared_tan, monkeypatch):
    """What many customers share a TAN multiplies is neither staged, shuffled nor sorted."""
    statement, people = shared_tan
    expected = sync.statement_with_customer(statement, people)
    n, staged, written = statement.count(), [], []

    def counted(frame, name="stage"):
        staged.append(frame.count())
        return warehouse.stage(frame, name)

    real = warehouse.Store._write

    def watched(self, name, shaped, mode, *args, **more):
        if name == "form26as_records":
            written.append(shaped._jdf.queryExecution().optimizedPlan().toString())
        return real(self, name, shaped, mode, *args, **more)

    monkeypatch.setattr(sync, "stage", counted)
    monkeypatch.setattr(warehouse.Store, "_write", watched)
    for added in (expected.count(), 0):
        assert sync.sync_statement(store, statement, people) == {"appended": added, "merged": 0}
    assert expected.count() == 70 and max(staged) == n
    assert len(written) == 1 and written[0].index("Join LeftOuter") < written[0].index("Relation")
    blank_is_null = expected.withColumn("fin_year", F.nullif("fin_year", F.lit("")))
    assert rows(store.read("form26as_records")) == rows(blank_is_null)
    assert rows(store.read("sync_marks"), "table_name", "last_id", "row_count") == [("form26as_records", 39, 70)]


def test_rows_by_year_are_stored_without_another_sort(spark, tables):
    frame = sync.statement_by_year(tables["form26as_records"], tables["cust_master"])
    year = warehouse.folder_value("fin_year")
    plan = frame.withColumn("fin_year", year).sortWithinPartitions("fin_year")._jdf.queryExecution().executedPlan().toString()
    # Both sides of the join are sorted; nothing sorts what comes out of it.
    assert "SortMergeJoin" in plan and "Sort [" not in plan[: plan.index("SortMergeJoin")]


def test_snapshot_converts_rows_before_they_are_repeated(spark, shared_tan, tables):
    statement, people = shared_tan
    whole = people.withColumns({c: F.lit(None).cast("string") for c in ("pan_number", "gstin_number", "cust_status")})
    given = {**tables, "form26as_records": statement, "cust_master": whole}
    frame = sync.snapshot_frames(given)["form26as_records"]
    assert rows(frame) == rows(warehouse.to_warehouse_types(sync.statement_with_customer(statement, whole)))
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("date_format") and "as double" not in plan[: plan.index("Join")]


def test_a_repeated_day_is_replaced_and_others_stay(spark, tables, tmp_path):
    root = str(tmp_path / "snap")
    for day, some in (("2024-01-01", "true"), ("a/b", "true"), ("2024-01-01", "cust_id < 7"), ("a/b", "false")):
        sync.snapshot_all(spark, root, {**tables, "cust_master": tables["cust_master"].filter(some)}, day)
    stored = spark.read.parquet(f"{root}/cust_master")
    assert rows(stored.groupBy(F.col("snapshot_date").cast("string")).count()) == [("2024-01-01", tables["cust_master"].filter("cust_id < 7").count())]
    assert sorted(p.name for p in (tmp_path / "snap" / "cust_master").iterdir()) == ["snapshot_date=2024-01-01", "snapshot_date=a%2Fb"]
