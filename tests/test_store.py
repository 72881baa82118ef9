"""Stored tables: what a change reads and rewrites."""

import datetime
import re
from decimal import Decimal
from pathlib import Path

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tallyfold import session
from tallyfold.plans import jobs
from tallyfold.sources.schemas import OPERATIONAL
from tallyfold.sources.warehouse import operational_store, stage

BUCKETS = 16


@pytest.fixture
def store(spark, tmp_path):
    made = operational_store(spark, str(tmp_path / "tables"), buckets=BUCKETS)
    fields = OPERATIONAL["cust_master"]
    people = [{"cust_id": k, "cust_code": f"C{k:03}", "cust_name": f"Name {k}", "tan_number": f"AAAA{k:05}A", "cust_status": "active"} for k in range(40)]
    made.append("cust_master", spark.createDataFrame([tuple(p.get(f.name) for f in fields) for p in people], fields))
    fields = OPERATIONAL["income_records"]
    money = Decimal("100.00")
    books = [
        {"income_id": k, "fin_year": f"202{k % 3}-2{k % 3 + 1}", "cust_id": k % 40, "doc_number": f"INV-{k}", "doc_date": datetime.date(2023, 5, 1), "taxable_amt": money}
        for k in range(240)
    ]
    made.append("income_records", spark.createDataFrame([tuple(b.get(f.name) for f in fields) for b in books], fields))
    return made


def files_of(store, name):
    return {str(p) for p in Path(store.path(name)).rglob("*.parquet")}


def test_touched_partitions_are_a_filter_of_the_scan(store):
    touched = store.partitions_of("income_records", store.read("income_records").filter("income_id in (1, 2)"))
    found = store.in_partitions("income_records", touched)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*cust_bucket", plan) and "Join" not in plan
    assert len(found.inputFiles()) <= len(files_of(store, "income_records"))
    read = {r[0] for r in found.select(F.input_file_name()).distinct().collect()}
    assert 0 < len(read) <= 2
    assert {1, 2} <= {r["income_id"] for r in found.collect()}


def test_an_upload_leaves_other_buckets_alone(spark, store, tmp_path):
    before = files_of(store, "income_records")
    old = rows(store.read("income_records").filter("cust_id <> 3"))
    path = tmp_path / "up.txt"
    path.write_text("code\tdoc_no\tdate\ttaxable\tgross\nC003\tINV-3\t2021-05-01\t700\t700\nC003\tNEW-1\t2020-05-01\t5\t5\n")
    jobs.ingest_books(store, [str(path)])
    changed = {re.search(r"cust_bucket=(\d+)", f)[1] for f in before ^ files_of(store, "income_records")}
    own = store.partitions_of("income_records", store.read("income_records").filter("cust_id = 3")).select("cust_bucket").distinct().collect()
    assert changed == {str(r[0]) for r in own}
    got = {r["doc_number"]: r["taxable_amt"] for r in store.read("income_records").filter("cust_id = 3").collect()}
    assert got["INV-3"] == Decimal("700.00") and got["NEW-1"] == Decimal("5.00")
    assert rows(store.read("income_records").filter("cust_id <> 3")) == old


def test_scratch_needs_a_shared_folder_off_one_machine(monkeypatch):
    class Conf:
        def get(self, key):
            return None

    class Context:
        master, applicationId = "yarn", "app-of-a-cluster"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError):
        session.scratch_root(Session())


def test_emptied_partitions_are_found_without_meeting_every_row(store):
    """The partitions a replacement empties go, and the join that finds them
    meets one row per partition and task, not every row."""
    seen = []
    whole = store.read("income_records").filter("fin_year != '2020-21'")
    touched = stage(store.partitions_of("income_records", store.read("income_records")), "touched")
    session_of = type(touched)
    real = session_of.join

    def watched(self, other, *a, **k):
        if "left_anti" in a:
            seen.append(other.count())
        return real(self, other, *a, **k)

    session_of.join = watched
    try:
        store.replace_partitions("income_records", whole, touched)
    finally:
        session_of.join = real
    assert store.read("income_records").select("fin_year").distinct().count() == 2
    assert store.read("income_records").count() == 160
    assert seen and max(seen) <= touched.count()
