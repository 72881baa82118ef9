"""Upload jobs killed after any write end like an undisturbed run."""

import datetime
from decimal import Decimal

import pytest
from conftest import rows

from tallyfold.plans import jobs, journal
from tallyfold.sources.schemas import OPERATIONAL
from tallyfold.sources.warehouse import operational_store

BOOK_STEPS = ["income_records", "unreferenced_entries", "reassess", "audit_logs", "file_uploads_log"]
UPLOAD = "code\tdoc_no\tdate\ttaxable\tgross\nC003\tINV-3\t2021-05-01\t700\t700\nC003\tNEW-1\t2020-05-01\t5\t5\nC999\tLOST-1\t2020-06-01\t9\t9\n"


class Crash(Exception):
    pass


def filled(spark, root):
    made = operational_store(spark, root, buckets=4)
    fields = OPERATIONAL["cust_master"]
    people = [{"cust_id": k, "cust_code": f"C{k:03}", "cust_name": f"Name {k}", "tan_number": f"AAAA{k:05}A", "cust_status": "active"} for k in range(20)]
    made.append("cust_master", spark.createDataFrame([tuple(p.get(f.name) for f in fields) for p in people], fields))
    fields = OPERATIONAL["income_records"]
    books = [
        {"income_id": k, "fin_year": f"202{k % 3}-2{k % 3 + 1}", "cust_id": k % 20, "doc_number": f"INV-{k}",
         "doc_date": datetime.date(2023, 5, 1), "taxable_amt": Decimal("100.00")}
        for k in range(60)
    ]
    made.append("income_records", spark.createDataFrame([tuple(b.get(f.name) for f in fields) for b in books], fields))
    return made


def state(store):
    """Every table an upload writes, without what differs between two runs by nature
    (times, references, and ids drawn from the path of the upload's file)."""
    out = {}
    for name in ("income_records", "unreferenced_entries", "audit_logs", "file_uploads_log"):
        drop = [f.name for f in OPERATIONAL[name].fields if f.dataType.typeName() == "timestamp" or f.name in ("upload_ref", "file_name", "unref_id")]
        out[name] = rows(store.read(name).drop(*drop))
    return out


@pytest.fixture(scope="module")
def undisturbed(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("undisturbed")
    store = filled(spark, str(root / "tables"))
    path = root / "up.txt"
    path.write_text(UPLOAD)
    jobs.ingest_books(store, [str(path)])
    return state(store)


@pytest.mark.parametrize("where", BOOK_STEPS)
def test_books_job_killed_after_a_write_ends_like_an_undisturbed_run(spark, tmp_path, monkeypatch, undisturbed, where):
    store = filled(spark, str(tmp_path / "tables"))
    path = tmp_path / "up.txt"
    path.write_text(UPLOAD)

    def fault(done):
        if done == where:
            raise Crash(done)

    monkeypatch.setattr(journal, "FAULT", fault)
    with pytest.raises(Crash):
        jobs.ingest_books(store, [str(path)])
    monkeypatch.setattr(journal, "FAULT", None)
    # The next job rolls the dead one forward; the same upload then finds its file logged.
    counts = jobs.ingest_books(store, [str(path)])
    assert counts.count() == 0
    got = state(store)
    assert got == undisturbed
    assert len(got["audit_logs"]) == len(undisturbed["audit_logs"]) and len(got["file_uploads_log"]) == 1
    assert journal.Journal(store).open_intents() == []


def test_recovery_runs_at_the_start_of_any_upload_job(spark, tmp_path, monkeypatch, undisturbed):
    store = filled(spark, str(tmp_path / "tables"))
    path = tmp_path / "up.txt"
    path.write_text(UPLOAD)
    monkeypatch.setattr(journal, "FAULT", lambda done: (_ for _ in ()).throw(Crash(done)) if done == "reassess" else None)
    with pytest.raises(Crash):
        jobs.ingest_books(store, [str(path)])
    monkeypatch.setattr(journal, "FAULT", None)
    assert len(journal.Journal(store).open_intents()) == 1
    # Another module's job finishes it first.
    jobs.ingest_statement_text(store, [])
    assert state(store) == undisturbed
