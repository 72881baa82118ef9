"""Upload files end to end, and their edge rows."""

from datetime import date
from decimal import Decimal as D

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tallyfold.plans import ingest, jobs, matching, overrides
from tallyfold.sources import landing, statement_files, warehouse
from tallyfold.sources.schemas import CUSTOMERS, OVERRIDES, RATES, STATEMENT
from tallyfold.streaming.jobs import stream_ingest_uploads

PEOPLE = [
    (1, "C001", "Acme Ltd", "ABCDE1234F", None, "AAAA11111A", "active", None),
    (2, "C002", "Beta Ltd", "ABCDE2222F", None, "AAAA22222A", "active", None),
    (3, "C003", "Beta Ltd", "ABCDE3333F", None, "AAAA33333A", "inactive", None),
]
RATE = (1, "194J", None, "d", "ALL", True, D("10.000"), D("0"), D("0"), 30000, None, None, date(2024, 4, 1), True, None)


@pytest.fixture
def store(spark, tmp_path):
    s = warehouse.operational_store(spark, str(tmp_path / "tables"))
    s.append("cust_master", spark.createDataFrame(PEOPLE, CUSTOMERS))
    spark.createDataFrame([RATE], RATES).write.parquet(s.path("tds_codes_master"))
    return s


TAB_FILE = (
    "﻿Customer Code\tCustomer Name\tPAN\tTAN\tDocument No\tDocument Date\tDocument Type\tTaxable Amount\tTax Amount\tGross Amount\tTDS Section\t\r\n"
    "C001\t\t\t\tINV-1\t2024-04-15\tinv\t₹1,00,000.00\t18,000\t\t194j\textra\r\n"
    "\t\t\t\t\t\t\t\t\t\t\t\r\n"
    "\tacme ltd\t\t\tINV-2\t15/03/2024\tcredit note\t0\t18\t118\t—\r\n"
    "C001\t\t\t\tINV-1\t16-04-2024\tsales\t200\t0\t\tNONE\r\n"
    "\t\t\tZZZZ99999Z\tINV-9\t2024-05-01\t\t5\t0\t5\t\r\n"
    "\tNobody\tZZZZZ9999Z\t\tINV-8\t2024-05-01\t\t5\t0\t5\t\r\n"
    "\tNobody\t\t\tINV-7\t01-May-2024\t\t5\t0\t5\t\r\n"
    "C002\t\t\t\t\t2024-05-01\t\t5\t0\t5\t\r\n"
    "C002\t\t\t\tINV-6\tsoon\t\t5\t0\t5\t\r\n"
)
COMMA_FILE = 'cust_code,doc_no,date,amount,gross\nC002,"INV,5",2024/06/01,1,50\n'


def write(folder, name, text):
    folder.mkdir(exist_ok=True)
    path = folder / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_books_upload(spark, store, tmp_path):
    paths = [write(tmp_path / "in", "a.txt", TAB_FILE), write(tmp_path / "in", "b.txt", COMMA_FILE)]
    counts = {r["file_id"].rsplit("/", 1)[-1]: r.asDict() for r in jobs.ingest_books(store, paths).collect()}
    assert counts["a.txt"] == {
        "file_id": f"file:{paths[0]}", "inserted": 2, "refreshed": 1, "unmatched": 3, "rejected": 2, "skipped": 3, "rows_imported": 5,
    }
    assert counts["b.txt"]["inserted"] == 1
    books = {r["doc_number"]: r for r in store.read("income_records").collect()}
    assert set(books) == {"INV-1", "INV-2", "INV,5"}
    assert books["INV-1"]["taxable_amt"] == D("200.00") and books["INV-1"]["tds_section"] == "—"
    assert books["INV-2"]["doc_type"] == "credit_note" and books["INV-2"]["taxable_amt"] == D("100.00")
    assert (books["INV-1"]["fin_year"], books["INV-2"]["fin_year"]) == ("2024-25", "2023-24")
    assert books["INV,5"]["entry_source"] == "sales_register" and books["INV,5"]["gross_amt"] == D("50.00")
    open_rows = {r["doc_number"]: r for r in store.read("unreferenced_entries").collect()}
    assert {k: v["unref_reason"] for k, v in open_rows.items()} == {"INV-9": "no_tan", "INV-8": "no_pan", "INV-7": "no_customer"}
    assert open_rows["INV-9"]["raw_identifier"] == "ZZZZ99999Z"
    log = {r["file_name"]: r for r in store.read("file_uploads_log").collect()}
    assert log["a.txt"]["rows_imported"] == 5 and log["a.txt"]["fin_year"] == "2024-25" and log["a.txt"]["quarter"] == "Q1"
    assert {r["upload_id"] for r in open_rows.values()} == {log["a.txt"]["upload_id"]}
    text = {r["description"] for r in store.read("audit_logs").collect()}
    assert "Books upload FY 2024-25: 2 inserted, 3 unmatched, 3 skipped." in text

    before = rows(store.read("income_records"))
    assert jobs.ingest_books(store, paths).count() == 0
    assert rows(store.read("income_records")) == before and store.read("file_uploads_log").count() == 2

    moved = write(tmp_path / "in", "c.txt", "code\tdoc_no\tdate\ttaxable\nC001\tINV-2\t2025-06-01\t900\n")
    assert jobs.ingest_books(store, [moved]).first()["refreshed"] == 1
    books = {r["doc_number"]: r for r in store.read("income_records").collect()}
    assert len(books) == 3 and books["INV-2"]["fin_year"] == "2025-26"
    assert not list((tmp_path / "tables" / "income_records" / "fin_year=2023-24").rglob("*.parquet"))


def test_undated_ledger_fails_alone(store, tmp_path):
    bad = write(tmp_path / "in", "x.txt", "code\tdoc_no\tdate\nC001\tINV-1\tnever\n")
    good = write(tmp_path / "in", "y.txt", "code\tdoc_no\tdate\ttaxable\tgross\nC001\tINV-2\t2024-05-01\t7\t7\n")
    jobs.ingest_books(store, [bad, good])
    assert [r["doc_number"] for r in store.read("income_records").collect()] == ["INV-2"]
    log = {r["file_name"]: (r["upload_status"], r["rows_imported"]) for r in store.read("file_uploads_log").collect()}
    assert log == {"x.txt": ("failed", 0), "y.txt": ("success", 1)}
    # A failed file may be tried again; one that is stored may not.
    assert [r["file_id"] for r in jobs.fresh_files(store, [bad, good]).collect()] == [f"file:{bad}"]


def test_files_of_one_name_are_two_files(store, tmp_path):
    head = "code\tdoc_no\tdate\ttaxable\tgross\n"
    paths = [
        write(tmp_path / "a", "x.txt", head + "C001\tINV-1\t2024-05-01\t7\t7\nnobody\tU-1\t2024-05-01\t1\t1\n"),
        write(tmp_path / "b", "x.txt", head + "C002\tINV-2\t2023-05-01\t8\t8\nnobody\tU-2\t2023-05-01\t1\t1\n"),
    ]
    jobs.ingest_books(store, paths)
    assert sorted(r["doc_number"] for r in store.read("income_records").collect()) == ["INV-1", "INV-2"]
    entries = store.read("unreferenced_entries").collect()
    assert sorted(r["doc_number"] for r in entries) == ["U-1", "U-2"] and len({r["unref_id"] for r in entries}) == 2
    log = store.read("file_uploads_log").collect()
    assert [(r["file_name"], r["rows_imported"]) for r in log] == [("x.txt", 2)] * 2
    assert {r["fin_year"] for r in log} == {"2024-25", "2023-24"}


def test_a_statement_that_died_before_the_reassessment(store, tmp_path, monkeypatch):
    books = write(tmp_path / "in", "books.txt", "code\tdoc_no\tdate\ttaxable\tgross\nC001\tINV-1\t2024-04-15\t40000\t40000\n")
    jobs.ingest_books(store, [books])
    path = write(tmp_path / "in", "s.txt", STATEMENT_FILE)

    def die(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(jobs, "reassess_customers", die)
        with pytest.raises(RuntimeError):
            jobs.ingest_statement_text(store, [path])
    jobs.ingest_statement_text(store, [path])
    invoice = store.read("income_records").first()
    assert (invoice["tds_section"], invoice["tds_deductible"]) == ("194J", D("4000.00"))
    assert store.read("form26as_records").count() == 3


STATEMENT_FILE = (
    "customer_name,doc,date,type,taxable,tds,section\n\n"
    "Acme Ltd\tD1\t15-04-2024\tinvoice\t1000\t100.00\t194J\n"
    "Acme Ltd,D2,2024-05-01,invoice,2000,200.00,194j\n"
    "Acme Ltd,D2,2024-05-01,invoice,2500,200.00,194J\n"
    "beta ltd  D3  2024-06-01  invoice  500  50\n"
    "Nobody   D4   2024-06-01   invoice   500   50   206C\n"
    "only  four  tokens  here  five\n"
)


def test_statement_upload(store, tmp_path):
    books = write(tmp_path / "in", "books.txt", "code\tdoc_no\tdate\ttaxable\tgross\nC001\tINV-1\t2024-04-15\t40000\t40000\n")
    jobs.ingest_books(store, [books])
    path = write(tmp_path / "in", "s.txt", STATEMENT_FILE)
    row = jobs.ingest_statement_text(store, [path]).first()
    assert (row["parsed"], row["inserted"], row["skipped"]) == (5, 3, 2)
    got = rows(store.read("form26as_records"), "tan_of_deductor", "section_code", "tds_credited", "booking_amt")
    assert got == [
        ("AAAA11111A", "194J", D("100.00"), D("1000.00")), ("AAAA11111A", "194J", D("200.00"), D("2000.00")),
        ("—", "206C", D("50.00"), D("500.00")),
    ]
    # The unsectioned invoice was claimed by the statement's section and taxed.
    invoice = store.read("income_records").first()
    assert (invoice["tds_section"], invoice["tds_deductible"]) == ("194J", D("4000.00"))
    assert jobs.ingest_statement_text(store, [path]).count() == 0
    again = write(tmp_path / "in", "s2.txt", STATEMENT_FILE + "\n")
    assert jobs.ingest_statement_text(store, [again]).first()["inserted"] == 0
    assert store.read("form26as_records").count() == 3


PAGES = [
    ("f", 1, 1, "Form  Annual   Tax Statement"),
    ("f", 1, 2, "Name of Assessee   Example Holdings"),
    ("f", 1, 3, "1 194J 05-Apr-2024 F 06-Apr-2024 - 10.00 1.00"),
    ("f", 1, 4, "Name of Deductor : First Payer  PWYC7918 3E"),
    ("f", 1, 5, "1 194J 15-Apr-2024 F 16-Apr-2024 - 1,000.00 12.00 100.00"),
    ("f", 1, 6, "2 194BA 15-Apr-2024 F 16-Apr-2024 - 1,000.00 100.00"),
    ("f", 1, 7, "3 194J 15-Apr-2024 F 16-Apr-2024 - -1,000.00 100.00"),
    ("f", 1, 8, "4 194J 15-Apr-2024 F 16-Apr-2024 - 100.00"),
    ("f", 2, 1, "5 206C 01-may-2024 F 16-Apr-2024 - 2,000.00 20.00"),
    ("f", 2, 2, "Second Payer ABCD12345E"),
    ("f", 2, 3, "6 194C 02-May-2024 F 16-Apr-2024 - 3,000.00 30.00"),
    ("g", 1, 1, "customer_name  inv-no"),
    ("g", 1, 2, "Acme Ltd  INV-1  15/04/2024  invoice  100  10"),
    ("g", 1, 3, "Acme Ltd  INV-2  15/04/2024  invoice  ten  10"),
    ("g", 2, 1, "Acme Ltd  DOC-3  15/04/2024  invoice  100  10"),
]


def test_statement_pages(spark):
    lines = spark.createDataFrame(PAGES, "file_id string, page_no int, line_no int, text string")
    wanted = ["file_id", "customer_name", "deductor_name", "deductor_tan", "section_code", "transaction_date", "taxable_amount", "tds_deductible", "tax_category"]
    got = rows(statement_files.parse_statement_pages(lines, "UPL-1"), *wanted)
    who = "Example Holdings"
    assert got == [
        ("f", who, "First Payer", "PWYC79183E", "194J", date(2024, 4, 15), D("1000.00"), D("100.00"), "TDS"),
        ("f", who, "First Payer", "PWYC79183E", "206C", date(2024, 5, 1), D("2000.00"), D("20.00"), "TCS"),
        ("f", who, "Second Payer", "ABCD12345E", "194C", date(2024, 5, 2), D("3000.00"), D("30.00"), "TDS"),
        ("f", who, "Unknown Deductor", "—", "194J", date(2024, 4, 5), D("10.00"), D("1.00"), "TDS"),
        ("g", "Acme Ltd", "Acme Ltd", "—", "", date(2024, 4, 15), D("100.00"), D("10.00"), "TDS"),
    ]
    wide = statement_files.parse_statement_pages(lines, "UPL-1", extended=True).filter("file_id = 'f'")
    assert {r["section_code"] for r in wide.collect()} == {"194J", "194BA", "206C", "194C"} and wide.count() == 6


def test_matching_order(spark):
    people = spark.createDataFrame(PEOPLE, CUSTOMERS)
    given = [
        (1, "c001 ", "AAAA22222A", "", ""), (2, "", "aaaa22222a", "ABCDE1234F", ""), (3, "", "", "abcde3333f", "Acme Ltd"),
        (4, "", "", "", " beta LTD "), (5, "X", "X", "X", "X"), (6, "", "", "", ""), (7, None, None, None, None),
    ]
    df = spark.createDataFrame(given, "n int, code string, tan string, pan string, name string")
    got = dict(rows(matching.match_customers(df, people), "n", "cust_id"))
    assert got == {1: 1, 2: 2, 3: 3, 4: 3, 5: None, 6: None, 7: None}


def sheet(spark, data, *names):
    return spark.createDataFrame(data, ", ".join(["file_id string", "line_no long"] + [f"`{n}` string" for n in names]))


def test_customer_upload(spark, store):
    names = ["Customer Code", "Customer Name", "PAN Number", "GSTIN", "TAN Number", "Status", "Contact"]
    data = [
        ("m.xlsx", 2, "", "Acme New", "abcde1234f", "g1", "AAAA99999A", "INACTIVE", "c"),
        ("m.xlsx", 3, "C9", "Taken", "ABCDE7777F", "", "AAAA22222A", "", ""),
        ("m.xlsx", 4, "C002", "New One", "ABCDE8888F", "", "BBBB11111B", "odd", ""),
        ("m.xlsx", 5, "", "Claims", "ABCDE9999F", "", "BBBB11111B", "", ""),
        ("m.xlsx", 6, "", "No code", "ABCDE6666F", "", "BBBB22222B", "", ""),
        ("m.xlsx", 7, "Z", "No code 2", "ABCDE6666F", "", "BBBB33333B", "", ""),
        ("m.xlsx", 8, "", "", "ABCDE6666F", "", "BBBB33333B", "", ""),
        ("m.xlsx", 9, "", "Bad", "ABC", "", "BBBB33333B", "", ""),
        ("m.xlsx", 10, "", "Bad", "ABCDE5555F", "", "B", "", ""),
        ("m.xlsx", 11, "", "", "", "", "", "", ""),
    ]
    files = spark.createDataFrame([("m.xlsx", "/m.xlsx", "h1", 2048)], "file_id string, path string, file_hash string, size_bytes long")
    row = jobs.ingest_customers(store, sheet(spark, data, *names), files).first().asDict()
    assert row == {"file_id": "m.xlsx", "inserted": 2, "updated": 2, "skipped": 5, "rows_imported": 4}
    got = {r["pan_number"]: r for r in store.read("cust_master").collect()}
    assert len(got) == 5
    acme = got["ABCDE1234F"]
    assert (acme["cust_id"], acme["cust_code"], acme["cust_name"], acme["tan_number"], acme["cust_status"]) == (1, "C001", "Acme New", "AAAA99999A", "inactive")
    assert got["ABCDE8888F"]["cust_code"] == "C002-4" and got["ABCDE8888F"]["cust_status"] == "active"
    assert got["ABCDE6666F"]["cust_code"] == "CUST0006" and got["ABCDE6666F"]["cust_name"] == "No code 2"
    assert len({r["cust_id"] for r in got.values()}) == 5
    assert store.read("file_uploads_log").first()["file_size_kb"] == D("2.00")
    assert jobs.ingest_customers(store, sheet(spark, data, *names), files).count() == 0


def test_overrides(spark, store):
    changes = spark.createDataFrame(
        [(1, "FY 2023-24", "reserved", "a", 1), (1, "2023-24", "open", " ", 2), (2, "2023-24", "bogus", "", 3)],
        "cust_id long, fin_year string, manual_status string, remarks string, n int",
    )
    jobs.set_overrides(store, changes, ["n"])
    assert rows(store.read("recon_overrides"), "cust_id", "fin_year", "manual_status", "remarks") == [(1, "2023-24", "open", None)]
    jobs.set_overrides(store, changes.limit(1), ["n"])
    assert [r["manual_status"] for r in store.read("recon_overrides").collect()] == ["reserved"]
    texts = {r["description"] for r in store.read("audit_logs").collect()}
    assert texts == {"Status changed to open | cust_id=1 | FY=2023-24", "Status changed to reserved | cust_id=1 | FY=2023-24"}
    empty = spark.createDataFrame([], OVERRIDES)
    assert overrides.override_upsert(empty, changes.withColumn("updated_at", F.current_timestamp()), ["n"]).count() == 1


def test_statement_key_is_the_narrow_one(spark):
    parsed = statement_files.parse_statement_text(
        spark.createDataFrame([("f", i, t) for i, t in enumerate(STATEMENT_FILE.splitlines())], "file_id string, line_no long, text string")
    )
    people = spark.createDataFrame(PEOPLE, CUSTOMERS)
    rows_in = ingest.classify_statement(parsed, people)
    fresh = ingest.new_statement_rows(rows_in, spark.createDataFrame([], STATEMENT))
    assert [r["booking_amt"] for r in fresh.filter("tds_credited = 200").collect()] == [D("2000.00")]
    assert rows_in.filter("outcome = 'rejected'").count() == 1


def test_stream_takes_each_file_once(store, tmp_path):
    folder = tmp_path / "landing"
    write(folder, "a.txt", TAB_FILE)
    write(folder, "same.txt", TAB_FILE)
    args = (store, str(folder), str(tmp_path / "cp"))
    stream_ingest_uploads(*args)
    assert store.read("income_records").count() == 2 and store.read("file_uploads_log").count() == 1
    write(folder, "b.txt", COMMA_FILE)
    stream_ingest_uploads(*args)
    stream_ingest_uploads(*args)
    assert store.read("income_records").count() == 3 and store.read("file_uploads_log").count() == 2


def test_large_file_is_read_in_splits_in_order(spark, tmp_path):
    lines = ["code\tdoc_no\tdate\ttaxable"] + [f"C001\tINV-{i % 50}\t2024-04-15\t{i}" for i in range(1, 4001)]
    path = write(tmp_path / "in", "big.txt", "\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        ledger = ingest.normalise_ledger(landing.read_books_delimited(spark, [path])[0])
        assert ledger.count() == 4000 and ledger.select("line_block").distinct().count() > 5
        people = spark.createDataFrame(PEOPLE, CUSTOMERS)
        rated = ingest.classify_ledger(ledger, people, spark.createDataFrame([RATE], RATES))
        kept = ingest.accepted_books(rated, F.lit("r"))
        assert sorted(int(r["taxable_amt"]) for r in kept.collect()) == list(range(3951, 4001))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
