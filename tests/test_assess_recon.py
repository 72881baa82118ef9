"""Reassessment and reconciliation on literal edge rows."""

from datetime import date
from decimal import ROUND_HALF_UP
from decimal import Decimal as D

from conftest import rows
from pyspark.sql import functions as F

from tallyfold.plans import assess, recon, summary
from tallyfold.sources.schemas import BOOKS, CUSTOMERS, OVERRIDES, RATES, STATEMENT

FY = "2023-24"


def customers(spark, *people):
    data = [(i, f"C{i}", f"Name {i}", pan, None, tan, "active", None) for i, pan, tan in people]
    return spark.createDataFrame(data, CUSTOMERS)


def book(i, cust, section, taxable, tax="7.00", tds="1.00", fy=FY, gross=None):
    return (
        i, "U", fy, cust, f"Name {cust}", f"INV-{i}", date(2023, 5, 1), "invoice", D(taxable), D(tax),
        D(gross if gross is not None else taxable), section, D("0.00"), D(tds), "manual",
    )


def credit(i, tan, section, amount="10.00", fy=FY):
    return (i, fy, tan, "Name", section, date(2023, 5, 1), D("100.00"), D(amount))


def rate(i, section, pct, limit, payee="ALL", resident=True, active=True, surcharge="0", cess="0"):
    return (
        i, section, None, "d", payee, resident, D(pct), D(surcharge), D(cess), limit, None, None,
        date(2024, 4, 1), active, None,
    )


RATE_ROWS = [
    rate(1, "194C", "1.000", 1000, "INDIVIDUAL_HUF"), rate(2, "194C", "2.000", 1000, "OTHERS"),
    rate(3, "194H", "2.000", None, surcharge="10", cess="4"), rate(4, "194J", "2.000", 0), rate(5, "194J", "10.000", 0),
    rate(6, "192", "0.000", None), rate(7, "194Q", "9.000", None, resident=False),
    rate(8, "194R", "9.000", None, active=False), rate(9, "194B", "30.000", None),
]
GOOD = "ABCDE1234F"


def tell(people, books, credits):
    """The rule invoice by invoice, sections in ascending order."""
    priority = {"OTHERS": 1, "ALL": 2, "INDIVIDUAL_HUF": 3}
    out = {b[0]: [b[11], b[13]] for b in books}
    section_of = {b[0]: b[11] for b in books}
    pairs = sorted({
        (c[0], c[1], f[4].strip().upper()) for c in people for f in credits
        if f[2].strip().lower() == c[2].strip().lower() and f[4] not in (None, "", "—", "-")
    })
    for cust, pan, section in pairs:
        options = [r for r in RATE_ROWS if r[1] == section and r[5] and r[13]]
        if not options:
            continue
        r = min(options, key=lambda x: (priority.get(x[4], 4), x[0]))
        base = r[6] if pan.isalnum() and len(pan) == 10 and pan[:5].isalpha() and pan[5:9].isdigit() else max(r[6], D(20))
        effective = (base * (1 + r[7] / 100) * (1 + r[8] / 100)).quantize(D("0.000001"))
        mine = [
            b for b in books
            if b[3] == cust and (section_of[b[0]] in (None, "—") or section_of[b[0]].strip().upper() == section)
        ]
        annual = sum((b[8] for b in mine), D(0))
        for b in mine:
            if r[9] and annual < r[9]:
                tax = D("0.00")
            elif effective > 0:
                tax = (b[8] * effective / 100).quantize(D("0.01"), ROUND_HALF_UP)
            else:
                tax = b[9]
            out[b[0]] = [section, tax]
            section_of[b[0]] = section
    return out


def test_reassess_edges(spark):
    people = [
        (1, GOOD, "AAAA00001A"), (2, GOOD, "AAAA00002A"), (3, "BAD", "AAAA00003A"), (4, GOOD, "AAAA00004A"),
        (5, GOOD, "AAAA00005A"), (6, GOOD, "AAAA00006A"), (7, "BAD", "AAAA00007A"),
    ]
    books = [
        book(1, 1, "194C", "999.99"),                       # just under the limit
        book(2, 2, "194C", "400.00"), book(3, 2, " 194c ", "600.00"),  # equal to it
        book(4, 3, "194C", "5000.00"),                      # invalid PAN: 20 %
        book(5, 4, "—", "100.00"), book(6, 4, None, "200.00"), book(7, 4, "194J", "300.00"), book(8, 4, "194H", "50.00"),
        book(9, 5, "192", "100.00", tax="33.00"),           # rate of zero
        book(10, 5, "194R", "100.00"), book(11, 5, "194Q", "100.00"), book(12, 5, "ZZZ", "100.00"),
        book(13, 6, "—", "100.00"),                         # no rated section
        book(14, 7, "194B", "100.00"),                      # invalid PAN, base above 20 %
        book(15, 1, "—", "0.02"),                           # lifts the first one over the limit
    ]
    credits = [
        credit(1, " aaaa00001a", "194C"), credit(2, "AAAA00002A ", "194c"), credit(3, "AAAA00003A", "194C"),
        credit(4, "AAAA00004A", "194J"), credit(5, "AAAA00004A", "194H"), credit(6, "AAAA00005A", "192"),
        credit(7, "AAAA00005A", "194R"), credit(8, "AAAA00005A", "194Q"), credit(9, "AAAA00006A", "ZZZ"),
        credit(10, "AAAA00006A", "—"), credit(11, "AAAA00007A", "194B"),
    ]
    b = spark.createDataFrame(books, BOOKS)
    c = customers(spark, *people)
    s = spark.createDataFrame(credits, STATEMENT)
    r = spark.createDataFrame(RATE_ROWS, RATES)
    done = assess.reassess_tax(b, c, s, r)
    got = {x["income_id"]: [x["tds_section"], x["tds_deductible"]] for x in done.collect()}
    assert got == tell(people, books, credits)
    assert got[5][0] == "194H" and got[9][1] == D("33.00") and got[4][1] == D("1000.00") and got[14][1] == D("30.00")
    assert rows(assess.reassess_tax(done, c, s, r)) == rows(done)
    other = b.withColumn("fin_year", F.when(F.col("income_id") <= 4, FY).otherwise("2020-21"))
    scoped = assess.reassess_tax(other, c, s, r, [FY])
    assert rows(scoped.filter("fin_year <> '2023-24'")) == rows(other.filter("fin_year <> '2023-24'"))
    assert scoped.count() == 15


def test_reassess_sliced_equals_broadcast(spark):
    people = [(i, GOOD, f"AAAA{i:05d}A") for i in range(1, 30)]
    books = [book(i, 1 if i % 3 == 0 else i % 29 + 1, ["194C", "—", "194H"][i % 3], f"{i}.50") for i in range(600)]
    credits = [credit(i, f"AAAA{i:05d}A", s) for i in range(1, 30) for s in ("194C", "194H")]
    frames = (
        spark.createDataFrame(books, BOOKS), customers(spark, *people),
        spark.createDataFrame(credits, STATEMENT), spark.createDataFrame(RATE_ROWS, RATES),
    )
    plain = rows(assess.reassess_tax(*frames))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert rows(assess.reassess_tax(*frames)) == plain
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def recon_frames(spark):
    people = [
        (1, GOOD, "T1"), (2, "P2", "T2"), (3, "P3", "T3"), (4, "P4", "T4"), (5, "T5", "T5"), (6, "P6", "T6"),
    ]
    books = [
        book(1, 1, "194C", "10.00", tds="100.00"), book(2, 2, "194C", "10.00", tds="100.00"),
        book(3, 3, "194C", "10.00", tds="0.00"), book(4, 5, "194C", "10.00", tds="40.00"),
        book(5, 6, "194C", "0.00", tds="0.00", gross="0.00"),
    ]
    credits = [
        credit(1, " t1", "194C", "95.01"), credit(2, "T2", "194C", "85.00"), credit(3, "p2", "194C", "50.00"),
        credit(4, "T4", "194C", "9.00"), credit(5, "T5", "194C", "20.00"),
    ]
    manual = spark.createDataFrame([(1, FY, "reserved", None, None), (4, "1999-00", "disabled", "x", None)], OVERRIDES)
    return customers(spark, *people), spark.createDataFrame(books, BOOKS), spark.createDataFrame(credits, STATEMENT), manual


def test_recon_records(spark):
    got = rows(recon.recon_records(*recon_frames(spark), FY), "cust_id", "f26as_credit_amt", "recon_status", "remarks")
    default = "Automated engine validation complete."
    assert got == [
        (1, D("95.01"), "reserved", default),
        (2, D("50.00"), "suggested_match", default),
        (2, D("85.00"), "likely_match", default),
        (3, D("0.00"), "reconciled", default),
        (4, D("9.00"), "open", default),
        (5, D("20.00"), "suggested_match", default),
    ]
    once = recon.recon_records(*recon_frames(spark), FY, dedupe=True)
    assert once.count() == 5


def test_recon_stats(spark):
    c, b, s, o = recon_frames(spark)
    row = recon.recon_stats(c, b, s, o, "FY " + FY).first().asDict()
    assert row["total_system_tds"] == D("340.00") and row["total_f26as_credit"] == D("259.01")
    assert row["cnt_grand_total"] == 6
    counts = {k: v for k, v in row.items() if k.startswith("cnt_") and k != "cnt_grand_total"}
    assert counts == {
        "cnt_reconciled": 1, "cnt_likely_match": 1, "cnt_reserved": 1, "cnt_suggested_match": 2,
        "cnt_not_liable": 0, "cnt_open": 2, "cnt_disabled": 0,
    }
    statuses = recon.recon_status_counts(c, b, s, o, FY)
    assert statuses.agg(F.sum("cnt_val")).first()[0] == sum(counts.values())


def test_recon_view_keeps_only_years_with_books(spark):
    view = recon.recon_view(*recon_frames(spark))
    got = {r["cust_id"]: r["recon_status"] for r in view.collect()}
    assert got == {1: "reserved", 2: "likely_match", 3: "open", 5: "suggested_match", 6: "open"}


def test_dominant_values_tie_and_default(spark):
    books = [
        book(1, 1, "194J", "1.00"), book(2, 1, "194C", "1.00"), book(3, 1, "—", "1.00"), book(4, 1, "—", "1.00"),
        book(5, 1, None, "1.00"), book(6, 2, "—", "1.00"),
    ]
    c = customers(spark, (1, GOOD, "T1"), (2, GOOD, "T2"), (3, GOOD, "T3"))
    s = spark.createDataFrame([credit(1, "T1", "194C", "0.50")], STATEMENT)
    got = rows(
        summary.tds_summary_view(c, spark.createDataFrame(books, BOOKS), s),
        "cust_id", "fin_year", "tds_section", "invoice_count", "pct_credit",
    )
    assert got == [(1, FY, "194C", 5, D("10.00")), (2, FY, "—", 1, D("0.00")), (3, None, "—", 0, D("0.00"))]


def test_summary_report_needs_an_upload_for_owner_names(spark):
    c = customers(spark, (1, GOOD, "T1"))
    b = spark.createDataFrame([book(1, 1, "—", "5.00")], BOOKS)
    s = spark.createDataFrame([credit(1, "t1", "194C")], STATEMENT).withColumn("deductor_name", F.lit("Other"))
    log = spark.createDataFrame([(FY, "form26as")], "fin_year string, module_name string")
    with_log = summary.tds_summary_report(c, b, s, log, FY).first()
    without = summary.tds_summary_report(c, b, s, log.limit(0), FY).first()
    assert (with_log["tds_section"], without["tds_section"]) == ("194C", "—")
    assert with_log["total_f26as_credit"] == D("10.00") and with_log["summary_id"] == "1_194C"
