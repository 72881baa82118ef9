"""Column expressions on literal rows."""

from datetime import date
from decimal import Decimal as D

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tallyfold.functions import dates, headers, identifiers, matching, money


def values(spark, expr, *inputs, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, x {kind}")
    return [r[1] for r in sorted(df.select("i", expr(F.col("x"))).collect())]


@pytest.mark.parametrize(
    "text,expected",
    [
        ("2024-01-15", date(2024, 1, 15)),
        ("2024-1-5", date(2024, 1, 5)),
        ("15-01-2024", date(2024, 1, 15)),
        ("15/01/2024", date(2024, 1, 15)),
        ("01/15/2024", date(2024, 1, 15)),
        ("03/04/2024", date(2024, 4, 3)),
        ("15-jan-2024", date(2024, 1, 15)),
        ("15-JAN-2024", date(2024, 1, 15)),
        ("2024/01/15", date(2024, 1, 15)),
        (" 2024-01-15 ", date(2024, 1, 15)),
        ("31-02-2024", None),
        ("soon", None),
        ("", None),
        (None, None),
    ],
)
def test_parse_any_date(spark, text, expected):
    assert values(spark, dates.parse_any_date, text) == [expected]


def test_fiscal_calendar(spark):
    days = [date(2024, 3, 31), date(2024, 4, 1), date(1999, 12, 31), date(2000, 1, 1), None]
    assert values(spark, dates.fiscal_year, *days, kind="date") == ["2023-24", "2024-25", "1999-00", "1999-00", None]
    assert values(spark, dates.fiscal_quarter, *days, kind="date") == ["Q4", "Q1", "Q3", "Q4", None]


def test_fiscal_year_param():
    assert dates.fiscal_year_param(" fy 2022-23 ") == "2022-23"
    with pytest.raises(ValueError):
        dates.fiscal_year_param("FY ")


def test_parse_money(spark):
    got = values(spark, money.parse_money, "₹1,00,000.00", "", None, "n/a", "12.345", " 7 ", "-3.10")
    assert got == [D("100000.00"), D("0.00"), D("0.00"), D("0.00"), D("12.35"), D("7.00"), D("-3.10")]


def test_amount_repair(spark):
    df = spark.createDataFrame(
        [(D("100.00"), D("18.00"), D("0.00")), (D("0.00"), D("18.00"), D("118.00")), (D("0.00"), D("20.00"), D("10.00"))],
        "t decimal(15,2), x decimal(15,2), g decimal(15,2)",
    )
    gross = money.repaired_gross(F.col("t"), F.col("x"), F.col("g"))
    fixed = df.withColumn("g2", gross)
    fixed = fixed.withColumn("t2", money.repaired_taxable(F.col("t"), F.col("x"), F.col("g2")))
    assert [tuple(r) for r in fixed.select("t2", "g2").collect()] == [
        (D("100.00"), D("118.00")), (D("100.00"), D("118.00")), (D("0.00"), D("10.00")),
    ]


def test_percent_rounds_half_up(spark):
    df = spark.createDataFrame([(D("12.50"), D("1.000000")), (D("0.25"), D("2.000000"))], "a decimal(15,2), r decimal(12,6)")
    got = [r[0] for r in df.select(money.percent_of(F.col("a"), F.col("r"))).collect()]
    assert got == [D("0.13"), D("0.01")]


def test_sections(spark):
    assert values(spark, identifiers.blank_section, "—", "-", "none", "", None, " 194j ") == ["—"] * 5 + ["194J"]
    found = values(spark, lambda c: identifiers.section_in(c), "x 194J y", "194BA 01", "206C", "1947", "a 194 b")
    assert found == ["194J", None, "206C", None, "194"]
    wide = values(spark, lambda c: identifiers.section_in(c, extended=True), "194BA 01", "194LBA", "206CR")
    assert wide == ["194BA", "194LBA", "206CR"]
    assert values(spark, identifiers.tax_category, "206C", "194J") == ["TCS", "TDS"]


def test_split_tan_and_name(spark):
    line = "Name of Deductor : Acme Ltd - PWYC7918 3E"
    repaired = identifiers.repair_split_tan
    assert values(spark, lambda c: identifiers.tan_in(repaired(c)), line) == ["PWYC79183E"]
    assert values(spark, lambda c: identifiers.deductor_name_before_tan(repaired(c)), line) == ["Acme Ltd"]
    assert values(spark, lambda c: identifiers.deductor_name_before_tan(c), "TAN of Deductor: ABCD12345E") == ["Unknown Deductor"]


def test_document_types(spark):
    given = ["Invoice", "INV", "sales", "bill", "credit note", "cn", "debit_note", "DN", "adv", "others", "weird", "", None]
    expected = ["invoice"] * 4 + ["credit_note"] * 2 + ["debit_note"] * 2 + ["advance", "other", "invoice", "invoice", "invoice"]
    assert values(spark, identifiers.document_type, *given) == expected


def test_identifier_formats(spark):
    assert values(spark, identifiers.is_valid_pan, "abcde1234f", "ABCDE12345", None) == [True, False, False]
    assert values(spark, identifiers.is_valid_tan, "ABCD12345E", "ABCDE1234F", "") == [True, False, False]


def test_header_resolution():
    names = headers.normalise_headers(["﻿Company Name", " PAN Number ", "", "Tax Amount", "Taxable Amount"])
    assert names == ["company_name", "pan_number", "col2", "tax_amount", "taxable_amount"]
    assert headers.resolve(names, ["pan"]) == "pan_number"
    assert headers.resolve(["company_name"], ["pan"]) is None
    assert headers.resolve(names, headers.LEDGER_COLUMNS["tax"]) == "tax_amount"
    assert headers.is_sales_register(["narration", "x"]) and not headers.is_sales_register(["doc_number"])


def _verdicts(spark, fn, triples):
    df = spark.createDataFrame(
        [(D(b), D(g), D(i)) for b, g, i in triples], "b decimal(25,2), g decimal(25,2), i decimal(25,2)"
    )
    return [r[0] for r in df.select(fn).collect()]


TRIPLES = [
    ("0", "0", "0"), ("0", "0", "100"), ("100", "104.99", "0"), ("100", "105", "0"), ("100", "85", "0"),
    ("10000", "8499", "0"), ("100", "50", "0"), ("10000", "4999", "0"), ("0", "90", "0"), ("90", "0", "0"),
]


def test_status_of_records(spark):
    b, g, i = F.col("b"), F.col("g"), F.col("i")
    assert _verdicts(spark, matching.status_of_records(b, g, i), TRIPLES) == [
        "open", "reconciled", "reconciled", "likely_match", "likely_match",
        "suggested_match", "suggested_match", "open", "open", "open",
    ]


def test_status_of_view_ignores_income(spark):
    got = _verdicts(spark, matching.status_of_view(F.col("b"), F.col("g")), TRIPLES)
    assert got[:2] == ["open", "open"]


def test_scores(spark):
    b, g = F.col("b"), F.col("g")
    records = _verdicts(spark, matching.score_of_records(b, g), TRIPLES)
    assert records[:5] == [D("100"), D("100"), D("100"), D("95.2381"), D("85")]
    assert records[-2:] == [D("0"), D("0")]
    view = _verdicts(spark, matching.score_of_view(b, g), TRIPLES)
    assert view[:4] == [D("0"), D("0"), D("95.25"), D("95.24")]


def test_variance_class(spark):
    got = values(spark, matching.variance_class, D("0.00"), D("0.01"), D("0.02"), D("-0.02"), kind="decimal(15,2)")
    assert got == ["match", None, "under", "over"]


def test_between_days_is_inclusive(spark):
    df = spark.sql("select timestamp'2024-01-01 00:00:00' t union all select timestamp'2024-01-02 23:59:59' union all select timestamp'2024-01-03 00:00:00'")
    assert df.filter(dates.between_days(F.col("t"), "2024-01-01", "2024-01-02")).count() == 2
    plan = df.filter(dates.between_days(F.col("t"), "2024-01-01", "2024-01-02"))._jdf.queryExecution().optimizedPlan().toString()
    assert "cast(t" not in plan


def test_includes_any_takes_the_needle_as_it_stands(spark):
    df = spark.createDataFrame([("user_1",), ("userX1",), ("50%",), ("a\\b",), (None,)], "a string")
    for needle, found in (("USER_1", ["user_1"]), ("0%", ["50%"]), ("a\\B", ["a\\b"]), ("r", ["userX1", "user_1"])):
        assert sorted(r[0] for r in df.filter(identifiers.includes_any(needle, F.col("a"))).collect()) == found
    assert [r[0] for r in df.filter(identifiers.contains_any("a\\b", F.col("a"))).collect()] == ["a\\b"]
    assert df.filter(identifiers.contains_any("r_1", F.col("a"))).count() == 2


def test_contains_any_treats_null_as_no_match(spark):
    df = spark.createDataFrame([("Alpha", None), (None, "beta"), (None, None)], "a string, b string")
    assert rows(df.filter(identifiers.contains_any("A", F.col("a"), F.col("b")))) == [("Alpha", None), (None, "beta")]
