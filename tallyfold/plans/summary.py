"""Tax summary per customer and fiscal year."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.dates import fiscal_year_param
from tallyfold.functions.identifiers import NO_VALUE, contains_any, includes_any, key_of
from tallyfold.functions.matching import variance_class, variance_sign
from tallyfold.functions.money import money_sum, or_zero, pct_credit
from tallyfold.plans.recon import statement_totals

EXPORT_NAMES = {
    "cust_name": "Customer Name",
    "pan_number": "PAN Number",
    "tan_number": "TAN Number",
    "tds_section": "TDS Section",
    "total_taxable_amt": "Total Taxable Amt",
    "total_tds_deductible": "System TDS Deductible",
    "total_f26as_credit": "Form 26AS Credit",
    "variance_amt": "Variance Amt",
}
_SUMS = ["total_taxable_amt", "total_tds_deductible", "total_gross_amt", "invoice_count"]


def _book_sums(books: DataFrame, *keys: str) -> DataFrame:
    return books.groupBy(*keys).agg(
        F.sum("taxable_amt").alias("total_taxable_amt"),
        F.sum("tds_deductible").alias("total_tds_deductible"),
        F.sum("gross_amt").alias("total_gross_amt"),
        F.count("income_id").alias("invoice_count"),
    )


def _regroup(sums: DataFrame, *keys: str, extra=()) -> DataFrame:
    return sums.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in _SUMS], *extra)


def _most_frequent(value: str):
    """The value with most invoices, the lowest one on a tie; unsectioned
    invoices do not vote."""
    votes = F.struct((-F.col("invoice_count")).alias("n"), F.col(value).alias("v"))
    return F.min_by(value, F.when(F.col("tds_section") != NO_VALUE, votes))


def dominant_values(books: DataFrame) -> DataFrame:
    """Per customer and year the sums, the dominant section and dominant rate.

    Invoices are scanned and grouped once, to section and rate; everything
    else works on that small table.
    """
    base = _book_sums(books, "cust_id", "fin_year", "tds_section", "tds_rate")
    by_section = _regroup(base, "cust_id", "fin_year", "tds_section")
    totals = _regroup(
        by_section, "cust_id", "fin_year", extra=[_most_frequent("tds_section").alias("top_section")]
    )
    by_rate = (
        base.filter(F.col("tds_section") != NO_VALUE)
        .groupBy("cust_id", "fin_year", "tds_rate")
        .agg(F.sum("invoice_count").alias("n"))
        .groupBy("cust_id", "fin_year")
        .agg(F.min_by("tds_rate", F.struct(-F.col("n"), F.col("tds_rate"))).alias("top_rate"))
    )
    return totals.join(by_rate, ["cust_id", "fin_year"], "left")


def _with_credit(customers: DataFrame, totals: DataFrame, statement: DataFrame, how: str) -> DataFrame:
    who = customers.select(
        "cust_id", "cust_code", "cust_name", "pan_number", "tan_number",
        key_of(F.col("tan_number")).alias("tan_key"),
    )
    return who.join(totals, "cust_id", how).join(
        statement_totals(statement), ["tan_key", "fin_year"], "left"
    )


def _summary_columns() -> list:
    tax, credit = or_zero(F.col("total_tds_deductible")), or_zero(F.col("f26as_credit"))
    return [
        "cust_id", "cust_code", "cust_name", "pan_number", "tan_number", "fin_year",
        or_zero(F.col("total_taxable_amt")).alias("total_taxable_amt"),
        tax.alias("total_tds_deductible"),
        or_zero(F.col("total_gross_amt")).alias("total_gross_amt"),
        credit.alias("total_26as_credit"),
        or_zero(tax - credit).alias("variance_amt"),
        pct_credit(credit, tax).alias("pct_credit"),
        F.coalesce("invoice_count", F.lit(0)).cast("long").alias("invoice_count"),
    ]


def tds_summary_view(customers: DataFrame, books: DataFrame, statement: DataFrame) -> DataFrame:
    """Customers without books appear once, with no year and zero sums."""
    rows = _with_credit(customers, dominant_values(books), statement, "left")
    return rows.select(
        *_summary_columns(),
        F.coalesce("top_section", F.lit(NO_VALUE)).alias("tds_section"),
        F.coalesce("top_rate", F.lit(0).cast("decimal(5,2)")).alias("tds_rate"),
    )


def tds_summary_fy(
    customers: DataFrame, books: DataFrame, statement: DataFrame, fin_year: str | None = None
) -> DataFrame:
    """The warehouse's summary: one row per customer and year with books, for
    one year or, in a single grouping, for all."""
    if fin_year is not None:
        books = books.filter(F.col("fin_year") == fin_year)
        statement = statement.filter(F.col("fin_year") == fin_year)
    totals = _book_sums(books.filter(F.col("fin_year").isNotNull()), "cust_id", "fin_year")
    return _with_credit(customers, totals, statement, "inner").select(*_summary_columns())


def distinct_years(books: DataFrame, statement: DataFrame) -> DataFrame:
    return books.select("fin_year").union(statement.select("fin_year")).distinct()


def _collated(column: str):
    """Equality of a case-insensitive, space-padded column."""
    return F.lower(F.rtrim(F.col(column)))


def section_by_name(
    customers: DataFrame, books: DataFrame, statement: DataFrame, uploads: DataFrame, fy: str
) -> DataFrame:
    """Highest section code seen under a name in books or statement.

    Statement rows also count under the name of the customer owning the TAN,
    once any statement upload of the year is on record.
    """
    year = F.col("fin_year") == fy
    rows = statement.filter(year)
    logged = uploads.filter(year & (F.col("module_name") == "form26as")).limit(1)
    uploaded = logged.agg(F.count(F.lit(1))).scalar()
    owners = customers.select(_collated("tan_number").alias("_tan"), F.col("cust_name").alias("name"))
    by_owner = (
        rows.filter(uploaded > 0)
        .select(_collated("tan_of_deductor").alias("_tan"), F.col("section_code").alias("section"))
        .distinct()
        .join(owners, "_tan")
        .select("name", "section")
    )
    seen = (
        books.filter(year)
        .select(F.col("cust_name").alias("name"), F.col("tds_section").alias("section"))
        .union(rows.select(F.col("deductor_name").alias("name"), F.col("section_code").alias("section")))
        .union(by_owner)
        .filter(F.col("section").isNotNull() & ~F.col("section").isin("", NO_VALUE))
        .select(key_of(F.col("name")).alias("name_key"), "section")
    )
    # Distinct first: it is a hash aggregation, and leaves max few rows to sort.
    return seen.distinct().groupBy("name_key").agg(F.max("section").alias("final_section"))


def tds_summary_report(
    customers: DataFrame,
    books: DataFrame,
    statement: DataFrame,
    uploads: DataFrame,
    fin_year: str,
    customer: str = "",
    section: str = "",
) -> DataFrame:
    """Page it by ``cust_name, cust_id``. ``customer`` is an id or part of a name."""
    fy = fiscal_year_param(fin_year)
    year = F.col("fin_year") == fy
    b = (
        books.filter(year)
        .groupBy("cust_id")
        .agg(
            F.sum("taxable_amt").alias("taxable"),
            F.sum("tds_deductible").alias("deductible"),
            F.count(F.lit(1)).alias("inv_count"),
        )
    )
    g = (
        statement.filter(year)
        .groupBy(_collated("tan_of_deductor").alias("_tan"))
        .agg(F.sum("tds_credited").alias("credited"))
    )
    who = customers.select(
        "cust_id", "cust_name", "pan_number", "tan_number",
        _collated("tan_number").alias("_tan"), key_of(F.col("cust_name")).alias("name_key"),
    )
    if customer and customer.upper() != "ALL":
        if customer.isdigit():
            who = who.filter(F.col("cust_id") == int(customer))
        else:
            who = who.filter(contains_any(customer, F.col("cust_name")))
    sections = section_by_name(customers, books, statement, uploads, fy)
    rows = (
        who.join(b, "cust_id", "left")
        .join(g, "_tan", "left")
        .filter("coalesce(taxable, 0) > 0 or coalesce(deductible, 0) > 0 or coalesce(credited, 0) > 0")
        .join(sections, "name_key", "left")
    )
    if section and section.upper() != "ALL":
        rows = rows.filter(F.col("final_section") == section.upper())
    shown = F.coalesce("final_section", F.lit(NO_VALUE))
    return rows.select(
        F.concat_ws("_", F.col("cust_id").cast("string"), shown).alias("summary_id"),
        "cust_id", "cust_name", "pan_number", "tan_number",
        shown.alias("tds_section"),
        or_zero(F.col("taxable")).alias("total_taxable_amt"),
        or_zero(F.col("deductible")).alias("total_tds_deductible"),
        or_zero(F.col("credited")).alias("total_f26as_credit"),
        or_zero(or_zero(F.col("deductible")) - or_zero(F.col("credited"))).alias("variance_amt"),
        F.coalesce("inv_count", F.lit(0)).cast("long").alias("invoice_count"),
    )


def summary_inline_filter(report: DataFrame, search: str = "", variance: str = "") -> DataFrame:
    """Dashboard filter: text over name, PAN, TAN and section; variance
    ``match``, ``under`` or ``over``."""
    rows = report
    if search:
        wanted = ["cust_name", "pan_number", "tan_number", "tds_section"]
        rows = rows.filter(includes_any(search, *[F.col(c) for c in wanted]))
    if variance in ("match", "under", "over"):
        rows = rows.filter(variance_class(F.col("variance_amt")) == variance)
    return rows


def summary_selection(report: DataFrame, customer: str = "", section: str = "") -> DataFrame:
    """Dashboard selection: customer by id or part of the name, section by
    case-insensitive equality."""
    rows = report
    if customer and customer.lower() != "all":
        by_id = F.col("cust_id").cast("string") == customer
        rows = rows.filter(by_id | includes_any(customer, F.col("cust_name")))
    if section and section.lower() != "all":
        rows = rows.filter(F.lower("tds_section") == section.lower())
    return rows


def summary_cards(report: DataFrame) -> DataFrame:
    """Totals over all filtered rows, not over a page."""
    return report.agg(
        F.count(F.lit(1)).alias("row_count"),
        money_sum(F.col("total_taxable_amt")).alias("taxable"),
        money_sum(F.col("total_tds_deductible")).alias("deductible"),
        money_sum(F.col("total_f26as_credit")).alias("f26as"),
        or_zero(F.sum("total_tds_deductible") - F.sum("total_f26as_credit")).alias("variance"),
    )


def with_variance_sign(report: DataFrame) -> DataFrame:
    return report.withColumn("variance_sign", variance_sign(F.col("variance_amt")))


def summary_export(report: DataFrame) -> DataFrame:
    text = {"cust_name", "pan_number", "tan_number", "tds_section"}
    columns = [
        F.coalesce(F.nullif(c, F.lit("")), F.lit(NO_VALUE)).alias(n) if c in text else F.col(c).alias(n)
        for c, n in EXPORT_NAMES.items()
    ]
    return report.orderBy("cust_name", "cust_id").select(*columns)
