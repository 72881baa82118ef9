"""Books-of-account reports.

Every total is aggregated before it meets another table, so a customer with a
third of all invoices arrives at a join as one row per map task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.dates import day_text, fiscal_quarter
from tallyfold.functions.identifiers import contains_any
from tallyfold.functions.money import MONEY_SUM, as_money, money_sum, or_zero, zero
from tallyfold.operators.joins import lookup_join

# Fixed value: constant remark of the detailed ledger.
DETAILED_REMARK = "Automated Sync"


def _books_and_adjustments(books: DataFrame, adjustments: DataFrame) -> DataFrame:
    """Both tables in one shape, so that their totals need one grouping and no join."""
    nothing = F.lit(None).cast("decimal(15,2)")
    booked = books.select(
        "cust_id", "fin_year", "gross_amt", "taxable_amt", "tds_deductible",
        nothing.alias("adj_amt"), nothing.alias("linked_amt"), F.lit(1).alias("is_book"),
    )
    adjusted = adjustments.select(
        "cust_id", "fin_year", nothing.alias("gross_amt"), nothing.alias("taxable_amt"),
        nothing.alias("tds_deductible"), "adj_amt",
        F.when(F.col("income_id").isNotNull(), F.col("adj_amt")).alias("linked_amt"),
        F.lit(0).alias("is_book"),
    )
    return booked.unionByName(adjusted)


def books_widgets(books: DataFrame, adjustments: DataFrame, fin_year: str | None = None) -> DataFrame:
    """Per fiscal year: income, all and linked adjustments, taxable, tax.
    A year asked for without books gives one row of zeros."""
    both = _books_and_adjustments(books, adjustments)
    totals = [
        money_sum(F.col("gross_amt")).alias("sales_income"),
        money_sum(F.col("adj_amt")).alias("adjustments"),
        money_sum(F.col("linked_amt")).alias("linked_adjustments"),
        money_sum(F.col("taxable_amt")).alias("total_income"),
        money_sum(F.col("tds_deductible")).alias("tds_deductible"),
    ]
    has_books = F.max("is_book").alias("has_books")
    if fin_year is None:
        grouped = both.groupBy("fin_year").agg(*totals, has_books)
        return grouped.filter(F.col("has_books") == 1).drop("has_books")
    one = both.filter(F.col("fin_year") == fin_year).agg(*totals, has_books)
    names = [c for c in one.columns if c != "has_books"]
    return one.select(
        F.lit(fin_year).alias("fin_year"),
        *[F.when(F.col("has_books") == 1, F.col(c)).otherwise(F.lit(0).cast(MONEY_SUM)).alias(c) for c in names],
    )


def books_summary_view(customers: DataFrame, books: DataFrame, adjustments: DataFrame) -> DataFrame:
    """Per customer and year; collection is gross less every adjustment of both."""
    per = (
        _books_and_adjustments(books, adjustments)
        .groupBy("cust_id", "fin_year")
        .agg(
            money_sum(F.col("taxable_amt")).alias("taxable_amt"),
            money_sum(F.col("gross_amt")).alias("gross_amt"),
            money_sum(F.col("tds_deductible")).alias("tds_deductible"),
            money_sum(F.col("adj_amt")).alias("adj_amt"),
            F.max("is_book").alias("has_books"),
        )
        .filter(F.col("has_books") == 1)
    )
    named = customers.select("cust_id", "cust_name", "cust_status").join(per, "cust_id")
    return named.select(
        "cust_id", "cust_name", "cust_status", "fin_year", "taxable_amt", "gross_amt", "tds_deductible",
        or_zero(F.col("gross_amt") - F.col("adj_amt")).alias("collection_amt"),
        F.col("tds_deductible").alias("tds_receivable"),
    )


def books_summary(customers: DataFrame, books: DataFrame, fin_year: str, status: str = "") -> DataFrame:
    """Per customer of one year; page it by ``cust_name, cust_id``."""
    wanted = customers.select("cust_id", "cust_name", "cust_status")
    if status and status.upper() != "ALL":
        wanted = wanted.filter(F.col("cust_status") == status.lower())
    collected = F.greatest(F.col("gross_amt") - F.col("tds_deductible"), zero())
    per = (
        books.filter(F.col("fin_year") == fin_year)
        .groupBy("cust_id")
        .agg(
            money_sum(F.col("taxable_amt")).alias("taxable_amt"),
            money_sum(F.col("gross_amt")).alias("gross_amt"),
            money_sum(F.col("tds_deductible")).alias("tds_deductible"),
            money_sum(collected).alias("collection_amt"),
            money_sum(F.col("tds_deductible")).alias("tds_receivable"),
            money_sum(F.col("tax_amt")).alias("tax_amt"),
        )
        # Customers without books have only zeros and fall to this filter too.
        .filter((F.col("taxable_amt") > 0) | (F.col("gross_amt") > 0) | (F.col("tax_amt") > 0))
        .drop("tax_amt")
    )
    return wanted.join(per, "cust_id")


def books_ledger(books: DataFrame, customers: DataFrame, fin_year: str, search: str = "") -> DataFrame:
    """Order it by ``cust_name, doc_date desc, income_id``."""
    found = books.filter(F.col("fin_year") == fin_year)
    if search.strip():
        found = found.filter(contains_any(search.strip(), F.col("cust_name"), F.col("doc_number")))
    codes = customers.select("cust_id", "cust_code")
    return lookup_join(found, codes, ["cust_id"]).select(
        "income_id", "upload_ref", "cust_code", "cust_name", "doc_number",
        day_text(F.col("doc_date")).alias("doc_date"),
        "doc_type", "taxable_amt", "tax_amt", "gross_amt", "entry_source",
    )


def books_detailed(books: DataFrame, fin_year: str) -> DataFrame:
    rows = books.filter((F.col("fin_year") == fin_year) & (F.col("doc_type") == "invoice"))
    return rows.orderBy(F.col("doc_date").desc(), "income_id").select(
        "cust_name",
        F.col("doc_number").alias("invoice_no"),
        day_text(F.col("doc_date")).alias("invoice_date"),
        "taxable_amt", "gross_amt", "tds_section", "tds_rate", "tds_deductible",
        as_money(F.col("gross_amt") - F.col("tds_deductible")).alias("collection_amt"),
        F.col("tds_deductible").alias("tds_receivable"),
        F.lit(DETAILED_REMARK).alias("remarks"),
    )


def unreferenced_open(entries: DataFrame, fin_year: str) -> DataFrame:
    return entries.filter((F.col("fin_year") == fin_year) & ~F.col("resolved")).select(
        "unref_id", "upload_ref", "raw_identifier", "doc_number", "doc_date", "entry_amt", "unref_reason"
    )


def invoice_detail(books: DataFrame, customers: DataFrame) -> DataFrame:
    who = customers.select("cust_id", "cust_code", F.col("cust_name"), "pan_number", "tan_number")
    joined = lookup_join(books.drop("cust_name"), who, ["cust_id"], how="inner")
    return joined.select(
        "income_id", "upload_ref", "fin_year", "cust_code", "cust_name", "pan_number", "tan_number",
        "doc_number", "doc_date", "doc_type", "taxable_amt", "tax_amt", "gross_amt",
        "tds_deductible", "tds_section", "tds_rate", "entry_source",
        F.month("doc_date").alias("txn_month"),
        F.year("doc_date").alias("txn_year"),
        F.coalesce(fiscal_quarter(F.col("doc_date")), F.lit("Q4")).alias("fy_quarter"),
    )
