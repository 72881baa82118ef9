"""Reconciliation of books against the statement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.dates import fiscal_year_param
from tallyfold.functions.identifiers import contains_any, key_of
from tallyfold.functions.matching import (
    DEFAULT_REMARK,
    STATUSES,
    score_of_records,
    score_of_view,
    status_of_records,
    status_of_view,
)
from tallyfold.functions.money import money_sum, or_zero, ratio_pct
from tallyfold.operators.joins import key_any_join


def book_totals(books: DataFrame) -> DataFrame:
    return books.groupBy("cust_id", "fin_year").agg(
        F.sum("tds_deductible").alias("system_tds"), F.sum("gross_amt").alias("gross_income")
    )


def statement_totals(statement: DataFrame) -> DataFrame:
    return statement.groupBy(key_of(F.col("tan_of_deductor")).alias("tan_key"), "fin_year").agg(
        F.sum("tds_credited").alias("f26as_credit")
    )


def recon_view(
    customers: DataFrame, books: DataFrame, statement: DataFrame, overrides: DataFrame
) -> DataFrame:
    """Verdict per customer and fiscal year of the books, TAN match only."""
    who = customers.select(
        "cust_id", "cust_code", "cust_name", "pan_number", "tan_number",
        key_of(F.col("tan_number")).alias("tan_key"),
    )
    manual = overrides.select(
        "cust_id", "fin_year", "manual_status", F.col("remarks").alias("note"), "updated_at"
    )
    rows = (
        who.join(book_totals(books), "cust_id")
        .join(statement_totals(statement), ["tan_key", "fin_year"], "left")
        .join(manual, ["cust_id", "fin_year"], "left")
        .filter(F.col("system_tds").isNotNull() | F.col("f26as_credit").isNotNull())
    )
    b, g = or_zero(F.col("system_tds")), or_zero(F.col("f26as_credit"))
    return rows.select(
        "cust_id", "cust_code", "cust_name", "pan_number", "tan_number", "fin_year",
        b.alias("system_tds"),
        or_zero(F.col("gross_income")).alias("book_credit"),
        g.alias("f26as_credit"),
        or_zero(b - g).alias("variance_amt"),
        score_of_view(b, g).alias("match_score_pct"),
        F.coalesce("manual_status", status_of_view(b, g)).alias("recon_status"),
        F.coalesce("note", F.lit(DEFAULT_REMARK)).alias("remarks"),
        F.col("updated_at").alias("status_updated_at"),
    )


def _year_frame(
    customers: DataFrame, books: DataFrame, statement: DataFrame, fy: str, dedupe: bool = False
) -> DataFrame:
    """Every customer with the year's book totals and the credit found under
    its TAN or its PAN."""
    year = F.col("fin_year") == fy
    b = book_totals(books.filter(year)).drop("fin_year").withColumn("has_books", F.lit(True))
    g = statement_totals(statement.filter(year)).drop("fin_year")
    who = customers.select("cust_id", "cust_name", "pan_number", "tan_number")
    keys = (key_of(F.col("tan_number")), key_of(F.col("pan_number")))
    return key_any_join(who.join(b, "cust_id", "left"), g, keys, "tan_key", "f26as_credit", dedupe)


def recon_records(
    customers: DataFrame,
    books: DataFrame,
    statement: DataFrame,
    overrides: DataFrame,
    fin_year: str,
    status: str = "",
    search: str = "",
    dedupe: bool = False,
) -> DataFrame:
    """Page it by ``cust_name, cust_id``."""
    fy = fiscal_year_param(fin_year)
    manual = overrides.filter(F.col("fin_year") == fy).select(
        "cust_id", "manual_status", F.col("remarks").alias("note")
    )
    rows = _year_frame(customers, books, statement, fy, dedupe).join(manual, "cust_id", "left")
    b, g, i = (or_zero(F.col(c)) for c in ("system_tds", "f26as_credit", "gross_income"))
    records = rows.select(
        F.col("cust_id").alias("recon_id"), "cust_id", "cust_name", "pan_number", "tan_number",
        b.alias("system_tds_amt"), g.alias("f26as_credit_amt"), i.alias("book_credit_amt"),
        or_zero(b - g).alias("variance_amt"),
        score_of_records(b, g).alias("match_score"),
        F.coalesce("manual_status", status_of_records(b, g, i)).alias("recon_status"),
        F.coalesce("note", F.lit(DEFAULT_REMARK)).alias("remarks"),
    ).filter("system_tds_amt > 0 or f26as_credit_amt > 0 or book_credit_amt > 0")
    if status and status.lower() != "all":
        records = records.filter(F.lower("recon_status") == status.lower())
    if search.strip() and search.strip().upper() != "ALL":
        wanted = [F.col(c) for c in ("cust_name", "pan_number", "tan_number")]
        records = records.filter(contains_any(search.strip(), *wanted))
    return records


def recon_totals(
    customers: DataFrame, books: DataFrame, statement: DataFrame, fin_year: str, dedupe: bool = False
) -> DataFrame:
    rows = _year_frame(customers, books, statement, fiscal_year_param(fin_year), dedupe)
    sums = rows.agg(
        money_sum(F.col("system_tds")).alias("total_system_tds"),
        money_sum(F.col("f26as_credit")).alias("total_f26as_credit"),
        money_sum(F.col("gross_income")).alias("total_book_credit"),
    )
    return sums.withColumn("pct_credit", _pct_of_totals())


def recon_status_counts(
    customers: DataFrame,
    books: DataFrame,
    statement: DataFrame,
    overrides: DataFrame,
    fin_year: str,
    dedupe: bool = False,
) -> DataFrame:
    fy = fiscal_year_param(fin_year)
    manual = overrides.filter(F.col("fin_year") == fy).select("cust_id", "manual_status")
    rows = _year_frame(customers, books, statement, fy, dedupe).filter(
        F.col("system_tds").isNotNull() | F.col("f26as_credit").isNotNull()
    )
    b, g, i = (or_zero(F.col(c)) for c in ("system_tds", "f26as_credit", "gross_income"))
    verdict = F.coalesce("manual_status", status_of_records(b, g, i))
    return (
        rows.join(manual, "cust_id", "left")
        .groupBy(verdict.alias("recon_status"))
        .agg(F.count(F.lit(1)).alias("cnt_val"))
    )


def recon_customer_count(
    customers: DataFrame, books: DataFrame, statement: DataFrame, fin_year: str
) -> DataFrame:
    """Customers with books or with a statement row under their TAN."""
    year = F.col("fin_year") == fiscal_year_param(fin_year)
    booked = books.filter(year).select("cust_id")
    tans = statement.filter(year).select(key_of(F.col("tan_of_deductor")).alias("tan_key"))
    who = customers.select("cust_id", key_of(F.col("tan_number")).alias("tan_key"))
    with_books = who.join(booked, "cust_id", "left_semi").select("cust_id")
    with_credit = who.join(tans, "tan_key", "left_semi").select("cust_id")
    return with_books.union(with_credit).agg(F.countDistinct("cust_id").alias("total_cust"))


def recon_stats(
    customers: DataFrame,
    books: DataFrame,
    statement: DataFrame,
    overrides: DataFrame,
    fin_year: str,
    dedupe: bool = False,
) -> DataFrame:
    """All figures of the overview in one row and one pass: totals, distinct
    customers and one count per status, zero where the status does not occur."""
    fy = fiscal_year_param(fin_year)
    manual = overrides.filter(F.col("fin_year") == fy).select("cust_id", "manual_status")
    rows = _year_frame(customers, books, statement, fy, dedupe).join(manual, "cust_id", "left")
    b, g, i = (or_zero(F.col(c)) for c in ("system_tds", "f26as_credit", "gross_income"))
    counted = F.col("system_tds").isNotNull() | F.col("f26as_credit").isNotNull()
    verdict = F.coalesce("manual_status", status_of_records(b, g, i))
    # A customer counts once: on the row of its TAN, else on its only row if it has books.
    by_tan = F.coalesce(F.col("matched_by") == "first", F.lit(False))
    again = F.coalesce(F.col("matched_by") == "both", F.lit(False))
    customer = by_tan | (F.coalesce("has_books", F.lit(False)) & ~again)
    sums = rows.agg(
        money_sum(F.col("system_tds")).alias("total_system_tds"),
        money_sum(F.col("f26as_credit")).alias("total_f26as_credit"),
        money_sum(F.col("gross_income")).alias("total_book_credit"),
        F.count_if(customer).alias("cnt_grand_total"),
        *[F.count_if(counted & (verdict == s)).alias(f"cnt_{s}") for s in STATUSES],
    )
    return sums.withColumn("pct_credit", _pct_of_totals())


def _pct_of_totals():
    return F.when(F.col("total_system_tds") == 0, F.lit(0).cast("decimal(20,4)")).otherwise(
        ratio_pct(F.col("total_f26as_credit"), F.col("total_system_tds"))
    )
