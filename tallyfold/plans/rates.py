"""Rate tables: reports and the choice of one rate per section."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.dates import day_text
from tallyfold.functions.identifiers import NO_VALUE, code_of
from tallyfold.operators.keyed import first_per_key

# Fixed value: payee kinds in order of preference; all others come last.
PAYEE_PRIORITY = ["OTHERS", "ALL", "INDIVIDUAL_HUF"]


def payee_rank(payee: Column) -> Column:
    position = F.array_position(F.array(*[F.lit(p) for p in PAYEE_PRIORITY]), payee)
    return F.when(position > 0, position).otherwise(len(PAYEE_PRIORITY) + 1)


def _applicable(rates: DataFrame) -> DataFrame:
    return rates.filter(F.col("is_resident") & F.col("is_active")).withColumn(
        "section_code", code_of(F.col("section_code"))
    )


def rates_for_assessment(rates: DataFrame) -> DataFrame:
    """One resident active row per section, by payee preference, then lowest id."""
    return first_per_key(
        _applicable(rates), ["section_code"], [payee_rank(F.col("payee_type")), F.col("id")]
    )


def rates_for_booking(rates: DataFrame) -> DataFrame:
    """One rate per section for new invoices: the newest row of the preferred payee."""
    chosen = first_per_key(
        _applicable(rates).filter(F.col("section_code") != ""),
        ["section_code"],
        [payee_rank(F.col("payee_type")), F.col("effective_from").desc(), F.col("id")],
    )
    return chosen.select("section_code", "tds_rate")


def _as_listed(rates: DataFrame) -> DataFrame:
    return rates.select(
        F.col("id").alias("gl_code"),
        F.col("section_code").alias("tds_section"),
        F.coalesce(F.nullif("sub_code", F.lit("")), F.lit(NO_VALUE)).alias("sub_code"),
        "tds_rate", "surcharge_pct", "cess_pct",
        F.coalesce(F.nullif("appln_form", F.lit("")), F.lit(NO_VALUE)).alias("appln_form"),
        F.coalesce(F.nullif("payee_type", F.lit("")), F.lit("ALL")).alias("applicable_to"),
        F.col("description").alias("tds_description"),
        F.coalesce(day_text(F.col("effective_from")), F.lit(NO_VALUE)).alias("eff_from_date"),
    )


def rate_list(rates: DataFrame, entity: str = "") -> DataFrame:
    rows = rates.filter("is_active")
    if entity and entity.upper() != "ALL":
        rows = rows.filter(code_of(F.col("payee_type")) == entity.upper())
    return _as_listed(rows)


def customer_rates(rates: DataFrame, books: DataFrame, cust_id: int) -> DataFrame:
    """Active rates of the sections a customer was invoiced under."""
    used = books.filter(F.col("cust_id") == cust_id).select(code_of(F.col("tds_section")).alias("_used"))
    rows = rates.filter("is_active").join(used, code_of(F.col("section_code")) == F.col("_used"), "left_semi")
    return _as_listed(rows.orderBy("section_code", "payee_type", "id"))


def tcs_list(codes: DataFrame, entity: str = "", fin_year: str = "", quarter: str = "") -> DataFrame:
    rows = codes
    if entity and entity.upper() != "ALL":
        rows = rows.filter(F.trim("applicable_to") == entity)
    if fin_year:
        rows = rows.filter(F.col("fin_year") == fin_year)
    if quarter and quarter.upper() != "ALL":
        rows = rows.filter(F.col("quarter") == quarter)
    return rows


def rate_verify(rates: DataFrame) -> DataFrame:
    ordered = rates.orderBy(
        F.col("is_resident").desc(), "section_code", F.col("sub_code").asc_nulls_first(), "id"
    )
    return ordered.select(
        "section_code", "sub_code",
        F.when(F.col("is_resident"), "Resident").otherwise("Non-Resident").alias("residency"),
        "payee_type", "tds_rate", "threshold_limit", "is_active",
    )


def rate_count(rates: DataFrame) -> DataFrame:
    return rates.agg(F.count(F.lit(1)).alias("total_sections"))
