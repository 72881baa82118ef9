"""Tax reassessment of invoices from rate table, statement sections and annual limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.functions.identifiers import (
    NO_VALUE,
    code_of,
    is_unsectioned,
    is_valid_pan,
    key_of,
)
from tallyfold.functions.money import percent_of
from tallyfold.operators.joins import lookup_join
from tallyfold.plans.rates import rates_for_assessment
from tallyfold.sources.warehouse import stage

# Fixed value: least base rate, in percent, without a valid PAN.
NO_PAN_RATE = 20
RATE = "decimal(12,6)"


def customer_sections(customers: DataFrame, statement: DataFrame) -> DataFrame:
    """Distinct customer, year and section the statement names, with the PAN."""
    named = (
        statement.filter(
            F.col("section_code").isNotNull() & ~F.col("section_code").isin(["", NO_VALUE, "-"])
        )
        .select(
            key_of(F.col("tan_of_deductor")).alias("tan_key"),
            "fin_year",
            code_of(F.col("section_code")).alias("section_code"),
        )
        .distinct()
    )
    who = customers.select("cust_id", "pan_number", key_of(F.col("tan_number")).alias("tan_key"))
    return named.join(who, "tan_key").select("cust_id", "pan_number", "fin_year", "section_code").distinct()


def effective_rates(customers: DataFrame, statement: DataFrame, rates: DataFrame) -> DataFrame:
    """Rate and limit per customer, year and statement section that has a rate."""
    chosen = rates_for_assessment(rates).select(
        "section_code", "tds_rate", "surcharge_pct", "cess_pct", "threshold_limit"
    )
    base = F.coalesce("tds_rate", F.lit(0).cast("decimal(6,3)"))
    least = F.lit(NO_PAN_RATE).cast("decimal(6,3)")
    base = F.when(is_valid_pan(F.col("pan_number")), base).otherwise(F.greatest(base, least))
    hundredth = F.lit("0.01").cast("decimal(3,2)")
    loaded = (
        base
        * (1 + F.coalesce("surcharge_pct", F.lit(0).cast("decimal(5,2)")) * hundredth)
        * (1 + F.coalesce("cess_pct", F.lit(0).cast("decimal(5,2)")) * hundredth)
    )
    return (
        customer_sections(customers, statement)
        .join(chosen, "section_code")
        .select("cust_id", "fin_year", "section_code", loaded.cast(RATE).alias("rate"), "threshold_limit")
    )


def _booked_section():
    return F.when(is_unsectioned(F.col("tds_section")), NO_VALUE).otherwise(code_of(F.col("tds_section")))


def annual_taxable(books: DataFrame) -> DataFrame:
    """Taxable sum and invoice count per customer, year and booked section:
    one partial aggregation, never a window over a customer's invoices."""
    return books.groupBy("cust_id", "fin_year", _booked_section().alias("booked")).agg(
        F.sum("taxable_amt").alias("taxable"), F.count(F.lit(1)).alias("n")
    )


def treatments(annual: DataFrame, rated: DataFrame) -> DataFrame:
    """How every (customer, year, booked section) is taxed, settled on grouped
    rows. Unsectioned invoices are claimed by the customer's lowest rated
    section of the year and count towards that section's annual sum.

    Both windows run over grouped rows: the first over a customer's rated
    sections of a year, the second over at most two booked sections.
    """
    lowest = F.min("section_code").over(Window.partitionBy("cust_id", "fin_year"))
    claims = rated.withColumn("_lowest", lowest).withColumn(
        "booked",
        F.explode(
            F.when(F.col("section_code") == F.col("_lowest"), F.array(F.col("section_code"), F.lit(NO_VALUE)))
            .otherwise(F.array("section_code"))
        ),
    )
    both = claims.drop("_lowest").join(annual, ["cust_id", "fin_year", "booked"])
    section = Window.partitionBy("cust_id", "fin_year", "section_code")
    return both.withColumn("annual_taxable", F.sum("taxable").over(section))


def reassess_tax(
    books: DataFrame,
    customers: DataFrame,
    statement: DataFrame,
    rates: DataFrame,
    fin_years: list[str] | None = None,
) -> DataFrame:
    """All invoices, with tax and section set where the statement's sections
    apply: nothing below the annual limit, else the effective rate, else (a
    rate of zero) the tax of the ledger. Running it again changes nothing.
    """
    if fin_years is not None:
        inside = F.col("fin_year").isin(fin_years)
        done = reassess_tax(books.filter(inside), customers, statement.filter(inside), rates)
        return done.unionByName(books.filter(~inside))
    # Read three times below; staged, the invoices are scanned once for it.
    annual = stage(annual_taxable(books), "annual")
    limit = F.coalesce("threshold_limit", F.lit(0)).cast("decimal(20,0)")
    plan = treatments(annual, effective_rates(customers, statement, rates)).select(
        "cust_id", "fin_year", "booked",
        F.col("section_code").alias("_section"),
        F.col("rate").alias("_rate"),
        ((limit != 0) & (F.col("annual_taxable") < limit)).alias("_below"),
    )
    keys = ["cust_id", "fin_year", "booked"]
    joined = lookup_join(
        books.withColumn("booked", _booked_section()),
        plan,
        keys,
        ["income_id"],
        counts=annual.select(*keys, "n"),
    )
    tax = (
        F.when(F.col("_section").isNull(), F.col("tds_deductible"))
        .when(F.col("_below"), F.lit(0).cast("decimal(15,2)"))
        .when(F.col("_rate") > 0, percent_of(F.col("taxable_amt"), F.col("_rate")))
        .otherwise(F.col("tax_amt"))
    )
    replaced = {
        "tds_deductible": tax.alias("tds_deductible"),
        "tds_section": F.coalesce("_section", "tds_section").alias("tds_section"),
    }
    return joined.select(*[replaced.get(c, F.col(c)) for c in books.columns])
