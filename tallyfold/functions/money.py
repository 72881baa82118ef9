"""Money: parsing, repair, sums and ratios in exact decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(15,2)"
MONEY_SUM = "decimal(25,2)"

# Signs dropped from amounts, and the amount format of statements.
AMOUNT_SIGNS = "[,₹]"
STATEMENT_AMOUNT = r"^\d+\.\d{2}$"
STATEMENT_AMOUNT_SIGNED = r"^-?\d+\.\d{2}$"


def zero() -> Column:
    return F.lit(0).cast(MONEY)


def as_money(col: Column) -> Column:
    return col.cast(MONEY)


def or_zero(col: Column) -> Column:
    return F.coalesce(col, F.lit(0).cast(MONEY_SUM)).cast(MONEY_SUM)


def money_sum(col: Column) -> Column:
    return or_zero(F.sum(col))


def parse_money(col: Column) -> Column:
    """Thousands separators and the rupee sign are dropped; anything that is
    still not a number counts as zero."""
    digits = F.trim(F.regexp_replace(F.coalesce(col, F.lit("")), AMOUNT_SIGNS, ""))
    return F.coalesce(F.round(digits.try_cast("decimal(20,6)"), 2).try_cast(MONEY), zero())


def number_or_null(col: Column) -> Column:
    return F.round(F.trim(col).try_cast("decimal(20,6)"), 2).try_cast(MONEY)


def statement_amounts(line: Column, signed: bool = False) -> Column:
    """All plain amounts of a statement line, in order."""
    form = STATEMENT_AMOUNT_SIGNED if signed else STATEMENT_AMOUNT
    tokens = F.split(F.replace(line, F.lit(","), F.lit("")), " ")
    return F.filter(tokens, lambda t: t.rlike(form))


def repaired_gross(taxable: Column, tax: Column, gross: Column) -> Column:
    return as_money(F.when(gross == 0, taxable + tax).otherwise(gross))


def repaired_taxable(taxable: Column, tax: Column, gross: Column) -> Column:
    """``gross`` is the repaired one."""
    rest = F.greatest(gross - tax, zero())
    return as_money(F.when((taxable == 0) & (gross > 0), rest).otherwise(taxable))


def percent_of(amount: Column, rate: Column) -> Column:
    """round(amount * rate / 100, 2), kept in decimals by scaling instead of dividing."""
    hundredth = F.lit("0.01").cast("decimal(3,2)")
    return F.round(amount * rate * hundredth, 2).cast(MONEY)


def pct_credit(credit: Column, tax: Column) -> Column:
    share = F.round(F.try_divide(credit, tax) * 100, 2).cast("decimal(18,2)")
    return F.when(tax == 0, F.lit(0).cast("decimal(18,2)")).otherwise(share)


def ratio_pct(part: Column, whole: Column) -> Column:
    """Percentage with four decimals: the quotient is kept to six places."""
    return (F.round(F.try_divide(part, whole), 6) * 100).cast("decimal(20,4)")


def size_kb(n_bytes: Column) -> Column:
    per_byte = F.lit("0.0009765625").cast("decimal(11,10)")
    return F.round(n_bytes.cast("decimal(15,0)") * per_byte, 2).cast("decimal(10,2)")
