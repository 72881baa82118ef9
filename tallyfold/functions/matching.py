"""Reconciliation verdicts from book tax B, statement credit G and gross I.

All three arguments are non-null decimals (missing sides already zero).
Ratio limits are compared as products, so no quotient is rounded on the way.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tolerance, ratio limits, status domain and default remark.
TOLERANCE = "5.00"
LIKELY_PCT = 85
SUGGESTED_PCT = 50
STATUSES = [
    "reconciled",
    "likely_match",
    "reserved",
    "suggested_match",
    "not_liable",
    "open",
    "disabled",
]
DEFAULT_REMARK = "Automated engine validation complete."
VARIANCE_EPS = "0.01"


def _within_tolerance(b: Column, g: Column) -> Column:
    return F.abs(g - b) < F.lit(TOLERANCE).cast("decimal(3,2)")


def _ratio_at_least(b: Column, g: Column, pct: int) -> Column:
    return F.least(b, g) * 100 >= F.greatest(b, g) * pct


def _by_ratio(start, b: Column, g: Column) -> Column:
    return (
        start.when(_within_tolerance(b, g), "reconciled")
        .when(g == 0, "open")
        .when(_ratio_at_least(b, g, LIKELY_PCT), "likely_match")
        .when(_ratio_at_least(b, g, SUGGESTED_PCT), "suggested_match")
        .otherwise("open")
    )


def status_of_records(b: Column, g: Column, i: Column) -> Column:
    """Verdict of the record list and the status counts: books that carry
    income but neither tax nor credit count as reconciled."""
    return _by_ratio(F.when((b == 0) & (g == 0) & (i == 0), "open"), b, g)


def status_of_view(b: Column, g: Column) -> Column:
    """Verdict of the BI view: no tax and no credit is open, whatever the income."""
    return _by_ratio(F.when((b == 0) & (g == 0), "open"), b, g)


def score_of_records(b: Column, g: Column) -> Column:
    ratio = (F.round(F.try_divide(F.least(b, g), F.greatest(b, g)), 6) * 100).cast("decimal(9,4)")
    full = F.lit(100).cast("decimal(9,4)")
    none = F.lit(0).cast("decimal(9,4)")
    return (
        F.when((b == 0) & (g == 0), full)
        .when(_within_tolerance(b, g), full)
        .when((b == 0) | (g == 0), none)
        .otherwise(ratio)
    )


def score_of_view(b: Column, g: Column) -> Column:
    ratio = F.round(F.try_divide(F.least(b, g), F.greatest(b, g)) * 100, 2).cast("decimal(9,2)")
    return F.when((b == 0) | (g == 0), F.lit(0).cast("decimal(9,2)")).otherwise(ratio)


def variance_class(v: Column) -> Column:
    """match / under (books above statement) / over; the exact ±0.01 is none of them."""
    eps = F.lit(VARIANCE_EPS).cast("decimal(3,2)")
    return F.when(F.abs(v) < eps, "match").when(v > eps, "under").when(v < -eps, "over")


def variance_sign(v: Column) -> Column:
    eps = F.lit(VARIANCE_EPS).cast("decimal(3,2)")
    return F.when(F.abs(v) < eps, "zero").when(v > 0, "neg").otherwise("pos")
