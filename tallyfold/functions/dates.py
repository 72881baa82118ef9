"""Dates as uploaded files write them, and the April-to-March fiscal year."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted date layouts, in the order they are tried, with the
# shape of text each can read.
DATE_LAYOUTS = {
    "yyyy-M-d": r"^\d{4}-\d{1,2}-\d{1,2}$",
    "d-M-yyyy": r"^\d{1,2}-\d{1,2}-\d{4}$",
    "d/M/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "M/d/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "d-MMM-yyyy": r"^\d{1,2}-[A-Za-z]{3}-\d{4}$",
    "yyyy/M/d": r"^\d{4}/\d{1,2}/\d{1,2}$",
}
STATEMENT_DATE_TOKEN = r"(?:^| )([0-9]{2}-[A-Za-z]{3}-[0-9]{4})(?= |$)"


def parse_any_date(col: Column) -> Column:
    """The shape is tested first: a failed parse costs an exception per row."""
    text = F.trim(col)
    tries = []
    for layout, shape in DATE_LAYOUTS.items():
        value = F.initcap(text) if "MMM" in layout else text
        tries.append(F.when(text.rlike(shape), F.try_to_date(value, layout)))
    return F.coalesce(*tries)


def statement_date(line: Column) -> Column:
    """First space-delimited dd-MMM-yyyy token of a statement line."""
    token = F.regexp_extract(line, STATEMENT_DATE_TOKEN, 1)
    return F.when(token != "", F.try_to_date(F.initcap(token), "dd-MMM-yyyy"))


def fiscal_start(date: Column) -> Column:
    return F.year(date) - F.when(F.month(date) >= 4, 0).otherwise(1)


def fiscal_year(date: Column) -> Column:
    start = fiscal_start(date)
    end = F.lpad(F.pmod(start + 1, F.lit(100)).cast("string"), 2, "0")
    return F.when(date.isNotNull(), F.concat_ws("-", start.cast("string"), end))


def fiscal_quarter(date: Column) -> Column:
    month = F.month(date)
    return (
        F.when(month.between(4, 6), "Q1")
        .when(month.between(7, 9), "Q2")
        .when(month.between(10, 12), "Q3")
        .when(month.between(1, 3), "Q4")
    )


def clean_fiscal_year(col: Column) -> Column:
    """'FY 2022-23' and '2022 - 23' both name the year 2022-23."""
    return F.regexp_replace(F.upper(col), "FY| ", "")


def fiscal_year_param(value: str) -> str:
    cleaned = value.upper().replace("FY", "").replace(" ", "").strip()
    if not cleaned:
        raise ValueError("fin_year is required")
    return cleaned


def day_text(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM-dd")


def minute_text(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM-dd HH:mm")


def second_text(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


def between_days(ts: Column, first: str | None, last: str | None) -> Column:
    """Inclusive day range as a half-open range on the raw timestamp, so that
    Parquet min/max statistics can prune."""
    keep = F.lit(True)
    if first:
        keep = keep & (ts >= F.lit(first).cast("timestamp"))
    if last:
        keep = keep & (ts < F.date_add(F.lit(last).cast("date"), 1).cast("timestamp"))
    return keep
