"""Tax identifiers, section codes and other coded text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Identifier formats, section formats, label phrases and codes.
PAN_FORMAT = r"^[A-Z]{5}[0-9]{4}[A-Z]$"
TAN_FORMAT = r"^[A-Z]{4}[0-9]{5}[A-Z]$"
TAN_IN_TEXT = r"\b([A-Z]{4}[0-9]{5}[A-Z])\b"
BEFORE_TAN = f"^(.*?){TAN_IN_TEXT}"
SPLIT_TAN = r"([A-Z]{4}[0-9]{1,4})\s+([0-9]{1,4}[A-Z])\b"
SECTION_IN_TEXT = r"\b(192|194[A-Za-z]?|193|195|206[A-Za-z]?)\b"
SECTION_IN_TEXT_EXTENDED = r"\b(192[A-Za-z]?|194[A-Za-z]{0,3}|193|195|206[A-Za-z]{0,2})\b"
DEDUCTOR_LABELS = ["Name of Deductor", "Deductor Name", "TAN of Deductor", ":", "-", "—"]
UNKNOWN_DEDUCTOR = "Unknown Deductor"
UNKNOWN_CUSTOMER = "Unknown Customer"
NO_VALUE = "—"
BLANK_SECTION_MARKS = ["—", "-", "NONE", ""]
DOC_TYPES = {
    "invoice": "invoice",
    "inv": "invoice",
    "sales": "invoice",
    "bill": "invoice",
    "credit_note": "credit_note",
    "credit note": "credit_note",
    "cn": "credit_note",
    "debit_note": "debit_note",
    "debit note": "debit_note",
    "dn": "debit_note",
    "advance": "advance",
    "adv": "advance",
    "other": "other",
    "others": "other",
}
CUSTOMER_STATUSES = ["active", "inactive"]


def key_of(col: Column) -> Column:
    """Join key of an identifier or name: case and outer spaces do not count."""
    return F.lower(F.trim(col))


def code_of(col: Column) -> Column:
    return F.upper(F.trim(col))


def text_or_blank(col: Column) -> Column:
    return F.trim(F.coalesce(col.cast("string"), F.lit("")))


def blank_to_null(col: Column) -> Column:
    return F.nullif(F.trim(col), F.lit(""))


def is_valid_pan(col: Column) -> Column:
    return F.coalesce(code_of(col).rlike(PAN_FORMAT), F.lit(False))


def is_valid_tan(col: Column) -> Column:
    return F.coalesce(code_of(col).rlike(TAN_FORMAT), F.lit(False))


def repair_split_tan(line: Column) -> Column:
    """Rejoin a TAN that text extraction broke in two: ``PWYC7918 3E``."""
    return F.regexp_replace(line, SPLIT_TAN, "$1$2")


def tan_in(line: Column) -> Column:
    return blank_to_null(F.regexp_extract(line, TAN_IN_TEXT, 1))


def without_labels(name: Column) -> Column:
    for label in DEDUCTOR_LABELS:
        name = F.replace(name, F.lit(label), F.lit(""))
    return F.coalesce(blank_to_null(name), F.lit(UNKNOWN_DEDUCTOR))


def deductor_name_before_tan(line: Column) -> Column:
    """Text in front of the first TAN without the label phrases."""
    return without_labels(F.regexp_extract(line, BEFORE_TAN, 1))


def section_in(line: Column, extended: bool = False) -> Column:
    pattern = SECTION_IN_TEXT_EXTENDED if extended else SECTION_IN_TEXT
    return blank_to_null(F.upper(F.regexp_extract(line, pattern, 1)))


def blank_section(col: Column) -> Column:
    """Section as booked: a dash for everything that means 'none given'."""
    code = F.coalesce(code_of(col), F.lit(""))
    return F.when(code.isin(BLANK_SECTION_MARKS), NO_VALUE).otherwise(code)


def is_unsectioned(col: Column) -> Column:
    return col.isNull() | (col == NO_VALUE)


def tax_category(section: Column) -> Column:
    return F.when(section.startswith("206"), "TCS").otherwise("TDS")


def document_type(col: Column) -> Column:
    pairs = [F.lit(x) for item in DOC_TYPES.items() for x in item]
    known = F.create_map(*pairs)
    return F.coalesce(F.try_element_at(known, key_of(F.coalesce(col, F.lit("")))), F.lit("invoice"))


def customer_status(col: Column) -> Column:
    status = key_of(F.coalesce(col, F.lit("")))
    return F.when(status.isin(CUSTOMER_STATUSES), status).otherwise("active")


def unmatched_reason(tan: Column, pan: Column) -> Column:
    return (
        F.when(F.coalesce(tan, F.lit("")) != "", "no_tan")
        .when(F.coalesce(pan, F.lit("")) != "", "no_pan")
        .otherwise("no_customer")
    )


def contains_any(needle: str, *cols: Column) -> Column:
    """Whether any of the columns matches SQL's ``LIKE '%needle%'``, without
    regard to case; ``%`` and ``_`` in the needle are wildcards, a backslash is
    itself."""
    pattern = "%" + needle.replace("\\", "\\\\") + "%"
    found = F.lit(False)
    for col in cols:
        found = found | F.coalesce(col.ilike(pattern), F.lit(False))
    return found


def includes_any(needle: str, *cols: Column) -> Column:
    """Whether any of the columns holds the needle as it stands, without regard
    to case."""
    found = F.lit(False)
    for col in cols:
        found = found | F.coalesce(F.contains(F.lower(col), F.lower(F.lit(needle))), F.lit(False))
    return found


def file_extension(name: Column) -> Column:
    return F.lower(F.substring_index(name, ".", -1))
