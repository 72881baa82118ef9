"""Header names of uploaded tables, resolved once per schema, never per row."""

from __future__ import annotations

from collections.abc import Sequence

# Accepted column names, in the order they are tried.
LEDGER_COLUMNS = {
    "code": ["customer_code", "cust_code", "code"],
    "name": ["customer_name", "cust_name", "name"],
    "pan": ["pan"],
    "tan": ["tan"],
    "doc_number": ["document_no", "doc_number", "invoice_no", "doc_no"],
    "doc_date": ["document_date", "doc_date", "date", "invoice_date"],
    "doc_type": ["document_type", "doc_type", "type"],
    "taxable": ["taxable_amount", "taxable_amt", "taxable"],
    "tax": ["tax_amount", "tax_amt", "tax"],
    "gross": ["gross_amount", "gross_amt", "gross"],
    "section": ["tds_section", "section_code", "section", "sec"],
    "source": ["entry_source", "source"],
}
CUSTOMER_COLUMNS = {
    "code": ["code"],
    "name": ["name"],
    "pan": ["pan"],
    "gstin": ["gstin", "gst"],
    "tan": ["tan"],
    "status": ["status"],
    "contact": ["contact", "phone", "mobile"],
}
SALES_REGISTER_HEADERS = {
    "voucher_no", "voucher_number", "voucher_type",
    "ledger", "ledger_name", "narration",
    "debit", "credit", "debit_amount", "credit_amount",
    "tally", "particulars", "vch_no",
}


def normalise_header(name: str) -> str:
    return name.replace("﻿", "").strip().lower().replace(" ", "_")


def normalise_headers(names: Sequence[str]) -> list[str]:
    """Unnamed and repeated headers get a positional name, so none is lost
    or made ambiguous."""
    seen: set[str] = set()
    out = []
    for i, raw in enumerate(names):
        name = normalise_header(raw or "")
        if not name or name in seen:
            name = f"col{i}"
        seen.add(name)
        out.append(name)
    return out


def resolve(columns: Sequence[str], aliases: Sequence[str]) -> str | None:
    """Exact name first, then a name that contains the alias as whole words:
    ``pan`` is found in ``pan_number`` but not in ``company_name``."""
    for alias in aliases:
        if alias in columns:
            return alias
    for alias in aliases:
        words = alias.split("_")
        for name in columns:
            parts = name.split("_")
            if any(parts[i : i + len(words)] == words for i in range(len(parts))):
                return name
    return None


def is_sales_register(columns: Sequence[str]) -> bool:
    return bool(SALES_REGISTER_HEADERS & set(columns))
