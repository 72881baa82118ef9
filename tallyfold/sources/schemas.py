"""Table schemas and the column each table is partitioned by."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.functions.identifiers import CUSTOMER_STATUSES
from tallyfold.functions.matching import STATUSES

_KINDS = {
    "long": T.LongType(),
    "int": T.IntegerType(),
    "text": T.StringType(),
    "money": T.DecimalType(15, 2),
    "sum": T.DecimalType(25, 2),
    "pct": T.DecimalType(5, 2),
    "rate": T.DecimalType(6, 3),
    "share": T.DecimalType(18, 2),
    "size": T.DecimalType(10, 2),
    "date": T.DateType(),
    "time": T.TimestampType(),
    "bool": T.BooleanType(),
}


def _schema(**columns: str) -> T.StructType:
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in columns.items()])


# Table columns.
CUSTOMERS = _schema(
    cust_id="long", cust_code="text", cust_name="text", pan_number="text",
    gstin_number="text", tan_number="text", cust_status="text", contact="text",
)
BOOKS = _schema(
    income_id="long", upload_ref="text", fin_year="text", cust_id="long", cust_name="text",
    doc_number="text", doc_date="date", doc_type="text", taxable_amt="money", tax_amt="money",
    gross_amt="money", tds_section="text", tds_rate="pct", tds_deductible="money", entry_source="text",
)
STATEMENT = _schema(
    record_id="long", fin_year="text", tan_of_deductor="text", deductor_name="text",
    section_code="text", transaction_date="date", booking_amt="money", tds_credited="money",
)
RATES = _schema(
    id="int", section_code="text", sub_code="text", description="text", payee_type="text",
    is_resident="bool", tds_rate="rate", surcharge_pct="pct", cess_pct="pct", threshold_limit="long",
    threshold_note="text", appln_form="text", effective_from="date", is_active="bool", notes="text",
)
TCS = _schema(
    id="int", cust_id="long", fin_year="text", quarter="text", gl_code="text", tcs_section="text",
    sub_code="text", tcs_rate="pct", surcharge_pct="pct", cess_pct="pct", appln_form="text",
    applicable_to="text", tcs_description="text", eff_from_date="date",
)
ADJUSTMENTS = _schema(
    adj_id="long", fin_year="text", cust_id="long", income_id="long", adj_type="text", adj_date="date",
    adj_amt="money", ref_number="text", remarks="text", upload_ref="text", created_at="time",
)
UNREFERENCED = _schema(
    unref_id="long", upload_id="long", upload_ref="text", fin_year="text", raw_identifier="text",
    doc_number="text", doc_date="date", entry_amt="money", unref_reason="text", remarks="text", resolved="bool",
)
UPLOADS = _schema(
    upload_id="long", file_name="text", file_hash="text", fin_year="text", quarter="text",
    file_size_kb="size", upload_status="text", rows_imported="long", uploaded_by="text",
    uploaded_at="time", module_name="text",
)
AUDIT = _schema(
    log_id="long", timestamp="time", user_name="text", action_type="text", module_name="text",
    description="text", severity_level="text", ip_address="text",
)
OVERRIDES = _schema(
    cust_id="long", fin_year="text", manual_status="text", remarks="text", updated_at="time",
)
MARKS = _schema(table_name="text", last_id="long", row_count="long", last_synced_at="time")

ID_MARKS = _schema(table_name="text", last_id="long")

OPERATIONAL = {
    "cust_master": CUSTOMERS,
    "income_records": BOOKS,
    "form26as_records": STATEMENT,
    "tds_codes_master": RATES,
    "tcs_codes_master": TCS,
    "adjustments": ADJUSTMENTS,
    "unreferenced_entries": UNREFERENCED,
    "file_uploads_log": UPLOADS,
    "audit_logs": AUDIT,
    "recon_overrides": OVERRIDES,
    "id_marks": ID_MARKS,
}

# Warehouse copies: the same columns, books and statement with the customer's
# identity beside them.
WAREHOUSE = {
    "cust_master": T.StructType([f for f in CUSTOMERS if f.name != "contact"]),
    "income_records": _schema(
        income_id="long", upload_ref="text", fin_year="text", cust_id="long", cust_code="text",
        cust_name="text", pan_number="text", tan_number="text", doc_number="text", doc_date="date",
        doc_type="text", taxable_amt="money", tax_amt="money", gross_amt="money", tds_section="text",
        tds_rate="pct", tds_deductible="money", entry_source="text",
    ),
    "form26as_records": _schema(
        record_id="long", fin_year="text", tan_of_deductor="text", deductor_name="text",
        section_code="text", transaction_date="date", booking_amt="money", tds_credited="money",
        cust_code="text", cust_name="text",
    ),
    "tds_summary": _schema(
        cust_id="long", cust_code="text", cust_name="text", pan_number="text", tan_number="text",
        fin_year="text", total_taxable_amt="sum", total_tds_deductible="sum", total_gross_amt="sum",
        total_26as_credit="sum", variance_amt="sum", pct_credit="share", invoice_count="long",
    ),
    "audit_logs": AUDIT,
    "sync_marks": MARKS,
    "id_marks": ID_MARKS,
}

# Partition columns of a table. ``cust_bucket`` is a hash of the customer, so
# that an upload rewrites only its customers' share of a year; ``id_block`` is
# a range of the id in IDS.
PARTITIONS = {
    "income_records": ["fin_year", "cust_bucket"],
    "form26as_records": ["fin_year"],
    "tds_summary": ["fin_year", "cust_bucket"],
    "recon_overrides": ["fin_year"],
    "unreferenced_entries": ["fin_year"],
    "adjustments": ["fin_year"],
    "file_uploads_log": ["module_name"],
    "sync_marks": ["table_name"],
    "id_marks": ["table_name"],
    "cust_master": ["id_block"],
    "audit_logs": ["id_block"],
}
IDS = {"cust_master": "cust_id", "audit_logs": "log_id"}

# Domains of coded columns.
DOMAINS = {
    "manual_status": STATUSES,
    "cust_status": CUSTOMER_STATUSES,
    "adj_type": ["credit_note", "discount", "write_off", "advance_adj", "other"],
    "unref_reason": ["no_pan", "no_tan", "no_customer", "duplicate"],
}


def outside_domains(df: DataFrame) -> DataFrame:
    """Rows with a coded column outside its domain; null is outside."""
    fault = F.lit(False)
    for column, allowed in DOMAINS.items():
        if column in df.columns:
            fault = fault | ~F.coalesce(F.col(column).isin(allowed), F.lit(False))
    return df.filter(fault)
