"""Customer master reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.identifiers import CUSTOMER_STATUSES, contains_any

COLUMNS = [
    "cust_id", "cust_code", "cust_name", "pan_number",
    "gstin_number", "tan_number", "cust_status", "contact",
]
EXPORT_NAMES = {
    "cust_code": "Customer Code",
    "cust_name": "Customer Name",
    "pan_number": "PAN",
    "gstin_number": "GSTIN",
    "tan_number": "TAN",
    "cust_status": "Status",
    "contact": "Contact",
}


def customer_stats(customers: DataFrame) -> DataFrame:
    return customers.agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.count_if(F.col("cust_status") == "active").alias("active_customers"),
        F.count_if(F.col("cust_status") == "inactive").alias("inactive_customers"),
        F.countDistinct("tan_number").alias("total_tans"),
    )


def customer_search(customers: DataFrame, search: str = "", status: str = "") -> DataFrame:
    """Contains-search over name, PAN, GSTIN, TAN and code; other statuses than
    the two known ones do not filter. Page it by ``cust_name, cust_id``."""
    found = customers
    if search.strip():
        wanted = ["cust_name", "pan_number", "gstin_number", "tan_number", "cust_code"]
        found = found.filter(contains_any(search.strip(), *[F.col(c) for c in wanted]))
    if status.strip().lower() in CUSTOMER_STATUSES:
        found = found.filter(F.col("cust_status") == status.strip().lower())
    return found.select(*COLUMNS)


def customer_by_id(customers: DataFrame, cust_id: int) -> DataFrame:
    return customers.filter(F.col("cust_id") == cust_id).select(*COLUMNS)


def customer_export(customers: DataFrame, search: str = "", status: str = "") -> DataFrame:
    found = customer_search(customers, search, status).orderBy("cust_name", "cust_id")
    return found.select(*[F.col(c).alias(name) for c, name in EXPORT_NAMES.items()])
