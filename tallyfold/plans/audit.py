"""Audit trail: search, cards, export and new events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.dates import between_days, second_text
from tallyfold.functions.identifiers import NO_VALUE, code_of, contains_any, includes_any

COLUMNS = [
    "log_id", "timestamp", "user_name", "action_type",
    "module_name", "description", "severity_level", "ip_address",
]
EXPORT_NAMES = {
    "log_id": "Log ID",
    "timestamp": "Timestamp",
    "user_name": "User",
    "action_type": "Action",
    "module_name": "Module",
    "description": "Description",
    "severity_level": "Severity",
    "ip_address": "IP Address",
}


def audit_search(
    logs: DataFrame,
    search: str = "",
    action: str = "",
    module: str = "",
    severity: str = "",
    date_from: str = "",
    date_to: str = "",
) -> DataFrame:
    """Newest first; timestamps as text, a dash where there is none."""
    rows = logs.filter(between_days(F.col("timestamp"), date_from or None, date_to or None))
    for column, wanted in (("action_type", action), ("module_name", module), ("severity_level", severity)):
        if wanted and wanted.upper() != "ALL":
            rows = rows.filter(code_of(F.col(column)) == wanted.upper())
    if search:
        wanted_in = [F.col(c) for c in ("description", "user_name", "module_name")]
        rows = rows.filter(contains_any(search, *wanted_in))
    shown = F.coalesce(second_text(F.col("timestamp")), F.lit(NO_VALUE)).alias("timestamp")
    ordered = rows.orderBy(F.col("timestamp").desc(), F.col("log_id").desc())
    return ordered.select(*[shown if c == "timestamp" else F.col(c) for c in COLUMNS])


def audit_inline_search(logs: DataFrame, text: str) -> DataFrame:
    if not text:
        return logs
    wanted = [F.col(c) for c in ("description", "user_name", "module_name", "action_type")]
    return logs.filter(includes_any(text, *wanted))


def audit_cards(logs: DataFrame) -> DataFrame:
    def of(level: str) -> Column:
        return F.count_if(F.col("severity_level") == level)

    return logs.agg(
        F.count(F.lit(1)).alias("total"),
        of("INFO").alias("info"),
        of("WARNING").alias("warning"),
        of("CRITICAL").alias("critical"),
    )


def audit_export(logs: DataFrame) -> DataFrame:
    return logs.select(*[F.col(c).alias(n) for c, n in EXPORT_NAMES.items()])


def upload_event(module: str, description: Column) -> list[Column]:
    """Columns of one audit row for a finished upload."""
    return [
        F.lit("UPLOAD").alias("action_type"),
        F.lit(module).alias("module_name"),
        description.alias("description"),
        F.lit("INFO").alias("severity_level"),
    ]


def override_event(overrides: DataFrame) -> DataFrame:
    """One audit row per manual status set."""
    year = F.when(F.coalesce("fin_year", F.lit("")) == "", "not provided").otherwise(F.col("fin_year"))
    text = F.concat(
        F.lit("Status changed to "), F.col("manual_status"),
        F.lit(" | cust_id="), F.col("cust_id").cast("string"), F.lit(" | FY="), year,
    )
    return overrides.select(
        F.lit("UPDATE").alias("action_type"),
        F.lit("RECONCILIATION").alias("module_name"),
        text.alias("description"),
        F.lit("INFO").alias("severity_level"),
    )
