"""Manual reconciliation statuses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.dates import clean_fiscal_year
from tallyfold.functions.identifiers import blank_to_null
from tallyfold.functions.matching import STATUSES
from tallyfold.operators.keyed import last_per_key
from tallyfold.operators.merge import merge_df


def valid_overrides(changes: DataFrame, order: list[str]) -> DataFrame:
    """Changes with a known status, one per customer and year (the last by
    ``order``), years normalised and blank remarks null."""
    cleaned = changes.withColumns(
        {
            "fin_year": F.trim(clean_fiscal_year(F.coalesce("fin_year", F.lit("")))),
            "manual_status": F.trim("manual_status"),
            "remarks": blank_to_null(F.col("remarks")),
        }
    ).filter(F.col("manual_status").isin(STATUSES))
    return last_per_key(cleaned, ["cust_id", "fin_year"], order)


def override_upsert(overrides: DataFrame, changes: DataFrame, order: list[str]) -> DataFrame:
    """New content of the override table; changes carry ``updated_at``."""
    return merge_df(
        overrides,
        valid_overrides(changes, order),
        ["cust_id", "fin_year"],
        ["manual_status", "remarks", "updated_at"],
    )
