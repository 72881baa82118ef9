"""Upload ledger: history, duplicate files, new ledger rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.dates import minute_text
from tallyfold.functions.identifiers import file_extension
from tallyfold.functions.money import size_kb
from tallyfold.operators.keyed import first_per_key

FAILED = "failed"


def upload_history(uploads: DataFrame, module: str = "", fin_year: str = "") -> DataFrame:
    rows = uploads
    if module:
        rows = rows.filter(F.lower("module_name") == module.lower())
    if fin_year:
        rows = rows.filter(F.col("fin_year") == fin_year)
    return rows.orderBy(F.col("upload_id").desc()).select(
        file_extension(F.col("file_name")).alias("file_ext"),
        F.col("file_name").alias("orig_filename"),
        F.col("module_name").alias("upload_module"),
        "fin_year",
        F.col("quarter").alias("quarter_ref"),
        "file_size_kb",
        F.col("upload_status").alias("parse_status"),
        F.col("rows_imported").alias("row_count_total"),
        F.col("uploaded_by").alias("uploaded_by_name"),
        minute_text(F.col("uploaded_at")).alias("uploaded_at"),
    )


def upload_history_bi(uploads: DataFrame) -> DataFrame:
    return uploads.select(
        "upload_id", "module_name", "fin_year", "quarter", "file_name", "file_size_kb",
        "rows_imported", "upload_status", "uploaded_by", "uploaded_at", "file_hash",
        F.to_date("uploaded_at").alias("upload_date"),
        F.hour("uploaded_at").alias("upload_hour"),
    )


def hash_of(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def new_files(files: DataFrame, ledger: DataFrame, order: list[str]) -> DataFrame:
    """Files whose content is not in the ledger, or only as a failed upload; of
    equal files in the batch the first by ``order``. Needs ``file_hash`` on
    both sides."""
    done = ledger.filter(F.col("upload_status") != FAILED) if "upload_status" in ledger.columns else ledger
    unseen = files.join(done.select("file_hash").distinct(), "file_hash", "left_anti")
    return first_per_key(unseen, ["file_hash"], [F.col(c) for c in order])


def ledger_rows(files: DataFrame, counts: DataFrame, module: str) -> DataFrame:
    """One upload-ledger row per file: ``files`` has upload_id, file_id,
    file_hash, size_bytes; ``counts`` has file_id, fin_year, quarter,
    rows_imported, and upload_status where files may have failed. Files are told
    apart by their path; the ledger shows their name."""
    status = F.coalesce("upload_status", F.lit("success")) if "upload_status" in counts.columns else F.lit("success")
    return files.join(counts, "file_id", "left").select(
        "upload_id",
        F.element_at(F.split("file_id", "/"), -1).alias("file_name"),
        "file_hash",
        "fin_year",
        "quarter",
        size_kb(F.col("size_bytes")).alias("file_size_kb"),
        status.alias("upload_status"),
        F.coalesce("rows_imported", F.lit(0)).cast("long").alias("rows_imported"),
        F.lit(module).alias("module_name"),
    )
