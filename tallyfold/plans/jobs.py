"""Upload jobs: files in, stored tables changed, ledger and audit rows appended.

Each job stages its classified rows once and derives everything else from the
stage. Stored tables are read by path, so a job that is repeated after a
failure finds the file's hash only if its ledger row, written last, is there.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.identifiers import key_of
from tallyfold.operators.joins import lookup_join
from tallyfold.operators.keyed import assign_ids
from tallyfold.plans import ingest
from tallyfold.plans.journal import Journal, append_absent, step
from tallyfold.plans.assess import reassess_tax
from tallyfold.plans.audit import override_event
from tallyfold.plans.overrides import valid_overrides
from tallyfold.plans.uploads import FAILED, ledger_rows, new_files
from tallyfold.sources import landing, statement_files
from tallyfold.sources.file_digest import file_digests
from tallyfold.sources.warehouse import Store, stage

SYSTEM_USER = "system"


def _now() -> Column:
    return F.lit(datetime.now(UTC).replace(tzinfo=None))


def fresh_files(store: Store, paths: Sequence[str]) -> DataFrame:
    """Files of the upload that are not in the ledger. A file is hashed in
    ordered pieces of lines read in splits (``file_digest``), never as one
    cell, so its size is not bounded by a task's memory."""
    hashed = file_digests(store.spark, paths).select("file_id", "path", "size_bytes", "file_hash")
    return admit(store, hashed)


def admit(store: Store, files: DataFrame) -> DataFrame:
    """Files (path, file_id, file_hash, size_bytes) not in the ledger, with the
    upload id their ledger row will have."""
    new = new_files(files, store.read("file_uploads_log"), ["path"])
    return stage(
        assign_ids(new, ["file_hash"], "upload_id", store.max_id("file_uploads_log", "upload_id")), "fresh-files"
    )


def _paths(files: DataFrame) -> list[str]:
    """The upload's file names; one upload names its files one by one."""
    return [r[0] for r in files.select("path").collect()]


def _log_frames(store: Store, files: DataFrame, counts: DataFrame, module: str, event: DataFrame) -> dict[str, DataFrame]:
    """Audit rows with their ids and ledger rows, as they will be stored."""
    now = _now()
    events = stage(event.withColumn("_n", F.monotonically_increasing_id()), "events")
    audit = assign_ids(events, ["_n"], "log_id", store.max_id("audit_logs", "log_id")).withColumns(
        {"timestamp": now, "user_name": F.lit(SYSTEM_USER), "ip_address": F.lit("unknown")}
    )
    rows = ledger_rows(files, counts, module)
    return {
        "audit": audit.select(*store.schemas["audit_logs"].names),
        "ledger": rows.withColumns({"uploaded_by": F.lit(SYSTEM_USER), "uploaded_at": now}).select(
            *store.schemas["file_uploads_log"].names
        ),
    }


def _journalled(store: Store, module: str, files: DataFrame, frames: dict[str, DataFrame], steps: list[str]) -> None:
    """Record the upload's intent with everything it writes, then write it step
    by step (see ``journal``)."""
    said = sorted(f"{r[0]}:{r[1]}" for r in files.select("upload_id", "file_hash").collect())
    journal = Journal(store)
    journal.run(journal.begin(Journal.key_of(module, said), module, frames, steps))


def recover(store: Store) -> int:
    """Finish the uploads that a dead job left; every upload job starts so."""
    return Journal(store).recover()


@step("income_records")
def _(store: Store, f: dict[str, DataFrame]) -> None:
    store.replace_by_key("income_records", f["accepted"], ingest.BOOK_KEY)


@step("unreferenced_entries")
def _(store: Store, f: dict[str, DataFrame]) -> None:
    store.replace_by_key("unreferenced_entries", f["entries"], ["upload_id"])


@step("form26as_records")
def _(store: Store, f: dict[str, DataFrame]) -> None:
    append_absent(store, "form26as_records", f["statement"], "record_id")


@step("cust_master")
def _(store: Store, f: dict[str, DataFrame]) -> None:
    store.merge("cust_master", f["delta"], ["cust_id"], CUSTOMER_ATTRIBUTES)


@step("reassess")
def _(store: Store, f: dict[str, DataFrame]) -> None:
    reassess_customers(store, f["reassess"])


@step("audit_logs")
def _(store: Store, f: dict[str, DataFrame]) -> None:
    append_absent(store, "audit_logs", f["audit"], "log_id")


@step("file_uploads_log")
def _(store: Store, f: dict[str, DataFrame]) -> None:
    append_absent(store, "file_uploads_log", f["ledger"], "upload_id")


CUSTOMER_ATTRIBUTES = ["cust_name", "tan_number", "gstin_number", "cust_status", "contact"]
LOG_STEPS = ["audit_logs", "file_uploads_log"]


def reassess_customers(store: Store, whose: DataFrame) -> None:
    """Reassess the invoices of some customers and years (cust_id, fin_year) in
    place. Limits are per customer, year and section, so the partitions that
    hold these customers are read and rewritten, and no others."""
    touched = stage(store.partitions_of("income_records", whose.dropna(subset=["cust_id", "fin_year"])), "reassessed")
    years = [r[0] for r in touched.select("fin_year").distinct().collect()]
    if not years:
        return
    done = reassess_tax(
        store.in_partitions("income_records", touched).select(*store.schemas["income_records"].names),
        store.read("cust_master"),
        store.read("form26as_records").filter(F.col("fin_year").isin(years)),
        store.read("tds_codes_master"),
    )
    store.replace_partitions("income_records", done)


def ingest_books(store: Store, paths: Sequence[str], fin_year: str = "") -> DataFrame:
    """Ledger text files to stored invoices; counts per file."""
    recover(store)
    files = fresh_files(store, paths)
    fresh = _paths(files)
    frames = landing.read_books_delimited(store.spark, fresh) if fresh else []
    return _store_books(store, files, frames, fin_year)


def ingest_books_table(store: Store, sheet: DataFrame, files: DataFrame, fin_year: str = "") -> DataFrame:
    """The same for a landed sheet (file_id, line_no, columns) whose files'
    hashes are given: file_id, file_hash, size_bytes, path."""
    recover(store)
    fresh = admit(store, files)
    wanted = sheet.join(fresh.select("file_id"), "file_id", "left_semi")
    return _store_books(store, fresh, [landing.read_books_table(wanted)], fin_year)


def _store_books(store: Store, files: DataFrame, frames: list[DataFrame], fin_year: str) -> DataFrame:
    empty = "file_id string, inserted long, refreshed long, unmatched long, rejected long, skipped long, rows_imported long"
    if not frames:
        return store.spark.createDataFrame([], empty)
    ledger = ingest.normalise_ledger(frames[0])
    for frame in frames[1:]:
        ledger = ledger.unionByName(ingest.normalise_ledger(frame))
    ledger = stage(ledger, "parsed-ledger")
    classified = stage(
        ingest.classify_ledger(ledger, store.read("cust_master"), store.read("tds_codes_master")), "ledger"
    )
    years = ingest.ledger_years(classified.select(*landing.META, "doc_date"))
    if fin_year:
        years = years.withColumn("fin_year", F.lit(fin_year))
    failed = F.when(F.col("fin_year").isNull(), FAILED)
    years = stage(years.withColumn("upload_status", failed), "years")
    # A file without any date is logged as failed; the others go on.
    classified = classified.join(years.filter(F.col("upload_status") == FAILED), "file_id", "left_anti")
    counts = stage(ingest.book_counts(classified, store.read("income_records")), "counts")
    ref = F.lit(f"BOOKS-{uuid.uuid4().hex[:8].upper()}")
    accepted = stage(
        ingest.accepted_books(classified, ref, store.max_id("income_records", "income_id")), "accepted"
    )
    unmatched = ingest.unmatched_entries(classified, ref, years)
    numbered = assign_ids(unmatched, landing.META, "unref_id", store.max_id("unreferenced_entries", "unref_id"))
    # Keyed by upload: a job that is run again replaces its own rows.
    entries = lookup_join(numbered, files.select("file_id", "upload_id"), ["file_id"])
    logs = _log_frames(store, files, years.join(counts, "file_id", "left"), "books_of_accounts", ingest.books_event(counts, years))
    frames = {"accepted": accepted, "entries": entries, "reassess": accepted.select("cust_id", "fin_year"), **logs}
    steps = ["income_records", "unreferenced_entries", "reassess", *LOG_STEPS]
    _journalled(store, "books_of_accounts", files, frames, steps)
    return counts


def ingest_statement_text(store: Store, paths: Sequence[str], fy_mode: str = "per_row") -> DataFrame:
    """Statement text files to stored credits; counts per file."""
    recover(store)
    files = fresh_files(store, paths)
    fresh = _paths(files)
    if not fresh:
        return store.spark.createDataFrame([], "file_id string, parsed long, inserted long, skipped long, rows_imported long")
    parsed = statement_files.parse_statement_text(landing.read_lines(store.spark, fresh))
    return store_statement(store, files, parsed, fy_mode)


def store_statement(store: Store, files: DataFrame, parsed: DataFrame, fy_mode: str = "per_row") -> DataFrame:
    """Parsed transactions of any layout to stored credits."""
    parsed = stage(parsed, "parsed")
    years = stage(ingest.statement_years(parsed), "years")
    classified = stage(ingest.classify_statement(parsed, store.read("cust_master"), fy_mode), "statement")
    fresh = stage(ingest.new_statement_rows(classified, store.read("form26as_records")), "new-statement")
    counts = stage(ingest.statement_counts(classified, fresh), "counts")
    statement = ingest.statement_rows(fresh, store.max_id("form26as_records", "record_id"))
    said = classified.filter(F.col("outcome") == "accepted").select(key_of(F.col("tan_of_deductor")).alias("tan"), "fin_year").distinct()
    owners = store.read("cust_master").select("cust_id", key_of(F.col("tan_number")).alias("tan"))
    logs = _log_frames(store, files, counts.join(years, "file_id"), "form26as", ingest.statement_event(counts, years))
    frames = {"statement": statement, "reassess": said.join(owners, "tan").select("cust_id", "fin_year"), **logs}
    _journalled(store, "form26as", files, frames, ["form26as_records", "reassess", *LOG_STEPS])
    return counts


def ingest_customers(store: Store, sheet: DataFrame, files: DataFrame) -> DataFrame:
    """A landed customer sheet (file_id, line_no, columns) to the master; counts per file."""
    recover(store)
    fresh = admit(store, files)
    wanted = sheet.join(fresh.select("file_id"), "file_id", "left_semi")
    known = store.read("cust_master")
    rows = ingest.normalise_customers(landing.read_books_table(wanted))
    classified = stage(ingest.classify_customers(rows, known), "customers")
    changes = ingest.customer_changes(classified, known, store.max_id("cust_master", "cust_id"))
    counts = stage(ingest.customer_counts(classified, known), "counts")
    delta = changes.updated.unionByName(changes.inserted)
    nothing = F.lit(None).cast("string")
    logs = _log_frames(
        store, fresh, counts.withColumns({"fin_year": nothing, "quarter": nothing}), "customer_master",
        ingest.customers_event(counts),
    )
    _journalled(store, "customer_master", fresh, {"delta": delta, **logs}, ["cust_master", *LOG_STEPS])
    return counts


def set_overrides(store: Store, changes: DataFrame, order: list[str]) -> None:
    """Manual statuses: upsert, and one audit row each."""
    valid = stage(valid_overrides(changes, order).withColumn("updated_at", _now()), "overrides")
    store.merge(
        "recon_overrides", valid, ["cust_id", "fin_year"], ["manual_status", "remarks", "updated_at"]
    )
    events = stage(override_event(valid).withColumn("_n", F.monotonically_increasing_id()), "events")
    audit = assign_ids(events, ["_n"], "log_id", store.max_id("audit_logs", "log_id"))
    store.append(
        "audit_logs",
        audit.withColumns(
            {"timestamp": _now(), "user_name": F.lit(SYSTEM_USER), "ip_address": F.lit("unknown")}
        ),
    )
