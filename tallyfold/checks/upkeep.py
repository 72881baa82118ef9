"""Merges, incremental sync, snapshots, streams: what a table holds afterwards.

The stored side is an earlier version derived from the given tables: some
rows missing, some with older values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.checks.ingest import CUST, CUST_TABLES, RESOLVED
from tallyfold.checks.registry import day, num, query, second
from tallyfold.checks.reports import ASSESS_SQL, ASSESS_TABLES
from tallyfold.operators.merge import changed_rows, insert_absent, merge_df
from tallyfold.plans import jobs, overrides, rates, summary, sync
from tallyfold.session import new_scratch
from tallyfold.sources import schemas, seeds, statement_files, versioned, warehouse
from tallyfold.sources.domain import DEFINITIONS, Domain
from tallyfold.sources.landing import scan_table
from tallyfold.streaming.jobs import stream_append_sync, stream_ingest_uploads

TABLES = ["cust_master", "income_records", "form26as_records", "audit_logs"]

WH_BOOKS = """
with cur as (select i.income_id, i.upload_ref, i.fin_year, i.cust_id, c.cust_code, c.cust_name, c.pan_number, c.tan_number, i.doc_number, i.doc_date, i.doc_type, i.taxable_amt, i.tax_amt, i.gross_amt,
  i.tds_section, i.tds_rate, i.tds_deductible, i.entry_source from income_records i join cust_master c on c.cust_id=i.cust_id),
old as (select * replace (cast(case when tds_section='194H' then tds_deductible+1 else tds_deductible end as decimal(15,2)) as tds_deductible, case when tds_section='194C' then 'OLD' else upload_ref end as upload_ref)
  from cur where doc_type='invoice')
"""
WH_OUT = (
    f"income_id, upload_ref, fin_year, cust_id, cust_code, cust_name, pan_number, tan_number, doc_number, {day('doc_date')}, doc_type, "
    + num("taxable_amt", "tax_amt", "gross_amt") + ", tds_section, " + num("tds_rate", "tds_deductible") + ", entry_source"
)


def _current(d: Domain) -> DataFrame:
    return sync.books_with_customer(d.income_records, d.cust_master)


def _older(books: DataFrame) -> DataFrame:
    tax = F.when(F.col("tds_section") == "194H", F.col("tds_deductible") + 1).otherwise(F.col("tds_deductible"))
    ref = F.when(F.col("tds_section") == "194C", "OLD").otherwise(F.col("upload_ref"))
    old = books.filter("doc_type = 'invoice'")
    return old.withColumns({"tds_deductible": tax.cast("decimal(15,2)"), "upload_ref": ref})


@query(
    "scan_table", ["cust_master"],
    "select c_custkey, c_name from customer where c_mktsegment='BUILDING' and c_acctbal>0",
)
def _(d: Domain):
    wanted = (F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") > 0)
    return scan_table(d.spark, f"{d.sf_dir}/customer.parquet", ["c_custkey", "c_name"], wanted)


@query(
    "max_key", TABLES, "select max(income_id) last_id from income_records",
)
def _(d: Domain):
    return d.income_records.agg(F.max("income_id").alias("last_id"))


@query(
    "changed_rows", TABLES,
    WH_BOOKS + "select c.income_id, c.fin_year from cur c join old o on o.income_id=c.income_id where abs(c.tds_deductible-o.tds_deductible)>0.001",
)
def _(d: Domain):
    changed = changed_rows(
        _current(d), _older(_current(d)), ["income_id", "fin_year"], sync.BOOK_LEGACY,
        sync.tolerances(sync.BOOK_LEGACY), {"_block": F.floor(F.col("income_id") / 1000)},
    )
    return changed.select("income_id", "fin_year")


@query(
    "merge_full", TABLES,
    WH_BOOKS + f"select {WH_OUT} from cur",
)
def _(d: Domain):
    return merge_df(_older(_current(d)), _current(d), ["income_id", "fin_year"], sync.BOOK_FULL_UPDATES)


@query(
    "merge_delta_books", TABLES,
    WH_BOOKS + f"select {WH_OUT} from (select o.* replace (c.tds_deductible as tds_deductible) from old o join cur c on c.income_id=o.income_id) m",
)
def _(d: Domain):
    stored, key = _older(_current(d)), ["income_id", "fin_year"]
    changed = changed_rows(_current(d), stored, key, sync.BOOK_LEGACY, sync.tolerances(sync.BOOK_LEGACY))
    return merge_df(stored, changed, key, sync.BOOK_UPDATES, insert=False)


@query(
    "merge_delete_missing", TABLES,
    WH_BOOKS + f"select {WH_OUT} from cur where doc_type='invoice'",
)
def _(d: Domain):
    """Full merge from the invoices alone drops everything else stored."""
    stored = _current(d)
    source = stored.filter("doc_type = 'invoice'")
    return merge_df(stored, source, ["income_id", "fin_year"], sync.BOOK_FULL_UPDATES, delete_missing=True)


OLD_CUST = """
with old as (select cust_id, cust_code, case when contact='MACHINERY' then 'Old name' else cust_name end cust_name, pan_number, case when contact='BUILDING' then null else gstin_number end gstin_number, tan_number, cust_status
  from cust_master where cust_status='active')
"""
CUST_WH = "cust_id, cust_code, cust_name, pan_number, gstin_number, tan_number, cust_status"


def _old_customers(d: Domain) -> DataFrame:
    kind = F.col("contact")
    old = d.cust_master.filter("cust_status = 'active'").withColumns(
        {
            "cust_name": F.when(kind == "MACHINERY", "Old name").otherwise(F.col("cust_name")),
            "gstin_number": F.when(kind != "BUILDING", F.col("gstin_number")),
        }
    )
    return sync.customers_for_warehouse(old)


@query(
    "merge_delta_customers", TABLES,
    OLD_CUST + f"select {CUST_WH} from cust_master where cust_status='active'",
)
def _(d: Domain):
    stored, current = _old_customers(d), sync.customers_for_warehouse(d.cust_master)
    changed = changed_rows(current, stored, ["cust_id"], sync.CUSTOMER_LEGACY)
    return merge_df(stored, changed, ["cust_id"], sync.CUSTOMER_UPDATES, insert=False)


@query(
    "changed_customers", TABLES,
    OLD_CUST + "select c.cust_id from cust_master c join old o on o.cust_id=c.cust_id where coalesce(c.cust_name,'')<>coalesce(o.cust_name,'') or coalesce(c.gstin_number,'')<>coalesce(o.gstin_number,'')",
)
def _(d: Domain):
    current = sync.customers_for_warehouse(d.cust_master)
    return changed_rows(current, _old_customers(d), ["cust_id"], sync.CUSTOMER_LEGACY).select("cust_id")


@query(
    "merge_delta_summary", TABLES,
    "select c.cust_id, ir.fin_year, " + num("sum(ir.tds_deductible) total_tds_deductible") + ", count(*) invoice_count from cust_master c join income_records ir on ir.cust_id=c.cust_id group by 1, 2",
)
def _(d: Domain):
    """The stored summary of an earlier ledger, brought up to date."""
    key = ["cust_id", "fin_year"]
    current = summary.tds_summary_fy(d.cust_master, d.income_records, d.form26as_records)
    earlier = d.income_records.filter("entry_source = 'manual'")
    stored = summary.tds_summary_fy(d.cust_master, earlier, d.form26as_records)
    changed = changed_rows(current, stored, key, sync.SUMMARY_UPDATES, sync.tolerances(sync.SUMMARY_UPDATES))
    merged = merge_df(stored, changed, key, sync.SUMMARY_UPDATES, insert=False)
    merged = merged.unionByName(insert_absent(stored, current, key))
    return merged.select("cust_id", "fin_year", "total_tds_deductible", "invoice_count")


@query(
    "incremental_append", TABLES,
    "select record_id, fin_year, tan_of_deductor, cust_code, c.cust_name from form26as_records f left join cust_master c on lower(trim(c.tan_number))=lower(trim(f.tan_of_deductor)) "
    "where record_id > (select max(record_id) from form26as_records where fin_year='1996-97' and section_code='194C' and deductor_name<'Customer#000000100')",
)
def _(d: Domain):
    early = F.col("deductor_name") < "Customer#000000100"
    stored = d.form26as_records.filter((F.col("fin_year") == "1996-97") & (F.col("section_code") == "194C") & early)
    mark = stored.agg(F.max("record_id")).scalar()
    rows = d.form26as_records.filter(F.col("record_id") > mark)
    return sync.statement_with_customer(rows, d.cust_master).select(
        "record_id", "fin_year", "tan_of_deductor", "cust_code", "cust_name"
    )


@query(
    "sync_scope_rows", TABLES,
    f"select f.record_id, f.fin_year, f.tan_of_deductor, f.deductor_name, f.section_code, {day('f.transaction_date', 'transaction_date')}, " + num("f.booking_amt booking_amt", "f.tds_credited tds_credited")
    + ", c.cust_code, c.cust_name from form26as_records f left join cust_master c on lower(trim(c.tan_number))=lower(trim(f.tan_of_deductor)) where f.fin_year='1997-98'",
)
def _(d: Domain):
    rows = d.form26as_records.filter("fin_year = '1997-98'")
    return sync.statement_with_customer(rows, d.cust_master)


@query(
    "books_with_customer", TABLES, WH_BOOKS + f"select {WH_OUT} from cur",
)
def _(d: Domain):
    return _current(d)


@query(
    "to_warehouse_types", TABLES,
    f"select log_id, {second('timestamp')}, user_name, action_type, module_name, description, severity_level, ip_address from audit_logs",
)
def _(d: Domain):
    return warehouse.to_warehouse_types(d.audit_logs)


OVERRIDE = """
with asked as (select c_custkey cust_id, concat('fy ',case when c_nationkey%2=0 then '1997-98' else '1998 - 99' end) fin_year, case c_nationkey%4 when 0 then 'reserved' when 1 then ' open ' when 2 then 'unknown' else 'disabled' end manual_status,
  case when c_nationkey%3=0 then ' ' else 'checked' end remarks, c_custkey n from customer where c_mktsegment='BUILDING'),
valid as (select cust_id, replace(replace(upper(fin_year),'FY',''),' ','') fin_year, trim(manual_status) manual_status, nullif(trim(remarks),'') remarks from asked
  where trim(manual_status) in ('reconciled','likely_match','reserved','suggested_match','not_liable','open','disabled'))
"""


@query(
    "override_upsert", ["recon_overrides"],
    OVERRIDE + f"select coalesce(v.cust_id,o.cust_id) cust_id, coalesce(v.fin_year,o.fin_year) fin_year, coalesce(v.manual_status,o.manual_status) manual_status, case when v.cust_id is not null then v.remarks else o.remarks end remarks, "
    "case when v.cust_id is not null then '2024-02-02 00:00:00' else strftime(o.updated_at,'%Y-%m-%d %H:%M:%S') end updated_at from recon_overrides o full join valid v on v.cust_id=o.cust_id and v.fin_year=o.fin_year",
)
def _(d: Domain):
    nation = F.col("c_nationkey")
    asked = d.customer.filter("c_mktsegment = 'BUILDING'").select(
        F.col("c_custkey").alias("cust_id"),
        F.concat(F.lit("fy "), F.when(nation % 2 == 0, "1997-98").otherwise("1998 - 99")).alias("fin_year"),
        F.when(nation % 4 == 0, "reserved").when(nation % 4 == 1, " open ").when(nation % 4 == 2, "unknown")
        .otherwise("disabled").alias("manual_status"),
        F.when(nation % 3 == 0, " ").otherwise("checked").alias("remarks"),
        F.lit("2024-02-02 00:00:00").cast("timestamp").alias("updated_at"),
        F.col("c_custkey").alias("n"),
    )
    return overrides.override_upsert(d.recon_overrides, asked, ["n"])


# ------------------------------------------------------ stored tables, streams

def _tables(d: Domain) -> dict[str, DataFrame]:
    """The operational tables as stored ones."""
    return {t: warehouse.stage(d.table(t), t) for t in TABLES}


@query(
    "sync_all", TABLES,
    "select 'income_records' table_name, count(*) n, cast(sum(i.tds_deductible) as double) total from income_records i join cust_master c using (cust_id) union all "
    "select 'form26as_records', count(*), cast(sum(tds_credited) as double) from form26as_records union all select 'cust_master', count(*), 0.0 from cust_master union all "
    "select 'audit_logs', count(*), 0.0 from audit_logs union all "
    "select 'tds_summary', count(*), cast(sum(t) as double) from (select cust_id, fin_year, sum(tds_deductible) t from income_records group by 1, 2) q",
)
def _(d: Domain):
    """An older state is synced, then the current one: the warehouse holds
    exactly the current rows."""
    store = warehouse.warehouse_store(d.spark, new_scratch(d.spark, "sync"))
    now = _tables(d)
    older_books = now["income_records"].filter("fin_year < '1999-00'").withColumn(
        "tds_deductible", (F.col("tds_deductible") + 1).cast("decimal(15,2)")
    )
    # Ids are not in year order here: only those up to the lowest later one count as synced.
    first_later = now["income_records"].filter("fin_year >= '1999-00'").agg(F.min("income_id")).scalar()
    older = {
        **now,
        "income_records": older_books.filter(F.col("income_id") < first_later),
        "cust_master": now["cust_master"].withColumn("cust_name", F.lower("cust_name")),
    }
    for tables in (older, now):
        sync.sync_all(store, tables)
    totals = {"income_records": "tds_deductible", "form26as_records": "tds_credited", "tds_summary": "total_tds_deductible"}
    out = None
    for name in ("income_records", "form26as_records", "cust_master", "audit_logs", "tds_summary"):
        amount = F.sum(totals[name]).cast("double") if name in totals else F.lit(0.0)
        row = store.read(name).agg(F.count(F.lit(1)).alias("n"), amount.alias("total"))
        row = row.select(F.lit(name).alias("table_name"), "n", "total")
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "snapshot_all", TABLES,
    "select snapshot_date, cust_id, fin_year, total_tds_deductible from (select '2024-03-31' snapshot_date, cust_id, fin_year, cast(sum(tds_deductible) as double) total_tds_deductible from income_records group by 2, 3) s",
)
def _(d: Domain):
    """A day's snapshot taken twice is there once."""
    root = new_scratch(d.spark, "snapshot")
    tables = _tables(d)
    for _n in range(2):
        sync.snapshot_all(d.spark, root, tables, "2024-03-31")
    stored = d.spark.read.parquet(f"{root}/tds_summary")
    return stored.select(
        F.col("snapshot_date").cast("string").alias("snapshot_date"), "cust_id", "fin_year", "total_tds_deductible"
    )


@query(
    "sync_scope_fy", TABLES, WH_BOOKS + f"select {WH_OUT} from cur where fin_year='1997-98'",
)
def _(d: Domain):
    """A year pushed twice is there once."""
    store = warehouse.warehouse_store(d.spark, new_scratch(d.spark, "scope"))
    tables = _tables(d)
    for _n in range(2):
        sync.sync_scope_fy(store, tables, "FY 1997-98")
    return store.read("income_records")


@query(
    "watermark_upsert", TABLES, "select 'income_records' table_name, max(income_id) last_id, 7::bigint row_count from income_records",
)
def _(d: Domain):
    """Marks only rise: setting a lower one keeps the higher id."""
    store = warehouse.warehouse_store(d.spark, new_scratch(d.spark, "marks"))
    top = d.income_records.agg(F.max("income_id")).first()[0]
    sync.set_mark(store, "income_records", top, 5)
    sync.set_mark(store, "income_records", top - 1, 7)
    return store.read("sync_marks").select("table_name", "last_id", "row_count")


@query(
    "warehouse_append", TABLES, WH_BOOKS + f"select {WH_OUT} from cur",
)
def _(d: Domain):
    store = warehouse.warehouse_store(d.spark, new_scratch(d.spark, "append"))
    rows = _current(d)
    store.append("income_records", rows.filter("doc_type = 'invoice'"))
    store.append("income_records", rows.filter("doc_type <> 'invoice'"))
    return store.read("income_records")


@query(
    "warehouse_stage", TABLES, WH_BOOKS + f"select {WH_OUT} from cur",
)
def _(d: Domain):
    return warehouse.stage(_current(d), "books")


@query(
    "stream_append_sync", TABLES,
    f"select log_id, {second('timestamp')}, user_name, action_type, module_name, description, severity_level, ip_address from audit_logs",
)
def _(d: Domain):
    """Events arrive as files and leave as audit rows; a second run adds none."""
    root = new_scratch(d.spark, "stream")
    select = DEFINITIONS["audit_logs"]
    for _n in range(2):
        stream_append_sync(
            d.spark, d.sf_dir, d.events.schema, f"{root}/audit_logs", f"{root}/checkpoint",
            name_filter="events.parquet", transform=lambda rows: d.spark.sql(select, events=rows),
        )
    return d.spark.read.parquet(f"{root}/audit_logs")


INGESTED_SQL = (
    "select fin_year, cust_id, doc_number, cast(taxable_amt as double) taxable_amt from (select concat(cast(year(d)-case when month(d)>=4 then 0 else 1 end as varchar),'-',lpad(cast((year(d)+case when month(d)>=4 then 1 else 0 end)%100 as varchar),2,'0')) fin_year, "
    "o_custkey cust_id, concat('INV-',cast(o_orderkey as varchar)) doc_number, cast(o_totalprice as decimal(15,2)) taxable_amt from (select *, cast(o_orderdate as date) d from orders) o) x"
)


@query("stream_ingest_uploads", ["ledger_rows", "cust_master", "assess_rates"], INGESTED_SQL)
def _(d: Domain):
    """Ledger files arrive in a landing folder and end as stored invoices; a
    second run finds nothing new."""
    root = new_scratch(d.spark, "uploads")
    store = warehouse.operational_store(d.spark, f"{root}/tables")
    return _ingest_landed(d, store, root)


@query("versioned_ingest_uploads", ["ledger_rows", "cust_master", "assess_rates"], INGESTED_SQL)
def _(d: Domain):
    """As ``stream_ingest_uploads`` into versioned tables: every change is one
    atomic commit of a manifest, a second run commits no new invoice, and the
    rows are read from the newest manifest's files."""
    root = new_scratch(d.spark, "versioned")
    store = versioned.versioned_operational_store(d.spark, f"{root}/tables")
    return _ingest_landed(d, store, root)


def _ingest_landed(d: Domain, store: warehouse.Store, root: str) -> DataFrame:
    store.append("cust_master", d.cust_master)
    key = F.col("o_orderkey").cast("string")
    blank = F.lit("")
    sheet = d.orders.select(
        F.concat(F.lit("CUST"), F.lpad(F.col("o_custkey").cast("string"), 6, "0")).alias("Customer Code"),
        F.concat(F.lit("INV-"), key).alias("Document No"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("Document Date"),
        blank.alias("Document Type"),
        F.col("o_totalprice").cast("decimal(15,2)").alias("Taxable Amount"),
        F.lit("0").alias("Tax Amount"),
        blank.alias("Gross Amount"),
    )
    writer = sheet.write.option("header", True).option("sep", "\t").option("extension", "txt")
    writer.csv(f"{root}/landing")
    for _n in range(2):
        stream_ingest_uploads(store, f"{root}/landing", f"{root}/checkpoint")
    return store.read("income_records").select("fin_year", "cust_id", "doc_number", "taxable_amt")


@query(
    "load_rate_tables", ["income_records"],
    "with chosen as (select section_code, tds_rate from (select *, row_number() over (partition by section_code order by case payee_type when 'OTHERS' then 1 when 'ALL' then 2 when 'INDIVIDUAL_HUF' then 3 else 4 end, id) rn "
    f"from {seeds.rates_as_values()} where is_resident) q where rn=1) "
    "select i.tds_section, " + num("c.tds_rate tds_rate", "sum(i.taxable_amt) taxable") + ", count(*) n from income_records i join chosen c on c.section_code=i.tds_section group by i.tds_section, c.tds_rate",
)
def _(d: Domain):
    """Invoices per section under the shipped rates."""
    chosen = rates.rates_for_booking(seeds.load_rate_tables(d.spark)["tds_codes_master"])
    per_section = d.income_records.groupBy("tds_section").agg(
        F.sum("taxable_amt").alias("taxable"), F.count(F.lit(1)).alias("n")
    )
    return per_section.join(chosen.withColumnRenamed("section_code", "tds_section"), "tds_section")


def _rates(d: Domain) -> DataFrame:
    missing = {
        f.name: F.lit(None).cast(f.dataType) for f in schemas.RATES.fields if f.name not in d.assess_rates.columns
    }
    return d.assess_rates.withColumns(missing)


STATED = RESOLVED + """, stated as (select fin_year, tan_of_deductor, section_code from form26as_records where fin_year in (select fin_year from fresh)
  union all select fin_year, resolved_tan, section_code from fresh)
"""


@query(
    "statement_ingest", ["statement_text", *ASSESS_TABLES],
    STATED + ", " + ASSESS_SQL.strip()[len("with "):].replace("join form26as_records f", "join stated f"),
)
def _(d: Domain):
    """A statement upload stored, and the invoices of its years reassessed."""
    store = warehouse.operational_store(d.spark, new_scratch(d.spark, "statement"))
    for name in ("cust_master", "income_records", "form26as_records"):
        store.append(name, d.table(name))
    store.append("tds_codes_master", _rates(d))
    text = d.statement_text
    files = text.groupBy("file_id").agg(F.sum(F.octet_length("text")).alias("size_bytes")).withColumns(
        {"path": F.col("file_id"), "file_hash": F.sha2("file_id", 256)}
    )
    parsed = statement_files.parse_statement_text(text)
    jobs.store_statement(store, jobs.admit(store, files), parsed, fy_mode="first_row")
    return store.read("income_records")


@query(
    "customer_ingest", CUST_TABLES,
    CUST + "select module_name, rows_imported, (select count(*) from cust_master)+(select count(*) from fresh) customers, (select count(*) from cust_master)+(select count(*) from fresh) tans from "
    "(select 'customer_master' module_name, count(*) filter (where reason is null) rows_imported from s2) x",
)
def _(d: Domain):
    """A customer upload merged into the stored master, with its ledger row."""
    store = warehouse.operational_store(d.spark, new_scratch(d.spark, "customers"))
    store.append("cust_master", d.cust_master)
    sheet = d.customer_upload
    files = sheet.groupBy("file_id").agg(F.sum(F.octet_length("customer_name")).alias("size_bytes")).withColumns(
        {"path": F.col("file_id"), "file_hash": F.sha2("file_id", 256)}
    )
    jobs.ingest_customers(store, sheet, files)
    people = store.read("cust_master")
    return store.read("file_uploads_log").select(
        "module_name", "rows_imported",
        people.agg(F.countDistinct("pan_number")).scalar().alias("customers"),
        people.agg(F.countDistinct("tan_number")).scalar().alias("tans"),
    )
