"""Customer, books, rate, upload and audit reports; reconciliation and summary."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfold.checks.registry import day, num, query, second
from tallyfold.functions.dates import clean_fiscal_year
from tallyfold.operators.paging import page_of, page_total, sorted_by
from tallyfold.plans import assess, audit, books, customers, rates, recon, summary, uploads
from tallyfold.sources.domain import Domain

FY = "1997-98"

# ---------------------------------------------------------------- customers

CUST_COLS = "cust_id, cust_code, cust_name, pan_number, gstin_number, tan_number, cust_status, contact"
CUST_FOUND = (
    "(lower(cust_name) like '%99%' or lower(pan_number) like '%99%' or lower(gstin_number) like '%99%' "
    "or lower(tan_number) like '%99%' or lower(cust_code) like '%99%') and cust_status='active'"
)


@query(
    "customer_stats", ["cust_master"],
    "select count(*) total_customers, sum(case when cust_status='active' then 1 else 0 end)::bigint active_customers, "
    "sum(case when cust_status='inactive' then 1 else 0 end)::bigint inactive_customers, count(distinct tan_number) total_tans from cust_master",
)
def _(d: Domain):
    return customers.customer_stats(d.cust_master)


@query("customer_search", ["cust_master"], f"select {CUST_COLS} from cust_master where {CUST_FOUND}")
def _(d: Domain):
    return customers.customer_search(d.cust_master, "99", "Active")


@query(
    "customer_page", ["cust_master"],
    f"select {CUST_COLS} from cust_master where {CUST_FOUND} order by cust_name, cust_id limit 20 offset 20",
)
def _(d: Domain):
    found = customers.customer_search(d.cust_master, "99", "active")
    return page_of(found, [F.col("cust_name"), F.col("cust_id")], page=2, per_page=20)


@query(
    "page_total", ["cust_master"],
    f"select count(*) total, 2::int page, 20::int per_page, greatest(ceil(count(*)/20.0),1)::bigint pages from cust_master where {CUST_FOUND}",
)
def _(d: Domain):
    return page_total(customers.customer_search(d.cust_master, "99", "active"), page=2, per_page=20)


@query("customer_by_id", ["cust_master"], f"select {CUST_COLS} from cust_master where cust_id=77")
def _(d: Domain):
    return customers.customer_by_id(d.cust_master, 77)


@query(
    "customer_export", ["cust_master"],
    'select cust_code "Customer Code", cust_name "Customer Name", pan_number "PAN", gstin_number "GSTIN", tan_number "TAN", '
    f'cust_status "Status", contact "Contact" from cust_master where {CUST_FOUND}',
)
def _(d: Domain):
    return customers.customer_export(d.cust_master, "99", "active")


# -------------------------------------------------------------------- books

@query(
    "books_widgets", ["income_records", "adjustments"],
    "select fin_year, " + num(
        "sum(gross_amt) sales_income",
        "(select coalesce(sum(adj_amt),0) from adjustments a where a.fin_year=ir.fin_year) adjustments",
        "(select coalesce(sum(adj_amt),0) from adjustments a where a.fin_year=ir.fin_year and a.income_id is not null) linked_adjustments",
        "sum(taxable_amt) total_income", "sum(tds_deductible) tds_deductible",
    ) + " from income_records ir group by fin_year",
)
def _(d: Domain):
    return books.books_widgets(d.income_records, d.adjustments)


@query(
    "books_widgets_one_year", ["income_records", "adjustments"],
    f"select '{FY}' fin_year, " + num(
        "sum(gross_amt) sales_income",
        f"(select coalesce(sum(adj_amt),0) from adjustments a where a.fin_year='{FY}') adjustments",
        f"(select coalesce(sum(adj_amt),0) from adjustments a where a.fin_year='{FY}' and a.income_id is not null) linked_adjustments",
        "sum(taxable_amt) total_income", "sum(tds_deductible) tds_deductible",
    ) + f" from income_records ir where fin_year='{FY}'",
)
def _(d: Domain):
    return books.books_widgets(d.income_records, d.adjustments, FY)


@query(
    "books_summary_view", ["cust_master", "income_records", "adjustments"],
    "select cm.cust_id, cm.cust_name, cm.cust_status, ir.fin_year, " + num(
        "sum(ir.taxable_amt) taxable_amt", "sum(ir.gross_amt) gross_amt", "sum(ir.tds_deductible) tds_deductible",
        "sum(ir.gross_amt) - coalesce((select sum(a.adj_amt) from adjustments a where a.cust_id=cm.cust_id and a.fin_year=ir.fin_year),0) collection_amt",
        "sum(ir.tds_deductible) tds_receivable",
    ) + " from cust_master cm join income_records ir on ir.cust_id=cm.cust_id group by cm.cust_id, cm.cust_name, cm.cust_status, ir.fin_year",
)
def _(d: Domain):
    return books.books_summary_view(d.cust_master, d.income_records, d.adjustments)


BOOKS_SUMMARY_SQL = (
    "select c.cust_id, c.cust_name, c.cust_status, " + num(
        "coalesce(sum(i.taxable_amt),0) taxable_amt", "coalesce(sum(i.gross_amt),0) gross_amt",
        "coalesce(sum(i.tds_deductible),0) tds_deductible",
        "coalesce(sum(greatest(i.gross_amt-i.tds_deductible,0)),0) collection_amt",
        "coalesce(sum(i.tds_deductible),0) tds_receivable",
    ) + f" from cust_master c left join income_records i on c.cust_id=i.cust_id and i.fin_year='{FY}' where c.cust_status='active' "
    "group by c.cust_id, c.cust_name, c.cust_status having coalesce(sum(i.taxable_amt),0)>0 or coalesce(sum(i.gross_amt),0)>0 or coalesce(sum(i.tax_amt),0)>0"
)


@query("books_summary", ["cust_master", "income_records"], BOOKS_SUMMARY_SQL)
def _(d: Domain):
    return books.books_summary(d.cust_master, d.income_records, FY, "Active")


@query(
    "books_summary_page", ["cust_master", "income_records"],
    BOOKS_SUMMARY_SQL + " order by c.cust_name, c.cust_id limit 100 offset 100",
)
def _(d: Domain):
    found = books.books_summary(d.cust_master, d.income_records, FY, "Active")
    return page_of(found, [F.col("cust_name"), F.col("cust_id")], page=2, per_page=100)


LEDGER_SQL = (
    f"select i.income_id, i.upload_ref, cm.cust_code, i.cust_name, i.doc_number, {day('i.doc_date', 'doc_date')}, i.doc_type, "
    + num("i.taxable_amt taxable_amt", "i.tax_amt tax_amt", "i.gross_amt gross_amt")
    + f", i.entry_source from income_records i left join cust_master cm on cm.cust_id=i.cust_id where i.fin_year='{FY}' "
    "and (lower(i.cust_name) like '%7%' or lower(i.doc_number) like '%7%')"
)


@query("books_ledger", ["cust_master", "income_records"], LEDGER_SQL)
def _(d: Domain):
    return books.books_ledger(d.income_records, d.cust_master, FY, "7")


@query(
    "books_ledger_page", ["cust_master", "income_records"],
    LEDGER_SQL + " order by i.cust_name, i.doc_date desc, i.income_id limit 50 offset 100",
)
def _(d: Domain):
    found = books.books_ledger(d.income_records, d.cust_master, FY, "7")
    order = [F.col("cust_name"), F.col("doc_date").desc(), F.col("income_id")]
    return page_of(found, order, page=3, per_page=50)


@query(
    "books_detailed", ["income_records"],
    f"select cust_name, doc_number invoice_no, {day('doc_date', 'invoice_date')}, "
    + num("taxable_amt", "gross_amt") + ", tds_section, "
    + num("tds_rate", "tds_deductible", "gross_amt-tds_deductible collection_amt", "tds_deductible tds_receivable")
    + f", 'Automated Sync' remarks from income_records where fin_year='{FY}' and doc_type='invoice'",
)
def _(d: Domain):
    return books.books_detailed(d.income_records, FY)


@query(
    "unreferenced_open", ["unreferenced_entries"],
    f"select unref_id, upload_ref, raw_identifier, doc_number, {day('doc_date')}, {num('entry_amt')}, unref_reason "
    f"from unreferenced_entries where fin_year='{FY}' and not resolved",
)
def _(d: Domain):
    return books.unreferenced_open(d.unreferenced_entries, FY)


DETAIL_SQL = (
    "select ir.income_id, ir.upload_ref, ir.fin_year, c.cust_code, c.cust_name, c.pan_number, c.tan_number, ir.doc_number, "
    f"{day('ir.doc_date', 'doc_date')}, ir.doc_type, "
    + num("ir.taxable_amt taxable_amt", "ir.tax_amt tax_amt", "ir.gross_amt gross_amt", "ir.tds_deductible tds_deductible")
    + ", ir.tds_section, " + num("ir.tds_rate tds_rate")
    + ", ir.entry_source, month(ir.doc_date)::int txn_month, year(ir.doc_date)::int txn_year, "
    "case when month(ir.doc_date) in (4,5,6) then 'Q1' when month(ir.doc_date) in (7,8,9) then 'Q2' when month(ir.doc_date) in (10,11,12) then 'Q3' else 'Q4' end fy_quarter "
    "from income_records ir join cust_master c on ir.cust_id=c.cust_id"
)


@query("invoice_detail", ["cust_master", "income_records"], DETAIL_SQL)
def _(d: Domain):
    return books.invoice_detail(d.income_records, d.cust_master)


# -------------------------------------------------------------------- rates

LISTED = (
    "id gl_code, section_code tds_section, coalesce(nullif(sub_code,''),'—') sub_code, "
    + num("tds_rate", "surcharge_pct", "cess_pct")
    + ", coalesce(nullif(appln_form,''),'—') appln_form, coalesce(nullif(payee_type,''),'ALL') applicable_to, description tds_description, "
    "coalesce(strftime(effective_from,'%Y-%m-%d'),'—') eff_from_date"
)


@query("rate_list", ["tds_codes_master"], f"select {LISTED} from tds_codes_master where is_active and upper(trim(payee_type))='OTHERS'")
def _(d: Domain):
    return rates.rate_list(d.tds_codes_master, "others")


@query(
    "customer_rates", ["tds_codes_master", "income_records"],
    f"select distinct {LISTED} from tds_codes_master t join (select tds_section used from income_records where cust_id=77) ir "
    "on upper(trim(used))=upper(trim(t.section_code)) where t.is_active",
)
def _(d: Domain):
    return rates.customer_rates(d.tds_codes_master, d.income_records, 77)


@query(
    "tcs_list", ["tcs_codes_master"],
    "select id, cust_id, fin_year, quarter, gl_code, tcs_section, sub_code, " + num("tcs_rate", "surcharge_pct", "cess_pct")
    + f", appln_form, applicable_to, tcs_description, {day('eff_from_date')} from tcs_codes_master "
    "where trim(applicable_to)='BUILDING' and fin_year='1994-95' and quarter='Q4'",
)
def _(d: Domain):
    return rates.tcs_list(d.tcs_codes_master, "BUILDING", "1994-95", "Q4")


@query(
    "rate_verify", ["tds_codes_master"],
    "select section_code, sub_code, case when is_resident then 'Resident' else 'Non-Resident' end residency, payee_type, "
    + num("tds_rate") + ", cast(threshold_limit as varchar) threshold_limit, is_active from tds_codes_master",
)
def _(d: Domain):
    return rates.rate_verify(d.tds_codes_master).withColumn("threshold_limit", F.col("threshold_limit").cast("string"))


@query("rate_count", ["tds_codes_master"], "select count(*) total_sections from tds_codes_master")
def _(d: Domain):
    return rates.rate_count(d.tds_codes_master)


PRIORITY = "case payee_type when 'OTHERS' then 1 when 'ALL' then 2 when 'INDIVIDUAL_HUF' then 3 else 4 end"


@query(
    "rates_for_assessment", ["tds_codes_master"],
    "select section_code, id, " + num("tds_rate") + f" from (select upper(trim(section_code)) section_code, id, tds_rate, "
    f"row_number() over (partition by upper(trim(section_code)) order by {PRIORITY}, id) rn from tds_codes_master where is_resident and is_active) x where rn=1",
)
def _(d: Domain):
    return rates.rates_for_assessment(d.tds_codes_master).select("section_code", "id", "tds_rate")


@query(
    "rates_for_booking", ["tds_codes_master"],
    "select section_code, " + num("tds_rate") + f" from (select upper(trim(section_code)) section_code, tds_rate, "
    f"row_number() over (partition by upper(trim(section_code)) order by {PRIORITY}, effective_from desc, id) rn from tds_codes_master where is_resident and is_active) x where rn=1",
)
def _(d: Domain):
    return rates.rates_for_booking(d.tds_codes_master)


# ---------------------------------------------------------- uploads, audit

@query(
    "upload_history", ["file_uploads_log"],
    "select lower(string_split(file_name,'.')[-1]) file_ext, file_name orig_filename, module_name upload_module, fin_year, quarter quarter_ref, "
    + num("file_size_kb") + ", upload_status parse_status, rows_imported row_count_total, uploaded_by uploaded_by_name, "
    "strftime(uploaded_at,'%Y-%m-%d %H:%M') uploaded_at from file_uploads_log where lower(module_name)='form26as' and fin_year='2023-24'",
)
def _(d: Domain):
    return uploads.upload_history(d.file_uploads_log, "FORM26AS", "2023-24")


@query(
    "upload_history_bi", ["file_uploads_log"],
    "select upload_id, module_name, fin_year, quarter, file_name, " + num("file_size_kb")
    + f", rows_imported, upload_status, uploaded_by, {second('uploaded_at')}, sha256(text) file_hash, {day('uploaded_at', 'upload_date')}, "
    "hour(uploaded_at)::int upload_hour from file_uploads_log",
)
def _(d: Domain):
    return uploads.upload_history_bi(d.file_uploads_log.withColumn("file_hash", uploads.hash_of(F.col("text"))))


AUDIT_COLS = f"log_id, {second('timestamp')}, user_name, action_type, module_name, description, severity_level, ip_address"


@query(
    "audit_search", ["audit_logs"],
    f"select {AUDIT_COLS} from audit_logs where (lower(description) like '%7%' or lower(user_name) like '%7%' or lower(module_name) like '%7%') "
    "and upper(trim(action_type))='UPDATE' and upper(trim(severity_level))='INFO' "
    "and cast(timestamp as date)>=date '2024-01-05' and cast(timestamp as date)<=date '2024-01-20'",
)
def _(d: Domain):
    return audit.audit_search(
        d.audit_logs, "7", action="update", severity="Info", date_from="2024-01-05", date_to="2024-01-20"
    )


@query(
    "audit_module_search", ["audit_logs"],
    f"select {AUDIT_COLS} from audit_logs where upper(trim(module_name))='RECONCILIATION'",
)
def _(d: Domain):
    return audit.audit_search(d.audit_logs, module="reconciliation", action="ALL")


INLINE = (
    "(lower(description) like '%up%' or lower(user_name) like '%up%' or lower(module_name) like '%up%' or lower(action_type) like '%up%')"
)


@query("audit_inline_search", ["audit_logs"], f"select {AUDIT_COLS} from audit_logs where {INLINE}")
def _(d: Domain):
    return audit.audit_inline_search(audit.audit_search(d.audit_logs), "Up")


@query(
    "audit_cards", ["audit_logs"],
    "select count(*) total, count(*) filter (where severity_level='INFO') info, count(*) filter (where severity_level='WARNING') warning, "
    f"count(*) filter (where severity_level='CRITICAL') critical from audit_logs where {INLINE}",
)
def _(d: Domain):
    return audit.audit_cards(audit.audit_inline_search(d.audit_logs, "up"))


@query(
    "audit_export", ["audit_logs"],
    'select log_id "Log ID", strftime(timestamp,\'%Y-%m-%d %H:%M:%S\') "Timestamp", user_name "User", action_type "Action", module_name "Module", '
    'description "Description", severity_level "Severity", ip_address "IP Address" from audit_logs where severity_level=\'CRITICAL\'',
)
def _(d: Domain):
    return audit.audit_export(audit.audit_search(d.audit_logs, severity="critical"))


# ------------------------------------------------------------------- recon

B0, G0, I0 = "coalesce(b.system_tds,0)", "coalesce(g.f26as_credit,0)", "coalesce(b.gross_income,0)"
REMARK = "'Automated engine validation complete.'"


def _verdict(first_test: str) -> str:
    return (
        f"case when {first_test} then 'open' when abs(coalesce(g.f26as_credit,0)-coalesce(b.system_tds,0))<5.00 then 'reconciled' "
        "when coalesce(g.f26as_credit,0)=0 then 'open' "
        f"when least({B0},{G0})*100>=greatest({B0},{G0})*85 then 'likely_match' "
        f"when least({B0},{G0})*100>=greatest({B0},{G0})*50 then 'suggested_match' else 'open' end"
    )


RECON_VIEW_SQL = (
    "select c.cust_id, c.cust_code, c.cust_name, c.pan_number, c.tan_number, b.fin_year, "
    + num(f"{B0} system_tds", f"{I0} book_credit", f"{G0} f26as_credit", f"{B0}-{G0} variance_amt",
          f"cast(case when {B0}=0 or {G0}=0 then 0 else round(least(b.system_tds,g.f26as_credit)/greatest(b.system_tds,g.f26as_credit)*100,2) end as decimal(9,2)) match_score_pct")
    + f", coalesce(ro.manual_status, {_verdict(f'{B0}=0 and {G0}=0')}) recon_status, coalesce(ro.remarks,{REMARK}) remarks, {second('ro.updated_at', 'status_updated_at')} "
    "from cust_master c left join (select cust_id, fin_year, sum(tds_deductible) system_tds, sum(gross_amt) gross_income from income_records group by cust_id, fin_year) b on c.cust_id=b.cust_id "
    "left join (select lower(trim(tan_of_deductor)) tan, fin_year, sum(tds_credited) f26as_credit from form26as_records group by 1, 2) g on lower(trim(c.tan_number))=g.tan and b.fin_year=g.fin_year "
    "left join recon_overrides ro on ro.cust_id=c.cust_id and ro.fin_year=b.fin_year where b.system_tds is not null or g.f26as_credit is not null"
)
RECON_TABLES = ["cust_master", "income_records", "form26as_records", "recon_overrides", "statement_mixed_keys"]


@query("recon_view", RECON_TABLES, RECON_VIEW_SQL)
def recon_view(d: Domain):
    return recon.recon_view(d.cust_master, d.income_records, d.form26as_records, d.recon_overrides)


def _year_join(statement: str, fy: str = FY) -> str:
    return (
        f"from cust_master c left join (select cust_id, sum(tds_deductible) system_tds, sum(gross_amt) gross_income from income_records where fin_year='{fy}' group by cust_id) b on c.cust_id=b.cust_id "
        f"left join (select lower(trim(tan_of_deductor)) clean_tan, sum(tds_credited) f26as_credit from {statement} where fin_year='{fy}' group by 1) g "
        "on (lower(trim(c.tan_number))=g.clean_tan or lower(trim(c.pan_number))=g.clean_tan) "
    )


def _records(statement: str) -> str:
    return (
        "select * from (select c.cust_id recon_id, c.cust_id, c.cust_name, c.pan_number, c.tan_number, "
        + num(f"{B0} system_tds_amt", f"{G0} f26as_credit_amt", f"{I0} book_credit_amt", f"{B0}-{G0} variance_amt",
              f"cast(case when {B0}=0 and {G0}=0 then 100 when abs({B0}-{G0})<5.00 then 100 when {B0}=0 or {G0}=0 then 0 "
              "else round(least(b.system_tds,g.f26as_credit)/greatest(b.system_tds,g.f26as_credit),6)*100 end as decimal(9,4)) match_score")
        + f", coalesce(ro.manual_status, {_verdict(f'{B0}=0 and {G0}=0 and {I0}=0')}) recon_status, coalesce(ro.remarks,{REMARK}) remarks "
        + _year_join(statement)
        + f"left join recon_overrides ro on ro.cust_id=c.cust_id and ro.fin_year='{FY}') m where (system_tds_amt>0 or f26as_credit_amt>0 or book_credit_amt>0)"
    )


@query("recon_records", RECON_TABLES, _records("form26as_records"))
def _(d: Domain):
    return recon.recon_records(d.cust_master, d.income_records, d.form26as_records, d.recon_overrides, "FY 1997-98")


@query("recon_key_any_join", RECON_TABLES, _records("statement_mixed_keys"))
def _(d: Domain):
    """Customers whose TAN and PAN both occur in the statement come out twice."""
    return recon.recon_records(d.cust_master, d.income_records, d.statement_mixed_keys, d.recon_overrides, FY)


@query(
    "recon_records_page", RECON_TABLES,
    _records("form26as_records") + " and lower(recon_status)='likely_match' and (lower(cust_name) like '%1%' or lower(pan_number) like '%1%' or lower(tan_number) like '%1%') "
    "order by cust_name, cust_id limit 25 offset 25",
)
def _(d: Domain):
    found = recon.recon_records(
        d.cust_master, d.income_records, d.form26as_records, d.recon_overrides, FY, status="Likely_Match", search="1"
    )
    return page_of(found, [F.col("cust_name"), F.col("cust_id")], page=2, per_page=25)


TOTALS = num("coalesce(sum(b.system_tds),0) total_system_tds", "coalesce(sum(g.f26as_credit),0) total_f26as_credit",
             "coalesce(sum(b.gross_income),0) total_book_credit",
             "cast(case when coalesce(sum(b.system_tds),0)=0 then 0 else round(coalesce(sum(g.f26as_credit),0)/sum(b.system_tds),6)*100 end as decimal(20,4)) pct_credit")


@query("recon_totals", RECON_TABLES, f"select {TOTALS} {_year_join('statement_mixed_keys')}")
def _(d: Domain):
    return recon.recon_totals(d.cust_master, d.income_records, d.statement_mixed_keys, FY)


COUNTS_SQL = (
    f"select coalesce(ro.manual_status, {_verdict(f'{B0}=0 and {G0}=0 and {I0}=0')}) recon_status, count(*) cnt_val "
    + _year_join("form26as_records")
    + f"left join recon_overrides ro on ro.cust_id=c.cust_id and ro.fin_year='{FY}' where b.system_tds is not null or g.f26as_credit is not null group by 1"
)


@query("recon_status_counts", RECON_TABLES, COUNTS_SQL)
def _(d: Domain):
    return recon.recon_status_counts(d.cust_master, d.income_records, d.form26as_records, d.recon_overrides, FY)


PEOPLE_SQL = (
    f"select count(distinct c.cust_id) total_cust from cust_master c left join (select distinct cust_id from income_records where fin_year='{FY}') b on c.cust_id=b.cust_id "
    f"left join (select lower(trim(tan_of_deductor)) t from form26as_records where fin_year='{FY}') g on lower(trim(c.tan_number))=g.t where b.cust_id is not null or g.t is not null"
)


@query("recon_customer_count", RECON_TABLES, PEOPLE_SQL)
def _(d: Domain):
    return recon.recon_customer_count(d.cust_master, d.income_records, d.form26as_records, FY)


STATUS_NAMES = ["reconciled", "likely_match", "reserved", "suggested_match", "not_liable", "open", "disabled"]


@query(
    "recon_stats", RECON_TABLES,
    f"select t.*, ({PEOPLE_SQL})::bigint cnt_grand_total, "
    + ", ".join(f"coalesce((select sum(cnt_val) from ({COUNTS_SQL}) k where recon_status='{s}'),0)::bigint cnt_{s}" for s in STATUS_NAMES)
    + f" from (select {TOTALS} {_year_join('form26as_records')}) t",
)
def _(d: Domain):
    return recon.recon_stats(d.cust_master, d.income_records, d.form26as_records, d.recon_overrides, FY)


# ----------------------------------------------------------------- summary

SUMMARY_TABLES = ["cust_master", "income_records", "form26as_records", "file_uploads_log"]
F26_ALL = "(select lower(trim(tan_of_deductor)) tan, fin_year, sum(tds_credited) total_tds_credited from form26as_records group by 1, 2) f26"
SUMMARY_COLS = "c.cust_id, c.cust_code, c.cust_name, c.pan_number, c.tan_number, ir.fin_year, " + num(
    "coalesce(sum(ir.taxable_amt),0) total_taxable_amt", "coalesce(sum(ir.tds_deductible),0) total_tds_deductible",
    "coalesce(sum(ir.gross_amt),0) total_gross_amt", "coalesce(f26.total_tds_credited,0) total_26as_credit",
    "coalesce(sum(ir.tds_deductible),0)-coalesce(f26.total_tds_credited,0) variance_amt",
    "cast(case when coalesce(sum(ir.tds_deductible),0)=0 then 0 else round(coalesce(f26.total_tds_credited,0)/sum(ir.tds_deductible)*100,2) end as decimal(18,2)) pct_credit",
) + ", count(ir.income_id) invoice_count"
SUMMARY_GROUP = "group by c.cust_id, c.cust_code, c.cust_name, c.pan_number, c.tan_number, ir.fin_year, f26.total_tds_credited"


@query(
    "tds_summary_view", SUMMARY_TABLES,
    f"select {SUMMARY_COLS}, coalesce((select s from (select tds_section s, row_number() over (order by count(*) desc, tds_section) rn from income_records i2 "
    "where i2.cust_id=c.cust_id and i2.fin_year=ir.fin_year and i2.tds_section<>'—' group by tds_section) q where rn=1),'—') tds_section, "
    "coalesce((select r from (select cast(tds_rate as double) r, row_number() over (order by count(*) desc, tds_rate) rn from income_records i3 "
    "where i3.cust_id=c.cust_id and i3.fin_year=ir.fin_year and i3.tds_section<>'—' group by tds_rate) q where rn=1),0.0) tds_rate "
    f"from cust_master c left join income_records ir on c.cust_id=ir.cust_id left join {F26_ALL} on lower(trim(c.tan_number))=f26.tan and ir.fin_year=f26.fin_year {SUMMARY_GROUP}",
)
def _(d: Domain):
    return summary.tds_summary_view(d.cust_master, d.income_records, d.form26as_records)


@query(
    "dominant_value", SUMMARY_TABLES,
    "select cust_id, fin_year, tds_section from (select cust_id, fin_year, tds_section, row_number() over (partition by cust_id, fin_year order by count(*) desc, tds_section) rn "
    "from income_records where tds_section<>'—' group by cust_id, fin_year, tds_section) q where rn=1",
)
def _(d: Domain):
    found = summary.dominant_values(d.income_records).filter(F.col("top_section").isNotNull())
    return found.select("cust_id", "fin_year", F.col("top_section").alias("tds_section"))


@query(
    "tds_summary_all_years", SUMMARY_TABLES,
    f"select {SUMMARY_COLS} from cust_master c left join income_records ir on c.cust_id=ir.cust_id left join {F26_ALL} "
    f"on lower(trim(c.tan_number))=f26.tan and ir.fin_year=f26.fin_year where ir.fin_year is not null {SUMMARY_GROUP}",
)
def _(d: Domain):
    return summary.tds_summary_fy(d.cust_master, d.income_records, d.form26as_records)


@query(
    "tds_summary_fy", SUMMARY_TABLES,
    f"select {SUMMARY_COLS} from cust_master c left join income_records ir on c.cust_id=ir.cust_id and ir.fin_year='{FY}' left join {F26_ALL} "
    f"on lower(trim(c.tan_number))=f26.tan and f26.fin_year='{FY}' where ir.fin_year='{FY}' {SUMMARY_GROUP}",
)
def _(d: Domain):
    return summary.tds_summary_fy(d.cust_master, d.income_records, d.form26as_records, FY)


@query(
    "distinct_years", SUMMARY_TABLES,
    "select distinct fin_year from income_records union select distinct fin_year from form26as_records",
)
def _(d: Domain):
    return summary.distinct_years(d.income_records, d.form26as_records)


def _report(fy: str = FY, uploads_fy: str = FY) -> str:
    return (
        "select concat(c.cust_id,'_',coalesce(sec_agg.final_section,'—')) summary_id, c.cust_id, c.cust_name, c.pan_number, c.tan_number, coalesce(sec_agg.final_section,'—') tds_section, "
        + num("coalesce(b.total_taxable,0) total_taxable_amt", "coalesce(b.total_deductible,0) total_tds_deductible", "coalesce(g.total_credited,0) total_f26as_credit",
              "coalesce(b.total_deductible,0)-coalesce(g.total_credited,0) variance_amt")
        + ", coalesce(b.inv_count,0) invoice_count from cust_master c left join (select c_name, max(sec_code) final_section from ("
        f"select lower(trim(cust_name)) c_name, tds_section sec_code from income_records where fin_year='{fy}' union "
        f"select lower(trim(deductor_name)), section_code from form26as_records where fin_year='{fy}' union "
        f"select lower(trim(cm.cust_name)), fr.section_code from form26as_records fr join (select distinct fin_year from file_uploads_log where module_name='form26as') ul on ul.fin_year='{uploads_fy}' "
        f"join cust_master cm on lower(rtrim(cm.tan_number))=lower(rtrim(fr.tan_of_deductor)) where fr.fin_year='{fy}') u where sec_code is not null and sec_code<>'' and sec_code<>'—' group by c_name) sec_agg "
        "on lower(trim(c.cust_name))=sec_agg.c_name "
        f"left join (select cust_id, sum(taxable_amt) total_taxable, sum(tds_deductible) total_deductible, count(*) inv_count from income_records where fin_year='{fy}' group by cust_id) b on c.cust_id=b.cust_id "
        f"left join (select lower(rtrim(tan_of_deductor)) tan, sum(tds_credited) total_credited from form26as_records where fin_year='{fy}' group by 1) g on lower(rtrim(c.tan_number))=g.tan "
        "where (coalesce(b.total_taxable,0)>0 or coalesce(b.total_deductible,0)>0 or coalesce(g.total_credited,0)>0)"
    )


def _tds_report(d: Domain, **kw):
    return summary.tds_summary_report(
        d.cust_master, d.income_records, d.form26as_records, d.file_uploads_log, "FY1997-98", **kw
    )


@query("tds_summary_report", SUMMARY_TABLES, _report())
def _(d: Domain):
    return _tds_report(d)


@query(
    "tds_summary_report_filtered", SUMMARY_TABLES,
    _report() + " and lower(c.cust_name) like '%r#0000012%' and sec_agg.final_section='194Q'",
)
def _(d: Domain):
    return _tds_report(d, customer="R#0000012", section="194q")


@query("tds_summary_report_one", SUMMARY_TABLES, _report() + " and c.cust_id=77")
def _(d: Domain):
    return _tds_report(d, customer="77", section="all")


@query(
    "tds_summary_report_page", SUMMARY_TABLES,
    _report() + " order by c.cust_name, c.cust_id limit 100 offset 200",
)
def _(d: Domain):
    return page_of(_tds_report(d), [F.col("cust_name"), F.col("cust_id")], page=3, per_page=100)


@query(
    "section_by_name", SUMMARY_TABLES,
    "select lower(trim(cm.cust_name)) name_key, max(fr.section_code) final_section from form26as_records fr join cust_master cm on lower(rtrim(cm.tan_number))=lower(rtrim(fr.tan_of_deductor)) "
    f"where fr.fin_year='{FY}' and fr.section_code not in ('','—') group by 1 "
    "union all select 'payer', max(section_code) from form26as_records where fin_year='1997-98'",
)
def _(d: Domain):
    """Sections that only the owner of a TAN brings in: the statement names
    another payer and the books carry none; an upload of the year exists."""
    logged = d.file_uploads_log.withColumn("fin_year", F.lit(FY))
    unnamed = d.form26as_records.withColumn("deductor_name", F.lit("Payer"))
    blank = d.income_records.withColumn("tds_section", F.lit("—"))
    return summary.section_by_name(d.cust_master, blank, unnamed, logged, FY)


@query(
    "summary_inline_filter", SUMMARY_TABLES,
    f"select * from ({_report()}) r where variance_amt>0.01 and (lower(cust_name) like '%5%' or lower(pan_number) like '%5%' or lower(tan_number) like '%5%' or lower(tds_section) like '%5%')",
)
def _(d: Domain):
    return summary.summary_inline_filter(_tds_report(d), "5", "under")


@query(
    "summary_selection", SUMMARY_TABLES,
    f"select * from ({_report()}) r where (cast(cust_id as varchar)='12' or lower(cust_name) like '%12%') and lower(tds_section)='194q'",
)
def _(d: Domain):
    return summary.summary_selection(_tds_report(d), "12", "194q")


@query(
    "summary_cards", SUMMARY_TABLES,
    "select count(*) row_count, " + num("sum(total_taxable_amt::decimal(25,2)) taxable", "sum(total_tds_deductible::decimal(25,2)) deductible", "sum(total_f26as_credit::decimal(25,2)) f26as",
    "sum(total_tds_deductible::decimal(25,2))-sum(total_f26as_credit::decimal(25,2)) variance") + f" from ({_report()}) r where lower(tds_section)='194q'",
)
def _(d: Domain):
    return summary.summary_cards(summary.summary_selection(_tds_report(d), section="194Q"))


@query(
    "summary_variance_sign", SUMMARY_TABLES,
    f"select *, case when abs(variance_amt)<0.01 then 'zero' when variance_amt>0 then 'neg' else 'pos' end variance_sign from ({_report()}) r",
)
def _(d: Domain):
    return summary.with_variance_sign(_tds_report(d))


@query(
    "summary_sorted", SUMMARY_TABLES,
    f"select * from ({_report()}) r order by total_tds_deductible desc, cust_id",
)
def _(d: Domain):
    return sorted_by(_tds_report(d), "total_tds_deductible", descending=True, tie_break="cust_id")


@query(
    "summary_export", SUMMARY_TABLES,
    'select coalesce(nullif(cust_name,\'\'),\'—\') "Customer Name", coalesce(nullif(pan_number,\'\'),\'—\') "PAN Number", coalesce(nullif(tan_number,\'\'),\'—\') "TAN Number", tds_section "TDS Section", '
    'total_taxable_amt "Total Taxable Amt", total_tds_deductible "System TDS Deductible", total_f26as_credit "Form 26AS Credit", variance_amt "Variance Amt" '
    f"from ({_report()}) r",
)
def _(d: Domain):
    return summary.summary_export(_tds_report(d))


@query(
    "fy_param_normalise", ["income_records"],
    "select distinct fin_year as raw_year, fin_year clean_year from income_records",
)
def _(d: Domain):
    raw = d.income_records.select("fin_year").distinct()
    written = F.concat(F.lit("fy "), F.replace("fin_year", F.lit("-"), F.lit(" - ")))
    return raw.select(F.col("fin_year").alias("raw_year"), clean_fiscal_year(written).alias("clean_year"))


# -------------------------------------------------------------- assessment

ASSESS_TABLES = ["cust_master", "income_records", "form26as_records", "assess_rates"]
# The row-by-row rule told as queries: invoices annotated with their section,
# annual sums as a window over that section.
ASSESS_SQL = f"""
with chosen as (select * from (select *, row_number() over (partition by upper(trim(section_code)) order by {PRIORITY}, id) rn from assess_rates where is_resident and is_active) x where rn=1),
pairs as (select distinct cm.cust_id, cm.pan_number, f.fin_year, upper(trim(f.section_code)) section_code from cust_master cm join form26as_records f on lower(trim(cm.tan_number))=lower(trim(f.tan_of_deductor))
  where f.section_code is not null and f.section_code not in ('','—','-')),
rated as (select p.cust_id, p.fin_year, p.section_code, r.threshold_limit,
  cast((case when regexp_full_match(upper(trim(p.pan_number)),'[A-Z]{{5}}[0-9]{{4}}[A-Z]') then r.tds_rate else greatest(r.tds_rate,20.000) end)*(1+r.surcharge_pct*0.01)*(1+r.cess_pct*0.01) as decimal(12,6)) rate
  from pairs p join chosen r on upper(trim(r.section_code))=p.section_code),
firsts as (select cust_id, fin_year, min(section_code) first_section from rated group by cust_id, fin_year),
claimed as (select i.*, case when i.tds_section is null or i.tds_section='—' then f.first_section else upper(trim(i.tds_section)) end section_code
  from income_records i left join firsts f on f.cust_id=i.cust_id and f.fin_year=i.fin_year),
summed as (select *, sum(taxable_amt) over (partition by cust_id, fin_year, section_code) annual from claimed)
select s.income_id, s.upload_ref, s.fin_year, s.cust_id, s.cust_name, s.doc_number, {day('s.doc_date', 'doc_date')}, s.doc_type,
{num('s.taxable_amt taxable_amt', 's.tax_amt tax_amt', 's.gross_amt gross_amt')}, case when r.cust_id is null then s.tds_section else s.section_code end tds_section, {num('s.tds_rate tds_rate')},
cast(case when r.cust_id is null then s.tds_deductible when coalesce(r.threshold_limit,0)<>0 and s.annual<r.threshold_limit then 0
  when r.rate>0 then cast(round(s.taxable_amt*r.rate*0.01,2) as decimal(15,2)) else s.tax_amt end as double) tds_deductible, s.entry_source
from summed s left join rated r on r.cust_id=s.cust_id and r.fin_year=s.fin_year and r.section_code=s.section_code"""


@query("reassess_tax", ASSESS_TABLES, ASSESS_SQL)
def _(d: Domain):
    return assess.reassess_tax(d.income_records, d.cust_master, d.form26as_records, d.assess_rates)


@query(
    "customer_sections", ASSESS_TABLES,
    "select distinct cm.cust_id, cm.pan_number, f.fin_year, upper(trim(f.section_code)) section_code from cust_master cm "
    "join form26as_records f on lower(trim(cm.tan_number))=lower(trim(f.tan_of_deductor)) where f.section_code is not null and f.section_code not in ('','—','-')",
)
def _(d: Domain):
    return assess.customer_sections(d.cust_master, d.form26as_records)


@query(
    "annual_taxable", ASSESS_TABLES,
    "select cust_id, fin_year, case when tds_section is null or tds_section='—' then '—' else upper(trim(tds_section)) end booked, "
    + num("sum(taxable_amt) taxable") + ", count(*) n from income_records group by 1, 2, 3",
)
def _(d: Domain):
    return assess.annual_taxable(d.income_records)
