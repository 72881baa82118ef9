"""Shapes of physical plans: what reaches the scan, what is shuffled."""

import datetime
import re

from conftest import SMALL, rows
from pyspark.sql import functions as F

from tallyfold.plans import assess, audit, ingest, recon, summary
from tallyfold.sources import schemas, seeds, warehouse
from tallyfold.sources.landing import scan_table


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"Exchange (?:hash|range|Single)", plan_of(df)))


def test_filters_and_columns_reach_the_scan(spark):
    df = scan_table(spark, f"{SMALL}/customer.parquet", ["c_name"], F.col("c_acctbal") > 0)
    plan = plan_of(df)
    assert "GreaterThan(c_acctbal,0.0)" in plan
    assert "ReadSchema: struct<c_name:string,c_acctbal:double>" in plan


def test_audit_day_range_is_pushed_down(domain):
    plan = plan_of(audit.audit_search(domain.audit_logs, date_from="2024-01-05", date_to="2024-01-06"))
    pushed = re.search(r"PushedFilters: \[([^\]]*)\]", plan).group(1)
    assert "GreaterThanOrEqual(ts" in pushed and "LessThan(ts" in pushed


def test_reports_shuffle_totals_only(domain):
    """Books and statement are grouped before any join: one exchange each for
    the grouping, the joins ride on broadcasts at this size."""
    d = domain
    view = recon.recon_view(d.cust_master, d.income_records, d.form26as_records, d.recon_overrides)
    plan = plan_of(view)
    assert plan.count("functions=[partial_sum") >= 2
    assert exchanges(view) <= 6
    assert "Window" not in plan


def test_assessment_joins_invoices_once(domain):
    d = domain
    plan = plan_of(assess.reassess_tax(d.income_records, d.cust_master, d.form26as_records, d.assess_rates))
    # Whole invoices are read by one scan; the annual sums come from the stage.
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", plan)
    assert len([s for s in scans if "o_orderstatus" in s and "o_totalprice" in s]) == 1
    assert any("taxable" in s for s in scans)


def test_year_of_a_file_is_a_grouping_over_all_rows(spark):
    days = [("f", 0, i, datetime.date(2023, 5, 1) if i >= 25 else None) for i in range(30)] + [("g", 0, 0, None)]
    data = spark.createDataFrame(days, "file_id string, line_block long, line_no long, doc_date date")
    years = ingest.ledger_years(data)
    assert "Window" not in plan_of(years)
    assert {r["file_id"]: r["fin_year"] for r in years.collect()} == {"f": "2023-24", "g": None}


def test_no_sort_before_hash_aggregates(domain):
    plan = plan_of(summary.tds_summary_fy(domain.cust_master, domain.income_records, domain.form26as_records))
    assert "SortAggregate" not in plan


def test_touched_partitions_prune_the_scan(spark, domain, tmp_path):
    store = warehouse.operational_store(spark, str(tmp_path))
    store.append("income_records", domain.income_records)
    year = store.read("income_records").filter("fin_year = '1997-98'")
    assert re.search(r"PartitionFilters: \[[^\]]*fin_year[^\]]*1997-98", plan_of(year))


def test_seeds(spark):
    tables = seeds.load_rate_tables(spark)
    rates, tcs = tables["tds_codes_master"], tables["tcs_codes_master"]
    assert (rates.filter("is_resident").count(), rates.filter("not is_resident").count(), tcs.count()) == (42, 27, 13)
    assert rates.select("id").distinct().count() == 69
    chosen = dict(rows(assess.rates_for_assessment(rates), "section_code", "id"))
    by_id = {r["id"]: r for r in rates.collect()}
    assert by_id[chosen["194C"]]["payee_type"] == "OTHERS" and str(by_id[chosen["194J"]]["tds_rate"]) == "2.000"


def test_outside_domains(spark):
    df = spark.createDataFrame([("active",), ("odd",), (None,)], "cust_status string")
    assert schemas.outside_domains(df).count() == 2
