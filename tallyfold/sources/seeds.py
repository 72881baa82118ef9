"""Statutory rate tables as shipped: rows and loaders."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from tallyfold.sources.schemas import RATES, TCS

EFFECTIVE_FROM = date(2024, 4, 1)
TCS_FROM = date(2026, 4, 1)

# Statutory deduction rates. Section, sub-code, nature of the
# payment, payee, percent, annual limit, form. Residents first.
RESIDENT_RATES = [
    ("192", None, "Payment of salary", "ALL", "0.000", None, "Form 16"),
    ("192A", None, "Payment of accumulated balance of provident fund taxable in hands of employee", "ALL", "10.000", 50000, "Form 16A"),
    ("193", "a", "Interest on debentures/securities by local authority or corporation", "ALL", "10.000", None, "Form 16A"),
    ("193", "b", "Interest on listed debentures issued by a company", "ALL", "10.000", None, "Form 16A"),
    ("193", "c", "Interest on Central/State Government security (8% Savings Bonds etc.)", "ALL", "10.000", None, "Form 16A"),
    ("193", "d", "Interest on any other security", "ALL", "10.000", None, "Form 16A"),
    ("194", None, "Income by way of dividend", "ALL", "10.000", 5000, "Form 16A"),
    ("194A", None, "Income by way of interest other than interest on securities", "ALL", "10.000", 40000, "Form 16A"),
    ("194B", None, "Income by way of winnings from lotteries, crossword puzzles, card games, gambling", "ALL", "30.000", 10000, "Form 16A"),
    ("194BA", None, "Income by way of winnings from any online game", "ALL", "30.000", None, "Form 16A"),
    ("194BB", None, "Income by way of winnings from horse races", "ALL", "30.000", 10000, "Form 16A"),
    ("194C", "a", "Payment to contractor/sub-contractor — Individual/HUF", "INDIVIDUAL_HUF", "1.000", 100000, "Form 16A"),
    ("194C", "b", "Payment to contractor/sub-contractor — Others (Company/Firm/etc.)", "OTHERS", "2.000", 100000, "Form 16A"),
    ("194D", None, "Insurance commission", "ALL", "5.000", 15000, "Form 16A"),
    ("194DA", None, "Payment in respect of life insurance policy", "ALL", "2.000", 100000, "Form 16A"),
    ("194EE", None, "Payment in respect of deposit under National Savings Scheme", "ALL", "10.000", 2500, "Form 16A"),
    ("194F", None, "Payment on account of repurchase of unit by Mutual Fund or Unit Trust of India", "ALL", "20.000", None, "Form 16A"),
    ("194G", None, "Commission on sale of lottery tickets", "ALL", "2.000", 15000, "Form 16A"),
    ("194H", None, "Commission or brokerage", "ALL", "2.000", 15000, "Form 16A"),
    ("194I", "a", "Rent — Plant and Machinery", "ALL", "2.000", 240000, "Form 16A"),
    ("194I", "b", "Rent — Land or building or furniture or fitting", "ALL", "10.000", 240000, "Form 16A"),
    ("194IA", None, "Payment on transfer of certain immovable property other than agricultural land", "ALL", "1.000", 5000000, "Form 26QB"),
    ("194IB", None, "Payment of rent by individual or HUF not liable to tax audit", "INDIVIDUAL_HUF", "2.000", 50000, "Form 26QC"),
    ("194IC", None, "Payment of monetary consideration under Joint Development Agreements", "ALL", "10.000", None, "Form 16A"),
    ("194J", "a", "Fees for technical services / royalty for cinematographic films / call centre", "ALL", "2.000", 30000, "Form 16A"),
    ("194J", "b", "Fees for professional services — Any other sum", "ALL", "10.000", 30000, "Form 16A"),
    ("194K", None, "Income in respect of units payable to resident person", "ALL", "10.000", 5000, "Form 16A"),
    ("194LA", None, "Payment of compensation on acquisition of certain immovable property", "ALL", "10.000", 250000, "Form 16A"),
    ("194LBA", "1", "Business trust distributing interest from SPV or rental income to unit holders", "ALL", "10.000", None, "Form 16A"),
    ("194LBB", None, "Investment fund paying income to resident unit holder", "ALL", "10.000", None, "Form 16A"),
    ("194LBC", None, "Income from investment in securitisation trust — resident", "ALL", "10.000", None, "Form 16A"),
    ("194M", None, "Commission, brokerage, contractual fee, professional fee paid by Individual/HUF not covered under 194C/194H/194J", "INDIVIDUAL_HUF", "2.000", 5000000, "Form 16A"),
    ("194N", "a", "Cash withdrawal exceeding Rs. 1 crore", "ALL", "2.000", 10000000, "Form 16A"),
    ("194N", "b", "Cash withdrawal exceeding Rs. 20 lakhs — ITR non-filer", "ALL", "2.000", 2000000, "Form 16A"),
    ("194O", None, "Payment/credit by e-commerce operator to e-commerce participant", "ALL", "0.100", 500000, "Form 16A"),
    ("194P", None, "Deduction of tax by specified bank for senior citizen aged 75 or more", "ALL", "0.000", None, "Form 16A"),
    ("194Q", None, "Payment for purchase of goods exceeding Rs. 50 lakhs", "ALL", "0.100", 5000000, "Form 16A"),
    ("194R", None, "Deduction on benefit or perquisite provided arising from business/profession", "ALL", "10.000", 20000, "Form 16A"),
    ("194S", None, "Payment on transfer of Virtual Digital Asset (VDA/Crypto)", "ALL", "1.000", 10000, "Form 16A"),
    ("194T", None, "Payments of salary/remuneration/commission/bonus/interest to partner of firm", "ALL", "10.000", 20000, "Form 16A"),
    ("195", None, "Payment of any other sum — catch-all for non-resident", "ALL", "10.000", None, "Form 16A"),
    ("OTHER", None, "Any other income not covered under specific sections", "ALL", "10.000", None, "Form 16A"),
]
NON_RESIDENT_RATES = [
    ("192", None, "Payment of salary to non-resident", "ALL", "0.000", None, "Form 16"),
    ("192A", None, "PF withdrawal — non-resident", "ALL", "10.000", None, "Form 16A"),
    ("194B", None, "Lottery winnings — non-resident", "ALL", "30.000", None, "Form 16A"),
    ("194BA", None, "Online game winnings — non-resident", "ALL", "30.000", None, "Form 16A"),
    ("194BB", None, "Horse race winnings — non-resident", "ALL", "30.000", None, "Form 16A"),
    ("194E", None, "Payment to non-resident sportsmen or sports association", "ALL", "20.000", None, "Form 16A"),
    ("194EE", None, "Payment in respect of NSS deposits — non-resident", "ALL", "10.000", None, "Form 16A"),
    ("194F", None, "Mutual Fund repurchase — non-resident", "ALL", "20.000", None, "Form 16A"),
    ("194G", None, "Lottery commission — non-resident", "ALL", "2.000", None, "Form 16A"),
    ("194LB", None, "Payment of interest on infrastructure debt fund — non-resident", "ALL", "5.000", None, "Form 16A"),
    ("194LBA", "2a", "Business trust distribution — Section 10(23FC)(a) — non-resident", "ALL", "5.000", None, "Form 16A"),
    ("194LBA", "2b", "Business trust distribution — Section 10(23FC)(b) — non-resident", "ALL", "10.000", None, "Form 16A"),
    ("194LBA", "3", "Business trust distribution — Section 10(23FCA) — non-resident", "ALL", "30.000", None, "Form 16A"),
    ("194LBB", None, "Investment fund income — non-resident unit holder", "ALL", "30.000", None, "Form 16A"),
    ("194LBC", None, "Securitisation trust income — non-resident", "ALL", "30.000", None, "Form 16A"),
    ("194LC", None, "Interest by Indian company on foreign currency borrowing/long-term bonds", "ALL", "5.000", None, "Form 16A"),
    ("194LD", None, "Interest on rupee denominated bond to FII/Qualified Foreign Investor", "ALL", "5.000", None, "Form 16A"),
    ("194N", "a", "Cash withdrawal exceeding Rs. 1 crore — non-resident", "ALL", "2.000", 10000000, "Form 16A"),
    ("194N", "b", "Cash withdrawal exceeding Rs. 20 lakhs — non-resident ITR non-filer", "ALL", "2.000", 2000000, "Form 16A"),
    ("194T", None, "Partner payment from firm — non-resident", "ALL", "10.000", 20000, "Form 16A"),
    ("195", "a", "Income in respect of investment made by Non-Resident Indian Citizen", "ALL", "20.000", None, "Form 16A"),
    ("195", "b", "Long-term capital gains u/s 115E — Non-Resident Indian", "ALL", "12.500", None, "Form 16A"),
    ("195", "c", "Long-term capital gains u/s 112(1)(c)(iii)", "ALL", "12.500", None, "Form 16A"),
    ("195", "d", "Long-term capital gains u/s 112A exceeding Rs. 1,25,000", "ALL", "12.500", 125000, "Form 16A"),
    ("195", "e", "Short-term capital gains u/s 111A", "ALL", "20.000", None, "Form 16A"),
    ("195", "f", "Any other long-term capital gains", "ALL", "12.500", None, "Form 16A"),
    ("195", "g", "Any other income to non-resident", "ALL", "30.000", None, "Form 16A"),
]

# Collection codes of the first quarter of 2026-27. Ledger
# account, section, percent, applicability, description; one per customer.
TCS_YEAR, TCS_QUARTER = "2026-27", "Q1"
ABOLISHED = "Exempted - Former 206C(1H) removed by 2025 Act"
TCS_CODES = [
    ("GL-5201", "394", "2.00", "Scrap Buyer Profile", "Collection on manufacturing scrap clearance"),
    ("GL-5205", "ABOLISHED", "0.00", "Bulk Goods Purchase", ABOLISHED),
    ("GL-5201", "394", "2.00", "Timber Merchant", "Timber contract sale clearance allocation"),
    ("GL-5205", "ABOLISHED", "0.00", "Hardware Logistics", ABOLISHED),
    ("GL-5201", "394", "2.00", "Mineral Contractor", "Collection on mining ore material clearance"),
    ("GL-5205", "ABOLISHED", "0.00", "Consumer Electronic", ABOLISHED),
    ("GL-5201", "394", "2.00", "Scrap Yard Operator", "Industrial waste processing clearing sales"),
    ("GL-5205", "ABOLISHED", "0.00", "Automotive Vendor", ABOLISHED),
    ("GL-5201", "394", "2.00", "Quarry Operations", "Stone aggregate logistics trade processing"),
    ("GL-5205", "ABOLISHED", "0.00", "Textile Manufacturer", ABOLISHED),
    ("GL-5201", "394", "2.00", "Scrap Buyer Profile", "Metal scrap disposal compliance clearing"),
    ("GL-5205", "ABOLISHED", "0.00", "Chemical Distributor", ABOLISHED),
    ("GL-5205", "ABOLISHED", "0.00", "Paper Mill Volume", ABOLISHED),
]


def rate_rows() -> list[tuple]:
    nil = Decimal("0.00")
    both = [(True, r) for r in RESIDENT_RATES] + [(False, r) for r in NON_RESIDENT_RATES]
    return [
        (
            number, section, sub, text, payee, resident, Decimal(pct), nil, nil, limit, None, form,
            EFFECTIVE_FROM, True, None,
        )
        for number, (resident, (section, sub, text, payee, pct, limit, form)) in enumerate(both, start=1)
    ]


def tcs_rows() -> list[tuple]:
    nil = Decimal("0.00")
    return [
        (
            number, number, TCS_YEAR, TCS_QUARTER, account, section, "—", Decimal(pct), nil, nil,
            "Form 27D", who, text, TCS_FROM,
        )
        for number, (account, section, pct, who, text) in enumerate(TCS_CODES, start=1)
    ]


def load_rate_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """The deduction and collection rate tables; notes no report reads are null."""
    return {
        "tds_codes_master": spark.createDataFrame(rate_rows(), RATES),
        "tcs_codes_master": spark.createDataFrame(tcs_rows(), TCS),
    }


def rates_as_values() -> str:
    """The deduction rates a comparison in plain SQL needs, as VALUES."""
    rows = ", ".join(
        f"({r[0]}, '{r[1]}', '{r[4]}', {str(r[5]).lower()}, cast({r[6]} as decimal(6,3)))" for r in rate_rows()
    )
    return f"(values {rows}) as seed(id, section_code, payee_type, is_resident, tds_rate)"
