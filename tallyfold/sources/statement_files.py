"""Uploaded tax statements as transactions, from any of the landed layouts.

All give: file_id, line_block, line_no, customer_name, deductor_name,
deductor_tan, section_code, tax_category, document_number, transaction_date,
taxable_amount, tds_deductible. Amounts that are no numbers are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.dates import STATEMENT_DATE_TOKEN, parse_any_date, statement_date
from tallyfold.functions.headers import normalise_headers, resolve
from tallyfold.functions.identifiers import (
    BEFORE_TAN,
    NO_VALUE,
    SECTION_IN_TEXT,
    SECTION_IN_TEXT_EXTENDED,
    TAN_IN_TEXT,
    UNKNOWN_CUSTOMER,
    UNKNOWN_DEDUCTOR,
    blank_to_null,
    code_of,
    repair_split_tan,
    tax_category,
    text_or_blank,
    without_labels,
)
from tallyfold.functions.money import number_or_null, statement_amounts, zero
from tallyfold.operators.joins import lookup_join
from tallyfold.operators.keyed import carry_forward
from tallyfold.sources.landing import META, with_position
from tallyfold.sources.warehouse import stage

# Gaps that separate tokens (beside tab and comma), header mark, row mark and layout phrases.
WIDE_GAP = " {2,}"
WIDE_GAP_ANY = r"\s{2,}"
BLANKS = " \t\n\r\f\v"
HEADER_MARK = "customer_name"
REGISTER_MARK = "inv-"
OFFICIAL_MARKS = ["annual tax statement", "traces"]
ASSESSEE = r"Name of Assessee\s+([A-Za-z0-9 ]+)"
OFFICIAL_DOCUMENT = "TRACES-"
TAN_LIKE = "[A-Z]{4}[0-9]"
DATE_LIKE = "[0-9]{2}-[A-Za-z]{3}-[0-9]{4}"


def _strip(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS))


def _tokens(text: Column, gap: str) -> Column:
    """Split at tabs, commas and wide gaps. Turning all of them into tabs first
    leaves one regular expression, and a split at a plain character."""
    tabbed = F.regexp_replace(F.translate(_strip(text), ",", "\t"), gap, "\t")
    return F.split(tabbed, "\t")


def _transactions(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select(*META, *[c.alias(n) for n, c in columns.items()])


def parse_statement_text(lines: DataFrame) -> DataFrame:
    """Lines split at tabs, commas or runs of spaces; six tokens at least:
    name, document, date, (type), taxable, tax and perhaps the section."""
    kept = with_position(lines).filter(
        (_strip(F.col("text")) != "") & ~F.contains(F.lower("text"), F.lit(HEADER_MARK))
    )
    tokens = kept.withColumn("_t", _tokens(F.col("text"), WIDE_GAP)).filter(F.size("_t") >= 6)

    def token(i: int) -> Column:
        return F.trim(F.coalesce(F.get("_t", F.lit(i)), F.lit("")))

    def amount(i: int) -> Column:
        return F.when(token(i) == "", zero()).otherwise(number_or_null(token(i)))

    section = F.upper(token(6))
    return _transactions(
        tokens,
        customer_name=token(0),
        deductor_name=token(0),
        deductor_tan=F.lit(NO_VALUE),
        section_code=section,
        tax_category=tax_category(section),
        document_number=token(1),
        transaction_date=parse_any_date(token(2)),
        taxable_amount=amount(4),
        tds_deductible=amount(5),
    )


def parse_register_lines(lines: DataFrame) -> DataFrame:
    """Invoice lines of a sales register; lines whose amounts are no numbers
    are skipped."""
    low = F.lower("text")
    kept = with_position(lines).filter(
        F.contains(low, F.lit(REGISTER_MARK)) & ~F.contains(low, F.lit(HEADER_MARK))
    )
    tokens = F.filter(
        F.transform(_tokens(F.col("text"), WIDE_GAP_ANY), lambda t: F.trim(t)), lambda t: t != ""
    )
    rows = kept.withColumn("_t", tokens).filter(F.size("_t") >= 6)

    def token(i: int) -> Column:
        return F.get("_t", F.lit(i))

    return _transactions(
        rows,
        customer_name=token(0),
        deductor_name=token(0),
        deductor_tan=F.lit(NO_VALUE),
        section_code=F.lit(""),
        tax_category=F.lit("TDS"),
        document_number=token(1),
        transaction_date=parse_any_date(F.replace(token(2), F.lit("/"), F.lit("-"))),
        taxable_amount=number_or_null(token(4)),
        tds_deductible=number_or_null(token(5)),
    ).filter(F.col("taxable_amount").isNotNull() & F.col("tds_deductible").isNotNull())


def read_statement_table(rows: DataFrame) -> DataFrame:
    """A landed statement sheet: file_id and line_no beside its columns."""
    placed = with_position(rows)
    sheet = [c for c in placed.columns if c not in META]
    names = normalise_headers(sheet)
    table = placed.select(*META, *[F.col(f"`{c}`").alias(n) for c, n in zip(sheet, names, strict=True)])

    def given(*aliases: str) -> Column:
        name = resolve(names, aliases)
        return F.lit("") if name is None else text_or_blank(F.col(name))

    def amount(*aliases: str) -> Column:
        value = given(*aliases)
        return F.when(value == "", zero()).otherwise(number_or_null(value))

    section = code_of(F.coalesce(blank_to_null(given("tds_section")), given("section_code")))
    parsed = _transactions(
        table,
        customer_name=given("customer_name"),
        deductor_name=given("customer_name"),
        deductor_tan=F.lit(NO_VALUE),
        section_code=section,
        tax_category=tax_category(section),
        document_number=given("document_number"),
        transaction_date=parse_any_date(given("document_date")),
        taxable_amount=amount("taxable_amount"),
        tds_deductible=amount("tds_deductible"),
    )
    return parsed.filter((F.col("customer_name") != "") | (F.col("document_number") != ""))


def statement_layouts(lines: DataFrame) -> DataFrame:
    """Per file from its first page: whether it is the official statement, and
    the assessee's name."""
    first = lines.filter(F.col("page_no") == 1).withColumn("_line", F.regexp_replace("text", " +", " "))
    low = F.lower("_line")
    official = F.lit(False)
    for mark in OFFICIAL_MARKS:
        official = official | F.contains(low, F.lit(mark))
    name = blank_to_null(F.regexp_extract("_line", ASSESSEE, 1))
    return first.groupBy("file_id").agg(
        F.coalesce(F.bool_or(official), F.lit(False)).alias("is_official"),
        F.min_by(name, F.when(name.isNotNull(), F.col("line_no"))).alias("assessee"),
    )


def parse_statement_pages(lines: DataFrame, batch: str = "", extended: bool = False) -> DataFrame:
    """Text lines of statement pages (file_id, page_no, line_no, text): the
    official layout or a sales register, whichever the first page shows."""
    layouts = statement_layouts(lines)
    official = layouts.filter("is_official").select("file_id", "assessee")
    register = lines.join(official, "file_id", "left_anti").withColumn("line_no", _position())
    found = parse_statement_lines(lines, official, batch, extended)
    return found.unionByName(parse_register_lines(register.drop("page_no")))


def _position() -> Column:
    return F.shiftleft(F.col("page_no").cast("long"), 32) + F.col("line_no").cast("long")


def parse_statement_lines(
    lines: DataFrame, official: DataFrame, batch: str = "", extended: bool = False
) -> DataFrame:
    """Transactions of official statements; each belongs to the last deductor
    line before it, on its own page or an earlier one.

    Lines that are neither a deductor nor a transaction are dropped before
    anything is shuffled. ``official`` has file_id and assessee.
    """
    # Lines without anything like a TAN or a dated section go first, told from
    # the text as it is; what is in the others is taken apart once, pattern by
    # pattern, and only then interpreted.
    section_form = SECTION_IN_TEXT_EXTENDED if extended else SECTION_IN_TEXT
    text = F.col("text")
    kept = lines.filter(text.rlike(TAN_LIKE) | (text.rlike(DATE_LIKE) & text.rlike(section_form)))
    collapsed = F.trim(F.regexp_replace("text", " +", " "))
    read = kept.select("file_id", _position().alias("line_no"), collapsed.alias("_line"))
    joined = read.withColumn("_joined", repair_split_tan(F.col("_line")))
    found = joined.select(
        "file_id", "line_no",
        F.regexp_extract("_joined", TAN_IN_TEXT, 1).alias("_tan"),
        F.regexp_extract("_joined", BEFORE_TAN, 1).alias("_name"),
        F.regexp_extract("_line", section_form, 1).alias("_section"),
        F.regexp_extract("_line", STATEMENT_DATE_TOKEN, 1).alias("_day"),
        statement_amounts(F.col("_line"), signed=extended).alias("_amounts"),
    )
    parts = found.select(
        "file_id", "line_no",
        blank_to_null(F.col("_tan")).alias("_tan"),
        without_labels(F.col("_name")).alias("_name"),
        F.when(F.col("_day") != "", blank_to_null(F.upper("_section"))).alias("_section"),
        statement_date(F.col("_day")).alias("_date"),
        "_amounts",
    )
    marked = parts.select(
        "file_id", "line_no",
        F.when(
            F.col("_tan").isNotNull(), F.struct(F.col("_tan").alias("tan"), F.col("_name").alias("name"))
        ).alias("deductor"),
        F.when(
            F.col("_tan").isNull() & F.col("_section").isNotNull() & (F.size("_amounts") >= 2),
            F.struct(
                F.col("_section").alias("section"),
                F.col("_date").alias("date"),
                number_or_null(F.element_at("_amounts", 1)).alias("taxable"),
                number_or_null(F.element_at("_amounts", -1)).alias("tax"),
            ),
        ).alias("txn"),
    )
    # The fill reads its input twice; staged, lines are parsed once.
    marked = stage(marked, "statement-lines").filter(F.col("deductor").isNotNull() | F.col("txn").isNotNull())
    owned = carry_forward(marked, "file_id", "line_no", "deductor").filter(F.col("txn").isNotNull())
    # The files' names come in after the parsing, on the transactions alone.
    named = lookup_join(owned, official, ["file_id"], how="inner")
    section = F.col("txn.section")
    return _transactions(
        with_position(named),
        customer_name=F.coalesce("assessee", F.lit(UNKNOWN_CUSTOMER)),
        deductor_name=F.coalesce(F.col("deductor.name"), F.lit(UNKNOWN_DEDUCTOR)),
        deductor_tan=F.coalesce(F.col("deductor.tan"), F.lit(NO_VALUE)),
        section_code=section,
        tax_category=tax_category(section),
        document_number=F.lit(f"{OFFICIAL_DOCUMENT}{batch}"),
        transaction_date=F.col("txn.date"),
        taxable_amount=F.col("txn.taxable"),
        tds_deductible=F.col("txn.tax"),
    )
