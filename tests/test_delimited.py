"""Split-safe delimited reader against one-task parsing of the whole file."""

import csv
import io
import random

import pytest

from tallyfold.sources.delimited import read_delimited

NAMES = ["code", "doc_no", "note", "amount"]


def _file_text(n: int, seed: int) -> str:
    rnd = random.Random(seed)
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n", quoting=csv.QUOTE_MINIMAL)
    w.writerow(NAMES)
    for i in range(n):
        kind = rnd.randrange(6)
        note = [
            "plain",
            "two\nlines",
            'says "hi", twice',
            "a,b,c",
            "many\n\nbreaks\n,\"\n end",
            "ünïcode ✓",
        ][kind]
        w.writerow([f"C{i % 7}", f"INV-{i}", note, str(i)])
        if rnd.random() < 0.05:
            out.write("\n")  # a blank line between records
    return out.getvalue()


def _one_task(text: str) -> list[tuple]:
    rows = list(csv.reader(io.StringIO(text)))
    return sorted(tuple(r) for r in rows[1:] if r)


@pytest.mark.parametrize("split_bytes", ["700", "4096", "134217728"])
def test_equal_to_one_task_parse_for_every_split_size(spark, tmp_path, split_bytes):
    texts = {"a.csv": _file_text(600, 1), "b.csv": _file_text(50, 2)}
    for name, text in texts.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    try:
        got = read_delimited(spark, [str(tmp_path / n) for n in texts], NAMES, block_lines=13)
        rows = got.collect()
        if split_bytes == "700":
            assert len({(r["file_id"], r["line_block"]) for r in rows}) > 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = sorted(_one_task(texts["a.csv"]) + _one_task(texts["b.csv"]))
    assert sorted(tuple(r[n] for n in NAMES) for r in rows) == want
    # Records keep file order: line_no rises with the document number.
    a = sorted((r["line_no"], int(r["amount"])) for r in rows if r["file_id"].endswith("a.csv"))
    assert [amount for _, amount in a] == list(range(600))


def test_open_quote_runs_to_the_end_and_header_only_file(spark, tmp_path):
    (tmp_path / "open.csv").write_text('code,doc_no,note,amount\nC1,D1,"never closed\nC2,D2,x,2\n', encoding="utf-8")
    (tmp_path / "head.csv").write_text("code,doc_no,note,amount\n", encoding="utf-8")
    got = read_delimited(spark, [str(tmp_path / "open.csv"), str(tmp_path / "head.csv")], NAMES).collect()
    assert len(got) == 1 and got[0]["code"] == "C1" and got[0]["note"] == "never closed\nC2,D2,x,2"


def test_ledger_upload_keeps_quoted_line_break_as_one_row(spark, tmp_path):
    from tallyfold.sources import landing

    (tmp_path / "l.txt").write_text('code,doc_no,date,taxable\nC1,"INV\n1",2024-04-15,10\nC2,INV-2,2024-04-16,20\n')
    (frame,) = landing.read_books_delimited(spark, [str(tmp_path / "l.txt")])
    got = sorted((r["code"], r["doc_no"]) for r in frame.collect())
    assert got == [("C1", "INV\n1"), ("C2", "INV-2")]


def test_blocks_without_open_quotes_are_not_shuffled(spark):
    """Lines of a block without an odd quote are records as they are; only the
    lines of records of several lines are gathered."""
    from pyspark.sql import functions as F

    from tallyfold.sources.delimited import records

    text = F.when(F.col("id") == 41, 'a,"b').when(F.col("id") == 43, 'c",d').when(F.col("id") == 70, 'x,"y""z"').otherwise(F.concat(F.lit("r,"), "id"))
    lines = spark.range(100).select(
        F.lit("f").alias("file_id"), F.lit(0).cast("long").alias("line_block"), F.col("id").alias("line_index"), text.alias("text")
    )
    got = records(lines, block_lines=10)
    assert "collect_list" in got._jdf.queryExecution().optimizedPlan().toString()
    by_line = {r["line_no"]: r["record"] for r in got.collect()}
    assert len(by_line) == 98 and by_line[41] == 'a,"b\nr,42\nc",d' and by_line[70] == 'x,"y""z"' and by_line[99] == "r,99"
    plain = records(lines.filter("line_index < 40"), block_lines=10)
    gathered = plain.filter("record like '%\n%'")
    assert plain.count() == 40 and gathered.count() == 0
