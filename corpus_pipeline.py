"""Corpus pipeline: documents of low quality go, repeated lines go, one
document of each near-duplicate group stays, documents that hold benchmark
passages go, and what is left is mixed by source.

Each stage takes all rows of the one before, as a table read back, and its
decisions take effect; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm.decontam import drop_contaminated
from tallyfold.llm.lines import drop_repeated_lines
from tallyfold.llm.mixing import mix_sources, word_count
from tallyfold.llm.ngram_join import near_duplicate_groups
from tallyfold.llm.quality import fit_quality, graded, with_quality
from tallyfold.llm.tables import stage, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the ordinal model, fitted on the rated ones,
    accepts."""
    model = fit_quality(docs, graded(table(spark, sf_dir, "labels")))
    return with_quality(docs, model).filter("quality_score.accepted").select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first of the lines that ten or more documents share. A
    document that had words and has none left is a copy and goes."""
    kept = drop_repeated_lines(docs, min_docs=10, keep_first=True)
    had, has = word_count(F.coalesce("text", F.lit(""))) > 0, word_count(F.col("kept_text")) > 0
    kept = kept.filter((F.col("n_dropped") == 0) | ~had | has)
    changed = F.col("n_dropped") > 0
    columns = {
        "text": F.when(changed, F.col("kept_text")).otherwise(F.col("text")).alias("text"),
        "n_chars": F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"),
    }
    return kept.select(*(columns.get(c, F.col(c)) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of each group of documents linked by five-word shingles at 0.8,
    the one with the least id; rows without an id or words stay."""
    groups = near_duplicate_groups(docs, percent=80, words=5)
    copies = groups.filter("doc_id != component_id").select("doc_id").distinct()
    kept = docs.join(copies, "doc_id", "left_anti")
    return kept.select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents without a passage of a benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mix_sources(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", source_mix),
]

# A fitted model and similarity links are beyond SQL; tests/llm compares the
# stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
