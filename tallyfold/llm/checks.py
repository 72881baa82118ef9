"""Registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm import lines, pii
from tallyfold.llm.alignment import align_tokenizers
from tallyfold.llm.decontam import contaminated_passages
from tallyfold.llm.digest import edited_fingerprints
from tallyfold.llm.html import extract_text
from tallyfold.llm.manifest import manifest
from tallyfold.llm.mixing import mix_sources
from tallyfold.llm.ngram_join import near_duplicate_groups
from tallyfold.llm.packing import pack_documents
from tallyfold.llm.ppm import score_texts
from tallyfold.llm.quality import fit_quality, graded, with_quality
from tallyfold.llm.tables import table
from tallyfold.llm.urls import judge_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame] | None = None, *, sql: str | None = None):
    """Register a query under its function's name, with the SQL that must
    return the same rows where SQL can express it."""
    if fn is None:
        return lambda f: query(f, sql=sql)
    QUERIES[fn.__name__] = fn
    if sql:
        SQL[fn.__name__] = sql
    return fn


@query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_spans(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *(pii.count_of(kind).alias(f"n_{kind}") for kind in pii.KINDS),
        F.sha2(pii.written(kinds=pii.BASE_KINDS), 256).alias("base_sha256"),
        pii.written().alias("spans"),
    )


@query
def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


@query
def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


@query
def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(table(spark, sf_dir, "documents"), percent=85, words=4)


@query
def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


@query
def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


@query
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, graded(table(spark, sf_dir, "labels")))
    return with_quality(docs, model).select("doc_id", "quality_score.*")


@query
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "score")


@query(sql=lines.KEPT_SQL)
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


@query
def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents"))
