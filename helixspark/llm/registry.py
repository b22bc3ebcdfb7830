"""The queries of the thirteen operators over the given tables, with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixspark.llm import bpe, collocations, exact_dedup, filter_audit, html_text, language, licenses, line_dedup, mixing, near_dedup, quality, quality_classifier, suffix_dedup
from helixspark.llm.common import table

TOKENIZER = "byte_bpe_50k.json"
WEIGHTS = [5.0, 2.0, 1.0]
MAX_DOCS_PER_LANGUAGE = 2000
MAX_LABELLED_DOCS = 3000


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="largest")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = mixing.curriculum(table(spark, sf_dir, "documents"), WEIGHTS)
    rows = placed.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken", F.get("copies", F.lit(0))["position"].alias("_first"))
    return mixing.range_sorted(rows, "_first").drop("_first")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.similar_components(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents")).drop("text_hash")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER)))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.fit(language.training_rows(docs, MAX_DOCS_PER_LANGUAGE)))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), MAX_LABELLED_DOCS)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_OPERATORS = (op1_exact_dedup, op2_html_extraction, op3_mixing, op4_suffix_dedup, op5_near_dedup, op6_quality_rules, op7_line_dedup, op8_license_scan, op9_bpe, op10_language_id, op11_collocations, op12_quality_classifier, op13_filter_audit)
QUERIES = {f.__name__: f for f in _OPERATORS}
ORACLES = {
    "op1_exact_dedup": exact_dedup.ORACLE,
    "op3_mixing": mixing.ORACLE,
    "op4_suffix_dedup": suffix_dedup.ORACLE,
    "op5_near_dedup": near_dedup.ORACLE,
    "op6_quality_rules": quality.ORACLE,
    "op11_collocations": collocations.ORACLE,
    "op13_filter_audit": filter_audit.ORACLE,
}
