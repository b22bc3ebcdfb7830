"""Variant-like views over the driver's tables; the same SQL text runs in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VARIANTS = """SELECT
  CASE WHEN l_linenumber % 2 = 0 THEN concat('chr', c) ELSE c END AS chrom,
  CAST(100000 + (l_orderkey * 131 + l_linenumber * 17) % 250000 AS INT) AS pos,
  CASE WHEN l_linenumber = 5 THEN lower(r) ELSE r END AS ref,
  CASE WHEN l_linenumber = 6 THEN concat(r, a) WHEN l_linenumber = 7 THEN 'na' ELSE a END AS alt,
  concat('GENE', CAST(l_suppkey AS VARCHAR(10))) AS gene_symbol,
  CASE l_linenumber WHEN 1 THEN 'missense_variant' WHEN 2 THEN 'missense_variant&splice_region_variant'
    WHEN 3 THEN 'synonymous_variant' WHEN 4 THEN 'stop_gained' WHEN 5 THEN 'splice_donor_variant'
    WHEN 6 THEN 'frameshift_variant' ELSE 'intron_variant' END AS consequence,
  CASE WHEN l_returnflag = 'R' THEN 'Pathogenic' WHEN l_returnflag = 'A' THEN 'Likely benign'
    WHEN l_partkey % 7 = 0 THEN 'Conflicting classifications of pathogenicity'
    WHEN l_partkey % 5 = 0 THEN 'Uncertain significance' ELSE 'Benign' END AS clinical_sig,
  CASE WHEN l_quantity > 40 THEN 'reviewed by expert panel' WHEN l_quantity > 20 THEN 'criteria provided, single submitter'
    ELSE 'no assertion criteria provided' END AS review_status,
  CASE WHEN l_tax = 0 THEN NULL ELSE l_discount / (1 + l_orderkey % 1000) END AS allele_freq,
  concat('p.Arg', CAST(1 + l_partkey % 900 AS VARCHAR(10)), 'His') AS protein_change,
  CASE l_suppkey % 4 WHEN 0 THEN 'clinvar' WHEN 1 THEN 'gnomad' WHEN 2 THEN 'uniprot' ELSE 'lovd' END AS source_db,
  l_shipdate AS last_evaluated
FROM (
  SELECT *, CASE WHEN l_partkey % 25 < 22 THEN CAST(1 + l_partkey % 25 AS VARCHAR(10))
                 WHEN l_partkey % 25 = 22 THEN 'X' WHEN l_partkey % 25 = 23 THEN 'Y' ELSE 'M' END AS c,
         substring('ACGT', CAST(1 + l_suppkey % 4 AS INT), 1) AS r,
         substring('ACGT', CAST(1 + (l_suppkey + 1 + l_linenumber % 3) % 4 AS INT), 1) AS a
  FROM {lineitem}) q"""
GENES = """SELECT concat('GENE', CAST(s_suppkey AS VARCHAR(10))) AS gene_symbol,
  CAST(s_suppkey * 37 % 100 AS DOUBLE) / 100.0 AS pli_score, CAST(s_suppkey * 53 % 200 AS DOUBLE) / 100.0 AS loeuf
FROM {supplier} WHERE s_suppkey % 10 <> 0"""
SCORED = """SELECT concat(CAST(l_orderkey AS VARCHAR(12)), '-', CAST(l_linenumber AS VARCHAR(4))) AS variant_id,
  concat('GENE', CAST(l_suppkey AS VARCHAR(10))) AS gene_symbol, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
  CAST((l_orderkey * 7919 + l_linenumber * 104729) % 5000 + CASE WHEN l_returnflag = 'R' THEN 4000 ELSE 0 END AS DOUBLE) / 10000.0 AS score
FROM {lineitem}"""
EDGES = """SELECT DISTINCT concat('GENE', CAST(l_suppkey AS VARCHAR(10))) AS src, concat('GENE', CAST(1 + l_partkey % 100 AS VARCHAR(10))) AS dst,
  400 + l_partkey % 600 AS combined_score FROM {lineitem} WHERE l_linenumber = 1"""
_SIG = """SELECT o_orderkey AS variant_id, CASE ({key}) % 5 WHEN 0 THEN 'Pathogenic' WHEN 1 THEN 'Likely pathogenic'
  WHEN 2 THEN 'Uncertain significance' WHEN 3 THEN 'Likely benign' ELSE 'Benign' END AS clinical_sig
FROM {orders} WHERE o_custkey % 10 <> {rest}"""
RELEASE_OLD = _SIG.replace("{key}", "o_orderkey").replace("{rest}", "0")
RELEASE_NEW = _SIG.replace("{key}", "o_orderkey + CASE WHEN o_custkey % 40 = 7 THEN 3 ELSE 0 END").replace("{rest}", "1")


def view(spark: SparkSession, sf_dir: str, sql: str, name: str) -> DataFrame:
    """The view over its one table."""
    return spark.sql(sql, **{name: spark.read.parquet(f"{sf_dir}/{name}.parquet")})


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, VARIANTS, "lineitem")


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, GENES, "supplier")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, SCORED, "lineitem")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, EDGES, "lineitem")


def releases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return view(spark, sf_dir, RELEASE_OLD, "orders"), view(spark, sf_dir, RELEASE_NEW, "orders")


def plain(sql: str) -> str:
    """The view's SQL for DuckDB, where the tables are registered by name."""
    return sql.replace("{lineitem}", "lineitem").replace("{supplier}", "supplier").replace("{orders}", "orders")
