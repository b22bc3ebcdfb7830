"""Registered whole jobs and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixspark.operators import evaluation as E
from helixspark.operators import jobs as J
from helixspark.plans.catalog import SCORED_CTE, metrics_sql
from helixspark.sources import fixtures as S

#: Rows as a VCF has them; those of line 3 insert two bases.
VCF_ROWS = """SELECT CAST(1 + l_partkey % 22 AS VARCHAR(10)) AS chrom, CAST(l_orderkey AS INT) AS pos, concat('rs', CAST(l_orderkey AS VARCHAR(12))) AS id,
  substring('ACGT', CAST(1 + l_suppkey % 4 AS INT), 1) AS ref,
  concat(substring('ACGT', CAST(1 + (l_suppkey + 1) % 4 AS INT), 1), CASE WHEN l_linenumber = 3 THEN 'GG' ELSE '' END) AS alt,
  concat('GENE', CAST(l_suppkey AS VARCHAR(10))) AS gene_symbol, l_linenumber, l_discount, l_tax, l_returnflag FROM {lineitem}"""
#: Scores with the date of their variant and its release.
DATED = """SELECT concat(CAST(l_orderkey AS VARCHAR(12)), '-', CAST(l_linenumber AS VARCHAR(4))) AS variant_id, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
  CAST((l_orderkey * 7919 + l_linenumber * 104729) % 5000 + CASE WHEN l_returnflag = 'R' THEN 4000 ELSE 0 END AS DOUBLE) / 10000.0 AS score, l_shipdate, l_linestatus, l_quantity FROM {lineitem}"""


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.view(spark, sf_dir, VCF_ROWS, "lineitem")


def vcf_feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    frequencies = rows.where("l_tax > 0.04").select(*J.N.LOCUS, (F.col("l_discount") / 100).alias("exome_af"))
    labels = rows.where("l_returnflag <> 'N'").select(*J.N.LOCUS, F.when(F.col("l_returnflag") == "R", 2).otherwise(-2).alias("sig_numeric"))
    out = J.vcf_features(rows.select(*J.N.LOCUS, "id"), frequencies, labels)
    return out.select("id", *J.N.LOCUS, "sig_numeric", "is_snv", "is_indel", F.round("log10_af", 6).alias("log10_af"))


def multi_source_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    frequencies = rows.where("l_tax > 0.04").select(*J.N.LOCUS, F.col("l_discount").alias("allele_freq"))
    labels = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderstatus <> 'P'").select(F.concat(F.lit("rs"), F.col("o_orderkey").cast("string")).alias("id"), (F.col("o_orderstatus") == "F").cast("int").alias("label"))
    out = J.feature_matrix(rows.select(*J.N.LOCUS, "id", "gene_symbol"), frequencies, labels, S.genes(spark, sf_dir), ["pli_score", "loeuf"])
    return out.select("id", *J.N.LOCUS, "gene_symbol", "allele_freq", "label", "pli_score", "loeuf")


def temporal_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants shipped after 1995 whose id the training release (ids with a finished line or one of small quantity) has not seen; ids repeat."""
    rows = S.view(spark, sf_dir, DATED, "lineitem")
    return J.temporal_validation(rows, rows.where("l_linestatus = 'F' OR l_quantity < 10"), F.col("l_shipdate") > F.lit("1995-12-31").cast("date"))


def conformal_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.conformal_intervals(S.scored(spark, sf_dir), F.col("variant_id").endswith("-1"))
    return rows.select("variant_id", F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"), "covered")


_QUERIES = (vcf_feature_rows, multi_source_matrix, temporal_validation, conformal_intervals)
_V = f"v AS ({S.plain(VCF_ROWS)})"
_AT = "{0}.chrom = v.chrom AND {0}.pos = v.pos AND {0}.ref = v.ref AND {0}.alt = v.alt"
_ORACLES = {
    "vcf_feature_rows": f"""WITH {_V}, f AS (SELECT chrom, pos, ref, alt, max(l_discount / 100) AS a FROM v WHERE l_tax > 0.04 GROUP BY ALL),
k AS (SELECT chrom, pos, ref, alt, max(CASE l_returnflag WHEN 'R' THEN 2 ELSE -2 END) AS g FROM v WHERE l_returnflag <> 'N' GROUP BY ALL)
SELECT id, v.chrom, v.pos, v.ref, v.alt, g AS sig_numeric, (length(v.alt) = 1)::INT AS is_snv, (length(v.alt) > 1)::INT AS is_indel, CASE WHEN a > 0 THEN round(log10(a), 6) ELSE -8.0::DOUBLE END AS log10_af
FROM v LEFT JOIN f ON {_AT.format('f')} LEFT JOIN k ON {_AT.format('k')}""",
    "multi_source_matrix": f"""WITH {_V}, f AS (SELECT chrom, pos, ref, alt, max(l_discount) AS a FROM v WHERE l_tax > 0.04 GROUP BY ALL), g AS ({S.plain(S.GENES)})
SELECT id, v.chrom, v.pos, v.ref, v.alt, v.gene_symbol, coalesce(a, 0) AS allele_freq, (o_orderstatus = 'F')::INT AS label, coalesce(pli_score, 0) AS pli_score, coalesce(loeuf, 0) AS loeuf
FROM v LEFT JOIN f ON {_AT.format('f')} LEFT JOIN g ON g.gene_symbol = v.gene_symbol LEFT JOIN orders ON v.id = concat('rs', o_orderkey) AND o_orderstatus <> 'P'""",
    "temporal_validation": metrics_sql("").replace(SCORED_CTE, f"d AS ({S.plain(DATED)}), s AS (SELECT * FROM d WHERE l_shipdate > DATE '1995-12-31' AND variant_id NOT IN (SELECT variant_id FROM d WHERE l_linestatus = 'F' OR l_quantity < 10))"),
    "conformal_intervals": f"""WITH {SCORED_CTE}, g AS (SELECT *, abs(label - score) AS gap, variant_id LIKE '%-1' AS cal FROM s), r AS (SELECT gap, row_number() OVER (ORDER BY gap) - 1 AS i, count(*) OVER () AS n FROM g WHERE cal),
h AS (SELECT n, least(1.0, ceil((n + 1) * 0.9) / n::DOUBLE) * (n - 1) AS spot FROM (SELECT max(n) AS n FROM r)),
q AS (SELECT (SELECT gap FROM r WHERE i = floor(spot)) * (1 - spot + floor(spot)) + (SELECT gap FROM r WHERE i = least(n - 1, floor(spot) + 1)) * (spot - floor(spot)) AS q FROM h)
SELECT variant_id, round(greatest(0, score - q), 6) AS lower, round(least(1, score + q), 6) AS upper, gap <= q AS covered FROM g, q WHERE NOT cal""",
}


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict:
    return dict(_ORACLES)
