"""Registered queries of the variant library and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixspark.operators import variants as V
from helixspark.operators.intervals import hit_counts
from helixspark.operators.selection import kept
from helixspark.sources import fixtures as S


def top_pathogenic_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = V.labelled(V.normalize(S.variants(spark, sf_dir)), max_tier=3)
    return V.pathogenic_by_gene(V.priority_dedup(clean)).select("gene_symbol", "n_pathogenic").orderBy(F.desc("n_pathogenic"), "gene_symbol").limit(10)


def normalized_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.normalize(S.variants(spark, sf_dir)).select("chrom", "pos", "ref", "alt", "locus", "gene_symbol")


def variant_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.with_features(V.normalize(S.variants(spark, sf_dir))).select(
        "locus", "gene_symbol", "af_absent", "af_ultra_rare", "af_rare", "af_common", "len_diff", "is_snv", "is_insertion", "is_deletion", "severity", "is_lof", "is_missense", "is_synonymous", "is_splice", "in_coding", "codon_number", "codon_phase")


def gene_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.lookup_left(V.normalize(S.variants(spark, sf_dir)), S.genes(spark, sf_dir), ["gene_symbol"], {"pli_score": 0.0, "loeuf": 1.0})
    return rows.groupBy("gene_symbol").agg(F.count("*").alias("n"), F.round(F.avg("pli_score"), 6).alias("pli_score"), F.round(F.avg("loeuf"), 6).alias("loeuf"))


def source_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.normalize(S.variants(spark, sf_dir)).groupBy("source_db", "clinical_sig").agg(F.count("*").alias("n"), F.count_distinct("locus").alias("n_loci"))


def gene_pathogenic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.pathogenic_by_gene(V.labelled(V.normalize(S.variants(spark, sf_dir))))


def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.normalize(S.variants(spark, sf_dir))
    spans = rows.where("consequence = 'stop_gained' AND clinical_sig = 'Pathogenic' AND review_status LIKE '%expert panel%'").select("chrom", (F.col("pos") - 200).alias("lo"), (F.col("pos") + 300).alias("hi"), F.col("gene_symbol").alias("cre_id"))
    loci = kept(rows.groupBy("locus", "chrom", "pos").agg(F.count("*").alias("n")))
    hits = loci.join(hit_counts(loci, spans, "cre_id"), ["chrom", "pos"])
    return hits.select("locus", (F.col("n") * F.col("n_hits")).alias("n_hits"), "n_elements")


def score_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.score_metrics(S.scored(spark, sf_dir))


def gene_score_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.score_metrics(S.scored(spark, sf_dir), ["gene_symbol"])


def calibration_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.calibration_table(S.scored(spark, sf_dir))


def release_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.release_directions(*S.releases(spark, sf_dir))


def quantity_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_extendedprice", (F.col("l_linenumber") % 2).alias("late"))
    return V.two_sample_distances(lines, "l_extendedprice", "late")


_QUERIES = (top_pathogenic_genes, normalized_variants, variant_features, gene_left_join, source_report, gene_pathogenic_counts, interval_overlap, score_metrics, gene_score_metrics, calibration_table, release_directions, quantity_drift)

NORM = f"""v AS ({S.plain(S.VARIANTS)}),
n1 AS (SELECT *, upper(regexp_replace(trim(chrom), '^[cC][hH][rR]', '')) AS c1, upper(trim(ref)) AS r1, upper(trim(alt)) AS a1 FROM v),
n AS (SELECT CASE WHEN c1 = 'M' THEN 'MT' ELSE c1 END AS chrom, pos, r1 AS ref, a1 AS alt, gene_symbol, consequence, clinical_sig, review_status, allele_freq, protein_change, source_db, last_evaluated,
  concat_ws(':', CASE WHEN c1 = 'M' THEN 'MT' ELSE c1 END, CAST(pos AS VARCHAR), r1, a1) AS locus
  FROM n1 WHERE r1 NOT IN ('NA', 'NAN', '.', '') AND a1 NOT IN ('NA', 'NAN', '.', '')),
l AS (SELECT *, CASE WHEN clinical_sig IN ('Pathogenic', 'Likely pathogenic') THEN 1 WHEN clinical_sig IN ('Benign', 'Likely benign') THEN 0 END AS label,
  CASE WHEN review_status LIKE '%expert panel%' THEN 1 WHEN review_status LIKE '%single submitter%' THEN 3 WHEN review_status LIKE 'no assertion%' THEN 4 ELSE 5 END AS tier FROM n)"""
SCORED_CTE = f"s AS ({S.plain(S.SCORED)})"


def metrics_sql(by: str) -> str:
    key, part, group = (f"{by}, ", f"PARTITION BY {by} ", f" GROUP BY {by}") if by else ("", "", "")
    return f"""WITH {SCORED_CTE}, h AS (SELECT {key}score, sum(label) AS p, sum(1 - label) AS n, sum(pow(score - label, 2)) AS b FROM s GROUP BY {key}score),
r AS (SELECT *, coalesce(sum(n) OVER ({part}ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM h)
SELECT {key}CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(n) AS BIGINT) AS n_neg, CAST(sum(CASE WHEN score >= 0.5 THEN p ELSE 0 END) AS BIGINT) AS tp,
  CAST(sum(CASE WHEN score >= 0.5 THEN n ELSE 0 END) AS BIGINT) AS fp,
  round(CAST(sum(p * (below + n / 2.0)) AS DOUBLE) / nullif(sum(p) * sum(n), 0), 6) AS auroc, round(sum(b) / (sum(p) + sum(n)), 6) AS brier FROM r{group}"""


_ORACLES = {
    "top_pathogenic_genes": f"""WITH {NORM}, d AS (SELECT * FROM l WHERE label IS NOT NULL AND tier <= 3 QUALIFY row_number() OVER (PARTITION BY locus ORDER BY
  CASE source_db WHEN 'clinvar' THEN 1 WHEN 'gnomad' THEN 2 WHEN 'uniprot' THEN 3 ELSE 4 END, last_evaluated DESC NULLS LAST,
  chrom, pos, ref, alt, gene_symbol, consequence, clinical_sig, review_status, allele_freq NULLS FIRST, protein_change, source_db) = 1)
SELECT gene_symbol, CAST(sum(label) AS BIGINT) AS n_pathogenic FROM d GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
    "normalized_variants": f"WITH {NORM} SELECT chrom, pos, ref, alt, locus, gene_symbol FROM n",
    "variant_features": f"""WITH {NORM} SELECT locus, gene_symbol, CAST(coalesce(allele_freq, 0) = 0 AS INT) AS af_absent, CAST(coalesce(allele_freq, 0) < 0.0001 AS INT) AS af_ultra_rare,
  CAST(coalesce(allele_freq, 0) >= 0.0001 AND allele_freq < 0.001 AS INT) AS af_rare, CAST(coalesce(allele_freq, 0) >= 0.01 AS INT) AS af_common,
  CAST(abs(length(ref) - length(alt)) AS INT) AS len_diff, CAST(length(ref) = 1 AND length(alt) = 1 AS INT) AS is_snv, CAST(length(alt) > length(ref) AS INT) AS is_insertion,
  CAST(length(alt) < length(ref) AS INT) AS is_deletion,
  CASE consequence WHEN 'splice_donor_variant' THEN 9 WHEN 'stop_gained' THEN 9 WHEN 'frameshift_variant' THEN 8 WHEN 'missense_variant' THEN 5
    WHEN 'missense_variant&splice_region_variant' THEN 5 WHEN 'synonymous_variant' THEN 2 WHEN 'intron_variant' THEN 1 ELSE 0 END AS severity,
  CAST(regexp_matches(consequence, 'stop_gained|frameshift|splice_(donor|acceptor)') AS INT) AS is_lof, CAST(contains(consequence, 'missense') AS INT) AS is_missense,
  CAST(contains(consequence, 'synonymous') AS INT) AS is_synonymous, CAST(contains(consequence, 'splice') AS INT) AS is_splice, CAST(consequence <> 'intron_variant' AS INT) AS in_coding, CAST(regexp_extract(protein_change, '(\\d+)', 1) AS INT) AS codon_number,
  CAST((CAST(regexp_extract(protein_change, '(\\d+)', 1) AS INT) - 1) % 3 + 1 AS INT) AS codon_phase FROM n""",
    "gene_left_join": f"""WITH {NORM}, g AS ({S.plain(S.GENES)}) SELECT n.gene_symbol, count(*) AS n, round(avg(coalesce(pli_score, 0.0)), 6) AS pli_score, round(avg(coalesce(loeuf, 1.0)), 6) AS loeuf
FROM n LEFT JOIN g ON g.gene_symbol = n.gene_symbol GROUP BY n.gene_symbol""",
    "source_report": f"WITH {NORM} SELECT source_db, clinical_sig, count(*) AS n, count(DISTINCT locus) AS n_loci FROM n GROUP BY 1, 2",
    "gene_pathogenic_counts": f"WITH {NORM} SELECT gene_symbol, CAST(sum(label) AS BIGINT) AS n_pathogenic, count(*) AS n_labelled FROM l WHERE label IS NOT NULL GROUP BY 1",
    "interval_overlap": f"""WITH {NORM}, i AS (SELECT chrom, pos - 200 AS lo, pos + 300 AS hi, gene_symbol AS cre_id FROM n WHERE consequence = 'stop_gained' AND clinical_sig = 'Pathogenic' AND review_status LIKE '%expert panel%')
SELECT locus, count(*) AS n_hits, count(DISTINCT cre_id) AS n_elements FROM n JOIN i ON n.chrom = i.chrom AND n.pos BETWEEN lo AND hi GROUP BY locus""",
    "score_metrics": metrics_sql(""),
    "gene_score_metrics": metrics_sql("gene_symbol"),
    "calibration_table": f"""WITH {SCORED_CTE} SELECT CAST(least(floor(score * 10), 9) AS INT) AS bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(label), 6) AS positive_rate FROM s GROUP BY 1""",
    "release_directions": f"""WITH o AS ({S.plain(S.RELEASE_OLD)}), w AS ({S.plain(S.RELEASE_NEW)})
SELECT o.clinical_sig AS old_sig, w.clinical_sig AS new_sig, count(*) AS n FROM o FULL JOIN w ON o.variant_id = w.variant_id
WHERE o.clinical_sig IS DISTINCT FROM w.clinical_sig GROUP BY 1, 2""",
    "quantity_drift": """WITH c AS (SELECT CAST(l_extendedprice AS DOUBLE) AS x, sum(1 - l_linenumber % 2) AS a, sum(l_linenumber % 2) AS b FROM lineitem GROUP BY 1),
d AS (SELECT x, lead(x) OVER (ORDER BY x) AS nx, abs(CAST(sum(a) OVER (ORDER BY x) AS DOUBLE) / sum(a) OVER () - CAST(sum(b) OVER (ORDER BY x) AS DOUBLE) / sum(b) OVER ()) AS gap FROM c)
SELECT round(max(gap), 6) AS ks, round(sum(gap * (coalesce(nx, x) - x)), 6) AS wasserstein FROM d""",
}


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict:
    return dict(_ORACLES)
