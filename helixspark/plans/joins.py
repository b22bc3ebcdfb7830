"""Registered annotation joins, summaries and whole jobs, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixspark.functions import expressions as X
from helixspark.operators import annotate as N
from helixspark.operators import annotation as A
from helixspark.operators import evaluation as E
from helixspark.operators import summaries as U
from helixspark.operators import variants as V
from helixspark.operators.intervals import regulatory_overlap
from helixspark.plans.catalog import NORM, SCORED_CTE
from helixspark.sources import fixtures as S
from helixspark.sources import tables as T

#: Residues in natural order, for derived protein changes.
_CODES = list(A.AMINO_ACIDS)[:20]
_CODE_LIST = ", ".join(f"'{c}'" for c in _CODES)
#: Variants' protein changes over all residues; the same text in both engines.
CHANGES = """SELECT concat('GENE', CAST(l_suppkey AS VARCHAR(10))) AS gene_symbol, l_orderkey, l_linenumber,
  concat('p.', trim(substring('{codes}', CAST(1 + 4 * (l_partkey % 20) AS INT), 4)), CAST(1 + l_partkey % 60 AS VARCHAR(10)), trim(substring('{codes}', CAST(1 + 4 * ((l_partkey + l_linenumber) % 20) AS INT), 4))) AS protein_change,
  CASE WHEN l_tax > 0.02 THEN l_discount * 10 END AS eve_score FROM {lineitem}""".replace("{codes}", "".join(f"{c:4}" for c in _CODES))
ELEMENTS = """SELECT CASE WHEN l_partkey % 25 < 22 THEN CAST(1 + l_partkey % 25 AS VARCHAR(10)) WHEN l_partkey % 25 = 22 THEN 'X' WHEN l_partkey % 25 = 23 THEN 'Y' ELSE 'MT' END AS chrom,
  CAST(100000 + (l_orderkey * 37 + l_partkey) % 250000 AS INT) AS lo, CAST(100150 + (l_orderkey * 37 + l_partkey) % 250000 AS INT) AS hi,
  CASE l_linenumber % 3 WHEN 0 THEN 'PLS' WHEN 1 THEN 'pELS' ELSE 'dELS' END AS kind, l_discount * 30 AS z FROM {lineitem} WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity > 30"""
HITS = """SELECT l_partkey AS variant_id, concat('ST', CAST(l_suppkey % 40 AS VARCHAR(10))) AS study, concat('trait ', CAST(l_orderkey % 9 AS VARCHAR(10))) AS trait,
  pow(10.0, -CAST(1 + l_orderkey % 15 AS DOUBLE)) AS p_value, l_discount AS score, concat('GENE', CAST(l_suppkey AS VARCHAR(10))) AS gene FROM {lineitem}"""


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.normalize(S.variants(spark, sf_dir))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores_of(_clean(spark, sf_dir))


def _scores_of(clean: DataFrame) -> DataFrame:
    """A score a locus, of the loci that expert panels reviewed."""
    rows = clean.where("review_status LIKE '%expert panel%'").withColumn("score", (F.col("pos") % 1000) / 1000.0 + F.length("alt") / 10.0)
    return N.one_row(rows, N.LOCUS, {"score": "max"})


def locus_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = N.annotated(_clean(spark, sf_dir), _scores(spark, sf_dir), N.LOCUS, ["score"])
    return rows.groupBy("chrom").agg(F.count("*").alias("n"), F.count("score").alias("n_matched"), F.round(F.avg(F.coalesce("score", F.lit(0.5))), 6).alias("mean_score"), F.count_if(F.coalesce("score", F.lit(0.5)) >= 0.7).alias("n_high"))


def position_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = N.annotated(_clean(spark, sf_dir), N.one_row(_scores(spark, sf_dir), ["chrom", "pos"], {"score": "max"}), ["chrom", "pos"], ["score"])
    return rows.groupBy("gene_symbol").agg(F.count("*").alias("n"), F.count("score").alias("n_matched"), F.round(F.sum(F.coalesce("score", F.lit(0.0))), 4).alias("total_score"))


def protein_change_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.view(spark, sf_dir, CHANGES, "lineitem").withColumn("aa_change", A.protein_key(F.col("protein_change")))
    table = N.one_row(rows.where("eve_score IS NOT NULL"), ["gene_symbol", "aa_change"], {"eve_score": "max"})
    out = N.annotated(rows.drop("eve_score"), table, ["gene_symbol", "aa_change"], ["eve_score"])
    return out.groupBy("aa_change").agg(F.count("*").alias("n"), F.count("eve_score").alias("n_scored"), F.round(F.sum(F.coalesce("eve_score", F.lit(0.5))), 4).alias("total_score"))


def frequency_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _clean(spark, sf_dir)
    table = rows.where("source_db = 'gnomad' AND allele_freq IS NOT NULL").select(F.concat(F.lit("gnomad:"), "locus").alias("variant_id"), "allele_freq")
    return N.filled_frequency(rows, table).groupBy("chrom").agg(F.count("*").alias("n"), F.count("allele_freq").alias("n_known"), F.round(F.sum("allele_freq"), 6).alias("total_af"))


def locus_allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _clean(spark, sf_dir)
    return N.allowed(rows, rows.where("consequence = 'stop_gained' AND clinical_sig = 'Pathogenic'")).groupBy("source_db", "consequence").agg(F.count("*").alias("n"))


def residue_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.view(spark, sf_dir, CHANGES, "lineitem")
    table = rows.select("gene_symbol", X.codon_number(F.col("protein_change")).alias("residue"), (F.col("eve_score") * 100).alias("plddt"))
    out = N.residues(rows, N.one_row(table.where("plddt IS NOT NULL"), ["gene_symbol", "residue"], {"plddt": "max"}), ["plddt"])
    return out.groupBy("residue").agg(F.count("*").alias("n"), F.count("plddt").alias("n_matched"), F.round(F.sum("plddt"), 4).alias("total_plddt"))


def rs_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = spark.read.parquet(f"{sf_dir}/lineitem.parquet"), spark.read.parquet(f"{sf_dir}/orders.parquet")
    index = orders.where("o_orderstatus = 'F'").select(F.concat(F.lit("rs"), F.col("o_orderkey").cast("string")).alias("rs_id"), (1 + F.col("o_custkey") % 22).cast("string").alias("chrom"), F.col("o_orderkey").cast("int").alias("pos"), F.lit("A").alias("ref"), F.lit("G").alias("alt"))
    key = F.col("l_orderkey").cast("string")
    asked = lines.select(F.when(F.col("l_linenumber") == 1, key).when(F.col("l_linenumber") == 2, F.concat(F.lit("RS"), key)).when(F.col("l_linenumber") == 3, F.concat(F.lit(" rs"), key)).otherwise(F.concat(F.lit("x"), key)).alias("rs_id"), "l_linenumber")
    features = index.select("chrom", "pos", "ref", "alt", (F.col("pos") % 7).alias("feature"))
    return N.resolved(asked, index, features).groupBy("l_linenumber", "known").agg(F.count("*").alias("n"), F.sum("feature").alias("total_feature"))


def gene_score_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.scored(spark, sf_dir)
    known = rows.where("label = 1").select("variant_id", "score")
    return U.with_gene_scores(rows.select("variant_id", "gene_symbol"), known, rows.select("variant_id", "gene_symbol")).groupBy("gene_symbol").agg(F.count("*").alias("n"), F.round(F.max("gnn_score"), 6).alias("gnn_score"))


def etl_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ETL job but for its write."""
    return N.etl(S.variants(spark, sf_dir)).select("locus", "source_db", "gene_symbol", "pathogenicity", "variant_type", "af_bin", "allele_freq")


def prepared_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data preparation from labels to the split feature table. The normalised variants, which the rows and all lookups come from, are made once."""
    clean = T.staged(_clean(spark, sf_dir).drop("locus"), "clean").withColumn("locus", X.locus(F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alt")))
    frequencies = clean.where("source_db = 'gnomad' AND allele_freq IS NOT NULL").select(F.concat(F.lit("gnomad:"), "locus").alias("variant_id"), "allele_freq")
    lookups = [
        (_scores_of(clean).withColumnRenamed("score", "revel_score"), N.LOCUS, ["revel_score"]),
        (N.one_row(_scores_of(clean).withColumnRenamed("score", "phylop_score"), ["chrom", "pos"], {"phylop_score": "max"}), ["chrom", "pos"], ["phylop_score"]),
        (S.genes(spark, sf_dir), ["gene_symbol"], ["pli_score", "loeuf"]),
    ]
    rows = N.prepared_clean(clean, lookups, frequencies)
    return rows.select("locus", "gene_symbol", "label", "tier", "split", "n_pathogenic_in_gene", "gene_has_known_disease", F.round("af", 9).alias("af"), "severity", "is_lof", "is_autosome", "is_mitochondrial", F.round("revel_score", 6).alias("revel_score"), "revel_pathogenic",
                       F.round("phylop_score", 6).alias("phylop_score"), "pli_score", "loeuf", "cadd_high", "n_tools_pathogenic", "dist_to_splice_site", "finngen_enrichment", "lovd_variant_class")


def annotation_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = N.annotated(_clean(spark, sf_dir), _scores(spark, sf_dir), N.LOCUS, ["score"])
    return N.coverage(rows, {"scores": F.col("score").isNotNull(), "frequency": F.col("allele_freq").isNotNull(), "protein": F.col("protein_change").isNotNull()})


def regulatory_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), (1 + F.col("o_custkey") % 22).cast("string").alias("chrom"), (100000 + F.col("o_orderkey") * 61 % 250000).cast("int").alias("pos"))
    return regulatory_overlap(points, S.view(spark, sf_dir, ELEMENTS, "lineitem"), 50).select("id", "in_cre", "types", "n_elements", F.round("max_z", 6).alias("max_z"))


def eqtl_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_partkey").alias("locus"), F.when(F.col("l_tax") > 0, F.pow(F.lit(10.0), -F.col("l_quantity") / 10)).alias("p_value"), (F.col("l_discount") - 0.05).alias("beta"))
    return U.eqtl_by_locus(rows, ["locus"]).select("locus", "gtex_is_eqtl", F.round("gtex_min_eqtl_pval", 6).alias("gtex_min_eqtl_pval"), F.round("gtex_max_abs_effect", 6).alias("gtex_max_abs_effect"))


def tissue_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.concat(F.lit("GENE"), F.col("l_suppkey").cast("string")).alias("gene_symbol"), F.concat(F.lit("tissue"), F.col("l_linenumber").cast("string")).alias("tissue"), (F.col("l_discount") * F.col("l_quantity")).alias("tpm"))
    text = F.array_join(F.transform(F.map_entries("tissues"), lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"], 2).cast("decimal(12,2)").cast("string"))), ",")
    return U.expression_by_gene(rows).select("gene_symbol", F.round("max_tpm", 6).alias("max_tpm"), F.round("mean_tpm", 6).alias("mean_tpm"), "n_expressed", F.round("specificity", 6).alias("specificity"), text.alias("tissues"))


def association_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.association_hits(S.view(spark, sf_dir, HITS, "lineitem")).withColumn("max_neg_log10_p", F.round("max_neg_log10_p", 4)).drop("min_p")


def modal_consequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.commonest(_clean(spark, sf_dir), "gene_symbol", "consequence")


def overall_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.overall(_clean(spark, sf_dir).withColumn("label", X.binary_label(F.col("clinical_sig"))), "label", "gene_symbol", "source_db")


def class_type_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _clean(spark, sf_dir).select("source_db", A.five_classes(F.col("clinical_sig")).alias("pathogenicity"), A.variant_type(F.col("ref"), F.col("alt")).alias("variant_type"))
    return rows.groupBy("source_db", "pathogenicity", "variant_type").agg(F.count("*").alias("n")).orderBy("source_db", "pathogenicity", "variant_type")


def gene_node_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = U.mean_by(V.with_features(_clean(spark, sf_dir)), "gene_symbol", ["severity", "is_lof", "is_missense", "len_diff"])
    return g.select("gene_symbol", *[F.round(c, 6).alias(c) for c in ("severity", "is_lof", "is_missense", "len_diff")])


def label_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _clean(spark, sf_dir).withColumn("label", X.binary_label(F.col("clinical_sig")))
    return U.value_counts(rows, ["label", "gene_symbol"], {"n_snv": (F.length("ref") == 1) & (F.length("alt") == 1), "n_frequency": F.col("allele_freq").isNotNull()})


def newest_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest record of each gene and consequence, ties by locus; and the best by one aggregate gives the same."""
    rows = _clean(spark, sf_dir).select("gene_symbol", "consequence", "last_evaluated", "locus")
    return U.first_by(rows, ["gene_symbol", "consequence"], [F.desc("last_evaluated"), F.desc("locus")])


def best_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.best_by(S.scored(spark, sf_dir), ["gene_symbol"], "score", ["variant_id", "label"])


def all_source_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _clean(spark, sf_dir).select(F.col("locus").alias("variant_id"), "source_db", "gene_symbol", "clinical_sig")
    parts = [rows.where(F.col("source_db") == s) for s in ("clinvar", "gnomad")] + [rows.where("source_db IN ('uniprot', 'lovd')").drop("clinical_sig")]
    return U.all_sources(parts).groupBy("source_db", "clinical_sig").agg(F.count("*").alias("n"))


def release_id_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.id_changes(*S.releases(spark, sf_dir), "variant_id")


def shared_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = S.edges(spark, sf_dir)
    return U.in_both(e.select(F.col("src").alias("gene")), e.where("combined_score >= 950").select(F.col("dst").alias("gene")), "gene")


def top_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.top(S.scored(spark, sf_dir), 20, [F.desc("score"), F.asc("variant_id")], ["variant_id", "gene_symbol", "score"])


def top_error_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.top(E.group_errors(S.scored(spark, sf_dir), "gene_symbol").withColumn("n_errors", F.col("n_fp") + F.col("n_fn")), 10, [F.desc("n_errors"), F.asc("gene_symbol")])


def strong_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.concat(F.lit("P"), F.col("l_suppkey").cast("string")).alias("protein1"), F.concat(F.lit("P"), (1 + F.col("l_partkey") % 100).cast("string")).alias("protein2"),
                                                                  (400 + F.col("l_partkey") % 600).alias("combined_score"), (F.col("l_orderkey") % 1000).alias("experimental"))
    names = spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_nationkey <> 3").select(F.concat(F.lit("P"), F.col("s_suppkey").cast("string")).alias("protein_id"), F.concat(F.lit("GENE"), F.col("s_suppkey").cast("string")).alias("preferred_name"))
    return U.gene_edges(links, names)


_QUERIES = (locus_left_join, position_left_join, protein_change_join, frequency_fill, locus_allow_list, residue_join, rs_resolution, gene_score_join, etl_variants, prepared_features, annotation_coverage, regulatory_summary, eqtl_summary, tissue_summary,
            association_summary, modal_consequences, overall_summary, class_type_report, gene_node_features, label_breakdown, newest_records, best_scores, all_source_union, release_id_changes, shared_genes, top_variants, top_error_genes, strong_edges)

_SCORES = "sc AS (SELECT chrom, pos, ref, alt, max((pos % 1000) / 1000.0::DOUBLE + length(alt) / 10.0::DOUBLE) AS score FROM n WHERE review_status LIKE '%expert panel%' GROUP BY ALL)"
_CHANGES = f"""c AS ({S.plain(CHANGES)}), codes AS (SELECT unnest([{_CODE_LIST}]) AS three, unnest(string_split('ARNDCQEGHILKMFPSTWYV', '')) AS one),
k AS (SELECT c.*, a.one || regexp_extract(protein_change, '([0-9]+)', 1) || b.one AS aa_change, regexp_extract(protein_change, '([0-9]+)', 1)::INT AS residue FROM c JOIN codes a ON a.three = substr(protein_change, 3, 3) JOIN codes b ON b.three = right(protein_change, 3))"""
_CLASS = """CASE WHEN lower(clinical_sig) LIKE 'pathogenic%' THEN 'pathogenic' WHEN lower(clinical_sig) LIKE 'benign%' THEN 'benign' WHEN contains(lower(clinical_sig), 'likely benign') THEN 'likely_benign'
  WHEN contains(lower(clinical_sig), 'pathogenic') THEN 'pathogenic' ELSE 'uncertain' END"""
_TYPE = "CASE WHEN length(ref) = 1 AND length(alt) = 1 THEN 'SNV' WHEN length(ref) < length(alt) THEN 'insertion' WHEN length(ref) > length(alt) THEN 'deletion' ELSE 'complex' END"
_BIN = """CASE WHEN allele_freq IS NULL THEN 'unknown' WHEN allele_freq < 0.0001 THEN 'ultra_rare' WHEN allele_freq < 0.001 THEN 'rare' WHEN allele_freq < 0.01 THEN 'low_freq' WHEN allele_freq < 0.05 THEN 'common' ELSE 'very_common' END"""

_ORACLES = {
    "locus_left_join": f"""WITH {NORM}, {_SCORES} SELECT n.chrom, count(*) AS n, count(score) AS n_matched, round(avg(coalesce(score, 0.5)), 6) AS mean_score, count_if(coalesce(score, 0.5) >= 0.7)::BIGINT AS n_high
FROM n LEFT JOIN sc ON sc.chrom = n.chrom AND sc.pos = n.pos AND sc.ref = n.ref AND sc.alt = n.alt GROUP BY 1""",
    "position_left_join": f"""WITH {NORM}, {_SCORES}, p AS (SELECT chrom, pos, max(score) AS score FROM sc GROUP BY 1, 2)
SELECT gene_symbol, count(*) AS n, count(score) AS n_matched, round(sum(coalesce(score, 0)), 4) AS total_score FROM n LEFT JOIN p ON p.chrom = n.chrom AND p.pos = n.pos GROUP BY 1""",
    "protein_change_join": f"""WITH {_CHANGES}, t AS (SELECT gene_symbol, aa_change, max(eve_score) AS e FROM k WHERE eve_score IS NOT NULL GROUP BY 1, 2)
SELECT k.aa_change, count(*) AS n, count(e) AS n_scored, round(sum(coalesce(e, 0.5)), 4) AS total_score FROM k LEFT JOIN t ON t.gene_symbol = k.gene_symbol AND t.aa_change = k.aa_change GROUP BY 1""",
    "frequency_fill": f"""WITH {NORM}, t AS (SELECT locus, max(allele_freq) AS f FROM n WHERE source_db = 'gnomad' GROUP BY 1)
SELECT chrom, count(*) AS n, count(coalesce(allele_freq, f)) AS n_known, round(sum(coalesce(allele_freq, f)), 6) AS total_af FROM n LEFT JOIN t ON t.locus = n.locus GROUP BY 1""",
    "locus_allow_list": f"""WITH {NORM} SELECT source_db, consequence, count(*) AS n FROM n WHERE locus IN (SELECT locus FROM n WHERE consequence = 'stop_gained' AND clinical_sig = 'Pathogenic') GROUP BY 1, 2""",
    "residue_join": f"""WITH {_CHANGES}, t AS (SELECT gene_symbol, residue, max(eve_score * 100) AS p FROM k GROUP BY 1, 2)
SELECT k.residue, count(*) AS n, count(p) AS n_matched, round(sum(p), 4) AS total_plddt FROM k LEFT JOIN t ON t.gene_symbol = k.gene_symbol AND t.residue = k.residue GROUP BY 1""",
    "rs_resolution": """SELECT l_linenumber, l_linenumber <= 3 AND o_orderkey IS NOT NULL AS known, count(*) AS n, sum(CASE WHEN l_linenumber <= 3 THEN o_orderkey % 7 END)::BIGINT AS total_feature
FROM lineitem LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') ON o_orderkey = l_orderkey GROUP BY 1, 2""",
    "gene_score_join": f"""WITH {SCORED_CTE}, p AS (SELECT variant_id AS id, score AS x FROM s WHERE label = 1), g AS (SELECT gene_symbol, avg(x) AS m FROM s JOIN p ON id = variant_id GROUP BY 1)
SELECT s.gene_symbol, count(*) AS n, round(max(coalesce(m, 0.5)), 6) AS gnn_score FROM s LEFT JOIN g ON g.gene_symbol = s.gene_symbol GROUP BY 1""",
    "etl_variants": f"""WITH {NORM} SELECT locus, source_db, gene_symbol, {_CLASS} AS pathogenicity, {_TYPE} AS variant_type, {_BIN} AS af_bin, allele_freq FROM n
QUALIFY row_number() OVER (PARTITION BY locus ORDER BY CASE source_db WHEN 'clinvar' THEN 1 WHEN 'gnomad' THEN 2 WHEN 'uniprot' THEN 3 ELSE 4 END, last_evaluated DESC NULLS LAST,
  chrom, pos, ref, alt, gene_symbol, consequence, clinical_sig, review_status, allele_freq NULLS FIRST, protein_change, source_db) = 1""",
    "prepared_features": f"""WITH {NORM}, {_SCORES}, q AS (SELECT chrom, pos, max(score) AS p FROM sc GROUP BY 1, 2), g AS ({S.plain(S.GENES)}), t AS (SELECT locus, max(allele_freq) AS f FROM n WHERE source_db = 'gnomad' GROUP BY 1),
b AS (SELECT *, sum(label) OVER (PARTITION BY gene_symbol) AS k FROM l WHERE label IS NOT NULL AND tier <= 3 AND NOT contains(clinical_sig, 'onflict')),
j AS (SELECT b.*, greatest(0, coalesce(allele_freq, f, 0)) AS a, coalesce(score, 0.5) AS r, coalesce(p, 0) AS ph, least(1, greatest(0, coalesce(pli_score, 0))) AS pli, least(5, greatest(0, coalesce(g.loeuf, 1))) AS lo,
  ('0x' || substr(md5('42:' || b.gene_symbol), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM b LEFT JOIN t ON t.locus = b.locus LEFT JOIN sc ON sc.chrom = b.chrom AND sc.pos = b.pos AND sc.ref = b.ref AND sc.alt = b.alt
  LEFT JOIN q ON q.chrom = b.chrom AND q.pos = b.pos LEFT JOIN g ON g.gene_symbol = b.gene_symbol)
SELECT locus, gene_symbol, label, tier, CASE WHEN u < 0.2 THEN 'test' WHEN u < 0.2::DOUBLE + 0.1::DOUBLE THEN 'val' ELSE 'train' END AS split, k::INT AS n_pathogenic_in_gene, (k > 0)::INT AS gene_has_known_disease, round(a, 9) AS af,
  CASE consequence WHEN 'splice_donor_variant' THEN 9 WHEN 'stop_gained' THEN 9 WHEN 'frameshift_variant' THEN 8 WHEN 'missense_variant' THEN 5 WHEN 'missense_variant&splice_region_variant' THEN 5 WHEN 'synonymous_variant' THEN 2 ELSE 1 END AS severity,
  regexp_matches(consequence, 'stop_gained|frameshift|splice_donor')::INT AS is_lof, (chrom NOT IN ('X', 'Y', 'MT'))::INT AS is_autosome, (chrom = 'MT')::INT AS is_mitochondrial, round(r, 6) AS revel_score, (r >= 0.5)::INT AS revel_pathogenic,
  round(ph, 6) AS phylop_score, pli AS pli_score, lo AS loeuf, 0 AS cadd_high, (r >= 0.5)::INT AS n_tools_pathogenic, 50 AS dist_to_splice_site, 1.0::DOUBLE AS finngen_enrichment, 0 AS lovd_variant_class FROM j""",
    "annotation_coverage": f"""WITH {NORM}, {_SCORES}, j AS (SELECT n.*, score FROM n LEFT JOIN sc ON sc.chrom = n.chrom AND sc.pos = n.pos AND sc.ref = n.ref AND sc.alt = n.alt),
c AS (SELECT 'scores' AS source, count(score) AS n_matched, count(*) AS n_total FROM j UNION ALL SELECT 'frequency', count(allele_freq), count(*) FROM j UNION ALL SELECT 'protein', count(protein_change), count(*) FROM j)
SELECT *, round(n_matched / n_total::DOUBLE, 6) AS share FROM c""",
    "regulatory_summary": f"""WITH e AS ({S.plain(ELEMENTS)}), p AS (SELECT o_orderkey AS id, (1 + o_custkey % 22)::VARCHAR AS chrom, (100000 + o_orderkey * 61 % 250000)::INT AS pos FROM orders)
SELECT id, count(lo) > 0 AS in_cre, coalesce(array_to_string(list_sort(list(DISTINCT kind) FILTER (kind IS NOT NULL)), ','), '') AS types, count(lo) AS n_elements, round(coalesce(max(z), 0), 6) AS max_z
FROM p LEFT JOIN e ON e.chrom = p.chrom AND pos BETWEEN lo - 50 AND hi + 50 GROUP BY 1""",
    "eqtl_summary": """WITH r AS (SELECT l_partkey AS locus, coalesce(CASE WHEN l_tax > 0 THEN -log10(pow(10.0::DOUBLE, -l_quantity / 10) + 1e-300) END, 0) AS s, abs(l_discount - 0.05) AS b FROM lineitem)
SELECT locus, max((s > 0)::INT) AS gtex_is_eqtl, round(max(s), 6) AS gtex_min_eqtl_pval, round(max(b), 6) AS gtex_max_abs_effect FROM r GROUP BY 1""",
    "tissue_summary": """WITH r AS (SELECT concat('GENE', l_suppkey) AS gene_symbol, concat('tissue', l_linenumber) AS tissue, l_discount * l_quantity AS tpm FROM lineitem),
t AS (SELECT gene_symbol, string_agg(tissue || '=' || round(m, 2)::DECIMAL(12,2)::VARCHAR, ',' ORDER BY tissue) AS tissues FROM (SELECT gene_symbol, tissue, max(tpm) AS m FROM r GROUP BY 1, 2) GROUP BY 1),
g AS (SELECT gene_symbol, max(tpm) AS m, avg(tpm) AS a, count_if(tpm >= 1)::BIGINT AS n_expressed FROM r GROUP BY 1)
SELECT g.gene_symbol, round(m, 6) AS max_tpm, round(a, 6) AS mean_tpm, n_expressed, round(CASE WHEN m > 0 THEN 1 - a / m ELSE 0 END, 6) AS specificity, tissues FROM g JOIN t ON t.gene_symbol = g.gene_symbol""",
    "association_summary": f"""WITH h AS ({S.plain(HITS)}) SELECT variant_id, count(*) AS n_hits, count(DISTINCT study) AS n_studies, count(DISTINCT trait) AS n_traits, round(max(-log10(p_value + 1e-300)), 4) AS max_neg_log10_p, max(score) AS max_score,
  arg_max(gene, (score, gene)) AS top_gene, array_to_string(list_sort(list(DISTINCT trait))[1:5], ', ') AS traits FROM h WHERE p_value <= 5e-8 GROUP BY 1""",
    "modal_consequences": f"""WITH {NORM}, c AS (SELECT gene_symbol, consequence, count(*) AS k FROM n GROUP BY 1, 2) SELECT gene_symbol, sum(k)::BIGINT AS n, arg_min(consequence, (-k, consequence)) AS modal_consequence FROM c GROUP BY 1""",
    "overall_summary": f"""WITH {NORM} SELECT count(*) AS n_variants, count_if(label = 1)::BIGINT AS n_pathogenic, count_if(label = 0)::BIGINT AS n_benign, count_if(label IS NULL)::BIGINT AS n_unlabelled, count(DISTINCT gene_symbol) AS n_genes, count(DISTINCT source_db) AS n_sources FROM l""",
    "class_type_report": f"""WITH {NORM} SELECT source_db, {_CLASS} AS pathogenicity, {_TYPE} AS variant_type, count(*) AS n FROM n GROUP BY 1, 2, 3""",
    "gene_node_features": f"""WITH {NORM}, f AS (SELECT gene_symbol, CASE consequence WHEN 'splice_donor_variant' THEN 9 WHEN 'stop_gained' THEN 9 WHEN 'frameshift_variant' THEN 8 WHEN 'missense_variant' THEN 5 WHEN 'missense_variant&splice_region_variant' THEN 5
  WHEN 'synonymous_variant' THEN 2 ELSE 1 END AS s, regexp_matches(consequence, 'stop_gained|frameshift|splice_donor')::INT AS lof, contains(consequence, 'missense')::INT AS mis, abs(length(ref) - length(alt)) AS d FROM n)
SELECT gene_symbol, round(avg(s), 6) AS severity, round(avg(lof), 6) AS is_lof, round(avg(mis), 6) AS is_missense, round(avg(d), 6) AS len_diff FROM f GROUP BY 1""",
    "label_breakdown": f"""WITH {NORM} SELECT label, gene_symbol, count(*) AS n, count_if(length(ref) = 1 AND length(alt) = 1)::BIGINT AS n_snv, count(allele_freq) AS n_frequency FROM l GROUP BY 1, 2""",
    "newest_records": f"""WITH {NORM} SELECT gene_symbol, consequence, max(last_evaluated) AS last_evaluated, arg_max(locus, (last_evaluated, locus)) AS locus FROM n GROUP BY 1, 2""",
    "best_scores": f"""WITH {SCORED_CTE} SELECT gene_symbol, score, variant_id, label FROM s QUALIFY row_number() OVER (PARTITION BY gene_symbol ORDER BY score DESC, variant_id DESC, label DESC) = 1""",
    "all_source_union": f"""WITH {NORM}, o AS (SELECT locus, CASE source_db WHEN 'clinvar' THEN 0 WHEN 'gnomad' THEN 1 ELSE 2 END AS k, source_db, gene_symbol, CASE WHEN source_db IN ('clinvar', 'gnomad') THEN clinical_sig END AS clinical_sig FROM n),
f AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY locus ORDER BY k, source_db, gene_symbol, clinical_sig NULLS LAST) = 1) SELECT source_db, clinical_sig, count(*) AS n FROM f GROUP BY 1, 2""",
    "release_id_changes": f"""WITH o AS ({S.plain(S.RELEASE_OLD)}), w AS ({S.plain(S.RELEASE_NEW)}) SELECT variant_id, 'new' AS change FROM w WHERE variant_id NOT IN (SELECT variant_id FROM o) UNION ALL SELECT variant_id, 'removed' FROM o WHERE variant_id NOT IN (SELECT variant_id FROM w)""",
    "shared_genes": f"""WITH e AS ({S.plain(S.EDGES)}) SELECT src AS gene FROM e INTERSECT SELECT dst FROM e WHERE combined_score >= 950""",
    "top_variants": f"WITH {SCORED_CTE} SELECT variant_id, gene_symbol, score FROM s ORDER BY score DESC, variant_id LIMIT 20",
    "top_error_genes": f"""WITH {SCORED_CTE}, g AS (SELECT gene_symbol, count(*) AS n, count_if(score >= 0.5 AND label = 0)::BIGINT AS n_fp, count_if(score < 0.5 AND label = 1)::BIGINT AS n_fn, round(count_if((score >= 0.5) <> (label = 1)) / count(*)::DOUBLE, 6) AS error_rate FROM s GROUP BY 1)
SELECT *, n_fp + n_fn AS n_errors FROM g ORDER BY n_errors DESC, gene_symbol LIMIT 10""",
    "strong_edges": """WITH k AS (SELECT concat('P', l_suppkey) AS a, concat('P', 1 + l_partkey % 100) AS b, 400 + l_partkey % 600 AS c, l_orderkey % 1000 AS x FROM lineitem), m AS (SELECT concat('P', s_suppkey) AS id, concat('GENE', s_suppkey) AS g FROM supplier WHERE s_nationkey <> 3),
r AS (SELECT coalesce(u.g, a) AS a, coalesce(v.g, b) AS b, c, x FROM k LEFT JOIN m u ON u.id = a LEFT JOIN m v ON v.id = b WHERE c >= 700)
SELECT least(a, b) AS src, greatest(a, b) AS dst, max(c) / 1000.0::DOUBLE AS combined_score, max(x) / 1000.0::DOUBLE AS experimental FROM r WHERE a <> b GROUP BY 1, 2""",
}


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict:
    return dict(_ORACLES)
