"""Registered queries of the source parsers, sequence scores, filters and labels, on raw rows that Spark derives from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixspark.functions import identifiers as I
from helixspark.functions import sequences as Q
from helixspark.operators import filters as P
from helixspark.sources import clinical as C
from helixspark.sources import fixtures as S

#: Raw rows as texts, the same SQL in both engines.
SUMMARY = """SELECT CASE WHEN l_linenumber = 7 THEN 'GRCh37' ELSE 'GRCh38' END AS Assembly, concat('GENE', CAST(l_suppkey AS VARCHAR(10))) AS GeneSymbol,
  CASE WHEN l_returnflag = 'R' THEN 'Pathogenic' WHEN l_returnflag = 'A' THEN 'Likely benign' ELSE 'Uncertain significance' END AS ClinicalSignificance,
  CASE WHEN l_returnflag = 'R' THEN '1' WHEN l_returnflag = 'A' THEN '0' ELSE '-1' END AS ClinSigSimple, 'criteria provided, single submitter' AS ReviewStatus,
  CASE WHEN l_partkey % 23 = 0 THEN 'chrM' ELSE CAST(1 + l_partkey % 23 AS VARCHAR(10)) END AS Chromosome, CASE WHEN l_linenumber = 6 THEN 'unknown' ELSE CAST(l_orderkey % 5000 AS VARCHAR(12)) END AS Start,
  CASE WHEN l_linenumber = 5 THEN 'na' WHEN l_linenumber = 4 THEN 'AC' ELSE 'a' END AS ReferenceAllele, substring('GTCA', CAST(1 + l_suppkey % 3 AS INT), 1) AS AlternateAllele,
  CAST(l_orderkey AS VARCHAR(12)) AS VariationID, CAST(l_partkey AS VARCHAR(12)) AS RS, CASE WHEN l_linenumber = 3 AND l_suppkey % 5 = 0 THEN 'unknown' ELSE CAST(CAST(l_shipdate AS DATE) AS VARCHAR(10)) END AS LastEvaluated FROM {lineitem}"""
POSITIONS = """SELECT CASE WHEN l_linenumber = 1 AND l_suppkey = 1 THEN 'chrom' ELSE concat('chr', CAST(1 + l_partkey % 5 AS VARCHAR(10))) END AS a, CASE WHEN l_linenumber = 1 AND l_suppkey = 1 THEN 'pos' ELSE CAST(l_orderkey % 900 AS VARCHAR(10)) END AS b,
  CAST(CAST(l_quantity AS INT) AS VARCHAR(10)) AS c FROM {lineitem}"""
VARIANT_JSON = """SELECT concat('{"gene":"GENE', CAST(o_custkey % 50 AS VARCHAR(10)), '","variants":[{"variant_id":"1-', CAST(o_orderkey AS VARCHAR(12)), '-a-T","consequence":"missense_variant","exome":',
  CASE WHEN o_orderstatus = 'F' THEN '{"af":0.25}' ELSE 'null' END, ',"genome":{"af":0.5}},{"variant_id":"bad","consequence":"x"}]}') AS json FROM {orders}"""
PROTEIN_JSON = """SELECT concat('{"accession":"P', CAST(s_suppkey AS VARCHAR(10)), '","gene":"GENE', CAST(s_suppkey AS VARCHAR(10)), '","features":[{"type":"Natural variant","begin":', CAST(1 + s_suppkey % 90 AS VARCHAR(10)),
  ',"original":"R","variation":"H","description":"d"},{"type":"Active site","begin":30},{"type":"Binding site","begin":12},{"type":"Domain","begin":5}]}') AS json FROM {supplier}"""
EXPRESSION_JSON = """SELECT concat('{"data":[{"geneSymbol":"GENE', CAST(s_suppkey AS VARCHAR(10)), '","tissueSiteDetailId":"Liver","median":', CAST(s_suppkey AS VARCHAR(10)), '.5},{"geneSymbol":"GENE', CAST(s_suppkey AS VARCHAR(10)), '","tissueSiteDetailId":"Lung","median":null}]}') AS json FROM {supplier}"""
STUDY_JSON = """SELECT concat('{"associations":[{"rsId":"rs', CAST(o_orderkey AS VARCHAR(12)), '","pvalueMantissa":', CAST(1 + o_custkey % 9 AS VARCHAR(2)), ',"pvalueExponent":-', CAST(1 + o_orderkey % 20 AS VARCHAR(3)),
  ',"study":"S', CAST(o_custkey % 7 AS VARCHAR(3)), '","traits":["a","b"]}]}') AS json FROM {orders}"""
SEQUENCES = """SELECT l_orderkey, l_linenumber, concat(repeat(substring('ACGT', CAST(1 + l_partkey % 4 AS INT), 1), CAST(l_linenumber + 1 AS INT)), 'CAGGTAAGT', repeat(substring('TCAG', CAST(1 + l_suppkey % 4 AS INT), 1), CAST(l_linenumber AS INT))) AS seq,
  CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE CAST(l_partkey % 9 - 4 AS INT) END AS donor, CASE WHEN l_suppkey % 2 = 0 THEN NULL ELSE CAST(l_orderkey % 11 - 5 AS INT) END AS acceptor, concat(CAST(l_linenumber AS VARCHAR(4)), CASE WHEN l_suppkey % 2 = 0 THEN '/12' ELSE ' of 12' END) AS exon FROM {lineitem}"""


def _raw(spark: SparkSession, sf_dir: str, sql: str, table: str = "lineitem") -> DataFrame:
    """The derived rows; braces of JSON texts are kept from spark.sql's own."""
    spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(f"_raw_{table}")
    return spark.sql(sql.replace("{" + table + "}", f"_raw_{table}"))


def summary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.summary(_raw(spark, sf_dir, SUMMARY), classes=("pathogenic", "likely_benign"))
    return rows.groupBy("pathogenicity", "gene_symbol").agg(F.count("*").alias("n"), F.count("pos").alias("n_placed"), F.count_distinct("variant_id").alias("n_ids"))


def recent_label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.recent_labels(_raw(spark, sf_dir, SUMMARY), "1995-01-01").select("variant_id", "label", "gene_symbol", "last_evaluated")


def position_score_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.position_scores(_raw(spark, sf_dir, POSITIONS))


def population_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequencies on the chromosomes and positions of one gene's variants."""
    v = S.variants(spark, sf_dir)
    raw = v.select(F.col("chrom").alias("chr"), F.col("pos").cast("string").alias("pos"), "ref", "alt", F.col("allele_freq").cast("string").alias("GENOME_AF_fin"), F.when(F.col("pos") % 2 == 0, F.col("allele_freq") / 4).cast("string").alias("GENOME_AF_nfe"))
    query = v.where("gene_symbol = 'GENE7'").select(F.regexp_replace("chrom", "^chr", "").alias("chrom"), "pos").where("chrom <> 'M'")
    return C.population_frequencies(raw, query).groupBy("chrom").agg(F.count("*").alias("n"), F.round(F.sum("enrichment"), 4).alias("total_enrichment"))


def disease_mutation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = S.variants(spark, sf_dir).select("chrom", F.col("pos").cast("string").alias("pos"), "ref", "alt", F.when(F.col("clinical_sig") == "Pathogenic", "DM").when(F.col("clinical_sig").contains("onflict"), "dm?").otherwise("FP").alias("class"))
    return C.disease_mutations(raw).groupBy("chrom", "hgmd_is_disease_mutation", "hgmd_n_reports").agg(F.count("*").alias("n"))


def gene_source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disease counts and the best validity class of each gene."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    gene = F.concat(F.lit("gene"), F.col("l_suppkey").cast("string"))
    diseases = C.gene_diseases(lines.select(gene.alias("symbol"), F.when(F.col("l_tax") > 0.04, "phenotype").otherwise("gene").alias("type")))
    validity = C.gene_validity(lines.where("l_discount < 0.01").select(gene.alias("symbol"), F.when(F.col("l_quantity") > 45, "Definitive").when(F.col("l_quantity") > 30, " Strong").when(F.col("l_quantity") > 10, "LIMITED").otherwise("disputed").alias("classification")))
    return diseases.join(validity, "gene_symbol", "full")


def locus_class_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = S.variants(spark, sf_dir)
    raw = v.select(F.concat_ws(":", "chrom", F.col("pos").cast("string"), "ref", "alt").alias("variant_id"), F.lower("clinical_sig").alias("classification"))
    return C.locus_classes(raw).groupBy("chrom", "lovd_variant_class").agg(F.count("*").alias("n"))


def variant_json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.gnomad_variants(_raw(spark, sf_dir, VARIANT_JSON, "orders")).select("chrom", "pos", "ref", "alt", "gene_symbol", "allele_freq", "af_of")


def protein_json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir, PROTEIN_JSON, "supplier")
    return C.protein_entries(raw).select("gene_symbol", "residue", "aa_change").join(C.protein_summary(raw).drop("accession"), "gene_symbol")


def tissue_json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.tissue_expression(_raw(spark, sf_dir, EXPRESSION_JSON, "supplier"))


def study_json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.study_hits(_raw(spark, sf_dir, STUDY_JSON, "orders")).select("rs_id", "study", "trait", (-F.round(F.log10("p_value"), 4)).alias("neg_log10_p"))


def study_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.concat(F.lit("rs"), F.col("l_partkey").cast("string")).alias("rs_id"), F.col("l_suppkey").alias("study"), F.pow(F.lit(10.0), -F.col("l_quantity") / 4).alias("p"), (F.col("l_discount") - 0.05).alias("beta"), (F.col("l_linestatus") == "F").alias("replicated"))
    return C.rs_statistics(rows).select("rs_id", F.round(F.log10("min_p"), 4).alias("log10_p"), "n_studies", F.round("max_abs_beta", 6).alias("max_abs_beta"), "replicated")


def identifier_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers written and read again, and genomic changes."""
    key = F.col("o_orderkey").cast("int")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(key.alias("k"), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("clinvar:7:"), key.cast("string"), F.lit(":A:T"))).when(F.col("o_orderstatus") == "P", F.concat(F.lit("7:"), key.cast("string"), F.lit(":A:T"))).otherwise(F.concat(F.lit("7:x:"), key.cast("string"), F.lit(":T"))).alias("id"),
        F.concat(F.lit("NC_7.1:g."), key.cast("string"), F.when(F.col("o_custkey") % 3 == 0, "del").otherwise("a>T")).alias("hgvs"))
    p, g = I.parsed_id(F.col("id")), I.genomic_change(F.col("hgvs"))
    return rows.select("k", p["source"].alias("source"), p["pos"].alias("pos"), I.locus_key(F.col("id")).alias("locus"), g["pos"].alias("g_pos"), g["ref"].alias("g_ref"), g["alt"].alias("g_alt"),
                       I.underscored(F.lit("7"), F.col("k"), F.lit("A"), F.lit("T"), "b38").alias("underscored"), I.from_separated(F.concat(F.lit("chr7-"), F.col("k").cast("string"), F.lit("-a-t")), "-")["ref"].alias("dash_ref"))


def splice_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence scores of each row. The bits are made once and added up by a lambda in the last projection, which keeps that out of one
    whole-stage method: all columns in one method are too large for the JVM to compile."""
    rows = _raw(spark, sf_dir, SEQUENCES).withColumn("hot", Q.one_hot(F.col("seq"), 12))
    d, a = F.col("donor"), F.col("acceptor")
    return rows.select("l_orderkey", "l_linenumber", Q.donor_score(F.substring("seq", 1, 9)).alias("first_donor"), Q.splice_score(F.col("seq")).alias("splice_score"), Q.acceptor_score(F.rpad("seq", 23, "A")).alias("acceptor_score"),
                       Q.splice_distance(d, a).alias("distance"), Q.canonical_splice(d, a).alias("canonical"), Q.exon_number(F.col("exon")).alias("exon_number"), F.size("hot").alias("window"),
                       F.aggregate("hot", F.lit(0), lambda n, x: n + F.size(F.array_remove(x, 0))).alias("bits"), Q.mutated_window(F.col("seq"), F.lit(4), F.lit("X"), 2).alias("mutated"), F.round(Q.solvent_accessibility(F.col("l_linenumber") * 20.0), 4).alias("accessibility"))


def effect_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by effect terms, class text and effect id."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    k = F.col("l_partkey") % 6
    text = F.when(k == 0, "Not pathogenic").when(k == 1, "likely pathogenic ").when(k == 2, "Class 5").when(k == 3, "benign").when(k == 4, "unclear")
    term = F.when(k == 0, F.array(F.lit("x"), F.lit(" FunctionAffected"))).when(k == 1, F.array(F.lit("functionNotAffected"), F.lit("functionAffected"))).otherwise(F.array(F.lit("effectUnknown")))
    rows = lines.select(text.alias("text"), P.label_of_class(text).alias("by_class"), P.label_of_effects(term).alias("by_terms"), P.label_of_effect_id(F.when(k == 2, 99).when(k == 3, 11).otherwise(5)).alias("by_id"))
    return rows.groupBy("text", "by_class", "by_terms", "by_id").agg(F.count("*").alias("n"))


def filtered_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row filters one after another: conflicts, classes, alleles, score floor, dates; then an aligned matrix of what is left."""
    rows = P.not_conflicting(S.variants(spark, sf_dir))
    rows = P.dated(P.scored_at_least(P.valid_alleles(P.chosen(rows, source_db=["clinvar", "gnomad"])), "allele_freq", 0.0001), P.date_column(rows.select("last_evaluated")), "1995-01-01")
    m = P.aligned(rows.select("gene_symbol", *P.numeric_features(rows, ("pos",)).columns), ["allele_freq", "missing"])
    total = m.agg(F.count("*").alias("n"), F.round(F.sum("allele_freq"), 6).alias("total_af"), F.sum("missing").alias("missing"))
    return total


_QUERIES = (summary_rows, recent_label_rows, position_score_rows, population_rows, disease_mutation_rows, gene_source_rows, locus_class_rows, variant_json_rows, protein_json_rows, tissue_json_rows, study_json_rows, study_statistics, identifier_forms, splice_features, effect_labels, filtered_variants)

_V = f"v AS ({S.plain(S.VARIANTS)})"
_CHROM = "CASE WHEN upper(replace(chrom, 'chr', '')) = 'M' THEN 'MT' ELSE upper(replace(chrom, 'chr', '')) END"
_DONOR = "CASE WHEN regexp_matches(x, '^[ACGT]{9}$') THEN round(" + " + ".join(f"log2(CASE substr(x, {i + 1}, 1) " + " ".join(f"WHEN '{b}' THEN {p}::DOUBLE / {Q.BACKGROUND[b]}::DOUBLE" for b, p in row.items()) + " END)" for i, row in enumerate(Q.DONOR)) + ", 4) ELSE 0 END"
_ACCEPTOR = """CASE WHEN length(y) = 23 THEN round(0.3::DOUBLE * len(regexp_extract_all(substr(y, 1, 18), '[CT]')) - 0.1::DOUBLE * len(regexp_extract_all(substr(y, 1, 18), '[AG]'))
  + CASE WHEN substr(y, 21, 2) = 'AG' THEN 5.0 WHEN substr(y, 21, 1) = 'A' OR substr(y, 22, 1) = 'G' THEN 0.5 ELSE -3.0 END, 4) + 0.0::DOUBLE ELSE 0 END"""

_ORACLES = {
    "summary_rows": f"""WITH r AS ({S.plain(SUMMARY)}), c AS (SELECT *, CASE ClinicalSignificance WHEN 'Pathogenic' THEN 'pathogenic' WHEN 'Likely benign' THEN 'likely_benign' END AS pathogenicity FROM r WHERE Assembly = 'GRCh38' AND ClinicalSignificance <> 'Uncertain significance')
SELECT pathogenicity, GeneSymbol AS gene_symbol, count(*) AS n, count(TRY_CAST(Start AS INT)) AS n_placed, count(DISTINCT concat_ws(':', 'clinvar', Chromosome, TRY_CAST(Start AS INT), ReferenceAllele, AlternateAllele)) AS n_ids FROM c GROUP BY 1, 2""",
    "recent_label_rows": f"""WITH r AS ({S.plain(SUMMARY)}), c AS (SELECT CASE WHEN Chromosome = 'chrM' THEN 'MT' ELSE Chromosome END || ':' || Start || ':' || upper(ReferenceAllele) || ':' || AlternateAllele AS variant_id, ClinSigSimple::INT AS label, GeneSymbol AS gene_symbol, TRY_CAST(LastEvaluated AS TIMESTAMP) AS last_evaluated
  FROM r WHERE Assembly = 'GRCh38' AND ClinSigSimple IN ('0', '1') AND ReferenceAllele <> 'na' AND TRY_CAST(Start AS INT) IS NOT NULL AND TRY_CAST(LastEvaluated AS TIMESTAMP) > TIMESTAMP '1995-01-01 00:00:00')
SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY variant_id ORDER BY last_evaluated DESC, label DESC, gene_symbol DESC) = 1""",
    "position_score_rows": f"WITH r AS ({S.plain(POSITIONS)}) SELECT replace(a, 'chr', '') AS chrom, b::INT AS pos, max(c::DOUBLE) AS score FROM r WHERE b <> 'pos' GROUP BY 1, 2",
    "population_rows": f"""WITH {_V}, q AS (SELECT replace(chrom, 'chr', '') AS c, pos AS p FROM v WHERE gene_symbol = 'GENE7' AND replace(chrom, 'chr', '') <> 'M'), b AS (SELECT min(p) AS lo, max(p) AS hi FROM q),
k AS (SELECT {_CHROM} AS chrom, pos, upper(ref) AS ref, upper(alt) AS alt, max(allele_freq) AS f, max(CASE WHEN pos % 2 = 0 THEN allele_freq / 4 END) AS o FROM v, b WHERE pos BETWEEN lo AND hi AND {_CHROM} IN (SELECT c FROM q) GROUP BY 1, 2, 3, 4)
SELECT chrom, count(*) AS n, round(sum(least(1000.0, coalesce(f, 0) / (coalesce(o, 0) + 1e-9))), 4) AS total_enrichment FROM k GROUP BY 1""",
    "disease_mutation_rows": f"""WITH {_V}, k AS (SELECT {_CHROM} AS chrom, pos, upper(ref) AS r, upper(alt) AS a, max((clinical_sig = 'Pathogenic' OR contains(clinical_sig, 'onflict'))::INT) AS hgmd_is_disease_mutation, count(*)::INT AS hgmd_n_reports FROM v GROUP BY 1, 2, 3, 4)
SELECT chrom, hgmd_is_disease_mutation, hgmd_n_reports, count(*) AS n FROM k GROUP BY 1, 2, 3""",
    "gene_source_rows": """WITH d AS (SELECT concat('GENE', l_suppkey) AS g, count(*)::INT AS n FROM lineitem WHERE l_tax > 0.04 GROUP BY 1), v AS (SELECT concat('GENE', l_suppkey) AS g, max(CASE WHEN l_quantity > 45 THEN 5 WHEN l_quantity > 30 THEN 4 WHEN l_quantity > 10 THEN 2 ELSE 0 END) AS s FROM lineitem WHERE l_discount < 0.01 GROUP BY 1)
SELECT coalesce(d.g, v.g) AS gene_symbol, n AS omim_n_diseases, s AS clingen_validity_score FROM d FULL JOIN v ON d.g = v.g""",
    "locus_class_rows": f"""WITH {_V}, k AS (SELECT {_CHROM} AS chrom, pos, upper(ref) AS r, upper(alt) AS a, max(CASE clinical_sig WHEN 'Pathogenic' THEN 4 WHEN 'Likely benign' THEN 1 WHEN 'Benign' THEN 1 WHEN 'Uncertain significance' THEN 2 ELSE 0 END) AS lovd_variant_class FROM v GROUP BY 1, 2, 3, 4) SELECT chrom, lovd_variant_class, count(*) AS n FROM k GROUP BY 1, 2""",
    "variant_json_rows": "SELECT '1' AS chrom, o_orderkey::INT AS pos, 'A' AS ref, 'T' AS alt, concat('GENE', o_custkey % 50) AS gene_symbol, CASE WHEN o_orderstatus = 'F' THEN 0.25::DOUBLE ELSE 0.5::DOUBLE END AS allele_freq, CASE WHEN o_orderstatus = 'F' THEN 'exome' ELSE 'genome' END AS af_of FROM orders",
    "protein_json_rows": "SELECT concat('GENE', s_suppkey) AS gene_symbol, (1 + s_suppkey % 90)::INT AS residue, 'R' || (1 + s_suppkey % 90) || 'H' AS aa_change, 1 AS n_variants, 1 AS n_domains, 2 AS n_sites, '12,30' AS sites FROM supplier",
    "tissue_json_rows": "SELECT concat('GENE', s_suppkey) AS gene_symbol, 'Liver' AS tissue, s_suppkey + 0.5::DOUBLE AS tpm FROM supplier UNION ALL SELECT concat('GENE', s_suppkey), 'Lung', 0 FROM supplier",
    "study_json_rows": """WITH s AS (SELECT *, (1 + o_custkey % 9) * pow(10.0::DOUBLE, -(1 + o_orderkey % 20)) AS p FROM orders) SELECT 'rs' || o_orderkey AS rs_id, 'S' || (o_custkey % 7) AS study, 'a; b' AS trait, -round(log10(p), 4) AS neg_log10_p FROM s WHERE p <= 5e-8""",
    "study_statistics": """WITH s AS (SELECT *, pow(10.0::DOUBLE, -l_quantity / 4) AS p FROM lineitem) SELECT 'rs' || l_partkey AS rs_id, round(log10(min(p)), 4) AS log10_p, count(DISTINCT l_suppkey) AS n_studies, round(max(abs(l_discount - 0.05)), 6) AS max_abs_beta, bool_or(l_linestatus = 'F') AS replicated FROM s WHERE p < 5e-8 GROUP BY 1""",
    "identifier_forms": """SELECT o_orderkey::INT AS k, CASE WHEN o_orderstatus = 'F' THEN 'clinvar' END AS source, CASE WHEN o_orderstatus IN ('F', 'P') THEN o_orderkey::INT END AS pos,
  CASE o_orderstatus WHEN 'F' THEN concat('7:', o_orderkey, ':A:T') WHEN 'P' THEN concat(o_orderkey, ':A:T') ELSE concat('x:', o_orderkey, ':T') END AS locus, o_orderkey::INT AS g_pos, CASE WHEN o_custkey % 3 <> 0 THEN 'A' END AS g_ref, CASE WHEN o_custkey % 3 <> 0 THEN 'T' END AS g_alt,
  concat('chr7_', o_orderkey, '_A_T_b38') AS underscored, 'A' AS dash_ref FROM orders""",
    "splice_features": f"""WITH r AS ({S.plain(SEQUENCES)}), m AS (SELECT *, substr(seq, 1, 9) AS x1, length(seq) // 2 AS c, rpad(seq, 23, 'A') AS y FROM r), w AS (SELECT *, CASE WHEN c >= 3 AND c + 6 <= length(seq) THEN substr(seq, c - 2, 9) END AS x2 FROM m)
SELECT l_orderkey, l_linenumber, {_DONOR.replace("(x,", "(x1,")} AS first_donor, CASE WHEN x2 IS NOT NULL THEN {_DONOR.replace("(x,", "(x2,")} ELSE 0 END AS splice_score, {_ACCEPTOR} AS acceptor_score,
  least(coalesce(abs(donor), 50), coalesce(abs(acceptor), 50))::INT AS distance, (coalesce(abs(donor) IN (1, 2), false) OR coalesce(abs(acceptor) IN (1, 2), false))::INT AS canonical, CASE WHEN l_linenumber IS NOT NULL AND exon LIKE '%/12' THEN l_linenumber ELSE 0 END AS exon_number,
  12 AS window, 12 AS bits, substr(seq, 2, 2) || 'X' || substr(seq, 5, 2) AS mutated, round(greatest(0, least(1, 1 - l_linenumber * 20.0::DOUBLE / 100 * 0.6::DOUBLE)), 4) AS accessibility FROM w""",
    "effect_labels": """WITH k AS (SELECT l_partkey % 6 AS k FROM lineitem) SELECT CASE k WHEN 0 THEN 'Not pathogenic' WHEN 1 THEN 'likely pathogenic ' WHEN 2 THEN 'Class 5' WHEN 3 THEN 'benign' WHEN 4 THEN 'unclear' END AS text, CASE k WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 0 END AS by_class,
  CASE k WHEN 0 THEN 1 WHEN 1 THEN 0 END AS by_terms, CASE k WHEN 2 THEN 1 WHEN 3 THEN 0 END AS by_id, count(*) AS n FROM k GROUP BY 1, 2, 3, 4""",
    "filtered_variants": f"""WITH {_V} SELECT count(*) AS n, round(sum(allele_freq), 6) AS total_af, 0.0::DOUBLE AS missing FROM v WHERE NOT contains(clinical_sig, 'onflict') AND source_db IN ('clinvar', 'gnomad') AND alt <> 'na' AND ref <> 'na' AND allele_freq >= 0.0001 AND last_evaluated > TIMESTAMP '1995-01-01 00:00:00'""",
}


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict:
    return dict(_ORACLES)
