"""Registered annotation queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixspark.operators import annotation as A
from helixspark.operators import variants as V
from helixspark.plans.catalog import NORM
from helixspark.sources import fixtures as S


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.normalize(S.variants(spark, sf_dir))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def variant_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, alt = F.col("ref"), F.col("alt")
    return _clean(spark, sf_dir).groupBy(
        A.five_classes(F.col("clinical_sig")).alias("class"), A.variant_type(ref, alt).alias("variant_type"), A.frequency_bin(F.col("allele_freq")).alias("af_bin"),
        A.chromosome_class(F.col("chrom")).alias("chrom_class"), A.inferred_consequence(ref, alt).alias("inferred")).agg(F.count("*").alias("n"))


def multi_value_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws(";", F.col("l_discount").cast("string"), F.lit("."), F.col("l_tax").cast("string"))
    low, high = A.reduced_scores(text)
    return _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", low.alias("lowest"), high.alias("highest"))


def info_alleles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", F.lit("A,T").alias("alt"), F.concat(F.lit("DP=9;AF="), F.col("l_discount").cast("string"), F.lit(","), F.col("l_quantity").cast("string"), F.lit(";DB")).alias("info"))
    return A.explode_alleles(rows.withColumn("af", A.info_field(F.col("info"), "AF")), ["af"]).select("l_orderkey", "l_linenumber", "alt", "af")


def protein_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clean(spark, sf_dir).groupBy("gene_symbol", A.protein_key(F.col("protein_change")).alias("aa_change")).agg(F.count("*").alias("n"))


def evidence_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _clean(spark, sf_dir).withColumns({"cadd": (F.col("pos") % 40).cast("double"), "revel": (F.col("pos") % 100) / 100.0})
    return A.with_evidence(rows).groupBy("pathogenic_points", "benign_points").agg(F.count("*").alias("n"), F.sum("ba1").alias("n_ba1"), F.sum("pm2").alias("n_pm2"), F.sum("pvs1").alias("n_pvs1"))


def frequency_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _clean(spark, sf_dir).select("locus", "source_db", "allele_freq")
    return A.tiered_by_source(rows, ["gnomad", "uniprot"]).groupBy("af_source").agg(F.count("*").alias("n"), F.round(F.sum("allele_freq"), 6).alias("total_af"))


def allele_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.variants(spark, sf_dir)
    fix = rows.where("lower(alt) <> 'na'").groupBy("pos").agg(F.min(F.upper("alt")).alias("alt"))
    out = A.patched(rows.where("lower(alt) = 'na'"), fix, "pos", ["alt"])
    return out.groupBy("alt", "patched").agg(F.count("*").alias("n"))


def nearest_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _clean(spark, sf_dir)
    sites = rows.where("consequence = 'stop_gained'").select("gene_symbol", "pos")
    return A.nearest_site(rows.select("gene_symbol", "pos", "locus"), sites, "gene_symbol", "pos", 3.8).groupBy("gene_symbol").agg(F.count("distance").alias("n"), F.round(F.avg("distance"), 4).alias("mean_distance"), F.max("distance").alias("max_distance"))


def gene_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hops from the genes of one nation's suppliers, over strong edges."""
    edges = S.edges(spark, sf_dir).where("combined_score >= 700")
    seeds = spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_nationkey = 7").select(F.concat(F.lit("GENE"), F.col("s_suppkey").cast("string")).alias("node"))
    return A.neighbourhood(edges, seeds, 2)


def release_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.flips(*S.releases(spark, sf_dir), _lines(spark, sf_dir).where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("variant_id")))


def release_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = S.releases(spark, sf_dir)
    ids = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("variant_id"))
    return A.membership(ids, {"old": old, "new": new}, "variant_id").groupBy("in_old", "in_new").agg(F.count("*").alias("n"))


def residue_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "value")
    return A.residue_order(rows, "user_id", "event_id", "value").select("user_id", "event_id", F.round("local_mean", 8).alias("local_mean"), F.round("local_var", 8).alias("local_var"), "order_class")


def index_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.quality_report(_clean(spark, sf_dir), ["chrom", "pos", "allele_freq", "gene_symbol"]).select("column", "n", "n_null", F.when(F.col("column") != "allele_freq", F.col("lowest")).alias("lowest"), F.when(F.col("column") != "allele_freq", F.col("highest")).alias("highest"))


def gene_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.labelled(_clean(spark, sf_dir)).withColumn("ordinal", 6 - F.col("tier"))
    return rows.groupBy("gene_symbol").agg(
        F.count("*").alias("n"), F.sum("label").alias("n_pathogenic"), F.max("ordinal").alias("best_ordinal"), F.count_if(F.col("source_db") == "uniprot").alias("n_uniprot"),
        F.bool_or(F.col("source_db") == "uniprot").alias("has_uniprot"), F.count_distinct("locus").alias("n_loci"), F.max_by("consequence", F.struct("pos", "consequence")).alias("last_consequence"))


def expression_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    tpm = F.col("l_discount") * F.col("l_quantity")
    rows = _lines(spark, sf_dir).select(F.concat(F.lit("GENE"), F.col("l_suppkey").cast("string")).alias("gene_symbol"), tpm.alias("tpm"))
    g = rows.groupBy("gene_symbol").agg(F.max("tpm").alias("m"), F.avg("tpm").alias("a"), F.count_if(F.col("tpm") >= 1).alias("n_expressed"))
    return g.select("gene_symbol", F.round("m", 6).alias("max_tpm"), F.round("a", 6).alias("mean_tpm"), "n_expressed", F.round(F.when(F.col("m") > 0, 1 - F.col("a") / F.col("m")).otherwise(0.0), 6).alias("specificity"))


def frequency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 bins of log10 from -8 to 0, by class."""
    k = F.least(F.lit(39), F.greatest(F.lit(0), F.floor((F.log10(F.greatest(F.col("allele_freq"), F.lit(0.0)) + 1e-8) + 8) * 5))).cast("int")
    return V.labelled(_clean(spark, sf_dir)).where("allele_freq IS NOT NULL").groupBy("label", k.alias("bin")).agg(F.count("*").alias("n"))


def text_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevance of every document to a list of keywords, by presence and by weighted frequency."""
    return A.text_relevance(_titled(spark, sf_dir), KEYWORDS).select("doc_id", "n_keywords", "presence_score", "frequency_score")


def feature_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that the documents' texts introduce, known ones and common words left out, with the number of documents."""
    return A.name_candidates(_titled(spark, sf_dir), NAME_PATTERN, ["license", "the"]).groupBy("name").agg(F.count_distinct("doc_id").alias("n_docs"))


#: Keywords and the pattern of introduced names, parameters of the two text jobs.
KEYWORDS = ["license", "contact", "email", "copyright", "information", "report"]
NAME_PATTERN = r"(?:^|[^A-Za-z])(?:called|named|using|under|with) ([A-Za-z][A-Za-z0-9-]*)"


def _titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their first line as the title and the rest as the abstract."""
    text = F.coalesce("text", F.lit(""))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.split_part(text, F.lit("\n"), F.lit(1)).alias("title"), F.substring(text, F.instr(text, "\n") + 1, 1 << 30).alias("abstract"), F.instr(text, "\n").alias("_at")).withColumn("abstract", F.when(F.col("_at") > 0, F.col("abstract")).otherwise("")).drop("_at")


_QUERIES = (variant_classes, multi_value_scores, info_alleles, protein_changes, evidence_points, frequency_tiers, allele_patch, nearest_sites, gene_neighbourhood, release_flips, release_membership, residue_windows, index_quality, gene_summary, expression_summary, frequency_histogram, text_relevance, feature_candidates)

_RELEASES = f"o AS ({S.plain(S.RELEASE_OLD)}), w AS ({S.plain(S.RELEASE_NEW)})"

_ORACLES = {
    "variant_classes": f"""WITH {NORM} SELECT CASE WHEN s LIKE 'pathogenic%' THEN 'pathogenic' WHEN s LIKE 'benign%' THEN 'benign' WHEN contains(s, 'likely pathogenic') THEN 'likely_pathogenic'
  WHEN contains(s, 'likely benign') THEN 'likely_benign' WHEN contains(s, 'pathogenic') THEN 'pathogenic' WHEN contains(s, 'benign') THEN 'benign' ELSE 'uncertain' END AS class,
  CASE WHEN lr = 1 AND la = 1 THEN 'SNV' WHEN lr < la THEN 'insertion' WHEN lr > la THEN 'deletion' ELSE 'complex' END AS variant_type,
  CASE WHEN allele_freq IS NULL THEN 'unknown' WHEN allele_freq < 0.0001 THEN 'ultra_rare' WHEN allele_freq < 0.001 THEN 'rare' WHEN allele_freq < 0.01 THEN 'low_freq' WHEN allele_freq < 0.05 THEN 'common' ELSE 'very_common' END AS af_bin,
  CASE WHEN chrom IN ('X', 'Y') THEN 'sex' WHEN chrom = 'MT' THEN 'mitochondrial' ELSE 'autosome' END AS chrom_class,
  CASE WHEN la = 1 AND lr > 1 THEN 'frameshift_variant' WHEN lr = 1 AND la > 1 THEN 'frameshift_variant' ELSE 'missense_variant' END AS inferred,
  count(*) AS n FROM (SELECT *, lower(clinical_sig) AS s, length(ref) AS lr, length(alt) AS la FROM n) GROUP BY 1, 2, 3, 4, 5""",
    "multi_value_scores": "SELECT l_orderkey, l_linenumber, least(l_discount, l_tax) AS lowest, greatest(l_discount, l_tax) AS highest FROM lineitem",
    "info_alleles": """SELECT l_orderkey, l_linenumber, 'A' AS alt, least(1.0, greatest(0.0, l_discount)) AS af FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, 'T', least(1.0, greatest(0.0, l_quantity)) FROM lineitem""",
    "protein_changes": f"WITH {NORM} SELECT gene_symbol, replace(replace(substr(protein_change, 3), 'Arg', 'R'), 'His', 'H') AS aa_change, count(*) AS n FROM n GROUP BY 1, 2",
    "evidence_points": f"""WITH {NORM}, f AS (SELECT coalesce(allele_freq, 0) > 0.05 AS ba1, coalesce(allele_freq, 0) < 1e-6 AS pm2, regexp_matches(consequence, 'stop_gained|frameshift|splice_(donor|acceptor)') AS pvs1,
  pos % 40 >= 25 OR (pos % 100) / 100.0 >= 0.7 AS pp3, pos % 40 < 15 AND (pos % 100) / 100.0 < 0.15 AS bp4 FROM n)
SELECT 8 * pvs1::INT + 2 * pm2::INT + pp3::INT AS pathogenic_points, 8 * ba1::INT + bp4::INT AS benign_points, count(*) AS n, CAST(sum(ba1::INT) AS BIGINT) AS n_ba1, CAST(sum(pm2::INT) AS BIGINT) AS n_pm2, CAST(sum(pvs1::INT) AS BIGINT) AS n_pvs1 FROM f GROUP BY 1, 2""",
    "frequency_tiers": f"""WITH {NORM}, t AS (SELECT locus, max(allele_freq) FILTER (source_db = 'gnomad') AS g, max(allele_freq) FILTER (source_db = 'uniprot') AS u FROM n GROUP BY 1)
SELECT CASE WHEN allele_freq IS NOT NULL THEN 'own' WHEN g IS NOT NULL THEN 'gnomad' WHEN u IS NOT NULL THEN 'uniprot' ELSE 'default' END AS af_source, count(*) AS n, round(sum(coalesce(allele_freq, g, u, 0)), 6) AS total_af
FROM n JOIN t ON t.locus = n.locus GROUP BY 1""",
    "allele_patch": f"""WITH v AS ({S.plain(S.VARIANTS)}), f AS (SELECT pos, min(upper(alt)) AS fixed FROM v WHERE lower(alt) <> 'na' GROUP BY 1)
SELECT coalesce(fixed, alt) AS alt, fixed IS NOT NULL AS patched, count(*) AS n FROM v LEFT JOIN f ON f.pos = v.pos WHERE lower(alt) = 'na' GROUP BY 1, 2""",
    "nearest_sites": f"""WITH {NORM}, s AS (SELECT DISTINCT gene_symbol AS g, pos AS p FROM n WHERE consequence = 'stop_gained'), q AS (SELECT DISTINCT gene_symbol, pos FROM n),
d AS (SELECT gene_symbol, pos, round(min(abs(pos - p)) * 3.8::DOUBLE, 2) AS distance FROM q LEFT JOIN s ON g = gene_symbol GROUP BY 1, 2)
SELECT n.gene_symbol, count(distance) AS n, round(avg(distance), 4) AS mean_distance, max(distance) AS max_distance FROM n JOIN d ON d.gene_symbol = n.gene_symbol AND d.pos = n.pos GROUP BY 1""",
    "gene_neighbourhood": f"""WITH e AS (SELECT DISTINCT src, dst FROM ({S.plain(S.EDGES)}) WHERE combined_score >= 700), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
h0 AS (SELECT concat('GENE', s_suppkey) AS node FROM supplier WHERE s_nationkey = 7), h1 AS (SELECT DISTINCT dst AS node FROM h0 JOIN b ON src = node WHERE dst NOT IN (SELECT node FROM h0)),
h2 AS (SELECT DISTINCT dst AS node FROM h1 JOIN b ON src = node WHERE dst NOT IN (SELECT node FROM h0) AND dst NOT IN (SELECT node FROM h1))
SELECT node, 0 AS hop FROM h0 UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2""",
    "release_flips": f"""WITH {_RELEASES}, t AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_linestatus = 'F'),
c AS (SELECT count(*) AS n_common, count_if(o.clinical_sig <> w.clinical_sig) AS n_changed, count_if(o.clinical_sig <> w.clinical_sig AND t.id IS NOT NULL) AS k, greatest(1, (SELECT count(*) FROM t))::DOUBLE AS ids,
  sum(CASE WHEN t.id IS NULL OR o.clinical_sig = w.clinical_sig THEN 0.0
    WHEN o.clinical_sig = 'Pathogenic' AND w.clinical_sig = 'Benign' THEN 3.0 WHEN o.clinical_sig = 'Pathogenic' AND w.clinical_sig = 'Likely benign' THEN 2.5
    WHEN o.clinical_sig = 'Likely pathogenic' AND w.clinical_sig = 'Benign' THEN 2.5 WHEN o.clinical_sig = 'Likely pathogenic' AND w.clinical_sig = 'Likely benign' THEN 2.0
    WHEN o.clinical_sig = 'Benign' AND w.clinical_sig = 'Pathogenic' THEN 3.0 WHEN o.clinical_sig = 'Benign' AND w.clinical_sig = 'Likely pathogenic' THEN 2.5
    WHEN o.clinical_sig = 'Likely benign' AND w.clinical_sig = 'Pathogenic' THEN 2.5 WHEN o.clinical_sig = 'Likely benign' AND w.clinical_sig = 'Likely pathogenic' THEN 2.0
    WHEN o.clinical_sig = 'Uncertain significance' AND w.clinical_sig IN ('Pathogenic', 'Benign') THEN 1.5
    WHEN o.clinical_sig = 'Uncertain significance' AND w.clinical_sig IN ('Likely pathogenic', 'Likely benign') THEN 1.0
    WHEN o.clinical_sig IN ('Pathogenic', 'Benign') AND w.clinical_sig = 'Uncertain significance' THEN 1.5 ELSE 0.5 END)::DOUBLE AS s
  FROM o JOIN w ON o.variant_id = w.variant_id LEFT JOIN t ON t.id = o.variant_id)
SELECT n_common, n_changed::BIGINT AS n_changed, k::BIGINT AS n_training_changed, round(k / ids, 6) AS flip_rate, round(s / ids, 6) AS weighted_impact,
  CASE WHEN k / ids >= 0.025 OR s / ids >= 0.025 THEN 'urgent' WHEN k / ids >= 0.01 OR s / ids >= 0.015 THEN 'retrain' WHEN k / ids >= 0.005 THEN 'monitor' ELSE 'none' END AS urgency FROM c""",
    "release_membership": f"""WITH {_RELEASES} SELECT o_orderkey IN (SELECT variant_id FROM o) AS in_old, o_orderkey IN (SELECT variant_id FROM w) AS in_new, count(*) AS n FROM orders GROUP BY 1, 2""",
    "residue_windows": """WITH r AS (SELECT user_id, event_id, avg(value) OVER w AS m, var_pop(value) OVER w AS v FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
SELECT user_id, event_id, round(m, 8) AS local_mean, round(v, 8) AS local_var, CASE WHEN m >= 90 AND v < 20 THEN 1 WHEN m >= 80 AND v < 40 THEN 2 ELSE 0 END AS order_class FROM r""",
    "index_quality": f"""WITH {NORM} SELECT 'chrom' AS "column", count(*) AS n, count_if(chrom IS NULL)::BIGINT AS n_null, min(chrom) AS lowest, max(chrom) AS highest FROM n
UNION ALL SELECT 'pos', count(*), count_if(pos IS NULL)::BIGINT, min(pos)::VARCHAR, max(pos)::VARCHAR FROM n
UNION ALL SELECT 'allele_freq', count(*), count_if(allele_freq IS NULL)::BIGINT, NULL, NULL FROM n
UNION ALL SELECT 'gene_symbol', count(*), count_if(gene_symbol IS NULL)::BIGINT, min(gene_symbol), max(gene_symbol) FROM n""",
    "gene_summary": f"""WITH {NORM} SELECT gene_symbol, count(*) AS n, sum(label)::BIGINT AS n_pathogenic, max(6 - tier)::INT AS best_ordinal, count_if(source_db = 'uniprot')::BIGINT AS n_uniprot,
  bool_or(source_db = 'uniprot') AS has_uniprot, count(DISTINCT locus) AS n_loci, arg_max(consequence, (pos, consequence)) AS last_consequence FROM l WHERE label IS NOT NULL GROUP BY 1""",
    "expression_summary": """WITH g AS (SELECT concat('GENE', l_suppkey) AS gene_symbol, max(l_discount * l_quantity) AS m, avg(l_discount * l_quantity) AS a, count_if(l_discount * l_quantity >= 1)::BIGINT AS n_expressed FROM lineitem GROUP BY 1)
SELECT gene_symbol, round(m, 6) AS max_tpm, round(a, 6) AS mean_tpm, n_expressed, round(CASE WHEN m > 0 THEN 1 - a / m ELSE 0 END, 6) AS specificity FROM g""",
    "frequency_histogram": f"""WITH {NORM} SELECT label, least(39, greatest(0, floor((log10(greatest(allele_freq, 0) + 1e-8) + 8) * 5)))::INT AS bin, count(*) AS n FROM l WHERE label IS NOT NULL AND allele_freq IS NOT NULL GROUP BY 1, 2""",
    "text_relevance": """WITH d AS (SELECT doc_id, lower(split_part(coalesce(text, ''), chr(10), 1)) AS t, lower(CASE WHEN contains(coalesce(text, ''), chr(10)) THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END) AS a FROM documents),
k AS (SELECT unnest(['license', 'contact', 'email', 'copyright', 'information', 'report']) AS w),
x AS (SELECT doc_id, w, contains(t, w) AS in_title, (length(t || ' ' || a) - length(replace(t || ' ' || a, w, ''))) / length(w) AS n FROM d, k)
SELECT doc_id, count_if(n > 0)::INT AS n_keywords, round(least(1.0, count_if(n > 0) / greatest(6 * 0.25, 1)::DOUBLE), 4) AS presence_score,
  round(least(1.0, sum(n * CASE WHEN in_title THEN 0.3::DOUBLE ELSE 0.1::DOUBLE END)), 4) AS frequency_score FROM x GROUP BY 1""",
    "feature_candidates": r"""WITH d AS (SELECT doc_id, split_part(coalesce(text, ''), chr(10), 1) || '. ' || CASE WHEN contains(coalesce(text, ''), chr(10)) THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END AS x FROM documents),
n AS (SELECT doc_id, unnest(regexp_extract_all(x, '(?i)(?:^|[^A-Za-z])(?:called|named|using|under|with) ([A-Za-z][A-Za-z0-9-]*)', 1)) AS name FROM d)
SELECT name, count(DISTINCT doc_id) AS n_docs FROM n WHERE length(name) BETWEEN 3 AND 60 AND lower(name) NOT IN ('license', 'the', 'and', 'for', 'with', 'from', 'using', 'based', 'this', 'that', 'these', 'our', 'their', 'here', 'also', 'both', 'each', 'such', 'thus') GROUP BY 1""",
}


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict:
    return dict(_ORACLES)
