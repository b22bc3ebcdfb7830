"""Parsers of variant, gene and study sources: each takes the raw rows of a source (read by Spark's readers) and gives typed ones.

Reading and parsing are apart, so that a source may come from a file, a table or a stream. Rows that lack what the key needs go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixspark.functions import expressions as X
from helixspark.functions import identifiers as I
from helixspark.operators import annotation as A
from helixspark.operators import filters as P

#: Gene validity classes, variant classes of a locus database, disease mutation classes, numeric significance.
GENE_VALIDITY = {"definitive": 5, "strong": 4, "moderate": 3, "limited": 2, "no known disease relationship": 1}
LOCUS_CLASSES = {
    "benign": 1, "likely benign": 1, "benign/likely benign": 1, "uncertain significance": 2, "variant of uncertain significance": 2, "vus": 2, "conflicting": 2,
    "conflicting interpretations of pathogenicity": 2, "likely pathogenic": 3, "pathogenic/likely pathogenic": 3, "pathogenic": 4,
}
DISEASE_CLASSES = ["DM", "DM?"]
SIGNIFICANCE = {"Pathogenic": 2, "Likely pathogenic": 1, "Uncertain significance": 0, "Likely benign": -1, "Benign": -2}


def _ordinal(table: dict[str, int], text: Column, default: int = 0) -> Column:
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(m, F.lower(F.trim(text))), F.lit(default))


def delimited(spark: SparkSession, path: str | list[str], sep: str = "\t", comment: str | None = None) -> DataFrame:
    """A delimited text with a header, all columns as text; malformed lines go."""
    reader = spark.read.option("header", True).option("sep", sep).option("mode", "DROPMALFORMED")
    return (reader.option("comment", comment) if comment else reader).csv(path)


def summary(raw: DataFrame, assembly: str = "GRCh38", classes: tuple[str, ...] = (), genes: tuple[str, ...] = ()) -> DataFrame:
    """A release summary's rows of one assembly in canonical names, with the five-way class and a metadata map; optional class and gene filters."""
    rows = raw.where(F.col("Assembly") == assembly).select(
        F.col("GeneSymbol").alias("gene_symbol"), F.col("ClinicalSignificance").alias("clinical_sig"), F.col("ReviewStatus").alias("review_status"), F.col("Chromosome").alias("chrom"), F.col("Start").try_cast("int").alias("pos"),
        F.col("ReferenceAllele").alias("ref"), F.col("AlternateAllele").alias("alt"), F.col("VariationID").alias("source_id"), F.lit("clinvar").alias("source_db"), A.five_classes(F.col("ClinicalSignificance")).alias("pathogenicity"),
        F.create_map(F.lit("rs_id"), F.col("RS"), F.lit("review_status"), F.col("ReviewStatus")).alias("metadata"))
    out = P.chosen(rows, pathogenicity=list(classes), gene_symbol=list(genes))
    return out.withColumn("variant_id", I.variant_id(F.lit("clinvar"), F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alt")))


def recent_labels(raw: DataFrame, cutoff: str, assembly: str = "GRCh38", longest: int = 50) -> DataFrame:
    """Labelled variants of one assembly that were evaluated after the cutoff: valid alleles, one row an id (the latest, then by label)."""
    rows = raw.where((F.col("Assembly") == assembly) & F.col("ClinSigSimple").isin("0", "1")).withColumnsRenamed({"ReferenceAllele": "ref", "AlternateAllele": "alt"})
    rows = P.valid_alleles(P.dated(rows, "LastEvaluated", cutoff), longest).select(
        X.norm_chrom(F.col("Chromosome")).alias("chrom"), F.col("Start").try_cast("int").alias("pos"), F.upper("ref").alias("ref"), F.upper("alt").alias("alt"), F.col("ClinSigSimple").cast("int").alias("label"),
        F.trim(F.coalesce("GeneSymbol", F.lit(""))).alias("gene_symbol"), F.col("LastEvaluated").try_cast("timestamp").alias("last_evaluated")).where("pos IS NOT NULL")
    keyed = rows.withColumn("variant_id", X.locus(F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alt")))
    return keyed.groupBy("variant_id").agg(F.max(F.struct("last_evaluated", "label", "gene_symbol", "chrom", "pos", "ref", "alt")).alias("r")).select("variant_id", "r.*")


def position_scores(raw: DataFrame) -> DataFrame:
    """chrom, pos, score of three text columns; a header line and other rows without numbers go; of a repeated position the largest."""
    c, p, s = raw.columns[:3]
    rows = raw.select(X.norm_chrom(F.col(c)).alias("chrom"), F.col(p).try_cast("int").alias("pos"), F.col(s).try_cast("double").alias("score"))
    return rows.where("pos IS NOT NULL AND score IS NOT NULL").groupBy("chrom", "pos").agg(F.max("score").alias("score"))


def locus_scores(raw: DataFrame, score: str, keep_all: bool = False) -> DataFrame:
    """The largest score a locus; SNVs only unless keep_all; rows without a score go."""
    rows = raw.select(X.norm_chrom(F.col("chrom")).alias("chrom"), F.col("pos").try_cast("int").alias("pos"), F.upper("ref").alias("ref"), F.upper("alt").alias("alt"), F.col(score).try_cast("double").alias("score"))
    rows = rows.where("pos IS NOT NULL AND score IS NOT NULL" + ("" if keep_all else " AND length(ref) = 1 AND length(alt) = 1"))
    return rows.groupBy("chrom", "pos", "ref", "alt").agg(F.max("score").alias("score"))


def population_frequencies(raw: DataFrame, query: DataFrame, finnish: str = "GENOME_AF_fin", other: str = "GENOME_AF_nfe") -> DataFrame:
    """af_fin, af_nfsee and their enrichment a locus, for the query's chromosomes and position range."""
    rows = raw.select(X.norm_chrom(F.col("chr")).alias("chrom"), F.col("pos").try_cast("int").alias("pos"), F.upper("ref").alias("ref"), F.upper("alt").alias("alt"), F.col(finnish).try_cast("double").alias("af_fin"), F.col(other).try_cast("double").alias("af_nfsee"))
    inside = P.in_region(rows, query)
    one = inside.groupBy("chrom", "pos", "ref", "alt").agg(F.max("af_fin").alias("af_fin"), F.max("af_nfsee").alias("af_nfsee"))
    return one.withColumn("enrichment", I.enrichment(F.col("af_fin"), F.col("af_nfsee")))


def gene_diseases(raw: DataFrame) -> DataFrame:
    """omim_n_diseases a gene: its phenotype rows."""
    gene = F.upper(F.trim("symbol"))
    return raw.where((F.lower("type").contains("phenotype")) & (F.coalesce(gene, F.lit("")) != "") & (gene != "-")).groupBy(gene.alias("gene_symbol")).agg(F.count("*").cast("int").alias("omim_n_diseases"))


def gene_validity(raw: DataFrame) -> DataFrame:
    """clingen_validity_score: the best class of each gene."""
    return raw.where("symbol IS NOT NULL").groupBy(F.upper(F.trim("symbol")).alias("gene_symbol")).agg(F.max(_ordinal(GENE_VALIDITY, F.col("classification"))).alias("clingen_validity_score"))


def disease_mutations(raw: DataFrame) -> DataFrame:
    """hgmd_is_disease_mutation and hgmd_n_reports a locus, of rows (chrom, pos, ref, alt, class) or VCF rows with CLASS in info; a header goes."""
    kind = F.col("class") if "class" in raw.columns else A.info_field(F.col("info"), "CLASS")
    rows = raw.select(X.norm_chrom(F.col("chrom")).alias("chrom"), F.col("pos").try_cast("int").alias("pos"), F.upper("ref").alias("ref"), F.upper("alt").alias("alt"), F.upper(F.trim(kind)).isin(*DISEASE_CLASSES).cast("int").alias("dm"))
    return rows.where("pos IS NOT NULL").groupBy("chrom", "pos", "ref", "alt").agg(F.max(F.coalesce("dm", F.lit(0))).alias("hgmd_is_disease_mutation"), F.count("*").cast("int").alias("hgmd_n_reports"))


def protein_scores(raw: DataFrame) -> DataFrame:
    """gene_symbol, aa_change, eve_score (0 to 1) from either layout: with the key, or with protein name, position and residues; the largest."""
    if {"gene_symbol", "aa_change", "eve_score"} <= set(raw.columns):
        rows = raw.select("gene_symbol", "aa_change", F.col("eve_score").try_cast("double").alias("eve_score"))
    else:
        position, score = F.col("position").try_cast("double").cast("int"), F.col("EVE_scores_ASM").try_cast("double")
        rows = raw.select(F.split_part("mutations_protein_name", F.lit("_"), F.lit(1)).alias("gene_symbol"), F.concat(F.trim("wt_aa"), position.cast("string"), F.trim("mt_aa")).alias("aa_change"), F.when(score.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).alias("eve_score"))
    return rows.where("gene_symbol IS NOT NULL AND aa_change IS NOT NULL AND eve_score IS NOT NULL").groupBy("gene_symbol", "aa_change").agg(F.max("eve_score").alias("eve_score"))


def locus_classes(raw: DataFrame) -> DataFrame:
    """lovd_variant_class (0 to 4): the largest of each locus, of rows (variant_id, classification)."""
    rows = raw.select(I.parsed_id(F.col("variant_id")).alias("l"), _ordinal(LOCUS_CLASSES, F.col("classification")).alias("k")).where("l IS NOT NULL")
    return rows.groupBy(X.norm_chrom(F.col("l.chrom")).alias("chrom"), F.col("l.pos").alias("pos"), F.upper("l.ref").alias("ref"), F.upper("l.alt").alias("alt")).agg(F.max("k").alias("lovd_variant_class"))


def section(lines: DataFrame, name: str) -> DataFrame:
    """The data rows of one `## name ##` section of a sectioned export, a map from header to value a row; lines is (file, text), a file a row."""
    body = F.regexp_extract("text", rf"(?s)## {name} ##[^\n]*\n(.*?)(?:\n##|\z)", 1)
    rows = F.filter(F.split(body, "\n"), lambda x: (F.trim(x) != "") & ~x.startswith("#"))
    cells = lambda x: F.transform(F.split(x, "\t"), lambda c: F.regexp_replace(F.regexp_replace(c, r'^"|"$', ""), r"^\{\{|\}\}$", ""))
    cut = lines.select("file", rows.alias("r")).where(F.size("r") > 1)
    return cut.select("file", cells(F.get("r", F.lit(0))).alias("h"), F.explode(F.slice("r", 2, F.size("r"))).alias("line")).select("file", F.map_from_arrays("h", F.slice(F.concat(cells(F.col("line")), F.array_repeat(F.lit(""), F.size("h"))), 1, F.size("h"))).alias("fields"))


def labelled_changes(raw: DataFrame) -> DataFrame:
    """Labels of a locus database's JSON rows (chrom, hg38, hg19, effects): HGVS on hg38 before hg19, rows without label or position go."""
    change = I.genomic_change(F.coalesce("hg38", "hg19"))
    rows = raw.select(X.norm_chrom(F.col("chrom")).alias("chrom"), change.alias("c"), P.label_of_effects(F.col("effects")).alias("label"), F.when(F.col("hg38").isNotNull(), "hg38").otherwise("hg19").alias("build"))
    return rows.select("chrom", "c.*", "label", "build").where("label IS NOT NULL AND pos IS NOT NULL")


def gnomad_variants(raw: DataFrame) -> DataFrame:
    """Canonical rows of saved API responses (json text): exome frequency before genome, the rest as metadata."""
    freq = "struct<af:double,ac:bigint,an:bigint>"
    parsed = raw.select(F.explode(F.from_json("json", f"struct<gene:string,variants:array<struct<variant_id:string,consequence:string,exome:{freq},genome:{freq}>>>").alias("r").getField("variants")).alias("v"), F.get_json_object("json", "$.gene").alias("gene_symbol"))
    at = I.from_separated(F.col("v.variant_id"), "-")
    return parsed.select(at.alias("l"), "gene_symbol", F.col("v.consequence").alias("consequence"), F.coalesce("v.exome.af", "v.genome.af").alias("allele_freq"), F.when(F.col("v.exome.af").isNotNull(), "exome").otherwise("genome").alias("af_of")).where("l IS NOT NULL").select("l.*", "gene_symbol", "consequence", "allele_freq", "af_of")


def protein_entries(raw: DataFrame) -> DataFrame:
    """A row a natural variant of protein entries (json): accession, gene, position, residues, description."""
    kind = "struct<accession:string,gene:string,features:array<struct<type:string,begin:int,original:string,variation:string,description:string>>>"
    entry = raw.select(F.from_json("json", kind).alias("e"))
    rows = entry.select("e.accession", "e.gene", F.explode(F.filter("e.features", lambda f: f["type"] == "Natural variant")).alias("f"))
    return rows.select("accession", F.col("gene").alias("gene_symbol"), F.col("f.begin").alias("residue"), F.concat("f.original", F.col("f.begin").cast("string"), "f.variation").alias("aa_change"), F.col("f.description").alias("description"))


def protein_summary(raw: DataFrame) -> DataFrame:
    """Counts of an entry's features by kind, and its active and binding sites in order."""
    kind = "struct<accession:string,gene:string,features:array<struct<type:string,begin:int>>>"
    e = raw.select(F.from_json("json", kind).alias("e")).select("e.*")
    n = lambda t: F.size(F.filter("features", lambda f: f["type"] == t))
    sites = F.filter("features", lambda f: f["type"].isin("Active site", "Binding site"))
    return e.select("accession", F.col("gene").alias("gene_symbol"), n("Natural variant").alias("n_variants"), n("Domain").alias("n_domains"), F.size(sites).alias("n_sites"), F.array_join(F.array_sort(F.transform(sites, lambda f: f["begin"])).cast("array<string>"), ",").alias("sites"))


def tissue_expression(raw: DataFrame) -> DataFrame:
    """gene_symbol, tissue, tpm of expression responses (json)."""
    rows = raw.select(F.explode(F.from_json("json", "struct<data:array<struct<geneSymbol:string,tissueSiteDetailId:string,median:double>>>").getField("data")).alias("d"))
    return rows.select(F.col("d.geneSymbol").alias("gene_symbol"), F.col("d.tissueSiteDetailId").alias("tissue"), F.coalesce("d.median", F.lit(0.0)).alias("tpm"))


def eqtls(raw: DataFrame) -> DataFrame:
    """Loci, p and effect of eQTL responses (json); ids are chr_pos_ref_alt_build."""
    rows = raw.select(F.explode(F.from_json("json", "struct<data:array<struct<variantId:string,pValue:double,nes:double,geneSymbol:string>>>").getField("data")).alias("d"))
    return rows.select(I.from_separated(F.col("d.variantId")).alias("l"), F.col("d.geneSymbol").alias("gene_symbol"), F.col("d.pValue").alias("p_value"), F.col("d.nes").alias("beta"), (-F.log10(F.col("d.pValue") + 1e-300)).alias("neg_log10_p")).where("l IS NOT NULL").select("l.*", "gene_symbol", "p_value", "beta", "neg_log10_p")


def study_hits(raw: DataFrame, p_limit: float = 5e-8) -> DataFrame:
    """Genome-wide significant associations of study responses (json), traits joined."""
    kind = "struct<associations:array<struct<rsId:string,pvalueMantissa:double,pvalueExponent:int,study:string,traits:array<string>>>>"
    a = raw.select(F.explode(F.from_json("json", kind).getField("associations")).alias("a"))
    p = F.col("a.pvalueMantissa") * F.pow(F.lit(10.0), F.col("a.pvalueExponent"))
    return a.select(F.col("a.rsId").alias("rs_id"), "a.study", F.array_join("a.traits", "; ").alias("trait"), p.alias("p_value")).where(F.col("p_value") <= p_limit)


def gene_predictions(raw: DataFrame) -> DataFrame:
    """A row a (credible set, gene) of nested locus-to-gene predictions (json); sets without genes keep a row."""
    kind = "struct<variantId:string,credibleSets:array<struct<studyId:string,l2g:array<struct<gene:string,score:double>>>>>"
    v = raw.select(F.from_json("json", kind).alias("v"))
    s = v.select("v.variantId", F.explode_outer("v.credibleSets").alias("s")).select("variantId", "s.studyId", F.explode_outer("s.l2g").alias("g"))
    return s.select(F.col("variantId").alias("variant_id"), F.col("studyId").alias("study"), "g.gene", "g.score")


def somatic(raw: DataFrame) -> DataFrame:
    """Gene, consequence and first transcript change of somatic mutations (json)."""
    kind = "struct<hits:array<struct<id:string,consequence:array<struct<gene:string,term:string,aaChange:string>>>>>"
    h = raw.select(F.explode(F.from_json("json", kind).getField("hits")).alias("h"))
    first = F.get("h.consequence", F.lit(0))
    return h.select(F.col("h.id").alias("mutation_id"), first["gene"].alias("gene_symbol"), first["term"].alias("consequence"), first["aaChange"].alias("aa_change"))


def regulatory_elements(raw: DataFrame) -> DataFrame:
    """chrom, lo, hi, kind, z of regulatory elements (json)."""
    r = raw.select(F.explode(F.from_json("json", "struct<elements:array<struct<chrom:string,start:int,len:int,group:string,zscore:double>>>").getField("elements")).alias("e"))
    return r.select(X.norm_chrom(F.col("e.chrom")).alias("chrom"), F.col("e.start").alias("lo"), (F.col("e.start") + F.col("e.len")).alias("hi"), F.col("e.group").alias("kind"), F.col("e.zscore").alias("z"))


def variant_info(raw: DataFrame, populations: list[str]) -> DataFrame:
    """Variant information (json): rs ids joined, a column a population's frequency."""
    kind = "struct<variantId:string,rsIds:array<string>,alleleFrequencies:array<struct<populationName:string,alleleFrequency:double>>>"
    v = raw.select(F.from_json("json", kind).alias("v")).select("v.*")
    table = F.map_from_entries(F.transform("alleleFrequencies", lambda x: F.struct(x["populationName"], x["alleleFrequency"])))
    return v.select(F.col("variantId").alias("variant_id"), F.array_join("rsIds", ",").alias("rs_ids"), *[F.try_element_at(table, F.lit(p)).alias(f"af_{p.lower()}") for p in populations])


def vcf_alleles(rows: DataFrame) -> DataFrame:
    """id, alleles and first molecular consequence of a release's VCF rows; of several alternate alleles the first."""
    return rows.select(F.col("id").alias("source_id"), "ref", F.split_part("alt", F.lit(","), F.lit(1)).alias("alt"), F.regexp_extract(A.info_field(F.col("info"), "MC"), r"^[^|,]*\|([^,|]*)", 1).alias("consequence"))


def numeric_significance(sig: Column) -> Column:
    """-2 (benign) to 2 (pathogenic); null for anything else."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in SIGNIFICANCE.items() for x in kv]), sig)


def c_alpha(lines: DataFrame) -> DataFrame:
    """file, residue, plddt of the C-alpha atoms of structure files; lines is (file, text) of mmCIF ATOM lines: the columns are found by the
    file's own _atom_site header lines, which are joined by file (a row a name)."""
    head = lines.where(F.col("text").startswith("_atom_site.")).select("file", "line", F.regexp_extract("text", r"^_atom_site\.(\S+)", 1).alias("name"))
    order = head.groupBy("file").agg(F.transform(F.sort_array(F.collect_list(F.struct("line", "name"))), lambda x: x["name"]).alias("names"))
    atoms = lines.where(F.col("text").startswith("ATOM")).select("file", F.split(F.trim("text"), r"\s+").alias("v")).join(order, "file")
    cell = lambda name: F.get("v", F.array_position("names", name).cast("int") - 1)
    rows = atoms.where(cell("label_atom_id") == "CA").select("file", cell("label_seq_id").try_cast("int").alias("residue"), cell("B_iso_or_equiv").try_cast("double").alias("plddt"))
    return rows.where("residue IS NOT NULL AND plddt IS NOT NULL")


def locus_index(rows: DataFrame, contigs: dict[str, str]) -> DataFrame:
    """rs id -> locus of VCF rows: only rs ids, accessions mapped to chromosomes (others go), alleles split, the first allele of an id."""
    table = F.create_map(*[F.lit(x) for kv in contigs.items() for x in kv])
    chrom = F.coalesce(F.try_element_at(table, F.col("chrom")), X.norm_chrom(F.col("chrom")))
    named = rows.where("id LIKE 'rs%'").select("id", chrom.alias("chrom"), "pos", F.upper("ref").alias("ref"), F.posexplode(F.split("alt", ",")).alias("at", "alt"))
    known = named.where(F.col("chrom").isin(*map(str, range(1, 23)), "X", "Y", "MT"))
    first = known.groupBy(F.col("id").alias("rs_id")).agg(F.min(F.struct("chrom", "pos", "ref", "at", F.upper("alt").alias("alt"))).alias("l"))
    return first.select("rs_id", "l.chrom", "l.pos", "l.ref", "l.alt")


def site_frequencies(exomes: DataFrame, genomes: DataFrame) -> DataFrame:
    """variant_id, allele_freq of two sites VCFs: several alternate alleles go, the exomes' frequency before the genomes'."""

    def one(rows: DataFrame, rank: int) -> DataFrame:
        af = A.info_field(F.col("info"), "AF").try_cast("double")
        return rows.where(~F.col("alt").contains(",")).select(X.locus(X.norm_chrom(F.col("chrom")), F.col("pos"), F.upper("ref"), F.upper("alt")).alias("variant_id"), F.struct(F.lit(rank).alias("rank"), (-af).alias("af")).alias("f")).where("f.af IS NOT NULL")

    return one(exomes, 0).union(one(genomes, 1)).groupBy("variant_id").agg((-F.min("f")["af"]).alias("allele_freq"))


def rs_statistics(rows: DataFrame, p_limit: float = 5e-8) -> DataFrame:
    """Significant rows of summary statistics (rs_id, study, p, beta, replicated), a row an rs id."""
    return rows.where(F.col("p") < p_limit).groupBy("rs_id").agg(F.min("p").alias("min_p"), F.count_distinct("study").alias("n_studies"), F.max(F.abs("beta")).alias("max_abs_beta"), F.bool_or("replicated").alias("replicated"))


def aliased(frames: list[DataFrame], aliases: dict[str, list[str]]) -> DataFrame:
    """Tables with differing headers united by name: each column is the first of its aliases that a table has, else null."""

    def one(df: DataFrame) -> DataFrame:
        have = {c.lower().strip(): c for c in df.columns}
        pick = lambda names: next((F.col(f"`{have[n.lower()]}`") for n in names if n.lower() in have), F.lit(None).cast("string"))
        return df.select(*[pick([c, *names]).cast("string").alias(c) for c, names in aliases.items()])

    out = one(frames[0])
    for f in frames[1:]:
        out = out.unionByName(one(f))
    return out
