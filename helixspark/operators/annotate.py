"""Annotation joins and the feature table that follows them.

A lookup has one row a key (lookups are aggregated to that before they are joined), so a left join never multiplies rows. Join
sides are left to the optimiser, which broadcasts small lookups by their size and sorts large ones; adaptive execution splits skewed keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixspark.functions import expressions as X
from helixspark.functions import identifiers as I
from helixspark.operators import annotation as A
from helixspark.operators import evaluation as E
from helixspark.operators import variants as V

LOCUS = ["chrom", "pos", "ref", "alt"]
#: Default, least and most of each feature (None: no bound) and whether it is a whole number.
FEATURES = {
    "cadd_phred": (15.0, None, None, False), "sift_score": (0.5, None, None, False), "polyphen2_score": (0.5, None, None, False), "revel_score": (0.5, None, None, False),
    "phylop_score": (0.0, None, None, False), "gerp_score": (0.0, None, None, False), "alphamissense_score": (0.5, None, None, False), "splice_ai_score": (0.0, None, None, False), "eve_score": (0.5, None, None, False),
    "gene_constraint_oe": (1.0, None, None, False), "n_pathogenic_in_gene": (0, None, None, True), "has_uniprot_annotation": (0, None, None, True), "n_known_pathogenic_protein_variants": (0, None, None, True),
    "gtex_max_tpm": (0.0, None, None, False), "gtex_n_tissues_expressed": (0, None, None, True), "gtex_tissue_specificity": (0.0, None, None, False), "gtex_is_eqtl": (0, None, None, True),
    "gtex_min_eqtl_pval": (0.0, None, None, False), "gtex_max_abs_effect": (0.0, None, None, False), "dbsnp_af": (0.0, 0.0, None, False),
    "omim_n_diseases": (0, None, None, True), "omim_is_autosomal_dominant": (0, None, None, True), "clingen_validity_score": (0, None, None, True),
    "hgmd_is_disease_mutation": (0, None, None, True), "hgmd_n_reports": (0, None, None, True), "lovd_variant_class": (0, 0, 4, True), "gnn_score": (0.5, 0.0, 1.0, False),
    "maxentscan_score": (0.0, None, None, False), "dist_to_splice_site": (50, None, None, True), "exon_number": (0, None, None, True), "is_canonical_splice": (0, None, None, True),
    "alphafold_plddt": (50.0, 0.0, 100.0, False), "solvent_accessibility": (0.5, 0.0, 1.0, False), "secondary_structure_context": (0, 0, 2, True), "dist_to_active_site": (100.0, 0.0, None, False),
    "af_1kg_afr": (0.0, 0.0, None, False), "af_1kg_eur": (0.0, 0.0, None, False), "af_1kg_eas": (0.0, 0.0, None, False), "af_1kg_sas": (0.0, 0.0, None, False), "af_1kg_amr": (0.0, 0.0, None, False),
    "finngen_af_fin": (0.0, None, None, False), "finngen_af_nfsee": (0.0, None, None, False), "finngen_enrichment": (1.0, None, None, False), "esm2_delta_norm": (0.0, 0.0, None, False),
    "pli_score": (0.0, 0.0, 1.0, False), "loeuf": (1.0, 0.0, 5.0, False), "syn_z": (0.0, None, None, False), "mis_z": (0.0, None, None, False),
}


def one_row(lookup: DataFrame, keys: list[str], values: dict[str, str]) -> DataFrame:
    """A row a key: each value column by its rule, 'max', 'min', 'sum', 'any' (1 if any row has more than 0) or 'count'."""
    rules = {"max": F.max, "min": F.min, "sum": F.sum, "any": lambda c: F.max((F.coalesce(F.col(c), F.lit(0)) > 0).cast("int")), "count": lambda c: F.count("*")}
    return lookup.where(F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))).groupBy(*keys).agg(*[rules[r](c).alias(c) for c, r in values.items()])


def annotated(df: DataFrame, lookup: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Left join to a lookup of one row a key. A value that the row already has stays where the lookup lacks one: an absent source never
    overwrites."""
    side = lookup.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in values])
    out = df.join(side, keys, "left")
    return out.withColumns({c: F.coalesce(f"_new_{c}", c) if c in df.columns else F.col(f"_new_{c}") for c in values}).drop(*[f"_new_{c}" for c in values])


def filled_frequency(df: DataFrame, frequencies: DataFrame, id_col: str = "variant_id") -> DataFrame:
    """allele_freq of the rows without one, from a table (variant_id, allele_freq) whose ids hold the locus, with or without a source."""
    at = frequencies.select(I.parsed_id(F.col(id_col)).alias("_l"), "allele_freq").where("_l IS NOT NULL")
    at = at.select(X.norm_chrom(F.col("_l.chrom")).alias("chrom"), F.col("_l.pos").alias("pos"), F.upper("_l.ref").alias("ref"), F.upper("_l.alt").alias("alt"), F.col("allele_freq").alias("_af"))
    at = at.groupBy(*LOCUS).agg(F.max("_af").alias("_af"))
    return df.join(at, LOCUS, "left").withColumn("allele_freq", F.coalesce("allele_freq", "_af")).drop("_af")


def allowed(df: DataFrame, loci: DataFrame) -> DataFrame:
    """Rows whose locus is in the list."""
    return df.join(loci.select(*LOCUS).distinct(), LOCUS, "left_semi")


def _left(df: DataFrame, side: DataFrame, keys: list[str], probe: str, salts: int = 1024) -> DataFrame:
    """Left join on keys; rows whose key `probe` is null, which match nothing, are dealt over many tasks instead of one."""
    salt = F.when(F.col(probe).isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(salts))).otherwise(F.lit(0).cast("long"))
    zero = F.pmod(F.xxhash64(*keys), F.lit(1).cast("long"))  # a plain 0 would be taken out of the join's keys
    return df.withColumn("_salt", salt).join(side.withColumn("_salt", zero), [*keys, "_salt"], "left").drop("_salt")


def resolved(queries: DataFrame, index: DataFrame, features: DataFrame, rs_col: str = "rs_id") -> DataFrame:
    """rs ids (rs prefix optional, any case) -> locus -> features; `known` tells whether the index has it."""
    bare = F.regexp_replace(F.lower(F.trim(rs_col)), "^rs", "")
    named = queries.withColumn("_rs", F.when(bare.rlike("^[0-9]+$"), F.concat(F.lit("rs"), bare)))
    out = _left(named, index.select(F.lower("rs_id").alias("_rs"), *LOCUS), ["_rs"], "_rs").withColumn("known", F.col("pos").isNotNull())
    return _left(out, features, LOCUS, "pos").drop("_rs")


def with_gene_counts(df: DataFrame, train: Column | None = None) -> DataFrame:
    """n_pathogenic_in_gene joined back: over all rows, or over those where `train` holds (leak-free)."""
    rows = df if train is None else df.where(train)
    counts = rows.groupBy("gene_symbol").agg(F.coalesce(F.sum("label"), F.lit(0)).alias("n_pathogenic_in_gene"))
    return annotated(df, counts, ["gene_symbol"], ["n_pathogenic_in_gene"])


def residues(df: DataFrame, table: DataFrame, values: list[str]) -> DataFrame:
    """Left join on gene and residue number of the protein change."""
    return annotated(df.withColumn("residue", X.codon_number(F.col("protein_change"))), table, ["gene_symbol", "residue"], values)


def with_defaults(df: DataFrame) -> DataFrame:
    """All columns of FEATURES, missing ones and nulls by their default, within their bounds; then the flags that thresholds make."""

    def value(name: str) -> Column:
        default, least, most, whole = FEATURES[name]
        v = F.coalesce(F.col(name).cast("double"), F.lit(float(default))) if name in df.columns else F.lit(float(default))
        v = F.greatest(v, F.lit(float(least))) if least is not None else v
        v = F.least(v, F.lit(float(most))) if most is not None else v
        return v.cast("int") if whole else v

    out = df.withColumns({c: value(c) for c in FEATURES})
    flag = lambda c: c.cast("int")
    out = out.withColumns({
        "cadd_high": flag(F.col("cadd_phred") >= 20), "sift_deleterious": flag(F.col("sift_score") < 0.05), "polyphen_probably_damaging": flag(F.col("polyphen2_score") >= 0.908),
        "revel_pathogenic": flag(F.col("revel_score") >= 0.5), "gene_is_constrained": flag(F.col("gene_constraint_oe") < 0.35), "gene_has_known_disease": flag(F.col("n_pathogenic_in_gene") > 0),
        "is_autosome": flag(F.col("chrom").isin(*map(str, range(1, 23)))), "is_sex_chrom": flag(F.col("chrom").isin("X", "Y")), "is_mitochondrial": flag(F.col("chrom").isin("MT", "M")),
    })
    return out.withColumn("n_tools_pathogenic", F.expr("cadd_high + sift_deleterious + polyphen_probably_damaging + revel_pathogenic"))


def coverage(df: DataFrame, sources: dict[str, Column]) -> DataFrame:
    """source, n_matched, n_total, share: how many rows each source's condition holds for, in one pass."""
    one = df.agg(F.count("*").alias("n_total"), *[F.count_if(c).alias(n) for n, c in sources.items()])
    long = one.unpivot(["n_total"], list(sources), "source", "n_matched")
    return long.withColumn("share", F.round(F.coalesce(F.try_divide("n_matched", "n_total"), F.lit(0.0)), 6))


def etl(raw: DataFrame) -> DataFrame:
    """Normalised, classified and deduplicated variants (write them with sinks.partitioned)."""
    ref, alt = F.col("ref"), F.col("alt")
    rich = V.normalize(raw).withColumns({"pathogenicity": A.five_classes(F.col("clinical_sig")), "variant_type": A.variant_type(ref, alt), "af_bin": A.frequency_bin(F.col("allele_freq"))})
    return V.priority_dedup(rich)


def prepared(raw: DataFrame, lookups: list[tuple[DataFrame, list[str], list[str]]], frequencies: DataFrame | None = None, max_tier: int = 3, test: float = 0.2, val: float = 0.1) -> DataFrame:
    """Data preparation as one plan: labels and tiers, conflicting records out, gene counts, lookups (table, keys, values) in order, features,
    defaults and flags, and a split by gene."""
    return prepared_clean(V.normalize(raw), lookups, frequencies, max_tier, test, val)


def prepared_clean(clean: DataFrame, lookups: list[tuple[DataFrame, list[str], list[str]]], frequencies: DataFrame | None = None, max_tier: int = 3, test: float = 0.2, val: float = 0.1) -> DataFrame:
    """The same of variants that are normalised already."""
    rows = V.labelled(clean.where(~F.col("clinical_sig").contains("onflict")), max_tier)
    rows = with_gene_counts(rows)
    if frequencies is not None:
        rows = filled_frequency(rows, frequencies)
    for table, keys, values in lookups:
        rows = annotated(rows, table, keys, values)
    return E.group_split(with_defaults(V.with_features(rows)), "gene_symbol", test=test, val=val)
