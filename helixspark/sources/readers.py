"""Readers of variant files and score tables: lazy DataFrames, no driver-side parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixspark.functions import expressions as X
from helixspark.operators.annotation import explode_alleles, info_field, reduced_scores

VCF_SCHEMA = "chrom string, pos int, id string, ref string, alt string, qual string, filter string, info string"
#: Canonical variant columns; a source that lacks some gets nulls.
CANONICAL = {
    "variant_id": "string", "source_db": "string", "chrom": "string", "pos": "int", "ref": "string", "alt": "string", "gene_symbol": "string", "consequence": "string",
    "clinical_sig": "string", "review_status": "string", "protein_change": "string", "allele_freq": "double", "last_evaluated": "timestamp",
}


def canonical(df: DataFrame) -> DataFrame:
    """Exactly the canonical columns, in order; missing ones are null, text that isn't of the type too."""
    return df.select(*[(F.col(c).try_cast(t) if c in df.columns else F.lit(None).cast(t)).alias(c) for c, t in CANONICAL.items()])


def vcf(spark: SparkSession, path: str) -> DataFrame:
    """A VCF (plain or gz); header lines go."""
    return spark.read.schema(VCF_SCHEMA).option("sep", "\t").option("comment", "#").option("quote", "").csv(path)


def vcf_frequencies(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """One row an alternate allele with the frequencies of the INFO fields; repeated loci keep the largest."""
    rows = vcf(spark, path).withColumns({f.lower(): info_field(F.col("info"), f) for f in fields})
    wide = explode_alleles(rows, [f.lower() for f in fields])
    keys = {"chrom": X.norm_chrom(F.col("chrom")), "ref": X.clean_allele(F.col("ref")), "alt": X.clean_allele(F.col("alt"))}
    return wide.withColumns(keys).where("ref IS NOT NULL AND alt IS NOT NULL").groupBy("chrom", "pos", "ref", "alt").agg(*[F.max(f.lower()).alias(f.lower()) for f in fields])


def splice_scores(spark: SparkSession, path: str, key: str = "SpliceAI", floor: float = 0.0) -> DataFrame:
    """The largest of the four deltas over all genes of an INFO field allele|gene|d1|d2|d3|d4|...; rows of several alleles or below the floor go."""
    rows = vcf(spark, path).where(~F.col("alt").contains(",")).withColumn("_r", F.split(info_field(F.col("info"), key), ","))
    deltas = F.transform("_r", lambda r: F.array_max(F.transform(F.slice(F.split(r, r"\|"), 3, 4), lambda d: d.try_cast("double"))))
    out = rows.select(X.norm_chrom(F.col("chrom")).alias("chrom"), "pos", F.upper("ref").alias("ref"), F.upper("alt").alias("alt"), F.array_max(deltas).alias("score"))
    return out.where(F.col("score") >= floor).groupBy("chrom", "pos", "ref", "alt").agg(F.max("score").alias("score"))


def rs_index(spark: SparkSession, path: str) -> DataFrame:
    """rs_id -> locus from a VCF; of several alternate alleles or lines the smallest locus stays."""
    rows = vcf(spark, path).where("id LIKE 'rs%'").withColumn("alt", F.explode(F.split("alt", ",")))
    return rows.groupBy(F.col("id").alias("rs_id")).agg(F.min(F.struct(X.norm_chrom(F.col("chrom")).alias("chrom"), "pos", F.upper("ref").alias("ref"), F.upper("alt").alias("alt"))).alias("l")).select("rs_id", "l.*")


def score_table(spark: SparkSession, path: str, columns: dict[str, str], lowest: set[str] = frozenset(), sep: str = "\t") -> DataFrame:
    """A delimited score table with a header -> chrom, pos, ref, alt and scores (new name -> header name).

    Several transcripts in one field (';') give the largest value, or the smallest of the names in `lowest`; SNVs only.
    """
    raw = spark.read.option("header", True).option("sep", sep).csv(path)
    find = {c.lstrip("#").lower(): c for c in raw.columns}
    at = lambda *names: next((F.col(f"`{find[n]}`") for n in names if n in find), F.lit(None).cast("string"))
    score = lambda n, h: reduced_scores(at(h.lower()))[0 if n in lowest else 1].alias(n)
    rows = raw.select(X.norm_chrom(at("chr", "chrom", "chromosome")).alias("chrom"), at("pos", "pos(1-based)", "position", "grch38_pos").try_cast("int").alias("pos"), F.upper(at("ref")).alias("ref"), F.upper(at("alt")).alias("alt"), *[score(n, h) for n, h in columns.items()])
    rows = rows.where("pos IS NOT NULL AND length(ref) = 1 AND length(alt) = 1")
    return rows.groupBy("chrom", "pos", "ref", "alt").agg(*[(F.min if n in lowest else F.max)(n).alias(n) for n in columns])


def gene_table(spark: SparkSession, path: str, gene: str, columns: dict[str, tuple[str, float, float, float]], sep: str = "\t") -> DataFrame:
    """A row a gene: each column is (header, default, least, most); text, NaN and infinities give the default; of several rows the largest."""
    raw = spark.read.option("header", True).option("sep", sep).option("comment", "#").csv(path)

    def safe(header: str, default: float, least: float, most: float):
        v = F.col(f"`{header}`").try_cast("double")
        bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
        return F.when(bad, F.lit(default)).otherwise(F.greatest(F.lit(least), F.least(F.lit(most), v)))

    return raw.groupBy(F.upper(F.trim(F.col(f"`{gene}`"))).alias("gene_symbol")).agg(*[F.max(safe(*spec)).alias(n) for n, spec in columns.items()])


def ingest(spark: SparkSession, parquet: list[str], csv: list[str]) -> DataFrame:
    """All given parquet and CSV inputs united by name in the canonical columns."""
    frames = [canonical(spark.read.option("recursiveFileLookup", True).parquet(p)) for p in parquet] + [canonical(spark.read.option("header", True).option("recursiveFileLookup", True).csv(p)) for p in csv]
    out = spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in CANONICAL.items())) if not frames else frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
