"""Operators on variant tables: DataFrame -> DataFrame, built-in functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixspark.functions import expressions as X
from helixspark.operators.selection import running_sums


def normalize(df: DataFrame) -> DataFrame:
    """Canonical chromosome and alleles; rows without a usable locus go; `locus` is the key across sources.

    The projections are kept apart by what they compute, and the filter uses each allele once, so that no expression is inlined
    many times into one generated method (which the JVM then would not compile).
    """
    up = df.withColumns({c: F.upper(F.trim(c)) for c in ("chrom", "ref", "alt")})
    usable = "^(?!NA$|NAN$)[ACGTN*-]+$"
    out = up.where(F.col("chrom").isNotNull() & F.col("pos").isNotNull() & F.col("ref").rlike(usable) & F.col("alt").rlike(usable))
    out = out.withColumn("chrom", X.norm_chrom(F.col("chrom")))
    return out.withColumn("locus", X.locus(F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alt")))


def with_features(df: DataFrame) -> DataFrame:
    """Allele, consequence and frequency features of normalised variants; no nulls."""
    ref, alt, af, c = F.length("ref"), F.length("alt"), F.greatest(F.coalesce("allele_freq", F.lit(0.0)), F.lit(0.0)), F.coalesce("consequence", F.lit(""))
    flag = lambda pattern: c.rlike(pattern).cast("int")
    return df.withColumns({
        "af": af, "log_af": F.round(F.log10(af + 1e-8), 6), "af_absent": (af == 0).cast("int"), "af_ultra_rare": (af < 0.0001).cast("int"), "af_rare": ((af >= 0.0001) & (af < 0.001)).cast("int"), "af_common": (af >= 0.01).cast("int"),
        "ref_len": ref, "alt_len": alt, "len_diff": F.abs(ref - alt), "is_snv": ((ref == 1) & (alt == 1)).cast("int"), "is_insertion": (alt > ref).cast("int"), "is_deletion": (alt < ref).cast("int"), "is_indel": (alt != ref).cast("int"),
        "severity": X.severity(c), "is_lof": flag(X.LOSS_OF_FUNCTION), "is_missense": flag("(?i)missense"), "is_synonymous": flag("(?i)synonymous"), "is_splice": flag("(?i)splice"), "in_coding": flag(X.CODING),
        "codon_number": F.coalesce(X.codon_number(F.col("protein_change")), F.lit(0)), "codon_phase": X.codon_phase(F.col("protein_change")),
    })


def priority_dedup(df: DataFrame, key: str = "locus") -> DataFrame:
    """One row a key: the most trusted source, then the newest, then by all other columns, so that ties are settled alike on any cluster."""
    rest = [c for c in df.columns if c not in (key, "last_evaluated")]
    order = Window.partitionBy(key).orderBy(X.source_rank(F.col("source_db")), F.col("last_evaluated").desc_nulls_last(), *[F.col(c).asc_nulls_first() for c in rest])
    return df.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def labelled(df: DataFrame, max_tier: int = 5) -> DataFrame:
    out = df.withColumns({"label": X.binary_label(F.col("clinical_sig")), "tier": X.review_tier(F.col("review_status"))})
    return out.where(F.col("label").isNotNull() & (F.col("tier") <= max_tier))


def pathogenic_by_gene(df: DataFrame) -> DataFrame:
    return df.groupBy("gene_symbol").agg(F.sum("label").alias("n_pathogenic"), F.count("*").alias("n_labelled"))


def lookup_left(df: DataFrame, lookup: DataFrame, keys: list[str], defaults: dict[str, float]) -> DataFrame:
    """Left join to a lookup of one row a key; missing values get their default. The optimiser picks broadcast by size."""
    return df.join(lookup, keys, "left").withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def score_metrics(scored: DataFrame, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """AUROC (ties count half), Brier score and counts at 0.5 from a histogram of the distinct scores. With `weight`, a row stands for as many."""
    by = by or []
    total = (lambda c: F.sum(F.col(weight) * c)) if weight else F.sum
    hist = scored.groupBy(*by, "score").agg(total(F.col("label")).alias("p"), total(1 - F.col("label")).alias("n"), total(F.pow(F.col("score") - F.col("label"), F.lit(2))).alias("b"))
    ranked = running_sums(hist, "score", ["n"], by=by).withColumn("below", F.col("upto_n") - F.col("n"))
    high = F.col("score") >= 0.5
    agg = ranked.groupBy(*by).agg(
        F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"), F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)).alias("u"), F.sum("b").alias("b"),
        F.sum(F.when(high, F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(high, F.col("n")).otherwise(0)).alias("fp"),
    )
    return agg.select(*by, "n_pos", "n_neg", "tp", "fp", F.round(F.try_divide("u", F.col("n_pos") * F.col("n_neg")), 6).alias("auroc"), F.round(F.col("b") / (F.col("n_pos") + F.col("n_neg")), 6).alias("brier"))


def calibration_table(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Equal-width bins [lo, hi), the last one closed."""
    k = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    return scored.groupBy(k.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.avg("label"), 6).alias("positive_rate"))


def release_directions(old: DataFrame, new: DataFrame) -> DataFrame:
    """How many ids went from one class to another; appeared and removed ids have a null side."""
    both = old.withColumnRenamed("clinical_sig", "old_sig").join(new.withColumnRenamed("clinical_sig", "new_sig"), "variant_id", "full")
    return both.where("NOT (old_sig <=> new_sig)").groupBy("old_sig", "new_sig").agg(F.count("*").alias("n"))


def two_sample_distances(df: DataFrame, value: str, tag: str) -> DataFrame:
    """KS and Wasserstein-1 distance of a column between the rows with tag 0 and 1, from cumulative counts of its distinct values."""
    counts = df.groupBy(F.col(value).cast("double").alias("x")).agg(F.sum(1 - F.col(tag)).alias("a"), F.sum(tag).alias("b"))
    total = counts.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    cdf = running_sums(counts, "x", ["a", "b"]).withColumnsRenamed({"upto_a": "ca", "upto_b": "cb", "next_x": "next"}).crossJoin(F.broadcast(total))
    gap = F.abs(F.col("ca") / F.col("ta") - F.col("cb") / F.col("tb"))
    return cdf.agg(F.round(F.max(gap), 6).alias("ks"), F.round(F.sum(gap * (F.coalesce("next", "x") - F.col("x"))), 6).alias("wasserstein"))
