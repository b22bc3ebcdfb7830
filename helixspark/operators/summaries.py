"""Aggregates, top rows, set operations and graph features over annotated variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixspark.operators.selection import exact_percentiles


def eqtl_by_locus(rows: DataFrame, key: list[str]) -> DataFrame:
    """gtex_is_eqtl, gtex_min_eqtl_pval (the largest -log10 p) and gtex_max_abs_effect a locus, from (p_value, beta) rows."""
    strength = F.coalesce(-F.log10(F.col("p_value") + 1e-300), F.lit(0.0))
    return rows.groupBy(*key).agg(F.max((strength > 0).cast("int")).alias("gtex_is_eqtl"), F.max(strength).alias("gtex_min_eqtl_pval"), F.max(F.abs(F.coalesce("beta", F.lit(0.0)))).alias("gtex_max_abs_effect"))


def expression_by_gene(rows: DataFrame) -> DataFrame:
    """Summary of (gene_symbol, tissue, tpm): max, mean, tissues of 1 TPM or more, specificity and the map from tissues to their largest TPM."""
    per = rows.groupBy("gene_symbol", "tissue").agg(F.max("tpm").alias("m"), F.sum("tpm").alias("s"), F.count("tpm").alias("n"), F.count_if(F.col("tpm") >= 1).alias("e"))
    g = per.groupBy("gene_symbol").agg(F.max("m").alias("max_tpm"), (F.sum("s") / F.sum("n")).alias("mean_tpm"), F.sum("e").alias("n_expressed"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("tissue", "m")))).alias("tissues"))
    return g.withColumn("specificity", F.when(F.col("max_tpm") > 0, 1 - F.col("mean_tpm") / F.col("max_tpm")).otherwise(0.0))


def overall(df: DataFrame, label: str, gene: str, source: str) -> DataFrame:
    """One row: variants, by class, distinct genes and sources."""
    c = F.col(label)
    return df.agg(F.count("*").alias("n_variants"), F.count_if(c == 1).alias("n_pathogenic"), F.count_if(c == 0).alias("n_benign"), F.count_if(c.isNull()).alias("n_unlabelled"), F.count_distinct(gene).alias("n_genes"), F.count_distinct(source).alias("n_sources"))


def mean_by(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Means of the columns a key (node features of a gene graph)."""
    return df.groupBy(key).agg(*[F.avg(c).alias(c) for c in columns])


def with_gene_scores(df: DataFrame, predictions: DataFrame, metadata: DataFrame, default: float = 0.5) -> DataFrame:
    """gnn_score: the mean prediction of the row's gene, from predictions and metadata that share variant ids; the default for other genes."""
    scores = predictions.join(metadata.select("variant_id", "gene_symbol"), "variant_id").groupBy("gene_symbol").agg(F.avg("score").alias("_score"))
    return df.join(scores, "gene_symbol", "left").withColumn("gnn_score", F.coalesce("_score", F.lit(default))).drop("_score")


def association_hits(hits: DataFrame, key: str = "variant_id", p_limit: float = 5e-8, traits: int = 5) -> DataFrame:
    """A row a variant from (study, trait, p_value, score, gene): hits, studies, traits, best p and score, top gene and the first traits by name."""
    rows = hits.where(F.col("p_value") <= p_limit)
    return rows.groupBy(key).agg(
        F.count("*").alias("n_hits"), F.count_distinct("study").alias("n_studies"), F.count_distinct("trait").alias("n_traits"), F.min("p_value").alias("min_p"), F.max(-F.log10(F.col("p_value") + 1e-300)).alias("max_neg_log10_p"),
        F.max("score").alias("max_score"), F.max_by("gene", F.struct("score", "gene")).alias("top_gene"), F.array_join(F.slice(F.array_sort(F.collect_set("trait")), 1, traits), ", ").alias("traits"))


def commonest(df: DataFrame, key: str, value: str) -> DataFrame:
    """n and the commonest value a key; of equal counts the first in order. Counts are aggregated before the choice."""
    counts = df.groupBy(key, value).agg(F.count("*").alias("_n"))
    return counts.groupBy(key).agg(F.sum("_n").alias("n"), F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(f"modal_{value}"))


def value_counts(df: DataFrame, by: list[str], flags: dict[str, Column]) -> DataFrame:
    """Rows and flag counts for each combination of values, nulls included."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), *[F.count_if(c).alias(n) for n, c in flags.items()])


def median_filled(df: DataFrame, column: str) -> DataFrame:
    """Nulls of the column by its exact median (one row, broadcast)."""
    found = exact_percentiles(df, column, [0.5]).first()
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(found["percentiles"][0] if found else None)))


def outcomes(df: DataFrame, status: str) -> DataFrame:
    """One row: how many rows of a batch succeeded, failed, and all."""
    return df.agg(F.count("*").alias("n_total"), F.count_if(F.col(status) == "ok").alias("n_ok"), F.count_if(~F.col(status).eqNullSafe("ok")).alias("n_failed"))


def first_by(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by an explicit order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_k = 1").drop("_k")


def best_by(df: DataFrame, key: list[str], score: str, rest: list[str]) -> DataFrame:
    """The row of the largest score of each key, by one aggregate (no sort of the groups)."""
    return df.groupBy(*key).agg(F.max(F.struct(score, *rest)).alias("_b")).select(*key, "_b.*")


def top(df: DataFrame, n: int, order: list[Column], columns: list[str] | None = None) -> DataFrame:
    """The first n rows by an order (each task keeps n, then one merges them)."""
    return (df.select(*columns) if columns else df).orderBy(*order).limit(n)


def sorted_by(df: DataFrame, key: str) -> DataFrame:
    """A global order by range partitions."""
    return df.repartitionByRange(key).sortWithinPartitions(key)


def all_sources(frames: list[DataFrame], key: str = "variant_id") -> DataFrame:
    """The union by name of all sources, one row an id; of several the first source in the list, then by all columns."""
    tagged = [f.withColumn("_source", F.lit(k)) for k, f in enumerate(frames)]
    out = tagged[0]
    for f in tagged[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    plain = [c for c, t in out.dtypes if c not in (key, "_source") and not t.startswith("map")]
    return first_by(out, [key], [F.col("_source"), *[F.col(c).asc_nulls_last() for c in plain]]).drop("_source")


def id_changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key and change ('new' or 'removed') of the ids that only one side has."""
    a, b = old.select(key), new.select(key)
    return b.subtract(a).withColumn("change", F.lit("new")).union(a.subtract(b).withColumn("change", F.lit("removed")))


def in_both(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def gene_edges(links: DataFrame, names: DataFrame, least: int = 700) -> DataFrame:
    """Undirected gene edges of interaction links (protein1, protein2, combined_score, channels...) over a threshold; a protein without a
    name keeps its id; scores become shares of 1000, the best of several."""
    name = lambda side: names.select(F.col("protein_id").alias(side), F.col("preferred_name").alias(f"_{side}"))
    rows = links.where(F.col("combined_score") >= least).join(name("protein1"), "protein1", "left").join(name("protein2"), "protein2", "left")
    a, b = F.coalesce("_protein1", "protein1"), F.coalesce("_protein2", "protein2")
    channels = [c for c in links.columns if c not in ("protein1", "protein2")]
    return rows.where(a != b).groupBy(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).agg(*[F.max(F.col(c) / 1000.0).alias(c) for c in channels])
