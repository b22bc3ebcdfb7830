"""Data preparation with all annotations: the lookups of one kind of key meet in one table before they meet the variants.

A lookup is a table with a key and values, of any number of rows a key. All lookups whose keys begin alike (locus and position;
protein change and residue; gene) are put end to end, dealt once by the coarse key and aggregated there, so a further source adds rows to one
exchange instead of an exchange of its own, and the variants are dealt once a kind of key.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixspark.functions import expressions as X
from helixspark.functions import identifiers as I
from helixspark.operators import annotate as N
from helixspark.operators import annotation as A
from helixspark.operators import evaluation as E
from helixspark.operators import variants as V
from helixspark.sources import tables as T

PLACE, ALLELES = ["chrom", "pos"], ["ref", "alt"]
RESIDUE, CHANGE = ["gene_symbol", "residue"], ["aa_change"]
GENE = ["gene_symbol"]
#: Frequencies of the five populations of the second frequency source; their mean is the last frequency before the default.
POPULATIONS = ["af_1kg_afr", "af_1kg_eur", "af_1kg_eas", "af_1kg_sas", "af_1kg_amr"]
#: A gene table of up to so many values (128 MB) is broadcast, so that the annotated variants are not dealt once more.
CELLS = 16_000_000


@dataclass(frozen=True)
class Lookup:
    """values: column and rule, 'max', 'min', 'sum', 'any' (1 if any row has more than 0) or 'count' (rows)."""

    table: DataFrame
    values: dict[str, str]

    def keyed_by(self, keys: list[str]) -> bool:
        return set(keys) <= set(self.table.columns)


def _entry(column: str, rule: str) -> Column:
    """What a row brings to its aggregate."""
    if rule == "any":
        return (F.coalesce(F.col(column), F.lit(0)) > 0).cast("int").alias(column)
    return (F.lit(1).cast("long") if rule == "count" else F.col(column)).alias(column)


_AGGREGATES = {"max": F.max, "min": F.min, "any": F.max, "sum": F.sum, "count": F.sum}


def brought_together(lookups: Iterable[Lookup], coarse: list[str], fine: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """One row a coarse key: its own values, and `_by` (a map from the fine key, as `_fine_key` makes it, to a struct of values). Rows without a coarse key go.

    The second result tells where each column is: 'coarse' or 'fine'. A lookup with all fine keys is a fine one.
    """
    parts, rules, where = [], {}, {}
    for one in lookups:
        at_fine = bool(fine) and one.keyed_by(fine)
        keys = [F.col(k) if k in coarse or at_fine else F.lit(None).cast("string").alias(k) for k in [*coarse, *fine]]
        parts.append(one.table.where(F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in [*coarse, *(fine if at_fine else [])]))).select(*keys, *[_entry(c, r) for c, r in one.values.items()]))
        if rules.keys() & one.values.keys():
            raise ValueError(f"two lookups give {sorted(rules.keys() & one.values.keys())}")
        rules |= one.values
        where |= {c: "fine" if at_fine else "coarse" for c in one.values}
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if not fine:
        return rows.groupBy(*coarse).agg(*[_AGGREGATES[r](c).alias(c) for c, r in rules.items()]), where
    # one exchange: both aggregates are by keys that begin with what the rows are dealt by
    exact = rows.repartition(*coarse).groupBy(*coarse, *fine).agg(*[_AGGREGATES[r](c).alias(c) for c, r in rules.items()])
    own = [c for c, w in where.items() if w == "coarse"]
    entry = F.struct(_fine_key(fine).alias("key"), F.struct(*[c for c, w in where.items() if w == "fine"]).alias("value"))
    entries = exact.select(*coarse, *own, F.when(F.col(fine[0]).isNotNull(), entry).alias("_entry"))  # made before the aggregate, which would do it value by value
    return entries.groupBy(*coarse).agg(*[F.max(c).alias(c) for c in own], F.map_from_entries(F.collect_list("_entry")).alias("_by")), where


def _fine_key(fine: list[str]) -> Column:
    """The fine key as one text, which maps find by its hash; null if a part of it is."""
    return F.concat(*[c for k in fine for c in (F.lit("\x1f"), F.col(k).cast("string"))])


def annotated_together(rows: DataFrame, lookups: Iterable[Lookup], coarse: list[str], fine: list[str] = (), cells: int = 0) -> DataFrame:
    """Left join of all lookups at once. A value that a row already has stays where the lookups have none. With `cells`, what the lookups
    come to is written once, and broadcast if it has no more values than that."""
    table, where = brought_together(lookups, coarse, list(fine))
    table = T.staged(table, "lookups") if cells else table
    side = table.select(*coarse, *[F.col(c).alias(f"_new_{c}") for c in table.columns if c not in coarse])
    joined = rows.join(F.broadcast(side) if cells and table.count() * len(table.columns) <= cells else side, coarse, "left")
    if fine:
        joined = joined.withColumn("_here", F.try_element_at("_new__by", _fine_key(fine)))
    found = {c: F.col(f"_new_{c}") if w == "coarse" else F.col(f"_here.{c}") for c, w in where.items()}
    return joined.withColumns({c: F.coalesce(v, F.col(c)) if c in rows.columns else v for c, v in found.items()}).select(*rows.columns, *[c for c in found if c not in rows.columns])


def prepared(raw: DataFrame, lookups: list[Lookup], max_tier: int = 3, test: float = 0.2, val: float = 0.1, seed: int = 42) -> DataFrame:
    """From raw variants to the split feature table: labels and tiers, conflicting records out, pathogenic counts by gene, all lookups,
    frequencies (own, then gnomad_af, then the mean of the populations), enrichment, features with defaults and bounds, flags, split by gene.

    Lookups are told apart by their key columns: (chrom, pos[, ref, alt]), (gene_symbol, residue[, aa_change]), (gene_symbol).
    """
    return prepared_clean(V.normalize(raw), lookups, max_tier, test, val, seed)


def prepared_clean(clean: DataFrame, lookups: list[Lookup], max_tier: int = 3, test: float = 0.2, val: float = 0.1, seed: int = 42) -> DataFrame:
    """The same of variants that are normalised already. The kinds of key come in the order of how little they add to the variants that
    are dealt next, and `locus` is made of its parts at the end."""
    rows = V.labelled(clean.drop("locus").where(~F.col("clinical_sig").contains("onflict")), max_tier)
    counts = rows.groupBy("gene_symbol").agg(F.coalesce(F.sum("label"), F.lit(0)).alias("n_pathogenic_in_gene"))
    at_place = [x for x in lookups if x.keyed_by(PLACE)]
    at_residue = [x for x in lookups if x.keyed_by(RESIDUE)]
    at_gene = [x for x in lookups if x.keyed_by(GENE) and x not in at_residue and x not in at_place]
    if at_residue:
        keyed = rows.withColumns({"residue": X.codon_number(F.col("protein_change")), "aa_change": A.protein_key(F.col("protein_change"))})
        rows = annotated_together(keyed, at_residue, RESIDUE, CHANGE).drop("residue", "aa_change")
    if at_place:
        rows = annotated_together(rows, at_place, PLACE, ALLELES)
    rows = annotated_together(rows, [*at_gene, Lookup(counts, {"n_pathogenic_in_gene": "max"})], GENE, cells=CELLS)
    rows = rows.withColumn("locus", X.locus(*[F.col(c) for c in (*PLACE, *ALLELES)]))
    tiers = [F.col("allele_freq"), *[F.col(c) for c in ("gnomad_af",) if c in rows.columns]]
    if set(POPULATIONS) <= set(rows.columns):
        tiers.append(reduce(lambda a, b: a + b, (F.col(c) for c in POPULATIONS)) / len(POPULATIONS))
    rows = rows.withColumn("allele_freq", F.coalesce(*tiers))
    if {"finngen_af_fin", "finngen_af_nfsee"} <= set(rows.columns):
        rows = rows.withColumn("finngen_enrichment", I.enrichment(F.col("finngen_af_fin"), F.col("finngen_af_nfsee")))
    return E.group_split(N.with_defaults(V.with_features(rows)), "gene_symbol", seed, test, val)


#: What is known of a variant beside its features.
META = ["locus", "chrom", "pos", "ref", "alt", "gene_symbol", "clinical_sig", "review_status", "source_db", "consequence", "protein_change", "last_evaluated"]


def feature_columns(table: DataFrame) -> list[str]:
    """The numeric columns that a model is fitted on."""
    return [f.name for f in table.schema if f.dataType.typeName() in ("integer", "long", "double") and f.name not in (*META, "label", "tier", "allele_freq", "gnomad_af")]


def scaling(table: DataFrame) -> dict:
    """What `scaled` takes of the training rows."""
    return E.fitted_moments(table, feature_columns(table), F.col("split") == "train")


def scaled(table: DataFrame, fitted: dict | None = None) -> DataFrame:
    """The features by the mean and population deviation of the training rows (`fitted`, if the table lacks some of them); null features of a
    source without a default stay null."""
    return E.standardised(table, feature_columns(table), F.col("split") == "train", fitted=fitted)


def scaled_moments(table: DataFrame) -> DataFrame:
    """split, feature, n, mean and deviation of the scaled features. They follow from those of the features, which are made once and written."""
    names = feature_columns(table)
    m = E.moments(T.staged(table.select("split", *names), "features"), names, ["split"])
    of_train = lambda c: F.max(F.when(F.col("split") == "train", F.col(c))).over(Window.partitionBy("column"))  # noqa: E731  # a row a split
    m = m.withColumns({"_m": of_train("mean"), "_d": of_train("deviation")}).withColumn("_d", F.when(F.col("_d") > 0, F.col("_d")).otherwise(1.0))
    known = F.col("_m").isNotNull()
    return m.select("split", F.col("column").alias("feature"), F.when(known, F.col("n")).otherwise(0).alias("n"), ((F.col("mean") - F.col("_m")) / F.col("_d")).alias("mean"), F.when(known, F.col("deviation") / F.col("_d")).alias("deviation"))
