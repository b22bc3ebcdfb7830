"""Whole jobs over variant tables, each one plan of the library's operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixspark.operators import annotate as N
from helixspark.operators import variants as V


def vcf_features(rows: DataFrame, frequencies: DataFrame | None = None, labels: DataFrame | None = None) -> DataFrame:
    """VCF rows with exome_af and sig_numeric by locus (null where unknown) and the features of that path.

    A locus that a side table has several times gets its largest value, so rows are never multiplied.
    """
    out = rows
    for side, value in ((frequencies, "exome_af"), (labels, "sig_numeric")):
        if side is not None:
            out = N.annotated(out, N.one_row(side, N.LOCUS, {value: "max"}), N.LOCUS, [value])
        elif value not in out.columns:
            out = out.withColumn(value, F.lit(None).cast("double"))
    one = (F.length("ref") == 1) & (F.length("alt") == 1)
    return out.withColumns({
        "is_snv": F.when(one, 1).otherwise(0), "is_indel": F.when(~one, 1).otherwise(0),
        "log10_af": F.when(F.col("exome_af") > 0, F.log10("exome_af")).otherwise(F.lit(-8.0)),
    })


def feature_matrix(rows: DataFrame, frequencies: DataFrame, labels: DataFrame, genes: DataFrame, gene_values: list[str]) -> DataFrame:
    """Frequencies by locus (0 where unknown), labels by rs id (null where unknown), summaries by gene (0 where unknown)."""
    out = N.annotated(rows, N.one_row(frequencies, N.LOCUS, {"allele_freq": "max"}), N.LOCUS, ["allele_freq"])
    out = N.annotated(out, N.one_row(labels, ["id"], {"label": "max"}), ["id"], ["label"])
    out = N.annotated(out, N.one_row(genes, ["gene_symbol"], {v: "max" for v in gene_values}), ["gene_symbol"], gene_values)
    return out.fillna(0.0, subset=["allele_freq", *gene_values])


def temporal_validation(scored: DataFrame, seen: DataFrame, recent: Column, key: str = "variant_id") -> DataFrame:
    """Score metrics on the rows where `recent` holds and whose key the training release has not seen."""
    return V.score_metrics(scored.where(recent).join(seen.select(key).distinct(), key, "left_anti"))
