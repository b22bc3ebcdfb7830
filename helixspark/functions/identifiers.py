"""Variant and locus identifiers of several sources, and safe numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from helixspark.functions.expressions import norm_chrom


def variant_id(source: Column, chrom: Column, pos: Column, ref: Column, alt: Column) -> Column:
    return F.concat_ws(":", source, chrom, pos.cast("string"), ref, alt)


def parsed_id(identifier: Column) -> Column:
    """source:chrom:pos:ref:alt as a struct; the source may be absent, all is null if there aren't four or five parts or pos is no number.

    The identifier stands in it once, as a lambda's argument: filters on the struct are pushed down with all that makes the identifier.
    """

    def fields(parts: Column) -> Column:
        n = F.size(parts)
        part = lambda k: F.get(parts, n - k)
        pos = part(3).try_cast("int")
        good = n.isin(4, 5) & pos.isNotNull()
        source = F.when(n == 5, F.get(parts, F.lit(0)))
        return F.when(good, F.struct(source.alias("source"), part(4).alias("chrom"), pos.alias("pos"), part(2).alias("ref"), part(1).alias("alt")))

    return F.get(F.transform(F.array(F.split(identifier, ":")), fields), F.lit(0))


def locus_key(identifier: Column) -> Column:
    """The identifier without what stands before its first colon; as it is without a colon."""
    return F.regexp_replace(identifier, "^[^:]*:", "")


def underscored(chrom: Column, pos: Column, ref: Column, alt: Column, suffix: str = "") -> Column:
    """chrom_pos_ref_alt, with a build suffix such as b38 and a chr prefix where a source wants them."""
    body = F.concat_ws("_", chrom, pos.cast("string"), ref, alt)
    return F.concat(F.lit("chr"), body, F.lit(f"_{suffix}")) if suffix else body


def from_separated(identifier: Column, sep: str = "_") -> Column:
    """chrom, pos, ref, alt of an identifier with another separator; a chr prefix and what follows the fourth part go."""
    parts = F.split(identifier, sep)
    pos = F.get(parts, F.lit(1)).try_cast("int")
    chrom = norm_chrom(F.get(parts, F.lit(0)))
    return F.when((F.size(parts) >= 4) & pos.isNotNull(), F.struct(chrom.alias("chrom"), pos.alias("pos"), F.upper(F.get(parts, F.lit(2))).alias("ref"), F.upper(F.get(parts, F.lit(3))).alias("alt")))


def genomic_change(hgvs: Column) -> Column:
    """g.123A>T as (pos, ref, alt); other changes have only their first position."""
    trimmed = F.trim(hgvs)
    full = r"(?i)g\.(\d+)([ACGT]+)>([ACGT]+)$"
    allele = lambda k: F.when(trimmed.rlike(full), F.upper(F.regexp_extract(trimmed, full, k)))
    return F.struct(F.regexp_extract(trimmed, r"g\.(\d+)", 1).try_cast("int").alias("pos"), allele(2).alias("ref"), allele(3).alias("alt"))


def safe_float(value: Column, default: float) -> Column:
    """The number a text holds; the default for anything else, NaN and infinities."""
    v = value.try_cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(default)).otherwise(v)


def safe_log10(value: Column, floor: float = 1e-10) -> Column:
    return F.log10(F.greatest(value, F.lit(floor)))


def enrichment(af: Column, background: Column) -> Column:
    """af / (background + 1e-9), at most 1000; what a source doesn't have counts as 0. Without a source the feature's default, 1.0, holds."""
    zero = F.lit(0.0)
    return F.least(F.lit(1000.0), F.coalesce(af, zero) / (F.coalesce(background, zero) + 1e-9))
