"""Scalar expressions over variant columns, all built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Severity of consequence terms.
SEVERITY = {
    "transcript_ablation": 10, "splice_acceptor_variant": 9, "splice_donor_variant": 9, "stop_gained": 9, "frameshift_variant": 8, "stop_lost": 8, "start_lost": 8,
    "transcript_amplification": 7, "inframe_insertion": 6, "inframe_deletion": 6, "missense_variant": 5, "protein_altering_variant": 5, "splice_region_variant": 4,
    "incomplete_terminal_codon_variant": 3, "start_retained_variant": 3, "stop_retained_variant": 3, "synonymous_variant": 2, "coding_sequence_variant": 2,
    "5_prime_UTR_variant": 2, "3_prime_UTR_variant": 2, "non_coding_transcript_exon_variant": 1, "intron_variant": 1, "NMD_transcript_variant": 1,
    "upstream_gene_variant": 0, "downstream_gene_variant": 0, "intergenic_variant": 0,
}
#: Review tier of the first of these that the status contains; 5 without any.
REVIEW_TIERS = [
    ("practice guideline", 1), ("reviewed by expert panel", 1), ("criteria provided, multiple submitters, no conflicts", 2),
    ("criteria provided, single submitter", 3), ("no assertion criteria provided", 4), ("no classification", 5),
]
#: Order in which sources are trusted; all others come after.
SOURCE_PRIORITY = ["clinvar", "gnomad", "uniprot"]
#: Consequence patterns.
LOSS_OF_FUNCTION = "(?i)stop_gained|frameshift|splice_donor|splice_acceptor|start_lost|stop_lost"
CODING = "(?i)missense|synonymous|stop|frameshift|inframe|splice"


def norm_chrom(c: Column) -> Column:
    """Trimmed, without a leading chr, M as MT, letters upper. A prefix test, no pattern: `c` stands in it few times."""
    up = F.upper(F.trim(c))
    bare = F.when(up.startswith("CHR"), F.substring(up, 4, 1 << 20)).otherwise(up)
    return F.when(up.isin("M", "CHRM"), "MT").otherwise(bare)


def clean_allele(a: Column) -> Column:
    """Upper case; placeholders (na, nan, '.', empty) are null."""
    up = F.upper(F.trim(a))
    return F.when(~up.isin("NA", "NAN", ".", ""), up)


def locus(chrom: Column, pos: Column, ref: Column, alt: Column) -> Column:
    return F.concat_ws(":", chrom, pos.cast("string"), ref, alt)


def binary_label(sig: Column) -> Column:
    """1 for (likely) pathogenic, 0 for (likely) benign, else null."""
    return F.when(sig.isin("Pathogenic", "Likely pathogenic", "Pathogenic/Likely pathogenic"), 1).when(sig.isin("Benign", "Likely benign", "Benign/Likely benign"), 0)


def review_tier(status: Column) -> Column:
    low = F.lower(status)
    out = F
    for text, tier in REVIEW_TIERS:
        out = out.when(low.contains(text), tier)
    return out.otherwise(5)


def severity(consequence: Column) -> Column:
    """The largest severity of the &-joined terms; unknown ones are 0."""
    table = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    return F.array_max(F.transform(F.split(consequence, "&"), lambda t: F.coalesce(table[t], F.lit(0))))


def codon_number(protein: Column) -> Column:
    return F.regexp_extract(protein, r"p\.[A-Za-z]{3}(\d+)", 1).try_cast("int")


def codon_phase(protein: Column) -> Column:
    return F.coalesce((codon_number(protein) - 1) % 3 + 1, F.lit(0))


def source_rank(source: Column) -> Column:
    rank = F.lit(len(SOURCE_PRIORITY))
    for k, s in reversed(list(enumerate(SOURCE_PRIORITY))):
        rank = F.when(source == s, k).otherwise(rank)
    return rank
