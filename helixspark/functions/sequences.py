"""Scores and features of nucleotide and protein sequences, as native expressions."""

from __future__ import annotations

import math
from functools import reduce
from itertools import product
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Base frequencies of a splice donor's nine positions (-3 to +6), and of the background.
DONOR = [
    {"A": 0.29, "C": 0.35, "G": 0.20, "T": 0.16}, {"A": 0.35, "C": 0.18, "G": 0.25, "T": 0.22}, {"A": 0.34, "C": 0.14, "G": 0.37, "T": 0.15},
    {"A": 0.003, "C": 0.002, "G": 0.990, "T": 0.005}, {"A": 0.003, "C": 0.002, "G": 0.005, "T": 0.990}, {"A": 0.76, "C": 0.07, "G": 0.09, "T": 0.08},
    {"A": 0.54, "C": 0.09, "G": 0.15, "T": 0.22}, {"A": 0.28, "C": 0.18, "G": 0.27, "T": 0.27}, {"A": 0.27, "C": 0.19, "G": 0.28, "T": 0.26},
]
BACKGROUND = {"A": 0.27, "C": 0.23, "G": 0.23, "T": 0.27}
#: Default distance to a splice site, and the length of a sequence window.
FAR, WINDOW = 50, 101
BASES = "ACGT"


def donor_score(seq: Column) -> Column:
    """Log-odds of a 9-mer (3 exonic and 6 intronic bases); 0 if it isn't nine of ACGT."""
    s = F.upper(seq)
    number = F.conv(F.translate(F.substring(s, 1, 9), BASES, "0123"), 4, 10).cast("int")  # the 9-mer in base 4
    parts = [F.array(*[F.lit(sum(math.log2(row[b] / BACKGROUND[b]) for row, b in zip(DONOR[k:], word))) for word in product(BASES, repeat=3)]) for k in (0, 3, 6)]
    total = reduce(add, [F.get(p, F.shiftright(number, shift).bitwiseAND(63)) for p, shift in zip(parts, (12, 6, 0))])
    return F.when((F.length(s) == 9) & (F.btrim(s, F.lit(BASES)) == ""), F.round(total, 4)).otherwise(0.0)


def acceptor_score(seq: Column) -> Column:
    """Score of a 23-mer: +0.3 a pyrimidine and -0.1 a purine in the first 18 bases, the AG at places 21 and 22; 0 at any other length."""
    s = F.upper(seq)
    tract = F.substring(s, 1, 18)
    count = lambda letters: F.length(tract) - F.length(F.translate(tract, letters, ""))
    tract_score = 0.3 * count("CT") - 0.1 * count("AG")
    first, second = F.substring(s, 21, 1) == "A", F.substring(s, 22, 1) == "G"
    signal = F.when(first & second, 5.0).when(first | second, 0.5).otherwise(-3.0)
    return F.when(F.length(s) == 23, F.round(tract_score + signal, 4)).otherwise(0.0)


def splice_score(seq: Column) -> Column:
    """The donor's 9-mer around the middle of a sequence; where that doesn't fit, the acceptor's 23-mer; else 0."""
    n = F.length(seq)
    middle = F.floor(n / 2).cast("int")
    cut = lambda lo, hi: F.substr(seq, middle - lo + 1, F.lit(lo + hi))
    return F.when((middle >= 3) & (middle + 6 <= n), donor_score(cut(3, 6))).when((middle >= 20) & (middle + 3 <= n), acceptor_score(cut(20, 3))).otherwise(0.0)


def splice_relevant(is_splice: Column, severity: Column) -> Column:
    return (F.coalesce(is_splice, F.lit(0)) == 1) | (F.coalesce(severity, F.lit(0)) >= 7)


def splice_distance(donor: Column, acceptor: Column) -> Column:
    """The smaller distance to either splice site; an unknown one counts as far."""
    return F.least(F.coalesce(F.abs(donor), F.lit(FAR)), F.coalesce(F.abs(acceptor), F.lit(FAR))).cast("int")


def canonical_splice(donor: Column, acceptor: Column) -> Column:
    near = lambda d: F.coalesce(F.abs(d).isin(1, 2), F.lit(False))
    return (near(donor) | near(acceptor)).cast("int")


def exon_number(text: Column) -> Column:
    """3 of '3/12' or '3'; 0 for anything else."""
    return F.coalesce(F.regexp_extract(F.trim(text), r"^(\d+)(?:/\d+.*)?$", 1).try_cast("int"), F.lit(0))


def solvent_accessibility(plddt: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - plddt / 100 * 0.6))


def one_hot(seq: Column, width: int = WINDOW) -> Column:
    """`width` arrays of four bits (A, C, G, T; other letters none set): the sequence cut to the width, or filled up with A."""
    letters = F.split(F.rpad(F.substring(F.upper(F.coalesce(seq, F.lit(""))), 1, width), width, "A"), "")
    bits = F.array(*[F.array(*[F.lit(int(b == letter)) for b in BASES]) for letter in " " + BASES])
    return F.transform(F.slice(letters, 1, width), lambda x: F.get(bits, F.position(x, F.lit(BASES))))


def residue_window(protein: Column, position: Column, half: int) -> Column:
    """The residues around a 1-based position."""
    start = F.greatest(F.lit(1), position - half)
    return F.when((position >= 1) & (position <= F.length(protein)), F.substr(protein, start, position + half - start + 1))


def mutated_window(protein: Column, position: Column, residue: Column, half: int) -> Column:
    """The same window with another residue at the position."""
    return residue_window(F.overlay(protein, residue, position), position, half)


def member_statistics(scores: Column) -> Column:
    """Of an array of member scores: mean, epistemic (population variance), aleatoric (mean binary entropy, nats), total and triage level."""
    n = F.size(scores)
    mean = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / n
    var = F.aggregate(scores, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n

    def entropy(x: Column) -> Column:
        p = F.greatest(F.lit(1e-8), F.least(F.lit(1 - 1e-8), x))
        return -(p * F.log(p) + (1 - p) * F.log(1 - p))

    noise = F.aggregate(scores, F.lit(0.0), lambda a, x: a + entropy(x)) / n
    total = var + noise
    return F.struct(mean.alias("mean"), var.alias("epistemic"), noise.alias("aleatoric"), total.alias("total"), F.when(total > 0.05, "high").when(total > 0.02, "medium").otherwise("low").alias("triage"))
