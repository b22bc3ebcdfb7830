"""Row and column filters, and labels of several vocabularies."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixspark.operators.selection import exact_percentiles

#: Terms of effect lists, classes and effect ids that mean pathogenic (1) or benign (0).
EFFECT_TERMS = {"functionprobablyaffected": 1, "functionaffected": 1, "functionnotaffected": 0}
EFFECT_IDS = {"99": 1, "1": 1, "11": 0, "10": 0}
BENIGN_TEXTS = ["benign", "likely benign", "probably not pathogenic", "not pathogenic", "class 1", "class 2"]
PATHOGENIC_TEXTS = ["pathogenic", "likely pathogenic", "definitely pathogenic", "probably pathogenic", "class 5", "class 4"]
#: Alleles that stand for none.
NO_ALLELE = ["na", ".", "N", "-", "nan"]


def canonical_class(sig: Column) -> Column:
    """One of five classes from a release's significance text; the order of the tests and their letters' case count."""
    benign = (sig.contains("Benign/Likely benign") | sig.contains("Benign")) & ~F.lower(sig).contains("pathogenic")
    return (
        F.when(sig.contains("Pathogenic"), "Pathogenic").when(sig.contains("Likely pathogenic"), "Likely pathogenic").when(benign, "Benign")
        .when(sig.contains("Likely benign"), "Likely benign").when(sig.contains("Uncertain") | sig.contains("VUS"), "Uncertain significance")
    )


def exact_label(sig: Column, pathogenic: list[str], benign: list[str]) -> Column:
    return F.when(sig.isin(*pathogenic), 1).when(sig.isin(*benign), 0)


def not_conflicting(df: DataFrame, column: str = "clinical_sig") -> DataFrame:
    """Rows whose significance doesn't speak of a conflict; null stays."""
    return df.where(~F.coalesce(F.col(column).contains("onflict"), F.lit(False)))


def chosen(df: DataFrame, **values: list) -> DataFrame:
    """Rows whose columns have one of the wanted values; an empty list asks for nothing."""
    for column, wanted in values.items():
        if wanted:
            df = df.where(F.col(column).isin(*wanted))
    return df


def valid_alleles(df: DataFrame, longest: int = 50) -> DataFrame:
    """Rows with two real alleles of at most `longest` bases."""
    good = lambda c: F.col(c).isNotNull() & ~F.col(c).isin(*NO_ALLELE) & (F.length(c) <= longest)
    return df.where(good("ref") & good("alt"))


def in_region(df: DataFrame, query: DataFrame, chrom: str = "chrom", pos: str = "pos") -> DataFrame:
    """Rows on one of the query's chromosomes and between its smallest and largest position (one bounding row is broadcast)."""
    box = query.agg(F.collect_set(chrom).alias("_chroms"), F.min(pos).alias("_lo"), F.max(pos).alias("_hi"))
    return df.crossJoin(F.broadcast(box)).where(F.array_contains("_chroms", F.col(chrom)) & F.col(pos).between(F.col("_lo"), F.col("_hi"))).drop("_chroms", "_lo", "_hi")


def scored_at_least(df: DataFrame, column: str, floor: float) -> DataFrame:
    return df.where(F.col(column) >= floor)


def dated(df: DataFrame, column: str, cutoff: str, after: bool = True) -> DataFrame:
    """Rows after the cutoff, or up to it; texts that are no date go."""
    at = F.col(column).try_cast("timestamp")
    return df.where(at > F.lit(cutoff).cast("timestamp") if after else at <= F.lit(cutoff).cast("timestamp"))


def date_column(df: DataFrame) -> str | None:
    """The first column whose name tells that it holds a date."""
    return next((c for c in df.columns if re.search("date|submitted|evaluated", c, re.I)), None)


def numeric_features(df: DataFrame, exclude: tuple[str, ...] = (), fill: float = -1.0) -> DataFrame:
    """The numeric columns but the excluded ones, as doubles, nulls filled."""
    kinds = ("int", "bigint", "smallint", "tinyint", "float", "double", "boolean")
    names = [c for c, t in df.dtypes if (t in kinds or t.startswith("decimal")) and c not in exclude]
    return df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(fill)).alias(c) for c in names])


def aligned(df: DataFrame, columns: list[str], fill: float = 0.0) -> DataFrame:
    """Exactly these columns in order; missing ones and nulls are the fill."""
    return df.select(*[(F.coalesce(F.col(c).cast("double"), F.lit(fill)) if c in df.columns else F.lit(fill)).alias(c) for c in columns])


def label_of_effects(terms: Column) -> Column:
    """The label of the first known term of a list."""
    table = F.create_map(*[F.lit(x) for kv in EFFECT_TERMS.items() for x in kv])
    return F.get(F.filter(F.transform(terms, lambda t: F.try_element_at(table, F.lower(F.trim(t)))), lambda v: v.isNotNull()), F.lit(0))


def label_of_class(text: Column) -> Column:
    """From a class text; benign and negated terms are tested before the pathogenic ones they contain."""
    low = F.lower(F.trim(text))
    any_of = lambda words: low.rlike("|".join(words))
    return F.when(any_of(BENIGN_TEXTS), 0).when(any_of(PATHOGENIC_TEXTS), 1)


def label_of_effect_id(value: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in EFFECT_IDS.items() for x in kv])
    return F.try_element_at(table, F.trim(value.cast("string")))


def capped(df: DataFrame, rows: int, key: Column) -> DataFrame:
    """A reproducible sample of about `rows` rows by the hash of a key; all rows of a smaller table."""
    n = df.agg(F.count("*")).first()[0]
    return df if n <= rows else df.where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(1_000_000 * rows / n))


def filled(df: DataFrame, numbers: dict[str, str], categories: list[str]) -> DataFrame:
    """Nulls of number columns by their 'mean' or 'median' (one row, broadcast), of categories by __missing__."""
    values: dict[str, float | None] = {}
    if means := [c for c, r in numbers.items() if r == "mean"]:
        values |= df.agg(*[F.avg(c).alias(c) for c in means]).first().asDict()
    if medians := [c for c, r in numbers.items() if r == "median"]:
        long = df.select(*[F.col(c).cast("double").alias(c) for c in medians]).unpivot([], medians, "column", "x")
        values |= {r["column"]: r["percentiles"][0] for r in exact_percentiles(long, "x", [0.5], ["column"]).collect()}  # a row a column
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(values.get(c))) for c in numbers} | {c: F.coalesce(c, F.lit("__missing__")) for c in categories})
