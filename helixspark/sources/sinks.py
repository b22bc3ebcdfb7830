"""Writers: partitioned tables, sorted indexes, cached tables, cohorts, patched tables, one-row reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def partitioned(df: DataFrame, path: str, by: str = "chrom", fmt: str = "parquet") -> None:
    """Overwrites a table with a folder a value; adaptive execution splits large values over several files."""
    df.hint("rebalance", by).write.mode("overwrite").partitionBy(by).format(fmt).save(path)


def sorted_index(df: DataFrame, path: str, key: str) -> None:
    """Range-partitioned and sorted, so that lookups by key skip files and row groups."""
    df.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def report(df: DataFrame, path: str) -> None:
    """A small report as JSON lines."""
    df.coalesce(1).write.mode("overwrite").json(path)


def split_bundle(df: DataFrame, path: str, split: str = "split") -> None:
    """A folder a split, so that a reader of one split scans only that."""
    partitioned(df, path, split)


def cached_table(spark: SparkSession, path: str, build: Callable[[], DataFrame], key: str) -> DataFrame:
    """The table at path; if it isn't there, it is built and written first, sorted by key."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    sorted_index(build(), path, key)
    return spark.read.parquet(path)


def cohort(rows: DataFrame, manifest: DataFrame, path: str) -> None:
    """A new cohort as Parquet and the manifest of its reclassified variants as CSV with a header."""
    rows.write.mode("overwrite").parquet(f"{path}/cohort")
    manifest.write.mode("overwrite").option("header", True).csv(f"{path}/manifest")


def patched(spark: SparkSession, path: str, patch: Callable[[DataFrame], DataFrame], out: str) -> None:
    """The patched table under a new path, which must not exist; the input stays as the backup and the caller swaps the two."""
    patch(spark.read.parquet(path)).write.mode("errorifexists").parquet(out)
