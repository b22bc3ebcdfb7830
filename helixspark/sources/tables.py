"""Tables that are replaced safely, replaced in part, and indexed for joins without a shuffle."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_POINTER = "number long, version string, replaced string"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share; a session in one process may go without the setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """The rows, written once into a new shared folder and read from there: what passes over them many times does not make them again."""
    path = shared_path(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.parquet(path)


def versions(spark: SparkSession, path: str) -> DataFrame:
    """number, version and replaced (the version before) of every publication; no rows for a table that was never published."""
    try:
        return spark.read.schema(_POINTER).parquet(f"{path}/pointer")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _POINTER)


def _point(spark: SparkSession, path: str, version: str) -> None:
    last = versions(spark, path).agg(F.max(F.struct("number", "version")).alias("l")).first()["l"]
    row = (last["number"] + 1 if last else 1, version, last["version"] if last else None)
    spark.createDataFrame([row], _POINTER).coalesce(1).write.mode("append").parquet(f"{path}/pointer")


def publish(df: DataFrame, path: str, by: Sequence[str] = ()) -> str:
    """Replaces the table: a new version is written whole and only then a pointer to it is appended, as one file. A run that dies in
    between leaves the old version in place for all readers, those that are reading it included. One writer at a time."""
    version = uuid.uuid4().hex
    rows = df.hint("rebalance", *by) if by else df
    (rows.write.partitionBy(*by) if by else rows.write).mode("errorifexists").parquet(f"{path}/versions/{version}")
    _point(df.sparkSession, path, version)
    return version


def publish_parts(spark: SparkSession, parts: dict[str, DataFrame], path: str, by: str) -> str:
    """The same of a table whose parts, by the value of a column, are known apart: each is written by itself, so no rows are dealt or ordered."""
    version = uuid.uuid4().hex
    for value, part in parts.items():
        part.drop(by).write.mode("errorifexists").parquet(f"{path}/versions/{version}/{by}={value}")
    _point(spark, path, version)
    return version


def current(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The newest version of the table, or that of a publication."""
    found = versions(spark, path)
    row = (found if number is None else found.where(F.col("number") == number)).agg(F.max(F.struct("number", "version")).alias("l")).first()["l"]
    if row is None:
        raise ValueError(f"nothing was published at {path}" + ("" if number is None else f" as {number}"))
    return spark.read.parquet(f"{path}/versions/{row['version']}")


def patch(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame], by: Sequence[str] = ()) -> str:
    """Publishes the changed table; the version before stays as the backup."""
    return publish(change(current(spark, path)), path, by)


def roll_back(spark: SparkSession, path: str) -> None:
    """Points to the version before the newest publication again."""
    last = versions(spark, path).agg(F.max(F.struct("number", "replaced")).alias("l")).first()["l"]
    if last is None or last["replaced"] is None:
        raise ValueError(f"no version before the newest at {path}")
    _point(spark, path, last["replaced"])


def replace_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Overwrites the partitions that df has rows of; all others stay."""
    df.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def locus_index(df: DataFrame, name: str, buckets: int, keys: Sequence[str] = ("chrom", "pos", "ref", "alt")) -> DataFrame:
    """A table of the catalog, bucketed and sorted by its keys: joins on them deal the other side only, into as many buckets."""
    df.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    return df.sparkSession.table(name)
