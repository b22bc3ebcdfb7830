"""Column expressions and session helpers that the operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: White space of the contracts: space and \x09-\x0D.
BLANKS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. A pure ASCII text takes the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, for checkpoints and written tables; only a session that runs in one process (tests) may go without the setting."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage by checkpoint() in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


_NULLABLE = {pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype(), pa.int16(): pd.Int16Dtype()}


def map_frames(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """mapInArrow over pandas frames whose integer columns are nullable: an id keeps all its digits in a batch that has a null one."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in run(b.to_pandas(types_mapper=_NULLABLE.get) for b in found):
            yield pa.RecordBatch.from_pandas(frame, schema=arrow, preserve_index=False, nthreads=1)

    return df.mapInArrow(batches, schema)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lookup_join(rows: DataFrame, lookup: DataFrame, keys: list[str], how: str, spread: Column, broadcast_rows: int = 100_000, salts: int = 16) -> DataFrame:
    """Joins many rows to a lookup that has one row a key.

    The lookup is checkpointed and counted. Up to broadcast_rows rows it is broadcast; beyond that each of its rows is
    repeated for `salts` salts and the join runs on (keys, salt), so that the rows of one hot key are dealt over as many
    tasks. spread: an expression over rows whose hash gives a row's salt.
    """
    lookup = checkpointed(lookup)
    if lookup.count() <= broadcast_rows:
        return rows.join(F.broadcast(lookup), keys, how)
    salted = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).join(salted, [*keys, "_salt"], how).drop("_salt")
