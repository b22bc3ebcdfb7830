"""The corpus pipeline: quality rules, exact dedup, MinHash near-dedup, mixing, BPE.

Each stage takes all that its predecessor kept and its decisions take effect; all but the last return the columns of documents.
The result has one row for each copy of a document that the mix places, in training order as written by the mixing stage, with
its token ids' digest. ORACLE_SQL is None: SQL can't reproduce the tokenizer; tests hold run() against a brute-force version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixspark.llm import bpe, exact_dedup, mixing, near_dedup, quality
from helixspark.llm.common import checkpointed
from helixspark.llm.registry import TOKENIZER, WEIGHTS


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = quality.drop_rejected(docs)  # texts without their lines over the limit
    return rows.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_copies(docs, keep="largest")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_copies(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.training_order(docs, WEIGHTS)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.token_digests(bpe.encode_documents(docs, public_tokenizers.path(TOKENIZER)))


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("mixing", mixing_stage), ("bpe", bpe_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = checkpointed(docs)
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
