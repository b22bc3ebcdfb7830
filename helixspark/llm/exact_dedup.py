"""Operator 1, exact dedup: tree merge of digest runs (DataFrame functions only).

Every row goes to one of runs = fan_in ** rounds leaf runs by the hash of its id. A leaf run is sorted by digest, one entry a digest.
The runs are then exchanged in binomial rounds: in round r the runs whose numbers differ only in their last digits (base fan_in) go
to the one of them that heads the next level's subtree, which merges them as sorted streams (Spark's sort aggregate over the
exchange's sorted partitions) and keeps per digest the winning id, the row count and a verification. After the last round one run
holds every digest once. The verdicts go down the same tree: root to leaf runs on the digest, leaf runs to rows on (digest, run),
so a digest with a third of all rows is dealt over `runs` keys. A run is split over tasks by digest, so no task holds one whole.

Verified: each level compares an independent 64-bit hash and the length of all texts it merges; a SHA-256 collision stops the
job instead of removing a row.

Cases: null text counts as empty, so null and empty texts are equal to each other. Null ids never win against others (a group of
null ids only has a null winner, and its rows are kept). Rows that repeat both id and text are one document stored repeatedly:
they count in group_size and share its verdict. Extra columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixspark.llm.common import ascii_lower, checkpointed, lookup_join


def digests(docs: DataFrame, runs: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One small row for each document: id, digest of the normalised text, verification, leaf run."""
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    return (
        docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm"))
        .select(
            "doc_id",
            F.unhex(F.sha2("norm", 256)).alias("digest"),
            F.xxhash64("norm", F.octet_length("norm")).alias("proof"),
            F.pmod(F.xxhash64("doc_id"), F.lit(runs)).cast("int").alias("run"),
        )
    )


def _merged(rows: DataFrame, keep: str) -> DataFrame:
    """The runs of rows merged: an entry for each (run, digest). The winner is kept in a struct, so Spark merges sorted streams."""
    pick = F.max if keep == "largest" else F.min
    same = F.min("proof") == F.max("proof")
    merged = rows.groupBy("run", "digest").agg(
        pick(F.struct(F.col("keep_id").isNotNull() if keep == "largest" else F.col("keep_id").isNull(), "keep_id")).alias("best"),
        F.sum("rows").alias("rows"),
        F.when(same, F.min("proof")).otherwise(F.raise_error(F.lit("two texts share one SHA-256 digest")).cast("long")).alias("proof"),
    )
    return merged.select("run", "digest", F.col("best.keep_id").alias("keep_id"), "rows", "proof")


def exact_groups(docs: DataFrame, keep: str = "smallest", fan_in: int = 4, rounds: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs. keep: 'smallest' or 'largest' id of a group."""
    return _groups(docs, keep, fan_in, rounds, id_col, text_col).drop("proof")


def _groups(docs: DataFrame, keep: str, fan_in: int = 4, rounds: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = checkpointed(digests(docs, fan_in**rounds, id_col, text_col))
    leaf = level = _merged(rows.select("digest", "run", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("rows"), "proof"), keep)
    for _ in range(rounds):
        level = _merged(level.withColumn("run", F.floor(F.col("run") / fan_in).cast("int")), keep)
    root = level.select("digest", "keep_id", F.col("rows").alias("group_size"))
    down = leaf.select("digest", "run").join(root, "digest")
    return rows.join(down, ["digest", "run"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "proof",
    )


def drop_exact_copies(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows that repeat both id and text, one.

    Only members of groups of two or more are looked up (broadcast up to a checked count); all other rows stay where they are.
    """
    several = _groups(docs, keep, id_col=id_col, text_col=text_col).where("group_size > 1").groupBy("doc_id", "proof").agg(F.max("kept").alias("_kept"))
    key = [F.coalesce(F.col("doc_id"), F.lit(0)), F.col("doc_id").isNull(), F.col("proof")]
    lookup = several.select(*[k.alias(n) for k, n in zip(key, ("_id_key", "_none", "_proof"))], "_kept")
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    marked = docs.select("*", F.coalesce(F.col(id_col), F.lit(0)).alias("_id_key"), F.col(id_col).isNull().alias("_none"), F.xxhash64(norm, F.octet_length(norm)).alias("_proof"))
    found = lookup_join(marked, lookup, ["_id_key", "_none", "_proof"], "left", F.col("_proof")).where("coalesce(_kept, true)")
    grouped = F.col("_kept").isNotNull()
    first = F.row_number().over(Window.partitionBy("_id_key", "_none", "_proof").orderBy("_proof"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return found.where(~grouped).select(*columns).union(found.where(grouped).withColumn("_first", first).where("_first = 1").select(*columns))


ORACLE = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""
