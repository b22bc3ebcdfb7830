"""Registered runs of the jobs that write, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixspark.operators import evaluation as E
from helixspark.operators import runs as J
from helixspark.operators import variants as V
from helixspark.plans import joins, preparation, scores
from helixspark.plans.catalog import NORM
from helixspark.sources import fixtures as S
from helixspark.sources import tables as T


def etl_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the published variants."""
    return J.run_etl(S.variants(spark, sf_dir), T.shared_path(spark, "etl"))


def preparation_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split statistics of the published table."""
    rows = preparation.clean(spark, sf_dir)
    return J.run_preparation(rows, preparation.lookups(rows), T.shared_path(spark, "preparation"), clean=True)


def drift_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference statistics saved, read again and held against the newer half; with the labels' report, down to the exit severity."""
    path = T.shared_path(spark, "drift")
    old, new = scores._halves(spark, sf_dir)
    J.save_reference(old, scores._FEATURES, f"{path}/reference")
    shifted = new.withColumn("l_discount", F.col("l_discount") / 2)
    return J.run_drift(spark, f"{path}/reference", shifted, scores._FEATURES, scores._label_report(spark, sf_dir), path)[0]


_FEATURES = ["severity", "is_lof", "is_missense", "is_splice", "log_af", "af_absent", "len_diff"]


def batch_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers of the held-out genes' variants, from a pipeline that was fitted on the others, saved and loaded again."""
    rows = E.group_split(V.with_features(V.labelled(V.normalize(S.variants(spark, sf_dir)))), "gene_symbol", test=0.3, val=0.2)
    path = T.shared_path(spark, "pipeline")
    J.fit_pipeline(rows, _FEATURES, F.col("split") == "train", F.col("split") == "val", path)
    return J.score_batch(rows.where("split = 'test'"), path).groupBy("tier", "confidence").agg(F.count("*").alias("n"), F.sum("label").alias("n_pos"))


_ETL = joins._ORACLES["etl_variants"]
_QUERIES = (etl_run, preparation_run, drift_run, batch_scores)
_ORACLES = {
    "etl_run": f"SELECT source_db, pathogenicity, variant_type, count(*) AS n FROM ({_ETL}) GROUP BY 1, 2, 3",
    "preparation_run": f"""WITH {NORM}, k AS (SELECT *, ('0x' || substr(md5('42:' || gene_symbol), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM l WHERE label IS NOT NULL AND tier <= 3 AND NOT contains(clinical_sig, 'onflict'))
SELECT CASE WHEN u < 0.2 THEN 'test' WHEN u < 0.2::DOUBLE + 0.1::DOUBLE THEN 'val' ELSE 'train' END AS split, count(*) AS n, sum(label)::BIGINT AS n_pos, count(DISTINCT gene_symbol) AS n_genes FROM k GROUP BY 1""",
}


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict:
    return dict(_ORACLES)
