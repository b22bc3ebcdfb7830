"""Registered queries that fit models or run stateful detectors; SQL can't express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixspark.operators import evaluation as E
from helixspark.operators import models as M
from helixspark.operators import variants as V
from helixspark.sources import fixtures as S
from helixspark.streaming import adwin

_FEATURES = ["af", "len_diff", "is_snv", "severity", "is_lof", "is_missense", "is_splice", "codon_phase"]


def calibrated_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores before and after Platt and isotonic calibration on a fifth of the rows that they were not fitted on."""
    rows = M.calibrated(E.folds(S.scored(spark, sf_dir), F.col("variant_id"), 5), F.col("fold") != 0).where("fold = 0")
    return E.compared_models(rows, ["score", "platt", "isotonic"])


def _split_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label, split and set of features once, with the number n of its variants: the fits pass over these instead of the variants."""
    rows = E.group_split(V.with_features(V.labelled(V.normalize(S.variants(spark, sf_dir)))), "gene_symbol")
    return rows.groupBy("label", "split", *_FEATURES).agg(F.count("*").alias("n"))


def classifier_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base models on the variants' features, fitted on train genes, compared on the others."""
    models = M.classifiers(len(_FEATURES))
    scored = M.scored_by(models, _split_features(spark, sf_dir), _FEATURES, F.col("split") == "train", "n")
    return E.compared_models(scored.where("split <> 'train'"), list(models), "n")


def tuned_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees over a grid, fitted on train genes, ranked on validation genes."""
    return M.grid_search(_split_features(spark, sf_dir), _FEATURES, F.col("split") == "train", F.col("split") == "val", weight="n")


def value_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adwin.detected(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", "ts", "value")


_QUERIES = (calibrated_models, classifier_comparison, tuned_models, value_drift)


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict:
    return {}
