"""Whole jobs, sinks, base models and the search grid on small inputs."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from helixspark.operators import evaluation as E
from helixspark.operators import jobs as J
from helixspark.operators import models as M
from helixspark.sources import sinks as K

LOCI = "chrom string, pos int, ref string, alt string"


def rows(df):
    return sorted(map(str, map(tuple, df.collect())))


def test_vcf_features_never_multiply_rows(spark):
    v = spark.createDataFrame([("1", 5, "A", "G"), ("1", 6, "A", "GT"), (None, None, "A", "G")], LOCI)
    af = spark.createDataFrame([("1", 5, "A", "G", 0.01), ("1", 5, "A", "G", 0.1), ("1", 6, "A", "GT", 0.0)], LOCI + ", exome_af double")
    got = J.vcf_features(v, af).select("pos", "is_snv", "is_indel", "log10_af", "sig_numeric")
    assert rows(got) == ["(5, 1, 0, -1.0, None)", "(6, 0, 1, -8.0, None)", "(None, 1, 0, -8.0, None)"]
    assert J.vcf_features(v.limit(0)).count() == 0


def test_feature_matrix_keeps_rows_without_sources(spark):
    v = spark.createDataFrame([("1", 5, "A", "G", "rs1", "G1"), ("1", 6, "A", "G", None, None)], LOCI + ", id string, gene_symbol string")
    af = spark.createDataFrame([("1", 5, "A", "G", 0.2)], LOCI + ", allele_freq double")
    labels = spark.createDataFrame([("rs1", 0), ("rs1", 1), (None, 1)], "id string, label int")
    genes = spark.createDataFrame([("G1", 0.9)], "gene_symbol string, pli double")
    assert rows(J.feature_matrix(v, af, labels, genes, ["pli"]).select("pos", "allele_freq", "label", "pli")) == ["(5, 0.2, 1, 0.9)", "(6, 0.0, None, 0.0)"]


def test_conformal_intervals(spark):
    df = spark.createDataFrame([(1, 0.5, 1), (2, 0.9, 1), (3, 0.1, 0), (4, 0.95, 0)], "id long, score double, label int")
    got = {r["id"]: (round(r["lower"], 6), round(r["upper"], 6), r["covered"]) for r in E.conformal_intervals(df, F.col("id") < 3).collect()}
    assert got == {3: (0.0, 0.6, True), 4: (0.45, 1.0, False)}
    assert E.conformal_intervals(df, F.lit(False)).where("covered IS NULL").count() == 4


def test_sinks(spark, tmp_path):
    df = spark.range(6).select("id", F.when(F.col("id") < 4, "train").otherwise("test").alias("split"))
    K.split_bundle(df, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s" / "split=test")).count() == 2
    built = []

    def build():
        built.append(1)
        return df

    for _ in range(2):
        assert K.cached_table(spark, str(tmp_path / "c"), build, "id").count() == 6
    assert built == [1]
    K.cohort(df, df.where("id = 5"), str(tmp_path / "k"))
    assert spark.read.option("header", True).csv(str(tmp_path / "k" / "manifest")).first()["id"] == "5"
    K.patched(spark, str(tmp_path / "c"), lambda d: d.withColumn("id", F.col("id") + 1), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).agg(F.max("id")).first()[0] == 6 and spark.read.parquet(str(tmp_path / "c")).agg(F.max("id")).first()[0] == 5
    with pytest.raises(AnalysisException):
        K.patched(spark, str(tmp_path / "c"), lambda d: d, str(tmp_path / "p"))


def test_base_models_and_grid(spark):
    df = spark.range(400).select("id", (F.col("id") % 10).cast("double").alias("x"), F.lit(1.0).alias("same"), (F.col("id") % 10 > 5).cast("int").alias("label"))
    fit = F.col("id") < 300
    scored = M.scored_by(M.classifiers(2), df, ["x", "same"], fit).where(~fit)
    for name in M.classifiers(2):
        assert scored.where((F.col(name) >= 0.5) != (F.col("label") == 1)).count() == 0, name
        assert scored.where((F.col(name) < 0) | (F.col(name) > 1)).count() == 0
    grid = M.grid_search(df, ["x", "same"], fit, ~fit, depths=(2,), rounds=(2, 4)).collect()
    assert [g["model"] for g in grid] == ["depth2_rounds2_step0.1", "depth2_rounds4_step0.1"] and grid[0]["auroc"] == 1.0
