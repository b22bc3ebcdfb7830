"""Readers, sinks, the stateful detector and fitted models on small inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixspark.operators import models as M
from helixspark.operators.evaluation import running_sums
from helixspark.plans import learned
from helixspark.sources import readers as R
from helixspark.sources import sinks as K
from helixspark.streaming import adwin

SF = "/root/testdata/sf0.001"
VCF = "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\nchr1\t10\trs1\ta\tC,G\t.\t.\tAF=0.1,1.5;DB\nM\t20\trs2\tT\tC\t.\t.\tSpliceAI=C|G1|0.1|0.7|.|0.0|1|2|3|4,C|G2|0.9|0|0|0|1|1|1|1\n2\t5\t.\tA\tT\t.\t.\tAF=.\n"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_vcf_readers(spark, tmp_path):
    p = tmp_path / "a.vcf"
    p.write_text(VCF)
    assert sorted(map(str, rows(R.vcf_frequencies(spark, str(p), ["AF"])))) == ["('1', 10, 'A', 'C', 0.1)", "('1', 10, 'A', 'G', 1.0)", "('2', 5, 'A', 'T', None)", "('MT', 20, 'T', 'C', None)"]
    assert rows(R.splice_scores(spark, str(p), floor=0.5)) == [("MT", 20, "T", "C", 0.9)]
    assert rows(R.rs_index(spark, str(p))) == [("rs1", "1", 10, "A", "C"), ("rs2", "MT", 20, "T", "C")]


def test_tables(spark, tmp_path):
    (tmp_path / "s.tsv").write_text("#chr\tpos(1-based)\tref\talt\tSIFT\tREVEL\n1\t7\ta\tg\t0.4;.;0.1\t0.2;0.9\n1\t7\ta\tg\t.\t.\n1\tx\ta\tg\t1\t1\n1\t8\tac\tg\t1\t1\n")
    assert rows(R.score_table(spark, str(tmp_path / "s.tsv"), {"sift": "SIFT", "revel": "REVEL"}, {"sift"})) == [("1", 7, "A", "G", 0.1, 0.9)]
    (tmp_path / "g.tsv").write_text("gene\tpLI\nA\t0.5\nA\tNaN\nB\tinf\nc \t7\n")
    assert rows(R.gene_table(spark, str(tmp_path / "g.tsv"), "gene", {"pli": ("pLI", 0.0, 0.0, 1.0)})) == [("A", 0.5), ("B", 0.0), ("C", 1.0)]


def test_ingest_and_sinks(spark, tmp_path):
    (tmp_path / "c.csv").write_text("chrom,pos,extra\n1,5,z\n2,bad,z\n")
    one = R.ingest(spark, [], [str(tmp_path / "c.csv")])
    assert list(one.columns) == list(R.CANONICAL) and rows(one.select("chrom", F.coalesce("pos", F.lit(-1)))) == [("1", 5), ("2", -1)]
    K.partitioned(one, str(tmp_path / "out"))
    assert rows(R.ingest(spark, [str(tmp_path / "out")], []).select(F.coalesce("pos", F.lit(-1)))) == [(-1,), (5,)]
    K.sorted_index(one, str(tmp_path / "ix"), "chrom")
    K.report(one.agg(F.count("*").alias("n")), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first()["n"] == 2
    assert R.ingest(spark, [], []).count() == 0


def test_running_sums_cross_slices(spark):
    x = np.random.default_rng(1).permutation(1000)
    df = spark.createDataFrame([(float(v), int(v) % 7) for v in x], "x double, v long")
    got = {r["x"]: (r["upto_v"], r["next_x"]) for r in running_sums(df, "x", ["v"], slices=9).collect()}
    assert got == {float(k): (sum(j % 7 for j in range(k + 1)), float(k + 1) if k < 999 else None) for k in range(1000)}
    assert running_sums(df.limit(0), "x", ["v"]).count() == 0


def test_detector_finds_a_shift_in_batch_and_stream(spark, tmp_path):
    r = np.random.default_rng(3)
    data = [("a", i, float(v)) for i, v in enumerate(np.r_[r.normal(0, 0.1, 100), r.normal(5, 0.1, 100)])] + [("b", i, float(v)) for i, v in enumerate(r.normal(0, 0.1, 200))] + [(None, 0, 1.0), ("a", 500, None)]
    df = spark.createDataFrame(data, "k string, t long, v double")
    batch = rows(adwin.detected(df, "k", "t", "v"))
    assert batch and {k for k, _, _ in batch} == {"a"} and 100 <= batch[0][1] < 110
    df.write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    q = adwin.streamed(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "k", "t", "v").writeStream.format("memory").queryName("drifts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("drifts")) == batch


@pytest.mark.parametrize("name", list(learned.queries()))
def test_learned_queries_run(spark, name):
    got = learned.queries()[name](spark, SF).toPandas()
    if name == "calibrated_models":
        assert got.set_index("model").loc["isotonic", "brier"] <= got.set_index("model").loc["score", "brier"]
    if name == "classifier_comparison":
        assert set(got["model"]) == {"logistic", "forest", "boosted", "svm", "network"}
    if name == "tuned_models":
        assert len(got) == 4 and got["auroc"].is_monotonic_decreasing


def test_stack(spark):
    df = spark.range(300).select("id", (F.col("id") % 7 / 7.0).alias("x"), (F.col("id") % 7 > 3).cast("int").alias("label"))
    out = M.stacked(df, ["x"], F.col("id") < 200, F.col("id"), 2)
    assert out.count() == 300 and out.where("id >= 200 AND (stack >= 0.5) <> (label = 1)").count() == 0


def test_fits_make_their_rows_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def value(i):
        made.add(1)
        return i % 7 / 7.0

    df = spark.range(300).select("id", value("id").alias("x"), (F.col("id") % 7 > 3).cast("int").alias("label"))
    models = {k: m for k, m in M.classifiers(1).items() if k in ("logistic", "forest")}
    out = M.scored_by(models, df, ["x"], F.col("id") < 200)
    assert out.count() == 300 and out.where("(logistic >= 0.5) <> (label = 1)").isEmpty() and made.value == 300


def test_a_grid_is_scored_once(spark):
    df = spark.range(300).select("id", (F.col("id") % 7 / 7.0).alias("x"), (F.col("id") % 7 > 3).cast("int").alias("label"))
    out = M.grid_search(df, ["x"], F.col("id") < 200, F.col("id") >= 250, (1,), (1, 2))
    assert "UDF" not in out._jdf.queryExecution().optimizedPlan().toString() and {(r.n_pos + r.n_neg, r.auroc) for r in out.collect()} == {(50, 1.0)}


def test_rows_alike_are_fitted_once_with_their_number(spark):
    rows = spark.range(1200).select((F.col("id") % 7 / 7.0).alias("x"), (F.col("id") % 5).cast("double").alias("y"), F.lit(2.0).alias("same"), (F.col("id") % 7 + F.col("id") % 3 > 4).cast("int").alias("label"), (F.col("id") % 11 < 8).alias("fit"))
    few = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
    names, features = ["logistic"], ["x", "y", "same"]
    each, once = ({m: c for m, c in M.classifiers(3).items() if m in names} for _ in range(2))
    one = M.scored_by(each, rows, features, F.col("fit")).where("NOT fit")
    two = M.scored_by(once, few, features, F.col("fit"), "n").where("NOT fit")
    assert two.count() < few.count() < rows.count() and two.agg(F.sum("n")).first()[0] == one.count()
    of = lambda df, by: {r["model"]: r.asDict() for r in by(df).collect()}
    a, b = of(one, lambda d: M.E.compared_models(d, names)), of(two, lambda d: M.E.compared_models(d, names, "n"))
    for m in names:
        assert a[m]["n"] == b[m]["n"] and all(abs(a[m][c] - b[m][c]) < 1e-4 for c in ("brier", "log_loss", "accuracy")), (a[m], b[m])
    scores = lambda df, *w: df.select("label", *w, F.lit("m").alias("model"), F.round("x", 3).alias("score"))
    assert M.V.score_metrics(scores(one), ["model"]).collect() == M.V.score_metrics(scores(two, "n"), ["model"], "n").collect()


def test_pieces_keep_all_weight(spark):
    df = spark.createDataFrame([(1, 1), (2, 10), (3, 25)], "id int, n long")
    cut = M.pieces(df, "n", 6)  # 36 rows: at most 6 a piece
    assert {r.id: (r.s, r.c, r.m) for r in cut.groupBy("id").agg(F.sum("n").alias("s"), F.count("*").alias("c"), F.max("n").alias("m")).collect()} == {1: (1, 1, 1), 2: (10, 2, 6), 3: (25, 5, 6)}
    assert M.pieces(df, "n").count() == 36 and M._rows_of(cut.select("n", F.lit(0).alias("label"), F.lit(0).alias("features")), "n").count() == 36


def test_fits_pass_over_distinct_rows(spark):
    few = learned._split_features(spark, SF)
    assert few.count() < 0.95 * few.agg(F.sum("n")).first()[0]
