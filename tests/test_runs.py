"""Published tables, indexes and the jobs that write."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from helixspark.operators import runs as J
from helixspark.plans import runs as P
from helixspark.plans import scores
from helixspark.sources import tables as T

SF = "/root/testdata/sf0.001"


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_a_run_that_dies_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(ValueError):
        T.current(spark, path)
    T.publish(spark.range(10).withColumn("part", F.col("id") % 2), path, ["part"])
    before = T.current(spark, path)
    dying = spark.range(100).select(F.when(F.col("id") < 90, F.col("id")).otherwise(F.raise_error(F.lit("dies midway")).cast("long")).alias("id"), F.lit(0).alias("part"))
    with pytest.raises(PySparkException):
        T.publish(dying, path, ["part"])
    assert ids(T.current(spark, path)) == list(range(10)) and T.versions(spark, path).count() == 1
    T.patch(spark, path, lambda d: d.where("id > 3"), ["part"])
    assert ids(T.current(spark, path)) == [4, 5, 6, 7, 8, 9] and ids(before) == list(range(10)) == ids(T.current(spark, path, 1))
    T.roll_back(spark, path)
    assert ids(T.current(spark, path)) == list(range(10)) and [r.number for r in T.versions(spark, path).orderBy("number").collect()] == [1, 2, 3]


def test_partitions_are_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "p")
    T.replace_partitions(spark.range(6).withColumn("k", F.col("id") % 3), path, ["k"])
    T.replace_partitions(spark.createDataFrame([(100, 1)], "id long, k long"), path, ["k"])
    assert ids(spark.read.parquet(path)) == [0, 2, 3, 5, 100]


def test_joins_with_an_index_deal_one_side(spark):
    loci = spark.range(200).select((F.col("id") % 5).cast("string").alias("chrom"), F.col("id").cast("int").alias("pos"), F.when(F.col("id") % 2 == 0, "A").otherwise("C").alias("ref"), F.when(F.col("id") % 3 == 0, "T").otherwise("G").alias("alt"), F.col("id").alias("score"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        index = T.locus_index(loci, "locus_index_test", 4)
        joined = loci.drop("score").where("pos < 50").join(index, ["chrom", "pos", "ref", "alt"])
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan and joined.count() == 50
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS locus_index_test")


def test_drift_run_reads_the_new_rows_once(spark, tmp_path):
    old, new = scores._halves(spark, SF)
    path = str(tmp_path / "d")
    J.save_reference(old, scores._FEATURES, f"{path}/reference")
    labels = spark.createDataFrame([("none",)], "urgency string")
    same, seen = J.run_drift(spark, f"{path}/reference", old, scores._FEATURES, labels, f"{path}/same")
    assert same.first().action == "none" and same.first().severity == 0 and seen["n"] == old.count()
    shifted = new.withColumn("l_discount", F.col("l_discount") / 2)
    counted = J.new_counts(T.current(spark, f"{path}/reference"), shifted, scores._FEATURES)
    assert counted._jdf.queryExecution().executedPlan().toString().count("lineitem") <= 1
    out, _ = J.run_drift(spark, f"{path}/reference", shifted.drop("l_discount"), scores._FEATURES, labels, f"{path}/new")
    report = {r.feature: r.action for r in T.current(spark, f"{path}/new/features").collect()}
    assert report["l_discount"] == "retrain" and out.first().severity >= 2 and out.first().should_retrain
    assert P.drift_run(spark, SF).count() == 1


def test_preparation_needs_both_classes(spark, tmp_path):
    raw = P.S.variants(spark, SF).where("clinical_sig = 'Pathogenic'")
    with pytest.raises(ValueError):
        J.run_preparation(raw, [], str(tmp_path / "x"))
    assert T.versions(spark, str(tmp_path / "x") + "/splits").count() == 0


def test_preparation_is_made_once_and_published_by_split(spark, tmp_path, monkeypatch):
    made, dealt = [], []
    staged, publish = T.staged, T.publish
    monkeypatch.setattr(T, "staged", lambda df, name, *by: (made.append(name), staged(df, name, *by))[1])
    monkeypatch.setattr(T, "publish", lambda *a, **k: (dealt.append(a), publish(*a, **k))[1])
    rows = P.preparation.clean(spark, SF)
    found = {r.split: (r.n, r.n_pos) for r in J.run_preparation(rows, P.preparation.lookups(rows), str(tmp_path / "p"), clean=True).collect()}
    table = T.current(spark, str(tmp_path / "p") + "/splits")
    assert made == ["clean", "lookups", "prepared"] and not dealt and found.keys() == {"train", "val"} and table.count() == sum(n for n, _ in found.values())
    train = table.where("split = 'train'").agg(F.avg("af"), F.stddev_pop("af")).first()
    assert abs(train[0]) < 1e-9 and abs(train[1] - 1) < 1e-9 and "locus" in table.columns and table.where("locus IS NULL").count() == 0


def test_scores_of_a_reloaded_pipeline(spark, tmp_path):
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import GBTClassifier, LogisticRegression

    rows = spark.range(600).select("id", (F.col("id") % 7 / 7.0).alias("a"), (F.col("id") % 11).cast("int").alias("b"), (F.col("id") % 7 + F.col("id") % 3 > 4).cast("int").alias("label"), F.lit("kept").alias("other"))
    for name, model in (("logistic", LogisticRegression()), ("trees", GBTClassifier(maxIter=3, seed=1))):
        path = str(tmp_path / name)
        J.fit_pipeline(rows, ["a", "b"], F.col("id") < 300, F.col("id").between(300, 399), path, model)
        fresh = rows.where("id >= 400").drop("label")
        one, two = (J.score_batch(fresh, path).orderBy("id").collect() for _ in range(2))
        assert one == two and len(one) == 200 and {"tier", "confidence", "other"} <= set(one[0].asDict())
        direct = PipelineModel.load(f"{path}/model").transform(rows.where("id >= 400")).orderBy("id").collect()
        assert [r.score for r in one] == [float(r["_score"][1]) for r in direct]
        right = rows.where("id >= 400").join(J.score_batch(fresh, path).select("id", "score"), "id").where("(score >= 0.5) = (label = 1)").count()
        assert right > 160
        assert J.score_batch(fresh.drop("b"), path).count() == 200 and T.current(spark, f"{path}/about").first().n_train == 300
    assert P.batch_scores(spark, SF).count() > 0


def test_a_fitted_pipeline_makes_its_rows_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def value(i):
        made.add(1)
        return i % 7 / 7.0

    rows = spark.range(400).select("id", value("id").alias("a"), (F.col("id") % 7 > 3).cast("int").alias("label"))
    J.fit_pipeline(rows, ["a"], F.col("id") < 200, F.col("id").between(200, 299), str(tmp_path / "once"))
    about = T.current(spark, str(tmp_path / "once") + "/about").first()
    assert (about.n_train, about.n_calibration) == (200, 100) and made.value <= 400
