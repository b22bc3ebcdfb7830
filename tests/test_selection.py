"""Exact percentiles, grouped running sums and the bootstrap against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixspark.operators import drift as D
from helixspark.operators import evaluation as E
from helixspark.operators import scoring as R
from helixspark.operators.selection import exact_percentiles, joined_by, running_sums, sliced

PROBABILITIES = [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]


@pytest.fixture(scope="module")
def values():
    r = np.random.default_rng(2)
    return {"skewed": np.exp(r.normal(0, 4, 6000)), "ties": np.round(r.normal(0, 1, 5000)), "hot": np.r_[np.full(9000, 3.0), r.random(50)], "one": np.array([7.5]), "two": np.array([1.0, 2.0]), None: -r.random(3000)}


@pytest.mark.parametrize("accuracy", [10_000, 40])
def test_exact_percentiles(spark, values, accuracy):
    rows = [(g, float(x)) for g, xs in values.items() for x in xs] + [("one", None), ("two", float("nan")), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {r.g: (r.n, r.percentiles) for r in exact_percentiles(df, "x", PROBABILITIES, ["g"], accuracy).collect()}
    assert got.keys() == values.keys()
    for g, xs in values.items():
        assert got[g][0] == len(xs) and np.allclose(got[g][1], np.percentile(xs, [100 * p for p in PROBABILITIES]), rtol=1e-12, atol=0), g
    whole = np.concatenate(list(values.values()))
    assert np.allclose(exact_percentiles(df, "x", [0.3, 0.5], (), accuracy).first().percentiles, np.percentile(whole, [30, 50]))
    assert exact_percentiles(df.limit(0), "x", [0.5]).count() == 0


def test_percentiles_count_only_what_the_brackets_hold(spark):
    """Values outside the brackets never reach the counted histogram."""
    df = spark.range(100_000).select(F.col("id").cast("double").alias("x"))
    assert exact_percentiles(df, "x", [0.5], (), 1000).first().percentiles == [49999.5]


def test_running_sums_by_group(spark, values):
    rows = [(g, float(x), 1) for g, xs in values.items() for x in np.unique(xs)]
    df = spark.createDataFrame(rows, "g string, x double, v long").repartition(4)
    got = {(r.g, r.x): (r.upto_v, r.next_x) for r in running_sums(df, "x", ["v"], 7, ["g"]).collect()}
    for g, xs in values.items():
        u = np.unique(xs)
        for k, x in enumerate(u):
            assert got[g, x] == (k + 1, u[k + 1] if k + 1 < len(u) else None)


def test_bootstrap_on_exact_scores(spark):
    r = np.random.default_rng(8)
    y = r.integers(0, 2, 3000)
    p = np.clip(r.normal(0.45 + 0.1 * y, 0.2), 0, 1)  # no two scores alike but 0 and 1
    df = spark.createDataFrame([(float(s), int(v)) for s, v in zip(p, y)], "score double, label int")
    got, point = R.resampled(df).first(), E.ranking_quality(df).first()
    assert got.n_replicates == 1000 and round(got.auroc, 6) == point.auroc and round(got.ap, 6) == point.average_precision
    assert np.allclose(R.resampled(df, slices=5, chunk=64).first(), got, rtol=1e-12)  # draws do not depend on slices

    def auroc(i):
        a, b = np.sort(p[i][y[i] == 0]), p[i][y[i] == 1]
        return (np.searchsorted(a, b) + np.searchsorted(a, b, "right")).sum() / (2 * len(a) * len(b))

    plain = [auroc(r.integers(0, 3000, 3000)) for _ in range(1000)]
    assert abs(got.auroc_low - np.percentile(plain, 2.5)) < 0.004 and abs(got.auroc_high - np.percentile(plain, 97.5)) < 0.004
    many = R.poisson_counts(np.array([0.0, 1.0, 25.0, 4000.0]), np.array([0.1, 0.2, 0.3, 0.4]), 5, 20_000)[:, 1:]
    assert np.allclose(many.mean(1), [0, 1, 25, 4000], rtol=0.03) and np.allclose(many.var(1), [0, 1, 25, 4000], rtol=0.05)
    assert R.resampled(df.where("label = 1"), replicates=5).first().n_replicates == 0 and R.resampled(df.limit(0), replicates=5).first().auroc is None


def test_percentile_between_equal_neighbours_is_their_value(spark):
    df = spark.createDataFrame([(x,) for x in (0.1, 0.3, 0.7, 0.4213, 0.8999) for _ in range(1007)], "x double")
    inner = [k / 10 for k in range(1, 10)]
    for x in (0.1, 0.3, 0.7, 0.4213, 0.8999):
        assert exact_percentiles(df.where(F.col("x") == x), "x", inner).first().percentiles == [x] * 9


def test_small_groups_are_not_cut(spark, values):
    rows = [(g, float(x), 1) for g, xs in values.items() for x in np.unique(xs)]
    df = spark.createDataFrame(rows, "g string, x double, v long").repartition(4)
    slices = {r.g: r.n for r in sliced(df, "x", 7, ["g"], small=1000).groupBy("g").agg(F.count_distinct("_slice").alias("n")).collect()}
    assert slices == {g: 7 if len(np.unique(xs)) > 1000 else 1 for g, xs in values.items()}
    cut = sorted(map(str, running_sums(df, "x", ["v"], 7, ["g"], small=1000).collect()))
    assert cut == sorted(map(str, running_sums(df, "x", ["v"], 7, ["g"]).collect())) and len(cut) == len(rows)


def test_few_groups_are_not_dealt_by_their_key(spark):
    """A join by three keys would bring each one's rows into one task; the brackets are broadcast."""
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("x"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        jobs = exact_percentiles(df, "x", [0.5], ["g"]).collect()
        plan = joined_by(df, df.groupBy("g").agg(F.count("*").alias("n")), ["g"], small=True)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(r.percentiles[0] for r in jobs) == [1498.5, 1499.5, 1500.5] and "SortMergeJoin" not in plan


def test_drift_deals_no_rows_by_feature(spark):
    """Only counts and sums of what a task has read are shuffled: a few numbers a task, whatever the rows."""

    def shuffled(run):
        """The most rows that a stage of run() gets from a shuffle."""
        sc = spark.sparkContext._jsc.sc()
        stages = lambda: sc.statusStore().stageList(spark._jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        sc.listenerBus().waitUntilEmpty()
        before = {stages().apply(i).stageId() for i in range(stages().size())}
        run()
        sc.listenerBus().waitUntilEmpty()
        seen = stages()
        new = [seen.apply(i) for i in range(seen.size())]
        return max(x.shuffleReadRecords() for x in new if x.stageId() not in before)

    most = []
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as on large tables, whose estimated sizes are above it
    try:
        for n in (20_000, 80_000):
            df = spark.range(n).select((F.col("id") % 3 == 0).cast("int").alias("tag"), (F.col("id") % 50).cast("double").alias("few"), F.col("id").cast("double").alias("all")).repartition(4).localCheckpoint()
            most.append((shuffled(lambda: E.feature_drift(df, ["few", "all"], "tag").collect()), shuffled(lambda: D.reference_statistics(df, ["few", "all"]).collect())))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert all(0 < x < 2000 for m in most for x in m), most  # 20000 to 80000 rows a feature
