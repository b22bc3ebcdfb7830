"""Interval overlaps against all pairs; the window detector's bounded state and its restart."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixspark.operators import intervals as I
from helixspark.streaming import adwin

from tests.test_references import plain_adwin


def test_one_row_an_interval_whatever_its_length(spark):
    rows = [("1", 5, 100_000_005, "long")] + [("1", 1000 * k, 1000 * k + 199, f"s{k}") for k in range(50)] + [("1", 255, 256, "across"), ("1", 9, 9, "one"), ("1", 10, 3, "empty"), ("1", -50, 4, "low")]
    bins = I.indexed(spark.createDataFrame(rows, "chrom string, lo long, hi long, name string"))
    got = {r.name: (r._shift, r._bin) for r in bins.collect()}
    assert bins.count() == len(got) == len(rows) - 1 and got["long"][0] > 25 and got["s0"] == (8, 0) and got["one"] == (8, 0) and got["across"] == (11, 0)
    for _, lo, hi, name in rows:
        if name in got:
            assert max(lo, 0) >> got[name][0] == hi >> got[name][0] == got[name][1]


@pytest.mark.parametrize("hot_rows", [1_000_000, 10])
def test_overlaps_equal_all_pairs(spark, hot_rows):
    r = np.random.default_rng(4)
    spans = [(str(r.integers(1, 3)), int(lo), int(lo + length), f"i{k}") for k, (lo, length) in enumerate(zip(r.integers(0, 300_000, 80), r.choice([0, 5, 200, 3000, 250_000], 80)))]
    points = [(str(r.integers(1, 4)), int(p), k) for k, p in enumerate([*r.integers(0, 310_000, 400), *[777] * 60])]
    df = spark.createDataFrame(points, "chrom string, pos int, id int").repartition(3)
    got = I.overlapping(df, spark.createDataFrame(spans, "chrom string, lo int, hi int, name string"), hot_rows)
    want = sorted((i, n) for c, p, i in points for d, lo, hi, n in spans if c == d and lo <= p <= hi)
    assert sorted((x.id, x.name) for x in got.collect()) == want and len(want) > 200
    assert got.columns == ["chrom", "pos", "id", "lo", "hi", "name"]
    assert I.overlapping(df, spark.createDataFrame([], "chrom string, lo int, hi int, name string")).count() == 0


def test_regulatory_overlap_keeps_rows_with_one_id_apart(spark):
    points = spark.createDataFrame([("1", 100, 7), ("1", 5000, 7), ("1", 100, 7), ("2", 100, None)], "chrom string, pos int, id int")
    elements = spark.createDataFrame([("1", 90, 110, "b", 1.5), ("1", 0, 90_000, "a", 0.5)], "chrom string, lo int, hi int, kind string, z double")
    got = sorted((r.chrom, r.pos, r.n_elements, r.types, r.max_z, r.in_cre) for r in I.regulatory_overlap(points, elements, 10).collect())
    assert got == [("1", 100, 2, "a,b", 1.5, True), ("1", 100, 2, "a,b", 1.5, True), ("1", 5000, 1, "a", 0.5, True), ("2", 100, 0, "", 0.0, False)]


def test_counts_without_pairs_equal_all_pairs(spark):
    r = np.random.default_rng(5)
    spans = [(str(r.integers(1, 3)), int(lo), int(lo + length), f"i{k % 17}" if k % 9 else None) for k, (lo, length) in enumerate(zip(r.integers(-300, 300_000, 120), r.choice([0, 5, 200, 3000, 250_000, 9_000_000], 120)))] + [("1", 9, 3, "none"), ("1", 5, 8, "i1"), ("1", 9, 12, "i1")]
    points = [(str(r.integers(1, 4)), int(p)) for p in [*r.integers(0, 310_000, 400), *[777] * 60, *range(20)]]
    df, of = spark.createDataFrame(points, "chrom string, pos int").repartition(3), spark.createDataFrame(spans, "chrom string, lo int, hi int, name string")
    want = {(c, p): [n for d, lo, hi, n in spans if c == d and lo <= p <= hi] for c, p in points}
    got = {(x.chrom, x.pos): (x.n_hits, x.n_elements) for x in I.hit_counts(df, of, "name").collect()}
    assert got == {k: (len(v), len(set(v) - {None})) for k, v in want.items() if v}
    assert I.hit_counts(df, of.limit(0), "name").count() == 0
    whole = I.nodes(of.where("lo = 9"), [], [F.count("*").alias("n")])
    assert sorted((x._shift, x._bin) for x in whole.collect()) == [(0, 9), (0, 12), (1, 5)]


def test_copies_of_intervals_are_met_once(spark):
    """Nodes are made once a place, however many intervals lie on it."""
    of = spark.range(500).select(F.lit("1").alias("chrom"), F.lit(64).alias("lo"), F.lit(127).alias("hi"), F.lit("a").alias("name"))
    places = spark.createDataFrame([("1", 70), ("1", 200)], "chrom string, pos int")
    assert I.at_nodes(places, I.nodes(of, [], [F.count("*").alias("n")])).select("pos", "n").collect() == [(70, 500)]


def drifts(values, **sizes):
    w, out = adwin.AdaptiveWindow(**sizes), []
    for at, v in enumerate(values):
        if w.update(v):
            out.append((at, len(w)))
    return out, w


def test_short_windows_equal_the_plain_loop():
    r = np.random.default_rng(6)
    values = np.concatenate([r.normal(m, 0.4, k) for m, k in ((0, 120), (1, 90), (-0.5, 150), (-0.5, 60), (2, 70))])
    assert drifts(values)[0] == plain_adwin(values) != []


def test_long_windows_have_logarithmic_state():
    r = np.random.default_rng(7)
    n, each, exact = 40_000, 16, 64
    values = np.r_[r.normal(0, 0.2, n), r.normal(1.0, 0.2, 200)]
    out, w = drifts(values[:n], exact=exact, each=each)
    assert not out and len(w) == n and len(w.newest) == exact
    assert len(w.counts) <= (each + 1) * np.log2(n) and np.isclose(sum(w.sums) + sum(w.newest), values[:n].sum())
    assert w.counts == sorted(w.counts, reverse=True) and all(w.counts.count(c) <= each for c in set(w.counts))
    for at, v in enumerate(values[n:]):
        if w.update(v):
            break
    # found soon after the change, and what is left begins near it: within n0 / each of the cut
    assert at < 60 and len(w) <= at + 1 + n / each


def run_stream(spark, df, condition, folder, **sizes):
    """One run of the query over the new rows, from the checkpoint of the run before; all its output so far."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    df.where(condition).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    source = spark.readStream.schema(df.schema).parquet(f"{folder}/in")
    q = adwin.streamed(source, "k", "t", "v", **sizes).writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(once=True).start()
    try:
        assert q.awaitTermination(100) and q.exception() is None
    finally:
        q.stop()
    return sorted(map(tuple, spark.read.schema("k string, t long, window_size int").parquet(f"{folder}/out").collect()))


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    r = np.random.default_rng(3)
    values = np.concatenate([r.normal(0, 0.3, 150), r.normal(1.5, 0.3, 100), r.normal(0, 0.3, 120)])
    data = [(k, i, float(v) if k == "a" else float(v) / 9) for k in ("a", "b") for i, v in enumerate(values)] + [(None, 0, 1.0), ("a", 9999, None)]
    df = spark.createDataFrame(data, "k string, t long, v double")
    sizes = {"exact": 40, "each": 8}
    want = sorted(map(tuple, adwin.detected(df, "k", "t", "v", **sizes).collect()))
    run_stream(spark, df, "t < 130", tmp_path, **sizes)
    assert run_stream(spark, df, "t >= 130", tmp_path, **sizes) == want and {k for k, *_ in want} == {"a"}


def test_state_of_a_silent_key_expires(spark, tmp_path):
    df = spark.createDataFrame([("a", i, float(i >= 100)) for i in range(130)], "k string, t long, v double")
    run_stream(spark, df, "t < 100", tmp_path, silent_ms=1)
    assert run_stream(spark, df, "t >= 100", tmp_path, silent_ms=1) == []  # 30 values only, the hundred before are gone
    assert adwin.detected(df, "k", "t", "v").count() > 0
