"""The joined lookups: rules, keys, and the shuffles of their plan."""

import re

from pyspark.sql import functions as F

from helixspark.functions import identifiers as I
from helixspark.operators import evaluation as E
from helixspark.operators import preparation as R
from helixspark.plans import joins
from helixspark.plans import preparation as P
from helixspark.sources import tables as T

SF = "/root/testdata/sf0.001"


def test_rules_and_keys(spark):
    rows = spark.createDataFrame([("1", 5, "A", "T", 0.5), ("1", 5, "A", "G", None), ("2", 5, "A", "T", None)], "chrom string, pos int, ref string, alt string, af double")
    exact = spark.createDataFrame([("1", 5, "A", "T", 0.1, 3), ("1", 5, "A", "T", 0.4, 0), ("1", 5, "A", "G", 0.9, None), (None, 5, "A", "T", 7.0, 1), ("1", 5, None, "T", 7.0, 1)], "chrom string, pos int, ref string, alt string, af double, hit int")
    place = spark.createDataFrame([("1", 5, 2.0), ("1", 5, -1.0), ("3", 5, 9.0)], "chrom string, pos int, depth double")
    got = R.annotated_together(rows, [R.Lookup(exact, {"af": "min", "hit": "any"}), R.Lookup(exact.withColumn("n", F.lit(None).cast("int")), {"n": "count"}), R.Lookup(place, {"depth": "max"})], R.PLACE, R.ALLELES)
    assert {(r.chrom, r.alt): (r.af, r.hit, r.n, r.depth) for r in got.collect()} == {("1", "T"): (0.1, 1, 2, 2.0), ("1", "G"): (0.9, 0, 1, 2.0), ("2", "T"): (None, None, None, None)}
    assert got.count() == 3


def test_one_exchange_for_all_lookups_of_a_key(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = P._table(spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*?), \d+\)", plan)
    by = [re.sub(r"#\d+L?", "", keys) for keys in dealt]
    assert by.count("chrom, pos") == 2 and not any("ref" in b for b in by), by  # the variants and the thirteen lookups
    assert sum(b.startswith("gene_symbol, residue") for b in by) == 2, by


def test_scaled(spark):
    table = P._table(spark, SF)
    names = R.feature_columns(table)
    assert len(names) > 70 and not {"label", "tier", "pos", "allele_freq"} & set(names)


def test_sources_of_one_key_are_read_once(spark):
    rows = spark.createDataFrame([("1", 5, "A", "T", "g", "p.Arg4His", "gnomad", 0.5, "c", "r", "s")], "chrom string, pos int, ref string, alt string, gene_symbol string, protein_change string, source_db string, allele_freq double, consequence string, review_status string, clinical_sig string")
    found = P.lookups(rows)
    assert len(found) == len({tuple(k) for k, _, _ in P.SOURCES.values()}) == 5
    assert sorted(c for x in found for c in x.values) == sorted(c for _, _, v in P.SOURCES.values() for c in v)


def test_prepared_features_normalise_their_variants_once(spark):
    plan = joins.prepared_features(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and max(map(len, plan.split("\n"))) < 20_000


def test_an_identifier_is_parsed_once(spark):
    key = F.concat(F.lit("a:1:"), F.col("id").cast("string"), F.lit(":A:T"))
    plan = spark.range(3).select(I.parsed_id(key).alias("l")).where("l IS NOT NULL")
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 2 and [r.l.pos for r in plan.collect()] == [0, 1, 2]


def test_the_prepared_table_reads_normalised_variants(spark):
    plan = P._table(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and max(map(len, plan.split("\n"))) < 20_000


def test_no_step_of_the_preparation_is_too_long_to_compile(spark):
    longest = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenStringSeq
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        table = P._table(spark, SF)
        known = {c: (0.5, 2.0) for c in R.feature_columns(table)}
        written = T.staged(table, "written")
        for df in (table, R.scaled(written, known), E.moments(written, list(known), ["split"])):
            steps = longest(df._jdf.queryExecution().executedPlan()).iterator()
            while steps.hasNext():
                assert steps.next()._3().maxMethodCodeSize() <= 8000  # the JVM compiles no longer ones
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_scaled_moments_are_those_of_the_scaled_rows(spark):
    # fifteen columns, so that there is more than a block; one is constant in train, one unknown there
    df = spark.range(60).select(F.when(F.col("id") < 40, "train").otherwise("test").alias("split"), *[((F.col("id") * (k + 3)) % 17).cast("double").alias(f"x{k}") for k in range(13)], F.when(F.col("id") >= 40, F.col("id")).otherwise(7).cast("double").alias("same"), F.when(F.col("id") >= 40, 1.0).alias("none"))
    names = R.feature_columns(df)
    long = R.scaled(df).select("split", *names).unpivot(["split"], names, "feature", "x").groupBy("split", "feature").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("deviation"))
    want, got = ({(r.split, r.feature): (r.n, *(None if v is None else round(v, 9) + 0.0 for v in (r["mean"], r.deviation))) for r in x.collect()} for x in (long, R.scaled_moments(df)))
    assert len(want) == 30 and want == got
