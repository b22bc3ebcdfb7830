"""Registered queries on score tables and drift, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixspark.functions import expressions as X
from helixspark.functions import sequences as Q
from helixspark.operators import annotation as A
from helixspark.operators import drift as D
from helixspark.operators import evaluation as E
from helixspark.operators import filters as P
from helixspark.operators import scoring as R
from helixspark.operators import summaries as U
from helixspark.operators import variants as V
from helixspark.plans.catalog import SCORED_CTE
from helixspark.sources import fixtures as S

#: Scores with a consequence, a date and two more models; the same text in both engines.
RICH = """SELECT concat(CAST(l_orderkey AS VARCHAR(12)), '-', CAST(l_linenumber AS VARCHAR(4))) AS variant_id, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
  CASE l_linenumber WHEN 1 THEN 'missense_variant' WHEN 2 THEN 'stop_gained' WHEN 3 THEN 'synonymous_variant' WHEN 4 THEN 'splice_region_variant' WHEN 5 THEN 'splice_donor_variant' WHEN 6 THEN 'inframe_deletion' ELSE 'intron_variant' END AS consequence,
  CAST((l_orderkey * 7919 + l_linenumber * 104729) % 5000 + CASE WHEN l_returnflag = 'R' THEN 4000 ELSE 0 END AS DOUBLE) / 10000.0 AS score,
  CAST((l_orderkey * 613 + l_linenumber * 31) % 7000 + CASE WHEN l_returnflag = 'R' THEN 2000 ELSE 0 END AS DOUBLE) / 10000.0 AS second,
  CAST((l_partkey * 89) % 10000 AS DOUBLE) / 10000.0 AS third, CASE WHEN l_shipdate < TIMESTAMP '1995-06-01 00:00:00' THEN 'old' ELSE 'new' END AS cohort FROM {lineitem}"""
#: Releases with loci, free significance texts and the training split of their ids.
RELEASE = """SELECT o_orderkey AS variant_id, CAST(1 + o_custkey % 22 AS VARCHAR(10)) AS chrom, o_orderkey * 7 AS pos, substring('ACGT', CAST(1 + o_orderkey % 4 AS INT), 1) AS ref,
  CASE WHEN {late} = 1 AND o_custkey % 50 = 3 THEN 'N' ELSE 'T' END AS alt, CASE o_orderstatus WHEN 'F' THEN 'train' WHEN 'P' THEN 'val' ELSE 'test' END AS split,
  CASE (o_orderkey + CASE WHEN {late} = 1 AND o_custkey % 40 = 7 THEN 3 ELSE 0 END) % 7 WHEN 0 THEN 'Pathogenic' WHEN 1 THEN 'Pathogenic/Likely pathogenic' WHEN 2 THEN 'Likely pathogenic' WHEN 3 THEN 'Uncertain significance'
    WHEN 4 THEN 'Likely benign' WHEN 5 THEN 'Benign/Likely benign' ELSE 'not provided' END AS clinical_sig
FROM {orders} WHERE o_custkey % 10 <> {late}"""
RELEASE_BEFORE, RELEASE_AFTER = RELEASE.replace("{late}", "0"), RELEASE.replace("{late}", "1")
_FEATURES = ["l_quantity", "l_extendedprice", "l_discount"]
_SWEEP = [k / 100 for k in range(10, 90, 5)]


def _rich(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.view(spark, sf_dir, RICH, "lineitem")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lines before and after a date, with a key."""
    rows = _lines(spark, sf_dir).select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("key"), *_FEATURES, (F.col("l_shipdate") < F.lit("1995-06-01").cast("timestamp")).alias("_early"))
    return rows.where("_early").drop("_early"), rows.where("NOT _early").drop("_early")


def reliability_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.reliability(_rich(spark, sf_dir).withColumn("class", R.consequence_class(F.col("consequence"))), by="class")


def consequence_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.grouped_quality(_rich(spark, sf_dir).withColumn("class", R.coarse_consequence(F.col("consequence"))), "class")


def tier_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.scored_in_tiers(_rich(spark, sf_dir)).groupBy("tier", "confidence").agg(F.count("*").alias("n"), F.sum("label").alias("n_pos"))


def tier_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.tier_bounds(_rich(spark, sf_dir), 0.95, 0.90)


def best_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.best_threshold(_rich(spark, sf_dir), _SWEEP)


def class_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.macro_f1(_rich(spark, sf_dir))


def blended_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.blended(_rich(spark, sf_dir), ["score", "second", "third"], [0.5, 0.3, 0.2])
    return R.grouped_quality(rows.select("cohort", F.round("blend", 6).alias("score"), "label"), "cohort")


def blend_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.best_blend(_rich(spark, sf_dir), ["score", "second", "third"])


def ranking_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genes as features, ranked by their mean discount before and after a date."""
    rows = _lines(spark, sf_dir)
    ranking = lambda early: rows.where(f"l_shipdate {'<' if early else '>='} TIMESTAMP '1995-06-01 00:00:00'").groupBy(F.concat(F.lit("GENE"), F.col("l_suppkey").cast("string")).alias("feature")).agg(F.sum(F.round(F.col("l_discount") * 100).cast("long")).cast("double").alias("importance"))
    return R.ranking_stability(ranking(False), ranking(True), 0.02)


def retraining_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rich(spark, sf_dir).withColumn("days_old", F.expr("CAST(split_part(variant_id, '-', 1) AS BIGINT) % 1000"))
    weighed = E.sample_weights(rows, rows.where("score > 0.85 AND label = 0").select("variant_id"), "variant_id")
    return R.combined_weights(weighed, "weight", "second").select("variant_id", F.round("combined", 6).alias("combined"))


def cohort_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.retention(_rich(spark, sf_dir), "cohort")


def quantile_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.quantile_bins(_rich(spark, sf_dir))


def stratified_fold_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.stratified_folds(_rich(spark, sf_dir), F.col("variant_id"), "label", 5).groupBy("fold", "label").agg(F.count("*").alias("n"))


def member_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Q.member_statistics(F.array("score", "second", "third"))
    rows = _rich(spark, sf_dir).select("variant_id", s.alias("s")).select("variant_id", "s.*")
    return rows.select("variant_id", F.round("mean", 6).alias("mean"), F.round("epistemic", 9).alias("epistemic"), F.round("aleatoric", 6).alias("aleatoric"), "triage")


def bootstrap_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.resampled(_rich(spark, sf_dir))


def temperature_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fitted temperature and the calibration error before and after, on a fifth of the rows it wasn't fitted on."""
    rows = E.folds(_rich(spark, sf_dir), F.col("variant_id"), 5)
    t = R.temperature(rows.where("fold <> 0"))
    test = R.tempered(rows.where("fold = 0"), t)
    before, after = E.calibration_error(test), E.calibration_error(test.withColumn("score", F.col("calibrated")))
    return before.select(F.lit(round(t, 6)).alias("temperature"), F.col("ece").alias("ece_before")).crossJoin(F.broadcast(after.select(F.col("ece").alias("ece_after"))))  # one row each


def drift_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).select(*_FEATURES, "l_tax", (F.col("l_linestatus") == "F").cast("int").alias("tag")).withColumn("l_discount", F.when(F.col("tag") == 1, F.col("l_discount") / 2).otherwise(F.col("l_discount")))
    return D.overall_action(E.feature_drift(rows, [*_FEATURES, "l_tax"], "tag"))


def stored_reference_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _halves(spark, sf_dir)
    shifted = new.withColumn("l_discount", F.col("l_discount") / 2)
    return D.drift_against(D.reference_statistics(old, _FEATURES), shifted, _FEATURES)


def quantity_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KS statistic and p of the price between two kinds of lines."""
    rows = _lines(spark, sf_dir).select("l_extendedprice", (F.col("l_linenumber") % 2).alias("late"))
    n = rows.agg(F.sum(1 - F.col("late")).alias("n"), F.sum("late").alias("m"))
    both = V.two_sample_distances(rows, "l_extendedprice", "late").crossJoin(F.broadcast(n))  # one row each
    return both.select("ks", F.round(D.ks_p_value(F.col("ks"), F.col("n"), F.col("m")), 6).alias("p_value"))


def manifest_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints (rows and total) of each customer's orders, at a date and now."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    manifest = lambda rows: rows.groupBy(F.col("o_custkey").alias("source")).agg(F.concat_ws(":", F.count("*").cast("string"), F.sum("o_orderkey").cast("string")).alias("fingerprint"))
    return D.source_changes(manifest(orders.where("o_orderdate < TIMESTAMP '1996-01-01 00:00:00'")), manifest(orders.where("o_orderstatus <> 'P'")))


def _releases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return tuple(S.view(spark, sf_dir, r, "orders").withColumn("clinical_sig", P.canonical_class(F.col("clinical_sig"))).where("clinical_sig IS NOT NULL") for r in (RELEASE_BEFORE, RELEASE_AFTER))


def _label_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _releases(spark, sf_dir)
    train = S.view(spark, sf_dir, RELEASE_BEFORE, "orders").where("split = 'train'")
    return A.flips(old, new, train, ("variant_id", "chrom", "pos", "ref", "alt"))


def label_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label drift report: flips over records that agree in id and locus, and the ids that came and went."""
    old, new = _releases(spark, sf_dir)
    ids = U.id_changes(old, new, "variant_id").agg(F.count_if(F.col("change") == "new").alias("n_new"), F.count_if(F.col("change") == "removed").alias("n_removed"))
    return _label_report(spark, sf_dir).crossJoin(F.broadcast(ids))  # one row each


def flip_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """old -> new counts of changed records, by the split their id is in."""
    old, new = _releases(spark, sf_dir)
    on = ["variant_id", "chrom", "pos", "ref", "alt"]
    both = old.withColumnRenamed("clinical_sig", "old_sig").join(new.select(*on, F.col("clinical_sig").alias("new_sig")), on).where("old_sig <> new_sig")
    return both.groupBy("split", F.concat_ws(" -> ", "old_sig", "new_sig").alias("direction")).agg(F.count("*").alias("n"))


def retrain_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.decision(drift_overall(spark, sf_dir), _label_report(spark, sf_dir))


def joint_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The joint tests of the lines before and after a date (their samples: see operators.drift), on standardised features."""
    old, new = _halves(spark, sf_dir)
    both = E.standardised(old.withColumn("t", F.lit(0)).union(new.withColumn("t", F.lit(1))), _FEATURES, F.col("t") == 0)
    return D.joint_tests(both.where("t = 0").drop("t"), both.where("t = 1").drop("t"), _FEATURES, "key")


def density_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weights of the older lines against the newer, discounts halved in the new ones; by discount."""
    old, new = _halves(spark, sf_dir)
    scale = lambda df, f: df.select("key", (F.col("l_quantity") / 50).alias("quantity"), (F.col("l_discount") * 10 / f).alias("discount"))
    weights = D.density_weights(scale(old, 1), scale(new, 2), scale(old, 1), ["quantity", "discount"], "key")
    return weights.groupBy(F.round("discount", 1).alias("discount")).agg(F.count("*").alias("n"), F.round(F.avg("weight"), 4).alias("mean_weight"))


_QUERIES = (reliability_table, consequence_quality, tier_report, tier_thresholds, best_f1, class_f1, blended_models, blend_weights, ranking_changes, retraining_weights, cohort_retention, quantile_calibration, stratified_fold_counts, member_uncertainty,
            bootstrap_intervals, temperature_scaling, drift_overall, stored_reference_drift, quantity_p_values, manifest_changes, label_drift, flip_directions, retrain_decision, joint_drift, density_ratio)

_R = f"r AS ({S.plain(RICH)})"


def _quality(by: str, rows: str) -> str:
    return f"""h AS (SELECT {by} AS g, score, sum(label) AS p, sum(1 - label) AS n FROM {rows} GROUP BY 1, 2), c AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM h WINDOW w AS (PARTITION BY g ORDER BY score DESC)),
a AS (SELECT g, sum(p)::BIGINT AS n_pos, sum(n)::BIGINT AS n_neg, sum(n * (tp - p / 2.0::DOUBLE)) AS u, sum(p * tp / (tp + fp)::DOUBLE) AS x FROM c GROUP BY 1 HAVING sum(p) + sum(n) >= 20 AND sum(p) > 0 AND sum(n) > 0)
SELECT g AS {{name}}, n_pos, n_neg, round(u / (n_pos::DOUBLE * n_neg), 6) AS auroc, round(x / n_pos, 6) AS average_precision FROM a"""


_COARSE = """CASE WHEN consequence IN ('stop_gained', 'splice_donor_variant') THEN 'loss_of_function' WHEN contains(consequence, 'missense') THEN 'missense' WHEN contains(consequence, 'synonymous') THEN 'synonymous'
  WHEN contains(consequence, 'splice') THEN 'splice_region' WHEN contains(consequence, 'inframe') THEN 'inframe_indel' ELSE 'other' END"""
_EXACT = """CASE consequence WHEN 'missense_variant' THEN 'missense' WHEN 'stop_gained' THEN 'lof' WHEN 'synonymous_variant' THEN 'synonymous' WHEN 'splice_region_variant' THEN 'splice' WHEN 'splice_donor_variant' THEN 'splice' ELSE 'other' END"""
_TIER = "CASE WHEN score > 0.9 THEN 'Pathogenic' WHEN score > 0.7 THEN 'Likely pathogenic' WHEN score > 0.3 THEN 'Uncertain significance' WHEN score > 0.1 THEN 'Likely benign' ELSE 'Benign' END"
_DRIFT = """x AS (UNPIVOT (SELECT (l_linestatus = 'F')::INT AS tag, l_quantity, l_extendedprice, CASE WHEN l_linestatus = 'F' THEN l_discount / 2 ELSE l_discount END AS l_discount, l_tax FROM lineitem) ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME feature VALUE x),
dr AS (SELECT feature, quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi FROM x WHERE tag = 0 GROUP BY 1), dt AS (SELECT feature, count_if(tag = 0) AS ta, count_if(tag = 1) AS tb FROM x GROUP BY 1),
dc AS (SELECT x.feature, least(floor((x - lo) / (hi - lo) * 10), 9) AS bin, count_if(tag = 0) AS a, count_if(tag = 1) AS b FROM x JOIN dr ON dr.feature = x.feature WHERE x BETWEEN lo AND hi GROUP BY 1, 2),
dg AS (SELECT dt.feature, greatest(1e-4, coalesce(a, 0) / ta::DOUBLE) AS a, greatest(1e-4, coalesce(b, 0) / tb::DOUBLE) AS b FROM dt CROSS JOIN range(10) k(bin) LEFT JOIN dc ON dc.feature = dt.feature AND dc.bin = k.bin),
dp AS (SELECT feature, sum((b - a) * ln(b / a)) AS psi FROM dg GROUP BY 1),
report AS (SELECT count_if(psi > 0.25)::BIGINT AS n_retrain, count_if(psi > 0.2 AND psi <= 0.25)::BIGINT AS n_monitor, coalesce(string_agg(feature, ',' ORDER BY psi DESC, feature) FILTER (psi > 0.25), '') AS top_drifted,
  CASE WHEN count_if(psi > 0.25) > 3 THEN 'urgent_retrain' WHEN count_if(psi > 0.25) > 0 THEN 'retrain' WHEN count_if(psi > 0.2) > 0 THEN 'monitor' ELSE 'none' END AS action FROM dp)"""
_SIG = """CASE WHEN contains(clinical_sig, 'Pathogenic') THEN 'Pathogenic' WHEN contains(clinical_sig, 'Likely pathogenic') THEN 'Likely pathogenic' WHEN contains(clinical_sig, 'Benign') THEN 'Benign'
  WHEN contains(clinical_sig, 'Likely benign') THEN 'Likely benign' WHEN contains(clinical_sig, 'Uncertain') THEN 'Uncertain significance' END"""
_FLIPS = f"""o AS (SELECT * REPLACE ({_SIG} AS clinical_sig) FROM ({S.plain(RELEASE_BEFORE)}) WHERE {_SIG} IS NOT NULL), w AS (SELECT * REPLACE ({_SIG} AS clinical_sig) FROM ({S.plain(RELEASE_AFTER)}) WHERE {_SIG} IS NOT NULL),
b AS (SELECT o.variant_id, o.split, o.clinical_sig AS old_sig, w.clinical_sig AS new_sig FROM o JOIN w ON o.variant_id = w.variant_id AND o.chrom = w.chrom AND o.pos = w.pos AND o.ref = w.ref AND o.alt = w.alt),
f AS (SELECT count(*) AS n_common, count_if(old_sig <> new_sig)::BIGINT AS n_changed, count_if(old_sig <> new_sig AND split = 'train')::BIGINT AS n_training_changed, (SELECT count(*) FROM ({S.plain(RELEASE_BEFORE)}) WHERE split = 'train')::DOUBLE AS ids,
  sum(CASE WHEN old_sig = new_sig OR split <> 'train' THEN 0 WHEN old_sig = 'Pathogenic' AND new_sig = 'Benign' THEN 3.0 WHEN old_sig = 'Benign' AND new_sig = 'Pathogenic' THEN 3.0 WHEN old_sig = 'Likely pathogenic' AND new_sig = 'Likely benign' THEN 2.0
    WHEN old_sig = 'Likely benign' AND new_sig = 'Likely pathogenic' THEN 2.0 WHEN old_sig IN ('Pathogenic', 'Likely pathogenic') AND new_sig IN ('Benign', 'Likely benign') THEN 2.5 WHEN old_sig IN ('Benign', 'Likely benign') AND new_sig IN ('Pathogenic', 'Likely pathogenic') THEN 2.5
    WHEN old_sig = 'Uncertain significance' AND new_sig IN ('Pathogenic', 'Benign') THEN 1.5 WHEN old_sig = 'Uncertain significance' THEN 1.0 WHEN old_sig IN ('Pathogenic', 'Benign') AND new_sig = 'Uncertain significance' THEN 1.5 ELSE 0.5 END)::DOUBLE AS s FROM b),
lr AS (SELECT n_common, n_changed, n_training_changed, round(n_training_changed / ids, 6) AS flip_rate, round(s / ids, 6) AS weighted_impact,
  CASE WHEN n_training_changed / ids >= 0.025 OR s / ids >= 0.025 THEN 'urgent' WHEN n_training_changed / ids >= 0.01 OR s / ids >= 0.015 THEN 'retrain' WHEN n_training_changed / ids >= 0.005 THEN 'monitor' ELSE 'none' END AS urgency FROM f)"""


def _ppv(name: str, rows: str, target: float) -> str:
    return f"""{name}h AS (SELECT round(score, 4) AS score, sum(label) AS p, sum(1 - label) AS n FROM {rows} GROUP BY 1), {name}c AS (SELECT score, sum(p) OVER w / (sum(p) OVER w + sum(n) OVER w)::DOUBLE AS ppv FROM {name}h WINDOW w AS (ORDER BY score DESC)),
{name} AS (SELECT coalesce(max(score) FILTER (ppv >= {target}), arg_min(score, (-ppv, score))) AS t FROM {name}c)"""


_WEIGHTS = ", ".join(f"({a / 4}, {b / 4}, {(4 - a - b) / 4})" for a in range(5) for b in range(5 - a))

_ORACLES = {
    "reliability_table": f"""WITH {_R}, g AS (SELECT 'all' AS "group", score, label FROM r UNION ALL SELECT {_EXACT}, score, label FROM r), t AS (SELECT "group", count(*) AS total FROM g GROUP BY 1 HAVING "group" = 'all' OR count(*) >= 50),
k AS (SELECT k::INT AS k, k * (1.0::DOUBLE / 15) AS lo, (k + 1) * (1.0::DOUBLE / 15) AS hi FROM range(15) x(k)), c AS (SELECT "group", k, count(*) AS n, avg(score) AS m, avg(label) AS f FROM g JOIN k ON score >= lo AND score < hi GROUP BY 1, 2),
e AS (SELECT c."group", sum(abs(m - f) * n / total) AS ece, max(abs(m - f)) AS mce FROM c JOIN t ON t."group" = c."group" GROUP BY 1)
SELECT t."group", round(k.k * (1.0::DOUBLE / 15), 4) AS bin_lower, round((k.k + 1) * (1.0::DOUBLE / 15), 4) AS bin_upper, round(coalesce(m, (k.k + 0.5::DOUBLE) * (1.0::DOUBLE / 15)), 4) AS mean_prob, round(f, 4) AS fraction_pos, coalesce(n, 0) AS count,
  round(coalesce(ece, 0), 4) AS ece, round(coalesce(mce, 0), 4) AS mce FROM t CROSS JOIN k LEFT JOIN c ON c."group" = t."group" AND c.k = k.k LEFT JOIN e ON e."group" = t."group\"""",
    "consequence_quality": f"WITH {_R}, {_quality(_COARSE, 'r').format(name='class')}",
    "tier_report": f"""WITH {_R}, t AS (SELECT score, label, {_TIER} AS tier, CASE WHEN score > 0.9 THEN least(score - 0.9, 1.01 - score) WHEN score > 0.7 THEN least(score - 0.7, 0.9 - score) WHEN score > 0.3 THEN least(score - 0.3, 0.7 - score)
  WHEN score > 0.1 THEN least(score - 0.1, 0.3 - score) ELSE least(score + 0.01, 0.1 - score) END AS d FROM r)
SELECT tier, CASE WHEN d >= 0.15 THEN 'high' WHEN d >= 0.05 THEN 'medium' ELSE 'low' END AS confidence, count(*) AS n, sum(label)::BIGINT AS n_pos FROM t GROUP BY 1, 2""",
    "tier_thresholds": f"""WITH {_R}, i AS (SELECT 1 - score AS score, 1 - label AS label FROM r), {_ppv('p', 'r', 0.95)}, {_ppv('l', 'r', 0.9)}, {_ppv('b', 'i', 0.95)}, {_ppv('m', 'i', 0.9)},
x AS (SELECT p.t AS p, l.t AS l, 1 - b.t AS b, 1 - m.t AS m FROM p, l, b, m), y AS (SELECT *, least(b, m) AS bh, least(m, l) AS lh FROM x)
SELECT 'Pathogenic' AS tier, round(p, 4) AS lo, 1.01::DOUBLE AS hi FROM y UNION ALL SELECT 'Likely pathogenic', round(l, 4), round(p, 4) FROM y UNION ALL SELECT 'Uncertain significance', round(bh, 4), round(lh, 4) FROM y
UNION ALL SELECT 'Likely benign', round(bh, 4), round(lh, 4) FROM y UNION ALL SELECT 'Benign', -0.01::DOUBLE, round(b, 4) FROM y""",
    "best_f1": f"""WITH {_R}, t AS (SELECT k / 100.0::DOUBLE AS threshold FROM range(10, 90, 5) x(k)), c AS (SELECT threshold, count_if(label = 1 AND score >= threshold) AS tp, count_if(label = 0 AND score >= threshold) AS fp, count_if(label = 1 AND score < threshold) AS fn FROM r, t GROUP BY 1)
SELECT threshold, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / (tp + fn)::DOUBLE, 6) AS recall FROM c ORDER BY f1 DESC, threshold LIMIT 1""",
    "class_f1": f"""WITH {_R}, c AS (SELECT count_if(label = 1 AND score >= 0.5)::DOUBLE AS tp, count_if(label = 0 AND score >= 0.5)::DOUBLE AS fp, count_if(label = 1 AND score < 0.5)::DOUBLE AS fn, count_if(label = 0 AND score < 0.5)::DOUBLE AS tn FROM r), f AS (SELECT *, 2 * tp / (2 * tp + fp + fn) AS a, 2 * tn / (2 * tn + fp + fn) AS b FROM c)
SELECT round(a, 6) AS f1_positive, round(b, 6) AS f1_negative, round((a + b) / 2, 6) AS f1_macro, round((a * (tp + fn) + b * (tn + fp)) / (tp + fp + fn + tn), 6) AS f1_weighted FROM f""",
    "blended_models": f"WITH {_R}, z AS (SELECT cohort, label, round((score * 0.5::DOUBLE + second * 0.3::DOUBLE + third * 0.2::DOUBLE) / 1.0::DOUBLE, 6) AS score FROM r), {_quality('cohort', 'z').format(name='cohort')}",
    "blend_weights": f"""WITH {_R}, w AS (SELECT * FROM (VALUES {_WEIGHTS}) x(a, b, c)), l AS (SELECT a, b, c, count(*) AS n, avg(pow(a::DOUBLE * score + b::DOUBLE * second + c::DOUBLE * third - label, 2)) AS brier FROM r, w GROUP BY 1, 2, 3)
SELECT n, round(brier, 6) AS brier, a::DOUBLE AS score, b::DOUBLE AS second, c::DOUBLE AS third FROM l ORDER BY round(l.brier, 9), a, b, c LIMIT 1""",
    "ranking_changes": """WITH x AS (SELECT concat('GENE', l_suppkey) AS feature, sum(round(l_discount * 100)::BIGINT) FILTER (l_shipdate >= TIMESTAMP '1995-06-01 00:00:00')::DOUBLE AS now, sum(round(l_discount * 100)::BIGINT) FILTER (l_shipdate < TIMESTAMP '1995-06-01 00:00:00')::DOUBLE AS before FROM lineitem GROUP BY 1),
y AS (SELECT *, rank() OVER (ORDER BY now DESC) + (count(*) OVER (PARTITION BY now) - 1) / 2.0 AS a, rank() OVER (ORDER BY before DESC) + (count(*) OVER (PARTITION BY before) - 1) / 2.0 AS b, abs(now - before) / nullif(before, 0) AS d FROM x WHERE now IS NOT NULL AND before IS NOT NULL)
SELECT feature, now, before, round(d, 6) AS change, CASE WHEN d > 0.04 THEN 'high' WHEN d >= 0.02 THEN 'medium' END AS severity, round(corr(a, b) OVER (), 6) AS spearman FROM y""",
    "retraining_weights": f"""WITH {_R}, w AS (SELECT variant_id, second, greatest(0.1, least(2.0, (1 - 0.5::DOUBLE * greatest(score, 1 - score) * ((score >= 0.5)::INT = label)::INT) * CASE WHEN score > 0.85 AND label = 0 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END * exp(-0.3::DOUBLE * (split_part(variant_id, '-', 1)::BIGINT % 1000) / 365))) AS e FROM r)
SELECT variant_id, round(greatest(0.1, least(3.0, sqrt(greatest(e, 0.1) * greatest(second, 0.1)))), 6) AS combined FROM w""",
    "cohort_retention": f"WITH {_R} SELECT cohort, count(*) AS n, round(avg(((score >= 0.5)::INT = label)::INT), 6) AS accuracy FROM r GROUP BY 1",
    "quantile_calibration": f"""WITH {_R}, e AS (SELECT quantile_cont(score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM r) SELECT len(list_filter(e.e, lambda x: x < score))::INT AS bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(label), 6) AS positive_rate FROM r, e GROUP BY 1""",
    "stratified_fold_counts": f"""WITH {_R}, k AS (SELECT label, (row_number() OVER (PARTITION BY label ORDER BY variant_id) - 1) % 5 AS fold FROM r) SELECT fold::INT AS fold, label, count(*) AS n FROM k GROUP BY 1, 2""",
    "member_uncertainty": f"""WITH {_R}, a AS (SELECT variant_id, [score, second, third] AS s, (score + second + third) / 3 AS m FROM r), b AS (SELECT variant_id, m, list_sum(list_transform(s, lambda x: (x - m) * (x - m))) / 3 AS v,
  list_sum(list_transform(s, lambda x: -(greatest(1e-8, least(1 - 1e-8::DOUBLE, x)) * ln(greatest(1e-8, least(1 - 1e-8::DOUBLE, x))) + (1 - greatest(1e-8, least(1 - 1e-8::DOUBLE, x))) * ln(1 - greatest(1e-8, least(1 - 1e-8::DOUBLE, x)))))) / 3 AS e FROM a)
SELECT variant_id, round(m, 6) AS mean, round(v, 9) AS epistemic, round(e, 6) AS aleatoric, CASE WHEN v + e > 0.05 THEN 'high' WHEN v + e > 0.02 THEN 'medium' ELSE 'low' END AS triage FROM b""",
    "drift_overall": f"WITH {_DRIFT} SELECT * FROM report",
    "stored_reference_drift": """WITH x AS (UNPIVOT (SELECT (l_shipdate >= TIMESTAMP '1995-06-01 00:00:00')::INT AS tag, l_quantity, l_extendedprice, CASE WHEN l_shipdate >= TIMESTAMP '1995-06-01 00:00:00' THEN l_discount / 2 ELSE l_discount END AS l_discount FROM lineitem) ON l_quantity, l_extendedprice, l_discount INTO NAME feature VALUE x),
r AS (SELECT feature, quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi FROM x WHERE tag = 0 GROUP BY 1), t AS (SELECT feature, count_if(tag = 0) AS ta, count_if(tag = 1) AS tb FROM x GROUP BY 1),
c AS (SELECT x.feature, least(floor((x - lo) / (hi - lo) * 10), 9) AS bin, count_if(tag = 0) AS a, count_if(tag = 1) AS b FROM x JOIN r ON r.feature = x.feature WHERE x BETWEEN lo AND hi GROUP BY 1, 2),
g AS (SELECT t.feature, tb, greatest(1e-4, coalesce(a, 0) / ta::DOUBLE) AS a, greatest(1e-4, coalesce(b, 0) / tb::DOUBLE) AS b FROM t CROSS JOIN range(10) k(bin) LEFT JOIN c ON c.feature = t.feature AND c.bin = k.bin),
p AS (SELECT feature, max(tb) AS m, sum((b - a) * ln(b / a)) AS psi, sum(a * ln(2 * a / (a + b)) + b * ln(2 * b / (a + b))) / 2 AS js FROM g GROUP BY 1)
SELECT feature, round(psi, 6) AS psi, round(js, 6) AS js, js > 0.05 AND m >= 500 AS shifted, CASE WHEN psi > 0.25 THEN 'retrain' WHEN psi > 0.2 THEN 'monitor' ELSE 'none' END AS action FROM p""",
    "quantity_p_values": """WITH c AS (SELECT l_extendedprice AS x, sum(1 - l_linenumber % 2) AS a, sum(l_linenumber % 2) AS b FROM lineitem GROUP BY 1), d AS (SELECT sum(a) OVER ()::DOUBLE AS n, sum(b) OVER ()::DOUBLE AS m, abs(sum(a) OVER (ORDER BY x)::DOUBLE / sum(a) OVER () - sum(b) OVER (ORDER BY x)::DOUBLE / sum(b) OVER ()) AS gap FROM c),
k AS (SELECT round(max(gap), 6) AS ks, max(n) AS n, max(m) AS m FROM d), z AS (SELECT ks, sqrt(n * m / (n + m)) * ks AS x FROM k)
SELECT ks, round(CASE WHEN x < 0.2 THEN 1.0 ELSE greatest(0, least(1, 2 * (SELECT sum(CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END * exp(-2 * i * i * x * x)) FROM range(1, 101) q(i)))) END, 6) AS p_value FROM z""",
    "manifest_changes": """WITH a AS (SELECT o_custkey AS source, concat_ws(':', count(*), sum(o_orderkey)) AS f FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01 00:00:00' GROUP BY 1), b AS (SELECT o_custkey AS source, concat_ws(':', count(*), sum(o_orderkey)) AS f FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)
SELECT coalesce(a.source, b.source) AS source, CASE WHEN a.f IS NULL THEN 'new' WHEN b.f IS NULL THEN 'removed' WHEN a.f <> b.f THEN 'changed' ELSE 'same' END AS status FROM a FULL JOIN b ON a.source = b.source""",
    "label_drift": f"""WITH {_FLIPS} SELECT lr.*, (SELECT count(*) FROM w WHERE variant_id NOT IN (SELECT variant_id FROM o)) AS n_new, (SELECT count(*) FROM o WHERE variant_id NOT IN (SELECT variant_id FROM w)) AS n_removed FROM lr""",
    "flip_directions": f"WITH {_FLIPS} SELECT split, old_sig || ' -> ' || new_sig AS direction, count(*) AS n FROM b WHERE old_sig <> new_sig GROUP BY 1, 2",
    "retrain_decision": f"""WITH {_DRIFT}, {_FLIPS}, k AS (SELECT CASE action WHEN 'urgent_retrain' THEN 3 WHEN 'retrain' THEN 2 WHEN 'monitor' THEN 1 ELSE 0 END AS a, CASE urgency WHEN 'urgent' THEN 3 WHEN 'retrain' THEN 2 WHEN 'monitor' THEN 1 ELSE 0 END AS l FROM report, lr)
SELECT a >= 2 AS feature_drift, l >= 2 AS label_drift, a >= 2 OR l >= 2 AS should_retrain, greatest(a, l) AS severity FROM k""",
}


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict:
    return dict(_ORACLES)
