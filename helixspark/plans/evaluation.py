"""Registered evaluation, split and drift queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixspark.operators import evaluation as E
from helixspark.operators import variants as V
from helixspark.plans.catalog import NORM, SCORED_CTE
from helixspark.sources import fixtures as S


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.labelled(V.normalize(S.variants(spark, sf_dir)))


def score_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.score_curve(S.scored(spark, sf_dir)).select("score", "tp", "fp", F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"), F.round("ppv", 6).alias("ppv"))


def ranking_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.ranking_quality(S.scored(spark, sf_dir))


def operating_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.operating_points(S.scored(spark, sf_dir), 0.9, 0.95)


def sensitivity_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.sensitivity_point(S.scored(spark, sf_dir), 0.95)


_CUTS = [k / 20 for k in range(2, 18)]


def threshold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.threshold_metrics(S.scored(spark, sf_dir), _CUTS)


def calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.calibration_error(S.scored(spark, sf_dir))


def compared_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.scored(spark, sf_dir).select("label", F.col("score").alias("first"), ((1 + F.col("score")) / 2.5).alias("second"), F.lit(0.5).alias("constant"))
    return E.compared_models(rows, ["first", "second", "constant"])


def gene_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.group_errors(S.scored(spark, sf_dir), "gene_symbol")


def gene_split_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.split_statistics(E.group_split(_labelled(spark, sf_dir), "gene_symbol"))


def temporal_split_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.split_statistics(E.temporal_split(_labelled(spark, sf_dir), "last_evaluated", "1997-01-01"))


def fold_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.folds(S.scored(spark, sf_dir), F.col("variant_id"), 5).groupBy("fold", "label").agg(F.count("*").alias("n"))


def standardised_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.group_split(S.scored(spark, sf_dir), "gene_symbol")
    return E.standardised(rows, ["score"], F.col("split") == "train").groupBy("gene_symbol").agg(F.round(F.avg("score"), 5).alias("mean_z"))


def sample_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.scored(spark, sf_dir).withColumn("days_old", (F.expr("CAST(split_part(variant_id, '-', 1) AS BIGINT)") % 1000).cast("double"))
    flipped = rows.where("score > 0.85 AND label = 0").select("variant_id")
    return E.sample_weights(rows, flipped, "variant_id").select("variant_id", F.round("weight", 6).alias("weight"))


def conformal_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.conformal(S.scored(spark, sf_dir), F.col("variant_id").endswith("-1"))


def feature_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_quantity", "l_extendedprice", "l_discount", (F.col("l_returnflag") == "R").cast("int").alias("tag"))
    return E.feature_drift(rows, ["l_quantity", "l_extendedprice", "l_discount"], "tag")


def gene_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.association(_labelled(spark, sf_dir), "gene_symbol", F.col("consequence").contains("missense"))


def attribution_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_quantity") - 25).alias("quantity"), F.col("l_discount").alias("discount"), (F.col("l_tax") - 0.02).alias("tax"))
    return E.noisy_features(rows.unpivot([], ["quantity", "discount", "tax"], "feature", "attribution"), 0.6, 2)


_QUERIES = (score_curve, ranking_quality, operating_points, sensitivity_point, threshold_metrics, calibration_error, compared_models, gene_errors, gene_split_statistics, temporal_split_statistics, fold_counts, standardised_genes, sample_weights, conformal_coverage, feature_drift, gene_association, attribution_noise)

_CURVE = f"""{SCORED_CTE}, h AS (SELECT score, sum(label) AS p, sum(1 - label) AS n FROM s GROUP BY 1),
c AS (SELECT score, p, n, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS t1, sum(n) OVER () AS t0 FROM h WINDOW w AS (ORDER BY score DESC)),
k AS (SELECT score, p, n, tp::BIGINT AS tp, fp::BIGINT AS fp, tp / t1::DOUBLE AS tpr, fp / t0::DOUBLE AS fpr, tp / (tp + fp)::DOUBLE AS ppv, p / t1::DOUBLE AS step, t1, t0 FROM c)"""
_SHARE = lambda key: f"('0x' || substr(md5('42:' || {key}), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
_SPLIT_STATS = """SELECT split, count(*) AS n, sum(label)::BIGINT AS n_pos, count(DISTINCT gene_symbol) AS n_genes, sum(label) > 0 AND sum(label) < count(*) AS both_classes,
  round(count(*) / nullif(2 * sum(label), 0)::DOUBLE, 6) AS weight_pos, round(count(*) / nullif(2 * (count(*) - sum(label)), 0)::DOUBLE, 6) AS weight_neg FROM x GROUP BY split"""

_ORACLES = {
    "score_curve": f"WITH {_CURVE} SELECT score, tp, fp, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(ppv, 6) AS ppv FROM k",
    "ranking_quality": f"WITH {_CURVE} SELECT round(sum(step * ppv), 6) AS average_precision, round(sum(n * (tp - p / 2.0::DOUBLE)) / (max(t1) * max(t0))::DOUBLE, 6) AS auroc FROM k",
    "operating_points": f"""WITH {_CURVE}, m AS (SELECT max(score) AS miss FROM k WHERE ppv < 0.95)
SELECT (SELECT score FROM k ORDER BY round(abs(tpr - 0.9), 9), score DESC LIMIT 1) AS nearest_threshold, min(score) AS ppv_threshold, round(max(tpr), 6) AS ppv_sensitivity FROM k, m WHERE miss IS NULL OR score > miss""",
    "sensitivity_point": f"""WITH {SCORED_CTE}, g AS (SELECT i * (1.0::DOUBLE / 999) AS t FROM range(1000) r(i)),
c AS (SELECT t, count_if(label = 1 AND score >= t) AS tp, count_if(label = 0 AND score >= t) AS fp, count_if(label = 1 AND score < t) AS fn, count_if(label = 0 AND score < t) AS tn FROM s, g GROUP BY 1),
b AS (SELECT * FROM c ORDER BY abs(tp / (tp + fn)::DOUBLE - 0.95), t LIMIT 1), r AS (SELECT *, tp / (tp + fn)::DOUBLE AS sens, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS p FROM b)
SELECT round(t, 4) AS threshold, round(sens, 4) AS sensitivity, round(tn / nullif(tn + fp, 0)::DOUBLE, 4) AS specificity, round(p, 4) AS ppv, round(coalesce(tn / nullif(tn + fn, 0)::DOUBLE, 0), 4) AS npv,
  round(2 * p * sens / (p + sens), 4) AS f1, (tp + fp)::BIGINT AS n_flagged, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn FROM r""",
    "threshold_metrics": f"""WITH {SCORED_CTE}, t AS (SELECT unnest([{', '.join(f'{x}::DOUBLE' for x in _CUTS)}]) AS threshold),
c AS (SELECT threshold, count_if(label = 1 AND score >= threshold)::BIGINT AS tp, count_if(label = 0 AND score >= threshold)::BIGINT AS fp, count_if(label = 1 AND score < threshold)::BIGINT AS fn, count_if(label = 0 AND score < threshold)::BIGINT AS tn FROM s, t GROUP BY 1)
SELECT *, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall, round(coalesce(tn / nullif(tn + fp, 0)::DOUBLE, 0), 6) AS specificity,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1,
  round(coalesce((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) AS mcc FROM c""",
    "calibration_error": f"""WITH {SCORED_CTE}, b AS (SELECT least(floor(score * 10), 9) AS k, count(*) AS c, abs(avg(score) - avg(label)) AS g FROM s GROUP BY 1)
SELECT round(sum(c * g) / sum(c), 6) AS ece, round(max(g), 6) AS mce, sum(c)::BIGINT AS n FROM b""",
    "compared_models": f"""WITH {SCORED_CTE}, m AS (SELECT label, 'first' AS model, score FROM s UNION ALL SELECT label, 'second', (1 + score) / 2.5::DOUBLE FROM s UNION ALL SELECT label, 'constant', 0.5::DOUBLE FROM s)
SELECT model, count(*) AS n, round(avg((score - label) * (score - label)), 6) AS brier, round(avg(-CASE WHEN label = 1 THEN ln(greatest(1e-15, score)) ELSE ln(1 - least(1 - 1e-15::DOUBLE, score)) END), 6) AS log_loss,
  round(avg(((score >= 0.5)::INT = label)::INT), 6) AS accuracy FROM m GROUP BY 1""",
    "gene_errors": f"""WITH {SCORED_CTE} SELECT gene_symbol, count(*) AS n, count_if(score >= 0.5 AND label = 0)::BIGINT AS n_fp, count_if(score < 0.5 AND label = 1)::BIGINT AS n_fn,
  round(count_if((score >= 0.5) <> (label = 1)) / count(*)::DOUBLE, 6) AS error_rate FROM s GROUP BY 1""",
    "gene_split_statistics": f"WITH {NORM}, y AS (SELECT *, {_SHARE('gene_symbol')} AS u FROM l WHERE label IS NOT NULL), x AS (SELECT *, CASE WHEN u < 0.2 THEN 'test' WHEN u < 0.2::DOUBLE + 0.1::DOUBLE THEN 'val' ELSE 'train' END AS split FROM y) {_SPLIT_STATS}",
    "temporal_split_statistics": f"WITH {NORM}, x AS (SELECT *, CASE WHEN last_evaluated::DATE > DATE '1997-01-01' THEN 'holdout' ELSE 'train' END AS split FROM l WHERE label IS NOT NULL) {_SPLIT_STATS}",
    "fold_counts": f"WITH {SCORED_CTE} SELECT floor({_SHARE('variant_id')} * 5)::INT AS fold, label, count(*) AS n FROM s GROUP BY 1, 2",
    "standardised_genes": f"""WITH {SCORED_CTE}, f AS (SELECT avg(score) AS m, stddev_pop(score) AS d FROM s WHERE {_SHARE('gene_symbol')} >= 0.2::DOUBLE + 0.1::DOUBLE)
SELECT gene_symbol, round(avg((score - m) / d), 5) AS mean_z FROM s, f GROUP BY 1""",
    "sample_weights": f"""WITH {SCORED_CTE} SELECT variant_id, round(greatest(0.1, least(2.0, CASE WHEN score > 0.85 AND label = 0 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END * (1 - 0.5::DOUBLE * greatest(score, 1 - score) * ((score >= 0.5)::INT = label)::INT)
  * exp(-0.3::DOUBLE * (split_part(variant_id, '-', 1)::BIGINT % 1000) / 365))), 6) AS weight FROM s""",
    "conformal_coverage": f"""WITH {SCORED_CTE}, g AS (SELECT abs(label - score) AS gap, variant_id LIKE '%-1' AS cal FROM s), r AS (SELECT gap, row_number() OVER (ORDER BY gap) - 1 AS i, count(*) OVER () AS n FROM g WHERE cal),
h AS (SELECT n, least(1.0, ceil((n + 1) * 0.9) / n::DOUBLE) * (n - 1) AS spot FROM (SELECT max(n) AS n FROM r)),
q AS (SELECT (SELECT gap FROM r WHERE i = floor(spot)) * (1 - spot + floor(spot)) + (SELECT gap FROM r WHERE i = least(n - 1, floor(spot) + 1)) * (spot - floor(spot)) AS q FROM h)
SELECT round(max(q), 6) AS quantile, count(*) AS n, round(avg((gap <= q)::INT), 6) AS coverage FROM g, q WHERE NOT cal""",
    "feature_drift": """WITH x AS (UNPIVOT (SELECT (l_returnflag = 'R')::INT AS tag, l_quantity, l_extendedprice, l_discount FROM lineitem) ON l_quantity, l_extendedprice, l_discount INTO NAME feature VALUE x),
r AS (SELECT feature, quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi, avg(x) AS m, stddev_pop(x) AS s FROM x WHERE tag = 0 GROUP BY 1),
t AS (SELECT x.feature, count_if(tag = 0) AS ta, count_if(tag = 1) AS tb, avg(x) FILTER (tag = 1) - max(m) AS move, max(s) AS s FROM x JOIN r ON r.feature = x.feature GROUP BY 1),
c AS (SELECT x.feature, least(floor((x - lo) / (hi - lo) * 10), 9) AS bin, count_if(tag = 0) AS a, count_if(tag = 1) AS b FROM x JOIN r ON r.feature = x.feature WHERE x BETWEEN lo AND hi GROUP BY 1, 2),
g AS (SELECT t.feature, move, s, greatest(1e-4, coalesce(a, 0) / ta::DOUBLE) AS a, greatest(1e-4, coalesce(b, 0) / tb::DOUBLE) AS b FROM t CROSS JOIN range(10) k(bin) LEFT JOIN c ON c.feature = t.feature AND c.bin = k.bin),
p AS (SELECT feature, sum((b - a) * ln(b / a)) AS psi, sum(a * ln(a / ((a + b) / 2))) / 2 + sum(b * ln(b / ((a + b) / 2))) / 2 AS js, max(move) / (max(s) + 1e-9) AS shift FROM g GROUP BY 1)
SELECT feature, round(psi, 6) AS psi, round(js, 6) AS js, round(shift, 6) AS shift, CASE WHEN psi > 0.25 THEN 'retrain' WHEN psi > 0.2 THEN 'monitor' ELSE 'none' END AS action FROM p""",
    "gene_association": f"""WITH {NORM}, g AS (SELECT gene_symbol, count_if(label = 1 AND e)::DOUBLE AS a, count_if(label = 0 AND e)::DOUBLE AS b, count_if(label = 1 AND NOT e)::DOUBLE AS c, count_if(label = 0 AND NOT e)::DOUBLE AS d,
  1.959964::DOUBLE * 1.959964::DOUBLE AS z FROM (SELECT *, contains(consequence, 'missense') AS e FROM l WHERE label IS NOT NULL) GROUP BY 1), h AS (SELECT *, a + b AS m FROM g),
t AS (SELECT gene_symbol, a, k, lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) - lgamma(k + 1) - lgamma(a + b - k + 1) - lgamma(a + c - k + 1) - lgamma(d - a + k + 1) AS lp
  FROM (SELECT *, unnest(range(greatest(0, a - d)::BIGINT, least(a + b, a + c)::BIGINT + 1)) AS k FROM h)),
e AS (SELECT t.gene_symbol, least(1.0, sum(exp(lp)) FILTER (lp <= o.l + 1e-7)) AS p FROM t JOIN (SELECT gene_symbol, lp AS l FROM t WHERE k = a) o ON o.gene_symbol = t.gene_symbol GROUP BY 1)
SELECT h.gene_symbol, round(CASE WHEN b * c > 0 THEN a * d / (b * c) WHEN a * d > 0 THEN 'Infinity'::DOUBLE ELSE 'NaN'::DOUBLE END, 4) AS odds_ratio, round(p, 6) AS p_value,
  round(coalesce(sqrt(pow(greatest(0, abs(a * d - b * c) - (a + b + c + d) / 2), 2) / nullif((a + b) * (c + d) * (a + c) * (b + d), 0)), 0), 4) AS cramers_v, round(p, 6) < 0.05 AS significant,
  CASE WHEN m > 0 THEN round((a / m + z / (2 * m)) / (1 + z / m) - sqrt(z * (a / m * (1 - a / m) / m + z / (4 * m * m))) / (1 + z / m), 6) ELSE 0 END AS low,
  CASE WHEN m > 0 THEN round((a / m + z / (2 * m)) / (1 + z / m) + sqrt(z * (a / m * (1 - a / m) / m + z / (4 * m * m))) / (1 + z / m), 6) ELSE 0 END AS high FROM h JOIN e ON e.gene_symbol = h.gene_symbol""",
    "attribution_noise": """WITH x AS (UNPIVOT (SELECT l_quantity - 25 AS quantity, l_discount AS discount, l_tax - 0.02 AS tax FROM lineitem) ON quantity, discount, tax INTO NAME feature VALUE v),
g AS (SELECT feature, avg(abs(v)) AS m, stddev_pop(abs(v)) AS s, count(*) AS n FROM x GROUP BY 1)
SELECT feature, round(m, 6) AS mean_abs, round(s, 6) AS sd_abs, n, row_number() OVER (ORDER BY m DESC, feature)::INT AS rank, row_number() OVER (ORDER BY m DESC, feature) <= 2 AS in_top, s > 0.6 * m AS noisy FROM g""",
}


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict:
    return dict(_ORACLES)
