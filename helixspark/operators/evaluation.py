"""Evaluation, splits, weights and drift, each from grouped counts; no step orders all rows in one task."""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from helixspark.operators.selection import exact_percentiles, running_sums

#: Drift actions by population stability index.
PSI_LEVELS = [(0.25, "retrain"), (0.20, "monitor")]


def score_curve(scored: DataFrame) -> DataFrame:
    """A row a distinct score as the threshold (score >= threshold is positive): tp, fp, tpr, fpr, ppv."""
    hist = scored.groupBy("score").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n")).withColumn("_down", -F.col("score"))
    c = running_sums(hist, "_down", ["p", "n"]).withColumnsRenamed({"upto_p": "tp", "upto_n": "fp"})
    total = hist.agg(F.sum("p").alias("_tp"), F.sum("n").alias("_tn"))
    c = c.crossJoin(F.broadcast(total))  # one row
    return c.select("score", "p", "n", "tp", "fp", F.try_divide("tp", "_tp").alias("tpr"), F.try_divide("fp", "_tn").alias("fpr"), F.try_divide("tp", F.col("tp") + F.col("fp")).alias("ppv"), F.try_divide("p", "_tp").alias("recall_step"))


def ranking_quality(scored: DataFrame) -> DataFrame:
    """Average precision and AUROC in one row."""
    c = score_curve(scored)
    area = F.try_divide(F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2)), F.max("tp") * F.max("fp"))
    return c.agg(F.round(F.sum(F.col("recall_step") * F.col("ppv")), 6).alias("average_precision"), F.round(area, 6).alias("auroc"))


def grid_counts(scored: DataFrame, points: int = 1000) -> DataFrame:
    """threshold, tp, fp, fn, tn at `points` equal steps from 0 to 1 (score >= threshold is positive), from one histogram of at most points + 1 rows."""
    step = 1.0 / (points - 1)
    low = F.floor(F.col("score") * (points - 1))
    k = F.when((low + 1) * step <= F.col("score"), low + 1).when(low * step > F.col("score"), low - 1).otherwise(low)
    hist = scored.where("score IS NOT NULL").groupBy(F.least(F.lit(points - 1), F.greatest(F.lit(-1), k)).cast("int").alias("k")).agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))
    grid = scored.sparkSession.range(-1, points).select(F.col("id").cast("int").alias("k")).join(F.broadcast(hist), "k", "left").fillna(0, ["p", "n"])
    down, whole = Window.partitionBy(F.lit(0)).orderBy(F.desc("k")), Window.partitionBy(F.lit(0))  # at most points + 1 rows
    c = grid.withColumns({"tp": F.sum("p").over(down), "fp": F.sum("n").over(down), "_p": F.sum("p").over(whole), "_n": F.sum("n").over(whole)}).where("k >= 0")
    return c.select((F.col("k") * step).alias("threshold"), "tp", "fp", (F.col("_p") - F.col("tp")).alias("fn"), (F.col("_n") - F.col("fp")).alias("tn"))


def sensitivity_point(scored: DataFrame, sensitivity: float) -> DataFrame:
    """One row: the first of 1000 thresholds whose sensitivity is nearest the wanted one, with its rates and counts; none without positives."""
    c = grid_counts(scored).where("tp + fn > 0").withColumn("s", F.col("tp") / (F.col("tp") + F.col("fn")))
    best = c.agg(F.min_by(F.struct("*"), F.struct(F.abs(F.col("s") - sensitivity), F.col("threshold"))).alias("b")).where("b IS NOT NULL").select("b.*")
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    ppv, npv = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tn"), F.col("tn") + F.col("fn"))
    return best.select(F.round("threshold", 4).alias("threshold"), F.round("s", 4).alias("sensitivity"), F.round(ratio(F.col("tn"), F.col("tn") + F.col("fp")), 4).alias("specificity"),
                       F.round(ppv, 4).alias("ppv"), F.round(npv, 4).alias("npv"), F.round(ratio(2 * ppv * F.col("s"), ppv + F.col("s")), 4).alias("f1"), (F.col("tp") + F.col("fp")).alias("n_flagged"), "tp", "fp", "fn", "tn")


def operating_points(scored: DataFrame, sensitivity: float, ppv: float) -> DataFrame:
    """The threshold nearest a sensitivity (the highest of equal ones), and the lowest one before the walk down first misses the PPV."""
    c = score_curve(scored)
    miss = c.where(F.col("ppv") < ppv).agg(F.max("score").alias("_miss"))
    held = c.crossJoin(F.broadcast(miss)).where("_miss IS NULL OR score > _miss")
    near = c.agg(F.min_by("score", F.struct(F.round(F.abs(F.col("tpr") - sensitivity), 9), -F.col("score"))).alias("nearest_threshold"))
    return near.crossJoin(F.broadcast(held.agg(F.min("score").alias("ppv_threshold"), F.round(F.max("tpr"), 6).alias("ppv_sensitivity"))))


def threshold_metrics(scored: DataFrame, thresholds: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """Confusion counts and rates at fixed thresholds, all in one pass."""
    p, hit = F.col("label") == 1, lambda t: F.col("score") >= t
    counts = [F.struct(F.lit(t).alias("threshold"), F.count_if(p & hit(t)).alias("tp"), F.count_if(~p & hit(t)).alias("fp"), F.count_if(p & ~hit(t)).alias("fn"), F.count_if(~p & ~hit(t)).alias("tn")) for t in thresholds]
    rows = scored.groupBy(*by).agg(F.array(*counts).alias("r")).select(*by, F.inline("r"))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    return rows.select(*by, "threshold", "tp", "fp", "fn", "tn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(tn, tn + fp).alias("specificity"),
                       ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))).alias("mcc"))


def calibration_error(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Expected and maximum calibration error over equal-width bins, the last one closed."""
    k = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1))
    b = scored.groupBy(k).agg(F.count("*").alias("c"), F.abs(F.avg("score") - F.avg("label")).alias("g"))
    return b.agg(F.round(F.try_divide(F.sum(F.col("c") * F.col("g")), F.sum("c")), 6).alias("ece"), F.round(F.max("g"), 6).alias("mce"), F.sum("c").alias("n"))


def compared_models(scored: DataFrame, models: list[str], weight: str | None = None) -> DataFrame:
    """Brier score, log loss and accuracy of several score columns. With `weight`, a row stands for as many."""
    long = scored.unpivot(["label", *([weight] if weight else [])], models, "model", "score")
    s = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col("score")))
    mean = (lambda c: F.sum(F.col(weight) * c) / F.sum(weight)) if weight else F.avg
    return long.groupBy("model").agg((F.sum(weight) if weight else F.count("*")).alias("n"), F.round(mean((F.col("score") - F.col("label")) * (F.col("score") - F.col("label"))), 6).alias("brier"),
                                     F.round(mean(-F.when(F.col("label") == 1, F.log(s)).otherwise(F.log(1 - s))), 6).alias("log_loss"), F.round(mean(((F.col("score") >= 0.5).cast("int") == F.col("label")).cast("int")), 6).alias("accuracy"))


def group_errors(scored: DataFrame, by: str, threshold: float = 0.5) -> DataFrame:
    wrong_fp, wrong_fn = (F.col("score") >= threshold) & (F.col("label") == 0), (F.col("score") < threshold) & (F.col("label") == 1)
    g = scored.groupBy(by).agg(F.count("*").alias("n"), F.count_if(wrong_fp).alias("n_fp"), F.count_if(wrong_fn).alias("n_fn"))
    return g.withColumn("error_rate", F.round((F.col("n_fp") + F.col("n_fn")) / F.col("n"), 6))


def hash_share(key: Column, seed: int) -> Column:
    """0 to 1 from the MD5 of seed and key: the same on any cluster and in other engines."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def group_split(df: DataFrame, group: str, seed: int = 42, test: float = 0.2, val: float = 0.1) -> DataFrame:
    """`split` by the hash of the group, so that none is in two; null groups go to train."""
    u = hash_share(F.col(group), seed)
    return df.withColumn("split", F.when(u < test, "test").when(u < test + val, "val").otherwise("train"))


def temporal_split(df: DataFrame, date: str, cutoff: str) -> DataFrame:
    """Rows after the cutoff are the holdout; those without a date stay in train."""
    return df.withColumn("split", F.when(F.to_date(date) > F.lit(cutoff).cast("date"), "holdout").otherwise("train"))


def folds(df: DataFrame, key: Column, k: int, seed: int = 42) -> DataFrame:
    """`fold` by hash: labels are spread alike in expectation, without ordering a class in one task."""
    return df.withColumn("fold", F.floor(hash_share(key, seed) * k).cast("int"))


def split_statistics(df: DataFrame) -> DataFrame:
    """A row a split: rows, positives, genes, both classes, and the weight n / (2 n_c) of either class."""
    g = df.groupBy("split").agg(F.count("*").alias("n"), F.sum("label").alias("n_pos"), F.count_distinct("gene_symbol").alias("n_genes"))
    return g.withColumns({"both_classes": (F.col("n_pos") > 0) & (F.col("n_pos") < F.col("n")), "weight_pos": F.round(F.try_divide("n", 2 * F.col("n_pos")), 6), "weight_neg": F.round(F.try_divide("n", 2 * (F.col("n") - F.col("n_pos"))), 6)})


def moments(df: DataFrame, columns: list[str], by: Sequence[str] = (), block: int = 8) -> DataFrame:
    """A row a group and column: by, column, n (values that are not null), mean, population deviation.

    Each block of columns is an aggregate of its own, since one over hundreds of sums is too long a method for the JVM to compile. Of a table of
    more than a block, give one that is written: each block then reads its own columns only.
    """
    parts = []
    for names in (columns[k : k + block] for k in range(0, len(columns), block)):
        found = df.groupBy(*by).agg(*[f(F.col(c).cast("double")).alias(f"_{n}_{c}") for c in names for n, f in (("n", F.count), ("m", F.avg), ("s", F.stddev_pop))])
        rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_n_{c}").alias("n"), F.col(f"_m_{c}").alias("mean"), F.col(f"_s_{c}").alias("deviation")) for c in names])
        parts.append(found.select(*by, F.inline(rows)))
    return reduce(lambda a, b: a.union(b), parts)


def fitted_moments(df: DataFrame, columns: list[str], fit: Column) -> dict[str, tuple[float | None, float | None]]:
    """column: mean and population deviation of the rows where `fit` holds; a deviation of 0 counts as 1."""
    return {r["column"]: (r["mean"], r["deviation"] or 1.0) for r in moments(df.where(fit), columns).collect()}  # two numbers a column


def standardised(df: DataFrame, columns: list[str], fit: Column, step: int = 20, fitted: dict[str, tuple[float | None, float | None]] | None = None) -> DataFrame:
    """Columns scaled by `fitted`, or else the moments of the rows where `fit` holds, some at a time: an observed step in between keeps all
    of them from becoming one method, too long for the JVM to compile."""
    fitted = fitted or fitted_moments(df, columns, fit)
    for k in range(0, len(columns), step):
        df = df.observe(f"scaled-{uuid.uuid4().hex}", F.count("*").alias("n")) if k else df
        df = df.withColumns({c: (F.col(c) - F.lit(fitted[c][0]).cast("double")) / F.lit(fitted[c][1]).cast("double") for c in columns[k : k + step]})
    return df


def sample_weights(df: DataFrame, reclassified: DataFrame, key: str, decay: float = 0.5, boost: float = 2.0, yearly: float = 0.3) -> DataFrame:
    """`weight`: confident (the larger of score and 1 - score) and right rows count less, reclassified ids get the boost as a factor, old
    ones (days_old; null doesn't fade) fade; within 0.1 and the boost."""
    sure = F.greatest(F.col("score"), 1 - F.col("score")) * ((F.col("score") >= 0.5).cast("int") == F.col("label")).cast("double")
    out = df.join(reclassified.select(key).distinct().withColumn("_flip", F.lit(True)), key, "left")
    w = (1 - decay * sure) * F.when(F.col("_flip"), F.lit(boost)).otherwise(1.0) * F.coalesce(F.exp(-yearly * F.col("days_old") / 365), F.lit(1.0))
    return out.withColumn("weight", F.greatest(F.lit(0.1), F.least(F.lit(boost), w))).drop("_flip")


def conformal_intervals(scored: DataFrame, calibration: Column, alpha: float = 0.1) -> DataFrame:
    """The rows outside the calibration rows with `quantile` (of |label - score| on those), `lower`, `upper` (within 0 to 1) and `covered`; all four null
    without calibration rows."""
    gap = F.abs(F.col("label") - F.col("score"))
    n = scored.where(calibration).agg(F.count("*").alias("n_cal")).first()[0]
    level = min(1.0, -(-(n + 1) * (1 - alpha) // 1) / n) if n else 1.0
    found = exact_percentiles(scored.where(calibration).select(gap.alias("gap")), "gap", [level]).first()
    q = F.lit(found["percentiles"][0] if found else None).cast("double")
    bound = lambda x: F.when(q.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))
    return scored.where(~calibration).withColumns({"quantile": q, "lower": bound(F.col("score") - q), "upper": bound(F.col("score") + q), "covered": gap <= q})


def conformal(scored: DataFrame, calibration: Column, alpha: float = 0.1) -> DataFrame:
    """One row: the quantile of |label - score| on the calibration rows, and how many of the others their intervals cover."""
    rest = conformal_intervals(scored, calibration, alpha)
    return rest.agg(F.round(F.max("quantile"), 6).alias("quantile"), F.count("*").alias("n"), F.round(F.avg(F.col("covered").cast("int")), 6).alias("coverage"))


def feature_drift(df: DataFrame, features: list[str], tag: str, bins: int = 10) -> DataFrame:
    """A row a feature: PSI (equal-width bins over the reference's 1st to 99th percentile, shares of all rows, floor 1e-4), Jensen-Shannon, shift, action."""
    long = df.unpivot([tag], features, "feature", "x").where("x IS NOT NULL AND NOT isnan(x)")
    old_rows = long.where(F.col(tag) == 0)
    ends = exact_percentiles(old_rows, "x", [0.01, 0.99], ["feature"]).select("feature", F.get("percentiles", F.lit(0)).alias("lo"), F.get("percentiles", F.lit(1)).alias("hi"))
    ref = old_rows.groupBy("feature").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).join(ends, "feature")
    k = F.when((F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi")), F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)))
    old, new = F.count_if(F.col(tag) == 0), F.count_if(F.col(tag) == 1)
    joined = long.join(F.broadcast(ref), "feature")  # a row a feature
    total = joined.groupBy("feature").agg(old.alias("ta"), new.alias("tb"), F.first("s").alias("s"), (F.avg(F.when(F.col(tag) == 1, F.col("x"))) - F.first("m")).alias("move"))
    counted = joined.where("hi > lo").groupBy("feature", k.alias("bin")).agg(old.alias("a"), new.alias("b")).where("bin IS NOT NULL")
    grid = total.select("feature", "ta", "tb", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")).join(counted, ["feature", "bin"], "left")
    a, b = (F.greatest(F.lit(1e-4), F.coalesce(F.try_divide(F.coalesce(c, F.lit(0)), t), F.lit(0.0))) for c, t in (("a", "ta"), ("b", "tb")))
    mid = (a + b) / 2
    parts = grid.groupBy("feature").agg(F.sum((b - a) * F.log(b / a)).alias("psi"), (F.sum(a * F.log(a / mid)) / 2 + F.sum(b * F.log(b / mid)) / 2).alias("js"))
    psi = F.col("psi")
    action = F.when(psi > PSI_LEVELS[0][0], PSI_LEVELS[0][1]).when(psi > PSI_LEVELS[1][0], PSI_LEVELS[1][1]).otherwise("none")
    return parts.join(total, "feature").select("feature", F.round("psi", 6).alias("psi"), F.round("js", 6).alias("js"), F.round(F.col("move") / (F.col("s") + 1e-9), 6).alias("shift"), action.alias("action"))


@pandas_udf(DoubleType())
def fisher_exact(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """Two-sided p of a 2 x 2 table: the probabilities of all tables with its margins that are no likelier than it.

    Terms further than 40 deviations from the mean are below 1e-300 and left out, so a row's work grows with the deviation only.
    """

    def one(a: float, b: float, c: float, d: float) -> float:
        row, column, n = a + b, a + c, a + b + c + d
        if n <= 0:
            return 1.0
        lo, hi, mean = max(0.0, row + column - n), min(row, column), row * column / n
        reach = 40 * math.sqrt(max(1.0, mean * (1 - row / n) * (1 - column / n))) + 40
        k = np.arange(max(lo, min(a, math.floor(mean - reach))), min(hi, max(a, math.ceil(mean + reach))) + 1)
        start = k[0]
        first = sum(math.lgamma(x + 1) for x in (row, n - row, column, n - column)) - sum(math.lgamma(x + 1) for x in (n, start, row - start, column - start, n - row - column + start))
        step = np.log((row - k[:-1]) * (column - k[:-1])) - np.log((k[:-1] + 1) * (n - row - column + k[:-1] + 1))
        p = first + np.concatenate([[0.0], np.cumsum(step)])
        return float(min(1.0, np.exp(p[p <= p[int(a - start)] + 1e-7]).sum()))

    return pd.Series([one(*x) for x in zip(a, b, c, d)])


def association(df: DataFrame, by: str, exposed: Column) -> DataFrame:
    """2 x 2 counts of label against `exposed` by group: odds ratio (infinite or NaN at empty cells), exact two-sided p, Cramer's V of the
    chi-square with continuity correction, Wilson interval of the exposed rate ((0, 0) if none is exposed)."""
    p = F.col("label") == 1
    g = df.groupBy(by).agg(F.count_if(p & exposed).cast("double").alias("a"), F.count_if(~p & exposed).cast("double").alias("b"), F.count_if(p & ~exposed).cast("double").alias("c"), F.count_if(~p & ~exposed).cast("double").alias("d"))
    n, cross, margins = "(a + b + c + d)", "abs(a * d - b * c)", "((a + b) * (c + d) * (a + c) * (b + d))"
    v = f"coalesce(sqrt(pow({cross} - least({cross}, {n} / 2), 2) / nullif({margins}, 0)), 0)"
    odds = "CASE WHEN b * c > 0 THEN a * d / (b * c) WHEN a * d > 0 THEN double('Infinity') ELSE double('NaN') END"
    out = g.withColumns({"odds_ratio": F.expr(f"round({odds}, 4)"), "p_value": F.round(fisher_exact("a", "b", "c", "d"), 6), "cramers_v": F.expr(f"round({v}, 4)"), "m": F.expr("a + b"), "z2": F.lit(1.959964 * 1.959964)})
    mid, half = "(a / m + z2 / (2 * m)) / (1 + z2 / m)", "sqrt(z2 * (a / m * (1 - a / m) / m + z2 / (4 * m * m))) / (1 + z2 / m)"
    return out.select(by, "odds_ratio", "p_value", "cramers_v", (F.col("p_value") < 0.05).alias("significant"), *[F.expr(f"CASE WHEN m > 0 THEN round({mid} {sign} {half}, 6) ELSE 0.0D END").alias(n) for sign, n in (("-", "low"), ("+", "high"))])


def noisy_features(long: DataFrame, limit: float = 1.0, top: int = 5) -> DataFrame:
    """feature, mean and deviation of |attribution|, rank, whether it varies more than `limit` means; long is (feature, attribution)."""
    g = long.groupBy("feature").agg(F.avg(F.abs("attribution")).alias("m"), F.stddev_pop(F.abs("attribution")).alias("s"), F.count("*").alias("n"))
    rank = F.row_number().over(Window.orderBy(F.desc("m"), "feature"))  # a row a feature
    return g.select("feature", F.round("m", 6).alias("mean_abs"), F.round("s", 6).alias("sd_abs"), "n", rank.alias("rank"), (rank <= top).alias("in_top"), (F.col("s") > limit * F.col("m")).alias("noisy"))
