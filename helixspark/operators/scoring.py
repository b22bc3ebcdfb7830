"""Score tables: intervals by resampling, reliability, calibration by temperature, tiers, blends, rankings."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixspark.operators import evaluation as E
from helixspark.operators.selection import sliced

#: Tiers (name, lower bound excluded, upper bound included), in order.
TIERS = [("Pathogenic", 0.90, 1.01), ("Likely pathogenic", 0.70, 0.90), ("Uncertain significance", 0.30, 0.70), ("Likely benign", 0.10, 0.30), ("Benign", -0.01, 0.10)]
#: Coarse class of consequence terms.
COARSE = {
    "missense_variant": "missense", "protein_altering_variant": "missense", "stop_gained": "lof", "frameshift_variant": "lof", "stop_lost": "lof", "start_lost": "lof",
    "transcript_ablation": "lof", "splice_donor_variant": "splice", "splice_acceptor_variant": "splice", "splice_region_variant": "splice", "synonymous_variant": "synonymous", "coding_sequence_variant": "synonymous",
}


def coarse_consequence(consequence: Column) -> Column:
    """By substring, the first that holds."""
    low = F.lower(F.coalesce(consequence, F.lit("unknown")))
    return (
        F.when(low.rlike("stop_gained|frameshift|splice_donor|splice_acceptor|start_lost"), "loss_of_function").when(low.contains("missense"), "missense")
        .when(low.contains("synonymous"), "synonymous").when(low.contains("splice"), "splice_region").when(low.contains("inframe"), "inframe_indel").otherwise("other")
    )


def consequence_class(consequence: Column) -> Column:
    """By exact term."""
    table = F.create_map(*[F.lit(x) for kv in COARSE.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.trim(consequence)), F.lit("other"))


def tier(score: Column, tiers: list[tuple[str, float, float]] = TIERS) -> tuple[Column, Column]:
    """Tier and confidence of a score: by the distance to the nearer bound of its tier."""
    name, sure = F, F
    for label, lo, hi in tiers:
        inside, margin = (score > lo) & (score <= hi), F.least(score - lo, hi - score)
        name = name.when(inside, label)
        sure = sure.when(inside, F.when(margin >= 0.15, "high").when(margin >= 0.05, "medium").otherwise("low"))
    return name.otherwise("Uncertain significance"), sure.otherwise("low")


def _uniform(score: np.ndarray, salt: int, replicates: int) -> np.ndarray:
    """A number in (0, 1) for each score and replicate, from a hash: the same wherever a cell is computed."""

    def mix(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    step = np.uint64(0x9E3779B97F4A7C15)
    cell, turn = mix(score.view(np.uint64) + np.uint64(salt) * step), mix(np.arange(1, replicates + 1, dtype=np.uint64) * step)
    return ((mix(cell[:, None] + turn[None, :]) >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)


def poisson_counts(counts: np.ndarray, score: np.ndarray, salt: int, replicates: int) -> np.ndarray:
    """cells x (replicates + 1): column 0 the counts themselves, the others Poisson draws with the counts as means."""
    out = np.zeros((len(counts), replicates + 1))
    out[:, 0] = counts
    for mean in np.unique(counts[counts > 0]):
        rows = np.flatnonzero(counts == mean)
        u = _uniform(score[rows], salt, replicates)
        if mean <= 1000:
            k = np.arange(int(mean + 12 * math.sqrt(mean)) + 20)
            log_p = k * math.log(mean) - mean - np.concatenate([[0.0], np.cumsum(np.log(k[1:]))])
            out[rows, 1:] = np.searchsorted(np.cumsum(np.exp(log_p))[:-1], u)
        else:  # the normal limit
            normal = np.sqrt(-2 * np.log(u)) * np.cos(2 * math.pi * _uniform(score[rows], salt + 7919, replicates))
            out[rows, 1:] = np.maximum(0, np.round(mean + math.sqrt(mean) * normal))
    return out


def resampled(scored: DataFrame, replicates: int = 1000, ci: float = 0.95, seed: int = 42, slices: int = 256, chunk: int = 1000) -> DataFrame:
    """One row: AUROC and average precision of the rows and their percentile intervals over resamples of the rows.

    Rows are counted by distinct score and label; a cell's count in a replicate is Poisson with the cell's count as its mean (the
    bootstrap's limit), drawn from a hash of (seed, replicate, score, label). All replicates go through the sliced running sums
    together, as columns of one array: a pass for the slices' totals, a pass for the sums inside each slice. A task holds one slice's
    cells and chunk x replicates draws; the driver gets 4 numbers for each slice and replicate. Replicates with one class only don't count.
    """
    hist = scored.where("score IS NOT NULL").groupBy(F.col("score").cast("double").alias("score")).agg(F.sum("label").cast("double").alias("p"), F.sum(1 - F.col("label")).cast("double").alias("n"))
    cells = sliced(hist.withColumn("down", -F.col("score")), "down", slices)

    def drawn(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        score = part["score"].to_numpy() + 0.0  # -0.0 is 0.0
        return tuple(poisson_counts(part[c].to_numpy(), score, 2 * seed + k, replicates) for k, c in enumerate(("p", "n")))

    def totals(of: pd.DataFrame) -> pd.DataFrame:
        p = n = 0
        for at in range(0, len(of), chunk):
            a, b = drawn(of.iloc[at : at + chunk])
            p, n = p + a.sum(axis=0), n + b.sum(axis=0)
        return pd.DataFrame({"slice": [of["_slice"].iloc[0]], "p": [p.tobytes()], "n": [n.tobytes()]})

    found = sorted(cells.groupBy("_slice").applyInPandas(totals, "slice int, p binary, n binary").collect())
    if not found:
        return scored.sparkSession.createDataFrame([(None,) * 6 + (0,)], _INTERVALS)
    per_slice = {k: np.array([np.frombuffer(r[k]) for r in found]) for k in ("p", "n")}
    before = {r["slice"]: tuple(per_slice[k][:i].sum(axis=0) for k in ("p", "n")) for i, r in enumerate(found)}

    def sums(of: pd.DataFrame) -> pd.DataFrame:
        tp, fp = before[of["_slice"].iloc[0]]
        of = of.sort_values("down")
        area = precision = 0
        for at in range(0, len(of), chunk):
            p, n = drawn(of.iloc[at : at + chunk])
            tps, fps = tp + np.cumsum(p, axis=0), fp + np.cumsum(n, axis=0)
            area = area + (n * (tps - p / 2)).sum(axis=0)
            precision = precision + (p * tps / np.maximum(tps + fps, 1)).sum(axis=0)
            tp, fp = tps[-1], fps[-1]
        return pd.DataFrame({"area": [area.tobytes()], "precision": [precision.tobytes()]})

    parts = cells.groupBy("_slice").applyInPandas(sums, "area binary, precision binary").collect()
    positives, negatives = (per_slice[k].sum(axis=0) for k in ("p", "n"))
    area, precision = (np.sum([np.frombuffer(r[k]) for r in parts], axis=0) for k in ("area", "precision"))
    both = (positives > 0) & (negatives > 0)
    row: list[float | int | None] = []
    for sums_, total in ((area, positives * negatives), (precision, positives)):
        value = np.divide(sums_, total, out=np.full(len(total), np.nan), where=both)
        later = value[1:][both[1:]]
        row += [float(value[0]) if both[0] else None, *([float(x) for x in np.percentile(later, [50 * (1 - ci), 50 * (1 + ci)])] if len(later) else [None, None])]
    return scored.sparkSession.createDataFrame([(*row, int(both[1:].sum()))], _INTERVALS)


_INTERVALS = "auroc double, auroc_low double, auroc_high double, ap double, ap_low double, ap_high double, n_replicates long"


def reliability(scored: DataFrame, bins: int = 15, by: str | None = None, least: int = 50) -> DataFrame:
    """Reliability table of half-open equal-width bins, empty ones kept (mean_prob their middle, fraction null), with ECE and MCE; over all
    rows as group 'all' and, if `by` is given, for each group of at least `least` rows. A score of 1 is in no bin but counts in n."""
    groups = scored.withColumn("group", F.lit("all"))
    if by is not None:
        groups = groups.select("group", "score", "label").union(scored.select(F.col(by), "score", "label"))
    width = 1.0 / bins
    low = F.floor(F.col("score") * bins)
    k = F.when((low + 1) * width <= F.col("score"), low + 1).when(low * width > F.col("score"), low - 1).otherwise(low)
    cells = groups.groupBy("group", k.cast("int").alias("bin")).agg(F.count("*").alias("count"), F.avg("score").alias("m"), F.avg("label").alias("f"))
    total = cells.groupBy("group").agg(F.sum("count").alias("n")).where((F.col("group") == "all") | (F.col("n") >= least))
    gap = F.abs(F.col("m") - F.col("f"))
    inside = cells.where(F.col("bin").between(0, bins - 1))
    errors = inside.join(total, "group").groupBy("group").agg(F.sum(gap * F.col("count") / F.col("n")).alias("ece"), F.max(gap).alias("mce"))
    grid = total.select("group", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = grid.join(inside, ["group", "bin"], "left").join(errors, "group", "left")
    middle = (F.col("bin") + 0.5) * width
    return out.select("group", F.round(F.col("bin") * width, 4).alias("bin_lower"), F.round((F.col("bin") + 1) * width, 4).alias("bin_upper"), F.round(F.coalesce("m", middle), 4).alias("mean_prob"), F.round("f", 4).alias("fraction_pos"),
                      F.coalesce("count", F.lit(0)).alias("count"), F.round(F.coalesce("ece", F.lit(0.0)), 4).alias("ece"), F.round(F.coalesce("mce", F.lit(0.0)), 4).alias("mce"))


def temperature(scored: DataFrame, least: float = 0.01, most: float = 10.0, rounds: int = 6, points: int = 21) -> float:
    """The temperature that minimises the negative log likelihood of sigmoid(logit / T): rounds of a grid that narrows around its best
    point, each one aggregate of all its points over the rows; the driver sees `points` numbers a round."""
    eps = 1e-7
    logit = F.log((F.col("score") + eps) / (1 - F.col("score") + eps))
    hist = scored.groupBy("score").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))
    lo, hi = math.log(least), math.log(most)
    for _ in range(rounds):
        grid = [math.exp(lo + (hi - lo) * k / (points - 1)) for k in range(points)]

        def loss(t: float) -> Column:
            q = 1 / (1 + F.exp(-logit / t))
            return F.sum(-F.col("p") * F.log(q + eps) - F.col("n") * F.log(1 - q + eps))

        found = hist.agg(*[loss(t).alias(f"t{k}") for k, t in enumerate(grid)]).first()
        if found[0] is None:
            return 1.0
        best = min(range(points), key=lambda k: found[k])
        lo, hi = math.log(grid[max(0, best - 1)]), math.log(grid[min(points - 1, best + 1)])
    return math.exp((lo + hi) / 2)


def tempered(scored: DataFrame, t: float) -> DataFrame:
    """`calibrated`: sigmoid(logit(score) / t)."""
    logit = F.log((F.col("score") + 1e-7) / (1 - F.col("score") + 1e-7))
    return scored.withColumn("calibrated", 1 / (1 + F.exp(-logit / F.lit(t))))


def ppv_threshold(scored: DataFrame, target: float, digits: int = 4, mode: str = "highest") -> DataFrame:
    """One row: a threshold whose PPV reaches the target, 'highest' or 'lowest' of them; if none does, the one of the best PPV (the lowest of
    equal ones). Scores are rounded to `digits` places, so that the walk is over a bounded histogram."""
    c = E.score_curve(scored.withColumn("score", F.round("score", digits)))
    pick = F.max if mode == "highest" else F.min
    return c.agg(F.coalesce(pick(F.when(F.col("ppv") >= target, F.col("score"))), F.min_by("score", F.struct(-F.col("ppv"), F.col("score")))).alias("threshold"))


def tier_bounds(scored: DataFrame, pathogenic: float = 0.95, likely: float = 0.90) -> DataFrame:
    """A row a tier with its bounds: PPV-anchored thresholds of the scores and, mirrored, of the inverted scores, clamped into order."""
    mirrored = scored.select((1 - F.col("score")).alias("score"), (1 - F.col("label")).alias("label"))
    one = ppv_threshold(scored, pathogenic).select(F.col("threshold").alias("p"))
    for name, rows, target in (("l", scored, likely), ("b", mirrored, pathogenic), ("m", mirrored, likely)):
        one = one.crossJoin(F.broadcast(ppv_threshold(rows, target).select(F.col("threshold").alias(name))))  # one row each
    one = one.withColumns({"b": 1 - F.col("b"), "m": 1 - F.col("m")}).withColumns({"bh": F.least("b", "m"), "lh": F.least("m", "l")})
    r = lambda c: F.round(c, 4)
    bounds = [("Pathogenic", r("p"), F.lit(1.01)), ("Likely pathogenic", r("l"), r("p")), ("Uncertain significance", r("bh"), r("lh")), ("Likely benign", r("bh"), r("lh")), ("Benign", F.lit(-0.01), r("b"))]
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("tier"), lo.alias("lo"), hi.alias("hi")) for n, lo, hi in bounds])).alias("t")).select("t.*")


def blended(scored: DataFrame, models: list[str], weights: list[float] | None = None) -> DataFrame:
    """`blend`: the weighted mean of the models' scores; equal weights by default."""
    w = weights or [1.0] * len(models)
    return scored.withColumn("blend", sum((F.col(m) * x for m, x in zip(models, w)), F.lit(0.0)) / float(sum(w)))


def best_blend(scored: DataFrame, models: list[str], step: int = 4) -> DataFrame:
    """One row: the convex weights (multiples of 1 / step) with the smallest Brier score, all candidates in one pass: the score of any
    blend follows from the models' moments with each other and with the label."""
    pairs = [(i, j) for i in range(len(models)) for j in range(i, len(models))]
    one = scored.agg(F.count("*").alias("n"), F.avg("label").alias("yy"), *[F.avg(F.col(m) * F.col("label")).alias(f"y{i}") for i, m in enumerate(models)], *[F.avg(F.col(models[i]) * F.col(models[j])).alias(f"c{i}_{j}") for i, j in pairs])

    def simplex(parts: int, left: int) -> list[list[int]]:
        return [[left]] if parts == 1 else [[k, *rest] for k in range(left + 1) for rest in simplex(parts - 1, left - k)]

    candidates = [[k / step for k in ks] for ks in simplex(len(models), step)]
    loss = lambda w: F.col("yy") - 2 * sum((w[i] * F.col(f"y{i}") for i in range(len(models))), F.lit(0.0)) + sum(((1 if i == j else 2) * w[i] * w[j] * F.col(f"c{i}_{j}") for i, j in pairs), F.lit(0.0))
    rows = one.select("n", F.explode(F.array(*[F.struct(F.round(loss(w), 9).alias("brier"), *[F.lit(x).alias(m) for m, x in zip(models, w)]) for w in candidates])).alias("b"))
    best = rows.agg(F.min("b").alias("b"), F.max("n").alias("n")).select("n", F.round("b.brier", 6).alias("brier"), *[F.col(f"b.{m}").alias(m) for m in models])
    return best


def scored_in_tiers(scored: DataFrame) -> DataFrame:
    """Adds `tier` and `confidence`."""
    name, sure = tier(F.col("score"))
    return scored.withColumns({"tier": name, "confidence": sure})


def best_threshold(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """One row: the threshold of the best F1, the first of equal ones."""
    return E.threshold_metrics(scored, thresholds).agg(F.min_by(F.struct("threshold", "f1", "precision", "recall"), F.struct(-F.col("f1"), F.col("threshold"))).alias("b")).select("b.*")


def macro_f1(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row: F1 of both classes, macro and weighted by class size."""
    hit, p = F.col("score") >= threshold, F.col("label") == 1
    c = scored.agg(F.count_if(p & hit).alias("tp"), F.count_if(~p & hit).alias("fp"), F.count_if(p & ~hit).alias("fn"), F.count_if(~p & ~hit).alias("tn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    one, zero = ratio(2 * tp, 2 * tp + fp + fn), ratio(2 * tn, 2 * tn + fp + fn)
    return c.select(F.round(one, 6).alias("f1_positive"), F.round(zero, 6).alias("f1_negative"), F.round((one + zero) / 2, 6).alias("f1_macro"), F.round(ratio(one * (tp + fn) + zero * (tn + fp), tp + fp + fn + tn), 6).alias("f1_weighted"))


def ranking_stability(first: DataFrame, second: DataFrame, delta: float = 0.5) -> DataFrame:
    """A row a feature that both rankings (feature, importance) have: fractional change, its severity, and the Spearman correlation of the
    shared features' ranks (the same in each row). A ranking has a row a feature, so its windows are small."""
    both = first.select("feature", F.col("importance").alias("now")).join(second.select("feature", F.col("importance").alias("before")), "feature")
    rank = lambda c: F.rank().over(Window.orderBy(F.desc(c))) + (F.count("*").over(Window.partitionBy(c)) - 1) / 2.0
    ranked = both.withColumns({"_a": rank("now"), "_b": rank("before")})
    rho = F.corr("_a", "_b").over(Window.partitionBy(F.lit(0)))
    change = F.try_divide(F.abs(F.col("now") - F.col("before")), F.col("before"))
    return ranked.select("feature", "now", "before", F.round(change, 6).alias("change"), F.when(change > 2 * delta, "high").when(change >= delta, "medium").alias("severity"), F.round(rho, 6).alias("spearman"))


def unexpected_features(ranking: DataFrame, expected: list[str], top: int = 10) -> DataFrame:
    """feature and rank of the first `top` features that are not expected there."""
    ranked = ranking.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")))
    return ranked.where((F.col("rank") <= top) & ~F.col("feature").isin(*expected)).select("feature", "rank")


def combined_weights(df: DataFrame, first: str, second: str) -> DataFrame:
    """`combined`: the geometric mean of two weights (each at least 0.1), within 0.1 and 3."""
    w = F.sqrt(F.greatest(F.col(first), F.lit(0.1)) * F.greatest(F.col(second), F.lit(0.1)))
    return df.withColumn("combined", F.greatest(F.lit(0.1), F.least(F.lit(3.0), w)))


def retention(scored: DataFrame, cohort: str, threshold: float = 0.5) -> DataFrame:
    """Accuracy of one model on each cohort."""
    right = ((F.col("score") >= threshold).cast("int") == F.col("label")).cast("int")
    return scored.groupBy(cohort).agg(F.count("*").alias("n"), F.round(F.avg(right), 6).alias("accuracy"))


def quantile_bins(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Calibration curve over bins between the scores' quantiles; equal scores share a bin, empty bins are left out."""
    edges = E.exact_percentiles(scored, "score", [k / bins for k in range(bins + 1)]).select(F.col("percentiles").alias("_e"))
    inner = F.slice("_e", 2, bins - 1)
    k = F.size(F.filter(inner, lambda e: e < F.col("score")))
    return scored.crossJoin(F.broadcast(edges)).groupBy(k.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.avg("label"), 6).alias("positive_rate"))


def grouped_quality(scored: DataFrame, by: str, least: int = 20) -> DataFrame:
    """AUROC and average precision of each group with at least `least` rows and both classes."""
    hist = scored.groupBy(by, "score").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))
    c = E.running_sums(hist.withColumn("_down", -F.col("score")), "_down", ["p", "n"], by=[by]).withColumnsRenamed({"upto_p": "tp", "upto_n": "fp"})
    g = c.groupBy(by).agg(F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"), F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2)).alias("u"), F.sum(F.col("p") * F.try_divide("tp", F.col("tp") + F.col("fp"))).alias("a"))
    g = g.where((F.col("n_pos") + F.col("n_neg") >= least) & (F.col("n_pos") > 0) & (F.col("n_neg") > 0))
    return g.select(by, "n_pos", "n_neg", F.round(F.col("u") / (F.col("n_pos") * F.col("n_neg")), 6).alias("auroc"), F.round(F.col("a") / F.col("n_pos"), 6).alias("average_precision"))


def stratified_folds(df: DataFrame, key: Column, label: str, k: int, seed: int = 42, slices: int = 64) -> DataFrame:
    """`fold`: within each label the rows in hash order, dealt in turn; a label is numbered by hash slices, so no task orders all of it."""
    u = E.hash_share(key, seed)
    cut = df.withColumns({"_u": u, "_slice": F.floor(u * slices).cast("int")})
    counts = cut.groupBy(label, "_slice").agg(F.count("*").alias("_n"))
    base = counts.select(label, "_slice", F.coalesce(F.sum("_n").over(Window.partitionBy(label).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = cut.withColumn("_i", F.row_number().over(Window.partitionBy(label, "_slice").orderBy("_u", key)) - 1)
    out = inside.join(F.broadcast(base), [label, "_slice"])  # labels x slices rows
    return out.withColumn("fold", ((F.col("_base") + F.col("_i")) % k).cast("int")).drop("_u", "_slice", "_i", "_base")
