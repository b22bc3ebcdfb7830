"""Joint drift tests on bounded samples, density-ratio weights, drift reports against a stored reference, retraining decisions.

The joint tests compare pairs of rows, so they run on samples of at most `most` rows a side (3000, the documented bound), drawn by the
hash of a key: the same rows on any cluster. All other statistics are of all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from helixspark.operators import evaluation as E

#: The shift of distributions (Jensen-Shannon) that asks for retraining and the new rows it needs at least.
JS_LIMIT, JS_LEAST_ROWS = 0.05, 500


def sample(df: DataFrame, features: list[str], key: str, most: int) -> np.ndarray:
    """At most `most` rows of smallest key hash as a matrix; rows with a null, NaN or infinite feature take no part."""
    finite = [F.col(c).cast("double").alias(c) for c in features]
    rows = df.select(F.xxhash64(key).alias("_h"), F.col(key).alias("_k"), *finite)
    for c in features:
        rows = rows.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.orderBy("_h", "_k").limit(most).select(*features).toPandas().to_numpy(float)


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0.0)


def median_width(ref: np.ndarray, rows: int = 1000) -> float:
    """The median distance of the first rows to each other; 1 if all are equal."""
    d = np.sqrt(squared_distances(ref[:rows], ref[:rows]))
    d = d[d > 1e-9]
    return float(np.median(d)) if len(d) else 1.0


def joint_tests(old: DataFrame, new: DataFrame, features: list[str], key: str, most: int = 3000, permutations: int = 200, seed: int = 42, tile: int = 250) -> DataFrame:
    """One row: MMD^2 (RBF kernel, median heuristic) and energy statistic with their permutation p values, and the sampled rows.

    The pair matrix is never held: each task takes tiles of `tile` rows against the (broadcast, bounded) sample and multiplies them with
    the label vectors of all permutations at once; what is summed is one number a permutation and statistic.
    """
    spark = old.sparkSession
    a, b = sample(old, features, key, most), sample(new, features, key, most)
    if len(a) < 2 or len(b) < 2:
        return spark.createDataFrame([(0.0, 1.0, 0.0, 1.0, len(a), len(b))], "mmd double, mmd_p double, energy double, energy_p double, n_old int, n_new int")
    n, both, width = len(a), np.vstack([a, b]), median_width(a)
    rng = np.random.default_rng(seed)
    first = np.zeros((len(both), permutations + 1))
    first[:n, 0] = 1
    for p in range(1, permutations + 1):
        first[rng.permutation(len(both))[:n], p] = 1
    shared = spark.sparkContext.broadcast((both, first))

    def tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, labels = shared.value
        for batch in batches:
            for start in batch["start"]:
                part = slice(start, start + tile)
                squares = squared_distances(rows[part], rows)
                own, s = np.arange(start, min(start + tile, len(rows))), labels[part]
                out = {"permutation": np.arange(labels.shape[1])}
                for name, k in (("k", np.exp(-squares / (2 * width**2))), ("d", np.sqrt(squares))):
                    k[np.arange(len(own)), own] = 0
                    met, whole = k @ labels, k.sum(1)[:, None]
                    out |= {f"{name}xx": (s * met).sum(0), f"{name}xy": (s * (whole - met)).sum(0), f"{name}yy": ((1 - s) * (whole - met)).sum(0)}
                yield pd.DataFrame(out)

    starts = spark.range(0, len(both), tile, max(1, min(64, len(both) // tile))).withColumnRenamed("id", "start")
    sums = starts.mapInPandas(tiles, "permutation long, kxx double, kxy double, kyy double, dxx double, dxy double, dyy double").groupBy("permutation").agg(*[F.sum(c).alias(c) for c in ("kxx", "kxy", "kyy", "dxx", "dxy", "dyy")])
    m = len(b)
    mmd = F.col("kxx") / (n * (n - 1)) + F.col("kyy") / (m * (m - 1)) - 2 * F.col("kxy") / (n * m)
    energy = (F.col("dxy") / (n * m) - F.col("dxx") / (2 * n * n) - F.col("dyy") / (2 * m * m)) * (2 * n * m / (n + m))
    each = sums.select("permutation", mmd.alias("mmd"), energy.alias("energy"))
    seen = each.where("permutation = 0").select(F.col("mmd").alias("m0"), F.col("energy").alias("e0"))
    rest = each.where("permutation > 0").crossJoin(F.broadcast(seen))  # one row
    return rest.agg(F.max("m0").alias("mmd"), F.avg((F.col("mmd") >= F.col("m0")).cast("int")).alias("mmd_p"), F.max("e0").alias("energy"), F.avg((F.col("energy") >= F.col("e0")).cast("int")).alias("energy_p"), F.lit(n).alias("n_old"), F.lit(m).alias("n_new"))


def kernel(x: np.ndarray, centres: np.ndarray, width: float) -> np.ndarray:
    return np.exp(-squared_distances(x, centres) / (2 * width**2))


def density_weights(old: DataFrame, new: DataFrame, rows: DataFrame, features: list[str], key: str, width: float = 1.0, ridge: float = 0.01, basis: int = 200) -> DataFrame:
    """rows with `weight`, the density ratio new / old by least-squares importance fitting; null features count as 0.

    At most `basis` centres are drawn from the new rows by hash. H and h are sums over all rows: tasks add up basis x basis numbers, Spark
    adds the tasks' sums, and the driver solves one basis x basis system.
    """
    spark = old.sparkSession
    centres = sample(new, features, key, basis)
    if not len(centres):
        return rows.withColumn("weight", F.lit(1.0))
    shared = spark.sparkContext.broadcast(centres)

    def sums(square: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            c = shared.value
            total, count = np.zeros((len(c), len(c)) if square else (1, len(c))), 0
            for b in batches:
                k = kernel(b.to_numpy(float), c, width)
                total += k.T @ k if square else k.sum(0)[None, :]
                count += len(b)
            if count:
                yield pd.DataFrame({"i": np.arange(len(total)), "part": list(total), "n": count})

        return run

    def added(df: DataFrame, square: bool) -> np.ndarray:
        filled = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features])
        cells = filled.mapInPandas(sums(square), "i int, part array<double>, n long").select("i", "n", F.posexplode("part").alias("j", "v"))
        got = cells.groupBy("i", "j").agg((F.sum("v") / F.sum("n")).alias("v")).toPandas()  # basis x basis numbers at most
        out = np.zeros((len(centres) if square else 1, len(centres)))
        out[got["i"].to_numpy(), got["j"].to_numpy()] = got["v"].to_numpy()
        return out

    alpha = np.linalg.solve(added(old, True) + ridge * np.eye(len(centres)), added(new, False)[0])

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            k = kernel(b[features].fillna(0.0).to_numpy(float), shared.value, width)
            yield b.assign(weight=np.maximum(k @ alpha, 0.0))

    return rows.mapInPandas(weigh, StructType([*rows.schema.fields, StructField("weight", DoubleType())]))


def ks_p_value(statistic: Column, n: Column, m: Column) -> Column:
    """The asymptotic two-sample Kolmogorov-Smirnov p."""
    x = F.sqrt(n * m / (n + m)) * statistic
    series = sum(((-1) ** (k - 1) * F.exp(-2 * k * k * x * x) for k in range(1, 101)), F.lit(0.0))
    return F.when(x < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * series)))


def overall_action(features: DataFrame, mmd_p: float | None = None, top: int = 5) -> DataFrame:
    """One row from a table (feature, psi, action): features to retrain and to monitor, the first to retrain by PSI, and the action;
    mmd_p is that of the joint test, None without one."""
    p = 1.0 if mmd_p is None else mmd_p
    drifted = F.sort_array(F.collect_list(F.when(F.col("action") == "retrain", F.struct(-F.col("psi"), "feature"))))
    one = features.agg(F.count_if(F.col("action") == "retrain").alias("n_retrain"), F.count_if(F.col("action") == "monitor").alias("n_monitor"), F.array_join(F.transform(F.slice(drifted, 1, top), lambda x: x["feature"]), ",").alias("top_drifted"))
    action = F.when((F.col("n_retrain") > 3) | (F.lit(p) < 0.001), "urgent_retrain").when((F.col("n_retrain") > 0) | (F.lit(p) < 0.01), "retrain").when(F.col("n_monitor") > 0, "monitor").otherwise("none")
    return one.withColumn("action", action)


def decision(feature_report: DataFrame, label_report: DataFrame) -> DataFrame:
    """One row: retrain if the features' action asks for it or the labels' urgency does; severity is the worse of the two (0 none, 1 monitor,
    2 retrain, 3 urgent)."""
    level = lambda c: F.when(c.contains("urgent"), 3).when(c == "retrain", 2).when(c == "monitor", 1).otherwise(0)
    both = feature_report.select(level(F.col("action")).alias("f")).crossJoin(F.broadcast(label_report.select(level(F.col("urgency")).alias("l"))))  # one row each
    return both.select((F.col("f") >= 2).alias("feature_drift"), (F.col("l") >= 2).alias("label_drift"), ((F.col("f") >= 2) | (F.col("l") >= 2)).alias("should_retrain"), F.greatest("f", "l").alias("severity"))


def reference_statistics(df: DataFrame, features: list[str], bins: int = 10) -> DataFrame:
    """A row a feature: n, mean, deviation, lo and hi (1st and 99th percentile) and the counts of the bins between; to be stored and reused."""
    long = df.unpivot([], features, "feature", "x").where("x IS NOT NULL AND NOT isnan(x)")
    ends = E.exact_percentiles(long, "x", [0.01, 0.99], ["feature"]).select("feature", F.get("percentiles", F.lit(0)).alias("lo"), F.get("percentiles", F.lit(1)).alias("hi"))
    ref = long.groupBy("feature").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd")).join(ends, "feature")
    return _with_bins(long, ref, bins, "counts")


def _with_bins(long: DataFrame, ref: DataFrame, bins: int, name: str) -> DataFrame:
    k = F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    cells = long.join(F.broadcast(ref.select("feature", "lo", "hi")), "feature").where("hi > lo AND x BETWEEN lo AND hi").groupBy("feature", k.alias("bin")).agg(F.count("*").alias("c"))
    packed = cells.groupBy("feature").agg(F.map_from_entries(F.collect_list(F.struct(F.col("bin").cast("int"), "c"))).alias("_m"))
    empty = F.lit(0).cast("long")
    counts = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), empty))
    return ref.join(packed, "feature", "left").withColumn(name, F.coalesce(counts, F.array_repeat(empty, bins))).drop("_m")


def drift_against(stats: DataFrame, new: DataFrame, features: list[str], floor: float = 1e-4) -> DataFrame:
    """feature, psi, js, shifted, action of new rows against stored reference statistics; the reference rows aren't read again."""
    long = new.unpivot([], features, "feature", "x").where("x IS NOT NULL AND NOT isnan(x)")
    bins = stats.select(F.max(F.size("counts"))).first()[0] or 10
    total = long.groupBy("feature").agg(F.count("*").alias("m"))
    return compared(_with_bins(long, stats.join(total, "feature"), bins, "fresh"), floor)


def compared(counted: DataFrame, floor: float = 1e-4) -> DataFrame:
    """feature, psi, js, shifted, action of rows (feature, n, counts, m, fresh, lo, hi)."""
    share = lambda counts, n: F.transform(counts, lambda c: F.greatest(F.lit(floor), c / n))
    pairs = F.zip_with(share(F.col("counts"), F.col("n")), share(F.col("fresh"), F.col("m")), lambda a, b: F.struct(((b - a) * F.log(b / a)).alias("psi"), ((a * F.log(2 * a / (a + b)) + b * F.log(2 * b / (a + b))) / 2).alias("js")))
    total_of = lambda field: F.when(F.col("hi") > F.col("lo"), F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x[field])).otherwise(0.0)
    psi, js = total_of("psi"), total_of("js")
    action = F.when(psi > E.PSI_LEVELS[0][0], E.PSI_LEVELS[0][1]).when(psi > E.PSI_LEVELS[1][0], E.PSI_LEVELS[1][1]).otherwise("none")
    return counted.select("feature", F.round(psi, 6).alias("psi"), F.round(js, 6).alias("js"), ((js > JS_LIMIT) & (F.col("m") >= JS_LEAST_ROWS)).alias("shifted"), action.alias("action"))


def source_changes(seen: DataFrame, now: DataFrame) -> DataFrame:
    """source and status (new, removed, changed, same) of two manifests (source, fingerprint)."""
    both = seen.select("source", F.col("fingerprint").alias("_a")).join(now.select("source", F.col("fingerprint").alias("_b")), "source", "full")
    return both.select("source", F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed").otherwise("same").alias("status"))
