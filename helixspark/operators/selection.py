"""Order statistics and running sums without a task that holds or orders all rows.

Axes are cut at approximate quantiles (mergeable sketches); slices are ordered by themselves and their totals, a few numbers each,
give what lies before. Percentiles are exact: sketches bracket the wanted ranks, and only the values inside the brackets are counted.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Sides of up to so many rows are broadcast.
FEW = 100_000
#: Groups of up to so many rows are one slice, which a task orders by itself.
SMALL = 100_000


def joined_by(rows: DataFrame, side: DataFrame, keys: Sequence[str], how: str = "inner", small: bool = False) -> DataFrame:
    """Join on keys whose nulls are equal; without keys every row meets the one row of side. A side known to be small is broadcast."""
    if not keys:
        return rows.crossJoin(F.broadcast(side))  # one row
    renamed = side.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys))
    return rows.join(F.broadcast(renamed) if small else renamed, same, how).drop(*[f"_key_{k}" for k in keys])


def kept(df: DataFrame) -> DataFrame:
    """The rows, made once: a checkpoint where its folder is set."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def _few(df: DataFrame) -> bool:
    return df.limit(FEW + 1).count() <= FEW


def sliced(df: DataFrame, order: str, slices: int = 256, by: Sequence[str] = (), small: int = SMALL) -> DataFrame:
    """`_slice`: of each group's axis of `order`, cut at approximate quantiles of the rows; nulls are in the first one. Groups of up to
    `small` rows are not cut; there are at most rows / small others, so their cuts are broadcast."""
    rows = joined_by(df, df.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > small).drop("_n"), by, "left_semi", True) if by else df
    edges = rows.groupBy(*by).agg(F.array_distinct(F.percentile_approx(order, [k / slices for k in range(1, slices)], 20 * slices)).alias("_edges"))
    cut = F.coalesce(F.size(F.filter("_edges", lambda e: e <= F.col(order))), F.lit(0))
    return joined_by(df, edges, by, "left", True).withColumn("_slice", F.greatest(cut, F.lit(0))).drop("_edges")


def running_sums(df: DataFrame, order: str, values: list[str], slices: int = 256, by: Sequence[str] = (), small: int = SMALL) -> DataFrame:
    """Adds `upto_<v>` (sum of v over rows of an equal or smaller `order`, in the row's group) and `next_<order>`; a group's rows have
    distinct values of `order`. Null values of `order` come first.

    Every slice of a group is ordered by itself; the slices' totals (at most `slices` rows a group of more than `small` rows) give what
    lies before it.
    """
    cutted = sliced(df, order, slices, by, small)
    w, across = Window.partitionBy(*by, "_slice").orderBy(order), Window.partitionBy(*by).orderBy("_slice")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    totals = cutted.groupBy(*by, "_slice").agg(F.min(order).alias("_least"), *[F.sum(v).alias(f"_{v}") for v in values])
    totals = totals.select(*by, "_slice", F.lead("_least").over(across).alias("_following"), *[F.sum(f"_{v}").over(before).alias(f"_{v}") for v in values])
    totals = totals.where(" OR ".join(f"`{c}` IS NOT NULL" for c in ("_following", *[f"_{v}" for v in values])))  # of cut groups only
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    inner = cutted.withColumns({f"upto_{v}": F.sum(v).over(upto) for v in values} | {f"next_{order}": F.lead(order).over(w)})
    out = joined_by(inner, totals, [*by, "_slice"], "left", True)
    return out.withColumns({f"upto_{v}": F.col(f"upto_{v}") + F.coalesce(f"_{v}", F.lit(0)) for v in values} | {f"next_{order}": F.coalesce(f"next_{order}", "_following")}).drop("_slice", "_following", *[f"_{v}" for v in values])


def exact_percentiles(df: DataFrame, value: str, probabilities: Sequence[float], by: Sequence[str] = (), accuracy: int = 10_000) -> DataFrame:
    """A row a group: by, n (values that are numbers) and `percentiles`, exact, with linear interpolation between neighbours.

    1. A sketch a group brackets the rank of each probability by two values, about 4 / accuracy of the rows apart.
    2. One pass counts the values below each bracket; the values inside are counted by value.
    3. Running sums over these find the neighbours of the rank. A bracket that misses its rank (the sketch promises its error, so none
       should) is widened and tried again.
    Groups without numbers have no row.
    """
    rows = df.select(*by, F.col(value).cast("double").alias("_x")).where("_x IS NOT NULL AND NOT isnan(_x)")
    margin = 2 / accuracy
    while True:
        ends = [min(1.0, max(0.0, p + side * margin)) for p in probabilities for side in (-1, 1)]
        sketch = rows.groupBy(*by).agg(F.count("*").alias("n"), F.percentile_approx("_x", ends, accuracy).alias("_ends"), F.min("_x").alias("_min"), F.max("_x").alias("_max"))
        end = lambda k: F.get("_ends", F.lit(k))
        brackets = [F.struct(F.lit(k).alias("k"), F.when(F.lit(ends[2 * k] > 0), end(2 * k)).otherwise(F.col("_min")).alias("lo"), F.when(F.lit(ends[2 * k + 1] < 1), end(2 * k + 1)).otherwise(F.col("_max")).alias("hi")) for k in range(len(probabilities))]
        sketch = kept(sketch.select(*by, "n", F.array(*brackets).alias("_brackets")))
        small = _few(sketch)  # a join dealt by few groups would put each one's rows into one task
        met = joined_by(rows, sketch, by, small=small)
        below = met.groupBy(*by).agg(F.first("n").alias("n"), F.array(*[F.count_if(F.col("_x") < F.get("_brackets", F.lit(k))["lo"]) for k in range(len(probabilities))]).alias("_below"))
        inside = met.select(*by, "_x", F.explode(F.filter("_brackets", lambda b: (F.col("_x") >= b["lo"]) & (F.col("_x") <= b["hi"]))["k"]).alias("_k"))
        counted = running_sums(inside.groupBy(*by, "_k", "_x").agg(F.count("*").alias("c")), "_x", ["c"], 64, [*by, "_k"])
        placed = joined_by(counted, below, by, small=small)
        rank = F.get(F.array(*[F.lit(float(p)) for p in probabilities]), F.col("_k")) * (F.col("n") - 1)
        upto = F.get("_below", F.col("_k")) + F.col("upto_c")
        at = lambda r: F.max(F.when((upto - F.col("c") <= r) & (r < upto), F.col("_x")))
        found = placed.groupBy(*by, "_k").agg(F.first("n").alias("n"), F.first(rank).alias("r"), at(F.floor(rank)).alias("a"), at(F.ceil(rank)).alias("b"))
        flat = (F.col("r") == F.floor("r")) | (F.col("a") == F.col("b"))  # a weighted sum of equal neighbours may round to another number
        between = F.when(flat, F.col("a")).otherwise((F.ceil("r") - F.col("r")) * F.col("a") + (F.col("r") - F.floor("r")) * F.col("b"))
        out = found.groupBy(*by).agg(F.first("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("_k", between.alias("v")))), lambda s: s["v"]).alias("percentiles")).where("n IS NOT NULL")
        if margin >= 1:
            return out
        out = kept(out)
        if out.where((F.size("percentiles") < len(probabilities)) | F.exists("percentiles", lambda v: v.isNull())).isEmpty():
            return out
        margin = min(1.0, margin * 20)
