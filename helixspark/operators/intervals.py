"""Overlaps of points with intervals of any mix of lengths.

`overlapping` returns the pairs. Where only counts, sets or extremes of a point's intervals are wanted, `nodes` and `at_nodes` find them
without the pairs, whose number grows with the square of the rows on one genome.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixspark.operators.selection import kept, running_sums

#: Widths of the bins, as powers of two: 256 bases, then eightfold up to one bin for all positions.
SHIFTS = tuple(range(8, 33, 3))


def indexed(intervals: DataFrame) -> DataFrame:
    """One row an interval: `_shift` and `_bin` of the smallest bin that holds it, however long it is. Empty intervals (hi < lo) go."""
    rows = intervals.where("hi >= lo AND hi >= 0").withColumns({"_lo": F.greatest(F.col("lo"), F.lit(0)).cast("long"), "_hi": F.col("hi").cast("long")})
    shift = F.coalesce(*[F.when(F.shiftright("_lo", s) == F.shiftright("_hi", s), F.lit(s)) for s in SHIFTS[:-1]], F.lit(SHIFTS[-1]))
    return rows.withColumn("_shift", shift).withColumn("_bin", F.expr("shiftright(_lo, _shift)")).drop("_lo", "_hi")


def overlapping(points: DataFrame, intervals: DataFrame, hot_rows: int = 1_000_000) -> DataFrame:
    """Points (chrom, pos, ...) joined to the intervals (chrom, lo, hi, ...) they lie in.

    Hierarchical bins: an interval is in one bin, a point looks into one bin of each width that an interval has, and only bins with
    intervals are met. A bin that more than hot_rows points look into is split: its points are dealt over as many salts as that
    takes, its intervals are repeated for each. Positions are at least 0.
    """
    bins = indexed(intervals)
    of_bin = ["chrom", "_shift", "_bin"]
    used = bins.select(*of_bin).distinct()
    shifts = [r[0] for r in used.select("_shift").distinct().collect()]  # at most len(SHIFTS)
    probes = points.withColumn("_shift", F.explode(F.array(*[F.lit(s) for s in sorted(shifts)]).cast("array<int>"))).withColumn("_bin", F.expr("shiftright(CAST(pos AS BIGINT), _shift)"))
    counts = probes.groupBy(*of_bin).agg(F.count("*").alias("n")).where(F.col("n") > hot_rows)
    hot = F.broadcast(counts.join(used, of_bin, "left_semi").select(*of_bin, F.ceil(F.col("n") / hot_rows).cast("int").alias("_salts")))  # at most probes / hot_rows rows
    at = probes.join(hot, of_bin, "left").withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.coalesce("_salts", F.lit(1)))).drop("_salts")
    among = bins.join(hot, of_bin, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), (F.coalesce("_salts", F.lit(1)) - 1).cast("long")))).drop("_salts")
    return at.join(among, [*of_bin, "_salt"]).where("pos BETWEEN lo AND hi").drop("_shift", "_bin", "_salt")


#: Nodes wider than two to this power are broadcast: there are few, and many points look into each.
WIDE = 20


def nodes(intervals: DataFrame, by: list[str], values: list[Column]) -> DataFrame:
    """A row a node and value of `by`: chrom, `_shift`, `_bin`, by and the aggregates `values` of the intervals (chrom, lo, hi, ...) that have
    the node. An interval is cut into the at most two nodes a width (bins of 1, 2, 4, ... positions) that make it up; so a position in
    it lies in exactly one of them. Empty intervals go, and what lies below 0."""
    rows = intervals.where("chrom IS NOT NULL AND hi >= lo AND hi >= 0").withColumns({"_lo": F.greatest(F.col("lo"), F.lit(0)).cast("long"), "_end": F.col("hi").cast("long") + 1})
    cut = """flatten(transform(sequence(0, CAST(floor(log2(_end - _lo)) AS INT)), s -> transform(filter(array(
      IF(shiftright(_lo + shiftleft(1L, s) - 1, s) % 2 = 1, shiftright(_lo + shiftleft(1L, s) - 1, s), NULL), IF(shiftright(_end, s) % 2 = 1, shiftright(_end, s) - 1, NULL)),
      b -> b IS NOT NULL AND shiftright(_lo + shiftleft(1L, s) - 1, s) < shiftright(_end, s)), b -> struct(s AS _shift, b AS _bin))))"""
    return rows.withColumn("_node", F.explode(F.expr(cut))).withColumns({"_shift": F.col("_node._shift"), "_bin": F.col("_node._bin")}).groupBy("chrom", "_shift", "_bin", *by).agg(*values)


def at_nodes(places: DataFrame, of: DataFrame) -> DataFrame:
    """The distinct places (chrom, pos) joined to the nodes that hold them: at most one a width, value of `by` and place. Positions are at least 0."""
    shifts = sorted(r[0] for r in of.select("_shift").distinct().collect())  # at most 64
    probes = places.withColumn("_shift", F.explode(F.array(*[F.lit(s) for s in shifts]).cast("array<int>"))).withColumn("_bin", F.expr("shiftright(CAST(pos AS BIGINT), _shift)"))
    key = ["chrom", "_shift", "_bin"]
    narrow = probes.where(F.col("_shift") <= WIDE).join(of.where(F.col("_shift") <= WIDE), key)
    if not shifts or shifts[-1] <= WIDE:
        return narrow
    return narrow.unionByName(probes.where(F.col("_shift") > WIDE).join(F.broadcast(of.where(F.col("_shift") > WIDE)), key))


def united(intervals: DataFrame, name: str) -> DataFrame:
    """The intervals (chrom, lo, hi) of each name put together: those that overlap or touch become one, so no position is in two of a name."""
    rows = intervals.where(f"chrom IS NOT NULL AND hi >= lo AND `{name}` IS NOT NULL")
    turns = rows.select("chrom", name, F.inline(F.array(F.struct(F.col("lo").cast("long").alias("at"), F.lit(1).alias("d")), F.struct((F.col("hi").cast("long") + 1).alias("at"), F.lit(-1).alias("d")))))
    sums = running_sums(kept(turns.groupBy("chrom", name, "at").agg(F.sum("d").alias("d")).where("d <> 0")), "at", ["d"], by=["chrom", name])
    ends = kept(sums.where("(upto_d = 0) <> (upto_d - d = 0)").select("chrom", name, "at", (F.col("upto_d") > 0).cast("long").alias("open")))
    k = running_sums(ends, "at", ["open"], by=["chrom", name])  # the open ones so far number the interval
    return k.groupBy("chrom", name, "upto_open").agg(F.min("at").alias("lo"), (F.max("at") - 1).alias("hi")).drop("upto_open")


def hit_counts(points: DataFrame, intervals: DataFrame, name: str) -> DataFrame:
    """chrom, pos, n_hits (intervals) and n_elements (their distinct names) of the places of points that lie in any."""
    intervals = kept(intervals)
    both = intervals.select("chrom", "lo", "hi", F.lit(1).alias("_hits"), F.lit(0).alias("_elements")).unionByName(united(intervals, name).select("chrom", "lo", "hi", F.lit(0).alias("_hits"), F.lit(1).alias("_elements")))
    found = at_nodes(points.select("chrom", "pos").distinct(), kept(nodes(both, [], [F.sum("_hits").alias("_hits"), F.sum("_elements").alias("_elements")])))
    return found.groupBy("chrom", "pos").agg(F.sum("_hits").alias("n_hits"), F.sum("_elements").alias("n_elements"))


def regulatory_overlap(points: DataFrame, intervals: DataFrame, window: int) -> DataFrame:
    """in_cre, types (sorted, joined), n_elements and max_z of each row of points (chrom, pos, ...) over the intervals (chrom, lo, hi, kind, z)
    within `window` of it. Rows that are alike get the same values; rows that share an id but not all else don't mix."""
    wide = intervals.select("chrom", (F.col("lo") - window).alias("lo"), (F.col("hi") + window).alias("hi"), "kind", "z")
    found = at_nodes(points.select("chrom", "pos").distinct(), nodes(wide, ["kind"], [F.count("*").alias("n"), F.max("z").alias("z")]))
    kinds = found.groupBy("chrom", "pos", "kind").agg(F.sum("n").alias("n"), F.max("z").alias("z"))
    hits = kinds.groupBy("chrom", "pos").agg(F.sum("n").alias("n_elements"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("types"), F.max("z").alias("max_z"))
    found = points.join(hits, ["chrom", "pos"], "left").select(*points.columns, "n_elements", "types", "max_z")
    return found.withColumns({"in_cre": F.col("n_elements").isNotNull(), "n_elements": F.coalesce("n_elements", F.lit(0)), "types": F.coalesce("types", F.lit("")), "max_z": F.coalesce("max_z", F.lit(0.0))})
