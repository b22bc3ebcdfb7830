"""Operator 3, mixing sources to target weights: a time-varying curriculum (DataFrame functions only).

1. Targets: every source asks for its weight's share of all words; a source stops at cap_multiple times its own size and the
   excess goes to the others by weight (water filling, solved in closed form over the sources in the order of cap / weight).
2. Streams: the documents of a source stand in a fixed pseudo-random order (md5 of the id). Prefix sums of their sizes, first over
   hash ranges of a source and then inside a range, give each document its offset, so no task holds a whole source.
   The stream repeats, pass after pass, until the target is met; the last document is taken in part, so a source's words come to
   its rounded target.
3. Curriculum: a source's weight changes over training time t in [0, 1] by a piecewise linear schedule. Its integral is the
   cumulative token demand; inverting it at the middle of each copy's share gives the copy its training position.
4. The placed copies are range-partitioned and sorted by position.

Cases: null text has size 0; documents of size 0 are never placed and take 0 words. A null source is one source of its own, the
last. Rows that repeat an id are documents of their own beside each other in the stream. Extra columns are ignored. An empty
table, or one without words, gives targets of 0 and no copies.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixspark.llm.common import checkpointed, shuffle_partitions

#: Weight schedules by the index of the weight class: (time, rate) knots. The first class fades, the last one rises.
SCHEDULES = [[(0.0, 1.5), (0.6, 1.0), (1.0, 0.5)], [(0.0, 1.0), (1.0, 1.0)], [(0.0, 0.5), (0.5, 1.0), (1.0, 2.0)]]


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sizes: DataFrame, weights: list[float], cap_multiple: int) -> DataFrame:
    """source, source_size, weight class and target for each source; windows run over one row a source."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    one = Window.partitionBy(F.lit(0))
    by_cap = one.orderBy("ratio", "rank")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    w = F.array(*[F.lit(float(x)) for x in weights])
    rated = (
        sources.withColumn("rank", F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1)
        .withColumn("klass", (F.col("rank") % len(weights)).cast("int"))
        .withColumn("weight", F.get(w, F.col("klass")))
        .withColumn("cap", (F.col("source_size") * cap_multiple).cast("double"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
    )
    level = (F.sum("source_size").over(one) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(one) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    return (
        rated.withColumn("level", level)
        .withColumn("level", F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank"))).over(one))
        .withColumn("target", F.least("cap", F.coalesce(F.col("weight") * F.col("level"), F.col("cap"))))
        .select("source", "source_size", "klass", "target", F.round("target").cast("long").alias("quota"))
    )


def _segments(schedule: list[tuple[float, float]]) -> list[tuple[float, ...]]:
    """(t0, r0, slope, g0, g1) of each piece; g is the integral so far, scaled to end at 1."""
    areas = [(t1 - t0) * (r0 + r1) / 2 for (t0, r0), (t1, r1) in zip(schedule, schedule[1:])]
    total, g, out = sum(areas), 0.0, []
    for ((t0, r0), (t1, r1)), a in zip(zip(schedule, schedule[1:]), areas):
        out.append((t0, r0 / total, (r1 - r0) / (t1 - t0) / total, g, g + a / total))
        g += a / total
    return out


def training_time(u: Column, klass: Column, schedules: list) -> Column:
    """Inverts a class's cumulative demand: the time at which it reaches the share u of its total."""
    kind = "array<array<struct<t0:double,r0:double,slope:double,g0:double,g1:double>>>"
    table = F.array(*[F.array(*[F.struct(*[F.lit(float(x)) for x in s]) for s in _segments(k)]) for k in schedules]).cast(kind)

    def solve(s: Column) -> Column:
        y = F.greatest(u - s["g0"], F.lit(0.0))
        return F.when(y > 0, s["t0"] + 2 * y / (s["r0"] + F.sqrt(F.greatest(s["r0"] * s["r0"] + 2 * s["slope"] * y, F.lit(0.0))))).otherwise(s["t0"])

    pieces = F.get(table, klass)
    at = F.filter(pieces, lambda s: s["g1"] >= u)
    return F.least(solve(F.coalesce(F.get(at, F.lit(0)), F.element_at(pieces, -1))), F.lit(1.0))


def curriculum(docs: DataFrame, weights: list[float], cap_multiple: int = 3, schedules: list | None = None, rows_per_range: int = 4_000, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, text_hash, source, size, source_size, target, taken and `copies`, an array of (pass, words, position) by pass."""
    sizes = checkpointed(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("text_hash")))
    bits = min(30, max(0, math.ceil(math.log2(max(1, sizes.count()) / rows_per_range))))
    ordered = sizes.withColumn("place", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    ordered = ordered.withColumn("range", F.shiftright(F.conv(F.substring("place", 1, 8), 16, 10).cast("long"), 32 - bits))
    targets = checkpointed(source_targets(sizes, weights, cap_multiple))
    ranges = ordered.groupBy("source", "range").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("base", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
    ranges = ranges.join(F.broadcast(targets) if targets.count() <= 100_000 else targets, ranges["source"].eqNullSafe(targets["source"])).select(
        ranges["source"].alias("s"), ranges["range"].alias("r"), "base", "source_size", "klass", "target", "quota"
    )
    inside = Window.partitionBy("source", "range").orderBy("place", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        ordered.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(ranges, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
        .withColumn("offset", F.col("base") + F.col("within"))
    )

    def copy(k: Column) -> Column:
        start = F.col("offset") + k * F.col("source_size")
        words = F.greatest(F.lit(0), F.least(F.col("size"), F.col("quota") - start)).cast("long")
        u = (start + words / 2.0) / F.greatest(F.col("quota"), F.lit(1))
        return F.struct(k.cast("int").alias("pass"), words.alias("words"), training_time(u, F.col("klass"), schedules or SCHEDULES).alias("position"))

    copies = F.filter(F.transform(F.sequence(F.lit(0), F.lit(cap_multiple - 1)), copy), lambda c: c["words"] > 0)
    return placed.withColumn("copies", copies).select(
        "doc_id", "text_hash", "source", "size", "source_size", "target", F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"]).alias("taken"), "copies"
    )


def range_sorted(rows: DataFrame, position: str) -> DataFrame:
    """Range partitions by position, each sorted: the order of training."""
    return rows.repartitionByRange(shuffle_partitions(rows.sparkSession), F.col(position).asc_nulls_last(), "doc_id").sortWithinPartitions(F.col(position).asc_nulls_last(), "doc_id")


def training_order(docs: DataFrame, weights: list[float], cap_multiple: int = 3, schedules: list | None = None) -> DataFrame:
    """The documents themselves, a row for each copy of which at least half is taken, in training order with all columns."""
    key = [F.coalesce(F.col("doc_id"), F.lit(0)).alias("_key"), F.col("doc_id").isNull().alias("_none")]
    placed = curriculum(docs, weights, cap_multiple, schedules).select(*key, F.col("text_hash").alias("_hash"), "size", "copies")
    times = F.transform(F.filter("copies", lambda c: 2 * c["words"] >= F.col("size")), lambda c: c["position"])
    at = placed.groupBy("_key", "_none", "_hash").agg(F.array_sort(F.collect_list(times)).alias("_at"))  # an entry a row: rows may repeat an id
    named = docs.select("*", *key, F.xxhash64("text").alias("_hash")).join(at, ["_key", "_none", "_hash"])
    nth = F.row_number().over(Window.partitionBy("_key", "_none", "_hash").orderBy("_key"))
    out = named.withColumn("_nth", nth).withColumn("_position", F.explode(F.get("_at", F.col("_nth") - 1)))
    return out.repartitionByRange(shuffle_partitions(docs.sparkSession), "_position").sortWithinPartitions("_position", "doc_id").select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size,
    md5(CAST(doc_id AS VARCHAR)) AS place FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sources),
rated AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap FROM ranked),
levels AS (SELECT *, cap / weight AS ratio,
  (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM rated WINDOW b AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
chosen AS (SELECT min_by(level, ratio) AS level FROM levels WHERE level <= ratio),
targets AS (SELECT source, source_size, least(cap, coalesce(weight * (SELECT level FROM chosen), cap)) AS target FROM levels),
placed AS (
  SELECT doc_id, size, source_size, target, CAST(round(target) AS BIGINT) AS quota,
    CAST(coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY place, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 3) AS target,
  CAST(greatest(0, least(size, quota - off)) + greatest(0, least(size, quota - off - source_size)) + greatest(0, least(size, quota - off - 2 * source_size)) AS BIGINT) AS taken
FROM placed
"""
