r"""Operator 13, filter interaction audit: what five filters remove alone, together and in every order.

A: under 200 words; B: under half of the words are distinct; C: over 3 % of the code points are A-Z; D: any of #$%&*|; E: the text
is identical to that of a smaller id, table-wide. A to D are functions of the text. E is found by radix text tries:

1. Adaptive prefixes. The distinct texts' first `width` bytes are weighed by their bytes; a prefix that is too heavy for one bucket and
   has several texts is lengthened fourfold (its texts alone are read again), until none is. The prefixes are small; Spark ranges
   them, and the least prefix of each range is a cut point, one for each bucket of about bucket_bytes.
2. Local tries. Each task puts its whole texts into a compressed trie whose terminals hold the minimum id. Only the rows with a
   terminal's minimum id keep their text; all others are duplicates already. So however often a text is repeated, it is sent once for
   each task (or for each trie_bytes of distinct texts), and its other rows go as a few bytes to any task.
3. Bucket tries. The rows go to the bucket between whose cut points their text lies; the bucket's trie holds the minimum id again,
   and traversing it flags what is not the minimum.

The documents' masks (a bit for each filter) are then reduced: to (part, mask) counts with the labels, at most 32 a part. All 120
orders are computed from these counts.

Cases: a null text is an empty one, and all empty texts are identical. A null id is a duplicate of any row with an id, never of
another null id. Rows that repeat an id and text are no duplicates of each other; each counts. A null lang is the part ''.
Several labels of one id: any 1 counts. Null and missing labels count as 0. Extra columns are ignored. An empty table has no parts, so no rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixspark.llm.common import checkpointed, lookup_join, map_frames, shuffle_partitions

FILTERS = "ABCDE"
DUPLICATE = 1 << FILTERS.index("E")
_UPPER, _MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"


class RadixTrie:
    """A compressed trie over bytes. A node is [label of the edge to it, children by first byte, what its terminal holds]."""

    def __init__(self) -> None:
        self.root: list = [b"", {}, None]

    def terminal(self, text: bytes) -> list:
        """The node where text ends; an edge is split where the text leaves it."""
        node, at = self.root, 0
        while at < len(text):
            child = node[1].get(text[at])
            if child is None:
                child = node[1][text[at]] = [text[at:], {}, None]
                return child
            label = child[0]
            if not text.startswith(label, at):
                same, most = 1, min(len(label), len(text) - at)
                while same < most:
                    middle = (same + most + 1) // 2
                    same, most = (middle, most) if text.startswith(label[:middle], at) else (same, middle - 1)
                upper = node[1][text[at]] = [label[:same], {label[same]: child}, None]
                child[0] = label[same:]
                child, label = upper, upper[0]
            node, at = child, at + len(label)
        return node

    def terminals(self) -> Iterator[tuple[bytes, object]]:
        """(text, what is held) of each terminal."""
        left = [(b"", self.root)]
        while left:
            before, node = left.pop()
            text = before + node[0]
            if node[2] is not None:
                yield text, node[2]
            left += [(text, child) for child in node[1].values()]


def failures(text: str, raw: bytes) -> int:
    """The bits of the filters A to D that the text fails."""
    words = raw.split()  # at space and \x09-\x0D
    capitals = len(raw) - len(raw.translate(None, _UPPER))
    marks = len(raw) != len(raw.translate(None, _MARKS))
    return (len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1 | (100 * capitals > 3 * len(text)) << 2 | marks << 3


def _earlier(a, b) -> bool:
    """Whether id a comes before id b; null last."""
    return a is not None and (b is None or a < b)


def _distinct_heads(texts: DataFrame, width: int) -> DataFrame:
    """h, n, prefix: a row for each distinct text (up to hash collisions, which only weigh)."""
    raw = F.col("text").cast("binary")
    return texts.select(F.xxhash64("text").alias("h"), F.octet_length("text").alias("n"), F.substring(raw, 1, width).alias("prefix")).distinct()


def cut_points(docs: DataFrame, text_col: str, width: int, bucket_bytes: int) -> list[bytes]:
    """The ascending least prefixes of all buckets but the first."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    heads = checkpointed(_distinct_heads(texts, width))
    total = heads.agg(F.sum("n")).first()[0] or 0
    while True:
        weighed = heads.groupBy("prefix").agg(F.sum("n").alias("weight"), F.count("*").alias("texts"), F.max("n").alias("longest"))
        heavy = checkpointed(weighed.where((F.col("weight") > bucket_bytes) & (F.col("texts") > 1) & (F.col("longest") > width)).select("prefix"))
        if heavy.isEmpty():
            break
        marked = texts.withColumn("prefix", F.substring(F.col("text").cast("binary"), 1, width))
        width *= 4
        longer = _distinct_heads(lookup_join(marked, heavy, ["prefix"], "left_semi", F.xxhash64("text")).select("text"), width)
        heads = checkpointed(lookup_join(heads, heavy, ["prefix"], "left_anti", F.col("h"), salts=1).select("h", "n", "prefix").union(longer))
    ranges = min(max(shuffle_partitions(spark), -(-total // bucket_bytes)), 1 + total // 1024)
    if ranges < 2:
        return []
    ranged = heads.repartitionByRange(ranges, "prefix").select("prefix", F.spark_partition_id().alias("range"))
    return sorted(r[0] for r in ranged.groupBy("range").agg(F.min("prefix").alias("least")).select("least").collect())[1:]


def filter_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", width: int = 64, bucket_bytes: int = 32 << 20, trie_bytes: int = 32 << 20) -> DataFrame:
    """doc_id, part, mask (a bit for each failed filter, A lowest), n: all rows of docs; n of them are alike."""
    cuts = cut_points(docs, text_col, width, bucket_bytes)
    buckets = len(cuts) + 1
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    columns = ["doc_id", "part", "mask", "n", "text", "bucket"]

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def held(trie: RadixTrie) -> Iterator[pd.DataFrame]:
            out, size = [], 0
            for raw, (i, mask, parts) in trie.terminals():
                bucket = bisect_right(cuts, raw)
                out += [(i, part, mask, n, raw, bucket) for part, n in parts.items()]
                size += len(raw) * len(parts)
                if size > 4 << 20:
                    yield pd.DataFrame(out, columns=columns)
                    out, size = [], 0
            yield pd.DataFrame(out, columns=columns)

        trie, size, dealt = RadixTrie(), 0, 0
        for b in batches:
            out = []
            for i, text, part in zip(b["doc_id"].astype(object), b["text"], b["part"]):
                i = None if pd.isna(i) else i
                raw = text.encode()
                node = trie.terminal(raw)
                if node[2] is None:
                    node[2] = (i, failures(text, raw), {part: 1})
                    size += len(raw) + 500
                    continue
                least, mask, parts = node[2]
                if i == least:
                    parts[part] = parts.get(part, 0) + 1
                    continue
                if _earlier(i, least):
                    gone, node[2] = [(least, p, mask | DUPLICATE, n) for p, n in parts.items()], (i, mask, {part: 1})
                else:
                    gone = [(i, part, mask | DUPLICATE, 1)]
                for g in gone:
                    dealt += 1
                    out.append((*g, None, dealt % buckets))
            yield pd.DataFrame(out, columns=columns)
            if size > trie_bytes:
                yield from held(trie)
                trie, size = RadixTrie(), 0
        yield from held(trie)

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = RadixTrie()
        for b in batches:
            out = []
            for i, part, mask, n, raw in zip(b["doc_id"].astype(object), b["part"], b["mask"], b["n"], b["text"]):
                i = None if pd.isna(i) else i
                if raw is None:
                    out.append((i, part, mask, n))
                    continue
                node = trie.terminal(raw)
                if node[2] is None or i == node[2][0]:
                    node[2] = node[2] or (i, mask, {})
                    node[2][2][part] = node[2][2].get(part, 0) + n
                elif _earlier(i, node[2][0]):
                    out += [(node[2][0], p, mask | DUPLICATE, k) for p, k in node[2][2].items()]
                    node[2] = (i, mask, {part: n})
                else:
                    out.append((i, part, mask | DUPLICATE, n))
            yield pd.DataFrame(out, columns=columns[:4])
        yield pd.DataFrame([(i, p, mask, n) for _, (i, mask, parts) in trie.terminals() for p, n in parts.items()], columns=columns[:4])

    schema = f"doc_id {id_type}, part string, mask int, n long"
    return map_frames(map_frames(rows, local, f"{schema}, text binary, bucket int").repartitionById(buckets, F.col("bucket")), merged, schema)


def mask_counts(masks: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """part, mask, n, good, toxic: documents, those with label quality = 1 and those with toxic = 1; at most 32 rows a part."""
    marks = labels.groupBy(F.col(id_col).alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    alike = masks.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))  # an id that repeats (a null one too) comes to few rows
    joined = alike.join(marks, "doc_id", "left")
    lost = lambda c: F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c)
    return joined.groupBy("part", "mask").agg(F.sum("n").alias("n"), lost("good"), lost("toxic"))


def all_orders(counts: DataFrame) -> DataFrame:
    """From mask_counts: a row for each part, filter_order and step."""
    cells = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    rows = cells.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    rows = rows.withColumn("bit", F.expr("shiftleft(1, ascii(substr(filter_order, step, 1)) - ascii('A'))"))
    rows = rows.withColumn("so_far", F.expr("aggregate(sequence(1, step), 0, (m, i) -> m | shiftleft(1, ascii(substr(filter_order, i, 1)) - ascii('A')))"))
    bit, before = F.col("bit"), F.col("so_far").bitwiseXOR(F.col("bit"))

    def total(what: str, when) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda found, c: found + F.when(when(c["mask"]), c[what]).otherwise(F.lit(0)))

    here = lambda m: (m.bitwiseAND(before) == 0) & (m.bitwiseAND(bit) != 0)
    out = rows.select(
        "part",
        "filter_order",
        "step",
        "bit",
        total("n", lambda m: m.bitwiseAND(F.col("so_far")) == 0).alias("kept"),
        total("n", here).alias("removed"),
        total("n", lambda m: (m.bitwiseAND(before) != 0) & (m.bitwiseAND(bit) != 0)).alias("redundant"),
        total("n", lambda m: m == bit).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit"))).drop("bit")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", **sizes: int) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return all_orders(checkpointed(mask_counts(filter_masks(docs, id_col, text_col, part_col, **sizes), labels, id_col)))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
m AS (SELECT doc_id, part, CAST(len(words) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(words)) < 50 * len(words) AS INT)
  + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS INT) + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT)
  + 16 * CAST(coalesce(doc_id > low, doc_id IS NULL AND low IS NOT NULL) AS INT) AS mask FROM (SELECT *, min(doc_id) OVER (PARTITION BY text) AS low FROM w)),
marks AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM m LEFT JOIN marks ON m.doc_id = marks.doc_id GROUP BY part, mask),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, CAST(step AS INT) AS step, 1 << (ascii(filter_order[step]) - 65) AS bit,
  list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))) AS earlier FROM orders, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, bit,
  coalesce(sum(n) FILTER (mask & (CAST(coalesce(earlier, 0) AS INT) + bit) = 0), 0) AS kept,
  coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & CAST(coalesce(earlier, 0) AS INT) = 0), 0) AS removed,
  coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & CAST(coalesce(earlier, 0) AS INT) <> 0), 0) AS redundant,
  coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
  coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & CAST(coalesce(earlier, 0) AS INT) = 0), 0) AS good_lost,
  coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & CAST(coalesce(earlier, 0) AS INT) = 0), 0) AS toxic_lost
  FROM c, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r
"""
