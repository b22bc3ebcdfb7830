r"""Operator 11, phrase collocations by dynamic itemset counting.

Texts (A-Z lower-cased) are cut into pieces at .,;:!? and \x0A-\x0D, pieces into words at spaces and tabs. Frequent phrases of up to
max_words words are found for each part (language) by scans over shards of the rows:

1. The rows are dealt over `shards` shards and written once. Scan t reads shard t mod shards, cyclically, and counts all phrases
   that are active: words from scan 0 on; a longer phrase from the scan after both its subphrases (without the last word, without
   the first) had reached min_count. Each phrase is counted for one full cycle, so in each shard once. So lengths interleave,
   and it ends when no phrase is active any more.
2. Scans count cells, not phrases: a phrase's 64-bit key falls into one of the cells of its length (`cells` for pairs, a quarter of it for
   each other length), counted for each first scan, so counts are upper bounds. A task packs the counts of some megabytes into one row for each block of 32768 cells, and blocks are summed by streaming over
   sorted rows, in two rounds (salted by sender, then not), so a task holds one block whatever the corpus. A count stops at min_count. What
   the open cycles have so far is written after each scan and goes into the next one's sums. What reached min_count is
   handed to the tasks as a table of two bits a cell (up to two shards): the first scan in which it did, as far as cycles are open. Its size
   follows the corpus up to most_cells. Phrases that share a cell become active together: then more is counted, but nothing is lost.
3. A last pass over all shards counts the phrases whose cells reached min_count, by their words, so counts are exact and false
   candidates go.

Joins of the phrases with their parts give scores (in decimals of 38 digits) and the phrases held in longer ones.

Cases: null texts count as empty; a null part is `und`. Texts without words add nothing; an empty table gives no rows. Repeated rows
count each time. Other control characters and other white space belong to words. Long texts are taken in stretches cut
between pieces; a single piece is held whole. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixspark.llm.common import checkpointed, lookup_join, shared_folder
from helixspark.llm.shingles import mixed

NEVER = 255
#: Text whose words and keys are held at once.
CHUNK = 1 << 20
#: Cells that a task of a scan holds before it counts and sends them, and the text that has about as many.
HELD_CELLS = 3 << 20
HELD_BYTES = 8 << 20
#: Text whose phrases a task of the last pass adds up before it sends them, and rows that wait for that at once.
SENT_BYTES = 16 << 20
HELD_PHRASES = 200_000
#: Text for a task of the last pass: each task sends every frequent phrase that it meets once, so fewer, larger ones send less.
LAST_BYTES = 96 << 20
BLOCK_BITS = 15
BLOCK = 1 << BLOCK_BITS
_MARKS = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n" * 9 + b" ")
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACES = 64
_LETTERS = mixed(np.arange(_PLACES * 256, dtype=np.uint64) * _STEP + np.uint64(3))


def _stretches(raw: bytes) -> Iterator[bytes]:
    at = 0
    while len(raw) - at > 2 * CHUNK:
        end = raw.find(b"\n", at + CHUNK) + 1
        if not end:
            break
        yield raw[at:end]
        at = end
    yield raw[at:]


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(part, text) in chunks of about CHUNK bytes: a part's texts in lower case, pieces ended by a line feed, words parted by spaces and line feeds."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    for b in (whole.slice(i, 256) for whole in batches for i in range(0, whole.num_rows, 256)):
        for part, text in zip(b.column("part").to_pylist(), b.column("text").to_pylist()):
            raw = text.encode().lower().translate(_MARKS)
            held.setdefault(part, []).append(raw)
            sizes[part] = sizes.get(part, 0) + len(raw)
            if sizes[part] > CHUNK or sum(sizes.values()) > 4 * CHUNK:
                part = max(sizes, key=sizes.get)
                del sizes[part]
                for s in _stretches(b"\n".join(held.pop(part))):
                    yield part, s
    for part, raws in held.items():
        for s in _stretches(b"\n".join(raws)):
            yield part, s


def words_of(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and piece of each word, and the letters of all words without what parts them."""
    b = np.frombuffer(raw, np.uint8)
    line = b == 10
    inside = ~((b == 32) | line)
    none = np.zeros(1, np.int8)
    edges = np.diff(np.concatenate((none, inside.view(np.int8), none)))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    return starts, ends - starts, np.cumsum(line, dtype=np.int32)[starts], b[inside]


def word_keys(lengths: np.ndarray, letters: np.ndarray, part: str) -> np.ndarray:
    """A 64-bit key for each word, other ones in each part."""
    at = np.cumsum(lengths) - lengths
    place = np.arange(len(letters), dtype=np.int32) - np.repeat(at.astype(np.int32), lengths)  # a chunk is far below 2 GB
    values = _LETTERS[((place & (_PLACES - 1)) << 8) | letters]
    far = np.flatnonzero(place >= _PLACES)
    with np.errstate(over="ignore"):
        values[far] = mixed(values[far] + place[far].astype(np.uint64) * _STEP)
        return mixed((np.add.reduceat(values, at) + lengths.astype(np.uint64)) ^ np.uint64(xxhash.xxh3_64_intdigest(part)))


def regions(cells: int, max_words: int) -> list[tuple[int, int]]:
    """(first cell, number of cells) of each length from 0 on; numbers are powers of two."""
    sizes = [0] + [cells if k == 2 else max(1, cells // 4) for k in range(1, max_words + 1)]
    return list(zip(np.cumsum([0, *sizes]).tolist(), sizes))


class Reached:
    """Which cells have reached the minimum, and in which scan, as scan t needs it: a small code a cell. A phrase's cycle is over when it began `shards` scans
    ago or more, so older scans share a code."""

    def __init__(self, scans: np.ndarray, t: int, shards: int) -> None:
        self.t, self.shards, self.bits = t, shards, next(b for b in (1, 2, 4, 8) if shards + 2 <= 1 << b)
        each = 8 // self.bits
        self.codes = np.zeros(-(-len(scans) // each), np.uint8)
        for lo in range(0, len(scans), 1 << 20):  # a multiple of `each`
            some = scans[lo : lo + (1 << 20)]
            code = np.where(some == NEVER, 0, np.clip(some.astype(np.int16) + 1 - (t - shards), 0, shards) + 1).astype(np.uint8)
            code = np.pad(code, (0, -len(code) % each)).reshape(-1, each)
            self.codes[lo // each : lo // each + len(code)] = np.bitwise_or.reduce(code << (np.arange(each, dtype=np.uint8) * self.bits), axis=1)

    def of(self, cell: np.ndarray) -> np.ndarray:
        """0: not reached; else one more than the first scan of the phrases that wait for it, counted from scan t - shards (or before)."""
        each = 8 // self.bits
        return (self.codes[cell // each] >> ((cell % each) * self.bits).astype(np.uint8)) & np.uint8((1 << self.bits) - 1)

    def start(self) -> int:
        """The words' first scan, counted as `of` counts."""
        return min(max(self.shards - self.t, 0), self.shards)


def levels(keys: np.ndarray, pieces: np.ndarray, reached: Reached, where: list[tuple[int, int]], top: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length up to top: the length, places, cells and first scans of the phrases whose subphrases have reached the
    minimum, and whether they did themselves. First scans count from scan t - shards; 0 is that and all before. A cell may have
    reached the minimum by another phrase before this one was counted, so a longer phrase starts no sooner than its subphrases did."""
    at, key, first, state = np.arange(len(keys), dtype=np.int32), keys, np.full(len(keys), reached.start(), np.uint8), np.zeros(0, np.uint8)
    for k in range(1, top + 1):
        if k > 1:
            ok = state != 0
            at, key, since = at[ok], key[ok], np.maximum(state[ok] - np.uint8(1), first[ok])
            pair = np.flatnonzero((at[1:] == at[:-1] + 1) & (pieces[at[1:]] == pieces[at[:-1]]))
            with np.errstate(over="ignore"):
                key = mixed(key[pair] * _STEP + keys[at[pair] + k - 1] + np.uint64(k))
            at, first = at[pair], np.maximum(since[pair], since[pair + 1])
        base, size = where[k]
        cell = (key & np.uint64(size - 1)).astype(np.uint32) + np.uint32(base)
        state = reached.of(cell)
        yield k, at, cell, first, state != 0


def active(last: dict[int, int], t: int, shards: int, max_words: int) -> tuple[int, ...]:
    """The lengths with phrases whose cycle isn't over before scan t. last: the last scan in which a cell of a length reached the minimum."""
    tops, start = [], 0  # start: the latest first scan of a length
    for k in range(1, max_words + 1):
        if k > 1:
            if k - 1 not in last:
                break
            start = max(start, last[k - 1] + 1)
        if start + shards > t:
            tops.append(k)
    return tuple(tops)


def counter(most: int) -> np.dtype:
    """The smallest type that holds counts up to `most`."""
    return np.min_scalar_type(most)


def packed(cells: np.ndarray, n: np.ndarray, most: int) -> list[tuple[int, bytes, bytes]]:
    """(block, offsets, counts) of sorted cells; counts stop at `most`."""
    n = np.minimum(n, most).astype(counter(most))
    blocks = cells >> BLOCK_BITS
    cut = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]]) if len(cells) else np.zeros(0, int)
    low = (cells & (BLOCK - 1)).astype(np.uint16)
    return [(int(blocks[i]), low[i:j].tobytes(), n[i:j].tobytes()) for i, j in zip(cut, [*cut[1:], len(cells)])]


def scan(batches: Iterator[pa.RecordBatch], t: int, shards: int, reached: Reached, where: list[tuple[int, int]], tops: tuple[int, ...], most: int) -> Iterator[pa.RecordBatch]:
    """words, first (the phrases' first scan), block, salt (of what is sent together), offsets, counts (up to `most`): the cells that scan t counts. tops: the lengths that may be active."""
    held: dict[tuple[int, int], list[np.ndarray]] = {}
    size = salt = 0

    def sent() -> Iterator[pa.RecordBatch]:
        for k, f in list(held):
            rows = packed(*np.unique(np.concatenate(held.pop((k, f))), return_counts=True), most)
            for lo in range(0, len(rows), 256):
                n = len(some := rows[lo : lo + 256])
                columns = [pa.array(np.full(n, v, np.int32)) for v in (k, f)] + [pa.array([r[0] for r in some], pa.int32()), pa.array(np.full(n, salt, np.int32)), pa.array([r[1] for r in some], pa.binary()), pa.array([r[2] for r in some], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["words", "first", "block", "salt", "offsets", "counts"])

    for part, raw in chunks(batches):
        _, lengths, pieces, letters = words_of(raw)
        if not len(lengths):
            continue
        salt = salt if held else xxhash.xxh32_intdigest(raw[:64]) & 0x7FFFFFFF
        for k, _, cell, first, _ in levels(word_keys(lengths, letters, part), pieces, reached, where, max(tops)):
            for f in range(max(0, t - shards + 1), t + 1) if k in tops else ():
                held.setdefault((k, f), []).append(found := cell[first == f - (t - shards)])
                size += len(found)
        if size > HELD_CELLS:
            yield from sent()
            size = 0
    yield from sent()


def summed(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Sums rows that follow each other with the same words, first, block and salt, up to `most`; bits: the cells that reached it. Holds one block."""
    total, now, kind = np.zeros(BLOCK, np.int64), None, counter(most)

    def row() -> pa.RecordBatch:
        at = np.flatnonzero(total)
        n = np.minimum(total[at], most)
        over = np.packbits(total >= most).tobytes() if (n == most).any() else None
        values = [pa.array([v], pa.int32()) for v in now] + [pa.array([x], pa.binary()) for x in (at.astype(np.uint16).tobytes(), n.astype(kind).tobytes(), over)]
        return pa.RecordBatch.from_arrays(values, ["words", "first", "block", "salt", "offsets", "counts", "bits"])

    for b in batches:
        for *key, offsets, counts in zip(*(b.column(c).to_pylist() for c in ("words", "first", "block", "salt", "offsets", "counts"))):
            if key != now:
                if now is not None:
                    yield row()
                now = key
                total[:] = 0
            total[np.frombuffer(offsets, np.uint16)] += np.frombuffer(counts, kind)  # offsets are distinct
    if now is not None:
        yield row()


_CELLS = "words int, first int, block int, salt int, offsets binary, counts binary"
_OF_BLOCK = ["words", "first", "block", "salt"]


def summed_blocks(rows: DataFrame, salts: int, most: int) -> DataFrame:
    """Blocks summed over all rows, those of one salt first; the salt is 0 after."""
    for n in (salts, 1) if salts > 1 else (1,):
        dealt = rows.drop("bits").withColumn("salt", F.pmod("salt", F.lit(n)).cast("int"))
        rows = dealt.repartition(*_OF_BLOCK).sortWithinPartitions(*_OF_BLOCK).mapInArrow(lambda found: summed(found, most), f"{_CELLS}, bits binary")
    return rows


def phrases_of(part: str, raw: bytes, reached: Reached, where: list[tuple[int, int]], max_words: int) -> Iterator[pa.Table]:
    """part, phrase, words, n of the phrases of a chunk whose cells reached the minimum; phrase '' and 0 words: all its words."""

    def rows(texts: pa.Array, n: np.ndarray, k: int) -> pa.Table:
        return pa.table({"part": pa.repeat(pa.scalar(part, pa.large_string()), len(n)), "phrase": texts, "words": np.full(len(n), k, np.int32), "n": n.astype(np.int64)})

    starts, lengths, pieces, letters = words_of(raw)
    if not len(lengths):
        return
    yield rows(pa.array([""], pa.large_string()), np.array([len(lengths)]), 0)
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    spelled = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
    ids, names = spelled.indices.to_numpy().astype(np.int64), spelled.dictionary.cast(pa.large_string())
    codes = ids.copy()  # of the phrase that starts here, dense in each length
    for k, at, _, _, over in levels(word_keys(lengths, letters, part), pieces, reached, where, max_words):
        at = at[over]
        if k == 1:
            n = np.bincount(ids[at], minlength=len(names))
            seen = np.flatnonzero(n)
            yield rows(names.take(pa.array(seen)), n[seen], 1)
            continue
        whole = codes[at] * len(names) + ids[at + k - 1]
        found, dense, n = np.unique(whole, return_inverse=True, return_counts=True)
        codes[at] = dense
        one = np.zeros(len(found), np.int64)
        one[dense] = at  # any of the phrase's places
        yield rows(pc.binary_join_element_wise(*[names.take(pa.array(ids[one + j])) for j in range(k)], pa.scalar(" ", pa.large_string())), n, k)


def exact_counts(batches: Iterator[pa.RecordBatch], reached: Reached, where: list[tuple[int, int]], max_words: int) -> Iterator[pa.RecordBatch]:
    """part, phrase, words, n of all phrases whose cells reached the minimum, counted by their words. Those of SENT_BYTES of text are added up before they are sent."""
    held: list[pa.Table] = []
    size = limit = seen = 0

    def added() -> pa.Table:
        both = pa.concat_tables(held).group_by(["part", "phrase", "words"], use_threads=False).aggregate([("n", "sum")])
        return both.select(["part", "phrase", "words", "n_sum"]).rename_columns(["part", "phrase", "words", "n"])

    def sent(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("part", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("n", pa.int64())])
        for lo in range(0, len(rows), 50_000):
            yield from rows.slice(lo, 50_000).cast(kinds).combine_chunks().to_batches()

    for part, raw in chunks(batches):
        for rows in phrases_of(part, raw, reached, where, max_words):
            held.append(rows)
            size += len(rows)
        if size > max(limit, HELD_PHRASES):
            held = [added()]
            size = len(held[0])
            limit = 2 * size
        seen += len(raw)
        if seen > SENT_BYTES and held:
            yield from sent(added())
            held, size, limit, seen = [], 0, 0, 0
    if held:
        yield from sent(added())


def frequent_phrases(docs: DataFrame, min_count: int = 30, max_words: int = 4, shards: int = 2, cells: int | None = None, most_cells: int = 1 << 28, text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, phrase, words, n of all phrases with n >= min_count, and a row (phrase '', words 0) with all words of each part.

    cells: of pairs of words, a power of two; by default one for each 32 bytes of text, from 2 ** 18 to most_cells.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/collocations-{uuid.uuid4().hex}"
    rows = docs.select(F.coalesce(F.col(part_col).cast("string"), F.lit("und")).alias("part"), F.col(text_col).alias("text")).where("length(text) > 0")
    rows.withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int")).write.partitionBy("shard").parquet(f"{folder}/rows")
    dealt = spark.read.schema("part string, text string, shard int").parquet(f"{folder}/rows")
    n_bytes = dealt.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = cells or min(most_cells, max(1 << 18, 1 << (n_bytes // 32).bit_length()))
    salts = int((n_bytes / HELD_BYTES / shards) ** 0.5) // 4
    where = regions(cells, max_words)
    reached, last, t = np.full(sum(where[-1]), NEVER, np.uint8), {}, 0
    while tops := active(last, t, shards, max_words):
        if t == NEVER - 1:
            raise RuntimeError("fewer shards or words, please: scans are numbered in a byte")
        table = spark.sparkContext.broadcast(Reached(reached, t, shards))
        read = lambda found, t=t, table=table, tops=tops: scan(found, t, shards, table.value, where, tops, min_count)
        counted = dealt.where(F.col("shard") == t % shards).select("part", "text").mapInArrow(read, _CELLS)
        if t:
            counted = counted.unionByName(spark.read.schema(_CELLS).parquet(f"{folder}/scan={t - 1}").where(F.col("first") > t - shards))
        summed_blocks(counted, salts, min_count).write.parquet(f"{folder}/scan={t}")
        table.unpersist()
        marks = spark.read.schema("words int, block int, bits binary").parquet(f"{folder}/scan={t}").where("bits IS NOT NULL")
        fresh = [(words, (block << BLOCK_BITS) + np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8)))) for words, block, bits in marks.toLocalIterator()]  # at most max_words * shards * cells / 8 bytes
        fresh = [(words, at[reached[at] == NEVER]) for words, at in fresh]
        for words, at in fresh:
            reached[at] = t
            if len(at):
                last[words] = t
        t += 1
    table = spark.sparkContext.broadcast(Reached(reached, t, shards))
    tasks = max(spark.sparkContext.defaultParallelism, -(-n_bytes // LAST_BYTES))
    exact = dealt.select("part", "text").coalesce(tasks).mapInArrow(lambda found: exact_counts(found, table.value, where, max_words), "part string, phrase string, words int, n long")
    return checkpointed(exact.groupBy("part", "phrase", "words").agg(F.sum("n").alias("n")).where((F.col("n") >= min_count) | (F.col("words") == 0)))


def _spread(of: Column) -> Column:
    return F.xxhash64(of)


def collocations(docs: DataFrame, min_count: int = 30, max_words: int = 4, best: int = 2000, held_percent: int = 80, scale: int = 2_000_000, text_col: str = "text", part_col: str = "lang", **counting: int) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each part."""
    counts = frequent_phrases(docs, min_count, max_words, text_col=text_col, part_col=part_col, **counting)
    phrases = counts.where("words > 0").select("part", "phrase", "words", F.col("n").alias("f"))
    candidates = phrases.where("words > 1").select("part", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    span = lambda start, size: F.array_join(F.slice("w", start, size), " ")

    cuts = candidates.select("part", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("part", "phrase", "a", "k", span(F.lit(1), F.col("k")).alias("first"), span(F.col("k") + 1, F.size("w") - F.col("k")).alias("rest"))
    of = phrases.select("part", "phrase", "f")
    cuts = cuts.join(of.select("part", F.col("phrase").alias("first"), F.col("f").alias("l")), ["part", "first"])
    cuts = cuts.join(of.select("part", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["part", "rest"])
    whole = lambda c: F.col(c).cast("decimal(20,0)")
    scored = cuts.withColumn("top", F.lit(scale).cast("decimal(10,0)") * whole("a")).withColumn("below", whole("l") + whole("r")).withColumn("score", F.expr("top div below"))
    lowest = scored.groupBy("part", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda size: F.transform(F.sequence(F.lit(1), F.col("words") - size + 1), lambda start: F.array_join(F.slice("w", start, size), " "))))
    inside = candidates.where("words > 2").select("part", F.explode(inner).alias("phrase"), F.col("a").alias("longer"))
    longest = inside.groupBy("part", "phrase").agg(F.max("longer").alias("longer"))
    free = lowest.join(longest, ["part", "phrase"], "left").where(F.col("longer").isNull() | (F.lit(100).cast("decimal(10,0)") * whole("longer") < F.lit(held_percent).cast("decimal(10,0)") * whole("a")))
    # the engine keeps the first rows of each task before it brings a part together
    placed = free.select("part", "phrase", "a", "cut.*").withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy(F.desc("score"), F.desc("a"), "phrase"))).where(F.col("rank") <= best)
    totals = counts.where("words = 0").select("part", "n")
    rows = lookup_join(placed, totals, ["part"], "inner", _spread(F.col("phrase")))
    return rows.select(F.col("part").alias("lang"), F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, row_number() OVER () AS piece, list_filter(regexp_split_to_array(x, '[\x20\x09]+'), lambda w: w <> '') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS x FROM t)),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, CAST(len(w) AS BIGINT) - k + 2)) AS i FROM p, (SELECT unnest(range(1, 5)) AS k))),
n AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY lang, k, phrase HAVING count(*) >= 30),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT c.*, j, array_to_string(w[1:j], ' ') AS first, array_to_string(w[j + 1:k], ' ') AS rest FROM (SELECT *, unnest(range(1, k)) AS j FROM cand) c),
scored AS (SELECT c.lang, c.phrase, c.a, c.j, x.f AS l, y.f AS r, CAST((CAST(2000000 AS HUGEINT) * c.a) // (x.f + y.f) AS BIGINT) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.first JOIN f y ON y.lang = c.lang AND y.phrase = c.rest),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, w, s, a, unnest(range(1, k - s + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS s FROM cand WHERE k > 2)) GROUP BY 1, 2),
free AS (SELECT l.* FROM lowest l LEFT JOIN inside i ON l.lang = i.lang AND l.phrase = i.phrase WHERE i.longer IS NULL OR 100 * i.longer < 80 * l.a)
SELECT q.lang, rank, phrase, a, l, r, CAST(n.n AS BIGINT) AS n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM free) q
JOIN n ON n.lang = q.lang WHERE rank <= 2000
"""
