r"""Operator 7, substring dedup by line hashing.

Units are the lines and, in them, the sentences (ended by . ! or ? and white space), so that a passage inside a paragraph is found
too. Units are normalised (lower case, white space to one space) and hashed (64 bits and the word count; lines apart from sentences).
Digests are grouped globally, by partial aggregates, to the smallest id that has them; a unit is a repeat if a document of a smaller
id, or an earlier place in its own document, has it. Repeated lines are removed whatever their length. Of the other lines, repeated
sentences that stand in a row (together with removed lines beside them) are removed if they come to at least min_words words;
shorter ones (stock phrases) stay. What is removed keeps its original offsets.

Cases: null text counts as empty: no units, nothing removed, an empty kept text. A row is known by its id and a 64-bit hash of its
text, so rows that repeat an id with other texts, and null ids, are told apart. Rows of the same id rank equal: each loses what
smaller ids have, nothing to each other. Null ids rank last, equal among themselves. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixspark.llm.common import checkpointed, map_frames

#: A unit with the white space behind it; the possessive runs keep it linear in texts like !!!!.
_UNIT = re.compile(r"(?:[^\n.!?]++|[.!?]++(?!\s))*+[.!?]*+\s*")


def units_of(text: str) -> list[tuple[int, int, int, int, int, int]]:
    """(number, start, end, words, digest, 0) of each sentence; (first sentence, start, end, words, digest, sentences) of each line.

    Ends include the white space behind.
    """
    out, at, k = [], 0, 0
    line: list[str] = []
    first = start = 0
    for m in _UNIT.finditer(text):
        if m.end() == at:
            continue
        words = m.group().lower().split()
        if words:
            out.append((k, at, m.end(), len(words), xxhash.xxh3_64_intdigest(" ".join(words)) - (1 << 63), 0))
            if not line:
                first, start = k, at
            line += words
            k += 1
        at = m.end()
        if line and ("\n" in m.group() or at == len(text)):
            out.append((first, start, at, len(line), xxhash.xxh3_64_intdigest(" ".join(line) + "\n") - (1 << 63), k - first))
            line = []
    return out


def unit_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: np.ndarray | None = None) -> DataFrame:
    """doc_id, h (hash of the text), at (number of the unit's first sentence), start, stop, words, digest, sentences (of a line, else 0), again (seen before in the same text).

    known: bits by the low part of a digest; units that are not seen again and whose bit isn't set are left out.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    columns = ["doc_id", "h", "at", "start", "stop", "words", "digest", "sentences", "again"]
    shared = docs.sparkSession.sparkContext.broadcast(known) if known is not None else None  # of fixed size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, h, t in zip(b["doc_id"], b["h"], b["text"]):
                seen: set = set()
                for k, start, stop, words, digest, sentences in units_of(t) if t else ():
                    rows.append((i, h, k, start, stop, words, digest, sentences, digest in seen))
                    seen.add(digest)
            out = pd.DataFrame(rows, columns=columns)
            if shared is not None and rows:
                bit = out["digest"].to_numpy(np.int64) & (8 * len(shared.value) - 1)
                out = out[out["again"].to_numpy(bool) | (shared.value[bit >> 3] >> (bit & 7) & 1).astype(bool)]
            yield out

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"))
    return map_frames(rows, run, f"doc_id {id_type}, h long, at int, start int, stop int, words int, digest long, sentences int, again boolean")


def digest_bits(owners: DataFrame, bits: int) -> np.ndarray:
    """A bit for the low part of each digest, in bytes; bits is a power of two of 32768 or more. The driver gets bits / 8 bytes at most."""
    low = F.col("digest").bitwiseAND(bits - 1)
    blocks = owners.groupBy(F.shiftright(low, 15).alias("block")).agg(F.bitmap_construct_agg(low.bitwiseAND(32767)).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for block, found in blocks.toLocalIterator():
        out[block * 4096 : block * 4096 + 4096] = np.frombuffer(found, np.uint8)
    return out


def repeated_spans(docs: DataFrame, broadcast_rows: int = 100_000, bits: int = 1 << 27, hot_share: float = 1e-5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h and the text's repeated units [(at, start, stop, words, sentences)].

    Up to broadcast_rows repeated digests are broadcast. Beyond, units without a repeated digest are left out in the tasks by a bitmap of
    fixed size (a false hit costs a row, nothing else), and the rest is joined: digests of over hot_share of all units, which are at
    most 1 / hot_share, by a broadcast, all others by the digest.
    """
    groups = unit_rows(docs, id_col, text_col).where("NOT again").groupBy("digest", "words").agg(F.count("*").alias("n"), F.min("doc_id").alias("owner")).where("n > 1")
    groups = checkpointed(groups)
    count, total = groups.agg(F.count("*"), F.sum("n")).first()
    owners = groups.select("digest", "words", "owner")
    if count <= broadcast_rows:
        judged = unit_rows(docs, id_col, text_col).join(F.broadcast(owners), ["digest", "words"], "left")
    else:
        units = unit_rows(docs, id_col, text_col, digest_bits(groups, bits))
        hot = groups.where(F.col("n") > F.greatest(F.lit(1000), F.lit(int(total * hot_share)))).select("digest", "words", F.col("owner").alias("_hot"), F.lit(True).alias("_is_hot"))
        met = units.join(F.broadcast(hot), ["digest", "words"], "left")
        # units of hot digests have their owner; a key of their own deals them over all tasks
        met = met.withColumn("_key", F.when(F.col("_is_hot"), F.xxhash64("doc_id", "h", "at", "sentences")).otherwise(F.col("digest"))).withColumn("_size", F.when(F.col("_is_hot"), -1).otherwise(F.col("words")))
        judged = met.join(owners.withColumnsRenamed({"digest": "_key", "words": "_size"}), ["_key", "_size"], "left").withColumn("owner", F.coalesce("_hot", "owner"))
    repeat = F.col("again") | (F.col("owner").isNotNull() & (F.col("doc_id").isNull() | (F.col("owner") < F.col("doc_id"))))
    return judged.where(repeat).groupBy("doc_id", "h").agg(F.collect_set(F.struct("at", "start", "stop", "words", "sentences")).alias("repeats"))


def joined(sentences: Iterable) -> list[list[int]]:
    """The runs [last sentence, start, stop, words, sentences] of sentences in a row."""
    runs: list[list[int]] = []
    for u in sentences:
        if runs and runs[-1][0] + 1 == u["at"]:
            runs[-1] = [u["at"], runs[-1][1], u["stop"], runs[-1][3] + u["words"], runs[-1][4] + 1]
        else:
            runs.append([u["at"], u["start"], u["stop"], u["words"], 1])
    return runs


def remove_repeats(docs: DataFrame, min_words: int = 25, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 100_000) -> DataFrame:
    """doc_id, n_removed_units, n_removed_words, n_removed_chars, removed_spans [(start, stop)] in the original text, kept_text."""
    id_type = docs.schema[id_col].dataType.simpleString()
    spans = repeated_spans(docs, broadcast_rows, id_col=id_col, text_col=text_col).withColumnsRenamed({"doc_id": "_id", "h": "_h"})
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"))
    rows = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left").select("doc_id", "text", "repeats")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, text, repeats in zip(b["doc_id"], b["text"], b["repeats"]):
                found = sorted(repeats, key=lambda u: u["at"]) if repeats is not None else []
                sentences = [u for u in found if not u["sentences"]]
                in_lines = {k for u in found for k in range(u["at"], u["at"] + u["sentences"])}
                long = {k for r in joined(sentences) if r[3] >= min_words for k in range(r[0] - r[4] + 1, r[0] + 1)}
                runs = joined(u for u in sentences if u["at"] in in_lines or u["at"] in long)
                text, kept, at = text or "", [], 0
                for _, start, stop, _, _ in runs:
                    kept.append(text[at:start])
                    at = stop
                kept.append(text[at:])
                out.append((i, sum(r[4] for r in runs), sum(r[3] for r in runs), sum(r[2] - r[1] for r in runs), [{"start": r[1], "stop": r[2]} for r in runs], "".join(kept)))
            yield pd.DataFrame(out, columns=["doc_id", "n_removed_units", "n_removed_words", "n_removed_chars", "removed_spans", "kept_text"])

    return map_frames(rows, run, f"doc_id {id_type}, n_removed_units long, n_removed_words long, n_removed_chars long, removed_spans array<struct<start:int,stop:int>>, kept_text string")
