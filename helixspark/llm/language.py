"""Operator 10, language ID: language-bitmask n-gram filters.

Fit (Spark): character n-grams of 1 to 4 letters of the labelled texts are counted by language. A language claims an n-gram if it
has it at least min_count times and at no less than `ratio` of the highest rate of any language. The claims go into a bit-sliced
Bloom filter: `slots` words with one bit a language; an n-gram sets its languages' bits in each of its `hashes` slots. The filter
is one bounded table of slots x 8 bytes for each 64 languages.

Predict: for each n-gram of a text, the AND of its slots gives at once all languages that claim it. Per-language popcounts over
the text are corrected for the filter's false positives, (count - n * f) / (1 - f) with f = fill ** hashes, and the largest wins
(ties: the first in order). The score is the winner's lead over the runner-up.

Bound: the fit reads at most about max_docs_per_language documents of a language, chosen by a hash of the id (all of them where
there are fewer); whole texts are used. Prediction reads every row.

Cases: null texts and texts without a letter give `und`, score 0; so does everything if nothing was learned. Repeated rows get
equal results. lang, source and id are no inputs of a prediction; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixspark.llm.common import checkpointed, map_frames

ORDERS = (1, 2, 3, 4)
#: All but letters and the marks (vowel signs, accents) that belong to them.
_BREAK = regex.compile(r"[^\p{L}\p{M}]+")
MIX = np.uint64(0x9E3779B97F4A7C15)


def letters(text: str | None) -> str:
    """Lower-cased text, all between its letters one space; empty if it has no letter."""
    s = _BREAK.sub(" ", text.lower()) if text else ""
    return f" {s.strip()} " if any(map(str.isalpha, s)) else ""


def grams(s: str) -> np.ndarray:
    """64-bit hashes of all n-grams of 1 to 4 characters, the space at a word's edge included."""
    x = np.frombuffer(s.encode("utf-32-le"), np.uint32).astype(np.uint64)
    out, h = [], np.zeros(len(x), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        h = (h[: len(x) - n + 1] * np.uint64(0x100000001B3)) + x[n - 1 :] + np.uint64(n)
        if n in ORDERS:
            g = (h ^ (h >> np.uint64(31))) * MIX
            out.append(g ^ (g >> np.uint64(29)))
    return np.concatenate(out)


def slots_of(g: np.ndarray, slots: int, hashes: int) -> list[np.ndarray]:
    step = (g >> np.uint64(33)) | np.uint64(1)
    return [((g + np.uint64(k) * step) % np.uint64(slots)).astype(np.int64) for k in range(hashes)]


def training_rows(docs: DataFrame, max_docs_per_language: int, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """text and lang of the rows to learn from: crc32(id as text) mod 3 is not 1, lang is known, bounded by a hash of the id."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL").where(F.crc32(F.col("id").cast("binary")) % 3 != 1)
    counts = rows.groupBy("lang").agg(F.count("*").alias("docs"))
    share = F.lit(float(max_docs_per_language)) / F.col("docs")
    return rows.join(F.broadcast(counts), "lang").where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share * 1_000_000).select("text", "lang")


def fit(train: DataFrame, slots: int = 1 << 20, hashes: int = 2, min_count: int = 3, ratio: float = 0.5) -> dict:
    """The filter: languages, slots, hashes, and `words`, an array of slots x ceil(languages / 64) masks."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, part in b.groupby("lang"):
                found = [grams(s) for s in map(letters, part["text"]) if s]
                if found:
                    g, n = np.unique(np.concatenate(found), return_counts=True)
                    yield pd.DataFrame({"lang": lang, "gram": g.view(np.int64), "n": n.astype(np.int64)})

    counted = checkpointed(train.mapInPandas(count, "lang string, gram long, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n")))
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    langs = sorted(r["lang"] for r in totals.select("lang").collect())
    if not langs:
        return {"langs": [], "slots": slots, "hashes": hashes, "words": np.zeros((slots, 1), np.uint64)}
    order = F.create_map(*[F.lit(x) for k, v in enumerate(langs) for x in (v, k)])
    rated = counted.join(F.broadcast(totals), "lang").select("gram", "n", F.get(F.array(*[F.lit(k) for k in range(len(langs))]), order[F.col("lang")]).alias("bit"), (F.col("n") / F.col("total")).alias("rate"))
    best = rated.groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("bit", "rate", "n")).alias("each"))
    claims = best.select("gram", F.col("top"), F.explode("each").alias("e")).where((F.col("e.n") >= min_count) & (F.col("e.rate") >= ratio * F.col("top")))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            bit = b["bit"].to_numpy().astype(np.int64)
            for at in slots_of(b["gram"].to_numpy().view(np.uint64), slots, hashes):
                yield pd.DataFrame({"slot": at, "part": (bit // 64).astype(np.int32), "mask": (np.uint64(1) << (bit % 64).astype(np.uint64)).view(np.int64)})

    masks = claims.select("gram", F.col("e.bit").alias("bit")).mapInPandas(place, "slot long, part int, mask long").groupBy("slot", "part").agg(F.bit_or("mask").alias("mask"))
    words = np.zeros((slots, (len(langs) + 63) // 64), np.uint64)
    got = masks.toPandas()  # at most slots rows for each 64 languages
    words[got["slot"].to_numpy(), got["part"].to_numpy()] = got["mask"].to_numpy().astype(np.int64).view(np.uint64)
    return {"langs": langs, "slots": slots, "hashes": hashes, "words": words}


class Scorer:
    def __init__(self, model: dict):
        self.langs, self.slots, self.hashes, self.words = model["langs"], model["slots"], model["hashes"], model["words"]
        bits = [(k // 64, np.uint64(k % 64)) for k in range(len(self.langs))]
        fill = np.array([np.count_nonzero(self.words[:, p] >> b & np.uint64(1)) / self.slots for p, b in bits])
        self.false, self.bits = fill**self.hashes, bits

    def __call__(self, text: str | None) -> tuple[str, float]:
        s = letters(text)
        if not s or not self.langs:
            return "und", 0.0
        g = grams(s)
        at = slots_of(g, self.slots, self.hashes)
        masks = self.words[at[0]]
        for a in at[1:]:
            masks &= self.words[a]
        counts = np.array([np.count_nonzero(masks[:, p] & (np.uint64(1) << b)) for p, b in self.bits])
        rate = np.maximum((counts - len(g) * self.false) / (1 - self.false), 0) / len(g)
        best = int(np.argmax(rate))
        rest = np.delete(rate, best)
        second = float(rest.max()) if len(rest) else 0.0
        score = (rate[best] - second) / rate[best] if rate[best] > 0 else 0.0
        return self.langs[best], float(min(1.0, max(0.0, score)))


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = Scorer(shared.value)
        for b in batches:
            out = [score(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "lang_pred": [x for x, _ in out], "score": [y for _, y in out]})

    rows = map_frames(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {id_type}, lang_pred string, score double")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return rows.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
