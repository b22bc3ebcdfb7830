r"""Operator 12, quality classifier: supervised subword embeddings.

Features of a text: its words (runs without space and \x09-\x0D), pairs of words in a row, a word that repeats the one before it, and
the character 3- to 5-grams of the words, a space on either side included. Each occurrence is hashed to one of `buckets` rows of an
embedding. A document is the average of its features' vectors, its class probabilities are the softmax of a linear layer on it, and
both are learned together by stochastic gradient descent in numpy.

Fit: on at most max_docs labelled documents (a parameter; those with the smallest hashes of id), whose features are counted in
parallel and then read by one training task; the order of the steps is drawn from a fixed seed, so a lost executor's rerun gives
the same model. The model is a row of fixed size, whatever the corpus. Scoring needs no labels: the two layers collapse to one
number for each bucket, and tasks average it over all features of a whole text.

Cases: a text that is null, empty or only white space has no features; its score is that of the bias alone. Texts of over `stretch`
code points are taken in stretches cut at a white space, or hard if there is none (no pair of words across the cut); all of them count.
Ids and labels may be null (a null id or label is not trained on). Several labels of one id: any 1 counts. Ids that repeat are scored row by row, and
trained on once (the smallest text). Extra columns are ignored. Without any training row scores are 0.5; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixspark.llm.common import map_frames
from helixspark.llm.shingles import mixed

BUCKETS = 1 << 17
GRAMS = (3, 4, 5)
STRETCH = 1_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_CUT = re.compile(r"[\x20\x09-\x0D]")


def _stretches(text: str, stretch: int) -> Iterator[str]:
    at = 0
    while at < len(text):
        found = _CUT.search(text, at + stretch, at + 2 * stretch) if len(text) - at > stretch else None
        end = found.end() if found else at + 2 * stretch if len(text) - at > 2 * stretch else len(text)
        yield text[at:end]
        at = end


def features(text: str | None, buckets: int = BUCKETS, stretch: int = STRETCH) -> Iterator[np.ndarray]:
    """Arrays of the buckets of all features of the text, in pieces."""
    for part in _stretches(text or "", stretch):
        code = np.frombuffer(part.encode("utf-32-le"), np.uint32).astype(np.uint64)
        blank = (code == 32) | ((code >= 9) & (code <= 13))
        if blank.all():
            continue
        keep = ~blank
        keep[1:] |= ~blank[:-1]  # one blank behind each word
        code = np.where(blank, np.uint64(32), code)[keep]
        code = np.pad(code, (1, int(not blank[-1])), constant_values=32)
        space = code == 32
        with np.errstate(over="ignore"):
            letter = mixed(code * _STEP + np.uint64(1))
            starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
            ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
            place = np.arange(len(code), dtype=np.uint64)
            place[1:] -= np.repeat(place[starts], np.diff(np.append(starts, len(code))))
            own = np.where(space, np.uint64(0), mixed(letter + place * _STEP))
            word = mixed(np.add.reduceat(own, starts) + (ends - starts).astype(np.uint64))
            found = [word, mixed(word[:-1] * _STEP + word[1:])[word[:-1] != word[1:]], np.full(int((word[:-1] == word[1:]).sum()), 7, np.uint64)]
            rolled = letter.copy()
            inside = np.cumsum(space)
            for n in range(2, max(GRAMS) + 1):
                rolled = rolled[:-1] * _STEP + letter[n - 1 :]
                if n in GRAMS:
                    whole = inside[n - 2 : len(code) - 1] == inside[: len(rolled)]  # no space but at the ends
                    found.append(mixed(rolled[whole] + np.uint64(n)))
        yield (np.concatenate(found) % np.uint64(buckets)).astype(np.int32)


def counted(text: str | None, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of the text's features and their shares."""
    total = np.zeros(buckets, np.int64)
    for f in features(text, buckets):
        total += np.bincount(f, minlength=buckets)
    at = np.flatnonzero(total)
    return at.astype(np.int32), (total[at] / max(1, total.sum())).astype(np.float32)


@dataclass
class Model:
    """What scoring needs: log odds of label 1 = bias + average of weights over a text's features."""

    weights: np.ndarray
    bias: float


def labelled(docs: DataFrame, labels: DataFrame, train: Column, max_docs: int, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """place, text, label: at most max_docs documents, those with the smallest hashes of id among ids with a label for which `train` (an expression over the column id) holds."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col)).cast("int").alias("label")).where(train)
    chosen = known.withColumn("place", F.xxhash64("id")).orderBy("place", "id").limit(max_docs)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "id").groupBy("id", "place", "label").agg(F.min("text").alias("text")).select("place", "text", "label")


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], buckets: int, size: int, epochs: int, rate: float, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embedding, output layer and bias after stochastic gradient descent with a falling rate."""
    rnd = np.random.default_rng(seed)
    table = (rnd.random((buckets, size), np.float32) - np.float32(0.5)) / size
    out, bias, step, steps = np.zeros((size, 2), np.float32), np.zeros(2, np.float32), 0, epochs * max(1, len(examples))
    for _ in range(epochs):
        for k in rnd.permutation(len(examples)):
            at, share, label = examples[k]
            now = np.float32(rate * (1 - step / steps))
            step += 1
            rows = table[at]
            hidden = share @ rows
            logits = hidden @ out + bias
            odds = np.exp(logits - logits.max())
            wrong = odds / odds.sum()
            wrong[label] -= 1
            back = out @ wrong
            out -= now * np.outer(hidden, wrong)
            bias -= now * np.float32(0.1) * wrong
            table[at] = rows - now * (share / share.max() if len(share) else share)[:, None] * back
    return table, out, bias


def fit(sample: DataFrame, buckets: int = BUCKETS, size: int = 16, epochs: int = 5, rate: float = 0.3, seed: int = 11) -> Model:
    """Learns from place, text, label (see labelled). One task reads the bounded sample's feature counts; the driver gets one row of `buckets` numbers."""

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [counted(t, buckets) for t in b["text"]]
            yield pd.DataFrame({"place": b["place"], "label": b["label"], "at": [x.tobytes() for x, _ in found], "share": [y.tobytes() for _, y in found]})

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame(columns=["place", "label", "at", "share"]), *batches]).sort_values(["place", "label", "at"])
        examples = [(np.frombuffer(a, np.int32), np.frombuffer(s, np.float32), int(y)) for a, s, y in zip(rows["at"], rows["share"], rows["label"])]
        table, out, bias = train(examples, buckets, size, epochs, rate, seed)
        toward = out[:, 1] - out[:, 0]
        yield pd.DataFrame({"weights": [(table @ toward).astype(np.float32).tobytes()], "bias": [float(bias[1] - bias[0])]})

    row = map_frames(map_frames(sample, counts, "place long, label int, at binary, share binary").repartition(1), learn, "weights binary, bias double").first()
    return Model(np.frombuffer(row["weights"], np.float32), row["bias"])


def predict(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1, rounded to 6 places), predicted (1 from the threshold on) for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets * 4 bytes
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            scores = []
            for text in b["text"]:
                total, n = 0.0, 0
                for f in features(text, len(m.weights)):
                    total, n = total + float(m.weights[f].sum(dtype=np.float64)), n + len(f)
                scores.append(round(float(1 / (1 + np.exp(-np.clip(m.bias + total / max(1, n), -50, 50)))), 6))
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": scores, "predicted": [int(s >= threshold) for s in scores]})

    return map_frames(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {id_type}, score double, predicted int")


def held_out(ids: Column, share: int = 5) -> Column:
    """Whether crc32 of the id as text is divisible by share; null ids are not held out."""
    return F.coalesce(F.pmod(F.crc32(ids.cast("string")), F.lit(share)) == 0, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame, max_docs: int = 3000, threshold: float = 0.3, share: int = 5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs; learns from labels of ids that aren't held out."""
    model = fit(labelled(docs, labels, ~held_out(F.col("id"), share), max_docs, id_col, text_col, label_col))
    return predict(docs, model, threshold, id_col, text_col).select("doc_id", held_out(F.col("doc_id"), share).alias("held_out"), "score", "predicted")
