"""Operator 9, BPE encoding and decoding: forced-boundary splitting.

A byte pair that occurs inside no token of the vocabulary can never be bridged by a merge, so every place where such a pair
stands is a certain cut. Encoding a text means: take out the special tokens, split the rest by the tokenizer's pattern, cut each
piece at its forced boundaries, encode the fragments on their own (a heap of merges, O(n log n), with a bounded memo for the
frequent ones) and concatenate. Decoding joins the tokens' bytes and reads them as UTF-8 with replacement.

The vocabulary is read from a tokenizer file of the usual JSON layout on each worker (path is a parameter) and never trained.

Cases: null text counts as empty, which has no tokens and decodes to the empty text. Every row is encoded on its own, so
repeated rows, ties and extra columns change nothing; an empty table gives no rows; long texts and long pieces without any
boundary cost O(n log n).
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixspark.llm.common import map_frames

#: Fixed value: the pattern by which byte-level tokenizers of this kind split a text (white space by its Unicode property).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: The same for texts without code points over 255, with the classes written out: the letters, numbers and white space among these.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
NARROW = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
#: Pieces that a worker remembers at most; the memo is emptied beyond.
MEMO = 300_000
#: Characters after which a task hands on what it has encoded, so that it never holds the ids of a whole Arrow batch.
HAND_ON = 1 << 20
NO_MERGE = (1 << 60, -1)


def byte_characters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else 256 and on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(printable) else chr(next(spare)) for b in range(256)]


class Codec(dict):
    """A memo from pieces to their ids, with the tables of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, of_char = spec["model"]["vocab"], {c: b for b, c in enumerate(byte_characters())}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: bytes(of_char[c] for c in t) for t, i in vocab.items() if t not in self.special}
        names |= {i: t.encode() for t, i in self.special.items()}
        self.bytes_of = [names.get(i, b"") for i in range(max(names) + 1)]
        self.single = [vocab[c] for c in byte_characters()]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.merge = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        inside = np.zeros(65536, bool)
        for i, t in names.items():
            b = np.frombuffer(t, np.uint8).astype(np.int32)
            inside[b[:-1] * 256 + b[1:]] = True
        self.inside = inside.tobytes()
        self.find_any, self.find_narrow = regex.compile(PATTERN).findall, re.compile(NARROW).findall
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None

    def find(self, text: str) -> list[str]:
        """The pieces of a text by the tokenizer's pattern."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.find_any(text)
        return self.find_narrow(text)

    def fragments(self, piece: bytes) -> list[bytes]:
        """Cuts a piece at its forced boundaries."""
        inside = self.inside
        cuts = [i for i in range(1, len(piece)) if not inside[piece[i - 1] << 8 | piece[i]]]
        if not cuts:
            return [piece]
        return [piece[i:j] for i, j in zip([0, *cuts], [*cuts, len(piece)])]

    def merged(self, fragment: bytes) -> list[int]:
        """Applies the merges to one fragment, the best rank first and the leftmost of equal ones."""
        single = self.single
        ids = [single[b] for b in fragment]
        n = len(ids)
        return self.merged_short(ids) if n <= 24 else self.merged_long(ids)

    def merged_short(self, ids: list[int]) -> list[int]:
        """Rescans the pairs next to each merge; for few ids that beats a heap."""
        find = self.merge.get
        ranks = list(map(find, zip(ids, ids[1:]), repeat(NO_MERGE)))
        while ranks:
            best = min(ranks)
            if best is NO_MERGE:
                break
            i = ranks.index(best)
            ids[i] = best[1]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = find((ids[i - 1], ids[i]), NO_MERGE)
            if i < len(ranks):
                ranks[i] = find((ids[i], ids[i + 1]), NO_MERGE)
        return ids

    def merged_long(self, ids: list[int]) -> list[int]:
        n = len(ids)
        nxt, prev, merge = list(range(1, n + 1)), list(range(-1, n - 1)), self.merge
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := merge.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = nxt[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j], nxt[i] = new, -1, nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
                if m := merge.get((new, ids[nxt[i]])):
                    heapq.heappush(heap, (m[0], i, new, ids[nxt[i]], m[1]))
            if prev[i] >= 0 and (m := merge.get((ids[prev[i]], new))):
                heapq.heappush(heap, (m[0], prev[i], ids[prev[i]], new, m[1]))
        return [i for i in ids if i >= 0]

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple(chain.from_iterable(map(self.merged, self.fragments(piece.encode()))))
        if len(piece) <= 40:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        if self.split_special is None or not any(s in text for s in self.special):
            return list(chain.from_iterable(map(self.__getitem__, self.find(text))))
        out: list[int] = []
        for k, part in enumerate(self.split_special(text)):
            out.extend([self.special[part]] if k % 2 else chain.from_iterable(map(self.__getitem__, self.find(part))))
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", check_decode: bool = True) -> DataFrame:
    """doc_id, ids array<int> and, decoded from these ids, `decoded` for each row of docs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for b in batches:
            doc_ids, texts, start = b["doc_id"], b["text"], 0
            ids: list[np.ndarray] = []
            decoded: list[str | None] = []
            held = 0
            for k, t in enumerate(texts, 1):
                found = c.encode(t) if t else []
                decoded.append(c.decode(found) if check_decode else None)
                ids.append(np.array(found, np.int32))
                held += len(t) if t else 0
                if held >= HAND_ON or k == len(texts):
                    yield pd.DataFrame({"doc_id": doc_ids.iloc[start:k].array, "ids": ids, "decoded": decoded})
                    ids, decoded, held, start = [], [], 0, k

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_frames(rows, run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids array<int>, decoded string")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": [c.decode([] if x is None else list(x)) for x in b["ids"]]})

    return map_frames(encoded.select("doc_id", "ids"), run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def token_digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.coalesce("decoded", F.lit("")), 256).alias("decoded_sha256"),
    )
