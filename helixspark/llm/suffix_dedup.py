"""Operator 4, suffix-array dedup over UTF-8 bytes.

A byte goes if a `span`-byte string that covers it also starts in a document of a smaller id. A full suffix array has a suffix a
byte; this one is sparse. Anchors are chosen by winnowing: of the k-grams of every span-byte window the one of the smallest hash
(all of equal ones), so equal windows have equal anchors at equal offsets, and about 2 / (span - k + 2) of the positions are kept.

1. Candidates: tasks pack the anchors' hashes (48 bits and a bucket), each once a chunk of texts, into one blob a bucket, and
   the buckets find those that two documents have. A false candidate costs work, never correctness.
2. Suffixes: each candidate anchor becomes a suffix: the `span` bytes from it on and the span - k bytes before it. Inside a chunk
   equal suffixes send only those of the smallest document; the others are removed on the spot, so a text with thousands of
   copies sends one row a chunk.
3. Range partitions: splitters sampled from the leading k bytes of suffixes deal them into buckets. A bucket is sorted by Spark
   and then, run by run, by multikey quicksort (8-byte tokens: less, equal, greater than a pivot; the equal part goes on with the
   next token); suffixes of equal leading k bytes are compared on every window through the anchor. Most splitters fall between
   different leading k-grams. Where a k-gram is so frequent that splitters fall inside its run (or a run outgrows a task's bound),
   the run is cut: its suffixes are dealt by their whole context over all buckets, each part settles equal contexts by itself,
   and what remains is compared across the cuts: (window digest, smallest id) pairs are aggregated and joined back.
4. Removed intervals are grouped by document and joined to its bytes.

The number of candidate buckets follows the input's bytes, so that a bucket's hashes fit a task at any size.

The candidate set is broadcast only up to broadcast_bytes (checked); beyond, candidates reach their documents by a join.

Cases: null text counts as empty: n_bytes 0 and the digest of nothing. Texts shorter than span bytes lose nothing. Equal texts:
all but the one of the smallest id lose all bytes. Rows that repeat an id: each loses what smaller ids have, nothing to each other; a
row is told from its twins by a 64-bit hash of its text (the column `twin`, 0 where the id alone tells). Null ids come last (after
every id) and are twins of each other in the same way. Extra columns are ignored; an empty table gives no rows.

Contexts are compared byte by byte, their windows by 64-bit digests inside a sorted part and by 128 bits across cuts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixspark.llm.common import checkpointed, lookup_join, map_frames, shuffle_partitions

_B = np.uint64(0x100000001B3)
_LAST = np.iinfo(np.int64).max


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _extreme(a: np.ndarray, width: int, f) -> np.ndarray:
    """The minimum or maximum of every `width` neighbours."""
    size = 1
    while size * 2 <= width:
        a = f(a[:-size], a[size:])
        size *= 2
    return f(a[: len(a) - (width - size)], a[width - size :]) if size < width else a


def _kgram_hashes(x: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-grams, by doubling."""
    n = len(x) - k + 1
    power, cur, done, out, at = int(_B), x.astype(np.uint64) + np.uint64(1), 1, np.zeros(n, np.uint64), 0
    for bit in range(k.bit_length()):
        if k >> bit & 1:
            out = out * np.uint64(power) + cur[at : at + n]
            at += done
        if 2 * done <= k:
            cur = cur[:-done] * np.uint64(power) + cur[done:]
            power, done = power * power % (1 << 64), done * 2
    return _mix(out)


class Chunk:
    """Several texts end to end, their anchors, and for each anchor its text."""

    def __init__(self, texts: list[bytes], span: int, k: int):
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        x = self.x = np.frombuffer(b"".join(texts), np.uint8)
        width = span - k + 1
        if len(x) < span:
            self.at = self.text = np.zeros(0, np.int64)
            self.hash = np.zeros(0, np.uint64)
            return
        h = _kgram_hashes(x, k)
        low = _extreme(h, width, np.minimum)
        inside = np.zeros(len(x) + 1, np.int32)  # windows that end in their text
        fits = self.lengths >= span
        inside[self.starts[fits]] += 1
        np.subtract.at(inside, self.ends[fits] - span + 1, 1)
        low[np.cumsum(inside)[: len(low)] == 0] = 0
        edge = np.zeros(width - 1, np.uint64)
        high = _extreme(np.concatenate([edge, low, edge]), width, np.maximum)
        self.at = np.flatnonzero((h == high) & (high > 0))
        self.hash = h[self.at]
        self.text = np.searchsorted(self.ends, self.at, "right")


def _chunks(batches: Iterator[pd.DataFrame], limit: int) -> Iterator[tuple[pd.DataFrame, list[bytes]]]:
    """Rows in chunks of about limit bytes; a longer text is one by itself."""
    for b in batches:
        sizes = np.cumsum([len(t) if t else 0 for t in b["text"]]) // limit
        cuts = np.flatnonzero(np.diff(sizes)) + 1
        for i, j in zip(np.r_[0, cuts], np.r_[cuts, len(b)]):
            if i < j:
                rows = b.iloc[i:j]
                yield rows, [t.encode() if t else b"" for t in rows["text"]]


def _ids(rows: pd.DataFrame) -> np.ndarray:
    """The ids of a frame of nullable integers; null is the last."""
    return rows["doc_id"].astype("Int64").fillna(_LAST).to_numpy(np.int64)


def shared_hashes(docs: DataFrame, span: int, k: int, buckets: int) -> DataFrame:
    """bucket and `found`, the hashes (8 bytes each, packed) that at least two documents have an anchor of."""
    low = np.uint64(buckets - 1)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, texts in _chunks(batches, 3 << 20):
            c, ids = Chunk(texts, span, k), _ids(rows)
            if not len(c.at):
                continue
            key = (c.hash & ~np.uint64(0xFFFF)) | (c.hash & low)
            order = np.lexsort((ids[c.text], key))
            key, owner = key[order], ids[c.text][order]
            new = np.r_[True, key[1:] != key[:-1]]
            first = np.flatnonzero(new)
            last = np.r_[first[1:], len(key)] - 1
            several = owner[first] != owner[last]
            key = key[first]
            bucket = (key & low).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            key, several, bucket = key[order], several[order], bucket[order]
            raw = (key >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6]
            cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            stop = np.r_[cut[1:], len(key)]
            yield pd.DataFrame({"bucket": bucket[cut].astype(np.int32), "once": [raw[i:j].tobytes() for i, j in zip(cut, stop)], "twice": [raw[i:j][several[i:j]].tobytes() for i, j in zip(cut, stop)]})

    def wide(blobs: pd.Series) -> np.ndarray:
        raw = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 6)
        out = np.zeros((len(raw), 8), np.uint8)
        out[:, :6] = raw
        return out.view(np.uint64).ravel()

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        once, twice = np.sort(wide(group["once"])), wide(group["twice"])
        found = np.union1d(once[1:][once[1:] == once[:-1]], twice)
        bucket = int(group["bucket"].iloc[0])
        return pd.DataFrame({"bucket": [bucket], "found": [((found << np.uint64(16)) | np.uint64(bucket)).tobytes()]})

    packed = map_frames(docs, pack, "bucket int, once binary, twice binary")
    return packed.groupBy("bucket").applyInPandas(meet, "bucket int, found binary")


def multikey_order(rows: np.ndarray, small: int = 64) -> np.ndarray:
    """The order of byte rows by multikey quicksort over 8-byte tokens; parts of at most `small` rows are sorted directly."""
    pad = -rows.shape[1] % 8
    tokens = np.ascontiguousarray(np.pad(rows, ((0, 0), (0, pad)))).view(">u8").astype(np.uint64)
    order, depth = np.arange(len(rows)), tokens.shape[1]
    todo = [(0, len(rows), 0)]
    while todo:
        lo, hi, d = todo.pop()
        if hi - lo < 2 or d == depth:
            continue
        part = order[lo:hi]
        if len(part) <= small:
            order[lo:hi] = part[np.lexsort(tokens[part, d:].T[::-1])]
            continue
        key = tokens[part, d]
        pivot = np.sort(key[:: max(1, len(key) // 31)])[len(key[:: max(1, len(key) // 31)]) // 2]
        less, more = key < pivot, key > pivot
        a, b = int(less.sum()), len(part) - int(more.sum())
        order[lo:hi] = np.concatenate([part[less], part[~less & ~more], part[more]])
        todo += [(lo, lo + a, d), (lo + a, lo + b, d + 1), (lo + b, hi, d)]
    return order


def _windows(left: np.ndarray, right: np.ndarray, span: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and most bytes a window through an anchor can have before it."""
    return np.maximum(0, span - right), np.minimum(span - k, left)


class Run:
    """Sorted suffixes, reduced to their distinct contexts.

    A suffix is the bytes (left, right, before, from the anchor on), the latter two padded with zeros. A context's smallest
    document stands for it; all others lose every window of it.
    """

    def __init__(self, ctx: np.ndarray, ids: np.ndarray, twins: np.ndarray, at: np.ndarray, span: int, k: int):
        self.span, self.k, self.back = span, k, span - k
        order = multikey_order(np.hstack([ctx[:, 2 + self.back :], ctx[:, 2 : 2 + self.back], ctx[:, :2]]))
        ctx, self.ids, self.twins, self.at = ctx[order], ids[order], twins[order], at[order]
        new = np.r_[True, (ctx[1:] != ctx[:-1]).any(axis=1)]
        self.which = np.cumsum(new) - 1
        self.smallest = np.minimum.reduceat(self.ids, np.flatnonzero(new))
        self.ctx = ctx[new]
        self.lo, self.hi = _windows(self.ctx[:, 0].astype(np.int64), self.ctx[:, 1].astype(np.int64), span, k)
        self.full = self.ids > self.smallest[self.which]

    def settled(self) -> tuple[np.ndarray, ...]:
        """(id, twin, start, stop) of the suffixes whose context a smaller document has."""
        f = np.flatnonzero(self.full)
        return self.ids[f], self.twins[f], self.at[f] - self.hi[self.which[f]], self.at[f] - self.lo[self.which[f]] + self.span

    def windows(self, of: np.ndarray, base: np.uint64 = _B) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(bytes before the anchor, places in `of` of the contexts that have such a window, its digests), from the most bytes down."""
        x = self.ctx[of, 2:].astype(np.uint64) + np.uint64(1)
        h = np.zeros(len(of), np.uint64)
        for t in range(self.span):
            h = h * base + x[:, t]
        top = np.uint64(pow(int(base), self.span, 1 << 64))
        for j in range(self.back, -1, -1):  # the window with j bytes before the anchor starts at back - j
            ok = np.flatnonzero((self.lo[of] <= j) & (j <= self.hi[of]))
            if len(ok):
                yield j, ok, _mix(h[ok])
            if j:
                h = h * base + x[:, self.span + self.back - j] - top * x[:, self.back - j]

    def compared(self) -> tuple[np.ndarray, ...]:
        """(id, twin, start, stop) of all windows that a smaller document has, if each leading k-gram's suffixes are complete here."""
        gram = self.ctx[:, 2 + self.back : 2 + self.back + self.k]
        run = np.cumsum(np.r_[True, (gram[1:] != gram[:-1]).any(axis=1)]) - 1
        u = np.flatnonzero(np.bincount(run)[run] > 1)
        mask = np.zeros((len(self.ctx), self.back + 1), bool)
        for j, ok, digest in self.windows(u) if len(u) else ():
            _, inverse = np.unique(digest, return_inverse=True)
            least = np.full(inverse.max() + 1, _LAST, np.int64)
            np.minimum.at(least, inverse, self.smallest[u[ok]])
            mask[u[ok], j] = least[inverse] < self.smallest[u[ok]]
        rest = np.flatnonzero(~self.full & mask.any(axis=1)[self.which])
        edge = np.diff(np.pad(mask[self.which[rest]].astype(np.int8), ((0, 0), (1, 1))), axis=1)
        r0, j0 = np.nonzero(edge == 1)
        _, j1 = np.nonzero(edge == -1)  # runs of windows j0 .. j1 - 1
        part = self.ids[rest[r0]], self.twins[rest[r0]], self.at[rest[r0]] - (j1 - 1), self.at[rest[r0]] - j0 + self.span
        return tuple(np.concatenate(x) for x in zip(self.settled(), part))

    def open_windows(self) -> pd.DataFrame:
        """doc_id, twin, start and two digests of each window of each distinct context, for comparison across the cuts of a run."""
        rest = np.flatnonzero(~self.full)
        first = np.full(len(self.ctx), -1)
        out = []
        for (j, ok, a), (_, _, b) in zip(self.windows(np.arange(len(self.ctx))), self.windows(np.arange(len(self.ctx)), np.uint64(0x9E3779B97F4A7C15))):
            first[:] = -1
            first[ok] = np.arange(len(ok))
            p = first[self.which[rest]]
            r, p = rest[p >= 0], p[p >= 0]
            out.append(pd.DataFrame({"doc_id": self.ids[r], "twin": self.twins[r], "start": (self.at[r] - j).astype(np.int32), "one": a[p].view(np.int64), "two": b[p].view(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({"doc_id": [], "twin": [], "start": [], "one": [], "two": []})


def _row_hash(rows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(rows), np.uint64)
    for t in range(rows.shape[1]):
        h = h * _B + rows[:, t] + np.uint64(1)
    return _mix(h)


def suffix_rows(docs: DataFrame, span: int, k: int, splitters: np.ndarray, hot: np.ndarray, known, buckets: int) -> DataFrame:
    """bucket, ctx, doc_id, at, stop: candidate suffixes, and with a null ctx intervals that are settled in their chunk.

    known: a broadcast of the sorted candidate hashes, or None if docs has them by row in `shared`. hot: sorted leading k-grams
    whose runs are cut; their buckets are negative.
    """
    back, size = span - k, 2 * span - k

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, texts in _chunks(batches, 2 << 20):
            c, ids = Chunk(texts, span, k), _ids(rows)
            if known is not None:
                table = known.value
            else:
                parts = [np.asarray(s, np.int64) for s in rows["shared"] if s is not None]
                table = np.unique(np.concatenate(parts)).view(np.uint64) if parts else np.zeros(0, np.uint64)
                table = np.sort(table)
            if not len(c.at) or not len(table):
                continue
            key = (c.hash & ~np.uint64(0xFFFF)) | (c.hash & np.uint64(buckets - 1))
            there = np.minimum(np.searchsorted(table, key), len(table) - 1)
            hit = np.flatnonzero(table[there] == key)
            if not len(hit):
                continue
            p, text = c.at[hit], c.text[hit]
            left = np.minimum(p - c.starts[text], back)
            right = np.minimum(c.ends[text] - p, span)
            padded = np.concatenate([np.zeros(back, np.uint8), c.x, np.zeros(span, np.uint8)])
            body = sliding_window_view(padded, size)[p].copy()
            column = np.arange(size)
            body[(column < (back - left)[:, None]) | (column >= (back + right)[:, None])] = 0
            ctx = np.hstack([left[:, None].astype(np.uint8), right[:, None].astype(np.uint8), body])
            owner, at = ids[text], p - c.starts[text]
            view = np.ascontiguousarray(ctx).view(np.dtype((np.void, size + 2))).ravel()
            _, inverse = np.unique(view, return_inverse=True)
            least = np.full(inverse.max() + 1, _LAST, np.int64)
            np.minimum.at(least, inverse, owner)
            send = owner == least[inverse]
            lead = np.ascontiguousarray(body[:, back : back + k]).view(f"S{k}").ravel()
            bucket = np.searchsorted(splitters, lead, "right").astype(np.int32)
            if len(hot):  # a run that is cut: dealt by the whole context
                there = hot[np.minimum(np.searchsorted(hot, lead), len(hot) - 1)] == lead
                bucket[there] = -1 - (_row_hash(ctx[there]) % np.uint64(len(splitters) + 1)).astype(np.int32)
            lo, hi = _windows(left, right, span, k)
            s, g = np.flatnonzero(send), np.flatnonzero(~send)
            twin = rows["twin"].to_numpy(np.int64)[text]
            yield pd.DataFrame({"bucket": bucket[s], "ctx": [ctx[i].tobytes() for i in s], "doc_id": owner[s], "twin": twin[s], "at": at[s].astype(np.int32), "stop": np.int32(0)})
            if len(g):
                d, t, a, z = merged_intervals(owner[g], twin[g], at[g] - hi[g], at[g] - lo[g] + span)
                yield pd.DataFrame({"bucket": ((d ^ t) % 1009).astype(np.int32), "ctx": None, "doc_id": d, "twin": t, "at": a.astype(np.int32), "stop": z.astype(np.int32)})

    return map_frames(docs, run, "bucket int, ctx binary, doc_id long, twin long, at int, stop int")


def merged_intervals(d: np.ndarray, t: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of each row (id and twin), those that touch united."""
    if not len(d):
        return d, t, start, stop
    order = np.lexsort((start, t, d))
    d, t, start, stop = d[order], t[order], start[order], stop[order]
    shift = (np.cumsum(np.r_[False, (d[1:] != d[:-1]) | (t[1:] != t[:-1])])).astype(np.int64) << 33  # one axis for all rows
    reach = np.maximum.accumulate(stop + shift)
    new = np.flatnonzero(np.r_[True, start[1:] + shift[1:] > reach[:-1]])
    return d[new], t[new], start[new], (reach - shift)[np.r_[new[1:], len(d)] - 1]


def sampled_leads(docs: DataFrame, n_docs: int, span: int, k: int, documents: int = 500, each: int = 256) -> np.ndarray:
    """Sorted leading k-grams of about documents * each anchors: documents drawn from all rows, anchors spread over their whole texts."""

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, texts in _chunks(batches, 2 << 20):
            c = Chunk(texts, span, k)
            if len(c.at):
                at = c.at[np.unique(np.linspace(0, len(c.at) - 1, min(len(c.at), each * len(texts))).astype(int))]
                yield pd.DataFrame({"lead": [g.tobytes() for g in sliding_window_view(c.x, k)[at]]})

    some = docs.sample(min(1.0, documents / max(1, n_docs)), seed=4)
    found = [bytes(r["lead"]) for r in map_frames(some, pick, "lead binary").collect()]
    return np.sort(np.array(found, f"S{k}"))


#: Bytes of packed hashes that a bucket of the candidate search gets at most, about.
BUCKET_BYTES = 8 << 20
#: Suffixes that a task of the comparison holds before it sorts them; a longer run of one k-gram is cut.
HELD = 60_000


def removed_intervals(docs: DataFrame, span: int, k: int, broadcast_bytes: int, held_rows: int = HELD) -> DataFrame:
    """doc_id, twin, start, stop; docs has doc_id, text and twin."""
    spark = docs.sparkSession
    back = span - k
    n_docs, n_bytes = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    buckets = 1 << max(6, (int(n_bytes * 12 / (span - k + 2)) // BUCKET_BYTES).bit_length())  # 2 / (span - k + 2) anchors a byte, 6 bytes each
    found = checkpointed(shared_hashes(docs, span, k, buckets))
    total = found.agg(F.coalesce(F.sum(F.octet_length("found")), F.lit(0))).first()[0]
    if total <= broadcast_bytes:
        parts = [r["found"] for r in found.select("found").toLocalIterator()]
        known = spark.sparkContext.broadcast(np.sort(np.frombuffer(b"".join(parts), np.uint64)))
        rows = docs
    else:
        known = None

        def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for blob in b["found"]:
                    yield pd.DataFrame({"key": np.frombuffer(blob, np.int64)})

        def anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part, texts in _chunks(batches, 2 << 20):
                c = Chunk(texts, span, k)
                key = (c.hash & ~np.uint64(0xFFFF)) | (c.hash & np.uint64(buckets - 1))
                yield pd.DataFrame({"doc_id": part["doc_id"].iloc[c.text].array, "twin": part["twin"].iloc[c.text].array, "key": key.view(np.int64)}).drop_duplicates()

        keyed = map_frames(docs, anchors, "doc_id long, twin long, key long").join(found.mapInPandas(listed, "key long"), "key", "left_semi")
        shared = keyed.groupBy(F.col("doc_id").alias("_id"), F.col("twin").alias("_twin")).agg(F.collect_set("key").alias("shared"))
        rows = docs.join(shared, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("twin") == F.col("_twin")), "left").select("doc_id", "text", "twin", "shared")

    leads = sampled_leads(docs, n_docs, span, k)
    partitions = shuffle_partitions(spark)
    splitters = leads[np.linspace(0, len(leads) - 1, 8 * partitions).astype(int)] if len(leads) else leads
    hot = np.unique(splitters[1:][splitters[1:] == splitters[:-1]])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, ...]] = []
        waiting = 0
        cutting = b""  # the k-gram of a run that outgrew the task's bound

        def packed(*columns: np.ndarray | None) -> pd.DataFrame:  # a row of arrays: the checkpoint stays small
            columns = [None if c is None else c.to_numpy(np.int64) if isinstance(c, pd.Series) else c for c in columns]
            columns[1] = columns[1] if columns[1].any() else None
            return pd.DataFrame([columns], columns=["ids", "twins", "starts", "stops", "one", "two"])

        def intervals(*found: np.ndarray) -> pd.DataFrame:
            return packed(*merged_intervals(*found), None, None)

        def settle(part: tuple, cut: bool) -> Iterator[pd.DataFrame]:
            run = Run(*part, span, k)
            yield intervals(*(run.settled() if cut else run.compared()))
            if cut:
                w = run.open_windows()
                yield packed(w["doc_id"], w["twin"], w["start"], None, w["one"], w["two"])

        for b in batches:
            done = b["ctx"].isna()
            if done.any():
                yield packed(b["doc_id"][done], b["twin"][done], b["at"][done], b["stop"][done], None, None)
            for cut, rows in b[~done].groupby(b["bucket"] < 0, sort=False):
                part = np.frombuffer(b"".join(rows["ctx"]), np.uint8).reshape(len(rows), -1), rows["doc_id"].to_numpy(np.int64), rows["twin"].to_numpy(np.int64), rows["at"].to_numpy(np.int64)
                if cut:
                    yield from settle(part, True)
                    continue
                held.append(part)
                waiting += len(rows)
            if waiting >= held_rows:
                ctx, *own = (np.concatenate(x) for x in zip(*held))  # own: ids, twins, places
                gram = ctx[:, 2 + back : 2 + back + k]
                heads = np.r_[0, np.flatnonzero((gram[1:] != gram[:-1]).any(axis=1)) + 1]
                if gram[0].tobytes() == cutting:  # the rest of the cut run
                    stop = heads[1] if len(heads) > 1 else len(ctx)
                    yield from settle((ctx[:stop], *(x[:stop] for x in own)), True)
                    ctx, own, heads = ctx[stop:], [x[stop:] for x in own], heads[1:] - stop
                if len(heads) > 1:  # the last k-gram may go on in the next batch
                    yield from settle((ctx[: heads[-1]], *(x[: heads[-1]] for x in own)), False)
                    ctx, own = ctx[heads[-1] :], [x[heads[-1] :] for x in own]
                if len(ctx) >= held_rows:
                    cutting = ctx[0, 2 + back : 2 + back + k].tobytes()
                    yield from settle((ctx, *own), True)
                    ctx, own = ctx[:0], [x[:0] for x in own]
                held, waiting = [(ctx, *own)], len(ctx)
        if waiting:
            ctx, *own = (np.concatenate(x) for x in zip(*held))
            same = (ctx[:, 2 + back : 2 + back + k] == np.frombuffer(cutting.ljust(k), np.uint8)).all(axis=1) if cutting else np.zeros(len(ctx), bool)
            for cut, of in ((True, same), (False, ~same)):
                if of.any():
                    yield from settle((ctx[of], *(x[of] for x in own)), cut)

    dealt = suffix_rows(rows, span, k, splitters, hot, known, buckets).repartition(partitions, "bucket").sortWithinPartitions(F.col("bucket") >= 0, F.substring("ctx", 3 + back, k))
    compared = checkpointed(map_frames(dealt, compare, "ids array<long>, twins array<long>, starts array<int>, stops array<int>, one array<long>, two array<long>"))
    twins = F.coalesce("twins", F.array_repeat(F.lit(0).cast("long"), F.size("ids"))).alias("twin")
    settled = compared.where("one IS NULL").select(F.inline(F.arrays_zip(F.col("ids").alias("doc_id"), twins, F.col("starts").alias("start"), F.col("stops").alias("stop"))))
    across = compared.where("one IS NOT NULL").select(F.inline(F.arrays_zip(F.col("ids").alias("doc_id"), twins, F.col("starts").alias("start"), "one", "two")))
    if across.isEmpty():
        return settled
    owners = across.groupBy("one", "two").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("one", "two", "least")
    late = lookup_join(across, owners, ["one", "two"], "inner", F.struct("doc_id", "start")).where("least < doc_id")
    return settled.unionByName(late.select("doc_id", "twin", "start", (F.col("start") + span).alias("stop")))


def with_twins(docs: DataFrame) -> DataFrame:
    """doc_id, text, twin: 0 where the id alone tells the row from all others with another text, else the text's hash."""
    hashed = F.xxhash64(F.coalesce("text", F.lit("")))
    several = docs.where("doc_id IS NOT NULL").select("doc_id", hashed.alias("h")).groupBy("doc_id").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low <> high")
    marked = lookup_join(docs, several.select("doc_id", F.lit(True).alias("_several")), ["doc_id"], "left", hashed)
    return marked.select("doc_id", "text", F.when(F.col("doc_id").isNull() | F.col("_several"), hashed).otherwise(F.lit(0).cast("long")).alias("twin"))


def remove_repeats(docs: DataFrame, span: int = 50, k: int = 20, broadcast_bytes: int = 64 << 20, held_rows: int = HELD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans [(start, stop)] in bytes, kept (binary), one row for each row of docs."""
    rows = with_twins(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    gone = removed_intervals(rows, span, k, broadcast_bytes, held_rows).groupBy(F.col("doc_id").alias("_id"), F.col("twin").alias("_twin")).agg(F.collect_set(F.struct("start", "stop")).alias("gone"))
    joined = rows.join(gone, (F.coalesce("doc_id", F.lit(_LAST)) == F.col("_id")) & (F.col("twin") == F.col("_twin")), "left").select("doc_id", "text", "gone")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b, texts in _chunks(batches, 4 << 20):
            out = []
            for i, raw, gone in zip(b["doc_id"], texts, b["gone"]):
                spans = []
                if gone is not None:
                    g = np.array([(x["start"], x["stop"]) for x in gone], np.int64)
                    same = np.zeros(len(g), np.int64)
                    *_, a, z = merged_intervals(same, same, g[:, 0], g[:, 1])
                    spans = list(zip(a.tolist(), z.tolist()))
                edges = [0, *(x for s in spans for x in s), len(raw)]
                kept = b"".join(raw[edges[j] : edges[j + 1]] for j in range(0, len(edges), 2))
                out.append((i, len(raw), len(raw) - len(kept), len(spans), [{"start": a, "stop": z} for a, z in spans], kept))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    return map_frames(joined, cut, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:int,stop:int>>, kept binary")


def brute_force(texts: dict[int, bytes], span: int = 50) -> dict[int, list[tuple[int, int]]]:
    """Removed spans by a dictionary of all windows, for tests."""
    first: dict[bytes, int] = {}
    out = {}
    for i in sorted(texts):
        t, spans = texts[i], []
        for s in range(len(t) - span + 1):
            if first.setdefault(t[s : s + span], i) < i:
                if spans and s <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], s + span)
                else:
                    spans.append((s, s + span))
        out[i] = spans
    return out


def digest(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


ORACLE = r"""
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, s, substr(h, 2 * s + 1, 100) AS x FROM (SELECT doc_id, h, unnest(range(0, greatest(0, length(h) // 2 - 49))) AS s FROM t)),
f AS (SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY x) AS m FROM w) WHERE m < doc_id),
g AS (SELECT doc_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 50 THEN 0 ELSE 1 END AS fresh FROM f),
k AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS id FROM g),
spans AS (SELECT doc_id, id, min(s) AS a, max(s) + 50 AS z FROM k GROUP BY doc_id, id),
pieces AS (SELECT doc_id, a, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM spans
  UNION ALL SELECT t.doc_id, length(h) // 2, coalesce(max(z), 0) FROM t LEFT JOIN spans ON spans.doc_id = t.doc_id GROUP BY t.doc_id, h),
kept AS (SELECT p.doc_id, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY p) AS rest FROM pieces p JOIN t ON t.doc_id = p.doc_id GROUP BY p.doc_id)
SELECT t.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(length(h) // 2 - length(rest) // 2 AS BIGINT) AS n_removed,
  (SELECT count(*) FROM spans WHERE spans.doc_id = t.doc_id) AS n_spans, sha256(unhex(rest)) AS kept_sha256
FROM t JOIN kept ON kept.doc_id = t.doc_id
"""
