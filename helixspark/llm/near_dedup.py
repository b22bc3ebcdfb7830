"""Operator 5, MinHash near-dedup by tensored banding.

Texts with equal shingle sets form a class, represented by its smallest id; only representatives go on. Two collections of
`side` keys are drawn, each key made of two minhashes, and the side * side tables of the banding are their pairs: table (i, j)
has the key (A_i, B_j), four minhashes deep, so 4 * side minhashes do the work of 4 * side ** 2. Half keys that no other class
has are dropped before tables are formed (a table key cannot be shared if one of its halves isn't).

Links: every bucket first proposes its members' links to two of its members (the smallest id and the smallest hash), which are
confirmed on the full sets, and components are formed. The members of buckets that still hold several components are compared
further, in groups of equal A keys (a superset of the buckets): a task counts, by postings of shingles, the intersections of the
members outside the group's largest component with all others, and sends one link for each two components that it joins. Nothing
is emitted for pairs that don't link, and shingles that no other member has settle most members at once. A group of more than
`block` members, or of more than `load` shingles, is dealt out as pairs of blocks, so a task's memory is bounded by bytes. Confirmed links of both rounds give the components.

Recall: two texts at similarity s meet in no table with a probability of about 2 (1 - s^2)^side (5e-4 at 0.75, 3e-8 at 0.91, for
side = 10); what meets is decided exactly.

Cases: null texts and texts without words have no shingles and link with nothing; with fewer than `width` words the whole
sequence is the one shingle. Rows that repeat an id are one node. Rows with a null id take no part and are kept. Extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixspark.llm.common import checkpointed, lookup_join, map_frames
from helixspark.llm.components import connected_components
from helixspark.llm.shingles import linked, mixed, shingle_set

_EMPTY = np.uint64(0)


def _seeds(n: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def half_keys(s: np.ndarray, side: int) -> np.ndarray:
    """2 * side keys of two minhashes each; the first side are collection A, the others B."""
    seeds = _seeds(4 * side)
    mult = (mixed(seeds + np.uint64(7)) | np.uint64(1))[:, None]
    low = np.array([((s ^ seeds[k]) * mult[k]).min() for k in range(len(seeds))]) if len(s) > 20_000 else ((s[None, :] ^ seeds[:, None]) * mult).min(axis=1)
    pair = low.reshape(2 * side, 2)
    return mixed(pair[:, 0] * np.uint64(0x9E3779B97F4A7C15) + mixed(pair[:, 1]) + np.arange(2 * side, dtype=np.uint64))


def signatures(docs: DataFrame, side: int, width: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, set_a, set_b (128-bit identity of the set) and halves, an array of half keys."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [shingle_set(t, width) for t in b["text"]]
            with np.errstate(over="ignore"):
                yield pd.DataFrame(
                    {
                        "doc_id": b["doc_id"],
                        "n_shingles": [len(s) for s in sets],
                        "set_a": [int(mixed(s).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0 for s in sets],
                        "set_b": [int(np.bitwise_xor.reduce(mixed(s + np.uint64(1))).view(np.int64)) if len(s) else 0 for s in sets],
                        "halves": [half_keys(s, side).view(np.int64) if len(s) else None for s in sets],
                    }
                )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_frames(rows, run, "doc_id long, n_shingles long, set_a long, set_b long, halves array<long>")


def texts_of(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and text of the documents in ids; few ids are broadcast (by their checked count), so that only their texts move on."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return lookup_join(texts, ids.select(F.col(ids.columns[0]).alias("id")).distinct(), ["id"], "left_semi", F.col("id"), broadcast_rows=1_000_000, salts=1)


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough; a pair carries the two texts, compressed by the shuffle."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    texts = texts_of(docs, ids, id_col, text_col)
    first = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    second = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, sets = None, np.zeros(0, np.uint64)
        for p in batches:
            yes = []
            for x, y in zip(p["text_a"], p["text_b"]):
                if x is not last:
                    if x != last:
                        sets = shingle_set(x, width)
                    last = x
                yes.append(linked(sets, shingle_set(y, width), percent))
            yield p.loc[yes, ["a", "b"]]

    return pairs.join(first, "a").join(second, "b").mapInPandas(run, "a long, b long")


def joining_links(ids: np.ndarray, components: np.ndarray, first: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """One link for each two components that are joined by some pair of a member in `first` and one not in it (or any two, if all
    are in it)."""
    sizes = np.array([len(s) for s in sets])
    codes, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts[inverse] > 1
    owner = np.repeat(np.arange(len(sets)), sizes)[shared]
    code = inverse[shared]
    usable = 100 * np.bincount(owner, minlength=len(sets)) >= percent * sizes  # a link can only lie in shared shingles
    keep = usable[owner]
    owner, code = owner[keep], code[keep]
    within = bool(first.all())
    left = usable & first
    if within:
        names, n = np.unique(components, return_counts=True)
        left &= components != names[np.argmax(n)]
    right = usable & (within | ~first)
    by_code = np.argsort(code[right[owner]], kind="stable")
    posting_owner, posting_code = owner[right[owner]][by_code], code[right[owner]][by_code]
    ends = np.searchsorted(posting_code, np.arange(len(codes) + 1))
    order = np.argsort(owner, kind="stable")
    starts = np.searchsorted(owner[order], np.arange(len(sets) + 1))
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            x = root[x]
        return x

    out = []
    for x in np.flatnonzero(left):
        mine = code[order[starts[x] : starts[x + 1]]]
        met = [posting_owner[ends[c] : ends[c + 1]] for c in mine]
        both = np.bincount(np.concatenate(met), minlength=len(sets)) if met else np.zeros(len(sets), int)
        hits = np.flatnonzero(right & (components != components[x]) & (100 * both >= percent * (sizes[x] + sizes - both)))
        for y in hits:
            u, v = find(int(components[x])), find(int(components[y]))
            if u != v:
                root[max(u, v)] = min(u, v)
                out.append((int(min(ids[x], ids[y])), int(max(ids[x], ids[y]))))
    return out


def links_across(members: DataFrame, docs: DataFrame, width: int, percent: int, block: int, load: int, id_col: str, text_col: str) -> DataFrame:
    """Links between components inside the groups of members (group, doc_id, component, n_shingles)."""
    groups = members.groupBy("group").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"), F.sum("n_shingles").alias("weight")).where("low <> high")
    blocks = F.least(F.col("n"), F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("weight") / load))).cast("int")
    placed = lookup_join(members, groups, ["group"], "inner", F.col("doc_id")).withColumn("blocks", blocks)  # no task gets a whole group
    placed = placed.withColumn("home", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("group", F.least("home", "other").alias("p"), F.greatest("home", "other").alias("q"), "home", "doc_id", "component").distinct()
    dealt = checkpointed(dealt)
    texts = texts_of(docs, dealt.select("doc_id"), id_col, text_col).withColumnRenamed("id", "doc_id").dropDuplicates(["doc_id"])

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "shingles": [shingle_set(t, width).tobytes() for t in b["text"]]})

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        found = joining_links(
            group["doc_id"].to_numpy(), group["component"].to_numpy(), (group["home"] == group["p"].iloc[0]).to_numpy(),
            [np.frombuffer(s, np.uint64) for s in group["shingles"]], percent,
        )
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    rows = dealt.join(texts.mapInPandas(sets, "doc_id long, shingles binary"), "doc_id")
    return rows.groupBy("group", "p", "q").applyInPandas(compare, "a long, b long")


def similar_components(docs: DataFrame, width: int = 5, percent: int = 75, side: int = 10, block: int = 2000, load: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs."""
    signed = checkpointed(signatures(docs, side, width, id_col, text_col))
    of_set = ["set_a", "set_b", "n_shingles"]
    classes = checkpointed(signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*of_set).agg(F.min("doc_id").alias("rep")))
    reps = signed.join(classes.select(*of_set, F.col("rep").alias("doc_id")), [*of_set, "doc_id"]).select("doc_id", "n_shingles", "halves")

    halves = reps.select("doc_id", "n_shingles", F.posexplode("halves").alias("slot", "half"))
    common = halves.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half")
    shared = halves.join(common, "half").groupBy("doc_id").agg(F.collect_set(F.struct("slot", "half")).alias("halves"), F.first("n_shingles").alias("n_shingles"))
    shared = checkpointed(shared)
    a_side, b_side = F.filter("halves", lambda h: h["slot"] < side), F.filter("halves", lambda h: h["slot"] >= side)
    tables = F.flatten(F.transform(a_side, lambda x: F.transform(b_side, lambda y: F.xxhash64(x["half"], y["half"]))))
    keys = checkpointed(shared.select("doc_id", F.explode(tables).alias("key")))
    buckets = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.min_by("doc_id", F.xxhash64("doc_id")).alias("pick")).where("n > 1")

    met = checkpointed(keys.join(buckets.select("key", "low", "pick"), "key"))
    stars = met.select("doc_id", F.explode(F.array_distinct(F.array("low", "pick"))).alias("other")).where("doc_id <> other")
    tried = checkpointed(stars.select(F.least("doc_id", "other").alias("a"), F.greatest("doc_id", "other").alias("b")).distinct())
    links = checkpointed(confirmed(tried, docs, width, percent, id_col, text_col))
    found = connected_components(links)

    labelled = met.select("key", "doc_id").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    parts = labelled.groupBy("key", "component").agg(F.count("*").alias("n"))
    several = parts.groupBy("key").agg(F.count("*").alias("parts")).where("parts > 1").select("key")
    open_ids = labelled.join(several, "key").select("doc_id", "component").distinct()
    members = shared.join(open_ids, "doc_id").select(F.explode(F.filter("halves", lambda h: h["slot"] < side)).alias("h"), "doc_id", "component", "n_shingles")
    members = checkpointed(members.select(F.col("h.half").alias("group"), "doc_id", "component", "n_shingles"))
    late = checkpointed(links_across(members, docs, width, percent, block, load, id_col, text_col))
    if not late.isEmpty():
        found = connected_components(links.union(late))

    home = classes.join(found, classes["rep"] == found["node"], "left").select(*of_set, F.coalesce("component", "rep").alias("component_id"))
    out = signed.select("doc_id", *of_set).join(home, of_set, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_copies(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of docs that stay, one document of each component, with all their columns."""
    gone = similar_components(docs, **parameters).where("NOT kept").select(F.col("doc_id").alias("_id")).distinct()
    return docs.withColumn("_key", F.col("doc_id")).join(gone, F.col("_key") == F.col("_id"), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 5 THEN list_transform(range(1, CAST(len(words) AS BIGINT) - 3), lambda i: array_to_string(words[i:i + 4], ' '))
  WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
inter AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM inter JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, e.b FROM reach JOIN edges e ON e.a = reach.r)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) c ON c.doc_id = d.doc_id
"""
