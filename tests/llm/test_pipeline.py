"""The pipeline's stages and its whole run against a brute-force version in plain Python on sf0.001."""

import hashlib
import re
from collections import Counter

import corpus_pipeline
from helixspark.llm.registry import TOKENIZER, WEIGHTS

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return (t or "").encode().lower().decode()


def after_quality(rows):
    """Documents that pass, without the lines over their host's limit."""
    norm = lambda x: re.sub("[0-9]", "0", re.sub(r"[\x20\x09\x0B-\x0D]+", " ", lower(x))).strip(" ")
    holders, hosts = Counter(), Counter()
    for _, t, host in rows:
        hosts[host] += 1
        for line in {norm(x) for x in (t or "").split("\n")} - {""}:
            holders[host, line] += 1
    out = []
    for i, t, host in rows:
        words = WORD.findall(t or "")
        grams = Counter(zip(words, words[1:], words[2:]))
        again = {k + d for k, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for d in range(3)}
        over = lambda x: norm(x) != "" and holders[host, norm(x)] > max(5, 0.02 * hosts[host])
        lines = (t or "").split("\n")
        gone = sum(len(norm(x).split(" ")) for x in lines if over(x))
        if len(words) >= 50 and 100 * len(again) <= 50 * len(words) and len(words) - gone >= 0.2 * len(words):
            out.append((i, "\n".join(x for x in lines if not over(x)), host))
    return out


def after_exact(rows):
    best = {}
    for i, t, _ in rows:
        best[lower(t)] = max(i, best.get(lower(t), i))
    return [r for r in rows if r[0] in set(best.values())]


def after_near(rows):
    sets = {}
    for i, t, _ in rows:
        w = WORD.findall(lower(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                u, v = find(a), find(b)
                root[max(u, v)] = min(u, v)
    return [r for r in rows if find(r[0]) == r[0]]


def after_mixing(rows):
    """Document ids, one for each copy of which at least half is taken."""
    sizes = {i: len(WORD.findall(t or "")) for i, t, _ in rows}
    of = {}
    for i, _, s in rows:
        of.setdefault(s, []).append(i)
    names = sorted((s for s in of if s is not None), key=str) + [None] * (None in of)
    weight = {s: WEIGHTS[k % len(WEIGHTS)] for k, s in enumerate(names)}
    size = {s: sum(sizes[i] for i in of[s]) for s in names}
    left, free, target = sum(size.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level > 3 * size[s]}
        if not full:
            target |= {s: weight[s] * level for s in free}
            break
        target |= {s: 3.0 * size[s] for s in full}
        left -= sum(3 * size[s] for s in full)
        free -= full
    out = []
    for s in names:
        at, quota = 0, int(target[s] + 0.5)
        for i in sorted(of[s], key=lambda i: hashlib.md5(str(i).encode()).hexdigest()):
            out += [i for k in range(3) if sizes[i] and 2 * max(0, min(sizes[i], quota - at - k * size[s])) >= sizes[i] and quota > at + k * size[s]]
            at += sizes[i]
    return out


def test_run_equals_brute_force(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    passed = after_quality(rows)
    single = after_exact(passed)
    apart = after_near(single)
    assert len(rows) > len(passed) > len(single) > len(apart) > 0
    text, tokens = {i: t for i, t, _ in apart}, Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    want = Counter()
    for i in after_mixing(apart):
        ids = tokens.encode(text[i], add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect()) == want


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0
