"""Operators 11 to 13 against brute force on small tables with the awkward cases."""

import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import types as T

from helixspark.llm import collocations, filter_audit, quality_classifier, registry

#: Extra columns whose names clash with those the operators make.
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("part", T.StringType()), T.StructField("n", T.LongType()), T.StructField("shard", T.LongType()), T.StructField("mask", T.StringType())])
LABELS = "doc_id long, quality int, toxic int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, lang, "p", 1, 2, "m") for i, t, lang in rows], SCHEMA).repartition(parts)


# ---- operator 11


def mined(rows, min_count, best):
    """Plain version of the contract."""
    total, counts = Counter(), Counter()
    for _, text, lang in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            total[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    frequent = {p: n for p, n in counts.items() if n >= min_count}
    out = []
    for lang in total:
        found = []
        for (part, w), a in frequent.items():
            if part != lang or len(w) < 2:
                continue
            score, _, l, r = min((2_000_000 * a // (frequent[lang, w[:k]] + frequent[lang, w[k:]]), k, frequent[lang, w[:k]], frequent[lang, w[k:]]) for k in range(1, len(w)))
            longer = [n for (q, v), n in frequent.items() if q == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))]
            if not any(100 * n >= 80 * a for n in longer):
                found.append((-score, -a, " ".join(w).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:best], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, total[lang], -score))
    return sorted(out)


def phrase_rows():
    rnd = np.random.default_rng(3)
    words = ["Alpha", "beta", "gamma", "été", "x y", "É", "of", "the", "a\x00b"]
    rows = [(1, None, "en"), (2, "", "en"), (None, " \t\n.,;", None), (3, "solo", None), (3, "solo", None)]
    for i in range(60):
        picked = rnd.choice(words, 40, p=[0.3, 0.2, 0.1, 0.1, 0.05, 0.05, 0.1, 0.05, 0.05])
        rows.append((i + 10, "".join(w + rnd.choice([" ", "  ", "\t", ". ", "\n", "\r\n"]) for w in picked), ["en", "fr", None, ""][i % 4]))
    rows.append((99, "Alpha beta " * 3000 + ". gamma été", "fr"))
    return rows


@pytest.mark.parametrize("shards, cells", [(1, 1 << 16), (3, 1 << 20), (4, 64)])
def test_collocations(spark, shards, cells):
    rows = phrase_rows()
    got = collocations.collocations(frame(spark, rows), min_count=5, best=40, shards=shards, cells=cells)
    assert sorted(tuple(r) for r in got.collect()) == mined(rows, 5, 40)


def test_phrases_in_cells_that_others_filled_before(spark):
    rnd = np.random.default_rng(0)
    said = [" ".join(f"{c}{i}" for c in "abcd") for i in range(400) for _ in range(rnd.integers(5, 14))] + [f"q{i} r{i}" for i in range(300)] * 40
    rnd.shuffle(said)
    rows = [(j, ". ".join(said[j : j + 5]), "en") for j in range(0, len(said), 5)]
    plain = Counter(" ".join(w[i : i + k]) for w in map(str.split, said) for k in range(1, 5) for i in range(len(w) - k + 1))
    got = collocations.frequent_phrases(frame(spark, rows), min_count=5, shards=3, cells=4096).where("words > 0").select("phrase", "n").collect()
    assert dict(map(tuple, got)) == plain and len(got) == len(plain)


def test_cells_are_handed_to_tasks_in_two_bits():
    scans = np.random.default_rng(1).choice(np.array([0, 1, 2, 3, 4, collocations.NEVER], np.uint8), 1001)
    for shards, t in ((1, 5), (2, 5), (2, 9), (3, 6), (20, 5)):
        reached = collocations.Reached(scans, t, shards)
        code = reached.of(np.arange(1001, dtype=np.uint32)).astype(int)
        plain = np.where(scans == collocations.NEVER, 0, np.maximum(scans.astype(int) + 1 - (t - shards), 0) + 1)
        assert (code == plain).all()
    assert collocations.Reached(scans, 5, 2).codes.nbytes == 251


def test_collocations_in_stretches(spark, monkeypatch):
    assert [bytes(x) for x in collocations._stretches(b"ab\n" * 3)] == [b"ab\n" * 3]
    monkeypatch.setattr(collocations, "CHUNK", 10)
    raw = b"alpha beta\ngamma\n\nalpha beta gamma delta epsilon\nx\n" * 3 + b"end"
    cut = list(collocations._stretches(raw))
    assert b"".join(cut) == raw and len(cut) > 3 and all(c.endswith(b"\n") for c in cut[:-1])


def test_collocations_without_rows(spark):
    assert collocations.collocations(frame(spark, []).limit(0)).count() == 0


# ---- operator 12


def gram_count(text):
    words = WORD.findall(text)
    return len(words) + max(0, len(words) - 1) + sum(max(0, len(w) + 3 - g) for w in words for g in (3, 4, 5))


@pytest.mark.parametrize("text", ["", " ", "a", "ab cd", "  ab \t cd\n ", "hello world hello hello", "x" * 200, "é ü 日本語", "\x0bq", "z ", "a b c"])
def test_features_are_all_there(text):
    assert sum(len(f) for f in quality_classifier.features(text)) == gram_count(text)


def test_features_ignore_white_space_but_no_letters():
    all_of = lambda t, **k: np.sort(np.concatenate([np.zeros(0, np.int32), *quality_classifier.features(t, **k)]))
    assert (all_of("ab cde f") == all_of("  ab\t\ncde f \r")).all()
    assert not np.array_equal(all_of("ab cd"), all_of("cd ab")) and not np.array_equal(all_of("Ab"), all_of("ab"))
    text = "some words here " * 50
    assert len(all_of(text, stretch=100)) <= len(all_of(text)) and len(all_of(text, stretch=100)) >= len(all_of(text)) - 10
    assert sum(1 for _ in quality_classifier.features("y" * 1000, stretch=100)) > 3


def test_quality_classifier(spark):
    sf = "/root/testdata/sf0.01"
    got = registry.op12_quality_classifier(spark, sf).toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().set_index("doc_id")
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = labels.join(got, how="inner").query("held_out")
    good, bad = held[held.quality == 1], held[held.quality == 0]
    assert len(good) > 30 and len(bad) > 3
    assert (good.predicted == 1).mean() > 0.97 and (bad.predicted == 0).mean() > 0.6
    assert ((got.score >= 0.3) == (got.predicted == 1)).all() and got.score.between(0, 1).all()
    ranks = held.score.rank()
    auc = (ranks[held.quality == 1].sum() - len(good) * (len(good) + 1) / 2) / (len(good) * len(bad))
    assert auc > 0.95
    again = registry.op12_quality_classifier(spark, sf).toPandas().set_index("doc_id")
    assert again.score.sort_index().equals(got.score.sort_index())


def test_quality_classifier_awkward(spark):
    good, junk = "a calm and ordinary line of words that says something ", "BUY!! NOW!! $$$ "
    rows = [(i, (good if i % 3 else junk) * (1 + i % 5), "en") for i in range(1, 60)] + [(100, None, None), (101, "", "en"), (None, good, "en"), (5, good * 2, "en"), (102, "x" * 50_000, None)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(1, 60)] + [(1, 0, 1), (None, 1, 0), (7, None, None), (500, 1, 0)], LABELS)
    got = quality_classifier.score_documents(frame(spark, rows), labels).collect()
    assert len(got) == len(rows)
    of = defaultdict(list)
    for r in got:
        of[r.doc_id].append(r)
    assert of[100][0].score == of[101][0].score and len(of[5]) == 2
    assert all(r.predicted == int(r.score >= 0.3) for r in got) and not of[None][0].held_out
    text = {i: t for i, t, _ in rows}
    calm, loud = [r.score for r in got if text[r.doc_id] and text[r.doc_id].startswith("a calm")], [r.score for r in got if text[r.doc_id] and text[r.doc_id].startswith("BUY")]
    assert min(calm) > max(loud)
    none = quality_classifier.score_documents(frame(spark, rows), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality_classifier.score_documents(frame(spark, []).limit(0), labels).count() == 0


# ---- operator 13


def audited(rows, labels):
    """Plain version of the contract."""
    low = {}
    for i, t, _ in rows:
        if i is not None:
            low[t or ""] = min(low.get(t or "", i), i)
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    docs = []
    for i, t, lang in rows:
        t = t or ""
        words = WORD.findall(t)
        fails = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 3 * len(t)) + "D" * bool(re.search(r"[#$%&*|]", t))
        fails += "E" * (t in low and (i is None or low[t] < i))
        docs.append((lang or "", fails, i in good and i is not None, i in toxic and i is not None))
    out = []
    for part in {d[0] for d in docs}:
        shapley = Counter()
        mine, rows_out = [d for d in docs if d[0] == part], []
        for order in permutations("ABCDE"):
            for step in range(1, 6):
                f, before = order[step - 1], set(order[: step - 1])
                left = [d for d in mine if not before & set(d[1])]
                gone = [d for d in left if f in d[1]]
                shapley[f] += len(gone)
                rows_out.append((part, "".join(order), step, len(left) - len(gone), len(gone), sum(f in d[1] for d in mine) - len(gone), sum(d[1] == f for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone)))
        out += [(*r, shapley[r[1][r[2] - 1]]) for r in rows_out]
    return sorted(out)


def audit_rows():
    rnd = np.random.default_rng(5)
    text = lambda n: " ".join("".join(rnd.choice(list("abcdeé"), 5)) for _ in range(n))
    long, head = text(230), "the same long header of many documents, " * 20
    rows = [(1, None, "en"), (2, "", None), (3, "", ""), (None, "", "en"), (None, "only a null id", "fr"), (None, "only a null id", "fr")]
    rows += [(10, long, "en"), (11, long, "fr"), (9, long, None), (9, long, None), (12, long.upper(), "en"), (None, long, "en")]
    rows += [(20 + k, head + text(3) + "#" * (k % 2), ["en", "fr"][k % 2]) for k in range(12)] + [(40 + k, head + "end", "de") for k in range(9)]
    rows += [(60 + k, head[:k], "en") for k in range(0, 40, 5)] + [(80, "w " * 400, "fr"), (81, "x" * 100_000, "fr"), (82, text(5000), "en"), (7, long, "en")]
    return rows


@pytest.mark.parametrize("sizes", [{}, {"width": 4, "bucket_bytes": 1500, "trie_bytes": 2000}, {"width": 1, "bucket_bytes": 1, "trie_bytes": 1}])
def test_filter_audit(spark, sizes):
    rows = audit_rows()
    labels = [(10, 1, 0), (10, 0, 1), (20, 1, 1), (21, 1, None), (None, 1, 1), (81, None, 1), (7, 1, 0), (999, 1, 1)]
    got = filter_audit.audit(frame(spark, rows, 4), spark.createDataFrame(labels, LABELS), **sizes)
    assert sorted(tuple(r) for r in got.collect()) == audited(rows, labels)


def test_filter_audit_without_rows(spark):
    assert filter_audit.audit(frame(spark, []).limit(0), spark.createDataFrame([], LABELS)).count() == 0


def test_radix_trie():
    rnd = np.random.default_rng(1)
    texts = {bytes(rnd.choice([97, 98, 0], rnd.integers(0, 12)).astype(np.uint8)) for _ in range(500)}
    trie = filter_audit.RadixTrie()
    for k, t in enumerate([*texts, *texts]):
        trie.terminal(t)[2] = k
    found = list(trie.terminals())
    assert {t for t, _ in found} == texts and len(found) == len(texts)
