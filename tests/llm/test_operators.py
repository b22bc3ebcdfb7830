"""The ten operators on a small table with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

import hashlib
import random

import duckdb
import pytest
from pyspark.sql import types as T

from helixspark.llm import bpe, exact_dedup, html_text, language, licenses, line_dedup, mixing, near_dedup, quality, suffix_dedup
from helixspark.llm.shingles import linked, shingle_set

WEIGHTS = [5.0, 2.0, 1.0]
#: Extra columns whose names clash with those the operators make.
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("key", T.LongType()), T.StructField("run", T.StringType()), T.StructField("words", T.StringType())])


def made() -> list[tuple]:
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefghij é") for _ in range(rnd.randint(2, 8)))
    texts = [None, "", " \t\n", "one two", "Une Idée. UNE IDÉE."]
    base = " ".join(word() for _ in range(150))
    texts += [base, base.upper(), base, base.replace("a", "A", 3)]
    for _ in range(12):
        w = base.split(" ")
        for _ in range(2):
            w[rnd.randrange(len(w))] = word()
        texts.append(" ".join(w))
    passage = ". ".join(" ".join(word() for _ in range(9)) for _ in range(7)) + "."
    texts += [f"{word()} {word()}\n{passage}\n{' '.join(word() for _ in range(60))}" for _ in range(6)]
    texts += ["line again\n" * 40 + " ".join(word() for _ in range(90)), " ".join(word() for _ in range(30_000)), "x" * 20_000, "Under the MIT License; Apache License, Version 2.0 (CC-BY-NC) ### 100% <b>"]
    rows = [(i, t, ["en", "fr", None][i % 3], ["s1", "s2", None, "s3"][i % 4], None if t is None else len(t), i, "r", "w") for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return made()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def duck(docs):
    c = duckdb.connect()
    c.register("documents", docs.toPandas())
    return c


def same(got, want):
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    g, w = (d[columns].sort_values("doc_id").reset_index(drop=True) for d in (got, want))
    assert len(g) == len(w)
    for c in columns:
        assert (g[c] == w[c]).all(), c


def test_exact_dedup(docs, duck, empty):
    same(exact_dedup.exact_groups(docs, "largest").toPandas(), duck.sql(exact_dedup.ORACLE).df())
    kept = exact_dedup.drop_exact_copies(docs.union(docs), "largest")
    assert kept.columns == docs.columns and kept.count() == len({(r.text or "").encode().lower() for r in docs.collect()})
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.drop_exact_copies(empty).count() == 0


def test_mixing(docs, duck, empty):
    placed = mixing.curriculum(docs, WEIGHTS, rows_per_range=4)
    from pyspark.sql import functions as F

    same(placed.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken").toPandas(), duck.sql(mixing.ORACLE).df())
    got = placed.toPandas()
    assert (got.taken <= 3 * got["size"]).all()
    times = [c["position"] for cs in got.copies for c in cs]
    assert times and 0 <= min(times) and max(times) <= 1
    ordered = mixing.training_order(docs, WEIGHTS)
    assert ordered.columns == docs.columns
    assert mixing.curriculum(empty, WEIGHTS).count() == 0 and mixing.training_order(empty, WEIGHTS).count() == 0


def test_quality(docs, duck, empty):
    same(quality.quality_rules(docs).drop("text_hash").toPandas(), duck.sql(quality.ORACLE).df())
    strict = quality.quality_rules(docs, min_docs=1, share=0.0).toPandas().set_index("doc_id")
    assert strict.removed_words.max() > 0 and strict.kept.sum() > 0
    assert quality.drop_rejected(docs).columns == docs.columns
    assert quality.quality_rules(empty).count() == 0


def test_quality_removes_lines(spark):
    import corpus_pipeline

    own = lambda i: " ".join(f"word{chr(97 + (i * 7 + k) % 26)}{chr(97 + i % 26)}{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + i // 26)}" for k in range(60))
    foot = "Read 12 more stories  in our shop"
    table = [(i, f"{own(i)}\n\n{foot.upper() if i % 2 else foot}\n {foot} \nend {own(i + 1)}\n" if i % 3 == 0 else own(i), "en", "hot" if i < 420 else None, -1) for i in range(430)] + [(500, None, "en", "hot", 0)]
    table.append(table[0])
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    norm = lambda x: "".join("0" if c in "0123456789" else c for c in " ".join(x.split()).lower())
    texts = {(s, t or "") for _, t, _, s, _ in table}
    holders: dict = {}
    for s, t in texts:
        for x in {norm(x) for x in t.split("\n")} - {""}:
            holders[s, x] = holders.get((s, x), 0) + 1
    hosts = {s: sum(h == s for h, _ in texts) for s, _ in texts}
    gone = {k for k, n in holders.items() if n > 100 and n > 0.02 * hosts[k[0]]}
    want = sorted((i, "\n".join(x for x in t.split("\n") if (s, norm(x)) not in gone)) for i, t, _, s, _ in table if t)
    assert gone and want[0][1] != table[0][1]
    assert sorted((r.doc_id, r.text) for r in quality.clean_texts(docs).where("text IS NOT NULL").collect()) == want
    assert quality.clean_texts(docs).columns == docs.columns and quality.clean_texts(docs).where("text IS NULL").count() == 1
    passed = corpus_pipeline.quality_stage(spark, docs, "")
    assert passed.schema == docs.schema and sorted((r.doc_id, r.text) for r in passed.collect()) == want
    assert passed.where("n_chars <> length(text)").count() == 0


def test_near_dedup(docs, rows, duck, empty):
    got = near_dedup.similar_components(docs)
    same(got.toPandas(), duck.sql(near_dedup.ORACLE).df())
    same(near_dedup.similar_components(docs, block=3).toPandas(), got.toPandas())
    assert near_dedup.drop_near_copies(docs).count() == got.where("kept").count()
    assert near_dedup.similar_components(empty).count() == 0


def test_links_across_blocks(rows):
    import numpy as np

    sets = {i: shingle_set(t) for i, t, *_ in rows if t and len(shingle_set(t)) > 1}
    ids = np.array(list(sets))
    first = np.arange(len(ids)) % 2 == 0
    found = near_dedup.joining_links(ids, ids, first, list(sets.values()), 75)
    assert found and all(linked(sets[a], sets[b]) for a, b in found)


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_suffix_dedup(docs, rows, limit, empty):
    got = suffix_dedup.remove_repeats(docs, broadcast_bytes=limit).toPandas()
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    want = suffix_dedup.brute_force(texts)
    for r in got.itertuples():
        assert [(s["start"], s["stop"]) for s in r.spans] == want[r.doc_id]
        assert r.n_bytes == len(texts[r.doc_id]) and r.n_bytes - r.n_removed == len(r.kept)
    assert len(got) == len(rows) and got.n_removed.sum() > 0
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_line_dedup(docs, rows, empty):
    got = line_dedup.remove_repeats(docs).toPandas().set_index("doc_id")
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        kept, at = "", 0
        for s in got.removed_spans[i]:
            kept, at = kept + (t or "")[at : s["start"]], s["stop"]
        assert got.kept_text[i] == kept + (t or "")[at:]
    holders = [i for i, t, *_ in rows if t and t.count("\n") == 2]
    assert [got.n_removed_words[i] >= 50 for i in holders] == [False] + [True] * (len(holders) - 1)
    assert line_dedup.remove_repeats(docs, broadcast_rows=0).toPandas().set_index("doc_id").kept_text.to_dict() == got.kept_text.to_dict()
    assert line_dedup.remove_repeats(empty).count() == 0


def plain_line_dedup(rows, min_words):
    """(id, text) -> removed spans of maximal runs, by lists and dictionaries."""
    import re

    def sentences(text):
        out, at = [], 0
        for m in re.finditer(r"[^\n.!?]|[.!?]+(?!\s)|[.!?]*\s+|[.!?]+$|\n", text):
            end = m.end()
            if end == len(text) or re.search(r"[.!?]\s+$", text[at:end]) or "\n" in m.group():
                if text[at:end].strip() or out:
                    out.append((at, end, text[at:end]))
                at = end
        return out

    units = {}
    for i, text in set(rows):
        lines, line, k = [], [], 0
        for m in sentences(text or ""):
            words = m[2].lower().split()
            if words:
                line.append((k, m[0], m[1], words))
                k += 1
            if line and ("\n" in m[2] or m[1] == len(text)):
                lines.append([*line[:-1], (*line[-1][:2], max(m[1], line[-1][2]), line[-1][3])])
                line = []
        units[i, text] = lines
    rank = lambda i: (i is None, i or 0)
    owner = {}
    for (i, _), lines in units.items():
        for line in lines:
            for key in [tuple(w for s in line for w in s[3]) + ("line",), *[tuple(s[3]) for s in line]]:
                owner[key] = min(owner.get(key, rank(i)), rank(i))
    out = {}
    for (i, text), lines in units.items():
        seen, gone, lined, flat = set(), set(), set(), []
        for line in lines:
            for s in line:
                flat.append(s)
                if tuple(s[3]) in seen or owner[tuple(s[3])] < rank(i):
                    gone.add(s[0])
                seen.add(tuple(s[3]))
            key = tuple(w for s in line for w in s[3]) + ("line",)
            if key in seen or owner[key] < rank(i):
                lined |= {s[0] for s in line}
            seen.add(key)
        runs: list[list[int]] = []
        for k in sorted(gone):
            if runs and runs[-1][-1] == k - 1:
                runs[-1].append(k)
            else:
                runs.append([k])
        long = {k for r in runs if sum(len(flat[k][3]) for k in r) >= min_words for k in r}
        final = gone & (lined | long)
        out[i, text] = "".join(text[s[1]:(flat[k + 1][1] if k + 1 < len(flat) else len(text))] for k, s in enumerate(flat) if s[0] not in final)
    return out


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_line_dedup_tells_rows_apart(spark, limit):
    """Null ids and ids with two texts lose what smaller ids have and nothing else."""
    rnd = random.Random(11)
    own = lambda: " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(12)) + "."
    shared, passage = [own() for _ in range(4)], " ".join(own() for _ in range(3))
    rows = [(1, shared[0]), (None, f"{shared[0]}\nfirst text"), (None, own() * 3), (7, f"{own()}\n{shared[1]}"), (7, f"{shared[1]}\n{own()}"), (9, f"{shared[1]}\n{shared[0]}\n{own()}"), (9, own()), (9, own()), (None, f"{shared[2]}\n{own()}"), (None, f"{own()}\n{shared[2]}")]
    rows += [(20, f"{own()} {passage} {own()}"), (21, f"{own()} {passage} {own()}"), (None, f"{own()} {passage}"), (22, f"{own()}\n{own()} {passage}\n{own()}"), (22, None), (23, "")]
    rows += [rows[0], rows[4], rows[1]] + [(k, shared[3]) for k in range(100, 1300)]  # a hot line
    got = line_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), broadcast_rows=limit).collect()
    want = plain_line_dedup([(i, t or "") for i, t in rows], 25)
    originals = sorted((str(i), want[i, t or ""]) for i, t in rows)
    assert sorted((str(r.doc_id), r.kept_text) for r in got) == originals
    assert want[None, rows[2][1]] == rows[2][1] and want[7, rows[4][1]] == rows[4][1] and passage not in want[21, rows[11][1]]


def test_html_keeps_headings_and_reads_broken_markup(spark):
    body = "<p>A first paragraph of the article that says quite a lot of things.</p>"
    article = lambda inner: f"<html><body><nav>menu</nav><article>{body}{inner}</article></body></html>"
    first = "A first paragraph of the article that says quite a lot of things."
    cases = [
        (article('<h2 id="related-work">Related work</h2><p>More.</p>'), [first, "Related work", "More."]),
        (article('<h2 id="social-structure">Social structure</h2>'), [first, "Social structure"]),
        (article('<section id="search-methods"><p>How we searched.</p></section><p id="search-terms">Terms.</p>'), [first, "How we searched.", "Terms."]),
        (article('<h1 class="page-header">The title</h1>'), [first, "The title"]),
        (article("<!--><p>After a whole comment.</p><!---><p>And another.</p>"), [first, "After a whole comment.", "And another."]),
        (article("<p title=it's>One.</p><p>It's two.</p>"), [first, "One.", "It's two."]),
        (article('<p title="a > b">Quoted.</p><!-- <p>gone</p> -->'), [first, "Quoted."]),
        (article("<script src=x/>var gone = 1;</script><p>Behind the script.</p>"), [first, "Behind the script."]),
        (article('<p class="ad">Buy.</p><section id="comments"><p>Nice post!</p></section><ol class="commentlist"><li>First!</li></ol><div id="respond">Say something</div>'), [first]),
        (article('<p class="notice">Gone</p><p class="not-a-notice">Stays.</p>'), [first, "Stays."]),
    ]
    pages = spark.createDataFrame([(k, f"http://h{k}.org/", h) for k, (h, _) in enumerate(cases)], "page_id long, url string, html string")
    got = {r.page_id: r.text.split("\n") for r in html_text.extract(pages).collect()}
    for k, (_, want) in enumerate(cases):
        assert got[k] == want, (k, got[k])


def plain_text(html):
    """A second extractor, on the standard library's parser, for pages whose article is in <article> or <main>: its text without unwanted elements."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.open, self.out, self.now = [], [], ""

        def flush(self):
            if text := " ".join(self.now.split()):
                self.out.append(text)
            self.now = ""

        def handle_starttag(self, tag, attrs):
            if tag == "br":
                self.handle_data(" ")
            if tag in html_text.VOID:
                return
            if tag in html_text.BLOCK or tag in html_text.SKIP:
                self.flush()
            names = [w for k, v in attrs if k in ("class", "id", "role") and v for w in v.split()]
            self.open.append((tag, tag in html_text.SKIP or any(html_text._WHOLE.fullmatch(n) for n in names) and tag not in ("article", "main")))

        def handle_endtag(self, tag):
            if any(tag == t for t, _ in self.open):
                if tag in html_text.BLOCK or tag in html_text.SKIP:
                    self.flush()
                while self.open.pop()[0] != tag:
                    pass

        def handle_data(self, data):
            if any(t in ("article", "main") for t, _ in self.open) and not any(bad for _, bad in self.open):
                self.now += data

    reader = Reader()
    reader.feed(html or "")
    reader.flush()
    return "\n".join(reader.out)


def test_html_equals_a_plain_reader_on_the_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    marked = [i for i, h in html.items() if h and ("<article" in h or "<main" in h)]
    same = sum(got[i] == plain_text(html[i]) for i in marked)
    assert len(got) == len(html) and len(marked) > 50 and same >= 0.97 * len(marked), (same, len(marked))


def test_short_lines(spark):
    texts = ["A short copy.", "a SHORT  copy.", "own one\nsame line\nown two\nsame line\n\nown three", "own four\nSame line\nFirst own. Two words here. Last own.", "Begins new. Two words here. Ends new.", "Two words here. Ends new.\nsame line"]
    got = {r.doc_id: r for r in line_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    assert [got[i].kept_text for i in range(6)] == [texts[0], "", "own one\nsame line\nown two\nown three", "own four\nFirst own. Two words here. Last own.", texts[4], "Two words here. Ends new.\n"]
    assert [got[i].n_removed_words for i in range(6)] == [0, 3, 2, 2, 0, 2]
    assert [(s.start, s.stop) for s in got[2].removed_spans] == [(26, 37)] and got[1].n_removed_units == 1


def based(text):
    """The contract's base columns of one text, in plain Python."""
    import re

    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower().decode())
    at = {label: [i for i in range(len(words)) if words[i : i + len(p.split())] == p.split()] for p, label in licenses.BASE}
    places = sorted(i for found in at.values() for i in found)
    return len(words), len(places), places[0] if places else None, places[-1] if places else None, ",".join(sorted(label for label, found in at.items() if found))


def test_license_base_columns_of_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    text = {r.doc_id: r.text for r in docs.collect()}
    got = licenses.base_scan(docs).collect()
    assert len(got) == len(text) and sum(r.n_base for r in got) > 20
    assert all((r.n_words, r.n_base, r.first_word, r.last_word, ",".join(sorted(r.base_list))) == based(text[r.doc_id]) for r in got)


def test_common_spellings(spark):
    want = {
        "license: Apache-2.0": "apache-2", "License: MIT": "mit", "MIT licensed": "mit", "it is GPLv3 software": "gpl-3", "GPL v2 or later": "gpl-2", "LGPLv2.1": "lgpl-2.1", "licensed under MIT": "mit", "license: BSD": "bsd",
        "php 3 days ago": "", "an artistic 2 day course": "", "php 3.01 license": "php-3.01", "ruby 3 and zlib 1.2": "", "er kommt mit dem Auto": "", "Lizenz frei": "", "license: ISC": "isc", "license MPL-2.0": "mpl-2",
    }
    got = {r.doc_id: r.labels for r in licenses.license_scan(spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")).collect()}
    assert {t: got[i] for i, t in enumerate(want)} == want


def test_licenses(docs, rows, empty):
    got = licenses.license_scan(docs).toPandas().set_index("doc_id")
    for i, text, *_ in rows:
        assert based(text) == tuple(None if x != x else x for x in got.loc[i, ["n_words", "n_base", "first_word", "last_word", "base_labels"]]), i
    r = got.loc[rows[-1][0]]
    assert r.base_labels == "apache-2,cc-by-nc,mit" and set(r.base_labels.split(",")) <= set(r.labels.split(",")) and 0 < r.score <= 1
    assert got.loc[0].n_words == 0 and got.loc[0].labels == "" and got.loc[0].score == 0
    assert len(licenses.rules()) >= 200 and licenses.license_scan(empty).count() == 0


def test_license_keywords(spark):
    from re import _parser

    def samples(tree) -> list[str]:
        """Strings that the pattern matches: every branch once, optional parts left out."""
        out = [""]
        for op, arg in tree:
            op = str(op)
            if op == "LITERAL":
                parts = [chr(arg)]
            elif op == "BRANCH":
                parts = [x for b in arg[1] for x in samples(b)]
            elif op == "SUBPATTERN":
                parts = samples(arg[-1])
            elif op in ("MAX_REPEAT", "MIN_REPEAT"):
                parts = [x * arg[0] for x in samples(arg[2])] if arg[0] else [""]
            elif op == "IN":
                parts = [chr(arg[0][1])] if str(arg[0][0]) == "LITERAL" else ["x"]
            else:
                assert op == "ASSERT_NOT", op
                parts = [""]
            out = [a + b for a in out for b in parts]
        return out

    made = [(i, key, x) for i, _, _, key, pattern in licenses.rules() for x in samples(_parser.parse(pattern))]
    assert {i for i, _, _ in made} == {r[0] for r in licenses.rules()}
    assert not [x for _, key, x in made if not any(k in x for k in key.split("|"))]
    cut = {(i, x.split(" under ")[-1]): (i, x) for i, _, x in made}  # one wording of the grants for each name
    texts = [(k, i, x) for k, (i, x) in enumerate(cut.values())]
    found = licenses.detections(spark.createDataFrame([(k, x) for k, _, x in texts], "doc_id long, text string").repartition(8))
    assert {(k, i) for k, i, _ in texts} <= {(r.doc_id, r.id) for r in found.collect()}
    texts = ["Distributed under the Boost Software 1.0.", "Artistic-2.0", "PHP 3.01", "GFDL 1.3", "a phpx 3.01"]
    got = licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).toPandas().set_index("doc_id").labels
    assert got.to_dict() == {0: "bsl-1", 1: "artistic-2", 2: "php-3.01", 3: "gfdl-1.3", 4: ""}


def test_containment(spark):
    found = spark.createDataFrame([(1, 1, 5, 4, "a", 0, 9), (1, 1, 6, 2, "b", 2, 5), (1, 1, 7, 4, "c", 3, 4), (1, 1, 8, 4, "d", 8, 12)], "doc_id long, text_hash long, id int, priority int, label string, first int, last int")
    assert sorted(r.label for r in licenses.surviving(found).collect()) == ["a", "b", "d"]


def test_bpe(docs, rows, empty):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    t, c = Tokenizer.from_file(path), bpe.Codec(path)
    rnd = random.Random(3)
    parts = ["a", "the", " ", "  ", "\n", "'s", "é", "中", "🙂", "12", "²", "\x1c", "\x85", "<|endoftext|>", "!!", "\r\n", "aaaaaaaa", "q" * 60]
    for _ in range(500):
        s = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25)))
        ids = t.encode(s, add_special_tokens=False).ids
        assert c.encode(s) == ids and c.decode(ids) == t.decode(ids, skip_special_tokens=False)
    got = bpe.token_digests(bpe.encode_documents(docs, path)).toPandas().set_index("doc_id")
    for i, s, *_ in rows:
        ids = t.encode(s or "", add_special_tokens=False).ids
        assert got.n_tokens[i] == len(ids) and got.ids_sha256[i] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got.decoded_sha256[i] == hashlib.sha256((s or "").encode()).hexdigest()
    assert bpe.encode_documents(empty, path).count() == 0


def test_language(spark, docs, empty):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = language.predict(table, language.fit(language.training_rows(table, 500))).join(table.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.lang == got.lang_pred)[got.held_out].mean() > 0.95
    model = language.fit(language.training_rows(docs, 500))
    odd = {r.doc_id: r for r in language.predict(docs, model).collect()}
    assert odd[0].lang_pred == odd[1].lang_pred == odd[2].lang_pred == "und" and odd[0].score == 0
    assert language.predict(empty, language.fit(language.training_rows(empty, 500))).count() == 0


def test_html(spark):
    pages = [
        (1, "https://h.example.com/a", '<html><head><title>t</title><script>var x="</p>"</script></head><body><nav><a href="/">menu</a></nav><article><h1>Head &amp; line</h1><p>First  <b>bold</b>\n text<br>more<p>Second</p></article><div class="comments"><p>reader</p></div><footer>foot</footer></body></html>'),
        (2, "https://h.example.com/b", '<body><article><p>Only &eacute;</p><div class="ad">buy</div></article><foot'),
        (3, None, None), (4, "", ""), (5, "nohost", "<p>bare"), (6, "https://h.example.com/c", "<div class='x1'><p>other layout here</p></div>"),
    ]
    got = {r.page_id: r for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[1].text == "Head & line\nFirst bold text more\nSecond" and got[2].text == "Only é" and got[2].n_chars == 6
    assert got[3].text == got[4].text == "" and got[5].text == "bare" and got[6].text == "other layout here"
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_beside_body(spark):
    body = "<div class='body'><section><p>" + "long text " * 100 + "</p></section><p>" + "more text " * 60 + "</p></div>"
    text = ("long text " * 100).strip() + "\n" + ("more text " * 60).strip()
    pages = [(k, f"https://a.example/{k}", f"<body><p><a href='/'>home page of all</a></p><article><h1>Title {k}</h1><p>Lede</p>{body}<div class='note'><p>End</p></div></article></body>") for k in range(3)]
    pages += [(k, f"https://b.example/{k}", f"<body><h1>Title {k}</h1><div class='page'><p>Lede</p>{body}</div></body>") for k in range(3, 6)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Title {k}\nLede\n{text}" + "\nEnd" * (k < 3) for k in range(6)}


def test_null_ids(spark):
    t = spark.createDataFrame([(None, "a b c d e f", "en", "s"), (3, "a b c d e f", "en", None), (3, "a b c d e f", "en", None)], "doc_id long, text string, lang string, source string")
    assert exact_dedup.exact_groups(t, "largest").count() == 3
    assert quality.quality_rules(t).count() == 3 and licenses.license_scan(t).count() == 3
    assert near_dedup.similar_components(t).count() == 3 and suffix_dedup.remove_repeats(t).count() == 3 and line_dedup.remove_repeats(t).count() == 3


def test_suffix_dedup_awkward(spark):
    """One partition, equal texts, all texts unique, null and large ids, a k-gram that a third of the texts hold in many contexts, cut runs."""
    rnd = random.Random(5)
    words = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6))) for _ in range(n))
    text = words(30)[:109]
    passages = ["-" * 20 + words(7) for _ in range(60)]
    hot = {i: f"{words(10)} {rnd.choice(passages)} {words(5)}{rnd.choice(passages)}" for i in range(120)}
    for texts, extra in (({1: text, 3: text}, {}), ({1: words(30), 2: words(30)}, {}), ({None: text, 9007199254740993: text, 9007199254740992: text + words(3)}, {}), (hot, {}), (hot, {"held_rows": 20})):
        docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
        want = suffix_dedup.brute_force({(1 << 62) if i is None else i: t.encode() for i, t in texts.items()})
        got = {r.doc_id: [(s.start, s.stop) for s in r.spans] for r in suffix_dedup.remove_repeats(docs, **extra).collect()}
        assert got == {i: want[(1 << 62) if i is None else i] for i in texts}


@pytest.mark.parametrize("extra", [{}, {"broadcast_bytes": 0}, {"held_rows": 20}])
def test_suffix_dedup_tells_rows_apart(spark, extra):
    """Null ids and ids with two texts lose what smaller ids have and nothing else."""
    rnd = random.Random(9)
    words = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6))) for _ in range(n))
    a, b, c = words(15), words(20), words(18)
    rows = [(1, a), (None, f"{a}\nfirst"), (None, words(25)), (None, f"{words(5)} {b}"), (None, f"{b} {words(9)}"), (7, f"{words(8)} {a}"), (7, f"{words(30)}"), (7, f"{c} {words(3)}"), (7, f"{words(4)} {c}"), (9, f"{words(2)} {c} {b}"), (9, None)]
    rows += [rows[0], rows[5], rows[1]]
    want = {}
    for i, t in set(rows):
        raw = (t or "").encode()
        smaller = [(u or "").encode() for j, u in rows if j is not None and (i is None or j < i)]
        hit = [any(raw[s : s + 50] in u for u in smaller) for s in range(len(raw) - 49)]
        keep = [not any(hit[max(0, p - 49) : p + 1]) for p in range(len(raw))]
        want[i, t] = bytes(x for x, k in zip(raw, keep) if k)
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), **extra).collect()
    assert sorted((str(r.doc_id), bytes(r.kept)) for r in got) == sorted((str(i), want[i, t]) for i, t in rows)
    assert want[rows[2]] == rows[2][1].encode() and want[rows[8]] == rows[8][1].encode() and len(want[rows[5]]) < len(rows[5][1])


def test_multikey_order():
    import numpy as np

    rows = np.random.default_rng(1).integers(0, 3, (3000, 70)).astype(np.uint8)
    assert [bytes(x) for x in rows[suffix_dedup.multikey_order(rows)]] == sorted(bytes(x) for x in rows)


def test_license_gates_lose_nothing(spark, docs):
    """Every rule on every text, without gates, gives the same detections; so does Python's re."""
    import re

    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").union(docs.selectExpr("doc_id + 100000", "substring(text, 1, 3000)"))
    texts = ["Artistic 2.0", "the apache 2 helicopter", "elastic 2 cm", "Apache License 2.0", "licensed under the Apache Software License, Version 1.1"]
    table = table.union(spark.createDataFrame([(200000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")).repartition(4)
    key = lambda df: sorted((r.doc_id, r.id, r.first, r.last) for r in df.collect())
    got = key(licenses.detections(table))
    assert got == key(licenses.detections(table, gated=False))
    want, patterns = [], [(i, re.compile(p, re.A)) for i, _, _, _, p in licenses.rules()]
    for r in table.collect():
        norm = re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ", (r.text or "").encode().lower().decode()).strip(" ")
        for i, p in patterns:
            want += [(r.doc_id, i, norm[: m.start()].count(" "), norm[: m.end()].count(" ")) for m in p.finditer(norm)]
    assert got == sorted(want)
    labels = {r.doc_id: r.labels for r in licenses.license_scan(table.where("doc_id >= 200000")).collect()}
    assert [labels[200000 + i] for i in range(5)] == ["artistic-2", "", "", "apache-2", "apache-1.1"]


def test_quality_acts_on_small_hosts(spark):
    got = quality.quality_rules(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("removed_words > 0")
    assert got.count() > 0


def test_html_wrappers(spark):
    pages = [
        (1, "https://w.example/1", "<body><div class='content has-sidebar'><article><p>" + "main text " * 20 + "</p></article></div><div class='sidebar'><p>aside</p></div></body>"),
        (2, "https://v.example/2", "<body><div id='page-header-fixed'><article><p>Area <math><mi>x</mi></math> grows.</p></article></div></body>"),
        (3, "https://u.example/3", "<body><article><p>Body " + "word " * 30 + "</p></article><div class='comments'><article><p>reader " + "says " * 90 + "</p></article></div></body>"),
        (4, "https://t.example/4", "<body><noscript>on<article><p>kept?</p></article>"), (9007199254740993, None, "<p>one"), (None, None, "<p>two"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    got = {r.page_id: r.text for r in html_text.extract(df.union(df.limit(1))).collect()}
    assert got[1] == ("main text " * 20).strip() and got[2] == "Area x grows." and got[3] == ("Body " + "word " * 30).strip()
    assert got[9007199254740993] == "one" and got[None] == "two" and 4 in got


def test_large_ids_beside_null(spark):
    import public_tokenizers as P

    big = 9007199254740993
    t = spark.createDataFrame([(None, "a b c d e f"), (big, "a b c d e g"), (big - 1, "a b c d e g")], "doc_id long, text string").coalesce(1)
    ids = lambda df: sorted((r.doc_id or 0) for r in df.collect())
    want = [0, big - 1, big]
    assert ids(near_dedup.similar_components(t)) == want and ids(line_dedup.remove_repeats(t)) == want and ids(suffix_dedup.remove_repeats(t)) == want
    assert ids(bpe.encode_documents(t, P.path("byte_bpe_50k.json"))) == want
    assert ids(language.predict(t, {"langs": ["a"], "slots": 8, "hashes": 1, "words": __import__("numpy").zeros((8, 1), "uint64")})) == want


def test_mixing_places_rows(spark):
    """Rows that repeat an id are placed as often as their own copies say."""
    table = [(1, "a b c", "s"), (1, "a b c", "s"), (1, "d e f g", "s"), (2, "h i", "t")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in table], "doc_id long, text string, lang string, source string, n_chars long")
    placed = mixing.curriculum(docs, WEIGHTS)
    copies = sum(sum(2 * c["words"] >= r["size"] for c in r["copies"]) for r in placed.collect())
    assert mixing.training_order(docs, WEIGHTS).count() == copies > 0


def test_near_dedup_recall(spark):
    """Against all pairs on sf0.01: no link is lost."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets = {r.doc_id: shingle_set(r.text) for r in docs.collect()}
    holders: dict = {}
    for i, s in sets.items():
        for x in s.tolist():
            holders.setdefault(x, []).append(i)
    pairs = {(a, b) for h in holders.values() for k, a in enumerate(h) for b in h[k + 1 :]}
    links = [(a, b) for a, b in pairs if linked(sets[a], sets[b])]
    got = {r.doc_id: r.component_id for r in near_dedup.similar_components(docs).collect()}
    assert links and all(got[a] == got[b] for a, b in links)


def test_long_runs_are_linear():
    import time

    began = time.time()
    assert line_dedup.units_of("!" * 200_000 + "a!" * 100_000)
    assert time.time() - began < 5
