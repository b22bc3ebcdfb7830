r"""Operator 6, quality rules: counts of a text and cross-document line frequency (DataFrame functions only).

Counts (words are runs without space and \x09-\x0D): words, code points in words, symbols, repeated lines, words in 3-word
windows that occur twice or more. A text with fewer than min_words words, or more than half of them in repeated windows, fails.

Line frequency: lines are normalised (ASCII lower case, runs of white space to one space, trimmed, digits to 0) and hashed with
their host (the source). For each host the distinct documents of a line are counted, by partial aggregates before the shuffle.
A line in more than max(min_docs, share * documents of its host) documents is removed (min_docs, a few, only keeps a line that two
or three documents of a tiny host share), and a document that keeps less than min_left of its words is rejected. Lines over the limit are few and are joined broadcast only after their count was checked, else salted. clean_texts and
drop_rejected give the texts themselves without these lines; the counts and the verdict are those of the texts as given.

Cases: null text is an empty one (no words, fails the base rules). A null source is a host of its own. Rows that repeat an id
and text are one document. Extra columns are ignored; an empty table gives no rows. Very long texts stay in one row: every
expression is linear (or sorts) in the words of a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixspark.llm.common import BLANKS, ascii_lower, checkpointed, lookup_join


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, BLANKS + "+"), lambda w: w != "")


def repeat_words(words: Column) -> Column:
    """Words covered by 3-word windows whose hash occurs again in the text: windows are sorted by hash and compared to neighbours."""

    def covered(sorted_windows: Column) -> Column:
        def again(w: Column, k: Column) -> Column:
            before, after = F.get(sorted_windows, k - 1)["h"], F.get(sorted_windows, k + 1)["h"]
            return F.coalesce(before == w["h"], F.lit(False)) | F.coalesce(after == w["h"], F.lit(False))

        at = F.filter(sorted_windows, again)
        return F.size(F.array_distinct(F.flatten(F.transform(at, lambda w: F.array(w["i"], w["i"] + 1, w["i"] + 2)))))

    def of(ws: Column) -> Column:
        hashes = F.slice(F.transform(ws, lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2))), 1, F.greatest(F.size(ws) - 2, F.lit(0)))

        def counted(hs: Column) -> Column:
            windows = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
            any_again = F.size(F.array_distinct(hs)) < F.size(hs)
            return F.when(any_again, F.get(F.transform(F.array(windows), covered), F.lit(0))).otherwise(0).cast("long")

        return F.get(F.transform(F.array(hashes), counted), F.lit(0))

    # arrays of one element bind their value to a lambda variable: evaluated once, even if the optimiser inlines this column
    return F.get(F.transform(F.array(words), of), F.lit(0))


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host, text_hash and the counts, one row for each row of docs."""
    text = F.col("text")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("words", words_of(text))
    return rows.select(
        "doc_id",
        "host",
        F.xxhash64("text").alias("text_hash"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
    )


def line_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host, text_hash, lines: a text's normalised lines as (key, words, at); the key hashes host and line, at is the place among all lines."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    host = F.col("host")
    lower = F.regexp_replace(F.regexp_replace(ascii_lower(F.col("text")), r"[\x20\x09\x0B-\x0D]+", " "), "[0-9]", "0")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), text.alias("text"))
    lines = F.filter(F.transform(F.split(lower, "\n"), lambda x, i: F.struct(F.trim(x).alias("line"), i.alias("at"))), lambda x: x["line"] != "")
    words = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1
    entries = F.transform(lines, lambda x: F.struct(F.xxhash64(host.isNull(), host, x["line"]).alias("key"), words(x["line"]).alias("words"), x["at"].alias("at")))
    return rows.select("doc_id", "host", F.xxhash64("text").alias("text_hash"), entries.alias("lines"))


def frequent_lines(keyed: DataFrame, min_docs: int, share: float) -> DataFrame:
    """Keys of the lines over the limit of their host."""
    host_key, document = F.xxhash64(F.col("host").isNull(), F.col("host")).alias("host_key"), F.xxhash64("doc_id", "text_hash").alias("document")
    limits = keyed.select(host_key, document).distinct().groupBy("host_key").agg((F.count("*") * share).alias("limit"))
    pairs = keyed.select(host_key, document, F.explode(F.array_distinct(F.transform("lines", lambda x: x["key"]))).alias("key"))
    # rows that repeat a document fall together; then a line's documents are counted by partial aggregates
    counts = pairs.distinct().groupBy("key").agg(F.count("*").alias("in_docs"), F.min("host_key").alias("host_key")).where(F.col("in_docs") > min_docs)
    return counts.join(limits, "host_key").where(F.col("in_docs") > F.col("limit")).select("key")


def lines_over_limit(docs: DataFrame, min_docs: int = 5, share: float = 0.02, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """_id, _hash, removed_words and removed_lines (sorted places among all lines), one row for each document that has lines over the limit."""
    keyed = line_keys(docs, id_col, text_col, host_col)
    over = frequent_lines(keyed, min_docs, share)
    lines = keyed.select("doc_id", "text_hash", F.explode("lines").alias("line")).select("doc_id", "text_hash", "line.at", "line.key", "line.words")
    hit = lookup_join(lines, over, ["key"], "inner", F.col("doc_id"))
    removed = hit.groupBy("doc_id", "text_hash", "at").agg(F.max("words").alias("words")).groupBy("doc_id", "text_hash")
    removed = removed.agg(F.sum("words").alias("removed_words"), F.sort_array(F.collect_list("at")).alias("removed_lines"))
    return removed.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "removed_words", "removed_lines")


def judged(docs: DataFrame, min_words: int = 50, min_docs: int = 5, share: float = 0.02, min_left: float = 0.2, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The columns of quality_rules and removed_lines (null without any)."""
    base = checkpointed(base_counts(docs, id_col, text_col, host_col))  # small rows; no filter on them can repeat the counting
    removed = lines_over_limit(docs, min_docs, share, id_col, text_col, host_col)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = base.join(removed, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    rows = rows.withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long")).withColumn("base_failed", failed)
    left = F.col("n_words") - F.col("removed_words")
    return rows.withColumn("kept", ~F.col("base_failed") & (left >= min_left * F.col("n_words"))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept", "text_hash", "removed_lines"
    )


def quality_rules(docs: DataFrame, min_words: int = 50, min_docs: int = 5, share: float = 0.02, min_left: float = 0.2, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, the counts, base_failed, removed_words (in lines over the limit) and kept, one row for each row of docs."""
    return judged(docs, min_words, min_docs, share, min_left, id_col, text_col, host_col).drop("removed_lines")


def without_lines(text: Column, removed: Column) -> Column:
    """The text less the lines at the sorted places `removed`: the slices between them, so linear in the lines."""

    def between(lines: Column, ends: Column) -> Column:
        return F.flatten(F.transform(F.sequence(F.lit(1), F.size(ends) - 1), lambda k: F.slice(lines, F.get(ends, k - 1) + 2, F.get(ends, k) - F.get(ends, k - 1) - 1)))

    def of(lines: Column) -> Column:
        ends = F.concat(F.array(F.lit(-1)), removed, F.array(F.size(lines)))
        return F.array_join(F.get(F.transform(F.array(ends), lambda e: between(lines, e)), F.lit(0)), "\n")

    return F.get(F.transform(F.array(F.split(text, "\n")), of), F.lit(0))


def _cleaned(docs: DataFrame, removed: DataFrame, how: str) -> DataFrame:
    """docs joined to one row a document (_id, _hash, removed_lines), their texts without the removed lines."""
    marked = docs.withColumn("_id_key", F.col("doc_id")).withColumn("_hash_key", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    rows = marked.join(removed.withColumnRenamed("removed_lines", "_removed"), F.col("_id_key").eqNullSafe(F.col("_id")) & (F.col("_hash_key") == F.col("_hash")), how)
    text = F.when(F.col("_removed").isNull(), F.col("text")).otherwise(without_lines(F.col("text"), F.col("_removed"))).alias("text")
    return rows.select(*[text if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def clean_texts(docs: DataFrame, **limits) -> DataFrame:
    """All rows of docs with all their columns, the texts without their lines over the limit."""
    return _cleaned(docs, lines_over_limit(docs, **limits).drop("removed_words"), "left")


def drop_rejected(docs: DataFrame, **rules) -> DataFrame:
    """The rows of docs that pass, with all their columns, the texts without their lines over the limit."""
    kept = judged(docs, **rules).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "removed_lines")
    return _cleaned(docs, kept.dropDuplicates(["_id", "_hash"]), "inner")


ORACLE = r"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
tri AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT doc_id, words, unnest(range(1, CAST(len(words) AS BIGINT) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS d) GROUP BY doc_id),
norm AS (SELECT doc_id, source, text, generate_subscripts(l, 1) AS ln, unnest(l) AS line FROM (SELECT doc_id, source, text,
  string_split(regexp_replace(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09\x0B-\x0D]+', ' ', 'g'), '[0-9]', '0', 'g'), chr(10)) AS l FROM t)),
trimmed AS (SELECT doc_id, source, text, ln, trim(line, ' ') AS line FROM norm WHERE trim(line, ' ') <> ''),
hosts AS (SELECT source, count(*) AS docs FROM t GROUP BY source),
over_limit AS (SELECT x.source, x.line FROM (SELECT source, line, count(DISTINCT doc_id) AS n FROM trimmed GROUP BY source, line) x
  JOIN hosts h ON x.source IS NOT DISTINCT FROM h.source WHERE n > 5 AND n > 0.02 * docs),
gone AS (SELECT x.doc_id, sum(length(x.line) - length(replace(x.line, ' ', '')) + 1) AS n FROM trimmed x
  JOIN over_limit o ON x.line = o.line AND x.source IS NOT DISTINCT FROM o.source GROUP BY x.doc_id),
counts AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
  CAST(coalesce(gone.n, 0) AS BIGINT) AS removed_words
  FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id LEFT JOIN gone ON w.doc_id = gone.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, removed_words,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - removed_words >= 0.2 * n_words AS kept FROM counts
"""
