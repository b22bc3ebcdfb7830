r"""Operator 2, HTML extraction: consensus host paths.

1. Score: each page is tokenised and walked; every container collects the text of the blocks below it, less what stands in links,
   and the page proposes its best container as a generalised path: tag names with their first class, digits as 0, no positions.
2. Vote (Spark): per host the pages' proposals are summed by path; the paths with at least min_share of a host's votes win.
3. Re-extract: a page is read again and the containers on a winning path of its host give its text; a page in which none of them
   has text falls back to its own best container. A container inside an article or main is extended to the nearest of these, and
   blocks directly in the containers around it come along if they have text outside links (headings and ledes beside the body).

The text: character references decoded, white space inside a block one space, blocks in page order joined by one newline.
Never part of it: head, script, style, forms, navigation, header, footer, aside, comments and whatever a class, id or role names
as a menu, notice, advert, sidebar, reader comments and the like (but a container so named stays if it wraps the article and half of the
page's text: a layout class).

Cases: null html counts as empty and gives an empty text. A null url, or one without a host, is the host ''. Broken or cut
markup is read as far as it goes. Repeated rows give equal rows, extra columns are ignored, an empty table gives no rows. Hosts'
winning paths are few for each host; they are broadcast only up to a checked count and salted beyond.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixspark.llm.common import lookup_join, map_frames

#: Comments (<!--> is a whole one), declarations, tags (a quote opens a value only behind =), a tag cut off by the end of the page, text.
_TOKEN = re.compile(r"""<!---?>|<!--.*?(?:--!?>|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)>|<[a-zA-Z/!][^>]*\Z|([^<]+|<)""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp".split())
SKIP = frozenset("head nav header footer aside form button select option fieldset label dialog menu object audio video canvas noscript template svg".split()) | RAW
BLOCK = frozenset("address article blockquote body center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINER = frozenset("article body center div main section td".split())
#: Elements that end an open paragraph; and pairs in which a new element ends an open one of the same kind.
CLOSES_P = BLOCK
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_WORDS = (
    r"ads?|adv|advert\w*|sponsor\w*|promo\w*|banner|sidebar|side-?bar|menu|nav|navbar|navigation|breadcrumbs?|header|masthead|footer|comments?|comment-?list|respond|replies|disqus"
    r"|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|login|search|share|sharing|social|related|recommended|widget|toolbar|pagination|pager|complementary|contentinfo|dialog"
)
_UNWANTED = re.compile(rf"(?:^|[\s_-])(?:{_WORDS})(?:$|[\s_-])", re.I)
#: The same as a whole class: what counts on elements of running text, and for a section in the article also its id.
_WHOLE = re.compile(_WORDS, re.I)
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr blockquote pre figure figcaption a abbr b cite code em i mark q s small span strong sub sup u time".split())


def named_unwanted(tag: str, marks: dict[str, str], in_article: bool) -> bool:
    """Whether an element's class, id or role says that it isn't part of the article."""
    if tag in RUNNING or (tag == "section" and in_article):
        names = marks.get("class", "").split() + [marks.get("role", "")] + ([marks.get("id", "")] if tag == "section" else [])
        return any(_WHOLE.fullmatch(n) for n in names if n)
    return any(_UNWANTED.search(v) for v in marks.values())


#: Of these the words that never stand on a wrapper of the article; an element named by others is kept if it wraps an article that has
#: at least half of the page's text (a layout class such as has-sidebar or page-header-fixed).
_NEVER = re.compile(r"(?:^|[\s_-])(?:comments?|comment-?list|respond|replies|disqus|related|recommended|cookies?|consent|gdpr|newsletter|popup|modal|overlay|ads?|advert\w*|sponsor\w*)(?:$|[\s_-])", re.I)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def blocks_of(html: str) -> list[tuple[tuple[str, ...], str, int]]:
    """(container paths from the root, text, characters in links) of each text block outside unwanted elements, in page order."""
    stack: list[tuple[str, str | None, bool, int]] = []  # tag, generalised name if a container, unwanted, number if its class may be a layout's
    bad = links = linked = 0
    parts: list[str] = []
    out: list[tuple[tuple[str, ...], str, int]] = []
    doubtful: list[tuple[int, ...]] = []  # a block's elements that are unwanted unless they wrap the article
    wraps: dict[int, bool] = {}
    raw = ""

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", unescape("".join(parts))).strip()
            if text:
                out.append((tuple(n for _, n, _, _ in stack if n), text, linked))
                doubtful.append(tuple(d for *_, d in stack if d))
            parts.clear()
            linked = 0

    def pop() -> None:
        nonlocal bad, links
        tag, _, unwanted, _ = stack.pop()
        bad -= unwanted
        links -= tag == "a"

    for m in _TOKEN.finditer(html):
        closing, tag, attributes, text = m.groups()
        if raw:
            if tag and closing and tag.lower() == raw:
                raw = ""
            continue
        if text is not None:
            if not bad:
                parts.append(text)
                linked += len(text) if links else 0
        elif tag:
            tag = tag.lower()
            if tag == "br":
                parts.append(" ")
            elif tag in VOID:
                if tag == "hr":
                    flush()
            elif closing:
                if any(tag == t for t, *_ in stack):
                    if tag in BLOCK or tag in SKIP:
                        flush()
                    while stack[-1][0] != tag:
                        pop()
                    pop()
            elif tag in RAW:  # a slash at its end doesn't close it
                raw = tag
            else:
                block = tag in BLOCK or tag in SKIP
                if block:
                    flush()
                    if tag in CLOSES_P and any(t == "p" for t, *_ in stack):
                        while stack[-1][0] != "p":
                            pop()
                        pop()
                    if stack and stack[-1][0] in SAME.get(tag, ()):
                        pop()
                name, unwanted, doubt = None, tag in SKIP, 0
                if block or attributes:
                    marks = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)} if attributes else {}
                    if tag not in ("html", "body", "article", "main") and marks and not unwanted:
                        unwanted = named_unwanted(tag, marks, any(t in ("article", "main") for t, *_ in stack))
                        if unwanted and tag in CONTAINER and not any(_NEVER.search(v) for v in marks.values()):
                            unwanted, doubt = False, len(wraps) + 1
                            wraps[doubt] = False
                    elif tag in ("article", "main") and not any(_UNWANTED.search(v) for v in marks.values()) and not bad:
                        wraps.update({d: True for *_, d in stack if d})
                    if tag in CONTAINER:
                        first = marks.get("class", "").split()[:1]
                        name = _DIGITS.sub("0", ".".join([tag, *first]))
                stack.append((tag, name, unwanted, doubt))
                bad += unwanted
                links += tag == "a"
    flush()
    if wraps:
        size = {d: 0 for d in wraps}
        for (_, text, _), ds in zip(out, doubtful):
            for d in ds:
                size[d] += len(text)
        whole = sum(len(text) for _, text, _ in out)
        gone = {d for d in wraps if not wraps[d] or 2 * size[d] < whole}
        out = [b for b, ds in zip(out, doubtful) if not gone.intersection(ds)]
    return out


def best_path(blocks: list[tuple[tuple[str, ...], str, int]]) -> tuple[str, int]:
    """The path of the page's best container and its score: text outside links, less a part for each step away from its blocks."""
    scores: dict[tuple[str, ...], float] = {}
    for path, text, linked in blocks:
        own = max(0, len(text) - 2 * linked)
        for up in range(len(path)):
            at = path[: len(path) - up]
            scores[at] = scores.get(at, 0.0) + own * 0.75**up
    if not scores:
        return "", 0
    path = max(scores, key=lambda p: (scores[p], len(p), p))
    return "/".join(path), int(scores[path])


def enclosing(path: tuple[str, ...]) -> tuple[str, ...]:
    """The path up to its nearest article or main; the path itself if it is in none."""
    for k in range(len(path), 0, -1):
        if path[k - 1].split(".")[0] in ("article", "main"):
            return path[:k]
    return path


def under(blocks: list[tuple[tuple[str, ...], str, int]], winners: set[str]) -> str:
    """The texts of the blocks inside a container on a winning path or its article, and of those directly in a container around it."""
    won = {path[:k] for path in {p for p, _, _ in blocks} for k in range(1, len(path) + 1) if "/".join(path[:k]) in winners}
    if not won:
        return ""
    whole = {enclosing(p) for p in won}
    around = {p[:k] for p in whole for k in range(1, len(p))}
    memo: dict[tuple[str, ...], bool] = {}
    kept = []
    for path, text, linked in blocks:
        if path not in memo:
            memo[path] = any(path[:k] in whole for k in range(1, len(path) + 1))
        if memo[path] or (path in around and len(text) > 2 * linked):
            kept.append(text)
    return "\n".join(kept)


def propose(pages: DataFrame) -> DataFrame:
    """host, path, score: each page's vote."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [best_path(blocks_of(h or "")) for h in b["html"]]
            yield pd.DataFrame({"host": b["host"], "path": [p for p, _ in found], "score": [s for _, s in found]})

    return pages.select("host", "html").mapInPandas(run, "host string, path string, score long").where("path <> ''")


def winning_paths(votes: DataFrame, min_share: float) -> DataFrame:
    """host and its winning paths; a vote counts one, the score breaks ties."""
    sums = votes.groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum("score").alias("score"))
    of_host = Window.partitionBy("host")
    rated = sums.withColumn("share", F.col("votes") / F.sum("votes").over(of_host)).withColumn("place", F.row_number().over(of_host.orderBy(F.desc("votes"), F.desc("score"), "path")))
    return rated.where((F.col("share") >= min_share) | (F.col("place") == 1)).groupBy("host").agg(F.array_sort(F.collect_list("path")).alias("winners"))


def extract(pages: DataFrame, min_share: float = 0.2, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars and path_source ('host' or 'page', null without text) for each row of pages."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    winners = winning_paths(propose(rows), min_share)
    with_paths = lookup_join(rows, winners, ["host"], "left", F.col("page_id"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, origin = [], []
            for html, paths in zip(b["html"], b["winners"]):
                blocks = blocks_of(html or "")
                text = under(blocks, set(paths)) if paths is not None else ""
                origin.append("host" if text else None)
                if not text and (own := best_path(blocks)[0]):
                    text = under(blocks, {own})
                    origin[-1] = "page" if text else None
                if not text and blocks:  # text outside any container
                    text, origin[-1] = "\n".join(t for _, t, _ in blocks), "page"
                texts.append(text)
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": texts, "path_source": origin})

    id_type = pages.schema[id_col].dataType.simpleString()
    out = map_frames(with_paths.select("page_id", "url", "html", "winners"), run, f"page_id {id_type}, url string, text string, path_source string")
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "path_source")
