"""Main text of web pages from flat text blocks.

A page becomes a flat list of text blocks; each has its number of words, its link density (the share of words in
links), both for the block before and the block after, and whether its elements mark it as chrome of the page, as the
article or as a heading. A decision tree, grown on the small labelled table below, says which blocks are main text.

Defined results: null and empty html give no text; html cut off in a tag or comment ends before it; text without any
element is one block; character references are decoded, white space is one space; repeated rows are read each; other
columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "chrome", "article", "heading")
#: The labelled table: the features of blocks as they come on pages, and 1 for main text.
LABELLED = [
    # menus and breadcrumbs
    ((1, 1.0, 0, 0.0, 1, 1.0, 1, 0, 0), 0),
    ((1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 0), 0),
    ((2, 1.0, 1, 1.0, 9, 0.0, 1, 0, 0), 0),
    ((1, 1.0, 1, 1.0, 1, 1.0, 0, 0, 0), 0),
    ((3, 1.0, 2, 1.0, 40, 0.0, 0, 0, 0), 0),
    ((5, 0.8, 1, 1.0, 12, 0.0, 0, 0, 0), 0),
    ((30, 0.9, 2, 1.0, 60, 0.0, 0, 0, 0), 0),
    # adverts, notices and sidebars
    ((8, 0.0, 1, 1.0, 9, 0.0, 1, 0, 0), 0),
    ((25, 0.0, 1, 1.0, 60, 0.0, 1, 0, 0), 0),
    ((45, 0.2, 80, 0.0, 30, 0.1, 1, 0, 0), 0),
    ((14, 0.1, 120, 0.0, 10, 0.0, 1, 1, 0), 0),
    ((6, 0.0, 90, 0.0, 50, 0.0, 1, 1, 1), 0),
    # forms, comments and footers
    ((2, 0.0, 60, 0.0, 2, 0.0, 1, 0, 0), 0),
    ((35, 0.0, 3, 0.0, 28, 0.0, 1, 0, 0), 0),
    ((60, 0.05, 4, 0.5, 70, 0.0, 1, 1, 0), 0),
    ((9, 0.0, 70, 0.0, 0, 0.0, 1, 0, 0), 0),
    ((7, 0.4, 70, 0.0, 0, 0.0, 1, 0, 0), 0),
    ((4, 0.0, 60, 0.0, 0, 0.0, 0, 0, 0), 0),
    ((3, 0.0, 1, 1.0, 1, 1.0, 0, 0, 0), 0),
    ((2, 0.0, 5, 0.9, 4, 1.0, 0, 0, 1), 0),
    ((5, 0.0, 1, 1.0, 3, 1.0, 0, 0, 0), 0),
    ((6, 0.1, 40, 0.0, 4, 0.0, 0, 0, 0), 0),
    ((4, 0.0, 3, 0.0, 5, 0.0, 0, 0, 0), 0),
    ((7, 0.0, 55, 0.0, 2, 1.0, 0, 0, 0), 0),
    # links within an article
    ((4, 1.0, 70, 0.0, 5, 1.0, 0, 1, 0), 0),
    ((6, 1.0, 4, 1.0, 3, 1.0, 0, 1, 0), 0),
    # headings
    ((7, 0.0, 8, 0.0, 50, 0.0, 0, 1, 1), 1),
    ((12, 0.0, 1, 1.0, 8, 0.0, 0, 1, 1), 1),
    ((3, 0.0, 60, 0.0, 45, 0.0, 0, 1, 1), 1),
    ((5, 0.0, 1, 1.0, 70, 0.0, 0, 0, 1), 1),
    ((9, 0.0, 40, 0.0, 55, 0.0, 0, 0, 1), 1),
    # paragraphs of an article, short ones too
    ((1, 0.0, 80, 0.0, 40, 0.0, 0, 1, 0), 1),
    ((1, 0.0, 2, 0.0, 1, 0.0, 0, 1, 0), 1),
    ((2, 0.0, 12, 0.0, 9, 0.0, 0, 1, 0), 1),
    ((6, 0.0, 30, 0.0, 8, 0.3, 0, 1, 0), 1),
    ((20, 0.0, 7, 0.0, 35, 0.0, 0, 1, 0), 1),
    ((50, 0.1, 60, 0.0, 20, 0.0, 0, 1, 0), 1),
    ((75, 0.3, 50, 0.1, 40, 0.0, 0, 1, 0), 1),
    ((90, 0.0, 9, 0.0, 8, 0.1, 0, 1, 0), 1),
    ((150, 0.05, 90, 0.0, 70, 0.0, 0, 1, 0), 1),
    # the first and the last of an article, beside menus, footers and nothing
    ((2, 0.0, 45, 0.0, 3, 1.0, 0, 1, 0), 1),
    ((9, 0.0, 1, 1.0, 2, 1.0, 0, 1, 0), 1),
    ((33, 0.0, 20, 0.0, 1, 1.0, 0, 1, 0), 1),
    ((70, 0.1, 2, 1.0, 2, 1.0, 0, 1, 0), 1),
    ((5, 0.0, 60, 0.0, 0, 0.0, 0, 1, 0), 1),
    ((28, 0.2, 33, 0.0, 0, 0.0, 0, 1, 0), 1),
    ((1, 0.0, 0, 0.0, 0, 0.0, 0, 1, 0), 1),
    ((3, 0.4, 15, 0.0, 20, 0.0, 0, 1, 0), 1),
    ((60, 0.0, 50, 0.0, 3, 1.0, 0, 0, 0), 1),
    ((24, 0.1, 1, 1.0, 1, 1.0, 0, 0, 0), 1),
    ((35, 0.0, 40, 0.0, 0, 0.0, 0, 0, 0), 1),
    # paragraphs of pages without such elements
    ((18, 0.0, 6, 0.0, 30, 0.0, 0, 0, 0), 1),
    ((40, 0.0, 3, 1.0, 55, 0.0, 0, 0, 0), 1),
    ((65, 0.1, 40, 0.0, 60, 0.0, 0, 0, 0), 1),
    ((120, 0.0, 65, 0.1, 5, 0.8, 0, 0, 0), 1),
    ((16, 0.1, 50, 0.0, 45, 0.0, 0, 0, 0), 1),
    ((80, 0.25, 0, 0.0, 0, 0.0, 0, 0, 0), 1),
]

_SILENT = "script|style|noscript|template|textarea|title|svg|math|iframe|object|canvas|select|button|xmp"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<({_SILENT})(?=[\s/>])(?:\"[^\"]*\"|'[^']*'|[^>\"'])*>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|<[a-zA-Z][^>]*\Z",
    re.S | re.I,
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split()
)
_CHROME_TAGS = frozenset("nav footer aside form menu dialog head fieldset".split())
_ARTICLE_TAGS = frozenset(("article", "main"))
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_NAMES = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_CHROME_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "notification alert popup modal overlay newsletter subscribe subscription signup login nav navbar navigation menu breadcrumb breadcrumbs "
    "pagination pager sidebar aside widget widgets related recommended share sharing social footer header masthead topbar toolbar comment comments "
    "respond reply replies discussion disqus form search complementary contentinfo".split()
)


@dataclass
class Block:
    text: str
    words: int
    links: float
    chrome: bool
    article: bool
    heading: bool


def _is_chrome(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in _CHROME_TAGS or (tag == "header" and not in_article):
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    if _HIDDEN.search(attributes):
        return True
    for m in _NAMES.finditer(attributes):
        names = set(re.split(r"[^a-z]+", (m[2] or m[3] or m[4] or "").lower()))
        if names & _CHROME_NAMES and not (tag == "header" and in_article):
            return True
    return False


def blocks(page: str | None) -> list[Block]:
    """The non-empty text blocks of a page in order."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, bool]] = [("", False, False, False)]
    parts: list[tuple[str, bool]] = []
    in_link = 0

    def close() -> None:
        if parts:
            text = " ".join(html.unescape("".join(t for t, _ in parts)).split())
            if text:
                words = text.count(" ") + 1
                linked = sum(len(html.unescape(t).split()) for t, link in parts if link)
                _, chrome, article, heading = stack[-1]
                out.append(Block(text, words, min(1.0, linked / words), chrome, article, heading))
            parts.clear()

    page, at = page or "", 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            parts.append((page[at : m.start()], in_link > 0))
        at = m.end()
        if m[3] is None:
            continue
        tag, ends = m[3].lower(), bool(m[2])
        if tag == "br":
            parts.append((" ", False))
            continue
        if tag in _INLINE:
            if tag == "a":
                in_link = 0 if ends else 1
            if ends or not m[4]:
                continue
            if not _is_chrome(tag, m[4], stack[-1][2]):
                continue
        close()
        if ends:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    in_link = 0
                    break
        elif tag not in _VOID and tag not in _INLINE:
            _, chrome, article, heading = stack[-1]
            in_link = 0
            stack.append((tag, chrome or _is_chrome(tag, m[4], article), article or tag in _ARTICLE_TAGS, heading or tag in _HEADINGS))
    if at < len(page):
        parts.append((page[at:], in_link > 0))
    close()
    return out


def features(found: list[Block]) -> list[tuple]:
    rows = []
    for i, b in enumerate(found):
        before = (found[i - 1].words, found[i - 1].links) if i else (0, 0.0)
        after = (found[i + 1].words, found[i + 1].links) if i + 1 < len(found) else (0, 0.0)
        rows.append((b.words, b.links, *before, *after, int(b.chrome), int(b.article), int(b.heading)))
    return rows


@dataclass
class Node:
    share: float
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None

    def says(self, row: tuple) -> bool:
        node = self
        while node.low is not None:
            node = node.low if row[node.feature] <= node.cut else node.high
        return node.share >= 0.5


def grow(rows: list[tuple[tuple, int]], depth: int = 6, least: int = 1) -> Node:
    """A tree of binary cuts, each with the least Gini impurity (of equal ones the first feature and lowest cut)."""

    def impurity(part: list[tuple[tuple, int]]) -> float:
        p = sum(y for _, y in part) / len(part)
        return len(part) * p * (1 - p)

    share = sum(y for _, y in rows) / len(rows)
    best = (impurity(rows) - 1e-9, None)
    if depth and 0 < share < 1:
        for f in range(len(rows[0][0])):
            values = sorted({x[f] for x, _ in rows})
            for a, b in zip(values, values[1:]):
                cut = (a + b) / 2
                low, high = [r for r in rows if r[0][f] <= cut], [r for r in rows if r[0][f] > cut]
                if min(len(low), len(high)) >= least and impurity(low) + impurity(high) < best[0]:
                    best = (impurity(low) + impurity(high), (f, cut, low, high))
    if best[1] is None:
        return Node(share)
    f, cut, low, high = best[1]
    return Node(share, f, cut, grow(low, depth - 1, least), grow(high, depth - 1, least))


def main_text(page: str | None, tree: Node) -> str:
    found = blocks(page)
    return " ".join(b.text for b, row in zip(found, features(found)) if tree.says(row))


def extracted(pages: DataFrame, labelled: list[tuple[tuple, int]] = LABELLED) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html)."""
    tree = grow(labelled)

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [main_text(h, tree) for h in pdf["html"]]
            yield pd.DataFrame(
                {"page_id": pdf["page_id"].astype("Int64"), "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]}
            )

    return pages.select("page_id", "url", "html").mapInPandas(extract, "page_id long, url string, text string, n_chars long")
