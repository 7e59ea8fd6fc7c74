"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one per block element; elements that say they are
menus, headers, footers, sidebars, notices, adverts, forms, scripts or reader
comments leave a stretch of empty lines. A class name or id alone says so only
if the element does not wrap the page's article. Over windows of lines the lengths of
text outside links are summed. A stretch of text begins where this curve surges
from zero and ends where it dives back; the stretches that rise high enough are
kept whole. On pages that mark their article, only lines inside it take part,
linked text too, and any rise counts.
"""

from __future__ import annotations

import html as markup
import re
from bisect import bisect_right
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from linewright.llm.batches import in_small_batches

#: Lines in a window.
WINDOW = 3
#: A stretch counts if its curve rises to this, or to a share of the page's highest rise.
SURGE, SURGE_SHARE = 80, 0.25
#: An element with a mark in its name wraps the article if it holds this share of the text outside links of the
#: page, or of the container around it; the second share is for names that say nothing but the mark.
WRAPPER_SHARE, NAMED_SHARE = 2 / 3, 0.9

# a quoted value may hold ">" but no "<", so that a broken quote ends at the next tag
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+)>|<(/?)([a-zA-Z][^\s/<>]*)([^<>]*)>|<[!?/][^<>]*>",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+))|([^\s=\"'/]+)")
NAME_PARTS = re.compile(r"[a-z0-9]+|[A-Z][a-z0-9]*|[A-Z]+")

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe template xmp noembed noframes".split())
RAW_ENDS = {name: re.compile(f"</{name}[^<>]*>", re.IGNORECASE) for name in RAW}
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that are never part of an article; a header is one outside of it only.
DROPPED = set("head nav footer aside form button select dialog menu svg canvas object audio video".split()) | RAW
CONTAINERS = ("article", "main")
#: Without these, elements with such names count as one if they hold most of the text.
CONTENT = "content"
CONTENT_NAMES = set("content article post entry story maincontent articlebody postcontent".split())
ROLES = set(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split()
)
#: Parts of class names and ids that mark such elements, whole or as a beginning.
MARKS = set(
    "ad ads adv nav navbar navigation menu menus submenu dropdown topbar toolbar alert alerts login share shares sharing respond "
    "reply replies footer form forms search searchbox colophon".split()
)
MARK_STARTS = tuple(
    "advert adsense adslot adbox announcement banner breadcrumb comment consent cookie copyright disclaimer disqus gdpr masthead "
    "modal newsletter notice offcanvas overlay "
    "pagination pager popup promo recommend related sidebar signup social sponsor subscri widget".split()
)
#: Beginnings that mark nothing, though a shorter one would.
UNMARKED = ("commentar", "sociali", "noticeab")
#: Elements whose ids are often made from a heading, and the words that a name may hold there beside marks.
TEXTUAL = set("p section li dt dd blockquote figure figcaption pre".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6 hgroup".split())
PLAIN_PARTS = set(
    "area article articles author bar block body bottom box button buttons card cards container content count cta entry group heading icons "
    "inner item items left links list message meta more news outer page panel post posts right row section side site slot "
    "stories text thread title top unit wrap wrapper".split()
)


def _is_mark(part: str) -> bool:
    return part in MARKS or (part.startswith(MARK_STARTS) and not part.startswith(UNMARKED))


def _wholly(parts: list[str]) -> bool:
    """Whether a name says nothing but a mark, such as ``related-posts``; ``related-work`` says more."""
    return any(map(_is_mark, parts)) and all(_is_mark(p) or p in PLAIN_PARTS or p.isdigit() for p in parts)


class _Marks(NamedTuple):
    """What the attributes of an element say of it."""

    named: bool = False  # a name or role marks it as no article text
    wholly: bool = False  # the name says nothing else
    unseen: bool = False
    header: bool = False
    comment: bool = False
    kind: str = ""  # which container it is


def _marks(name: str, attributes: str) -> _Marks:
    kind = name if name in CONTAINERS else ""
    if not attributes or attributes.isspace():
        return _Marks(kind=kind)
    names: list[list[str]] = []
    named = unseen = False
    for key, a, b, c, alone in ATTRIBUTE.findall(attributes):
        key, value = (key or alone).lower(), a or b or c
        if key in ("class", "id"):
            names += [[part.lower() for part in NAME_PARTS.findall(word)] for word in value.split()]
        elif key == "role":
            named |= value.strip().lower() in ROLES
            kind = value.strip().lower() if value.strip().lower() in CONTAINERS else kind
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            unseen = True
        elif key == "style":
            unseen |= "display:none" in value.replace(" ", "").lower()
    wholly = any(map(_wholly, names))
    if name in TEXTUAL:
        named |= wholly
    elif name not in HEADINGS:
        named |= any(_is_mark(part) for parts in names for part in parts)
    comment = any(_wholly(parts) and any(p.startswith("comment") for p in parts) for parts in names)
    if not kind and any(not CONTENT_NAMES.isdisjoint(parts) for parts in names):
        kind = CONTENT
    return _Marks(named, wholly, unseen, any("header" in parts for parts in names), comment, kind)


def _tags(page: str) -> list[tuple[int, int, bool, str, str]]:
    """``(start, end, closing, name, attributes)``; comments have no name. What raw elements hold is one tag with them."""
    found = []
    unclosed: set[str] = set()
    at = 0
    while match := TAG.search(page, at):
        start, at = match.span()
        closing = bool(match[1] or match[4])
        name = (match[2] or match[5] or "").lower()
        attributes = match[3] or match[6] or ""
        if name in RAW and not closing:
            end = None if name in unclosed else RAW_ENDS[name].search(page, at)
            if end:
                at = end.end()
            elif name in ("script", "style"):
                at = len(page)
            else:  # an open title or the like must not swallow the page
                unclosed.add(name)
            name = attributes = ""
        found.append((start, at, closing, name, attributes))
    return found


def _ends(tags: list[tuple[int, int, bool, str, str]]) -> dict[int, tuple[int, bool]]:
    """For the place of each opening tag the place where its element ends, and whether a closing tag says so."""
    ends: dict[int, tuple[int, bool]] = {}
    stack: list[int] = []
    waiting: dict[str, int] = {}
    for i, (_, _, closing, name, attributes) in enumerate(tags):
        if not name or name in VOID or attributes.endswith("/"):
            continue
        if not closing:
            stack.append(i)
            waiting[name] = waiting.get(name, 0) + 1
        elif waiting.get(name):
            while True:
                opened = stack.pop()
                waiting[tags[opened][3]] -= 1
                ends[opened] = (i, tags[opened][3] == name)
                if tags[opened][3] == name:
                    break
    ends.update((i, (len(tags), False)) for i in stack)
    return ends


class _Drops:
    """Where to go on after an element that is no article text."""

    def __init__(self, page: str, tags: list[tuple[int, int, bool, str, str]], ends: dict[int, tuple[int, bool]]):
        self.marks = {i: _marks(name, attributes) for i, (_, _, closing, name, attributes) in enumerate(tags) if name and not closing}
        self.starts = [i for i in self.marks if tags[i][3] in CONTAINERS or tags[i][3] in ("body", "section", "h1")]
        # text outside links, dropped elements and comments, up to each tag
        self.text = [0]
        containers: list[tuple[int, int]] = []
        contents: list[tuple[int, int]] = []
        at, skipped = 0, -1
        for i, (start, after, _, name, _) in enumerate(tags):
            self.text.append(self.text[-1] + (len(" ".join(page[at:start].split())) if i > skipped else 0))
            at = after
            mark = self.marks.get(i)
            if mark is None or i < skipped:
                continue
            end, closed = ends.get(i, (i, True))
            fixed = name in ("html", "body")
            if closed and ((name in DROPPED and name != "form") or name == "a" or ((mark.unseen or mark.comment) and not fixed)):
                skipped = end
            elif mark.kind in CONTAINERS:
                containers.append((i, end))
            elif mark.kind and not mark.named and not fixed:
                contents.append((i, end))
        self.text.append(self.text[-1] + (len(" ".join(page[at:].split())) if skipped < len(tags) else 0))
        # the container with most text; of nested ones with as much the inner one
        self.best = max(containers, key=lambda c: (self.held(*c), c[0]), default=None)
        self.content = max(contents, key=lambda c: (self.held(*c), c[0]), default=None)
        articles = [(i, end) for i, end in containers if self.marks[i].kind == CONTAINERS[0]]
        self.article = max(articles, key=lambda c: (self.held(*c), c[0]), default=None)

    def held(self, i: int, end: int) -> int:
        """Characters of text between the tags ``i`` and ``end``."""
        return self.text[min(end, len(self.text) - 2) + 1] - self.text[i + 1]

    def _wraps(self, i: int, end: int) -> bool:
        """Whether an element with a mark holds the article of the page."""
        held = self.held(i, end)
        for best in (self.article, self.best):
            if best and i < best[0] < end and (best == self.article or self.article is None or 2 * self.held(*best) > self.held(*self.article)):
                return True
        around = next((c for c in (self.article, self.best) if c and c[0] < i < c[1]), None)
        share = held / max(1, self.held(*around) if around else self.text[-1])
        if self.marks[i].comment or share < (NAMED_SHARE if self.marks[i].wholly else WRAPPER_SHARE):
            return False
        # a container beside it with text of its own has the article; one around it does not
        beside = [c for c in (self.article, self.best, self.content) if c and not (c[0] < i < c[1] or i <= c[0] < end)]
        return all(self.held(*c) < (SURGE if c == self.content else 1) for c in beside)

    def until(self, i: int, name: str, end: int, closed: bool) -> int | None:
        """The place of the tag to go on from, or None for a wrapper around the article."""
        if closed and ((name in DROPPED and name != "form") or self.marks[i].unseen):
            return end
        if closed or name == "form":
            if self._wraps(i, end):
                return None
        if closed:
            return end
        # no tag closes it: it may not swallow what follows
        at = bisect_right(self.starts, i)
        return self.starts[at] if at < len(self.starts) and self.starts[at] < end else end


def _lines(page: str) -> list[tuple[str, int, frozenset[str]]]:
    """``(text, characters outside links, containers)`` per block; dropped elements give empty ones."""
    tags = _tags(page)
    ends = _ends(tags)
    drops = _Drops(page, tags, ends)
    lines: list[tuple[str, int, frozenset[str]]] = []
    parts: list[str] = []
    linked = 0
    inside: list[int] = []  # where the open containers end
    kinds: list[frozenset[str]] = [frozenset()]  # which they are
    link_end = -1

    def flush() -> None:
        nonlocal linked
        text = " ".join(markup.unescape("".join(parts)).split())
        lines.append((text, max(0, len(text) - linked) if text else 0, kinds[-1]))
        parts.clear()
        linked = 0

    def add(text: str, i: int) -> None:
        nonlocal linked
        parts.append(text)
        if i <= link_end:
            linked += len(" ".join(markup.unescape(text).split()))

    at, i = 0, 0
    while i < len(tags):
        start, after, closing, name, attributes = tags[i]
        add(page[at:start], i)
        at = after
        while inside and i >= inside[-1]:
            flush()
            inside.pop()
            kinds.pop()
        if name and not closing:
            end, closed = ends.get(i, (i, True))
            mark = drops.marks[i]
            fixed = name in ("html", "body") or (mark.kind in CONTAINERS and not mark.comment and not mark.unseen)
            header = not inside and (mark.header or name == "header")
            if name in DROPPED or ((mark.named or mark.unseen or header) and not fixed):
                resume = drops.until(i, name, end, closed)
                if resume is not None and resume > i:
                    flush()
                    lines.extend([("", 0, frozenset())] * WINDOW)
                    at, i = (tags[resume][0] if resume < len(tags) else len(page)), resume
                    continue
            if mark.kind and name in BLOCKS and name not in ("html", "body"):
                flush()
                inside.append(end)
                kinds.append(kinds[-1] | {mark.kind})
            if name == "a":
                link_end = end if closed else i + 1
        if name in BLOCKS:
            flush()
        elif name == "br":
            parts.append(" ")
        i += 1
    add(page[at:], len(tags))
    flush()
    return lines


def _article(lines: list[tuple[str, int, frozenset[str]]]) -> str | None:
    """The kind of container that holds the article: of articles and what ``main`` holds beside them, that with more text."""
    article, main = CONTAINERS
    articles = sum(n for _, n, where in lines if article in where)
    others = sum(n for _, n, where in lines if main in where and article not in where)
    if articles or others:
        return article if articles >= others else main
    content = sum(n for _, n, where in lines if CONTENT in where)
    return CONTENT if 2 * content >= sum(n for _, n, _ in lines) > 0 else None


def main_text(page: str | None) -> str:
    """The kept lines of a page, joined by line breaks; empty if there are none."""
    if not page:
        return ""
    lines = _lines(page)
    marked = _article(lines)
    if marked in CONTAINERS:
        weights = [len(text) if marked in where else 0 for text, _, where in lines]
    else:
        weights = [n if marked is None or marked in where else 0 for _, n, where in lines]
    sums = [0] * (len(lines) + 1)
    for i, n in enumerate(weights):
        sums[i + 1] = sums[i] + n
    blocks = [sums[min(i + WINDOW, len(lines))] - sums[i] for i in range(len(lines))]
    least = 1 if marked else min(SURGE, SURGE_SHARE * max(blocks, default=0))
    kept: list[str] = []
    i = 0
    while i < len(lines):
        if not weights[i]:
            i += 1
            continue
        # a surge; the dive is where a whole window holds nothing
        dive = i
        while dive < len(lines) and blocks[dive]:
            dive += 1
        if max(blocks[i:dive]) >= least:
            last = max(k for k in range(i, dive) if weights[k])
            kept += [text for text, _, where in lines[i : last + 1] if text and (marked is None or marked in where)]
        i = dive
    return "\n".join(kept)


@F.pandas_udf(StringType())
def main_text_of(pages: pd.Series) -> pd.Series:
    return pages.map(main_text, na_action=None)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)``, one row per page, repeated rows included.

    A null page has an empty text. Ids and urls are passed on as they are,
    nulls too; other columns are not looked at. An empty table gives no rows.
    """
    rows = in_small_batches(pages).select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), main_text_of(F.col(html)).alias("text"))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
