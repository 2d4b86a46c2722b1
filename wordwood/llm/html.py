"""Main text of web pages, by scoring the element tree.

A page becomes a tree of elements and a list of text blocks. Elements that are no article by
their tag, role or class (menus, headers, notices, comments and the like) are left out with all
they hold. Each block then earns points for its length and its commas, less the share of its
text that is links, and passes them to the elements around it, less with each level. The element
with the most points, again less its share of links, is the article; its siblings are kept where
they score well or are headings.
"""

from __future__ import annotations

import re
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
# What may end a tag, or a value in it.
MARK = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"([^\s=/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s]+))?")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
DROPPED = RAW | frozenset(
    "head nav header footer aside form button select option object svg canvas template dialog "
    "menu audio video map".split()
)
DROPPED_ROLES = frozenset(
    "navigation banner contentinfo complementary search alert alertdialog dialog menu menubar "
    "form toolbar status tooltip".split()
)
# Words of a class or id that say an element is no article.
DROPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion "
    "banner sidebar nav navbar navigation menu breadcrumb breadcrumbs header masthead footer "
    "comment comments disqus reply replies respond cookie cookies consent gdpr notice notices "
    "alert popup modal overlay subscribe subscription newsletter signup login share sharing social "
    "related recommended recommendations widget pagination pager toolbar hidden".split()
)
# Before such a word they say only that there is, or is not, such an element.
HARMLESS_BEFORE = frozenset("has with no without".split())
NEVER_DROPPED = frozenset("html body main article".split())
BLOCKS = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table "
    "caption thead tbody tfoot tr td th figure figcaption address details summary center hr "
    "fieldset hgroup".split()
) | (DROPPED - frozenset("button select option object svg canvas map".split()))
# What an opening tag closes, and where the search for it stops.
CLOSES = {
    "li": (("li",), ("ul", "ol")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr",), ("table",)),
    "option": (("option",), ("select",)),
}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))

COMMAS = re.compile("[,،、，]")
CHARS_PER_POINT, MOST_LENGTH_POINTS = 100, 3.0
TAG_POINTS = {"article": 10.0, "main": 10.0, "section": 3.0, "div": 3.0, "ul": -3.0, "ol": -3.0}
SIBLING_SHARE, SIBLING_POINTS, SIBLING_LINKS = 0.2, 10.0, 0.25


def _tag_end(html: str, at: int, last: dict[str, int]) -> int:
    """Where the ``>`` of a tag is, whatever its quoted values hold and however long they are; or -1.

    A quote is one if it follows an equals sign and is closed somewhere.
    """
    while at <= last[">"]:
        found = MARK.search(html, at)
        mark, at = found[0], found.end()
        if mark == ">":
            return found.start()
        if at <= last[mark] and html[max(0, found.start() - 64) : found.start()].rstrip()[-1:] == "=":
            at = html.find(mark, at) + 1
    return -1


class Page:
    """Elements as parallel lists, and the text blocks in page order."""

    def __init__(self, html: str, by_name: bool = True):
        self.by_name = by_name
        self.tag, self.parent, self.dropped = ["#page"], [-1], [False]
        # Of each block: innermost block element, text, characters inside links.
        self.blocks: list[tuple[int, str, int]] = []
        self._stack, self._pieces, self._links = [0], [], 0
        self._read(html)

    def _read(self, html: str) -> None:
        at, text_from = 0, 0
        last = {mark: html.rfind(mark) for mark in "<>\"'"}
        while True:
            found = TOKEN.search(html, at)
            name = found["tag"].lower() if found and found["tag"] else ""
            end = _tag_end(html, found.end(), last) if name else -1
            if name and end < 0:
                # No tag: all that is left if it stands alone, else a character like others.
                if found.start() == last["<"]:
                    self._text(html[text_from : found.start()])
                    break
                at = found.start() + 1
                continue
            self._text(html[text_from : found.start() if found else len(html)])
            if not found:
                break
            at = text_from = end + 1 if name else found.end()
            if not name:
                continue
            if found["end"]:
                self._close(name)
                continue
            rest = html[found.end() : end]
            self._open(name, rest)
            if name in RAW and not rest.endswith("/"):
                raw = re.compile(f"</{name}", re.I).search(html, at)
                if raw is None:
                    break
                at = text_from = raw.start()
        self._flush()

    def _text(self, text: str) -> None:
        node = self._stack[-1]
        if text and not self.dropped[node]:
            text = unescape(text)
            self._pieces.append(text)
            if any(self.tag[i] == "a" for i in self._stack):
                self._links += len(text.strip())

    def _flush(self) -> None:
        """End the text block that is being collected."""
        text = " ".join("".join(self._pieces).split())
        if text:
            inner = next(i for i in reversed(self._stack) if i == 0 or self.tag[i] in BLOCKS)
            self.blocks.append((inner, text, min(self._links, len(text))))
        self._pieces, self._links = [], 0

    def _open(self, name: str, rest: str) -> None:
        if name == "br":
            self._pieces.append(" ")
            return
        if name in BLOCKS:
            self._flush()
            self._pop(("p",), ("table", "td", "th", "button", "object"))
        if name in CLOSES:
            self._pop(*CLOSES[name])
        if name in VOID:
            return
        self.tag.append(name)
        self.parent.append(self._stack[-1])
        self.dropped.append(self.dropped[self._stack[-1]] or _is_dropped(name, rest, self.by_name))
        self._stack.append(len(self.tag) - 1)

    def _close(self, name: str) -> None:
        if name in BLOCKS:
            self._flush()
            self._pop((name,), ())
        else:
            # An inline end tag does not reach past the block it stands in.
            self._pop((name,), BLOCKS)

    def _pop(self, names, stops) -> None:
        """Close the innermost open element of these names, unless a stop comes first."""
        for depth in range(len(self._stack) - 1, 0, -1):
            tag = self.tag[self._stack[depth]]
            if tag in names:
                del self._stack[depth:]
                return
            if tag in stops:
                return


def _is_dropped(name: str, rest: str, by_name: bool) -> bool:
    if name in DROPPED:
        return True
    if not rest.strip(" /") or name in NEVER_DROPPED:
        return False
    for key, value in ATTRIBUTE.findall(rest):
        key, value = key.lower(), unescape(value.strip("\"'"))
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key == "role" and value.lower() in DROPPED_ROLES:
            return True
        if key == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if by_name and key in ("class", "id"):
            for one in value.split():
                before = ""
                for part in NAME_PART.findall(one):
                    part = part.lower()
                    if part in DROPPED_NAMES and before not in HARMLESS_BEFORE:
                        return True
                    before = part
    return False


def main_text(html: str | None) -> str:
    """The article of a page, one line per block; empty for null and where there is none.

    Where all text stands in elements whose names say that they are no article, the names are wrong about
    at least one of them: then tags, roles and points alone decide.
    """
    return _article(Page(html or "")) or _article(Page(html or "", by_name=False))


def _article(page: Page) -> str:
    size = len(page.tag)
    points, chars, links = [0.0] * size, [0] * size, [0] * size
    for node, text, linked in page.blocks:
        earned = 1 + len(COMMAS.findall(text)) + min(len(text) / CHARS_PER_POINT, MOST_LENGTH_POINTS)
        earned *= 1 - linked / len(text)
        # A paragraph is scored for what holds it; text that stands in a container, for that.
        holder = page.parent[node] if page.tag[node] in HEADINGS or page.tag[node] == "p" else node
        level = 0
        while holder >= 0:
            points[holder] += earned / (1, 2)[level] if level < 2 else earned / (3 * level)
            holder, level = page.parent[holder], level + 1
        while node >= 0:
            chars[node] += len(text)
            links[node] += linked
            node = page.parent[node]
    if not page.blocks:
        return ""

    def link_share(node: int) -> float:
        return links[node] / chars[node] if chars[node] else 0.0

    score = [
        (p + TAG_POINTS.get(page.tag[i], 0.0)) * (1 - link_share(i)) if p else 0.0
        for i, p in enumerate(points)
    ]
    best = max(range(size), key=lambda i: (score[i], -i))
    # Within an article element the article is all of it.
    node = best
    while node >= 0:
        if page.tag[node] == "article":
            best = node
            break
        node = page.parent[node]
    least = max(SIBLING_POINTS, SIBLING_SHARE * score[best])
    kept = [False] * size
    for i in range(size):
        beside = i != best and page.parent[i] == page.parent[best]
        good = beside and link_share(i) < SIBLING_LINKS and chars[i] > 0
        heading = page.tag[i] in HEADINGS or page.tag[i] == "hgroup"
        paragraph = page.tag[i] == "p" and chars[i] >= CHARS_PER_POINT
        kept[i] = (
            i == best
            or (page.parent[i] >= 0 and kept[page.parent[i]])
            or (good and (score[i] >= least or heading or paragraph))
        )
    return "\n".join(text for node, text, _ in page.blocks if kept[node])


@F.pandas_udf(T.StringType())
def _main_texts(html: pd.Series) -> pd.Series:
    return html.map(main_text)


def extract_pages(
    pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """The main text of every page: ``page_id, url, text, n_chars``, one row per row.

    Null or empty html, and a page without an article, give the empty text. Repeated rows,
    null ids and null urls come out as they went in; other columns are not read. A page is the
    work of one task, whatever its length; no rows are moved.
    """
    read = pages.select(
        F.col(key).alias("page_id"), F.col(url).alias("url"), _main_texts(F.col(html)).alias("text")
    )
    return read.withColumn("n_chars", F.length("text").cast("bigint"))
