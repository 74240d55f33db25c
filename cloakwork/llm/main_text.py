"""Main text of web pages by line-block distribution.

Markup is stripped into lines: each block-level element begins and ends a line, all else runs on. Every line has a text length, the number of its
characters that count; characters in links, and in what is marked as boilerplate (menus, headers, footers, sidebars, notices, adverts, forms, comments, by element or by
class and id words), count nothing. Where a page marks its article, all characters in it count, links' too, and none outside of it.

The lengths are summed over a sliding window of lines. Text begins at a surge point, a line with text whose window rises from nothing to `surge` characters,
and ends at the dive point, the last line with text before the window falls to nothing. Every page goes through this. The lines between are kept, but
for those that are marked as boilerplate or lie outside of a marked article; nothing is cut off at a length. In a marked article any text is text, so there `surge`
is one character and all stretches stay. Elsewhere the heaviest stretch stays, with those next to it that have at least `share` of its weight, and headings
right before it; if no window reaches `surge`, one character is enough.

Defined results: null and empty pages have no text; character references are decoded as HTML 5 does, without a semicolon too; white space inside a
line becomes one space; a page cut off anywhere, even inside a tag, gives what stands before; rows of equal ids or pages each get a row, with all other
columns but those named text and n_chars; an empty table gives none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import spread

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|iframe|object|svg|math|select|textarea|title|button|canvas|audio|video)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)",
    re.S | re.I,
)
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
BOILERPLATE = frozenset("nav header footer aside form menu dialog head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_UNMARKED = VOID | frozenset("html body main p b i em strong a h1 h2 h3 h4 h5 h6".split())
_ARTICLE = re.compile(r"<article\b", re.I)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+|\d+")
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs sidebar aside widget widgets header masthead footer copyright "
    "cookie cookies consent notice gdpr popup modal newsletter subscribe subscription signup login social share sharing related recommended comments comment respond disqus replies pagination pager skip toolbar complementary contentinfo search".split()
)
_SPACE = re.compile(r"\s+")


def _is_marked(attributes: str) -> bool:
    for m in _ATTRIBUTE.finditer(attributes):
        if not MARKS.isdisjoint(_WORD.findall((m[2] or m[3] or m[4] or "").lower())):
            return True
    return False


class Lines:
    """The lines of a page: text, characters that count, whether boilerplate, and whether inside a marked article."""

    def __init__(self, html: str, marks: bool = True):
        self.marks = marks
        self.container = "article" if _ARTICLE.search(html) else "main"
        self.text: list[str] = []
        self.length: list[int] = []
        self.boiler: list[bool] = []
        self.inside: list[bool] = []
        self.has_article = False
        self._read(html)

    def _is_boilerplate(self, name: str, attributes: str, article: int) -> bool:
        if name in BOILERPLATE:
            return not (name == "header" and article)  # an article's own header holds its title
        return bool(self.marks and attributes and name not in _UNMARKED and _is_marked(attributes))

    def _read(self, html: str) -> None:
        parts: list[str] = []
        linked = 0
        link = article = 0
        skipped: list[str] = []  # open elements from the outermost boilerplate element on
        place = 0

        def close() -> None:
            nonlocal linked
            text = _SPACE.sub(" ", unescape("".join(parts))).strip()
            if text:
                self.text.append(text)
                self.length.append(max(0, len(text) - linked))
                self.boiler.append(bool(skipped))
                self.inside.append(article > 0)
            parts.clear()
            linked = 0

        for m in _TOKEN.finditer(html):
            if m.start() > place:
                run = html[place : m.start()]
                parts.append(run)
                if link:
                    linked += len(run)
            place = m.end()
            name = m[3] or m[6]
            if not name:
                continue
            name, closing, attributes = name.lower(), bool(m[2] or m[5]), m[4] or m[7] or ""
            if name == "br":
                parts.append(" ")
                continue
            if name in BLOCK:
                close()
            if name == "a":
                link = 0 if closing else 1
            if closing:
                if skipped and name in skipped:
                    while skipped.pop() != name:
                        pass
                if name == self.container and not skipped:
                    article = max(0, article - 1)
                continue
            if skipped:
                # the article, or the body, is never inside of what comes before it: an element there was left open
                if name in (self.container, "body") and not self.has_article and not self._is_boilerplate(name, attributes, article):
                    skipped.clear()
                elif name not in VOID and not attributes.rstrip().endswith("/"):
                    skipped.append(name)
                    continue
            if self._is_boilerplate(name, attributes, article):
                skipped.append(name)
            elif name == self.container:
                article += 1
                self.has_article = True
        if place < len(html):
            rest = html[place:]
            parts.append(rest)
            if link:
                linked += len(rest)
        close()


def spans(length: list[int], window: int, surge: int) -> list[tuple[int, int]]:
    """(surge point, dive point) of each stretch of lines: first line, line after the last."""
    n = len(length)
    total = np.concatenate([[0], np.cumsum(length)])
    block = total[np.minimum(np.arange(n) + window, n)] - total[:n]
    found, start = [], -1
    for i in range(n):
        if start < 0 and length[i] and block[i] >= surge:
            start = i
        elif start >= 0 and block[i] == 0:
            found.append((start, i))
            start = -1
    if start >= 0:
        end = n
        while end > start and not length[end - 1]:
            end -= 1
        found.append((start, end))
    return found


def main_text(html: str | None, *, window: int = 3, surge: int = 40, share: float = 0.3) -> str:
    if not html:
        return ""
    page = Lines(html)
    if all(page.boiler):  # the words of a class or id may stand on a wrapper of the whole page
        page = Lines(html, marks=False)
    marked = page.has_article and any(i and not b for i, b in zip(page.inside, page.boiler, strict=True))
    kept = [not b and (i or not marked) for i, b in zip(page.inside, page.boiler, strict=True)]
    length = [(len(t) if marked else n) if k else 0 for t, n, k in zip(page.text, page.length, kept, strict=True)]
    found = spans(length, window, 1 if marked else surge) or spans(length, window, 1)
    if not found:
        return ""
    weight = [sum(length[a:b]) for a, b in found]
    first = last = max(range(len(found)), key=weight.__getitem__)
    least = 0 if marked else share * weight[first]
    while first and weight[first - 1] >= least:
        first -= 1
    while last + 1 < len(found) and weight[last + 1] >= least:
        last += 1
    begin, end = found[first][0], found[last][1]
    while begin and length[begin - 1]:  # a heading right before the surge
        begin -= 1
    return "\n".join(t for t, k in zip(page.text[begin:end], kept[begin:end], strict=True) if k)


def extract(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", window: int = 3, surge: int = 40, share: float = 0.3) -> DataFrame:
    """A row per page: all columns of `pages` but the html, and text and n_chars (code points). One pass, no shuffle."""
    kept = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    source = spread(pages.select(*kept, pages[html_col].alias("__html")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                text = [main_text(h.as_py(), window=window, surge=surge, share=share) for h in part.column(len(kept))]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], [*kept, "text", "n_chars"])

    from pyspark.sql import types as T

    schema = T.StructType([*source.select(*kept).schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return source.mapInArrow(run, schema)
