"""Main text of web pages from text-to-tag ratios.

The standard library's parser reports a page piece by piece. A line is the text between two block-level tags; its ratio is its characters over
the tags seen since the line before. Text inside menus, forms, notices and the like (by element, role, class or id) and text of links
counts as none. An inline element of that kind (a share count, an icon) is left out of its block and doesn't end it; a link of such a class stays if its block
says more beside such links than in them. The ratios are smoothed by a Gaussian and split into two clusters by a threshold; the lines of the upper cluster
select the region of the page that is its content, and the lines of that region are the text.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from mselect.llm.common import arrow_map

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong "
                   "sub sup time tt u var wbr br".split())
SILENT = frozenset("script style noscript template iframe object svg math canvas audio video head title textarea select option button".split())
WITHIN = SILENT - {"head", "title"}  # these end no block
AROUND = frozenset("nav footer aside form menu dialog fieldset".split())
DROPPED, LINK = "dropped", "link"
ROOTS = frozenset("article main".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "footer masthead cookie cookies consent gdpr notice notices popup modal overlay comment comments disqus reply replies respond share sharing "
    "social related recommended newsletter subscribe signup login widget toolbar pagination pager search copyright disclaimer alert hidden".split())
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_UNFINISHED = re.compile(r"<[a-zA-Z/!?]")
_NAME = re.compile(r"[^a-z0-9]+")


class Element(NamedTuple):
    tag: str
    around: bool  # whether blocks in it are around the content
    root: int  # number of the article or main element it is in, 0 for none
    inline: str = ""  # of an inline element: DROPPED or LINK


class Lines(HTMLParser):
    """Collects (text, characters that count, tags, root) of each line; a root is an article or main element, 0 for none."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int]] = []
        self.open: list[Element] = []  # blocks, and inline elements that change what becomes of their text
        self.parts: list[str | None] = []  # None for a piece of ``named``
        self.named: list[str] = []  # texts of links that look like no content
        self.tags = self.linked = self.links = self.roots = self.ended = 0  # ended: roots, after which one in a block of comments is a comment
        self.around = False  # of the innermost block

    def _line(self) -> None:
        plain = sum(len(p.strip()) for p in self.parts if p is not None)
        if plain > sum(len(p.strip()) for p in self.named):
            named = iter(self.named)
            self.parts = [next(named) if p is None else p for p in self.parts]
            self.linked += sum(len(p.strip()) for p in self.named)
        text = " ".join("".join(p or "" for p in self.parts).split())
        if text:
            counted = -1 if self.around else max(0, len(text) - self.linked)
            self.lines.append((text, counted, self.tags, self.open[-1].root if self.open else 0))
            self.tags = 0
        self.parts, self.named, self.linked = [], [], 0

    def _hidden(self, attrs: list[tuple[str, str | None]]) -> bool:
        a = {k: v or "" for k, v in attrs if k in ("style", "hidden", "aria-hidden")}
        return bool(a) and ("hidden" in a or a.get("aria-hidden") == "true" or bool(_HIDDEN.search(a.get("style", ""))))

    def _around(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in AROUND or tag in SILENT:
            return True
        if tag == "header" and not (self.open and self.open[-1].root):
            return True
        if not attrs or tag in ("html", "body") or (tag in ROOTS and not self.ended):
            return False
        a = {k: v or "" for k, v in attrs if k in ("class", "id", "role")}
        return (self._hidden(attrs) or a.get("role", "").lower() in ROLES
                or not NAMES.isdisjoint(_NAME.split(f"{a.get('class', '')} {a.get('id', '')}".lower())))

    def _silent(self) -> bool:
        """Whether this is inside an element of which nothing is shown."""
        for e in reversed(self.open):
            if e.tag in SILENT or not e.inline:
                return e.tag in SILENT
        return False

    def _state(self) -> None:
        self.around = next((e.around for e in reversed(self.open) if not e.inline), False)

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        above = self.open[-1] if self.open else Element("", False, 0)
        if tag == "a":
            self.links = 1  # links don't nest
            if above.inline:
                self._close(tag)
                above = self.open[-1] if self.open else Element("", False, 0)
        if above.inline == DROPPED and tag not in VOID and tag not in ROOTS and (tag in INLINE or self._silent()):
            self.open.append(Element(tag, True, above.root, DROPPED))
            return
        if tag not in INLINE and tag not in WITHIN:
            self._line()
            if tag == "p" or tag == "li":
                self._close(tag, ("div", "ul", "ol", "article", "section", "main", "table"))
        if tag in VOID:
            return
        around = self._around(tag, attrs)
        if tag in INLINE or tag in WITHIN:
            if above.inline or (around and not above.around):
                link = tag == "a" and not self._hidden(attrs) if around else above.inline == LINK
                self.open.append(Element(tag, True, above.root, LINK if link and above.inline != DROPPED else DROPPED))
            elif tag in WITHIN:
                self.open.append(Element(tag, True, above.root, DROPPED))
            return  # other such elements are often left open, and they change nothing
        root = above.root
        if tag in ROOTS:
            self.roots += 1
            root = self.roots
            if not self.ended and not any(e.tag in AROUND for e in self.open):  # the first ends what was left open before it
                self.open = [e for e in self.open if not e.around]
        self.open.append(Element(tag, around or (bool(self.open) and self.open[-1].around), root))
        self._state()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _close(self, tag: str, walls: tuple[str, ...] = ()) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            e = self.open[i]
            if e.tag == tag:
                blocks = any(not x.inline for x in self.open[i:])
                self.ended += tag in ROOTS
                if blocks:
                    self._line()
                del self.open[i:]
                if blocks:
                    self._state()
                return
            if e.tag in walls or (tag in INLINE and not e.inline):  # the end of an inline element ends no block
                return

    def handle_endtag(self, tag):
        self.tags += 1
        if tag == "a":
            self.links = 0
        if tag not in INLINE and tag not in WITHIN and not (self.open and self.open[-1].tag == tag and self.open[-1].inline):
            self._line()
        self._close(tag)

    def handle_data(self, data):
        kind = self.open[-1].inline if self.open else ""
        if kind == DROPPED or (self.open and self.open[-1].tag in SILENT):
            return
        if kind == LINK:
            self.parts.append(None)
            self.named.append(data)
            return
        self.parts.append(data)
        if self.links:
            self.linked += len(data.strip())


def smoothed(values: list[float], sigma: float) -> list[float]:
    """Values averaged with their neighbours, weighted by a Gaussian that is cut at three sigma and at the ends."""
    reach = max(1, math.ceil(3 * sigma))
    weights = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        low, high = max(0, i - reach), min(len(values), i + reach + 1)
        w = weights[low - i + reach: high - i + reach]
        out.append(sum(a * b for a, b in zip(w, values[low:high])) / sum(w))
    return out


def threshold(values: list[float]) -> float:
    """The border of two clusters: halfway between their means, from means at the ends."""
    low, high = min(values), max(values)
    for _ in range(50):
        border = (low + high) / 2
        upper = [v for v in values if v >= border]
        lower = [v for v in values if v < border]
        if not lower:
            return high
        means = sum(lower) / len(lower), sum(upper) / len(upper)
        if means == (low, high):
            break
        low, high = means
    return (low + high) / 2


def main_text(html: str | None, sigma: float = 1.0, feed: int = 65_536) -> str:
    """The main text of one page: its lines, joined by newlines; empty if there are none."""
    parser = Lines()
    for i in range(0, len(html or ""), feed):
        parser.feed(html[i: i + feed])
    if _UNFINISHED.match(parser.rawdata):  # a tag or comment that the page breaks off in
        parser.rawdata = ""
    parser.close()
    parser._line()
    lines = parser.lines
    inside = [i for i, line in enumerate(lines) if line[1] >= 0]
    if not inside:
        return ""
    # logarithms, so that one very long line doesn't make all others look empty
    ratios = [math.log1p(max(0, counted) / max(1, tags)) for _, counted, tags, _ in lines]
    smooth = smoothed(ratios, sigma)
    border = threshold(smooth)
    chosen = [i for i in inside if smooth[i] >= border and lines[i][1] > 0] or [max(inside, key=lambda i: smooth[i])]
    mass: dict[int, float] = {}
    for i in chosen:
        mass[lines[i][3]] = mass.get(lines[i][3], 0) + max(0, lines[i][1])
    root = max(mass, key=mass.get)
    if root:  # the element that holds most of the chosen text is the region
        return "\n".join(lines[i][0] for i in inside if lines[i][3] == root)
    first, last = chosen[0], chosen[-1]
    while first - 1 in inside and lines[first - 1][1] > 0 and lines[first - 1][3] == 0:  # headings before it
        first -= 1
    return "\n".join(lines[i][0] for i in inside if first <= i <= last and lines[i][1] > 0)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every row; a null page is empty and an empty page has an empty text.

    Keys and addresses may be null or repeated, and other columns aren't read.
    """
    def run(batch: pa.RecordBatch) -> dict:
        texts = [main_text(cell.as_py()) for cell in batch.column(2)]
        return {key: batch.column(0), "url": batch.column(1), "text": pa.array(texts, pa.string()),
                "n_chars": pa.array([len(t) for t in texts], pa.int64())}
    kind = pages.schema[key].dataType.simpleString()
    return arrow_map(pages.select(key, pages[url].cast("string").alias("url"), html), run,
                     f"{key} {kind}, url string, text string, n_chars long")
