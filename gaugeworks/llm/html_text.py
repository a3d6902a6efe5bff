"""Main text of web pages by text-to-tag ratio.

The standard library's parser streams events into lines, one per block element. A line's ratio is its
characters over its tags, weighed by what the markup says of it: lines inside ``article`` or ``main`` count
more and the others of such a page less. The logarithms of the ratios are smoothed with a Gaussian, so a
short paragraph between long ones counts as its neighbours do, and two clusters of them give the
threshold. Lines above it form the content regions; where the clusters are not clearly apart, all lines
are one region. The smallest element that holds all regions is the main text. It stays whole, whether its
paragraphs stand in it or in elements of their own, but for groups of links at its edges whose ratio lies
with the lower cluster. What the markup itself names as menu, header, footer, sidebar, notice, advert,
form or comment never counts, unless only its class says so and it holds most of the page's text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_chunks

# Elements by their part in a page.
SILENT = frozenset("script style noscript template svg math iframe canvas head title select option button textarea audio video map".split())
APART = frozenset("nav footer aside dialog menu".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CONTAINERS = frozenset("div section td body blockquote details".split())
GROUPS = frozenset("article main ul ol dl table figure".split())
HEADINGS = frozenset(("h1", "h2", "h3"))
# Whole class and id words that name something else than content, plain or behind a word of place.
HINT = re.compile(
    r"(?:(?:site|top|bottom|left|right|main|global|primary|secondary|mobile)[-_])?"
    r"(?:ads?|ad[-_].+|advert\w*|banner\w*|bread-?crumbs?|comments?(?:[-_].+)?|consent|cookies?(?:[-_].+)?|disqus\w*|disclaimer|footer|header|"
    r"masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|overlay|pager|pagination|popup|promo\w*|related|replies|respond|share|sharing|"
    r"side-?bar|social|sponsor\w*|subscribe|toolbar|widget)"
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())

SIGMA = 1.5
MAIN = 16.0  # how much more a line in ``article`` or ``main`` counts, and how much less another one of the same page
APART_BY = np.log(3)  # text and the rest differ by this factor in their mean ratio, or the lines are all of one kind
EDGE = 0.25  # a group of links at an edge goes if its ratio lies in the lowest part between the clusters
CHUNK = 65_536


class Line(NamedTuple):
    text: str
    tags: int
    links: int  # characters inside links
    element: int  # innermost element that holds the line
    main: bool
    named: int  # innermost element around it that its class names as something else, 0 for none
    aside: bool  # named so by its tag or role
    heading: bool


class Element(NamedTuple):
    tag: str
    number: int
    aside: bool
    main: bool
    named: int


class Lines(HTMLParser):
    """Parser events as lines."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.stack = [Element("", 0, False, False, 0)]
        self.above: dict[int, int] = {}  # the named element around each named element
        self.inner: set[int] = set()
        self.outer = [0]  # the element around each element of a kind that holds lines
        self.text: list[str] = []
        self.tags = self.links = self.link = 0
        self.silent = 0

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            top = self.stack[-1]
            self.lines.append(Line(text, self.tags, self.links, top.number, top.main, top.named, top.aside, any(e.tag in HEADINGS for e in self.stack[-4:])))
        self.text, self.tags, self.links = [], 0, 0

    def _close(self, tags: set[str] | frozenset[str], stop: frozenset[str]) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in tags:
                self.flush()
                gone = self.stack[i:]
                self.silent -= sum(e.tag in SILENT for e in gone)
                self.link -= sum(e.tag == "a" for e in gone)
                del self.stack[i:]
                return
            if self.stack[i].tag in stop:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            if tag != "html":  # a head or a list of options that is left open ends where a block begins
                self._close({"head", "select"}, BLOCKS - {"html"})
            self._close({"p"}, CONTAINERS | {"article", "main", "li", "td", "th"})
            self.flush()
        if tag in CLOSES:
            self._close(CLOSES[tag], frozenset(("ul", "ol", "dl", "table", "select")))
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        _, number, aside, main, named = self.stack[-1]
        aside = aside or tag in APART or (tag == "header" and not main)
        hint = tag == "form"
        if tag not in ("html", "body", "article", "main"):
            for name, value in attrs:
                if name in ("class", "id") and value:
                    hint = hint or any(map(HINT.fullmatch, value.lower().split()))
                elif (name == "role" and value in ROLES) or name == "hidden" or (name == "aria-hidden" and value == "true"):
                    aside = True
        if hint or tag in CONTAINERS or tag in GROUPS:
            self.outer.append(number)
            number = len(self.outer) - 1
            if hint:
                self.above[number] = named
                named = number
            if hint and main:
                self.inner.add(number)
        self.silent += tag in SILENT
        self.link += tag == "a"
        self.stack.append(Element(tag, number, aside, main or tag in ("article", "main"), named))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        if tag not in VOID:
            self._close({tag}, frozenset() if tag in BLOCKS else BLOCKS)

    def close(self) -> None:
        if self.rawdata.startswith("<!--"):  # a comment that never ends takes the rest of the page
            self.rawdata = ""
        super().close()

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.text.append(data)
            if self.link:
                self.links += len(data.strip())


def countable(lines: list[Line], above: dict[int, int], inner: set[int]) -> list[Line]:
    """The lines that the markup doesn't name as something else; ``inner`` are named elements inside an article."""
    lines = [x for x in lines if not x.aside]
    held, mains = Counter(), Counter()
    for x in lines:
        held[x.named] += len(x.text)
        mains[x.named] += x.main
    for e in sorted(above, reverse=True):  # what an element holds counts for those around it, which have smaller numbers
        held[above[e]] += held[e]
        mains[above[e]] += mains[e]
    # A class word of an element around the article, or that holds most of the text, doesn't name it.
    good = {0: True}
    for e in sorted(above):
        around = mains[e] == mains[0]
        good[e] = good[above[e]] and around and (2 * held[e] > held[0] or (mains[e] > 0 and e not in inner))
    return [x for x in lines if good[x.named]]


def scores(lines: list[Line]) -> np.ndarray:
    """The logarithm of each line's weighed ratio."""
    has_main = any(x.main for x in lines)
    return np.log1p([len(x.text) / max(1, x.tags) * (MAIN if x.main else 1 / MAIN if has_main else 1) for x in lines])


def smoothed(values: np.ndarray) -> np.ndarray:
    reach = np.arange(-4, 5)
    kernel = np.exp(-0.5 * (reach / SIGMA) ** 2)
    return np.convolve(np.pad(values, 4, mode="edge"), kernel / kernel.sum(), mode="valid")


def clusters(values: np.ndarray) -> tuple[float, float]:
    """The means of two clusters on a line."""
    low, high = values.min(), values.max()
    for _ in range(20):
        middle = (low + high) / 2
        below, above = values[values < middle], values[values >= middle]
        if not len(below):
            break
        low, high = below.mean(), above.mean()
    return float(low), float(high)


def smallest(elements: list[int], lines: list[Line], outer: list[int]) -> int:
    """The smallest element that holds all of ``elements``, or, where that is a single line, the next one that holds more."""
    common, seen = elements[0], {elements[0]}
    for other in elements[1:]:
        while common != other:
            if other < common:  # an element has a larger number than those around it
                common = outer[common]
            elif other in seen:  # already below the common one
                break
            else:
                seen.add(other)
                other = outer[other]
    held = [0] * len(outer)
    for x in lines:
        held[x.element] += 1
    for e in range(len(outer) - 1, 0, -1):
        held[outer[e]] += held[e]
    while common and held[common] == 1:
        common = outer[common]
    return common


def content_lines(html: str) -> list[str]:
    """The blocks of the main text in page order."""
    parser = Lines()
    for i in range(0, len(html), CHUNK):
        parser.feed(html[i : i + CHUNK])
    parser.close()
    parser.flush()
    lines = countable(parser.lines, parser.above, parser.inner)
    if not lines:
        return []
    score = scores(lines)
    smooth = smoothed(score)
    low, high = clusters(smooth)
    if high - low < APART_BY:
        return [x.text for x in lines]
    middle = (low + high) / 2  # what only borders on text does not vote
    chosen = np.flatnonzero((smooth >= middle) & (score >= middle))
    if not len(chosen):
        return [x.text for x in lines]
    common = smallest([lines[i].element for i in chosen], lines, parser.outer)
    # The child of the common element around each element inside it: itself for its own lines, none outside.
    child: list[int | None] = [None] * len(parser.outer)
    child[common] = common
    for e in range(common + 1, len(child)):
        child[e] = e if parser.outer[e] == common else child[parser.outer[e]]
    groups: list[tuple[int, list[int]]] = []
    for i, x in enumerate(lines):
        at = child[x.element]
        if at is not None and groups and at != common and groups[-1][0] == at:
            groups[-1][1].append(i)
        elif at is not None:
            groups.append((at, [i]))
    least = low + EDGE * (high - low)

    def of_links(group: tuple[int, list[int]]) -> bool:
        some = [lines[i] for i in group[1]]
        size = sum(len(x.text) for x in some)
        return group[0] != common and 2 * sum(x.links for x in some) > size and score[group[1]].mean() < least

    while groups and of_links(groups[0]):
        groups.pop(0)
    while groups and of_links(groups[-1]):
        groups.pop()
    kept = [i for _, group in groups for i in group]
    # Headings right before the element, in the one around it, are those of its text.
    place = {id(x): k for k, x in enumerate(parser.lines)}
    while kept and (k := place[id(lines[kept[0]])]) and kept[0] and parser.lines[k - 1] is (x := lines[kept[0] - 1]) and x.heading and x.element == parser.outer[common]:
        kept.insert(0, kept[0] - 1)
    return [lines[i].text for i in kept]


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every whole page: ``id_col, url_col, text, n_chars``.

    Character references are decoded, white space inside a block is one space, and blocks are joined by
    an empty line. A null or empty page, or one without content, has the empty text. One row per input
    row, so repeated rows repeat and an empty table gives an empty one; a page of any length is read
    whole, CHUNK characters at a time; other columns are ignored; a narrow map without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, pages in text_chunks(batch.column(2)):
                texts = ["\n\n".join(content_lines(h)) for h in pages]
                columns = [batch.column(0).slice(start, len(texts)), batch.column(1).slice(start, len(texts)), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "url", "text", "n_chars"])

    rows = df.select(df[id_col].alias("id"), df[url_col].alias("url"), df[html_col].alias("html"))
    kinds = [rows.schema[c].dataType.simpleString() for c in ("id", "url")]
    return rows.mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
