"""Main text of web pages by text-to-tag ratio.

The standard library's parser streams events; each block of text is a line with its ratio of text
to tags, where linked text counts for nothing but in headings. The ratios are smoothed by a Gaussian, and those at a
share of the page's usual one or above are dense. Runs of dense lines, with short gaps, are clusters;
the heavy ones are the content, each together with the rest of the container that it lies in.

Names only weigh: in containers that are by their element or class often no article, a line's ratio
counts for a fraction of itself, so that a notice of a sentence falls below the threshold and a
paragraph of the article, whatever its class is called, does not. Such lines are smoothed among
themselves, or the text around a notice would lift it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.runtime import bound_arrow_batches

# HTML element names by their part in a page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
SILENT = set("script style noscript template head title iframe object svg math audio video canvas select option textarea button datalist".split())
REGION = set("article main section div td body html blockquote center form".split())
CLOSED_BY = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody"}, "th": {"td", "th", "tr", "tbody"}, "option": {"option"}}
#: Elements, words and beginnings of words in a class or id, and roles, of what is often no article.
ELEMENTS = set("footer aside form dialog menu search fieldset".split())
NAMES = set(
    "ad ads adsense alert alerts banner banners consent gdpr masthead menu menus modal nav navigation notice notices notification notifications outbrain overlay paywall recommended related replies share sharing signup skip social subscribe subscription taboola teaser teasers toolbar widget widgets".split()
)
BEGIN = tuple("advert breadcrumb cookie footer navbar newsletter popup promo sidebar sponsor".split())
TALK = set("comment comments commentlist disqus respond".split())
OUTSIDE = set("header topbar".split())
ROLES = set("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search".split())
#: Words that name an article; beside one of them the words above say nothing.
ARTICLE = set("article body content entry main post story text".split())

#: Weights: of lines without such names, of menus, of lines in such classes within an article, of those in
#: others, and of those in such elements.
PLAIN, IN_MENU, IN_ARTICLE, WEAK, ELEMENT = 1.0, 0.3, 0.25, 0.02, 0.002
#: Width of the Gaussian, in lines, and how far it reaches; thin lines that a cluster bridges.
SIGMA, RADIUS, GAP = 1.0, 3, 3
#: Share of the usual ratio that makes a line dense, and of the heaviest cluster that makes a cluster heavy.
DENSE, HEAVY = 0.2, 0.3

_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_KERNEL = [math.exp(-(d * d) / (2 * SIGMA * SIGMA)) for d in range(RADIUS + 1)]


class Line:
    __slots__ = ("linked", "region", "tags", "text", "weight")

    def __init__(self, text: str, linked: int, tags: int, weight: float, region: int):
        self.text, self.linked, self.tags, self.weight, self.region = text, linked, tags, weight, region

    def ratio(self) -> float:
        return max(0, len(self.text) - self.linked) / max(1, self.tags)

    def is_link(self) -> bool:
        return 2 * self.linked > len(self.text)


class _Lines(HTMLParser):
    """Collects the lines of a page and the tree of its regions, in one pass."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, float]] = []  # open elements and the weight of their text
        self.open: Counter[str] = Counter()
        self.named: Counter[str] = Counter()  # open elements that lower the weight, by name
        self.silent = self.headings = 0
        self.regions = [0]
        self.parent, self.begin, self.end = [-1], [0], [0]  # of each region: parent, first line, line after the last
        self.kind = [""]
        self.parts: dict[float, tuple[list[str], list[int]]] = {}  # text so far by weight, and how much of it is linked
        self.tags = 0
        self.lines: list[Line] = []

    def _end_line(self) -> None:
        some = False
        for weight, (own, linked) in self.parts.items():
            if text := " ".join("".join(own).split()):
                self.lines.append(Line(text, sum(linked), self.tags, weight, self.regions[-1]))
                some = True
        self.parts = {}
        if some:
            self.tags = 0

    def _weight(self, tag: str, attrs: list[tuple[str, str | None]]) -> float:
        if tag in ("html", "body", "main"):
            return PLAIN
        inside = self.open["article"] or self.open["main"]
        found = IN_MENU if tag == "nav" else ELEMENT if tag in ELEMENTS or tag == "header" and not inside else PLAIN
        for name, value in attrs:
            if name in ("class", "id") and value:
                words = set(_WORD.findall(_CAMEL.sub("-", value).lower()))
                if words & ARTICLE:
                    continue
                if words & TALK:
                    found = min(found, WEAK)
                elif words & NAMES or any(w.startswith(BEGIN) for w in words) or not inside and words & OUTSIDE:
                    found = min(found, IN_ARTICLE if inside else WEAK)
            elif name == "role" and (value or "").lower() in ROLES:
                found = min(found, WEAK)
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and _HIDDEN.search(value):
                return 0.0
        return found

    def _push(self, tag: str, weight: float) -> None:
        above = self.stack[-1][1] if self.stack else PLAIN
        self.stack.append((tag, min(above, weight)))
        self.open[tag] += 1
        self.silent += tag in SILENT
        self.headings += tag in HEADINGS
        if weight < PLAIN:
            self.named[tag] += 1
        if tag in REGION:
            self.parent.append(self.regions[-1])
            self.regions.append(len(self.begin))
            self.kind.append(tag)
            self.begin.append(len(self.lines))
            self.end.append(len(self.lines))

    def _pop(self) -> None:
        tag, weight = self.stack.pop()
        self.open[tag] -= 1
        self.silent -= tag in SILENT
        self.headings -= tag in HEADINGS
        if self.named[tag] and weight < PLAIN:
            self.named[tag] -= 1
        if tag in REGION:
            self.end[self.regions.pop()] = len(self.lines)

    def _close(self, tag: str, until: set[str]) -> None:
        if not self.open[tag]:
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                while len(self.stack) > i:
                    self._pop()
                return
            if self.stack[i][0] in until:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in BLOCK:
            self._end_line()
        elif tag in ("br", "img") or tag in SILENT:
            self.handle_data(" ")
        if tag in VOID:
            return
        for closed, by in CLOSED_BY.items():
            if tag in by:
                self._close(closed, until=BLOCK - {closed})
        # never in these: one of them was left open, or a form holds the whole page
        holders = {"main": ("nav", "header", "footer", "aside", "form"), "article": ("form",)}.get(tag)
        while holders and self.stack and self.stack[-1][1] < PLAIN and sum(self.named.values()) == sum(self.named[n] for n in holders) > 0:
            self._pop()
        self._push(tag, self._weight(tag, attrs))

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCK:
            self._end_line()
        if tag not in VOID:
            self._close(tag, until=set() if tag in BLOCK or tag in SILENT else BLOCK)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_data(self, data: str) -> None:
        weight = self.stack[-1][1] if self.stack else PLAIN
        if self.silent or not weight:
            return
        own, linked = self.parts.setdefault(weight, ([], []))
        own.append(data)
        if self.open["a"] and not self.headings:
            linked.append(len(data.strip()))

    def close(self) -> None:
        super().close()
        self._end_line()
        while self.stack:
            self._pop()
        self.end[0] = len(self.lines)


def smoothed(lines: list[Line]) -> list[float]:
    """The lines' ratios under a Gaussian over the lines of the same weight, times their weights.

    A line of links alone, with ratio 0, isn't lifted by the text next to it: a menu ends where an article begins.
    """
    ratio = [line.ratio() for line in lines]
    out = []
    for i, line in enumerate(lines):
        total = share = 0.0
        if not ratio[i]:
            out.append(0.0)
            continue
        for j in range(max(0, i - RADIUS), min(len(lines), i + RADIUS + 1)):
            if lines[j].weight == line.weight:
                k = _KERNEL[abs(i - j)]
                total += k * ratio[j]
                share += k
        out.append(line.weight * total / share)
    return out


def clusters(lines: list[Line], dense: list[bool]) -> list[tuple[int, int, int]]:
    """Runs of dense lines that at most GAP thin ones divide: first line, line after the last, dense characters."""
    out: list[tuple[int, int, int]] = []
    for i, line in enumerate(lines):
        if dense[i]:
            begin, mass = i, 0
            if out and i - out[-1][1] <= GAP:
                begin, _, mass = out.pop()
            out.append((begin, i + 1, mass + len(line.text)))
    return out


def _container(parser: _Lines, a: int, b: int) -> int:
    """The innermost region around two lines: region numbers grow inwards."""
    while a != b:
        if a > b:
            a = parser.parent[a]
        else:
            b = parser.parent[b]
    return a


def main_text(html: str) -> str:
    """The article's blocks, one to a line; empty if the page has none."""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    lines = parser.lines
    plain = [i for i, line in enumerate(lines) if line.weight == PLAIN]
    density = smoothed(lines)
    size = sum(len(lines[i].text) for i in plain)
    if not size:
        return ""
    threshold = DENSE * sum(len(lines[i].text) * density[i] for i in plain) / size
    dense = [d >= threshold for d in density]
    found = clusters(lines, dense)
    heaviest = max((mass for _, _, mass in found), default=0)
    keep: list[int] = []
    for begin, end, mass in found:
        if mass < HEAVY * heaviest:
            continue
        region = _container(parser, lines[begin].region, lines[end - 1].region)
        if parser.kind[region] not in ("", "html", "body"):
            begin, end = min(begin, parser.begin[region]), max(end, parser.end[region])
        begin = max(begin, keep[-1] + 1 if keep else 0)
        keep += range(begin, max(begin, end))
    # among them, thin lines stay unless they are links or are named for what is no article
    return "\n".join(lines[i].text for i in keep if dense[i] or lines[i].weight == PLAIN and not lines[i].is_link())


def extract_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page, from its whole html.

    A null or empty page has an empty text; null ids and urls stay; repeated rows give a row each; an
    empty table gives no rows; other columns are ignored.
    """
    bound_arrow_batches(pages.sparkSession)
    narrow = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            arrays = [batch.column(0), batch.column(1), pa.array(texts, type=pa.string()), pa.array([len(t) for t in texts], type=pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "text", "n_chars"])

    return narrow.mapInArrow(run, "page_id long, url string, text string, n_chars long")
