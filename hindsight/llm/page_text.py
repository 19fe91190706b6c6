"""Main text of web pages: streamed parser events, text-to-tag ratios, Gaussian smoothing, threshold clustering.

``html.parser`` reads a page once. Its events fill *lines*, the runs of text between block-level tags, each with
its container, its number of tags and of characters inside links. What stands in elements that are no text
(``IGNORED``), that frame a page (``FRAMING``, a landmark ``role``) or whose class or id names such a part
(``NAMED``) is left out as the events arrive. The text-to-tag ratios of the remaining lines are smoothed with a Gaussian
and split into two clusters at the threshold that is the mean of both clusters' means. The lines of the
upper cluster select the content regions: the ``article`` and ``main`` elements that hold any of them, or, where there
are none, the smallest other element, paragraphs and the like aside, with at least ``HELD`` of their text. All lines of a region are its text, short
ones too, but for lists of nothing but links outside paragraphs and headings.

Character references are decoded, white space inside a line becomes one space, lines are trimmed and
joined in page order by one space.

Odd input: null, empty and textless pages have an empty text of 0 characters; pages that end in the midst of a tag,
script or comment, unclosed and stray tags are read as far as they go; text without any tag is one line. Repeated
pages each have their row; an empty table gives an empty result; columns besides ``page_id``, ``url`` and
``html`` are not read. Characters that have no code point (references to surrogates) become U+FFFD.
"""

import re
from collections import Counter
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Batches, BatchesIn, small

#: Standard deviation of the smoothing, in lines.
SIGMA = 1.5
#: Share of the upper cluster's text that a region outside ``article`` and ``main`` has to hold.
HELD = 0.8
#: Share of characters inside links from which a line is a link.
LINKED = 0.8

# Elements and names of the HTML standard, and customary names of page parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are parts of a text, not regions of a page.
TEXT_PARTS = INLINE | HEADINGS | frozenset(
    "p ul ol li dl dt dd blockquote pre figure figcaption caption details summary address hgroup".split()
)
IGNORED = frozenset(
    "head title script style noscript template svg math canvas iframe object audio video map form select option textarea "
    "button label input fieldset datalist dialog".split()
)
FRAMING = frozenset("nav header footer aside menu".split())
ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split()
)
NAMED = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist "
    "consent cookie cookies copyright disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter "
    "alert notice notices pager pagination paywall popup promo promoted promotion recommended related replies respond "
    "share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar topbar widget".split()
)
#: Names with these words tell of another part's presence (``has-sidebar``), not of being one.
ABOUT_OTHERS = frozenset("has no with without".split())
PAGE = frozenset("html body main".split())
#: A start tag ends an open element of the first kind, unless one of the second is nearer.
CLOSES = {
    "li": (frozenset(["li"]), frozenset("ul ol menu".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset("td th".split()), frozenset("tr table".split())),
    "th": (frozenset("td th".split()), frozenset("tr table".split())),
}
PARAGRAPH = frozenset(["p"])
ARTICLE = frozenset("article main".split())
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


@dataclass(slots=True)
class Element:
    """An open or closed element. ``cause`` tells why its text is left out: empty, ``header`` or ``part``."""

    tag: str
    number: int
    parent: int
    cause: str
    in_article: bool


@dataclass(slots=True)
class Line:
    within: int
    tags: int = 0
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    prose: bool = False
    text: str = ""

    def ratio(self) -> float:
        return len(self.text) / max(self.tags, 1)

    def is_link(self) -> bool:
        return not self.prose and self.linked >= LINKED * sum(map(len, self.parts))


def other_part(attributes: dict[str, str | None]) -> str:
    """Why role, class, id or visibility exclude an element from the text: empty, ``header`` or ``part``."""
    style = (attributes.get("style") or "").lower().replace(" ", "")
    if (
        "hidden" in attributes
        or (attributes.get("aria-hidden") or "").lower() == "true"
        or (attributes.get("role") or "").strip().lower() in ROLES
        or "display:none" in style
        or "visibility:hidden" in style
    ):
        return "part"
    cause = ""
    for name in f"{attributes.get('class') or ''} {attributes.get('id') or ''}".split():
        words = {word.lower() for word in _NAME.findall(name)}
        if words & ABOUT_OTHERS:
            continue
        if words & NAMED - {"header"}:
            return "part"
        if "header" in words:
            cause = "header"
    return cause


class Events(HTMLParser):
    """Turns the parser's events into lines and the elements that hold them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.elements = [Element("", 0, 0, "", False)]
        self.open = [self.elements[0]]
        self.count = Counter()
        self.lines: list[Line] = []
        self.line = Line(0)

    def _end_line(self) -> None:
        line = self.line
        line.text = " ".join("".join(line.parts).split())
        if line.text:
            self.lines.append(line)
        # Tags without text count for the line that follows.
        self.line = Line(self.open[-1].number, 0 if line.text else line.tags)

    def _close_to(self, depth: int) -> None:
        for element in self.open[depth:]:
            self.count[element.tag] -= 1
        del self.open[depth:]
        self.line.within = self.open[-1].number

    def _close_before(self, tag: str) -> None:
        """Closes what the start of ``tag`` ends without an end tag of its own."""
        closed, limits = CLOSES.get(tag, (PARAGRAPH, None))
        if not any(self.count[name] > 0 for name in closed):
            return
        for depth in range(len(self.open) - 1, 0, -1):
            name = self.open[depth].tag
            if name in closed:
                self._close_to(depth)
                return
            if name in limits if limits else name not in INLINE:
                return

    def _cause(self, tag: str, attributes: dict[str, str | None], parent: Element) -> str:
        if parent.cause == "part" or tag in IGNORED:
            return "part"
        if tag in FRAMING:
            own = "header" if tag == "header" else "part"
        else:
            own = "" if tag in PAGE else other_part(attributes)
        if own == "part" or (own and not parent.in_article):
            return "part"
        # Of a header inside the article the headings are text.
        return "" if tag in HEADINGS else own or parent.cause

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        block = tag not in INLINE
        if block:
            self._end_line()
            if tag != "br":
                self._close_before(tag)
        parent = self.open[-1]
        self.line.tags += not parent.cause
        if tag in VOID:
            return
        cause = self._cause(tag, dict(attrs), parent)
        in_article = parent.in_article or (tag in ARTICLE and not cause)
        element = Element(tag, len(self.elements), parent.number, cause, in_article)
        self.elements.append(element)
        self.open.append(element)
        self.count[tag] += 1
        if block:
            self.line.within = element.number

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        # A slash does not close an element of HTML.
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.count[tag] <= 0:
            return
        depth = next(d for d in range(len(self.open) - 1, 0, -1) if self.open[d].tag == tag)
        self.line.tags += not self.open[depth].cause
        if any(element.tag not in INLINE for element in self.open[depth:]):
            self._end_line()
        within = self.line.within
        self._close_to(depth)
        if self.line.parts:
            self.line.within = within

    def handle_data(self, data: str) -> None:
        element = self.open[-1]
        if element.cause:
            return
        line = self.line
        line.parts.append(data)
        line.linked += len(data) * (self.count["a"] > 0)
        line.prose |= self.count["p"] > 0 or any(self.count[name] > 0 for name in HEADINGS)

    def parse_html_declaration(self, i: int) -> int:
        # Marked sections are comments in HTML; the base class knows only some of their keywords.
        if self.rawdata.startswith("<![", i):
            return self.parse_bogus_comment(i)
        return super().parse_html_declaration(i)

    def close(self) -> None:
        # What the page ends in the midst of is no text, as in browsers: a tag, comment or declaration.
        if self.rawdata.startswith("<"):
            self.rawdata = ""
        super().close()
        self._end_line()


def smoothed(ratios: np.ndarray) -> np.ndarray:
    """Gaussian means of the ratios over neighbouring lines; beyond the ends there is nothing to weigh."""
    reach = np.arange(-int(3 * SIGMA), int(3 * SIGMA) + 1)
    kernel = np.exp(-0.5 * (reach / SIGMA) ** 2)
    middle = slice(len(reach) // 2, len(reach) // 2 + len(ratios))
    return np.convolve(ratios, kernel)[middle] / np.convolve(np.ones(len(ratios)), kernel)[middle]


def upper_cluster(values: np.ndarray) -> np.ndarray:
    """Which values lie in the upper of two clusters, parted at the mean of the clusters' means."""
    threshold, before = values.mean(), None
    while threshold != before:
        upper = values >= threshold
        if upper.all():
            break
        before, threshold = threshold, (values[upper].mean() + values[~upper].mean()) / 2
        if not (values >= threshold).any():
            break
    return upper


def content(elements: list[Element], lines: list[Line]) -> list[Line]:
    """The lines of the content regions."""
    if not lines:
        return []
    upper = upper_cluster(smoothed(np.array([line.ratio() for line in lines])))
    weight = [0] * len(elements)
    for line, high in zip(lines, upper, strict=True):
        weight[line.within] += len(line.text) * bool(high)
    # Elements come after those that hold them.
    for element in reversed(elements[1:]):
        weight[element.parent] += weight[element.number]
    regions = set()
    for tag in ("article", "main"):
        regions = regions or {e.number for e in elements if e.tag == tag and not e.cause and weight[e.number]}
    if not regions:
        regions = {max(e.number for e in elements if e.tag not in TEXT_PARTS and weight[e.number] >= HELD * weight[0])}
    inside = [False] * len(elements)
    for element in elements:
        inside[element.number] = element.number in regions or inside[element.parent]
    return [line for line in lines if inside[line.within] and not line.is_link()]


def page_text(html: str) -> str:
    """The main text of a page."""
    events = Events()
    events.feed(html)
    events.close()
    return " ".join(line.text for line in content(events.elements, events.lines))


def _texts(batches: BatchesIn) -> Batches:
    for batch in batches:
        for part in small([batch], 200):
            texts = [page_text(html) if html else "" for html in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    types = {name: pages.schema[name].dataType.simpleString() for name in ("page_id", "url")}
    schema = ", ".join(f"{name} {kind}" for name, kind in types.items())
    return pages.select("page_id", "url", "html").mapInArrow(_texts, f"{schema}, text string, n_chars long")
