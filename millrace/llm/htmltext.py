"""Main text of web pages: text-to-tag ratio of lines, smoothed and clustered.

The events of the standard library's streaming parser cut a page into lines, one per block, and count
the tags met in each. Characters per tag is the ratio of a line. Ratios are smoothed with a Gaussian
kernel, and lines at or above the threshold (a share of their mean) form clusters. The clusters choose the content
region: the smallest block that holds most of their characters, widened to the ``article`` or ``main`` around
it; of several articles side by side each counts. Every line of the region stays, short ones too, unless a
block inside the region is boilerplate (menus, headers, footers, sidebars, notices, adverts, forms, reader
comments); marks outside the region or on the blocks around it do not matter. Hidden elements have no text and do
not divide a line. Where the region is the whole page, lines outside the clusters stay if they stand in the page itself.

Defined results: NULL, empty or tag-only pages give an empty text. Unclosed tags end with the block that
holds them or with the page, and end tags without a beginning are ignored. Character references are decoded, white
space in a line becomes one space, empty lines vanish. Repeated pages give the same text. Pages are worked on
one by one, whole, in time that grows with their length.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Names of elements.
HIDDEN = frozenset("script style noscript template head svg math iframe object canvas audio video select button textarea datalist".split())
BOILERPLATE = frozenset("nav footer aside form dialog menu".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td "
    "tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXT_BLOCKS = HEADINGS | frozenset("p pre blockquote address".split())
CONTENT = frozenset(("article", "main"))
CLOSED_BY = {"p": BLOCKS, "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr",)), "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr")), "option": frozenset(("option",))}
#: Names of boilerplate blocks in ``class`` and ``id``, and words that may stand before or behind such a name.
NAMES = frozenset(
    "ad ads advert adverts advertisement adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar side-bar footer masthead cookie cookies consent gdpr notice popup modal newsletter subscribe share sharing social related "
    "recommended comment comments disqus replies pagination pager login signup search toolbar topbar widget".split()
)
AROUND = frozenset(
    "site page global main primary secondary top bottom left right sticky mobile desktop post entry article blog user reader header footer "
    "cookie cookies social share nav menu".split()
)
BEHIND = frozenset(
    "bar box area block section list links link buttons button icons wrapper container holder inner panel widget unit slot overlay banner notice "
    "form menu nav posts articles stories items content top bottom left right header footer consent signup message popup".split()
)
WHOLE_NAMES = frozenset("site-header page-header site-nav skip-link skip-to-content".split())
# End of the fixed values.

ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
NO_DISPLAY = re.compile(r"display\s*:\s*none", re.IGNORECASE)
SPACES = re.compile(r"\s+")
THRESHOLD_SHARE = 0.5
SIGMA = 1.0
#: The region holds at least this share of the clusters' characters; a block around it with at most so much more text is taken whole.
REGION_SHARE, WIDER_SHARE = 0.75, 0.3
#: Lines between a heading and the region below it.
BYLINES = 5


def names_boilerplate(token: str) -> bool:
    """Whether one word of a class or id is the name of boilerplate, alone or with a usual word at one side."""
    token = token.lower().replace("_", "-")
    if token in NAMES or token in WHOLE_NAMES:
        return True
    before, _, last = token.rpartition("-")
    first, _, behind = token.partition("-")
    return (last in NAMES and before in AROUND) or (first in NAMES and behind in BEHIND)


class _Line:
    __slots__ = ("text", "tags", "where", "heading")

    def __init__(self, where: int, heading: bool):
        self.text: list[str] = []
        self.tags = 0
        self.where = where
        self.heading = heading


class _Lines(HTMLParser):
    """Parser events into lines and blocks. Blocks are numbered as they open, so the inside of one is a range."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool]] = []  # tag, innermost block, hidden
        self.count: dict[str, int] = {}  # open elements of each name
        self.tags = [""]  # of each block; 0 is the page
        self.parent = [0]
        self.last = [0]  # the last block inside each
        self.marked = [0]  # the innermost boilerplate block around each, itself included
        self.lines: list[_Line] = []
        self.line = _Line(0, False)

    def state(self) -> tuple[int, bool]:
        return self.open[-1][1:] if self.open else (0, False)

    def end_line(self) -> None:
        if self.line.text or self.line.tags:
            self.lines.append(self.line)
        self.line = _Line(self.state()[0], any(t in HEADINGS for t, *_ in self.open[-3:]))

    def cut(self, size: int) -> None:
        """Close all elements from the given depth on."""
        for tag, block, _ in self.open[size:]:
            self.count[tag] -= 1
            self.last[block] = len(self.tags) - 1
        del self.open[size:]

    def in_content(self) -> bool:
        return bool(self.count.get("article") or self.count.get("main"))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            if tag == "br":
                self.line.text.append(" ")
            elif tag == "hr" and not self.state()[1]:
                self.end_line()
            self.line.tags += 1
            return
        if not self.state()[1]:  # nothing in a hidden element ends what is around it
            if self.open and tag in CLOSED_BY.get(self.open[-1][0], ()):
                self.cut(len(self.open) - 1)
            else:
                self.close_implied(tag)
        block, hidden = self.state()
        unseen = self.is_unseen(attrs)
        boilerplate = tag in BOILERPLATE or (tag == "header" and not self.in_content()) or self.is_boilerplate(tag, attrs)
        hidden = hidden or tag in HIDDEN or unseen or (boilerplate and tag not in BLOCKS)
        if tag in BLOCKS and not hidden:
            self.tags.append(tag)
            self.parent.append(block)
            self.marked.append(len(self.tags) - 1 if boilerplate else self.marked[block])
            block = len(self.tags) - 1
            self.last.append(block)
        self.open.append((tag, block, hidden))
        self.count[tag] = self.count.get(tag, 0) + 1
        if tag in BLOCKS and not hidden:
            self.end_line()
        self.line.tags += 1

    def close_implied(self, tag: str) -> None:
        """A block inside an open paragraph ends it, also when inline tags were left open in it."""
        if tag not in BLOCKS:
            return
        for i in range(len(self.open) - 1, max(-1, len(self.open) - 12), -1):
            name = self.open[i][0]
            if name == "p" or (name == tag == "li"):
                self.cut(i)
                return
            if name in BLOCKS:
                return

    @staticmethod
    def is_unseen(attrs: list[tuple[str, str | None]]) -> bool:
        return any(n == "hidden" or (n == "aria-hidden" and v == "true") or (n == "style" and v and NO_DISPLAY.search(v)) for n, v in attrs)

    @staticmethod
    def is_boilerplate(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in CONTENT or tag in ("html", "body"):
            return False
        for name, value in attrs:
            if value and name in ("class", "id") and any(names_boilerplate(token) for token in value.split()):
                return True
            if value and name == "role" and value.lower() in ROLES:
                return True
        return False

    def handle_endtag(self, tag: str) -> None:
        if not self.count.get(tag):
            self.line.tags += 1
            return
        hidden = self.state()[1]
        i = len(self.open) - 1
        while self.open[i][0] != tag:
            i -= 1
        self.cut(i)
        if tag in BLOCKS and not hidden:
            self.end_line()
        self.line.tags += 1

    def handle_data(self, data: str) -> None:
        if not self.state()[1]:
            self.line.text.append(data)

    def finish(self) -> None:
        self.cut(0)
        self.last[0] = len(self.tags) - 1
        self.end_line()


def smoothed(values: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing with a kernel of three sigmas, renormalised at the ends."""
    reach = max(1, int(math.ceil(3 * sigma)))
    kernel = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for k, share in enumerate(kernel, start=i - reach):
            if 0 <= k < len(values):
                total += share * values[k]
                weight += share
        out.append(total / weight)
    return out


def main_text(page: str | None, threshold_share: float = THRESHOLD_SHARE, sigma: float = SIGMA) -> str:
    """The content region of one page as text, one line per block."""
    if not page:
        return ""
    parser = _Lines()
    parser.feed(page)
    parser.close()
    parser.finish()
    lines = [(text, x) for text, x in ((SPACES.sub(" ", "".join(x.text)).strip(), x) for x in parser.lines) if text]
    plain = [i for i, (_, x) in enumerate(lines) if not parser.marked[x.where]]
    if not plain:
        plain = list(range(len(lines))) if any(t in CONTENT for t in parser.tags) else []
    if not plain:
        return ""
    ratios = smoothed([len(lines[i][0]) / max(1, lines[i][1].tags) for i in plain], sigma)
    threshold = threshold_share * sum(ratios) / len(ratios)
    clustered = [i for i, ratio in zip(plain, ratios) if ratio >= threshold]
    regions = _regions(parser, [(lines[i][1].where, len(lines[i][0])) for i in plain], [(lines[i][1].where, len(lines[i][0])) for i in clustered])
    if regions == [_page_block(parser)]:
        kept = _page_lines(parser, lines, plain, clustered, regions[0])
    else:
        kept = [i for i, (_, x) in enumerate(lines) if any(_stays(parser, x.where, r) for r in regions)]
        kept = _headings_before(parser, lines, plain, kept) + kept if parser.tags[regions[0]] not in CONTENT else kept
    return "\n".join(lines[i][0] for i in kept)


def _stays(parser: _Lines, block: int, region: int) -> bool:
    """Whether a line lies in the region and in no boilerplate inside it."""
    mark = parser.marked[block]
    return region <= block <= parser.last[region] and not region < mark <= parser.last[region]


def _page_block(parser: _Lines) -> int:
    """The body, or what the page has for one."""
    return next((i for i, tag in enumerate(parser.tags) if tag == "body"), 0)


def _sums(parser: _Lines, weighted: list[tuple[int, int]]) -> list[int]:
    """Characters in each block and all before it, by number; the inside of a block is a difference of two."""
    out = [0] * (len(parser.tags) + 1)
    for block, size in weighted:
        out[block + 1] += size
    for i in range(1, len(out)):
        out[i] += out[i - 1]
    return out


def _regions(parser: _Lines, plain: list[tuple[int, int]], clustered: list[tuple[int, int]]) -> list[int]:
    """Blocks whose lines are the content."""
    text, sums = _sums(parser, plain), _sums(parser, clustered)
    inside = lambda totals, i: totals[parser.last[i] + 1] - totals[i]
    page = _page_block(parser)
    wanted = REGION_SHARE * sums[-1]
    region = max((i for i in range(len(parser.tags)) if inside(sums, i) >= wanted), default=page)
    if parser.last[region] == region and parser.tags[region] not in CONTENT:
        region = parser.parent[region]  # a single line stands in the block around it
    around = region
    while around and parser.tags[around] not in CONTENT:
        around = parser.parent[around]
    if around:
        if parser.tags[around] != "article":
            return [around]
        beside = [i for i, tag in enumerate(parser.tags) if tag == "article" and parser.parent[i] == parser.parent[around] and inside(sums, i) > 0]
        return beside or [around]
    articles = [i for i in range(region, parser.last[region] + 1) if parser.tags[i] == "article" and inside(sums, i) > 0]
    if articles:
        outer: list[int] = []
        for i in articles:
            if not outer or i > parser.last[outer[-1]]:
                outer.append(i)
        return outer
    if region <= page:
        return [page]
    while (up := parser.parent[region]) > page and inside(text, up) <= (1 + WIDER_SHARE) * inside(text, region):
        region = up
    return [region]


def _page_lines(parser: _Lines, lines: list, plain: list[int], clustered: list[int], page: int) -> list[int]:
    """Lines from the first to the last cluster, and those before and behind that stand in the page itself."""
    def in_page(block: int) -> bool:
        return block <= page or (parser.parent[block] <= page and parser.last[block] == block and parser.tags[block] in TEXT_BLOCKS)

    return [i for i in plain if clustered[0] <= i <= clustered[-1] or in_page(lines[i][1].where)]


def _headings_before(parser: _Lines, lines: list, plain: list[int], kept: list[int]) -> list[int]:
    """The nearest heading above the region, with the few lines between them."""
    before = [i for i in plain if i < kept[0]] if kept else []
    for n, i in enumerate(reversed(before[-BYLINES - 1 :]), 1):
        if lines[i][1].heading:
            first = len(before) - n
            while first and lines[before[first - 1]][1].heading:
                first -= 1
            return before[first:]
    return []


def extract_main_text(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """The table with the main text of ``html`` in column ``into`` (replaced if it exists)."""
    others = [c for c in pages.columns if c.lower() != into.lower() or c == html]
    named = pages.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(others)], F.col(f"`{html}`").cast("string").alias("_h"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            for at in range(0, rows, 256):  # pages as Python text a few at a time
                part = batch.slice(at, 256)
                texts = pa.array([main_text(x.as_py()) for x in part.column(part.num_columns - 1)], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], texts], [*part.schema.names[:-1], "_t"])

    schema = named.drop("_h").schema.add("_t", "string")
    result = named.mapInArrow(work, schema)
    return result.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(others) if c.lower() != into.lower()], F.col("_t").alias(into))
