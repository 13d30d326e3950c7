"""HTML extraction: text-to-tag ratios of parser events, smoothed and clustered.

The page streams through the standard library's parser once. Block elements end a line; a line has its text, the tags met
in it, the letters inside links, and the section (article, main, section, division, body) it lies in. What can't be
content is left out while parsing: head, scripts, styles, navigation, asides, footers, page headers, and elements whose
role names such a part. Forms, and elements whose class or id names a menu, notice, advert, sidebar or comment, are left
out once the page is read, unless they wrap the page's content: see ``shown``.

A line's ratio is its text outside links to its tags. Ratios are smoothed with a Gaussian along the page, and lines are
clustered by a threshold (a share of the standard deviation of the smoothed ratios): lines above it are content. Where
articles and mains hold most of the content text, they are the content, whole, with any other section of SHARE of it or
more. Elsewhere the innermost section around all content lines is the content, with all lines and sections in it; only
sections of links before its first and after its last content line are left out. A section of one line is a paragraph:
the section around it is taken instead. Lines come in page order.

Null or empty html gives an empty text, and so does a page without text. Cut pages are read as far as they go; a tag or
comment that the cut left open is no text (``whole``). Time grows with the page whatever its markup: end tags find their
element by name. Nothing is capped. Every page gives one row; other columns don't matter.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGMA = 1.0
DEVIATIONS = 0.5
SHARE = 0.2
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SECTIONS = frozenset("article main section div body td".split())
BLOCKS = SECTIONS | frozenset(
    "address aside blockquote caption center dd details dialog dir dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li menu nav ol optgroup option p pre search summary table tbody tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LEFT_OUT = frozenset("head title script style noscript template nav aside footer iframe object svg math canvas audio video select textarea button dialog menu".split())
CLOSED_BY = {name: BLOCKS - {"html", "body"} for name in ("p",)} | {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
"""Elements that a start tag of the given names ends."""
NOT_CONTENT = re.compile(
    r"(^|[-_\s])(ads?|ads?(box|slot|unit|space|block|container|wrapper)|adsbygoogle|adverts?|advertisements?|advertising|banner|breadcrumbs?|"
    r"comments?(area|block|body|box|container|form|holder|list|s?ection|thread|wrap|wrapper)?|cookies?|consent|disqus|footer|gdpr|menu|modal|nav|navbar|navigation|newsletter|"
    r"notices?|popup|promo|promoted|related|replies|respond|share|sharing|sidebar|signup|skip|social|sponsor(ed)?|subscribe|toolbar|widget|widgets)($|[-_\s])", re.IGNORECASE)
STATE = re.compile(r"(?<![^\s])(has|with|no|without|show|hide)[-_]\S+|\S+[-_](on|off|enabled|disabled)(?![^\s])", re.IGNORECASE)
"""Names that say what a wrapper has or does, not what it is."""
ROLES = frozenset("alert banner complementary contentinfo dialog alertdialog form menu menubar navigation search toolbar".split())
HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
OPEN_TAG = re.compile(r"<(?:[a-zA-Z/!?]|\Z)")
COMMENT_OR_RAW = re.compile(r"<!--|<(script|style)(?=[\s/>])", re.IGNORECASE)
RAW_END = {name: re.compile(f"</{name}(?=[\\s/>])", re.IGNORECASE) for name in ("script", "style")}


@dataclass
class Line:
    section: int
    parts: list[tuple[int, str, bool]] = field(default_factory=list)  # wrapper, text, inside a link
    tags: int = 0
    heading: bool = False

    def text(self) -> str:
        return " ".join("".join(text for _, text, _ in self.parts).split())

    @property
    def linked(self) -> int:
        return sum(len(text.strip()) for _, text, link in self.parts if link)


class PageLines(HTMLParser):
    """Lines of a page from parser events."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[tuple[str, int, bool, bool, int]] = [("", 0, False, False, 0)]  # name, section, left out, inside an article, wrapper
        self.around, self.kinds = [0], [""]  # of each section: the section around it, its element; numbers follow the page
        self.outer = [0]  # of each wrapper (a form, or named as no content): the wrapper around it; 0 is the page
        self.named = [""]  # of each wrapper: element, class and id
        self.marks: list[tuple[int, str]] = []  # wrapper and name of every article and main, one inside another not counted
        self.at: dict[str, list[int]] = {}  # of each element name: where it stands in the open ones
        self.blocks: list[int] = []  # where block elements stand in the open ones
        self.links = 0
        self.line = Line(0)

    def end_line(self) -> None:
        if self.line.parts:
            self.lines.append(self.line)
        self.line = Line(self.open[-1][1])

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        while len(self.open) > 1 and tag in CLOSED_BY.get(self.open[-1][0], ()):
            self._close()
        _, section, out, article, wrapper = self.open[-1]
        if tag in BLOCKS:
            self.end_line()
        elif tag in ("br", "img"):
            self.line.parts += [(self.line.parts[-1][0], " ", False)] if self.line.parts else []
        self.line.tags += 1
        if tag in VOID:
            return
        given = dict(attrs)
        names = HUMP.sub("-", f"{given.get('class') or ''} {given.get('id') or ''}")
        out = out or tag in LEFT_OUT or (tag == "header" and not article) or (given.get("role") or "").lower() in ROLES or "hidden" in given
        out = out or (given.get("itemprop") or "").lower() == "comment" or (given.get("itemtype") or "").lower().endswith("/comment")
        if tag == "form" or (tag not in ("html", "body", "article", "main") and NOT_CONTENT.search(names) and NOT_CONTENT.search(STATE.sub(" ", names))):
            self.outer.append(wrapper)
            self.named.append(f"{tag} {names}")
            wrapper = len(self.outer) - 1
        if tag in ("article", "main") and not article and not out:
            self.marks.append((wrapper, tag))
        if tag in SECTIONS:
            if not (article and tag in ("section", "div", "td")):  # parts of an article are one section
                self.around.append(section)
                self.kinds.append(tag)
                section = len(self.kinds) - 1
        self.at.setdefault(tag, []).append(len(self.open))
        if tag in BLOCKS:
            self.blocks.append(len(self.open))
        self.open.append((tag, section, out, article or tag in ("article", "main"), wrapper))
        self.links += tag == "a"
        if tag in BLOCKS:
            self.line = Line(section)
            self.line.tags = 1
            self.line.heading = tag in HEADINGS

    def _close(self) -> None:
        tag = self.open.pop()[0]
        self.links -= tag == "a"
        if tag in self.at:
            self.at[tag].pop()
        if tag in BLOCKS:
            self.blocks.pop()
            self.end_line()

    def handle_endtag(self, tag: str) -> None:
        self.line.tags += 1
        depth = self.at[tag][-1] if self.at.get(tag) else 0
        if depth and (tag in BLOCKS or not self.blocks or self.blocks[-1] < depth):
            while len(self.open) > depth:
                self._close()
        elif depth and tag not in BLOCKS:  # an inline end tag inside a block that the inline element doesn't enclose well
            self.links -= tag == "a"
            if tag == "a":
                self.at["a"].pop()
                self.open[depth] = ("", *self.open[depth][1:])

    def handle_data(self, data: str) -> None:
        if not self.open[-1][2]:
            self.line.parts.append((self.open[-1][4], data, self.links > 0))


def whole(html: str) -> str:
    """The page up to a comment or tag that is never closed. Scripts and styles may hold what looks like one."""
    at = 0
    while found := COMMENT_OR_RAW.search(html, at):
        if found[1]:
            end = RAW_END[found[1].lower()].search(html, found.end())
            at = end.end() if end else len(html)
        else:
            at = html.find("-->", found.start() + 2) + 3
            if at < 3:
                html = html[:found.start()]
                break
    cut = OPEN_TAG.search(html, html.rfind(">") + 1)
    return html[:cut.start()] if cut else html


def parsed(html: str) -> PageLines:
    """The parser at the page's end; its lines are those with text."""
    parser = PageLines()
    parser.feed(whole(html))
    parser.close()
    parser.end_line()
    if len(parser.outer) > 1:
        seen = shown(parser)
        for line in parser.lines:
            line.parts = [part for part in line.parts if part[0] in seen]
    parser.lines = [line for line in parser.lines if line.text()]
    return parser


def page_lines(html: str) -> list[Line]:
    return parsed(html).lines


def shown(page: PageLines) -> set[int]:
    """The wrappers that are content after all, with the page itself (0).

    Those around a main are; so are, where no article or main stands free, those around the first article (or that in a
    wrapper with more than twice its text) and around articles in wrappers of the same name, up to one beside which more
    text is shown. From the outside in, so is one of several lines beside which the page shows less than SHARE of the text.
    """
    outer, seen = page.outer, {0}
    own, lines = [0] * len(outer), [0] * len(outer)

    def add(w: int) -> None:
        while w not in seen:
            seen.add(w)
            w = outer[w]

    for w, tag in page.marks:
        if tag == "main":
            add(w)
    for line in page.lines:
        for w in {w for w, text, _ in line.parts if text.strip()}:
            lines[w] += 1
        for w, text, link in line.parts:
            own[w] += 0 if link else len(text.strip())
    whole = list(own)
    for w in range(len(own) - 1, 0, -1):
        whole[outer[w]] += whole[w]
        lines[outer[w]] += lines[w]
    if page.marks and not any(w in seen for w, _ in page.marks):
        first, most = page.marks[0][0], max((w for w, _ in page.marks), key=lambda w: whole[w])
        first = most if whole[most] > 2 * whole[first] else first
        alike = {w for w, _ in page.marks if page.named[w] == page.named[first]}
        free, group, before = sum(own[w] for w in seen), sum(whole[w] for w in alike), set(seen)
        for w in alike:
            chain = [w]
            while outer[chain[-1]]:
                chain.append(outer[chain[-1]])
            beside = free
            for a in reversed(chain):
                if a not in before:
                    if max(whole[a], group if a in alike else 0) < beside:
                        break
                    seen.add(a)
                    beside += own[a]
    free = sum(own[w] for w in seen)
    for w in range(1, len(own)):
        if w not in seen and outer[w] in seen and lines[w] > 1 and whole[w] > 0 and free < SHARE * (free + whole[w]):
            seen.add(w)
            free += own[w]
    return seen


def smoothed(ratios: np.ndarray) -> np.ndarray:
    """Gaussian along the lines, weights renewed at both ends."""
    reach = np.arange(-3, 4) * 1.0
    kernel = np.exp(-reach**2 / (2 * SIGMA**2))
    return np.convolve(ratios, kernel, "full")[3:-3] / np.convolve(np.ones(len(ratios)), kernel, "full")[3:-3]


def main_text(html: str | None) -> tuple[str, int, int]:
    """Text of the content, lines on the page that could be content, lines taken."""
    page = parsed(html or "")
    lines = page.lines
    if not lines:
        return "", 0, 0
    texts = [line.text() for line in lines]
    plain = np.array([max(0, len(t) - line.linked) for t, line in zip(texts, lines)], float)
    ratios = smoothed(plain / np.array([max(1, line.tags) for line in lines]))
    content = ratios >= min(ratios.max(), DEVIATIONS * ratios.std())
    taken = [t for t, keep in zip(texts, chosen(page, plain, content)) if keep]
    return "\n".join(taken), len(lines), len(taken)


def chosen(page: PageLines, plain: np.ndarray, content: np.ndarray) -> np.ndarray:
    """Which lines belong to the content. Sections are numbered in page order, so those inside a section follow it."""
    around, kinds, at = page.around, page.kinds, np.array([line.section for line in page.lines])
    marked = np.zeros(len(kinds), bool)
    for s in range(1, len(kinds)):
        marked[s] = marked[around[s]] or kinds[s] in ("article", "main")
    weight = np.bincount(at, plain * content, len(kinds))
    if marked[at].any() and weight[marked].sum() >= weight.sum() / 2:
        return marked[at] | ((weight > 0) & (weight >= SHARE * weight.sum()))[at]
    size = np.array([len(line.text()) for line in page.lines], float)
    solid = content & (plain > 0.5 * size)
    held = at[solid] if solid.any() else at[content]
    last = np.arange(len(kinds))
    for s in range(len(kinds) - 1, 0, -1):
        last[around[s]] = max(last[around[s]], last[s])
    top = int(held.min())
    while last[top] < held.max():
        top = around[top]
    climbed = False
    while top and ((at >= top) & (at <= last[top])).sum() == 1:
        top, climbed = around[top], True
    inside = (at >= top) & (at <= last[top])
    unit = np.zeros(len(kinds), int)  # the outermost section inside the chosen one
    for s in range(top + 1, last[top] + 1):
        unit[s] = s if around[s] == top else unit[around[s]]
    mine = unit[at]
    full = np.flatnonzero(inside & solid)
    first, end = (full[0], full[-1]) if len(full) else (0, len(at) - 1)
    links = np.bincount(mine, size - plain, len(kinds)) > 0.5 * np.bincount(mine, size, len(kinds))
    place = np.arange(len(at))
    edge = ((place < first) | (place > end)) & ~np.isin(mine, mine[full])
    edge &= (mine > 0) & links[mine] & np.array([kinds[u] != "td" for u in mine])
    if climbed:
        edge |= ((place < first) | (place > end)) & (mine == 0) & (plain <= 0.5 * size) & ~np.array([line.heading for line in page.lines])
    return inside & ~edge


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars, n_lines, n_taken`` of every page."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lines, taken = zip(*(main_text(h.as_py()) for h in batch.column(2)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), *(pa.array(c, pa.int64()) for c in ([len(t) for t in texts], lines, taken))],
                ["page_id", "url", "text", "n_chars", "n_lines", "n_taken"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_lines long, n_taken long")
