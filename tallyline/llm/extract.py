"""Main-text extraction from web pages.

The standard library's streaming parser turns a page into lines (one for each
block element) with the number of their tags. A line's text-to-tag ratio,
smoothed by a Gaussian over the sequence of lines, is compared with a
threshold; lines above it form clusters. The regions (innermost containers)
that clusters lie in are the content, and all their lines belong to the text,
the short ones too. Where there are articles, what lies in them is content but
for regions (lists too) of mostly links with fewer lines above the threshold
than below; what lies outside is none, unless no line in an article is above
the threshold. Elements that by name, role or
class are menus, headers, footers, sidebars, notices, adverts, forms or
comments never are. A class or id is only a hint: an element that is as dense
as the page and holds most of its text is not left out for it, unless the hint
says comments, notice or advert (and not that a layout has them) and the element
holds no article without such a hint.

Defined results: null, empty or text-less pages give an empty text; markup
that breaks off or nests wrongly is read as far as it goes; repeated rows give
equal texts; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.common import col

SIGMA = 1.0       # lines
THRESHOLD = 0.5   # of the mean smoothed ratio

MOSTLY = 0.8      # share of a region's text in chosen regions from which all of it is chosen
READINGS = 4      # of a page at most
WRAPS = 0.5       # share of a page's text from which an element is not left out by its class or id
LINKED = 0.5      # share of a region's text in links from which it is a list of links

# Elements by kind, in order of name.
SILENT = frozenset("applet audio canvas head iframe math noscript object script style svg template title video".split())
ASIDE = frozenset("aside button datalist dialog footer form header menu nav select textarea".split())
LANDMARK = frozenset(("article", "main"))
BLOCK = frozenset("""address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset
    figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section summary
    table tbody td tfoot th thead tr ul""".split())
CONTAINER = frozenset("article aside body dialog div fieldset footer form header main menu nav section".split())
LISTS = frozenset("dl menu ol table ul".split())
# What a start tag ends where the end tag was omitted, and where the search stops.
ENDS = {**dict.fromkeys(("dt", "dd"), ("dt", "dd")), **dict.fromkeys(("td", "th"), ("td", "th")), "li": ("li",), "option": ("option",),
        "tr": ("tr", "td", "th"), **dict.fromkeys(("tbody", "tfoot", "thead"), ("tbody", "tfoot", "thead", "tr", "td", "th"))}
SCOPE = (CONTAINER | LISTS | {"select"}) - {"div"}
HEAD = frozenset("base basefont bgsound head html link meta".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
HINTS = re.compile(r"""(?:^|[\s_-])(?:ad|ads|advert\w*|banner|breadcrumbs?|comments?|commentlist|consent|cookies?|disqus|
    footer|gdpr|header|login|masthead|menu|modal|navbar|navigation|nav|newsletter|notice|popup|promo\w*|related|replies|
    respond|share|sharing|sidebar|signup|social|sponsor\w*|subscribe|subscription|toolbar|widget)(?:$|[\s_-])""", re.X | re.I)
# Those of them that are never the page's own text: reader comments, notices, adverts.
FIRM = re.compile(r"""(?:^|[\s_-])(?:ad|ads|advert\w*|comments?|commentlist|consent|cookies?|disqus|gdpr|newsletter|notice|popup|
    promo\w*|replies|respond|sponsor\w*)(?:$|[\s_-])""", re.X | re.I)
# Classes that say whether a layout has such parts.
LAYOUT = re.compile(r"(?:^|[\s_-])(?:(?:no|with|has|without|hide|show)[_-][\w-]+|[\w-]+[_-](?:open|closed|on|off|enabled|disabled|allowed))(?=$|\s)", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class _Lines(HTMLParser):
    """Collects lines: [text, tags, region, in an article, signs in links]."""

    def __init__(self, never_closed: frozenset[str] = frozenset(), wrappers: frozenset[tuple[int, int]] = frozenset()):
        super().__init__(convert_charrefs=True)
        self.never_closed = never_closed   # elements not to leave out by name
        self.wrappers = wrappers   # elements not to leave out by class or id, by their place
        # Signs, tags and articles in those left out, and whether for a firm hint.
        self.hinted: dict[tuple[int, int], list[int]] = {}
        self.firm = False       # whether the element at hand has a firm hint
        self.open: dict[str, int] = {}   # elements on the stack by name
        self.within: list[tuple[int, int]] = []   # those of them that are open
        self.outer = [0, 0]     # signs and tags in all of them
        self.stack: list[tuple[str, int, int]] = []   # element, left out (1, by class or id 2), region
        self.muted = 0          # elements on the stack that are left out,
        self.named = 0          # not by class or id
        self.silent = ""        # a silent element that is open
        self.inner = ""         # a silent element that is open in the head
        self.above = [0]        # the region around each region
        self.region, self.landmark = 0, None
        self.landmarks: set[int] = set()
        self.linked, self.links = False, 0   # whether a link is open, signs in links of the line
        self.lines: list[list] = []
        self.parts: list[str] = []
        self.tags = 0
        self.unclosed: str | None = None   # the input in which a comment has no end

    def parse_comment(self, i, report=1):
        # One without an end has none after it that has: looked for once.
        if self.unclosed is self.rawdata:
            return -1
        end = super().parse_comment(i, report)
        if end < 0:
            self.unclosed = self.rawdata
        return end

    def close(self):
        """Read what is left of a page that breaks off. Behind the last '>' no tag
        or comment can end, so that part is text, taken at once."""
        rest = self.rawdata
        cut = rest.rfind(">") + 1
        self.rawdata = rest[:cut]
        super().close()
        if not self.cdata_elem:
            self.handle_data(unescape(rest[cut:]))

    def end_line(self):
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append([text, self.tags, self.region, self.landmark is not None, self.links])
        self.parts, self.tags, self.links = [], 0, 0

    def out(self, tag: str, attrs) -> int:
        """1 for an element that is left out by its name or attributes, 2 for
        one that is by its class or id, else 0."""
        if tag in ASIDE and tag not in self.never_closed:
            # The heading of an article is its own, not the page's.
            return int(not (tag == "header" and self.landmark is not None))
        hint = self.firm = False
        for name, value in attrs:
            value = value or ""
            if name in ("class", "id"):
                if tag not in ("html", "body") and HINTS.search(value):
                    hint = True
                    self.firm = self.firm or bool(FIRM.search(LAYOUT.sub(" ", value)))
            elif name == "role":
                if value.lower() in ROLES:
                    return 1
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and HIDDEN.search(value)):
                return 1
        return 2 if hint and self.getpos() not in self.wrappers else 0

    def handle_starttag(self, tag, attrs):
        if self.silent == "head" and tag != "body" and (self.inner or tag in SILENT or tag in HEAD):
            if not self.inner and tag in SILENT and tag != "head":
                self.inner = tag
            return
        if self.silent == "head" or (self.silent == "title" and tag == "body"):
            self.silent = self.inner = ""   # the end tag was omitted
        if self.silent:
            return
        if tag in SILENT:
            self.silent = tag
            return
        if tag == "body":
            self.end_line()
            return
        self.tags += 1
        if self.muted and tag in ENDS:
            self.end_open(tag)
        if tag in BLOCK:
            self.end_line()
            while self.stack and self.stack[-1][0] in ("p", *HEADINGS):   # a block ends an open paragraph
                self.pop()
        if tag in VOID:
            if tag == "br":
                self.parts.append(" ")
            return
        if tag == "a":
            self.linked = True
        out = self.out(tag, attrs) if attrs or tag in ASIDE else 0
        if tag in LANDMARK and not out and self.muted and not any(x[1] and x[0] not in ASIDE for x in self.stack):
            while self.muted:   # an article inside a menu or header: those were never closed
                self.pop()
        if tag in CONTAINER or out or (tag in LISTS and self.landmark is not None):
            if tag in LANDMARK and not out and self.landmark is None:
                self.landmark = len(self.above)
                self.landmarks.add(self.landmark)
                self.push("!" + tag, out)
            else:
                self.push(tag, out)
            self.above.append(self.region)
            self.region = len(self.above) - 1
            self.muted += out > 0
            self.named += out == 1
            if out == 2:
                self.within.append(self.getpos())
                self.hinted[self.within[-1]] = [0, 0, int(tag in LANDMARK), int(self.firm)]
        elif tag in LISTS:
            self.push(tag, 0)
        if self.within and not self.named:
            held = self.hinted[self.within[-1]]
            held[1] += 1
            if tag in LANDMARK and not out:
                held[2] = 2

    def push(self, tag: str, out: int):
        self.stack.append((tag, out, self.region))
        self.open[tag.lstrip("!")] = self.open.get(tag.lstrip("!"), 0) + 1

    def pop(self):
        tag, out, region = self.stack.pop()
        self.open[tag.lstrip("!")] -= 1
        self.muted -= out > 0
        self.named -= out == 1
        if out == 2:
            self.leave()
        self.region = region
        if tag[0] == "!":
            self.landmark = None

    def leave(self):
        """What an element left out by class or id holds, the one around it holds too."""
        signs, tags, articles, _ = self.hinted[self.within.pop()]
        if self.within:
            held = self.hinted[self.within[-1]]
            if articles == 2:
                held[2] = 2
        else:
            held = self.outer
        held[0], held[1] = held[0] + signs, held[1] + tags

    def end_open(self, tag: str):
        """End the sibling whose end tag was omitted."""
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in ENDS[tag]:
                while len(self.stack) > i:
                    self.pop()
                return
            if self.stack[i][0].lstrip("!") in SCOPE:
                return

    def wrapping(self) -> frozenset[tuple[int, int]]:
        """The elements left out by class or id that hold most of the page, or
        that the page left open though their end tag may be omitted."""
        omitted = {at for at, x in zip(self.within, [x for x in self.stack if x[1] == 2]) if x[0] in ENDS}
        while self.within:
            self.leave()
        signs, tags = self.outer[0] + sum(len(x[0]) for x in self.lines), self.outer[1] + sum(x[1] for x in self.lines)
        article = any(x[3] for x in self.lines)

        def wraps(held: list[int]) -> bool:
            if held[3] and held[2] != 2:
                return False
            share = WRAPS if held[2] and not article else MOSTLY
            return held[0] >= max(1, share * signs) and held[0] * max(1, tags) >= THRESHOLD * signs * held[1]
        return frozenset(at for at, held in self.hinted.items() if at in omitted or wraps(held))

    def handle_startendtag(self, tag, attrs):
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        elif not self.silent and tag in BLOCK:
            self.end_line()

    def handle_endtag(self, tag):
        if self.silent:
            if tag == self.silent or (self.silent == "title" and tag == "head"):
                self.silent = self.inner = ""
            elif tag == self.inner:
                self.inner = ""
            return
        if tag in BLOCK:
            self.end_line()
        if tag == "a" or tag in BLOCK:   # a link that is never closed ends with its block
            self.linked = False
        for i in range(len(self.stack) - 1, -1, -1) if self.open.get(tag) else ():
            if self.stack[i][0].lstrip("!") == tag:
                while len(self.stack) > i:
                    self.pop()
                break

    def handle_data(self, data):
        if self.silent == "head" and not self.inner and data.strip():
            self.silent = ""   # text ends a head
        if self.silent:
            return
        if not self.muted:
            self.parts.append(data)
            if self.linked:
                self.links += len(data.strip())
        elif not self.named:
            self.hinted[self.within[-1]][0] += len(data.strip())


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = max(1, math.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratios, reach, mode="edge"), kernel / kernel.sum(), mode="valid")


def _read(html: str, never_closed: frozenset[str] = frozenset(), wrappers: frozenset[tuple[int, int]] = frozenset()) -> _Lines:
    page = _Lines(never_closed, wrappers)
    page.feed(html)
    page.close()
    page.end_line()
    return page


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = _read(html)
    for _ in range(READINGS - 1):
        # A class that speaks of a menu does not hide the page, nor does a menu that is never closed.
        wrappers = page.wrappers | page.wrapping()
        left_open = page.never_closed if page.lines else page.never_closed | {tag for tag, out, _ in page.stack if out == 1 and tag in ASIDE}
        if wrappers == page.wrappers and left_open == page.never_closed:
            break
        page = _read(html, page.never_closed if wrappers != page.wrappers else frozenset(left_open), wrappers)
    lines = page.lines
    if not lines:
        return ""
    ratios = np.array([len(x[0]) / max(1, x[1]) for x in lines], dtype=float)
    level = smoothed(ratios)
    dense = level >= THRESHOLD * level.mean()
    inside = [x[3] for x in lines]
    if any(inside):
        chosen = {x[2] for x, i in zip(lines, inside) if i} - _links(lines, dense, page.landmarks)
        if not dense[inside].any():   # the text may lie beside the articles
            chosen |= {x[2] for x, d in zip(lines, dense) if d}
    else:
        chosen = {x[2] for x, d in zip(lines, dense) if d}
        chosen |= _around(chosen, [(x[2], len(x[0])) for x in lines], page.above)
    return " ".join(x[0] for x in lines if x[2] in chosen)


def _links(lines: list[list], dense: np.ndarray, landmarks: set[int]) -> set[int]:
    """The regions inside articles that are lists of links: fewer than half of
    their lines are dense, and half of their text or more is in links."""
    told: dict[int, list[int]] = {}
    for (text, _, region, inside, links), d in zip(lines, dense):
        if inside and region not in landmarks:
            held = told.setdefault(region, [0, 0, 0, 0])
            for i, more in enumerate((1, int(d), len(text), links)):
                held[i] += more
    return {r for r, (n, above, size, links) in told.items() if above * 2 < n and links >= LINKED * size}


def _around(chosen: set[int], lines: list[tuple[int, int]], above: list[int]) -> set[int]:
    """The regions beside chosen ones, where the region around them is mostly
    theirs: short blocks with containers of their own."""
    whole, own = [0] * len(above), [0] * len(above)
    for region, size in lines:
        whole[region] += size
        own[region] += size * (region in chosen)
    held = [bool(x) for x in whole]
    for region in range(len(above) - 1, 0, -1):   # a region comes after the one around it
        around = above[region]
        whole[around], own[around] = whole[around] + whole[region], own[around] + own[region]
        held[around] = held[around] or held[region]
    within = [False] * len(above)
    for region in range(1, len(above)):
        within[region] = within[above[region]] or held[region] and own[region] >= MOSTLY * whole[region]
    return {region for region, _ in lines if within[region]}


def extracted(html: Column) -> Column:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([main_text(p) for p in pages], dtype="object")

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "string")(html)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    out = pages.select(col(page_id), col(url), extracted(col(html)).alias("text"))
    return out.select(col(page_id), col(url), "text", F.length("text").cast("long").alias("n_chars"))
