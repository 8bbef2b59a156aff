"""Main text of HTML pages by line-block distribution.

Markup is stripped into lines: every edge of a block element ends a line. A
line weighs as many characters as it has; lines of page furniture and of menus
weigh nothing. A block is the sum of a window of lines with text. The main text
begins where the block sums first surge over the threshold and ends where they
dive to nothing after the last surge; what stands between is kept whole, but for
what weighs nothing.

Marks and names are weights, too: where the parts marked as article or main hold
at least as much text as surges elsewhere, what stands outside them weighs
nothing. A class or id is furniture's if all its parts are names of furniture or
of page structure, and a container of a doubtful name that holds half of the
page's text is none.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impactspark.llm.common import ship, whole_text

WINDOW = 3  # lines in a block
SURGE = 80  # characters in a block at which main text may begin
LINKED = 0.5  # share of linked characters from which a line is a link's
MENU_LINES = 3  # links one after another that make a menu

# fixed values: elements of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe noembed noframes xmp textarea title svg math object".split())
FOREIGN = frozenset("svg math".split())  # of RAW: may be closed by their own tag
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search "
    "section select summary table tbody td tfoot th thead title tr ul".split()
)
FURNITURE = frozenset("nav header footer aside form button select dialog menu head search datalist".split())
MAIN = frozenset("article main".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
FURNITURE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promotion promoted "
    "sidebar side-bar sidenav nav navbar navigation menu menus breadcrumb breadcrumbs header masthead topbar footer foot "
    "cookie cookies consent gdpr notice notices notification alert disclaimer popup modal overlay newsletter subscribe subscription signup login paywall "
    "comment comments commentlist respond reply replies disqus discussion share sharing social related recommended recommendations "
    "pagination pager toolbar widget widgets skip copyright".split()
)
# a paragraph that is not closed ends where one of these begins
ENDS_P = BLOCKS - frozenset("td th tr tbody thead tfoot caption option optgroup body html head title".split())

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|</?([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|</?([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",  # a quote that never closes
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
UNQUOTED_END = re.compile(r"=\s*[^\s\"'=]+$")  # a slash there is the value's
DIGITS = re.compile(r"\d+")
# names of furniture whose containers are furniture however much they hold
CERTAIN = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sidebar side-bar sidenav nav navbar navigation menu menus breadcrumb breadcrumbs "
    "footer foot cookie cookies consent gdpr comment comments commentlist respond disqus newsletter pagination pager".split()
)
# names of page structure, which say nothing by themselves
STRUCTURE = frozenset(
    "site page main top bottom left right upper lower primary secondary global outer inner mobile desktop sticky fixed my the js box boxes block blocks bar "
    "list lists item items link links button buttons wrap wrapper container content contents holder section sections area areas row col column columns "
    "group unit slot zone panel module component message text title form posts post articles stories story news icons media network".split()
)
LIST_ITEMS = frozenset("li dt dd td th tr option".split())


def _names_furniture(name: str) -> tuple[bool, bool]:
    """Whether a class or id is furniture's, and whether that is certain."""
    name = DIGITS.sub("", name).replace("_", "-").strip("-")
    parts = [name] if name in FURNITURE_NAMES else name.split("-")
    found = [p for p in parts if p in FURNITURE_NAMES]
    named = bool(found) and all(p in FURNITURE_NAMES or p in STRUCTURE for p in parts) and parts[0] not in ("post", "story", "content", "text")
    # what ends in a certain name is furniture whatever it begins with
    named = named or len(parts) > 1 and parts[-1] in CERTAIN and parts[0] not in ("with", "has", "no")
    return named, named and any(p in CERTAIN for p in found)


@dataclass
class Line:
    text: str
    linked: int  # characters inside links
    furniture: bool
    main: bool
    listed: bool = False  # in an item of a list
    named: int = -1  # innermost container with a doubtful name


def _furnishes(name: str, rest: str) -> tuple[bool, bool]:
    """Whether an element is furniture, and whether that is certain."""
    if name in FURNITURE:
        return True, True
    if not rest or name in ("body", "html", "article", "main"):
        return False, False
    found = certain = False
    for key, *values in ATTRIBUTE.findall(rest):
        key, value = key.lower(), "".join(values).lower()
        if key == "role" and value in FURNITURE_ROLES:
            return True, True
        if key in ("class", "id"):
            for part in value.split():
                named, sure = _names_furniture(part)
                found, certain = found or named, certain or sure
        if key in ("hidden",) or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            return True, True
    if re.search(r"(?:^|\s)hidden(?:\s|$)", rest):
        return True, True
    return found, certain


def _marks_main(name: str, rest: str) -> bool:
    return name in MAIN or "articleBody" in rest or bool(re.search(r"role\s*=\s*[\"']?main\b", rest))


class Open:
    """The open elements. Every question takes the same time at any depth."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, bool, bool, int]] = []  # name, certain furniture, main, container before
        self.where: dict[str, list[int]] = {}
        self.blocks: list[int] = []  # places of block elements but p
        self.furniture = self.main = self.links = self.items = 0
        self.named = -1
        self.parents: list[int] = []  # of containers with doubtful names

    def push(self, name: str, furniture: bool, certain: bool, main: bool) -> None:
        self.where.setdefault(name, []).append(len(self.stack))
        if name in BLOCKS and name != "p":
            self.blocks.append(len(self.stack))
        self.stack.append((name, furniture and certain, main, self.named))
        self.furniture += furniture and certain
        self.main += main
        self.links += name == "a"
        self.items += name == "li"
        if furniture and not certain:
            self.parents.append(self.named)
            self.named = len(self.parents) - 1

    def close(self, at: int) -> None:
        while len(self.stack) > at:
            name, furniture, main, self.named = self.stack.pop()
            self.where[name].pop()
            if name in BLOCKS and name != "p":
                self.blocks.pop()
            self.furniture -= furniture
            self.main -= main
            self.links -= name == "a"
            self.items -= name == "li"

    def last(self, name: str) -> int:
        found = self.where.get(name)
        return found[-1] if found else -1

    def last_block(self) -> int:
        return self.blocks[-1] if self.blocks else -1


def lines(page: str) -> list[Line]:
    """The page's lines in order, empty ones too, in time linear in the page."""
    out: list[Line] = []
    parts: list[str] = []
    linked = 0
    tags = Open()

    def close_line() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        out.append(Line(text, linked, tags.furniture > 0, tags.main > 0, tags.items > 0, tags.named))
        parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if tags.links:
                linked += len(text.strip())

    at = 0
    endless: set[str] = set()  # raw elements with no end tag any more
    while True:
        found = TAG.search(page, at)
        if found is None:
            add(page[at:])
            break
        add(page[at : found.start()])
        at = found.end()
        name, rest = (found[1], found[2]) if found[1] else (found[3], found[4])
        if name is None:
            continue
        name, closing = name.lower(), page[found.start() + 1] == "/"
        if name in RAW and not closing:
            if name in BLOCKS:
                close_line()
            if name in FOREIGN and rest.endswith("/") and not UNQUOTED_END.search(rest):
                continue
            end = None if name in endless else re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            if end is None:
                endless.add(name)
            at = end.end() if end else len(page)
            continue
        if name == "br":
            add(" ")
            continue
        if name in BLOCKS:
            close_line()
        if name in VOID:
            continue
        if closing:
            if (place := tags.last(name)) >= 0:
                tags.close(place)
            continue
        if name in ENDS_P and tags.last("p") > tags.last_block():  # as a browser does: the open paragraph ends here
            tags.close(tags.last("p"))
        if name in LIST_ITEMS and tags.last(name) >= 0 and tags.last(name) == tags.last_block():
            tags.close(tags.last(name))
        if rest.endswith("/") and name not in BLOCKS:
            continue
        furniture, certain = _furnishes(name, rest)
        if name == "header" and tags.main:
            furniture = False  # an article's own heading
        tags.push(name, furniture, certain, _marks_main(name, rest))
    close_line()
    _judge_names(out, tags.parents)
    return out


def _judge_names(found: list[Line], parents: list[int]) -> None:
    """Lines in containers of doubtful names are furniture, unless a container
    holds half of the text that is not furniture for certain."""
    held = np.zeros(len(parents) + 1, np.int64)  # the last one: all
    for x in found:
        if not x.furniture:
            held[x.named] += len(x.text)
    total = int(held.sum())
    furniture = np.zeros(len(parents) + 1, bool)
    for i in range(len(parents) - 1, -1, -1):  # a container comes after the one around it
        held[parents[i]] += held[i] if parents[i] >= 0 else 0
    for i, parent in enumerate(parents):
        furniture[i] = 2 * held[i] < total or furniture[parent]
    for x in found:
        x.furniture = x.furniture or bool(furniture[x.named])


def stretches(weights: np.ndarray, surge: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """Runs of lines [from, to) between a surge and the next dive of the block
    sums: block i holds lines i to i + window - 1, blocks rise to the surge and
    last until one is empty, and end with their last line that weighs."""
    n = len(weights)
    sums = np.concatenate([[0], np.cumsum(weights)])
    blocks = sums[np.minimum(np.arange(n) + window, n)] - sums[:n]
    heavy, surges, empty = np.flatnonzero(weights), np.flatnonzero(blocks >= surge), np.flatnonzero(blocks == 0)
    found, i = [], 0
    while True:
        k = int(np.searchsorted(surges, i))
        if k == len(surges):
            return found
        e = int(np.searchsorted(empty, surges[k]))
        up = int(empty[e - 1]) + 1 if e else 0  # the rise before the surge
        down = int(empty[e]) if e < len(empty) else n
        inside = heavy[np.searchsorted(heavy, up) : np.searchsorted(heavy, down)]
        if len(inside):
            found.append((int(inside[0]), int(inside[-1]) + 1))
        i = down + 1


def main_text(page: str) -> str:
    """The page's main text; empty if it has none."""
    # edges of containers leave empty lines, which part no text here
    found = [x for x in lines(page) if x.text]
    weighed = weights(found)
    marked = np.array([x.main for x in found], bool)
    inside = np.where(marked, weighed, 0)
    # a mark is trusted where it holds most of the text: else it may be a teaser's
    if inside.sum() >= sum(len(found[i].text) for i in kept(weighed) if not marked[i]):
        weighed = inside
    return " ".join(found[i].text for i in kept(weighed))


def weights(found: list[Line]) -> np.ndarray:
    """Characters of each line; 0 for furniture and menus. A menu is an item of
    a list, or three lines one after another, of links."""
    n = len(found)
    links = np.array([x.linked >= LINKED * len(x.text) for x in found], bool)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], links.view(np.int8), [0]])))
    menu = np.array([x.listed for x in found], bool) & links
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        if b - a >= MENU_LINES:
            menu[a:b] = True
    out = np.array([len(x.text) for x in found], np.int64)
    return np.where(menu | np.array([x.furniture for x in found], bool), 0, out) if n else out


def kept(weighed: np.ndarray) -> np.ndarray:
    """The lines that weigh between the first surge and the last dive."""
    runs = stretches(weighed, SURGE)
    if not runs:
        if not weighed.any():
            return np.zeros(0, np.int64)
        runs = stretches(weighed, 1)  # a short page: its largest stretch
        runs = [max(runs, key=lambda r: weighed[r[0] : r[1]].sum())]
    first, last = runs[0][0], runs[-1][1]
    return first + np.flatnonzero(weighed[first:last])


def extract(pages: DataFrame, page: str = "html", text: str = "text") -> DataFrame:
    """Add `text`, each page's main text. A NULL or empty page has an empty one,
    and one however long is read whole, in linear time; repeated pages are rows
    like others; other columns stay, but for one called `text`, which is
    replaced."""
    ship(pages.sparkSession)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(p) for p in batch], dtype="object")

    return pages.withColumn(text, run(whole_text(page)))
