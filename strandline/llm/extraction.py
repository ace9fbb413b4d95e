"""Main text of web pages by the maximum-scoring subsequence.

A page is a row of words and tags. Words score positive, tags negative, and one
linear scan finds the contiguous region with the largest sum. The weights come from
pages that label themselves by a single ``article`` or ``main`` element: first how
much more often a tag stands outside than inside, then corrections wherever the
region found differs from the labelled one. Elements that labelled pages never hold
inside the article (menus, adverts and the like) count as one tag whose words are left
out. So do those whose tag or class says what they are, unless labelled articles hold the
like, but never what holds the article, or all its paragraphs. How many words an element
holds makes no difference.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from strandline.llm.common import documents, hash_share, python_tasks

#: Labelled pages that weights are learned from, and the bytes of each, at most.
FIT_PAGES, FIT_BYTES = 1000, 262_144

# Fixed values of the page format.
RAW = frozenset("script style textarea title iframe".split())
#: Raw text, and elements nested as others are that no reader sees as text.
INERT = RAW | frozenset("noscript template svg".split())
#: Tags of HTML that end an svg, and elements that tags within do not close.
NOT_SVG = frozenset(
    "article b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li main menu "
    "meta nobr ol p pre ruby s section small span strong strike sub sup table tt u ul var".split())
WALLS = ("noscript", "template", "foreignobject")
IN_HEAD = frozenset("base link meta noscript script style template title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr".split())
#: Elements that rarely hold article text, by their meaning.
SET_ASIDE = INERT | frozenset(
    "aside button canvas dialog embed fieldset footer form head header input menu nav object select".split())
#: Words of a class, id or role that name such an element.
HINTS = frozenset(
    "ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies copyright disclaimer footer gdpr header login masthead menu modal nav navbar navigation newsletter notice "
    "notices pager pagination popup promo promoted related reply replies respond search share sharing sidebar signup "
    "social sponsor sponsored subscribe toolbar widget widgets".split())
#: Elements that no article lies in, whatever else the page holds.
NEVER_TEXT = frozenset("aside button canvas dialog embed footer head input menu nav object select".split())  # and those that are inert
#: With one of these beside it a hint describes what surrounds the element.
ABOUT = frozenset("has no with without".split())
CONTENT = ("article", "main")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<raw>script|style|textarea|title|iframe)\b(?P<raw_attrs>[^>]*+)>.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<odd_close>/?)(?P<odd_name>[a-zA-Z][^\s/>]*+)[^>]*+>"
    r"|(?P<text>[^<]++|<)", re.S | re.I)
#: The same, where no quote is taken to hold a bracket.
_PLAIN_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<raw>script|style|textarea|title|iframe)\b(?P<raw_attrs>[^>]*+)>.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>[^>]*+)>"
    r"|(?P<text>[^<]++|<)", re.S | re.I)
#: So many tags may end in an open quote; then quotes count no more in the page.
OPEN_QUOTES = 8
_REST = re.compile(r"(?P<text>.+)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
_PARTS = re.compile(r"[a-z]+|[0-9]+")


@lru_cache(4096)
def marks_of(name: str, attributes: str) -> tuple[frozenset[str], bool]:
    """What describes an element (its tag, and the words of its class, id and role), and whether it is hidden."""
    found, hidden = {name}, False
    for match in _ATTRIBUTE.finditer(attributes):
        key, value = match[1].lower(), match[2] or match[3] or match[4] or ""
        if key in ("class", "id", "role"):
            found.update("." + part for part in _PARTS.findall(re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower()))
        hidden |= (key == "hidden" or key == "aria-hidden" and value.strip().lower() == "true"
                   or key == "style" and _NO_DISPLAY.search(value) is not None)
    return frozenset(found), hidden


@dataclass
class Weights:
    """Scores of a word and of tags, and the marks of elements that are set aside.

    Tags and hints that set an element aside are a prior. Inside the article the marks
    in ``inside`` overrule it, on pages without a labelled article those in ``open``.
    """

    word: float = 1.0
    tags: dict[str, float] = field(default_factory=lambda: {
        f"{slash}{name}": -3.0 for name in (*CONTENT, "body", "html") for slash in ("", "/")})
    aside: frozenset[str] = frozenset()
    inside: frozenset[str] = frozenset()
    open: frozenset[str] = frozenset()
    other: float = -0.2

    def tag(self, name: str) -> float:
        return self.tags.get(name, self.other)

    def sets_aside(self, element: Element, overruled: frozenset[str]) -> bool:
        if element.name in INERT:
            return element.closed  # one that never ends is a slip, not the rest of the page
        if element.name in ("html", "body", *CONTENT):
            return False
        marks = element.marks - overruled
        hinted = (element.name not in HEADINGS and not HINTS.isdisjoint(m[1:] for m in marks if m[0] == ".")
                  and ABOUT.isdisjoint(m[1:] for m in element.marks if m[0] == "."))
        return (element.hidden or element.name in SET_ASIDE and element.name in marks or hinted
                or not marks.isdisjoint(self.aside))


@dataclass
class Item:
    """A tag, or the text between two tags. ``block`` numbers the blocks of a page."""

    kind: str
    text: str = ""
    words: int = 0
    labelled: bool = False


@dataclass(slots=True)
class Element:
    """An element of a page; ``parent`` and the like are numbers of elements, 0 is the page itself."""

    name: str
    marks: frozenset[str] = frozenset()
    hidden: bool = False
    parent: int = -1
    words: int = 0
    closed: bool = False  # by an end tag of its own
    inside: bool = False  # within the article
    holds: bool = False  # the article
    inert: bool = False  # script, an svg and the like, or within them
    aside: bool = False
    beside: bool = False  # neither within an article or main nor within an element set aside


class Page:
    """The elements of a page, what happens in page order, and the article: its largest ``article``, or else ``main``.

    ``events`` are an element and its opening (None), a text, or its end tag (the innermost open element).
    """

    def __init__(self, page: str) -> None:
        self.elements = elements = [Element("")]
        self.events: list[tuple[int, str | int | None]] = []
        stack = [0]
        places: dict[str, list[int]] = {"": [0]}  # where in the stack the open elements of a name are

        def last(*names: str) -> int:
            return max((places[name][-1] for name in names if places.get(name)), default=0)

        def shorten(to: int) -> None:
            while len(stack) > to:
                places[elements[stack.pop()].name].pop()

        def close_to(name: str, *walls: str) -> None:
            """Close the innermost open ``name`` and what it holds, unless a wall is between."""
            if (i := last(name)) and last(*walls) <= i:
                shorten(i)

        tokens, open_quotes = _TOKEN, 0
        at, last_end = 0, page.rfind(">")
        while match := tokens.match(page, at):
            if match["text"] == "<" and at > last_end:  # no tag ends any more
                match = _REST.match(page, at)
            at = match.end()
            if match.lastgroup == "text":
                text = html.unescape(match["text"])
                elements[stack[-1]].words += len(text.split())
                self.events.append((stack[-1], text))
                continue
            found = match.groupdict()
            if found.get("odd_name"):
                open_quotes += 1
                tokens = _PLAIN_TOKEN if open_quotes >= OPEN_QUOTES else tokens
            name = (found["name"] or found.get("odd_name") or found["raw"] or "").lower()
            if not name:
                continue
            if found["close"] or found.get("odd_close"):
                if i := last(name):
                    k = stack[i]
                    self.events.append((k, stack[-1]))
                    elements[k].closed = True
                    shorten(i)
                continue
            attributes = found["attrs"] or found["raw_attrs"] or ""
            svg = last("svg")
            foreign = svg > 0 and last("foreignobject") < svg
            if foreign and name in NOT_SVG:
                shorten(svg)
                foreign = False
            alone = name in VOID or (foreign or name == "svg") and attributes.endswith("/")
            if found["raw"]:
                if alone:
                    at = match.end("raw_attrs") + 1
            elif not foreign:
                if name == "body":
                    close_to("head")
                if elements[stack[-1]].name == "head" and name not in IN_HEAD:
                    shorten(len(stack) - 1)
                if name not in INLINE and name not in INERT:
                    close_to("p", "table", "button", "object", "div", "section", "article", "main", "td", "li", *WALLS)
                if name in ("li", "dd", "dt", "tr", "td", "th", "option"):
                    close_to(name, "ul", "ol", "dl", "table", "select", *WALLS)
            elements.append(Element(name, *marks_of(name, attributes), stack[-1], closed=alone or bool(found["raw"])))
            self.events.append((len(elements) - 1, None))
            if not alone and not found["raw"]:
                places.setdefault(name, []).append(len(stack))
                stack.append(len(elements) - 1)
        for element in reversed(elements[1:]):
            if not (element.name in INERT and element.closed):
                elements[element.parent].words += element.words
        for element in elements[1:]:
            element.inert = element.name in INERT and element.closed or elements[element.parent].inert
        self.article = self._article()
        k = elements[self.article].parent if self.article else 0
        while k > 0:
            elements[k].holds = True
            k = elements[k].parent
        for k, element in enumerate(elements[1:], 1):
            element.inside = element.parent == self.article > 0 or elements[element.parent].inside

    def _article(self) -> int:
        """The number of the article, or 0."""
        for name in CONTENT:
            found = [k for k, element in enumerate(self.elements) if element.name == name and not element.inert]
            if found:
                return max(found, key=lambda k: (self.elements[k].words, -k))
        return 0

    def items(self, weights: Weights) -> list[Item]:
        """The tags and texts that count, in page order; elements set aside are one tag.

        ``labelled`` tells what lies inside the article. Never set aside are the article and
        what holds it, nor what holds all paragraphs of the article or, without one, of the page.
        A menu that holds the article because it was never closed ends where the article starts.
        """
        items: list[Item] = []
        elements, article = self.elements, self.article
        needed = self._needed(weights)
        within = [element.inside or k == article > 0 for k, element in enumerate(elements)]
        for k, what in self.events:
            element = elements[k]
            if isinstance(what, str):
                if not element.aside:
                    items.append(Item("text", what, len(what.split()), within[k]))
            elif what is not None:
                if not elements[what].aside:
                    items.append(Item("/" + element.name, labelled=within[k] and k != article))
            else:
                parent = elements[element.parent]
                if k == article:
                    self._end_menus(k)
                whole = k in needed or element.holds and element.closed
                own = not (whole and not element.inert) and self._sets_aside(element, weights)
                element.beside = not element.inside and k != article and not parent.aside
                element.aside = own or parent.aside
                if not parent.aside:
                    items.append(Item(("=" if own else "") + element.name, labelled=element.inside))
        return items

    def _sets_aside(self, element: Element, weights: Weights) -> bool:
        return weights.sets_aside(element, weights.inside if element.inside else frozenset() if self.article else weights.open)

    def _needed(self, weights: Weights) -> set[int]:
        """The elements without which the article (or the page, if it has none) would have no paragraph.

        Of the paragraphs inside the fewest elements that would be set aside the first
        counts, and these elements stay. A paragraph is a ``p`` with words, or where there
        is none, whatever holds words itself. Menus and the like hold no paragraphs.
        """
        elements, article = self.elements, self.article
        with_text = {k for k, what in self.events if isinstance(what, str) and not what.isspace()}
        below = [0] * len(elements)  # elements around this one that would be set aside
        never = [False] * len(elements)
        for k, element in enumerate(elements[1:], 1):
            if article and not element.inside:
                continue
            below[k] = below[element.parent] + self._sets_aside(element, weights)
            never[k] = never[element.parent] or element.name in NEVER_TEXT or element.hidden
        scope = [k for k, e in enumerate(elements) if (e.inside or k == article if article else True)
                 and not never[k] and not e.inert and e.words]
        found = [k for k in scope if elements[k].name == "p"] or [k for k in scope if k in with_text]
        if not found:
            return set()
        k, out = min(found, key=lambda k: (below[k], k)), set()
        while below[k]:
            out.add(k)
            k = elements[k].parent
        return out

    def _end_menus(self, k: int) -> None:
        while (k := self.elements[k].parent) >= 0:
            self.elements[k].aside = False


def items_of(page: str, weights: Weights) -> list[Item]:
    return Page(page).items(weights)


def best_region(items: list[Item], weights: Weights) -> tuple[int, int]:
    """The contiguous items with the largest sum, by one scan; the first of equal ones."""
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for i, item in enumerate(items):
        total += item.words * weights.word if item.kind == "text" else weights.tag(item.kind)
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, region = total, (start, i + 1)
    return region


def text_of(items: list[Item]) -> str:
    """The texts, with one space for white space and between blocks, none for inline tags."""
    parts = []
    for item in items:
        if item.kind == "text":
            parts.append(item.text)
        elif item.kind.lstrip("=/") not in INLINE or item.kind[0] == "=":
            parts.append(" ")
    return " ".join("".join(parts).split())


def extract(page: str, weights: Weights) -> str:
    items = items_of(page, weights)
    start, end = best_region(items, weights)
    return text_of(items[start:end])


def is_labelled(page: Column) -> Column:
    """Whether a page labels its article: one ``article``, or one ``main`` and no ``article``."""
    def times(name: str) -> Column:
        return F.regexp_count(page, F.lit(rf"(?i)<{name}[\s>]"))

    return F.coalesce((times("article") == 1) | ((times("article") == 0) & (times("main") == 1)), F.lit(False))


def learn(pages: list[str], epochs: int = 4, rate: float = 0.1, least: int = 10) -> Weights:
    """Weights from labelled pages; without any, the values that ``Weights`` starts with.

    A word of a class, id or role becomes a mark of elements set aside if at least
    ``least`` pages have it beside the article, and none inside or around it. Marks of
    elements with words inside a labelled article overrule the fixed hints there, and on
    pages without one if they are found in or around as many articles as beside them.
    """
    weights = Weights()
    beside, within, inside, apart = Counter(), Counter(), Counter(), Counter()
    kept: set[str] = set()
    for page in map(Page, pages):
        page.items(weights)
        elements = page.elements
        found = {m for e in elements if e.inside and e.words and not e.inert for m in e.marks}
        around = {m for e in elements if e.holds for m in e.marks} | elements[page.article].marks
        next_to = {m for e in elements if e.beside and not e.holds and not e.inert for m in e.marks}
        # What has the tag of an element that holds the article is not told from it by a class.
        tags = {e.name for e in elements if e.holds}
        alike = {m for e in elements if e.beside and e.name in tags for m in e.marks}
        inside.update(found)
        within.update(found | around)
        beside.update(next_to)
        kept.update({m for e in elements if e.inside and not e.inert for m in e.marks} | around | alike | set(CONTENT))
        apart.update(next_to - alike)
    weights.inside = frozenset(inside)
    weights.open = frozenset(m for m, n in within.items() if n >= beside[m])
    weights.aside = frozenset(m for m, n in apart.items() if m[0] == "." and n >= least and m not in kept)
    rows = [items_of(page, weights) for page in pages]
    inside, outside = Counter(), Counter()
    for items in rows:
        for item in items:
            if item.kind != "text":
                (inside if item.labelled else outside)[item.kind] += 1
    for kind in inside.keys() | outside.keys():
        odds = math.log((inside[kind] + 0.5) / (outside[kind] + 0.5))
        weights.tags[kind] = min(-0.05, 0.5 * odds - 0.1) if kind.strip("=/") not in CONTENT else min(-3.0, odds)
    for _ in range(epochs):
        wrong = 0
        for items in rows:
            marked = [i for i, item in enumerate(items) if item.labelled and item.words]
            if not marked:
                continue
            start, end = best_region(items, weights)
            truth = (marked[0], marked[-1] + 1)
            if (start, end) == truth:
                continue
            wrong += 1
            change = Counter(item.kind for item in items[truth[0]:truth[1]] if item.kind != "text")
            change.subtract(item.kind for item in items[start:end] if item.kind != "text")
            for kind, n in change.items():
                if n:
                    weights.tags[kind] = min(-0.01, weights.tag(kind) + math.copysign(rate, n))
        if not wrong:
            break
    return weights


def fit(pages: DataFrame, fit_pages: int = FIT_PAGES, fit_bytes: int = FIT_BYTES) -> Weights:
    """Learn from ``fit_pages`` of the labelled pages of up to ``fit_bytes`` bytes, drawn by hash, or from all if they are fewer.

    The share drawn follows from the number of such pages, a little above what is
    needed, and of the drawn ones those with the smallest hashes are taken.
    """
    short = pages.where(F.octet_length("html") <= fit_bytes).select("page_id", "html")
    count = short.where(is_labelled(F.col("html"))).count()
    if not count:
        return learn([])
    key = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    drawn = short.withColumn("share", hash_share(key, F.col("html"), F.lit("labelled")))
    drawn = drawn.where(F.col("share") < (1.25 * fit_pages + 50) / count).where(is_labelled(F.col("html")))
    found = drawn.orderBy("share", "page_id", "html").limit(fit_pages).collect()
    return learn([r["html"] for r in sorted(found, key=lambda r: (str(r["page_id"]), r["html"]))])


def extracted(pages: DataFrame, weights: Weights) -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` (its code points); null and wordless pages give an empty text.

    Repeated rows are read each, an empty table gives none, and columns of ``pages`` that
    bear the name of a result are replaced by it.
    """
    python_tasks(pages.sparkSession)

    @arrow_udf("string")
    def main_text(column: pa.Array) -> pa.Array:
        return pa.array([extract(raw.decode(), weights) for raw in documents(column)], pa.string())

    return pages.withColumn("text", main_text("html")).withColumn("n_chars", F.length("text").cast("long"))
