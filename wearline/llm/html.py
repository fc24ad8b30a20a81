"""Operator 2, main text of web pages by line-block distribution.

Markup is stripped into lines: every block-level tag begins a new one, so a page's lines are its
blocks of text. A line weighs its length without white space at the ends, times what its tags say: more
in a heading, paragraph or list item, less by its share of characters in links, nothing in a part that
is no main text by its tag, role or class (menus, page headers, footers, sidebars, notices, adverts,
forms, reader comments). Where a page has an ``article`` or ``main`` with text, lines outside weigh
nothing and each line inside has a least weight, so that the shortest paragraph shows on the curve; side
parts inside it are no place on the curve at all.

Over these weights runs a window of ``WINDOW`` lines. A region surges at the first line of weight whose
window passes the threshold (``THRESHOLD``, or half of the fullest window on pages where none passes
twice that); it dives where the window has gone empty, and ends with its last line of weight. The lines
of weight between surge and dive are kept. That is the only way in which text is chosen, on every page.

Character references are decoded once, after tags are gone; white space inside a block becomes one
space; blocks are joined by a line feed. ``br`` is white space, and so is the border of a table cell.
A page is read once from left to right, in time proportional to its length.

Defined cases: a null or empty page gives an empty text; a page without main text too; very long pages
are read whole; unclosed and wrongly nested tags close with the next element around them; an unclosed
quote ends with its tag, and a tag that never ends is text; an unclosed comment, script or style reaches
to the end; there are no ties, for lines are chosen by place; repeated rows give repeated results; an
empty table gives no row; other columns stay, one called ``text`` is replaced.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, extended, prepare, table, texts

WINDOW = 3
THRESHOLD = 80
#: Weight of a line that a region may begin or end with, where the threshold is whole.
LEAST = 25
#: A line with a larger share of its characters in links is no text, outside an article.
MAX_LINKS = 0.5
#: Times its length that a line of prose or of an article weighs, beside ``LEAST``.
PROSE_WEIGHT = 8
#: Elements whose lines are prose.
PROSE = frozenset("p li dd dt blockquote pre h1 h2 h3 h4 h5 h6 figcaption caption summary".split())
#: Elements whose id is an anchor and describes nothing.
ANCHORS = frozenset("p li h1 h2 h3 h4 h5 h6".split())

#: Elements whose content is never text on the page.
HIDDEN = frozenset("script style title noscript template iframe object svg math select option textarea button canvas audio video".split())
#: Elements that are no main text, with all they hold.
ASIDE = frozenset("nav footer aside form menu dialog".split())
#: Elements that begin and end a block.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
SPACED = frozenset("br td th wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Blocks that another of their kind closes, and so are never waited for.
LOOSE = frozenset("p li dt dd tr td th option".split())
#: Words of a class or id that mark a part as no main text.
CLASSES = frozenset(
    "ad ads advert advertisement adverts banner sponsor sponsored promo promotion cookie cookies consent gdpr notice alert sidebar menu nav navbar"
    " navigation breadcrumb breadcrumbs comment comments commentlist disqus replies respond share sharing social related newsletter subscribe signup popup"
    " modal footer masthead toolbar pagination pager login search widget widgets advertising adsbygoogle teaser teasers recommended".split()
)
#: Of these, the ones around which nothing is main text, not even an article.
COMMENTS = frozenset("comment comments commentlist disqus replies respond".split())
#: Words beside them that change nothing: inside an article, a name with any other word is not judged.
NEUTRAL = frozenset(
    "left right top bottom main site page global primary secondary box block list container wrapper wrap section bar button buttons link links content inner outer"
    " area form thread post posts slot unit item items group panel row col column header body text title icon icons js mobile desktop sticky fixed floating".split()
)
#: Words that turn a class name into a description of the page: "has-sidebar", "no-comments".
_OF_PAGE = frozenset("has with without no not layout".split())
#: Elements that are never judged by their class.
_PAGE = frozenset("html body main".split())
#: Such words that count only where they are the whole class or id, or name the site's or the page's part.
HEADERS = frozenset("header site-header page-header top-bar topbar".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_ENDS = re.compile(r"""[>"']""")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORDS = re.compile(r"[a-z]+")


class Scanner:
    """The tags of a page, from left to right; what is found to be nowhere ahead is not looked for again."""

    def __init__(self, page: str) -> None:
        self.page, self.low = page, None
        self.gone: set[str] = set()

    def find(self, what: str, at: int) -> int:
        if what in self.gone:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.gone.add(what)
        return found

    def closing(self, tag: str, at: int) -> int:
        """The end of the next closing tag of that name, the page's end where there is none."""
        if self.low is None:
            # Letter by letter, so that places stay the same.
            self.low = self.page.translate(_LOWER)
        what = f"</{tag}"
        while what not in self.gone:
            found = self.low.find(what, at)
            if found < 0:
                self.gone.add(what)
                break
            at = found + len(what)
            if not (self.page[at : at + 1].isalnum() or self.page[at : at + 1] == "-"):
                end = self.find(">", at)
                return end + 1 if end >= 0 else len(self.page)
        return len(self.page)

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """Start, end, slash, name and attributes of the next tag from ``at`` on; comments and declarations have no name."""
        page = self.page
        while (start := self.find("<", at)) >= 0:
            if page.startswith("<!--", start):
                end = self.find("-->", start + 4)
                return start, end + 3 if end >= 0 else len(page), "", "", ""
            if page.startswith(("<!", "<?"), start):
                end = self.find(">", start)
                if end >= 0:
                    return start, end + 1, "", "", ""
            elif (tag := _TAG.match(page, start)) is not None and (plain := self.find(">", tag.end())) >= 0:
                end = self._end(tag.end())
                end = plain if end < 0 else end
                return start, end + 1, tag[1], tag[2].lower(), page[tag.end() : end]
            at = start + 1
        return None

    def _end(self, at: int) -> int:
        """Where a tag's ``>`` outside of quotes is; -1 where a quote is never closed."""
        while (found := _ENDS.search(self.page, at)) is not None:
            if found[0] == ">":
                return found.start()
            at = self.find(found[0], found.end()) + 1
            if not at:
                return -1
        return -1


_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


class Line(NamedTuple):
    text: str
    #: In a part that is no main text.
    aside: bool
    #: In an article or main element.
    article: bool
    #: Characters in links.
    linked: int
    #: In a heading, paragraph, list item or the like.
    prose: bool


NOT, SOFT, HARD = 0, 1, 2
_MAIN = re.compile(r"""(?<![\w-])role\s*=\s*["']?main\b""", re.IGNORECASE)


def _side_part(tag: str, attributes: str, inside: bool) -> int:
    """Whether an element and all it holds is no main text: by its class only (an article in it is text again), or for certain."""
    if tag in ASIDE:
        return HARD
    if tag == "header" and not inside:
        return SOFT
    if not attributes or tag in _PAGE:
        return NOT
    found = NOT
    for match in _ATTRIBUTE.finditer(attributes):
        name, value = match[1].lower(), (match[2] or "").strip("\"'").lower()
        if name == "hidden" or name == "role" and value in ROLES:
            return HARD
        if name == "class" or name == "id" and tag not in ANCHORS:
            for own in value.split():
                words = set(_WORDS.findall(own))
                if not _OF_PAGE.isdisjoint(words):
                    continue
                if inside and not words <= _KNOWN:
                    continue
                if not COMMENTS.isdisjoint(words):
                    return HARD
                if tag != "article" and (not CLASSES.isdisjoint(words) or not inside and own in HEADERS):
                    found = SOFT
    return found


_KNOWN = CLASSES | COMMENTS | NEUTRAL


def lines_of(page: str) -> list[Line]:
    """The blocks of a page in order, but for empty ones."""
    out: list[Line] = []
    text: list[str] = []
    linked = 0
    block = ""
    #: Open elements: tag, what kind of side part, an article, and the soft side parts around it that it ends.
    stack: list[tuple[str, int, bool, int]] = []
    soft = hard = articles = links = 0
    at, end = 0, len(page)
    scanner = Scanner(page)

    def close_line() -> None:
        nonlocal linked
        joined = " ".join(references.unescape("".join(text)).split()) if text else ""
        if joined:
            out.append(Line(joined, soft + hard > 0, articles > 0, linked, block in PROSE))
        text.clear()
        linked = 0

    def push(tag: str, side: int, article: bool) -> None:
        nonlocal soft, hard, articles
        ended = soft if article else 0
        soft += (side == SOFT) - ended
        hard += side == HARD
        articles += article
        stack.append((tag, side, article, ended))

    def pop_to(depth: int) -> None:
        nonlocal soft, hard, articles
        while len(stack) > depth:
            _, side, article, ended = stack.pop()
            soft += ended - (side == SOFT)
            hard -= side == HARD
            articles -= article

    while at < end:
        found = scanner.next(at)
        if found is None:
            text.append(page[at:])
            break
        start, stop, slash, tag, attributes = found
        if start > at:
            text.append(page[at:start])
            if links:
                linked += start - at
        at = stop
        if not tag:
            continue
        if tag in HIDDEN:
            if not slash and not attributes.endswith("/"):
                at = scanner.closing(tag, at)
            continue
        if tag == "a":
            links = 0 if slash else 1
            continue
        if tag in SPACED:
            text.append(" ")
            continue
        if tag not in BLOCKS:
            if tag in VOID or attributes.endswith("/"):
                continue
            # Inline elements are followed only where their class says that they are no main text.
            if not slash:
                if attributes and (side := _side_part(tag, attributes, articles > 0)):
                    close_line()
                    push(tag, side, False)
            elif stack and stack[-1][0] == tag:
                close_line()
                pop_to(len(stack) - 1)
            continue
        close_line()
        if tag in VOID:
            continue
        if not slash:
            block = tag
            side = _side_part(tag, attributes, articles > 0)
            if tag in LOOSE and not side:
                continue
            push(tag, side, not side and (tag in ("article", "main") or _MAIN.search(attributes) is not None))
        else:
            depth = len(stack) - 1
            while depth >= 0 and stack[depth][0] != tag:
                depth -= 1
            if depth >= 0:
                pop_to(depth)
            block = stack[-1][0] if stack else ""
    close_line()
    return out


def regions(weights: list[int], threshold: int, least: int = 1, window: int = WINDOW) -> list[tuple[int, int]]:
    """Surge and dive points: from a line of weight whose window passes the threshold to the last one before an empty window."""
    n, out, start = len(weights), [], None
    total = sum(weights[:window])

    def end(at: int) -> None:
        while weights[at - 1] < least:
            at -= 1
        out.append((start, at))

    for i in range(n):
        if start is None:
            if total >= threshold and weights[i] >= least:
                start = i
        elif not total:
            end(i)
            start = None
        total += (weights[i + window] if i + window < n else 0) - weights[i]
    if start is not None:
        end(n)
    return out


def curve(lines: list[Line]) -> list[tuple[str, int]]:
    """The places of a page's curve: texts and their weights."""
    article = any(line.article and not line.aside for line in lines)
    out = []
    for line in lines:
        length = len(line.text)
        if article:
            if line.article and line.aside:
                continue
            weight = LEAST + PROSE_WEIGHT * length if line.article else 0
        elif line.aside or line.linked > MAX_LINKS * length:
            weight = 0
        else:
            plain = length - min(length, line.linked)
            weight = LEAST + PROSE_WEIGHT * plain if line.prose and plain else plain
        out.append((line.text, weight))
    return out


def main_text(page: str, threshold: int = THRESHOLD) -> str:
    places = curve(lines_of(page))
    weights = [w for _, w in places]
    fullest = max((sum(weights[i : i + WINDOW]) for i in range(len(weights))), default=0)
    threshold = max(1, min(threshold, fullest // 2))
    least = max(1, LEAST * threshold // THRESHOLD)
    return "\n".join(places[i][0] for start, end in regions(weights, threshold, least) for i in range(start, end) if weights[i])


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add text, the main text of each page; other columns stay, a column of that name is replaced."""
    prepare(pages.sparkSession)
    pages = pages.drop("text") if html != "text" else pages
    k = pages.columns.index(html)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, k):
            found = pa.array([main_text(p) if p else "" for p in texts(batch.column(k))], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, "text"])

    return pages.mapInArrow(run, extended(pages, "text string"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


QUERIES = {"op2_html_extraction": op2_html_extraction}
