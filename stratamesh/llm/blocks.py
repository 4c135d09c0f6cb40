"""Main text of web pages: flat text blocks classified by a small decision tree.

A page is cut into blocks at block-level tags. Each block has its word count and link density, those of the blocks
before and after it, and what encloses it: an article or main element, or an element that carries menus, headers,
footers, sidebars, notices, adverts, forms or comments (by tag, role, class or id). A CART tree fitted on
``LABELLED`` below, once for each session, says which blocks are main text. What encloses a block is one feature among the others: on pages that mark nothing,
counts and neighbours decide, and they may overrule marks where the table says so.

Null and empty html and pages without main text give an empty text. Elements without an end tag end where HTML ends them (a paragraph at the next block, an item at the next item or its
list's end, a cell at the next cell); truncated pages are read to their end; unclosed
comments, scripts and tags swallow the rest. Pages may be of any length. Repeated rows are reported each; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html as htmllib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML: elements that begin and end a block, elements whose content is no text, elements without content.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
SKIPPED = frozenset("script style template noscript iframe object svg math head title textarea select option button datalist canvas audio video".split())
RAW = frozenset("script style textarea title iframe noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags, roles and words of class or id that tell what an element carries.
ASIDE_TAGS = frozenset("nav header footer aside form dialog menu search".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
ASIDE_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side aside menu nav navbar navigation breadcrumb breadcrumbs header masthead footer notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments disqus replies reply respond form search widget pagination pager toolbar copyright legal disclaimer skip".split())
MAIN_TAGS = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Fixed values of HTML: for a start tag, the open elements that it ends and those that it doesn't look beyond; elements whose inside end tags don't leave.
_CELLS, _ROWS, _SECTIONS = frozenset(("td", "th")), frozenset(("td", "th", "tr")), frozenset(("td", "th", "tr", "tbody", "thead", "tfoot"))
IMPLIED = {"li": (frozenset(("li",)), frozenset(("ul", "ol", "menu", "table"))), "dt": (frozenset(("dt", "dd")), frozenset(("dl", "table"))), "dd": (frozenset(("dt", "dd")), frozenset(("dl", "table")))}
IMPLIED |= {"td": (_CELLS, frozenset(("tr", "table"))), "th": (_CELLS, frozenset(("tr", "table"))), "tr": (_ROWS, frozenset(("table",))), "tbody": (_SECTIONS, frozenset(("table",))), "thead": (_SECTIONS, frozenset(("table",))), "tfoot": (_SECTIONS, frozenset(("table",)))}
SCOPE = frozenset("table td th caption html template".split())
#: Block elements that may stand in a paragraph's place don't end it: those of tables and bodies.
KEEPS_P = frozenset("body caption html tbody td tfoot th thead tr".split())

_TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?|<[!?][^>]*>?", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-a-zA-Z0-9_:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[^\W_]+")
_SPACE = re.compile(r"\s+")

FEATURES = ("aside", "main", "page_has_main", "heading", "words", "links", "words_before", "links_before", "words_after", "links_after")

#: The labelled table: values of FEATURES (link densities in percent) and 1 for main text. Written by hand after looking at pages.
LABELLED = [
    # inside an article: every block is main text, however short
    (0, 1, 1, 1, 9, 0, 12, 0, 60, 0, 1), (0, 1, 1, 0, 60, 0, 9, 0, 45, 0, 1), (0, 1, 1, 0, 1, 0, 60, 0, 30, 0, 1), (0, 1, 1, 0, 3, 0, 1, 0, 2, 0, 1),
    (0, 1, 1, 0, 140, 2, 3, 0, 25, 0, 1), (0, 1, 1, 0, 12, 60, 50, 0, 40, 0, 1), (0, 1, 1, 1, 2, 0, 0, 0, 3, 0, 1), (0, 1, 1, 0, 25, 0, 30, 0, 7, 0, 1),
    (0, 1, 1, 0, 5, 100, 30, 0, 30, 0, 1), (0, 1, 1, 0, 2, 0, 25, 0, 0, 0, 1), (0, 1, 1, 1, 5, 100, 0, 0, 80, 0, 1), (0, 1, 1, 0, 500, 0, 9, 0, 5, 0, 1),
    # asides of any length, inside an article or not
    (1, 0, 1, 0, 1, 100, 0, 0, 1, 100, 0), (1, 0, 1, 0, 2, 100, 1, 100, 1, 100, 0), (1, 0, 1, 0, 11, 0, 1, 100, 9, 0, 0), (1, 0, 1, 0, 14, 0, 25, 0, 0, 0, 0),
    (1, 1, 1, 0, 20, 0, 60, 0, 60, 0, 0), (1, 1, 1, 0, 70, 0, 60, 0, 30, 0, 0), (1, 1, 1, 1, 3, 0, 40, 0, 4, 100, 0), (1, 1, 1, 0, 4, 100, 3, 0, 5, 100, 0),
    (1, 0, 0, 0, 40, 0, 60, 0, 30, 0, 0), (1, 0, 0, 0, 6, 50, 0, 0, 90, 0, 0), (1, 0, 0, 1, 4, 0, 2, 100, 70, 0, 0), (1, 0, 0, 0, 120, 0, 80, 0, 60, 0, 0),
    # on a page with an article: what is outside of it
    (0, 0, 1, 0, 12, 0, 0, 0, 9, 0, 0), (0, 0, 1, 0, 45, 0, 3, 100, 60, 0, 0), (0, 0, 1, 1, 6, 0, 2, 100, 9, 0, 0), (0, 0, 1, 0, 3, 100, 25, 0, 4, 100, 0),
    (0, 0, 1, 0, 90, 0, 12, 0, 30, 0, 0), (0, 0, 1, 0, 2, 0, 40, 0, 0, 0, 0),
    # pages without an article: long blocks with few links, and short ones among them
    (0, 0, 0, 0, 60, 0, 9, 0, 45, 0, 1), (0, 0, 0, 0, 35, 5, 50, 0, 30, 0, 1), (0, 0, 0, 0, 150, 1, 0, 0, 0, 0, 1), (0, 0, 0, 0, 22, 0, 40, 0, 40, 0, 1),
    (0, 0, 0, 0, 4, 0, 60, 0, 45, 0, 1), (0, 0, 0, 0, 7, 0, 30, 0, 80, 3, 1), (0, 0, 0, 1, 6, 0, 2, 100, 60, 0, 1), (0, 0, 0, 1, 5, 0, 50, 0, 50, 0, 1),
    (0, 0, 0, 0, 18, 10, 25, 0, 35, 0, 1), (0, 0, 0, 0, 90, 8, 4, 100, 3, 100, 1), (0, 0, 0, 0, 28, 0, 5, 0, 90, 0, 1), (0, 0, 0, 0, 45, 20, 60, 0, 55, 0, 1),
    (0, 0, 0, 1, 8, 0, 0, 0, 24, 0, 1), (0, 0, 0, 0, 16, 0, 6, 0, 20, 0, 1), (0, 0, 0, 0, 30, 0, 3, 0, 3, 0, 1), (0, 0, 0, 0, 24, 0, 2, 100, 2, 0, 1),
    (0, 0, 0, 0, 55, 12, 30, 0, 3, 0, 1), (0, 0, 0, 0, 19, 0, 24, 0, 2, 0, 1), (0, 0, 0, 0, 80, 30, 2, 100, 9, 0, 1), (0, 0, 0, 0, 21, 25, 0, 0, 30, 0, 1),
    (0, 0, 0, 0, 3, 0, 22, 0, 25, 0, 1), (0, 0, 0, 0, 9, 0, 20, 0, 18, 0, 1), (0, 0, 0, 0, 1, 0, 35, 0, 50, 0, 1), (0, 0, 0, 1, 2, 0, 0, 0, 40, 0, 1),
    # pages without an article: link lists, labels and foot lines
    (0, 0, 0, 0, 2, 100, 1, 100, 3, 100, 0), (0, 0, 0, 0, 1, 100, 0, 0, 2, 100, 0), (0, 0, 0, 0, 4, 100, 60, 0, 2, 100, 0), (0, 0, 0, 0, 9, 80, 4, 100, 5, 100, 0),
    (0, 0, 0, 0, 5, 0, 3, 100, 4, 100, 0), (0, 0, 0, 0, 3, 0, 2, 100, 1, 100, 0), (0, 0, 0, 0, 20, 70, 3, 100, 40, 0, 0), (0, 0, 0, 0, 40, 65, 12, 90, 9, 80, 0),
    (0, 0, 0, 0, 2, 100, 0, 0, 30, 0, 0), (0, 0, 0, 0, 4, 100, 30, 0, 60, 0, 0), (0, 0, 0, 0, 12, 90, 50, 0, 45, 0, 0), (0, 0, 0, 0, 25, 60, 40, 0, 40, 0, 0),
    (0, 0, 0, 0, 2, 0, 30, 0, 0, 0, 0), (0, 0, 0, 0, 5, 0, 60, 0, 0, 0, 0), (0, 0, 0, 0, 3, 50, 45, 0, 0, 0, 0), (0, 0, 0, 0, 8, 0, 50, 0, 2, 100, 0),
    (0, 0, 0, 0, 4, 0, 2, 100, 35, 0, 0), (0, 0, 0, 0, 6, 45, 30, 0, 30, 0, 0), (0, 0, 0, 1, 3, 100, 40, 0, 30, 0, 0), (0, 0, 0, 1, 2, 0, 40, 0, 2, 100, 0),
    (0, 0, 0, 0, 6, 0, 4, 100, 0, 0, 0), (0, 0, 0, 1, 3, 0, 5, 100, 2, 100, 0), (0, 0, 0, 0, 2, 0, 5, 0, 3, 0, 0), (0, 0, 0, 0, 7, 0, 3, 0, 4, 0, 0),
    # the first block of text after a menu
    (0, 0, 0, 0, 40, 0, 2, 100, 40, 0, 1), (0, 0, 0, 0, 60, 0, 1, 100, 45, 0, 1), (0, 0, 0, 0, 28, 0, 3, 100, 50, 0, 1), (0, 0, 0, 0, 90, 4, 2, 100, 30, 0, 1), (0, 0, 0, 0, 35, 0, 2, 100, 2, 0, 1),
    # lists of links inside an article: its neighbours tell them from a link in the text
    (0, 1, 1, 0, 2, 100, 3, 100, 2, 100, 0), (0, 1, 1, 0, 1, 100, 40, 0, 2, 100, 0), (0, 1, 1, 0, 3, 100, 2, 100, 0, 0, 0), (0, 1, 1, 0, 2, 100, 2, 100, 60, 0, 0), (0, 1, 1, 0, 6, 100, 5, 100, 7, 100, 0), (0, 1, 1, 0, 1, 100, 1, 100, 1, 100, 0),
    (0, 1, 1, 0, 4, 80, 3, 100, 3, 100, 0),
    # blocks of real pages, one of each sort: beside the article, and in it
    (1, 0, 1, 0, 1, 100, 0, 0, 1, 100, 0), (1, 0, 1, 0, 1, 100, 1, 100, 1, 100, 0), (1, 0, 1, 0, 1, 100, 1, 100, 8, 0, 0), (1, 0, 1, 0, 1, 100, 1, 100, 12, 0, 0), (1, 0, 1, 0, 5, 0, 1, 100, 2, 0, 0), (1, 0, 1, 0, 8, 0, 1, 100, 10, 0, 0),
    (1, 0, 1, 0, 8, 0, 2, 0, 0, 0, 0), (1, 0, 1, 0, 9, 0, 1, 100, 12, 0, 0), (1, 0, 1, 0, 9, 0, 8, 0, 0, 0, 0), (1, 0, 1, 0, 11, 0, 25, 0, 0, 0, 0), (1, 0, 1, 0, 12, 0, 1, 100, 1, 0, 0), (1, 0, 1, 0, 12, 0, 1, 100, 11, 0, 0),
    (1, 0, 1, 0, 12, 0, 1, 100, 12, 0, 0), (1, 0, 1, 0, 12, 0, 2, 0, 0, 0, 0), (1, 0, 1, 0, 13, 0, 64, 0, 0, 0, 0), (1, 0, 1, 0, 15, 0, 8, 0, 0, 0, 0),
    (0, 1, 1, 0, 1, 0, 45, 0, 30, 0, 1), (0, 1, 1, 0, 2, 0, 2, 0, 8, 0, 1), (0, 1, 1, 0, 2, 0, 2, 0, 12, 0, 1), (0, 1, 1, 0, 2, 0, 47, 0, 1, 0, 1), (0, 1, 1, 0, 3, 0, 7, 0, 1, 0, 1), (0, 1, 1, 0, 3, 0, 7, 0, 9, 0, 1),
    (0, 1, 1, 0, 3, 0, 8, 0, 38, 0, 1), (0, 1, 1, 0, 3, 0, 15, 0, 8, 0, 1), (0, 1, 1, 0, 6, 0, 6, 0, 10, 0, 1), (0, 1, 1, 0, 7, 0, 7, 0, 3, 0, 1), (0, 1, 1, 0, 8, 0, 3, 0, 10, 0, 1), (0, 1, 1, 0, 8, 0, 3, 0, 15, 0, 1),
    (0, 1, 1, 0, 8, 0, 12, 0, 3, 0, 1), (0, 1, 1, 0, 8, 0, 51, 0, 11, 0, 1), (0, 1, 1, 0, 9, 0, 12, 0, 39, 0, 1), (0, 1, 1, 0, 11, 0, 8, 0, 36, 0, 1), (0, 1, 1, 0, 12, 0, 9, 0, 9, 0, 1), (0, 1, 1, 0, 15, 0, 1, 0, 3, 0, 1),
    (0, 1, 1, 0, 17, 0, 8, 0, 2, 0, 1), (0, 1, 1, 0, 21, 0, 131, 0, 3, 0, 1), (0, 1, 1, 0, 25, 0, 52, 0, 11, 0, 1), (0, 1, 1, 0, 30, 0, 1, 0, 37, 0, 1), (0, 1, 1, 0, 32, 0, 36, 0, 52, 0, 1), (0, 1, 1, 0, 36, 0, 11, 0, 32, 0, 1),
    (0, 1, 1, 0, 37, 0, 1, 0, 9, 0, 1), (0, 1, 1, 0, 45, 0, 8, 0, 1, 0, 1), (0, 1, 1, 0, 47, 0, 37, 0, 2, 0, 1), (0, 1, 1, 0, 51, 0, 10, 0, 8, 0, 1), (0, 1, 1, 0, 52, 0, 32, 0, 25, 0, 1), (0, 1, 1, 0, 57, 0, 65, 0, 5, 0, 1),
    (0, 1, 1, 0, 72, 0, 9, 0, 16, 0, 1), (0, 1, 1, 0, 76, 0, 1, 0, 10, 0, 1), (0, 1, 1, 0, 82, 0, 3, 0, 108, 0, 1), (0, 1, 1, 1, 1, 0, 12, 0, 1, 0, 1), (0, 1, 1, 1, 2, 0, 5, 0, 2, 0, 1), (0, 1, 1, 1, 6, 0, 8, 0, 9, 0, 1),
    (0, 1, 1, 1, 6, 0, 12, 0, 6, 0, 1), (0, 1, 1, 1, 10, 0, 8, 0, 51, 0, 1), (0, 1, 1, 1, 11, 0, 12, 0, 149, 0, 1), (0, 1, 1, 1, 12, 0, 9, 0, 184, 0, 1), (0, 1, 1, 1, 12, 0, 12, 0, 184, 0, 1),
]

def fit(rows=LABELLED, depth: int = 12):
    """A CART tree by Gini impurity: (feature, threshold, below, above) or a label."""
    labels = [r[-1] for r in rows]
    if depth == 0 or len(set(labels)) < 2:
        return int(2 * sum(labels) >= len(labels)) if rows else 0
    best = None
    for f in range(len(FEATURES)):
        values = sorted({r[f] for r in rows})
        for a, b in zip(values, values[1:], strict=False):
            cut = (a + b) / 2
            low, high = [r[-1] for r in rows if r[f] <= cut], [r[-1] for r in rows if r[f] > cut]
            cost = sum(2 * sum(x) * (len(x) - sum(x)) / len(x) for x in (low, high))
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, cut)
    if best is None:
        return int(2 * sum(labels) >= len(labels))
    _, f, cut = best
    return f, cut, fit([r for r in rows if r[f] <= cut], depth - 1), fit([r for r in rows if r[f] > cut], depth - 1)


def decide(tree, row) -> int:
    while not isinstance(tree, int):
        f, cut, low, high = tree
        tree = low if row[f] <= cut else high
    return tree


def _marks(name: str, raw: str, in_main: bool) -> tuple[bool, bool, bool]:
    """(aside, main, hidden) of an opening tag."""
    aside = name in ASIDE_TAGS and not (name == "header" and in_main)
    main, hidden = name in MAIN_TAGS, False
    if raw and not raw.isspace():
        for m in _ATTRIBUTE.finditer(raw):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key in ("class", "id"):
                aside = aside or (name not in ("body", "html", "article", "main") and not ASIDE_WORDS.isdisjoint(re.split(r"[^a-z]+", value)))
            elif key == "role":
                main, aside = main or value in ("main", "article"), aside or value in ASIDE_ROLES
            elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                hidden = True
    return aside, main, hidden


class Block:
    __slots__ = ("aside", "heading", "links", "main", "text", "words")

    def __init__(self, text, linked, aside, main, heading):
        self.text, self.aside, self.main, self.heading = text, aside, main, heading
        self.words = len(_WORDS.findall(text))
        self.links = min(100, round(100 * len(_WORDS.findall(linked)) / self.words)) if self.words and linked else 0


def blocks(page: str) -> list[Block]:
    """The flat blocks of a page, in order; text that is never shown is left out. Elements end where HTML says so, with or without an end tag."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # open elements: name, aside, main, skipped
    open_marks = [0, 0, 0]  # how many of them are asides, main, skipped
    text: list[str] = []
    linked: list[str] = []
    anchor, heading, at = 0, False, 0

    def flush():
        if text:
            plain = _SPACE.sub(" ", htmllib.unescape("".join(text))).strip()
            if plain:
                out.append(Block(plain, htmllib.unescape(" ".join(linked)), open_marks[0] > 0, open_marks[1] > 0, heading))
            text.clear()
            linked.clear()

    def close(i: int):
        """End the open elements from the i-th on."""
        if any(s[1] or s[2] or s[3] for s in stack[i:]):
            flush()  # what follows isn't enclosed by them
            for s in stack[i:]:
                for j in range(3):
                    open_marks[j] -= s[j + 1]
        del stack[i:]

    def find(names, border) -> int:
        """The innermost open element with one of the names, not looked for beyond a border (-1: none)."""
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                return i
            if stack[i][0] in border:
                break
        return -1

    end = len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        begin = m.start() if m else end
        if begin > at and not open_marks[2]:
            text.append(page[at:begin])
            if anchor:
                linked.append(page[at:begin])
        if m is None:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name == "a":
                anchor = 0
            if name in BLOCK:
                flush()
                heading = False
            # an end tag ends what is open inside its element; one of an inline element doesn't end blocks
            i = find((name,), SCOPE if name in BLOCK else BLOCK)
            if i >= 0:
                close(i)
            continue
        if name == "a":
            anchor = 1
        elif name == "br":
            text.append(" ")
        if name in BLOCK:
            flush()
            heading = name in HEADINGS
            if name not in KEEPS_P and (i := find(("p",), SCOPE)) >= 0:
                close(i)
            if name in IMPLIED:
                inner, border = IMPLIED[name]
                while (i := find(inner, border)) >= 0:
                    close(i)
        if name in VOID or m[3].endswith("/"):
            continue
        aside, main, hidden = _marks(name, m[3], open_marks[1] > 0)
        gone = hidden or name in SKIPPED
        if name in RAW:  # to its end tag, whatever stands between
            shut = re.compile(rf"</{name}[^a-zA-Z0-9]", re.I).search(page, at)
            at = page.find(">", shut.start()) + 1 if shut else end
            at = at or end
            continue
        if (aside or main or gone) and name not in BLOCK and not open_marks[2]:
            flush()
        stack.append((name, aside, main, gone))
        for j, mark in enumerate((aside, main, gone)):
            open_marks[j] += mark
    flush()
    return out


def main_text(page: str | None, tree) -> str:
    found = blocks(page) if page else []
    has_main = int(any(b.main for b in found))
    kept = []
    for i, b in enumerate(found):
        before, after = found[i - 1] if i else None, found[i + 1] if i + 1 < len(found) else None
        row = (int(b.aside), int(b.main), has_main, int(b.heading), b.words, b.links, before.words if before else 0, before.links if before else 0, after.words if after else 0, after.links if after else 0)
        if decide(tree, row):
            kept.append(b.text)
    return "\n".join(kept)


def _extract(tree):
    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py(), tree) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, tree=None) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(_extract(tree if tree is not None else fit()), "page_id long, url string, text string, n_chars long")


def op1(spark, sf_dir: str) -> DataFrame:
    """op1_blocks: the main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
