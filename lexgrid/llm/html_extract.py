"""Main text of web pages: flat text blocks, classified by a decision tree over each block and its neighbours.

A page is cut into blocks at block-level tags in one pass; what is open around a block is kept as running marks, so a
block costs the same at any depth. A block is described by its own and both neighbours' word counts and link densities
and by marks of where it stands: the innermost telling element around it (an article, a menu, ...), the innermost
telling class, id or role, heading, list item. The tree is grown from the small labelled table below, whose layouts
come with and without such marks; no mark decides alone.
"""

from __future__ import annotations

import functools
import html as entities
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexgrid.llm.tree import decide, grow

# Element and attribute names of HTML, and common words of class and id attributes.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr blink".split())
SPACING = {"br", "wbr"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup; a page that ends in one has no text after it.
RAW = set("script style title textarea iframe xmp".split())
HIDDEN_TAGS = set("head template noscript noembed noframes object svg canvas audio video datalist".split())
CONTENT_TAGS = {"article", "main"}
BOILER_TAGS = set("nav footer aside form select button fieldset menu dialog".split())
CONTENT_WORDS = set("article articlebody content post entry story main body text".split())
TITLE_WORDS = set("header heading headline title".split())
BOILER_WORDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs pagination pager "
    "sidebar aside widget related recommended share sharing social footer header masthead topbar toolbar cookie cookies consent gdpr notice alert popup modal overlay "
    "newsletter subscribe subscription paywall login signup register search form copyright legal hidden skip tags".split()
)
COMMENT_WORDS = set("comment comments reply replies respond disqus discussion".split())
BOILER_ROLES = set("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: First words of class names that tell of something elsewhere, as in has-sidebar.
ELSEWHERE = set("has with without no is not".split())
#: An open one of these ends at the next of the same group; an open paragraph ends at any block.
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

# A quote without its mate counts as a plain character, so that one broken tag changes no other.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"<>]*+"|'[^'<>]*+'|"[^"]*+"(?=[\s/>])|'[^']*+'(?=[\s/>])|["'])*+)>""")
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|itemprop|style|hidden|aria-hidden)(?![^\s=>/])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_NAME = re.compile(r"[a-z]+")
_ENDS = {tag: re.compile(f"</{tag}\\b[^>]*>", re.I) for tag in RAW}


class Marks(NamedTuple):
    """What the open elements say. place and named are 1 for content, -1 for anything else, 0 if nothing tells."""

    tag: str = ""
    place: int = 0
    named: int = 0
    comment: bool = False
    heading: bool = False
    item: bool = False
    hidden: bool = False
    article: bool = False
    #: Whether a link was open when the element began.
    linked: bool = False


class Block(NamedTuple):
    text: str
    words: int
    link_words: int
    marks: Marks

    @property
    def density(self) -> float:
        return self.link_words / self.words


def _named(values: list[str]) -> tuple[int, bool]:
    """(mark, comment) of class and id values. In a name of content and title words, such as entry-header, the title counts."""
    mark, comment = 0, False
    for value in values:
        for name in value.split():
            words = _NAME.findall(name)
            if not words or words[0] in ELSEWHERE:
                continue
            comment |= not COMMENT_WORDS.isdisjoint(words)
            content = not CONTENT_WORDS.isdisjoint(words)
            if content and not TITLE_WORDS.isdisjoint(words):
                mark = mark or 1
            elif not BOILER_WORDS.isdisjoint(words):
                mark = -1
            elif content:
                mark = mark or 1
    return mark, comment


@functools.lru_cache(4096)
def _attributes(raw: str) -> tuple[int, bool, bool]:
    """(mark, comment, hidden) of an element's attributes."""
    values, boiler, main, hidden = [], False, False, False
    for m in _ATTRIBUTE.finditer(raw):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id", "itemprop"):
            values.append(value)
        elif key == "role":
            boiler |= value in BOILER_ROLES
            main |= value in ("main", "article")
        elif key == "style":
            hidden |= "display:none" in value.replace(" ", "") or "visibility:hidden" in value.replace(" ", "")
        elif key == "hidden":
            hidden |= value != "until-found"
        else:
            boiler |= value == "true"
    mark, comment = _named(values)
    return (-1 if boiler else 1 if main else mark), comment, hidden


class _Page:
    """The open elements of a page and its blocks so far."""

    def __init__(self):
        self.stack: list[Marks] = [Marks()]
        self.open_tags: dict[str, int] = {}
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.linked: list[str] = []
        self.link = False

    def text(self, raw: str) -> None:
        if raw and not self.stack[-1].hidden:
            raw = entities.unescape(raw) if "&" in raw else raw
            self.parts.append(raw)
            if self.link:
                self.linked.append(raw)

    def flush(self) -> None:
        words = "".join(self.parts).split()
        if words:
            self.blocks.append(Block(" ".join(words), len(words), len("".join(self.linked).split()), self.stack[-1]))
        self.parts, self.linked = [], []

    def push(self, marks: Marks) -> None:
        self.stack.append(marks)
        self.open_tags[marks.tag] = self.open_tags.get(marks.tag, 0) + 1

    def pop(self) -> Marks:
        last = self.stack.pop()
        self.open_tags[last.tag] -= 1
        self.link = last.linked
        return last

    def open(self, tag: str, raw: str) -> None:
        if tag in SPACING:
            self.text(" ")
            return
        mark, comment, hidden = _attributes(raw) if raw and not raw.isspace() else (0, False, False)
        if tag in INLINE:
            if tag == "a":
                self.link = True
            # An inline element that is hidden or marked as an advert and the like is a block of its own.
            if tag in VOID or not (hidden or comment or mark < 0):
                return
        self.flush()
        if tag in VOID:
            return
        if tag not in INLINE:
            while self.stack[-1].tag == "p" or self.stack[-1].tag in SELF_CLOSING.get(tag, ()):
                self.pop()
        around = self.stack[-1]
        place, named, article = around.place, around.named, around.article
        if tag in CONTENT_TAGS:
            place, named, article = 1, 0, True
        elif tag in BOILER_TAGS or (tag == "header" and not article):
            place = -1
        if mark and tag not in ("body", "html"):
            named = mark
        comment = (around.comment or (comment and tag not in ("body", "html"))) and tag != "main"
        self.push(Marks(tag, place, named, comment, around.heading or tag in HEADINGS, around.item or tag == "li", around.hidden or hidden or tag in HIDDEN_TAGS, article, self.link))

    def close(self, tag: str) -> None:
        if tag == "a":
            self.link = False
        if tag in SPACING:
            self.text(" ")
        if tag in INLINE and not self.open_tags.get(tag):
            return
        if tag in INLINE and self.stack[-1].tag != tag:
            return
        self.flush()
        if self.open_tags.get(tag):
            while self.pop().tag != tag:
                pass


def blocks(source: str | None) -> list[Block]:
    """The page's non-empty text blocks in page order. Broken markup is taken as far as it goes; a null page has none."""
    page, at, source = _Page(), 0, source or ""
    last = source.rfind(">")
    while (lt := source.find("<", at)) >= 0:
        page.text(source[at:lt])
        following = source[lt + 1 : lt + 2]
        if lt > last and (following.isalpha() or following in ("/", "!", "?")):
            at = len(source)
        elif source.startswith("<!--", lt):
            end = source.find("-->", lt + 4)
            at = end + 3 if end >= 0 else len(source)
        elif following in ("!", "?"):
            at = source.find(">", lt) + 1
        elif m := _TAG.match(source, lt):
            tag, at = m[2].lower(), m.end()
            if m[1]:
                page.close(tag)
            elif tag in RAW and not m[3].endswith("/"):
                page.flush()
                end = _ENDS[tag].search(source, at)
                at = end.end() if end else len(source)
            else:
                page.open(tag, m[3])
        elif following == "/":
            at = source.find(">", lt) + 1
        else:
            page.text("<")
            at = lt + 1
    page.text(source[at:])
    page.flush()
    return page.blocks


FEATURES = ("words", "words_before", "words_after", "density", "density_before", "density_after", "words_near", "place", "named", "comment", "heading", "item")


def features(found: list[Block]) -> list[tuple]:
    rows = []
    for i, b in enumerate(found):
        p, n = found[i - 1] if i else None, found[i + 1] if i + 1 < len(found) else None
        m = b.marks
        before, after = p.words if p else 0, n.words if n else 0
        rows.append((b.words, before, after, b.density, p.density if p else 0.0, n.density if n else 0.0, before + b.words + after, m.place, m.named, m.comment, m.heading, m.item))
    return rows


# The labelled table: layouts of pages. A line is the markup around a block (outermost first), its words, how many of
# them are linked, and whether the block is main text.
_ARTICLE = [("article h1", 7, 0, 1), ("article p", 42, 0, 1), ("article p", 3, 0, 1), ("article h2", 4, 0, 1), ("article p", 65, 4, 1), ("article ul li", 6, 0, 1), ("article ul li", 2, 2, 1), ("article ul li", 3, 3, 1), ("article p", 4, 0, 1), ("article p", 1, 0, 1), ("article blockquote p", 18, 0, 1), ("article figure figcaption", 8, 0, 1), ("article p", 9, 9, 1), ("article p", 120, 0, 1)]
_LINKED_ARTICLE = [("article header h1", 5, 5, 1), ("article p", 20, 12, 1), ("article p", 2, 2, 1), ("article p", 33, 0, 1), ("article p", 1, 0, 1)]
_DIVS = [("div.content h1", 6, 0, 1), ("div.content p", 38, 0, 1), ("div.content p", 2, 0, 1), ("div.content p", 80, 5, 1), ("div.content ul li", 5, 0, 1), ("div.content ul li", 3, 3, 1), ("div.content p", 9, 0, 1), ("div.content p", 1, 0, 1), ("div.content p", 26, 0, 1)]
_ENTRY = [("div.entry div.entry-header h1", 5, 0, 1), ("div.entry p", 47, 0, 1), ("div.entry p", 16, 0, 1), ("div.entry p", 3, 0, 1)]
_PLAIN = [("h1", 6, 0, 1), ("div p", 55, 2, 1), ("div p", 31, 0, 1), ("div p", 12, 0, 1), ("div p", 74, 3, 1), ("div h2", 4, 0, 1), ("div p", 48, 0, 1), ("div p", 2, 0, 1), ("div p", 60, 0, 1)]
_BODY_ONLY = [("div p", 57, 0, 1), ("div p", 57, 0, 1)]
_TITLED = [("div h1", 3, 0, 1), ("div p", 22, 0, 1), ("div p", 5, 0, 1), ("div ul li", 9, 0, 1), ("div ul li", 12, 1, 1), ("div p", 140, 2, 1), ("div h3", 2, 0, 1), ("div p", 35, 8, 1)]
_MENU = [("nav ul li", 1, 1, 0), ("nav ul li", 2, 2, 0), ("nav ul li", 1, 1, 0), ("nav p", 9, 0, 0), ("nav div", 24, 24, 0)]
_BARE_MENU = [("ul li", 1, 1, 0), ("ul li", 2, 2, 0), ("ul li", 1, 1, 0), ("ul li", 3, 3, 0)]
_ONE_WORD_MENU = [("ul li", 1, 1, 0), ("ul li", 1, 1, 0), ("ul li", 1, 1, 0)]
_MENU_LINE = [("div", 6, 6, 0), ("div", 18, 17, 0)]
_TEASERS = [("ul li", 8, 8, 0), ("ul li", 11, 11, 0), ("ul li", 6, 6, 0), ("div", 14, 12, 0)]
_HEADER = [("header h1", 3, 0, 0), ("header p", 8, 0, 0), ("header div", 3, 3, 0)]
_FOOTER = [("footer", 9, 2, 0), ("footer p", 34, 0, 0), ("footer p", 3, 3, 0), ("footer div", 70, 6, 0)]
_ASIDE = [("aside h3", 2, 0, 0), ("aside p", 26, 0, 0), ("aside ul li", 5, 5, 0), ("div.sidebar p", 45, 0, 0), ("div.sidebar h3", 3, 0, 0), ("div.sidebar p", 15, 2, 0)]
_NOTICES = [("div.ad", 12, 0, 0), ("div.ad", 3, 0, 0), ("div.cookie-notice p", 30, 1, 0), ("div.banner", 6, 6, 0), ("div.promo p", 64, 2, 0), ("form p", 10, 0, 0), ("form div", 2, 0, 0), ("form p", 41, 0, 0)]
_COMMENTS = [("section.comments h2", 2, 0, 0), ("section.comments p", 40, 0, 0), ("div.comment p", 15, 1, 0), ("div.comment p", 4, 0, 0), ("div.comments article p", 28, 0, 0), ("div.comment p", 90, 0, 0)]
_INSIDE = [("article div.ad p", 14, 0, 0), ("article aside p", 33, 0, 0), ("article div.share", 3, 3, 0), ("article section.comments p", 52, 0, 0), ("article form p", 7, 0, 0), ("article footer p", 11, 2, 0), ("article nav ul li", 2, 2, 0), ("article div.notice p", 21, 0, 0), ("article div.ad p", 80, 0, 0)]
# A telling name around several long texts says little: they stand in a wrapper of the page.
_WRAPPED = [("div.sidebar-layout div p", 115, 1, 1), ("div.sidebar-layout div p", 130, 4, 1), ("div.sidebar-layout div p", 126, 0, 1), ("div.sidebar-layout div p", 140, 0, 1)]
# Short adverts between and inside paragraphs, also inline ones.
_SPRINKLED = [("div.ad", 1, 0, 0), ("article p", 2, 0, 1), ("article p span.ad", 2, 0, 0), ("article p", 1, 0, 1), ("div.ad", 4, 4, 0), ("article p", 48, 0, 1), ("article p span.promo", 3, 0, 0), ("article p", 64, 0, 1), ("div.ad", 9, 0, 0), ("article p", 90, 0, 1), ("article div.notice p", 2, 0, 0)]
_SPRINKLED_DIVS = [("div.ad", 2, 0, 0), ("div.content p", 1, 0, 1), ("div.ad", 20, 0, 0), ("div.content p", 70, 0, 1), ("div.ad", 3, 0, 0), ("div.content p", 85, 0, 1), ("div.banner", 16, 1, 0), ("div p", 95, 0, 1), ("div.ad", 1, 0, 0), ("div p", 60, 0, 1), ("div.newsletter p", 30, 0, 0), ("div p", 45, 0, 1), ("div.cookie", 5, 0, 0)]
# Paragraphs with many links, in pages without marks.
_REFERENCES = [("div p", 50, 10, 1), ("div p", 44, 20, 1), ("div p", 62, 0, 1), ("div p", 28, 9, 1), ("div p", 75, 30, 1), ("div p", 40, 4, 1)]
LAYOUTS = [
    _HEADER + _MENU + _NOTICES + _ARTICLE + _ASIDE + _COMMENTS + _FOOTER,
    _MENU + _NOTICES[:2] + _ARTICLE[:2] + _INSIDE[:4] + _ARTICLE[2:] + _INSIDE[4:] + _FOOTER,
    _MENU + _LINKED_ARTICLE + _FOOTER,
    _ONE_WORD_MENU + _LINKED_ARTICLE + _COMMENTS,
    _HEADER + _BARE_MENU + _DIVS + _COMMENTS + _ASIDE + _FOOTER,
    _ONE_WORD_MENU + _DIVS[1:] + _TEASERS,
    _MENU + _ENTRY + _ASIDE + _FOOTER,
    _BARE_MENU + _ENTRY + _TEASERS + _FOOTER,
    _BARE_MENU + _PLAIN + _BARE_MENU + _FOOTER,
    _MENU_LINE + _PLAIN + _BARE_MENU,
    _ONE_WORD_MENU + _BODY_ONLY,
    _BARE_MENU + _BODY_ONLY + _TEASERS + _BARE_MENU,
    _ONE_WORD_MENU + _TITLED + _ONE_WORD_MENU,
    _MENU_LINE + _TITLED + _TEASERS + _MENU_LINE,
    _NOTICES + _PLAIN + _COMMENTS + _ASIDE,
    _MENU + _WRAPPED + _ASIDE + _FOOTER,
    _ONE_WORD_MENU + _WRAPPED + _TEASERS,
    _SPRINKLED + _FOOTER,
    _BARE_MENU + _SPRINKLED_DIVS + _BARE_MENU,
    _NOTICES[:1] + _SPRINKLED_DIVS + _COMMENTS,
    _ONE_WORD_MENU + _REFERENCES + _TEASERS,
    _ARTICLE[:2] + _FOOTER,
    _DIVS + _BARE_MENU,
    _TITLED,
]
#: Each layout comes with texts of these lengths, blocks of up to SHORT words as they are.
SCALES, SHORT = (0.5, 1.0, 2.5), 4


def _markup(layout: list[tuple], scale: float = 1.0) -> str:
    out = []
    for path, words, linked, _ in layout:
        tags = [(*step.split("."), "")[:2] for step in path.split()]
        if words > SHORT:
            words, linked = round(words * scale), round(linked * scale)
        text = f"<a href=x>{'w ' * linked}</a>" * (linked > 0) + "w " * (words - linked)
        out += [f'<{t} class="{c}">' if c else f"<{t}>" for t, c in tags] + [text] + [f"</{t}>" for t, _ in reversed(tags)]
    return "".join(out)


def labelled() -> tuple[np.ndarray, np.ndarray]:
    x, y = [], []
    for layout in LAYOUTS:
        for scale in SCALES:
            found = features(blocks(_markup(layout, scale)))
            if len(found) != len(layout):
                raise ValueError("a layout's blocks don't match its labels")
            x += found
            y += [row[3] for row in layout]
    return np.array(x, float), np.array(y, float)


@functools.cache
def trained_tree():
    return grow(*labelled(), depth=12, least=2)


def main_text(source: str | None, tree=None) -> str:
    """The main text of a page: its kept blocks in page order, joined by a space; empty if there are none."""
    tree = trained_tree() if tree is None else tree
    found = blocks(source)
    return " ".join([b.text for b, row in zip(found, features(found)) if decide(tree, row) >= 0.5])


def extract(df: DataFrame, html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page of a table with page_id, url and `html`.

    A null or empty page, or one without main text, has an empty text. A page of any length is read once, from start to
    end. Repeated rows give repeated results; other columns are not read; an empty table gives an empty result.
    """
    tree = trained_tree()

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py(), tree) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return df.select("page_id", "url", html).mapInArrow(run, "page_id long, url string, text string, n_chars long")
