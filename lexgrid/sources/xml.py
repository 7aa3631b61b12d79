"""Act XML (Akoma Ntoso): metadata by paths, sections by a tree walk in an Arrow batch, block-aware text."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Callable
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

SECTIONS = "array<struct<id:string,title:string,text:string,references:array<string>>>"
# Element names of the format; blank lines or line ends that go before and after an element.
BEFORE = {
    **dict.fromkeys(("level", "article", "chapter", "part", "book", "annex", "doc", "component", "h1", "h2", "h3", "p", "h4", "h5", "h6", "heading", "subheading", "paragraph", "num", "content"), 2),
    **dict.fromkeys(("listintroduction", "item", "blocklist", "br"), 1),
}
AFTER = {
    **dict.fromkeys(("p", "h1", "h2", "h3", "h4", "h5", "h6", "level", "article", "paragraph", "heading", "subheading", "blocklist", "item", "num", "content"), 2),
    "listintroduction": 1,
}
NOTE = "authorialNote"
LEVEL = "level"
CONTAINERS = ("mainBody", "conclusions", "body", "doc")
JOINTS = (" ", "\n", "\n\n")


def _parsed(source: str | None) -> ET.Element | None:
    """The tree with names without their namespaces; None for broken markup."""
    try:
        root = ET.fromstring(source or "")
    except ET.ParseError:
        return None
    for e in root.iter():
        if e.tag[0] == "{":
            e.tag = e.tag.rpartition("}")[2]
    return root


def _own(e: ET.Element, nested: bool = True) -> list[ET.Element]:
    """e and its descendants in document order; without those of levels inside it unless `nested`."""
    if nested or all(x is e for x in e.iter(LEVEL)):
        return list(e.iter())
    found, todo = [], [e]
    while todo:
        x = todo.pop()
        found.append(x)
        todo += [c for c in reversed(x) if c.tag != LEVEL]
    return found


def _first(e: ET.Element, *names: str) -> ET.Element | None:
    return next((x for x in e.iter() if x.tag in names), None)


@cache
def _breaks(name: str) -> tuple[int, int]:
    return BEFORE.get(name.lower(), 0), AFTER.get(name.lower(), 0)


def markup_text(e: ET.Element, nested: bool = True, own: list[ET.Element] | None = None) -> str:
    """Text in which elements stand apart as their names ask: pieces are joined by a blank, a line end or an empty line.

    Of the breaks between two pieces the strongest holds. Notes are left out, and levels inside with what follows them
    directly unless `nested`. If there is a body, its content alone is read. Names have no namespace; `own` is _own(e, nested).
    """
    start = next((x for x in (_own(e, nested) if own is None else own) if x.tag in CONTAINERS), None)
    out: list[str] = []
    gap = 0
    # Elements to enter, text to write and breaks to make after them.
    todo: list[ET.Element | str | int] = []

    def enter(x: ET.Element) -> None:
        for child in reversed(x):
            if nested or child.tag != LEVEL:
                if child.tail:
                    todo.append(child.tail)
                todo.append(child)
        if x.text:
            todo.append(x.text)

    if start is None:
        todo.append(e)
    else:
        enter(start)
    while todo:
        x = todo.pop()
        kind = x.__class__
        if kind is int:
            gap = max(gap, x)
        elif kind is str:
            piece = " ".join(x.split())
            if piece:
                out += [JOINTS[gap], piece] if out else [piece]
                gap = 0
        elif x.tag != NOTE:
            before, after = _breaks(x.tag)
            gap = max(gap, before)
            if after:
                todo.append(after)
            enter(x)
    return "".join(out)


def _raw(e: ET.Element) -> str:
    return " ".join("".join(e.itertext()).split())


def _references(whole: ET.Element, scope: list[ET.Element]) -> list[str]:
    """Links of the notes of `whole`, in order, once each, that also stand in the scope."""
    inside = {x.get("href") for x in scope if x.get("href")}
    links = [r.get("href") for n in whole.iter(NOTE) for r in n.iter("ref")] if inside else []
    return [h for h in dict.fromkeys(links) if h in inside]


def _level(e: ET.Element) -> dict:
    """The title is the level's number, or its heading where the number is blank."""
    number, head = e.find("num"), e.find("heading")
    title = f"Level {e.get('eId')}" if number is None else _raw(number)
    if head is not None and (number is None or not title):
        title = _raw(head)
    own = _own(e, nested=False)
    return {"id": e.get("eId"), "title": title, "text": markup_text(e, nested=False, own=own), "references": _references(e, own)}


def _annex(e: ET.Element, place: int) -> dict:
    """The title is that of the preface, or its number; the text goes up to the first level or component of the body."""
    preface = next((c for c in e if c.tag == "preface"), None)
    named = [] if preface is None else [x for x in preface.iter() if x.tag == "h1"]
    named = named or [c for c in e if c.tag == "h1"]
    if not named and preface is not None:
        blocks = [b for c in preface if c.tag == "container" for b in c if b.tag == "block" and b.get("name") == "num"]
        named = [x for b in blocks for x in b if x.tag == "num"] or [x for x in preface.iter() if x.tag == "num"]
    body = next(filter(lambda x: x is not None, (_first(e, n) for n in CONTAINERS)))
    end = next((i for i, c in enumerate(body) if c.tag in (LEVEL, "component")), len(body))
    scope = ET.Element(body.tag, body.attrib)
    scope.text = body.text
    scope.extend(body[:end])
    return {"id": f"annex_{place}", "title": _raw(named[0]) if named else f"Allegato {place}", "text": markup_text(scope), "references": _references(e, list(scope.iter()))}


def parse_sections(source: str | None) -> list[dict]:
    """Annexes by their place, then levels with an eId, ordered by id as text; broken XML gives none.

    A level's text and links leave out the levels inside it, which are sections of their own.
    """
    root = _parsed(source)
    return [] if root is None else _sections(root)


def _sections(root: ET.Element) -> list[dict]:
    is_annex = lambda x: x.tag == "doc" and x.get("name") == "annex"
    annexes = [x for c in root.iter("component") for x in c if is_annex(x)] or [x for x in root.iter("doc") if x is not root and is_annex(x)]
    levels = [x for x in root.iter(LEVEL) if x is not root and x.get("eId")]
    found = [_annex(x, i) for i, x in enumerate(annexes, 1)] + list(map(_level, levels))
    return sorted(found, key=lambda s: (not s["id"].startswith("annex_"), s["id"]))


def _applied(df: DataFrame, xml: str, kind: str, one: Callable[[ET.Element | None], object]) -> Column:
    """What `one` makes of each tree, or of None for broken markup; batches go straight to Arrow.

    Marked as not deterministic, else a filter that the optimizer draws from an explode would parse every row once more.
    """
    wanted = to_arrow_type(_parse_datatype_string(kind))

    @F.arrow_udf(kind)
    def run(sources: pa.Array) -> pa.Array:
        return pa.array([one(_parsed(x)) for x in sources.to_pylist()], wanted)

    return run.asNondeterministic()(F.col(xml))


def acts(df: DataFrame, xml: str = "xml") -> DataFrame:
    """df with law_url, decision_date and sections, the markup of each row parsed once."""
    both = lambda root: _metadata(root) | {"sections": [] if root is None else _sections(root)}
    return df.withColumn("_m", _applied(df, xml, f"law_url string, decision_date string, sections {SECTIONS}", both)).select(*df.columns, "_m.law_url", "_m.decision_date", "_m.sections")


def sections(df: DataFrame, xml: str = "xml", out: str = "sections") -> DataFrame:
    return df.withColumn(out, _applied(df, xml, SECTIONS, lambda root: [] if root is None else _sections(root)))


def text(df: DataFrame, xml: str = "xml", out: str = "text") -> DataFrame:
    """df with the block-aware text of well-formed markup; null for broken markup."""
    return df.withColumn(out, _applied(df, xml, "string", lambda root: None if root is None else markup_text(root)))


def parse_metadata(source: str | None) -> dict:
    return _metadata(_parsed(source))


def _metadata(root: ET.Element | None) -> dict:
    """law_url and decision_date: of several places in the metadata the first that has a value; none in broken XML."""
    if root is None:
        return {"law_url": None, "decision_date": None}
    works = list(root.iter("FRBRWork"))
    work = lambda name: [e for w in works for e in w.iter(name)]
    dates = work("FRBRdate")
    urls = (e.get("value") for found in (lambda: work("FRBRuri"), lambda: work("FRBRthis"), lambda: root.iter("FRBRuri")) for e in found())
    days = (d for found in (lambda: [e.get("date") for e in dates if e.get("name") == "jolux:dateDocument"], lambda: [e.get("date") for e in dates], lambda: [e.get("date") for e in root.iter("docDate")]) for d in found())
    return {"law_url": next(filter(None, urls), None), "decision_date": next(filter(None, days), None)}


def metadata(df: DataFrame, xml: str = "xml") -> DataFrame:
    """df with law_url and decision_date; Spark's own path functions fail a job at the first broken file, so the tree is read here."""
    return df.withColumn("_m", _applied(df, xml, "law_url string, decision_date string", _metadata)).select(*df.columns, "_m.law_url", "_m.decision_date")
