"""Sections of an act in one pass over the blocks of its pages: heading lines open sections, notes at the foot are linked to them.

Input: doc, page, block, y0, height, text, one row a block. Windows and groups run within a document, and marks meet
notes by page and number inside it: nothing is joined, and no step holds more than one document's lines together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Headings that open a section, the name each gives it, and the forms of notes and of their marks.
HEADINGS = (
    ("Art", r"(?i)^\s*(?:Art\.|Articolo)\s+([\w\d.\-]+)\b"),
    ("Capitolo", r"(?i)^\s*Capitolo\s+([IVXLCDM\d]+)\b\.?"),
    ("Sezione", r"(?i)^\s*Sezione\s+(\d+)\b\.?"),
    ("Titolo", r"(?i)^\s*Titolo\s+([IVXLCDM\d]+(?:[\s_]?bis|[\s_]?ter|[\s_]?quater)?|terzo\s+a)\b\.?"),
    ("Allegato", r"(?i)^\s*Allegato\s+(\d+)\b\.?"),
    ("Roman", r"(?i)^\s*([IVXLCDM]+)\.?\s*$"),
)
#: How every heading starts.
OPENING = r"(?i)^\s*(?:Art|Capitolo|Sezione|Titolo|Allegato|[IVXLCDM]+\.?\s*$)"
NOTE = r"^(\d+)\s*(.*)$"
RAISED = "⁰¹²³⁴⁵⁶⁷⁸⁹"
YEAR_MARK = r"((?:19|20)\d{2})(\d)(?=[\s.,;!?:)]|$)"
MARK = r"(?<=\S)(\d+)(?=[\s.,;!?:)]|$)"
LARGEST_MARK = 499
FOOT = 0.85


def _squeezed(c: Column) -> Column:
    return F.trim(F.when(c.rlike(r"[^\S ]|  "), F.regexp_replace(c, r"\s+", " ")).otherwise(c))


def _lines(blocks: DataFrame, foot: float) -> DataFrame:
    """One row a non-blank line, its place among those of the block in `line`; `low` lines stand at the foot."""
    low = F.coalesce(F.col("y0") > foot * F.col("height"), F.lit(False))
    solid = F.filter(F.transform(F.split("text", "\n"), _squeezed), lambda x: x != "")
    return blocks.select("doc", "page", "block", "y0", low.alias("low"), F.posexplode(solid).alias("line", "text"))


def _note_line(text: Column) -> tuple[Column, Column]:
    """(number of the note that a line opens, or null; what the line adds to its note): digits, plain or raised, open one."""
    raised = F.regexp_extract(text, f"^([{RAISED}]+)", 1)
    number = F.when(text.rlike(NOTE), F.regexp_extract(text, NOTE, 1)).when(raised != "", F.translate(raised, RAISED, "0123456789"))
    part = F.when(text.rlike(NOTE), F.regexp_extract(text, NOTE, 2)).when(raised != "", F.trim(F.regexp_replace(text, f"^[{RAISED}]+", ""))).otherwise(text)
    return number, part


def heading(text: Column) -> Column:
    """The name of the section that a line opens, or null: its kind and its number, dots and blanks as underscores."""
    name = lambda k, p: F.when(text.rlike(p), F.concat(F.lit(f"{k}_"), F.regexp_replace(F.regexp_extract(text, p, 1), r"[.\s]+", "_")))
    return F.when(text.rlike(OPENING), F.coalesce(*[name(k, p) for k, p in HEADINGS]))


def marks(text: Column) -> tuple[Column, Column]:
    """(numbers of notes, text without those that cling to a year): marks are digits at the end of a word, from 1 to 499."""
    plain = F.regexp_replace(text, YEAR_MARK, "$1")
    every = F.concat(F.regexp_extract_all(text, F.lit(YEAR_MARK), F.lit(2)), F.regexp_extract_all(plain, F.lit(MARK), F.lit(1)))
    return F.filter(every, lambda m: (F.length(m) < 10) & m.cast("bigint").between(1, LARGEST_MARK)), plain


def sections(blocks: DataFrame, foot: float = FOOT, linked: bool = True) -> DataFrame:
    """doc, at, marker, title, text, notes: the sections of each document in order.

    Lines before the first heading are the section Preamble. A block of the foot whose lines all belong to notes leaves
    the text; one that starts before the first note stays whole. `notes` are the texts of the section's marks by page
    and number, equal ones once; a mark without a note on its page has none. A document without lines has no row; a
    block without text, height or place at the foot counts as body. Without `linked` notes leave the text all the same, but
    aren't listed.
    """
    order = Window.partitionBy("doc").orderBy("page", "y0", "block", "line")
    up_to = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    # Every window has this order or the start of it and every group starts with doc, so rows are dealt out and sorted once.
    rows = _lines(blocks, foot).withColumn("seq", F.row_number().over(order))
    number, part = _note_line(F.col("text"))
    rows = rows.select("*", F.when(F.col("low"), number).alias("number"), F.when(F.col("low"), part).alias("part"))
    in_page, numbered = up_to(Window.partitionBy("doc", "page").orderBy("y0", "block", "line")), F.col("number").isNotNull()
    rows = rows.select("*", F.sum(F.when(numbered, 1).otherwise(0)).over(in_page).alias("run"), F.first(F.when(numbered, F.struct("y0", "block", "line")), ignorenulls=True).over(in_page).alias("opens"))
    # A block is open if the page's first note starts after it, or in it but not at its start.
    is_open = (F.col("run") == 0) | ((F.col("block") == F.col("opens.block")) & (F.col("y0") == F.col("opens.y0")) & (F.col("opens.line") > 0))
    rows = rows.withColumn("body", ~F.col("low") | is_open)
    found, plain = marks(F.col("text"))
    rows = rows.withColumn("name", F.when(F.col("body"), heading(F.col("text"))))
    rows = rows.withColumn("at", F.sum(F.when(F.col("name").isNotNull(), 1).otherwise(0)).over(up_to(order)))
    if not linked:
        texts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "plain"))), lambda r: r["plain"])
        whole = rows.where("body").select("doc", "at", "seq", "name", F.col("text").alias("title"), plain.alias("plain")).groupBy("doc", "at")
        return _named(whole.agg(F.min(F.struct("seq", "name", "title")).alias("first"), texts.alias("texts")))
    # A line of an open block may be part of the text and of a note.
    kinds = F.array_compact(F.array(F.when(F.col("body"), F.struct(F.lit(True).alias("body"), F.col("at").alias("key"))), F.when(F.col("low") & (F.col("run") > 0), F.struct(F.lit(False).alias("body"), F.col("run").alias("key")))))
    rows = rows.select("doc", "page", "seq", "name", F.col("text").alias("title"), "number", F.explode(kinds).alias("k"), F.when(F.col("body"), found).alias("marks"), F.when(F.col("body"), plain).alias("plain"), "part")
    rows = rows.select("doc", "page", "k.body", "k.key", "seq", "name", "title", "number", "marks", F.when(F.col("k.body"), F.col("plain")).otherwise(F.col("part")).alias("part"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "part"))), lambda r: r["part"])
    pieces = rows.groupBy("doc", "page", "body", "key").agg(
        F.min(F.when(F.col("body"), F.struct("seq", "name", "title"))).alias("first"), F.max("number").alias("number"), F.array_distinct(F.flatten(F.collect_list(F.when(F.col("body"), F.col("marks"))))).alias("marks"), ordered.alias("parts")
    )
    # Of several notes of a number the last that isn't empty counts, and only numbers of marks do.
    note = _squeezed(F.array_join("parts", " "))
    wanted = ~F.col("body") & (F.length("number") < 10) & F.col("number").cast("bigint").between(1, LARGEST_MARK) & (note != "")
    text = F.struct("key", "first", "marks", F.array_join("parts", "\n").alias("text"))
    pages = pieces.groupBy("doc", "page").agg(F.collect_list(F.when(F.col("body"), text)).alias("texts"), F.collect_list(F.when(wanted, F.struct(F.col("key").alias("run"), "number", note.alias("note")))).alias("notes"))
    placed = pages.select("doc", "page", "notes", F.explode("texts").alias("t"))
    last = lambda m: F.array_max(F.filter("notes", lambda n: n["number"] == m))["note"]
    links = F.filter(F.transform("t.marks", lambda m: F.struct(F.col("page"), m.cast("int").alias("n"), last(m).alias("note"))), lambda x: x["note"].isNotNull())
    whole = placed.select("doc", F.col("t.key").alias("at"), "page", "t.first", "t.text", links.alias("links")).groupBy("doc", "at").agg(
        F.min("first").alias("first"), F.array_sort(F.collect_list(F.struct("first.seq", "text"))).alias("r"), F.array_sort(F.flatten(F.collect_list("links"))).alias("links")
    )
    # The least page and number of equal notes gives their place.
    return _named(whole.withColumns({"texts": F.transform("r", lambda r: r["text"]), "notes": F.array_distinct(F.transform("links", lambda x: x["note"]))}))


def _named(whole: DataFrame) -> DataFrame:
    opened = F.col("at") > 0
    marker, title = F.when(opened, F.col("first.name")).otherwise("Preamble"), F.when(opened, F.col("first.title")).otherwise("Preamble")
    return whole.select("doc", "at", marker.alias("marker"), title.alias("title"), F.array_join("texts", "\n").alias("text"), *[c for c in whole.columns if c == "notes"])
