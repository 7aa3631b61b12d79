"""From page trees to sections, references and document classes; one row a span, ordered within its document.

A page tree is pages > blocks > lines > spans. spans() flattens it once; everything after is columns and windows over
(doc, seq), so no step walks a tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexgrid.functions import ids
from lexgrid.operators import sequences

SPAN = "struct<hierarchical_id:string,text:string,font:string,size:double,flags:int,bbox:array<double>,is_superscript:boolean>"
LINE = f"struct<hierarchical_id:string,bbox:array<double>,spans:array<{SPAN}>>"
BLOCK = f"struct<hierarchical_id:string,bbox:array<double>,lines:array<{LINE}>>"
PAGE = f"struct<page_number:int,hierarchical_id:string,blocks:array<{BLOCK}>>"
PAGES = f"array<{PAGE}>"

# Labels of references, ends of headers, headings and phrases of the three languages' acts.
REFERENCE_LABELS = ("RS", "FF", "RU", "CS")
HEADER_TEXTS = ("RU ", "RO ", "FF ", "RS ")
PREAMBLE_ENDS = ("decreta:", "ordina:", "stabilisce:")
MODIFIES = r"(?i)è modificat[ao]\s+come\s+segue:"
ROMAN_LINE = r"(?i)^\s*(?:(?:I|V|X){1,5}|L|C|D|M)\.?\s*$"
ARTICLE_LINE = r"(?i)^\s*Art\.\s*\d+[a-z]?\.?\s*$"
SECTION_LINE = r"(?i)^\s*(Sezione|Capitolo|Chapter|Section|Titel|Abschnitt)\s+\d+"
LAW_LIST_LINE = r"(?i)^\s*\d+\.\s+(Legge|Codice|Ordinanza|Procedura|Regolamento|Costituzione)\b"
FIRST_SECTION = r"(?i)^\s*(Sezione\s+\d+|Art\.\s*\d+|(I|II|III|IV|V|VI|VII|VIII|IX|X)($|\s|\.))"
#: Where a span stands in its document.
PLACE = ("page", "block", "line", "span")
BOLD = r"(-BoldMT|-Bold|bold|Bold)$"


def spans(df: DataFrame, doc: str = "doc", pages: str = "pages") -> DataFrame:
    """doc, page, block, line, span, id, text, bold, superscript, y0, block_y0, seq: one row a span, in reading order."""
    return page_spans(df.select(F.col(doc).alias("doc"), F.posexplode(pages).alias("page", "p")))


def page_spans(rows: DataFrame) -> DataFrame:
    """The same from one row a page: doc, page, p. Rows come sorted by PLACE within doc, and steps that keep to it sort no more."""
    flat = (
        rows.select("doc", "page", F.posexplode("p.blocks").alias("block", "b"))
        .select("doc", "page", "block", F.element_at("b.bbox", 2).alias("block_y0"), F.posexplode("b.lines").alias("line", "l"))
        .select("doc", "page", "block", "block_y0", "line", F.posexplode("l.spans").alias("span", "s"))
    )
    raised = F.coalesce(F.col("s.is_superscript"), F.col("s.flags").bitwiseAND(1) != 0, F.lit(False))
    rows = flat.select(
        "doc", "page", "block", "line", "span", F.col("s.hierarchical_id").alias("id"), F.coalesce("s.text", F.lit("")).alias("text"),
        F.coalesce(F.col("s.font").rlike(BOLD), F.lit(False)).alias("bold"), raised.alias("superscript"), F.element_at("s.bbox", 2).alias("y0"), "block_y0",
    )
    return sequences.index(rows, "doc", *PLACE)


def is_element(text: Column, bold: Column) -> Column:
    """Bold or roman, with text."""
    return (text != "") & (bold | text.rlike(ids.ROMAN_MARKER))


def elements(flat: DataFrame, header_ends: list[str] = ()) -> DataFrame:
    """Bold or roman spans with text, after the last one that ends the header."""
    text = F.trim("text")
    kept = flat.withColumn("text", text).where(is_element(text, F.col("bold")))
    if not header_ends:
        return kept
    hit = F.lit(False)
    for p in header_ends:
        hit = hit | F.col("text").contains(p)
    return sequences.after_last(kept, "doc", "seq", hit)


def kind(text: Column, bold: Column) -> Column:
    """section, base or systematic reference, or null: the first rule that holds."""
    return (
        F.when(text.rlike(ids.ROMAN_MARKER) & ~bold, "section")
        .when(text.rlike(ids.ARTICLE_MARKER) & bold, "section")
        .when(text.rlike(ids.DIGIT_DOT_MARKER) & bold, "section")
        .when(text.rlike(ids.BASE_REFERENCE) & bold, "base")
        .when(text.rlike(ids.SYSTEMATIC_REFERENCE) & bold, "systematic")
    )


def marker(text: Column) -> Column:
    first = lambda p: F.when(text.rlike(p), F.regexp_extract(text, p, 1))
    return F.coalesce(first(ids.ROMAN_MARKER), first(ids.ARTICLE_MARKER), first(ids.DIGIT_DOT_MARKER))


def _tidy(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\W+|\W+$", ""), r"(?U)\s+", " ")


def title(found: DataFrame, ignore: list[str] = ()) -> DataFrame:
    """doc, title, title_id, title_seq: the elements of the first block before the first marker, ignored words left out."""
    is_marker = F.col("text").rlike(ids.ROMAN_MARKER) | (F.col("bold") & (F.col("text").rlike(ids.ARTICLE_MARKER) | F.col("text").rlike(ids.DIGIT_DOT_MARKER)))
    skip = F.lit(False)
    for p in ignore:
        skip = skip | F.col("text").contains(p)
    whole = Window.partitionBy("doc")
    rows = found.withColumn("_first", F.min(F.when(is_marker, F.col("seq"))).over(whole)).where(F.col("_first").isNull() | (F.col("seq") < F.col("_first"))).where(~skip)
    rows = rows.withColumn("_start", F.min(F.struct("seq", "page", "block")).over(whole))
    same = (F.col("page") == F.col("_start.page")) & (F.col("block") == F.col("_start.block"))
    rows = rows.withColumn("_other", F.min(F.when(~same, F.col("seq"))).over(whole)).where(same & (F.col("_other").isNull() | (F.col("seq") < F.col("_other"))))
    joined = rows.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("seq", "text", "id"))).alias("r"))
    text = F.array_join(F.transform("r", lambda x: x["text"]), " ")
    return joined.select("doc", _tidy(text).alias("title"), F.element_at("r", -1)["id"].alias("title_id"), F.element_at("r", -1)["seq"].alias("title_seq"))


def markers(found: DataFrame, ignore: list[str] = ()) -> DataFrame:
    """doc, seq, marker_id, marker, title: section marks; later elements of a mark's own block add to its title."""
    k = kind(F.col("text"), F.col("bold"))
    skip = F.lit(False)
    for p in ignore:
        skip = skip | F.col("text").contains(p)
    rows = found.withColumn("kind", k)
    up_to = Window.partitionBy("doc").orderBy(*PLACE).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("kind") == "section", F.struct("seq", "id", "text", "page", "block")), ignorenulls=True).over(up_to)
    rows = rows.withColumn("m", last).where("m is not null and page = m.page and block = m.block").where((F.col("kind") == "section") | (F.col("kind").isNull() & ~skip))
    own = F.when(F.col("kind") == "section", F.when(F.col("text").rlike(ids.DIGIT_DOT_MARKER), F.trim(F.regexp_extract("text", ids.DIGIT_DOT_MARKER, 2))).otherwise("")).otherwise(F.col("text"))
    grouped = rows.withColumn("part", own).groupBy("doc", F.col("m.seq").alias("seq"), F.col("m.id").alias("marker_id"), F.col("m.text").alias("text")).agg(F.array_sort(F.collect_list(F.struct(F.col("seq").alias("at"), "part"))).alias("parts"))
    title = F.array_join(F.filter(F.transform("parts", lambda p: p["part"]), lambda p: p != ""), " ")
    return grouped.select("doc", "seq", "marker_id", marker(F.col("text")).alias("marker"), F.trim(title).alias("title"))


def references(flat: DataFrame, found: DataFrame | None = None, annex: Column | None = None) -> DataFrame:
    """doc, seq, id, type, fn_number, text, blocks: references with label, footnote number and suffix digits.

    The label is the nearest earlier RS, FF, RU or CS in the reference's own or the previous block of the page; the
    number the nearest earlier digits before the label (or the reference) in the same blocks, not above the
    reference's ordinal unless the document is an annex; RU, FF and CS take digits that follow in the own or the next
    block, blanks skipped. `blocks` are those used, to be left out of section texts. Without `found` all elements of
    flat count, and no join is needed.
    """
    if found is None:
        rows = flat.withColumn("element", is_element(F.trim("text"), F.col("bold")))
    else:
        rows = flat.join(found.select("doc", "seq", F.lit(True).alias("element")), ["doc", "seq"], "left").withColumn("element", F.coalesce("element", F.lit(False)))
    return _with_references(rows, annex).where("ref is not null").select("doc", "seq", "page", "id", "ref.*")


def _with_references(rows: DataFrame, annex: Column | None) -> DataFrame:
    """rows (those of flat, with element) with ref: type, fn_number, text and blocks of a reference, or null.

    Every window has the order of PLACE or the start of it, so rows are sorted once; reach is a range of blocks.
    """
    t = F.trim("text")
    in_page = Window.partitionBy("doc", "page").orderBy(*PLACE[1:])
    earlier = Window.partitionBy("doc").orderBy(*PLACE).rowsBetween(Window.unboundedPreceding, 0)
    near = Window.partitionBy("doc", "page").orderBy("block").rangeBetween(-1, 0)
    place = F.struct("seq", "block", t.alias("t"))
    is_ref = F.col("element") & F.coalesce(kind(t, F.col("bold")).isin("base", "systematic"), F.lit(False))
    rows = rows.withColumn("_ref", is_ref).withColumn("_ordinal", F.sum(F.when(F.col("_ref"), 1).otherwise(0)).over(earlier))
    rows = rows.withColumn("_label", F.last(F.when(t.isin(*REFERENCE_LABELS), place), ignorenulls=True).over(in_page.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("_text", F.when(t != "", place)).withColumn("_next", F.expr("lead(_text) ignore nulls").over(in_page))
    rows = rows.withColumn("_label", F.when(F.col("_label.block") >= F.col("block") - 1, F.col("_label")))
    limit = F.lit(True) if annex is not None else F.length(t) < 10
    digits = F.collect_list(F.when(t.rlike("^[0-9]+$") & limit, F.struct(F.col("seq").alias("d_seq"), t.alias("d_text"), F.col("block").alias("d_block")))).over(near)
    before = F.coalesce("_label.seq", "seq")
    fits = lambda d: (d["d_seq"] < before) if annex is not None else (d["d_seq"] < before) & (d["d_text"].cast("bigint") <= F.col("_ordinal"))
    rows = rows.withColumn("_digits", digits).withColumn("_number", F.when(F.col("_ref"), F.array_max(F.filter("_digits", fits)))).drop("_digits")
    suffix = F.when(F.col("_label.t").isin("RU", "FF", "CS") & F.col("_next.t").rlike("^[0-9]+$") & (F.col("_next.block") <= F.col("block") + 1), F.col("_next"))
    ref = F.struct(
        F.col("_label.t").alias("type"), F.col("_number.d_text").alias("fn_number"), F.concat_ws(" ", t, suffix["t"]).alias("text"),
        F.array_compact(F.array("block", "_label.block", "_number.d_block", suffix["block"])).alias("blocks"),
    )
    return rows.withColumn("ref", F.when(F.col("_ref"), ref)).drop("_ref", "_ordinal", "_label", "_text", "_next", "_number")


def sections(flat: DataFrame, marks: DataFrame, titles: DataFrame, refs: DataFrame) -> DataFrame:
    """doc, marker, title, text, fn_indexes: preamble and marked sections; a document without marks is one Content section.

    Raised digits become [FN_n]; blocks used by references are left out, as are blocks 0 and 1 above y 100 of later
    pages: in a preamble always, elsewhere if they hold a collection name.
    """
    used = refs.select("doc", "page", F.explode("blocks").alias("block")).distinct()
    head = titles.select("doc", "title_id", "title_seq", F.col("title").alias("doc_title"))
    have = marks.groupBy("doc").agg(F.min("seq").alias("first_mark"))
    rows = flat.join(used, ["doc", "page", "block"], "left_anti").join(head, "doc", "left").join(have, "doc", "left")
    m = marks.select("doc", "seq", F.struct("seq", "marker_id", "marker", "title").alias("mark"))
    rows = rows.join(m, ["doc", "seq"], "full_outer")
    up_to = Window.partitionBy("doc").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("mark", F.last("mark", ignorenulls=True).over(up_to)).where(F.col("text").isNotNull())
    rows = rows.where(F.col("mark").isNotNull() | (F.col("seq") > F.coalesce("title_seq", F.lit(-1))))
    named = F.lit(False)
    for h in HEADER_TEXTS:
        named = named | F.col("text").contains(h)
    top = (F.col("page") > 0) & F.col("block").isin(0, 1) & (F.col("y0") < 100)
    preamble = F.col("mark").isNull() & F.col("first_mark").isNotNull()
    rows = rows.where(~F.coalesce(top & (preamble | named), F.lit(False)))
    is_note = F.col("superscript") & F.trim("text").rlike("^[0-9]+$")
    part = F.when(is_note, F.concat(F.lit("[FN_"), F.trim("text"), F.lit("]"))).otherwise(F.trim("text"))
    whole = F.when(F.col("mark").isNotNull(), F.struct(F.col("mark.seq").alias("at"), F.col("mark.marker").alias("marker"), F.col("mark.title").alias("title"))).when(
        F.col("first_mark").isNotNull(), F.struct(F.lit(-1).alias("at"), F.lit("Preamble").alias("marker"), F.lit("Preamble").alias("title"))
    ).otherwise(F.struct(F.lit(-1).alias("at"), F.lit("Content").alias("marker"), F.coalesce("doc_title", F.lit("Document Content")).alias("title")))
    grouped = rows.select("doc", whole.alias("s"), "seq", part.alias("part"), F.when(is_note, F.trim("text").cast("int")).alias("note")).groupBy("doc", "s").agg(
        F.array_sort(F.collect_list(F.struct("seq", "part"))).alias("parts"), F.array_sort(F.collect_set("note")).alias("fn_indexes")
    )
    text = F.trim(F.array_join(F.transform("parts", lambda p: p["part"]), " "))
    return grouped.select("doc", F.col("s.at").alias("at"), F.col("s.marker").alias("marker"), F.col("s.title").alias("title"), text.alias("text"), "fn_indexes").where((F.col("marker") != "Preamble") | (F.col("text") != ""))


def read(flat: DataFrame) -> DataFrame:
    """What sections() gives for flat with its own elements, markers, title and references, without joins.

    The windows keep the order of _with_references(); what was aggregated apart and joined is gathered with the section.
    """
    t = F.trim("text")
    rows = _with_references(flat.withColumn("element", is_element(t, F.col("bold"))), None)
    every = Window.partitionBy("doc").orderBy(*PLACE)
    whole, up_to = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), every.rowsBetween(Window.unboundedPreceding, 0)
    near = Window.partitionBy("doc", "page").orderBy("block").rangeBetween(-1, 1)
    rows = rows.withColumn("_used", F.array_distinct(F.flatten(F.collect_list("ref.blocks").over(near)))).withColumn("_used", F.array_contains("_used", F.col("block"))).drop("ref")
    is_marker = t.rlike(ids.ROMAN_MARKER) | (F.col("bold") & (t.rlike(ids.ARTICLE_MARKER) | t.rlike(ids.DIGIT_DOT_MARKER)))
    rows = rows.withColumn("_kind", F.when(F.col("element"), kind(t, F.col("bold"))))
    section = F.coalesce(F.col("_kind") == "section", F.lit(False))
    rows = rows.withColumn("_m", F.last(F.when(section, F.struct("seq", t.alias("text"), "page", "block")), ignorenulls=True).over(up_to))
    rows = rows.withColumn("_marked", F.max(section).over(whole)).withColumn("_first", F.min(F.when(F.col("element") & is_marker, F.col("seq"))).over(whole))
    # The title stands in the first block that has an element before the first marker.
    early = F.col("element") & (F.col("_first").isNull() | (F.col("seq") < F.col("_first")))
    rows = rows.withColumn("_start", F.min(F.when(early, F.struct("page", "block"))).over(whole))
    rows = rows.withColumn("_titled", F.coalesce(early & (F.struct("page", "block") == F.col("_start")), F.lit(False))).withColumn("_title_seq", F.max(F.when(F.col("_titled"), F.col("seq"))).over(whole))
    named = F.lit(False)
    for h in HEADER_TEXTS:
        named = named | F.col("text").contains(h)
    top = (F.col("page") > 0) & F.col("block").isin(0, 1) & (F.col("y0") < 100)
    mark = F.col("_m").isNotNull()
    kept = ~F.col("_used") & (mark | (F.col("seq") > F.coalesce("_title_seq", F.lit(-1)))) & ~F.coalesce(top & ((~mark & F.col("_marked")) | named), F.lit(False))
    is_note = F.col("superscript") & t.rlike("^[0-9]+$")
    part = F.when(is_note, F.concat(F.lit("[FN_"), t, F.lit("]"))).otherwise(t)
    own = F.when(section, F.when(t.rlike(ids.DIGIT_DOT_MARKER), F.trim(F.regexp_extract(t, ids.DIGIT_DOT_MARKER, 2))).otherwise("")).otherwise(t)
    adds = F.col("element") & (F.col("page") == F.col("_m.page")) & (F.col("block") == F.col("_m.block")) & (section | F.col("_kind").isNull())
    named_by = F.when(mark & adds, own).when(~F.col("_marked") & F.col("_titled"), t)
    rows = rows.select("doc", F.coalesce("_m.seq", F.lit(-1)).alias("at"), F.col("_m.text").alias("mark"), "_marked", "seq", F.when(kept, part).alias("part"), F.when(kept & is_note, t.cast("int")).alias("note"), named_by.alias("name"))
    listed = lambda c: F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("seq", F.col(c).alias("x")))))
    grouped = rows.where("part is not null or name is not null").groupBy("doc", "at").agg(
        F.max("mark").alias("mark"), F.max("_marked").alias("marked"), listed("part").alias("parts"), listed("name").alias("names"), F.array_sort(F.collect_set("note")).alias("fn_indexes")
    ).where(F.size("parts") > 0)
    joined = lambda c: F.transform(c, lambda x: x["x"])
    title = F.when(F.col("at") >= 0, F.trim(F.array_join(F.filter(joined("names"), lambda x: x != ""), " "))).when(F.col("marked"), "Preamble").when(F.size("names") > 0, _tidy(F.array_join(joined("names"), " "))).otherwise("Document Content")
    name = F.when(F.col("at") >= 0, marker(F.col("mark"))).when(F.col("marked"), "Preamble").otherwise("Content")
    out = grouped.select("doc", "at", name.alias("marker"), title.alias("title"), F.trim(F.array_join(joined("parts"), " ")).alias("text"), "fn_indexes")
    return out.where((F.col("marker") != "Preamble") | (F.col("text") != ""))


def annex_parts(flat: DataFrame, keyword: str = "Anhang", limit: float = 150.0) -> DataFrame:
    """flat with part (0 before the first annex) and suffix: a block near the top whose span starts with the keyword opens an annex.

    The suffix is the number after the keyword, arabic before roman, or the next span's of the line, or the annex's ordinal.
    """
    t = F.trim("text")
    line = Window.partitionBy("doc", "page", "block", "line").orderBy("span")
    after = F.expr("lead(_t) ignore nulls").over(line)
    arabic, roman = rf"^{keyword}\s*(\d+)", rf"^{keyword}\s+([IVX]+)"
    own = F.when(t.rlike(arabic), F.regexp_extract(t, arabic, 1)).when(t.rlike(roman) & ids.is_small_roman(F.regexp_extract(t, roman, 1)), F.regexp_extract(t, roman, 1))
    rows = flat.withColumn("_t", F.when(t != "", t)).withColumn("_next", after).withColumn("_own", own)
    named = F.col("_own").isNotNull() | (t == keyword)
    following = F.when((t == keyword) & (F.col("_next").rlike("^[0-9]+$") | ids.is_small_roman(F.col("_next"))), F.col("_next"))
    hit = (F.col("block_y0") < limit) & named
    # Every window has the order of PLACE or the start of it, so rows are sorted once.
    per_block = Window.partitionBy("doc", "page", "block").orderBy("line", "span")
    rows = rows.withColumn("_hit", hit).withColumn("_suffix", F.coalesce("_own", following))
    first_hit = F.sum(F.when(F.col("_hit"), 1).otherwise(0)).over(per_block.rowsBetween(Window.unboundedPreceding, 0))
    opens = F.col("_hit") & (first_hit == 1)
    first_span = F.row_number().over(per_block) == 1
    block_open = F.max(F.when(opens, F.struct(F.coalesce("_suffix", F.lit("")).alias("s"))).otherwise(None)).over(Window.partitionBy("doc", "page", "block"))
    rows = rows.withColumn("_open", block_open).withColumn("_start", first_span & F.col("_open").isNotNull())
    rows = sequences.segments(rows, "doc", list(PLACE), F.col("_start"), "part")
    last = F.last(F.when(F.col("_start"), F.struct(F.when(F.col("_open.s") != "", F.col("_open.s")).otherwise(F.col("part").cast("string")).alias("s"))), ignorenulls=True)
    rows = rows.withColumn("suffix", last.over(Window.partitionBy("doc").orderBy(*PLACE).rowsBetween(Window.unboundedPreceding, 0))["s"])
    return rows.drop("_t", "_next", "_own", "_hit", "_suffix", "_open", "_start")


def split_annex(text: Column, keyword: str = "Allegato", ignore_case: bool = False) -> tuple[Column, Column]:
    """(main, annex) of a plain text, cut before the first line that starts with the keyword; no annex gives null."""
    pattern = rf"(?m{'i' if ignore_case else ''})^\s*{keyword}\b"
    at = F.regexp_instr(text, F.lit(pattern))
    return F.when(at > 0, F.rtrim(F.substring(text, F.lit(1), at - 1))).otherwise(text), F.when(at > 0, F.ltrim(F.substring(text, at, F.length(text))))


def _count(lines: Column, pattern: str) -> Column:
    return F.size(F.filter(lines, lambda x: x.rlike(pattern)))


def body_start(lines: Column) -> Column:
    """The place of the first line after the preamble, from 0.

    A preamble ends with a line that has one of its closing words, or before a section mark that follows such a line,
    a line of under seven words, or stands after line 10; at line 51 in any case. Without any sign the first line alone
    is the preamble, if it has at most ten words.
    """
    closes = lambda x: F.exists(F.array(*map(F.lit, PREAMBLE_ENDS)), lambda e: F.lower(x).contains(e))
    n_words = lambda x: F.size(F.split(F.trim(x), r"\s+"))
    places = F.sequence(F.lit(0), F.size(lines) - 1)

    def end(i: Column) -> Column:
        line, before = F.get(lines, i), F.get(lines, i - 1)
        mark = line.rlike(FIRST_SECTION) & ~line.rlike("^(visti|vista|visto)")
        return F.when(mark & (i > 0) & (closes(before) | (n_words(before) < 7)), i - 1).when(mark & (i > 10), i - 1).when(closes(line), i).when(i > 50, i)

    ends = F.filter(F.transform(places, end), lambda e: e.isNotNull())
    return F.when(F.size(ends) > 0, F.get(ends, F.lit(0)) + 1).when(n_words(F.get(lines, F.lit(0))) > 10, 0).otherwise(1)


def document_classes(df: DataFrame, text: str = "text", whole: bool = True, out: str = "class") -> DataFrame:
    """df with Base, Modification or Unknown. whole counts marks in the whole body, numbered law lists included; else its first 75 lines first.

    Lines and body are columns of their own, so that a text is split once.
    """

    def cascade(part: Column, lists: bool, last: bool) -> Column:
        roman, article, section = _count(part, ROMAN_LINE), _count(part, ARTICLE_LINE), _count(part, SECTION_LINE)
        laws = _count(part, LAW_LIST_LINE) if lists else F.lit(0)
        rule = F.when(F.array_join(part, "\n").rlike(MODIFIES), "Modification").when((roman > 0) & (roman >= article) & (section == 0), "Modification")
        if lists:
            rule = rule.when((laws > 0) & (section == 0) & (article <= roman + laws), "Modification")
        base = (section > 0) | (article > 0)
        if not last or lists:
            base = base & ((roman == 0) | (article >= roman)) & ((laws == 0) | (article >= laws))
        rule = rule.when(base, "Base")
        return rule.when(roman > 0, "Modification") if lists else rule

    lines, body = F.col("_lines"), F.col("_body")
    rows = df.withColumn("_lines", F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")).withColumn("_start", body_start(lines))
    rows = rows.withColumn("_body", F.slice(lines, F.col("_start") + 1, F.greatest(F.size(lines) - F.col("_start"), F.lit(0))))
    result = cascade(body, True, True) if whole else F.coalesce(cascade(F.slice(body, 1, 75), False, False), cascade(body, False, True))
    return rows.withColumn(out, F.when(F.size(lines) == 0, "Unknown").otherwise(F.coalesce(result, F.lit("Unknown")))).drop("_lines", "_start", "_body")


def footers(blocks: DataFrame, height: Column, threshold: float = 0.6) -> DataFrame:
    """doc, numbers, had_gap, footnotes: footnotes in the part of pages below the threshold.

    A block that starts with a number at the page's margin opens a footnote; blocks up to the next one continue it.
    The numbers are accepted in reading order with small gaps only. blocks: doc, page, block, x0, y0, text.
    """
    rows = sequences.margin(blocks, ["doc", "page"], F.col("x0"), (F.col("y0") > threshold * height) & (F.length("text") > 10))
    rows = rows.where(F.col("y0") > threshold * height)
    numbered = F.col("text").rlike(r"^\s*[0-9]{1,3}\s+\S") & (F.abs(F.col("x0") - F.col("margin")) < 10)
    rows = sequences.index(rows, "doc", "page", "block").withColumn("numbered", numbered)
    joined = sequences.joined_segments(rows.select("doc", "seq", "numbered", F.trim("text").alias("text")), "doc", "seq", F.col("numbered"), "text").where("segment > 0")
    listed = joined.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("segment", F.regexp_extract("text", r"^\s*([0-9]+)", 1).cast("int").alias("n"), "text"))).alias("r"))
    numbers, gap = sequences.accepted(F.transform("r", lambda x: x["n"]))
    return listed.withColumn("numbers", numbers).withColumn("had_gap", gap).select("doc", "numbers", "had_gap", F.transform(F.filter("r", lambda x: F.array_contains("numbers", x["n"])), lambda x: x["text"]).alias("footnotes"))


def quality_report(finals: DataFrame, refs: DataFrame) -> DataFrame:
    """doc, issue, n: empty texts, missing titles, duplicate markers, footnotes without reference and the reverse, gaps.

    finals: doc, marker, title, text, fn_indexes; refs: doc, fn_number, type.
    """
    used = finals.select("doc", F.explode("fn_indexes").alias("n")).distinct()
    given = refs.where("fn_number is not null").select("doc", F.col("fn_number").cast("int").alias("n")).distinct()
    parts = [
        finals.where("trim(text) = ''").select("doc", F.lit("empty text").alias("issue")),
        finals.where("title is null or title = ''").select("doc", F.lit("missing title").alias("issue")),
        sequences.repeated(finals, "doc", "marker").select("doc", F.lit("duplicate marker").alias("issue")),
        refs.where("type is null").select("doc", F.lit("missing type").alias("issue")),
        refs.where("fn_number is null").select("doc", F.lit("missing number").alias("issue")),
        sequences.repeated(refs.where("fn_number is not null"), "doc", "fn_number").select("doc", F.lit("duplicate footnote").alias("issue")),
        used.join(given, ["doc", "n"], "left_anti").select("doc", F.lit("footnote without reference").alias("issue")),
        given.join(used, ["doc", "n"], "left_anti").select("doc", F.lit("reference without footnote").alias("issue")),
        sequences.gaps(given, "doc", "n").select("doc", F.lit("gap").alias("issue")),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("doc", "issue").agg(F.count("*").alias("n"))
