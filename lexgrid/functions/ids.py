"""The identifier grammar of the corpus as column expressions: codes, URIs, file names, section and annex ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The grammar's patterns.
CODE = r"\b(?:FF|RU)\s+\d{4}\s+\d+\b"
SYSTEMATIC = r"\bRS\s+\d+(?:\.\d+)*\b"
CODE_LIST = r"\b(?:FF|RU)\s+\d{4}\s+\d+\b(?:;\s*\d{4}\s+\d+\b)*"
YEAR_NUMBER = r"\d{4}\s+\d+"
ROMAN_SMALL = r"^(XL|L?X{0,3})(IX|IV|V?I{0,3})$"
ROMAN_MARKER = r"^\s*([IVX]+)\s*$"
ARTICLE_MARKER = r"^\s*((?:Art|Articolo)\.?\s*\d+[a-zA-Z]?)\b"
DIGIT_DOT_MARKER = r"^\s*(\d+\.)(?=\s)(.*\S.*|)\s*$"
BASE_REFERENCE = r"^\s*(\d{1,4})\s*$"
SYSTEMATIC_REFERENCE = r"^\s*(\d+\.\d+(?:[.\d]*)?)\s*$"
FILE_MANY = r"(\d{4})-\d+(?:_\d+)*_(\d+)\.pdf$"
FILE_ONE = r"(\d{4})-(\d+)\.pdf$"
LABELS = {"ABROGATES": 0, "AMENDS": 1, "CITES": 2, "INTRODUCES": 3}
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}


def _found(c: Column, pattern: str, group: int) -> Column:
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def codes(c: Column) -> Column:
    """Sorted distinct reference codes of a text: FF and RU codes, RS codes, and the members of lists, which inherit the list's prefix."""
    single = F.concat(F.regexp_extract_all(c, F.lit(CODE), F.lit(0)), F.regexp_extract_all(c, F.lit(SYSTEMATIC), F.lit(0)))
    lists = F.flatten(
        F.transform(
            F.regexp_extract_all(c, F.lit(CODE_LIST), F.lit(0)),
            lambda m: F.transform(F.regexp_extract_all(m, F.lit(YEAR_NUMBER), F.lit(0)), lambda y: F.concat_ws(" ", F.substring(m, 1, 2), y)),
        )
    )
    return F.array_sort(F.array_union(single, lists))


def roman_value(c: Column) -> Column:
    """The value of a roman numeral, null where a character isn't one; the empty text is 0."""
    letters = F.filter(F.split(F.upper(c), ""), lambda x: x != "")
    value = lambda x: F.coalesce(*[F.when(x == k, v) for k, v in ROMAN.items()])
    folded = F.aggregate(
        F.reverse(letters),
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")),
        lambda s, x: F.struct((s["sum"] + F.when(value(x) < s["last"], -value(x)).otherwise(value(x))).alias("sum"), value(x).alias("last")),
        lambda s: s["sum"],
    )
    return F.when(F.exists(letters, lambda x: ~x.isin(*ROMAN)), None).otherwise(folded)


def is_small_roman(c: Column) -> Column:
    """Roman up to 89; the empty text passes as well, as its grammar says."""
    return c.rlike(ROMAN_SMALL)


def act_code(uri: Column, part: str = "oc", prefix: str = "RU") -> Column:
    """A collection URI's code: year and number, or year or volume and the last non-empty of its pages.

    Unknown forms give UNKNOWN_URI_FORMAT, known ones without any page UNKNOWN_PAGE. Years from 1999 on take a number;
    the last form also takes years outside 1948 to 1998 with pages, for its volume is any number.
    """
    new = rf"/{part}/(1999|[2-9]\d{{3}})/(\d+)$"
    pages = rf"/{part}/([IVXLCDM]+|\d+)/(\d*)_(\d*)_(\d*)$"
    page = F.coalesce(*[F.nullif(F.regexp_extract(uri, pages, g), F.lit("")) for g in (4, 3, 2)])
    return (
        F.when(uri.rlike(new), F.concat_ws(" ", F.lit(prefix), F.regexp_extract(uri, new, 1), F.regexp_extract(uri, new, 2)))
        .when(uri.rlike(pages), F.concat_ws(" ", F.lit(prefix), F.regexp_extract(uri, pages, 1), F.coalesce(page, F.lit("UNKNOWN_PAGE"))))
        .otherwise("UNKNOWN_URI_FORMAT")
    )


def file_code(name: Column, category: Column, gazette: list[str]) -> Column:
    """A PDF file name's code: year and the last number, FF for gazette categories, else RU; other names stay."""
    prefix = F.when(F.lower(category).isin(*gazette), "FF").otherwise("RU")
    join = lambda p: F.concat_ws(" ", prefix, F.regexp_extract(name, p, 1), F.regexp_extract(name, p, 2))
    return F.when(name.rlike(FILE_MANY), join(FILE_MANY)).when(name.rlike(FILE_ONE), join(FILE_ONE)).otherwise(name)


def canonical(kind: Column, text: Column) -> Column:
    """A reference's full code: the kind is put before the text unless it stands there."""
    return F.when(text.startswith(F.concat(kind, F.lit(" "))), text).otherwise(F.concat_ws(" ", kind, text))


def annex(file: Column) -> tuple[Column, Column]:
    """(annex id, parent id) of an annex file name, null for others."""
    stem = F.regexp_replace(file, r"\.json$", "")
    is_annex = stem.contains("_Allegato_")
    return F.when(is_annex, stem), F.when(is_annex, F.split_part(stem, F.lit("_Allegato_"), F.lit(1)))


def section_id(parent: Column, marker: Column) -> Column:
    return F.concat_ws("/", parent, marker)


def place(hierarchical: Column) -> Column:
    """page, block, line and span numbers of an id such as page-0.block-5.line-1.span-0, as a map."""
    return F.transform_values(F.str_to_map(hierarchical, F.lit(r"\."), F.lit("-")), lambda _, v: v.cast("int"))


def safe_name(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r'[\\/*?:"<>|]', ""), r"\s+", "_")


def valid_label(c: Column) -> Column:
    """Known relation labels only; error texts in capitals are no labels."""
    return c.isin(*LABELS)
