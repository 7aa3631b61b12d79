"""Text functions as column expressions. White space is Unicode-aware where the rules ask for it ((?U))."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SUPERSCRIPTS, DIGITS = "⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789"


def collapse(c: Column) -> Column:
    """Runs of white space to one space, ends trimmed. No-break spaces count as white space."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def clean(c: Column, quotes: bool = False) -> Column:
    """Blank, NaN-like and empty values to null; optionally double quotes are stripped first."""
    c = F.regexp_replace(c, '"', "") if quotes else c
    c = F.trim(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    return F.when(c.isin("", "nan", "NaN"), None).otherwise(c)


def blank_tokens(c: Column, tokens: list[str]) -> Column:
    return F.when(c.isin(*tokens), None).otherwise(c)


def words(c: Column) -> Column:
    """The words of a text: split at white space, empties dropped."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def sentences(c: Column) -> Column:
    """The sentences of a text: split at . ! ?, blank ones dropped."""
    return F.filter(F.split(c, r"[.!?]+"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")) != "")


def context(text: Column, mark: Column, window: int = 200) -> Column:
    """`window` characters around the first place of `mark`, half on each side, trimmed; the whole text where it is missing."""
    at = F.instr(text, mark)
    half = window // 2
    start = F.greatest(at - half, F.lit(1))
    return F.when(at == 0, text).otherwise(F.trim(F.substring(text, start, at - start + F.length(mark) + half)))


def superscripts(c: Column) -> Column:
    return F.translate(c, SUPERSCRIPTS, DIGITS)


def median(values: Column) -> Column:
    """The median of an array of numbers, null for an empty one."""
    s, n = F.array_sort(values), F.size(values)
    half = F.floor(n / 2).cast("int")
    return F.when(n == 0, None).when(n % 2 == 1, F.get(s, half).cast("double")).otherwise((F.get(s, half - 1) + F.get(s, half)) / 2.0)


def mean(values: Column) -> Column:
    return F.when(F.size(values) == 0, None).otherwise(F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values))


def deviation(values: Column) -> Column:
    """The sample standard deviation of an array, 0 for fewer than two values."""
    # One pass: a mean within the fold's function would be taken again for every element.
    sums = F.aggregate(
        values,
        F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q")),
        lambda a, x: F.struct((a["s"] + x).alias("s"), (a["q"] + x * x).alias("q")),
        lambda a: F.greatest(F.lit(0.0), a["q"] - a["s"] * a["s"] / F.size(values)) / F.greatest(F.size(values) - 1, F.lit(1)),
    )
    return F.when(F.size(values) < 2, 0.0).otherwise(F.sqrt(sums))


def type_token_ratio(tokens: Column) -> Column:
    lower = F.transform(tokens, F.lower)
    return F.when(F.size(tokens) == 0, 0.0).otherwise(F.size(F.array_distinct(lower)) / F.size(tokens))


def gulpease(chars: Column, n_words: Column, n_sentences: Column) -> Column:
    return F.when((n_words == 0) | (n_sentences == 0), 0.0).otherwise(F.lit(89.0) + (F.lit(300.0) * n_sentences - F.lit(10.0) * chars) / n_words)


def readability_fr(chars: Column, n_words: Column, n_sentences: Column) -> Column:
    return F.when((n_words == 0) | (n_sentences == 0), 0.0).otherwise(F.lit(207.0) - F.lit(1.015) * (n_words / n_sentences) - F.lit(73.6) * (chars / n_words))


def readability_de(chars: Column, n_words: Column, n_sentences: Column) -> Column:
    return F.when((n_words == 0) | (n_sentences == 0), 0.0).otherwise(F.lit(180.0) - n_words / n_sentences - F.lit(58.5) * (chars / n_words))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.format_string("%.1f%%", F.lit(100.0) * part / whole)).otherwise("N/A")


def keywords(c: Column, stop: list[str]) -> Column:
    """Lower-case words of letters only, longer than one, outside a stop list; quotes and punctuation dropped."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(c), "[\"'“”’]", ""), r"[^\p{L}\p{N}\s]", " ")
    return F.filter(F.split(plain, r"\s+"), lambda w: w.rlike(r"^\p{L}{2,}$") & ~w.isin(*stop) if stop else w.rlike(r"^\p{L}{2,}$"))


def heading_level(size: Column, bold: Column, text: Column, prefix: str = "Art") -> Column:
    """First rule that holds: size above 14, above 12, bold with a prefix or digit, bold, plain."""
    return F.when(size > 14, 1).when(size > 12, 2).when(bold & (text.startswith(prefix) | text.rlike("^[0-9]")), 3).when(bold, 4).otherwise(0)


def sigmoid(c: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))


def argmax(values: Column) -> Column:
    """The zero-based place of the largest value, the first of equal ones."""
    return F.array_position(values, F.array_max(values)) - 1
