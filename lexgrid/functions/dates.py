"""Date functions: strict ISO parsing, Italian month names, years."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS_IT = "gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre".split()


def iso(c: Column) -> Column:
    """The date at the start of a text, null where there is none."""
    return F.try_to_timestamp(F.split_part(F.trim(c), F.lit(" "), F.lit(1)), F.lit("yyyy-MM-dd")).cast("date")


def italian(d: Column) -> Column:
    months = F.array(*map(F.lit, MONTHS_IT))
    return F.concat_ws(" ", F.day(d), F.element_at(months, F.month(d)), F.year(d))


def year_text(c: Column) -> Column:
    return F.substring(c, 1, 4)


def after_end(end: Column, validity: Column, threshold: str = "2025-06-10") -> Column:
    """`Abrogated` where the end of applicability lies before the threshold, else the validity as it is."""
    return F.when(end < F.to_date(F.lit(threshold)), "Abrogated").otherwise(validity)
