"""Operators over ordered rows: segments, gaps, nearest marks, state folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def index(df: DataFrame, doc: str, *order: str, name: str = "seq") -> DataFrame:
    """Rows numbered from 0 within a document."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(doc).orderBy(*order)) - 1)


def segments(df: DataFrame, doc: str, order: str | list[str], mark: Column, name: str = "segment") -> DataFrame:
    """Rows with the number of marks up to them: rows from a mark to the next are a segment, rows before the first have 0."""
    up_to = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(F.when(mark, 1).otherwise(0)).over(up_to))


def joined_segments(df: DataFrame, doc: str, order: str, mark: Column, text: str, separator: str = " ") -> DataFrame:
    """doc, segment, text: the texts of each segment in order."""
    marked = segments(df, doc, order, mark)
    rows = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(text))))
    return marked.groupBy(doc, "segment").agg(F.array_join(F.transform(rows, lambda r: r[text]), separator).alias(text))


def after_last(df: DataFrame, doc: str, order: str, hit: Column) -> DataFrame:
    """Rows after the document's last hit; all rows where there is none."""
    cut = F.max(F.when(hit, F.col(order))).over(Window.partitionBy(doc))
    return df.withColumn("_cut", cut).where((F.col("_cut").isNull()) | (F.col(order) > F.col("_cut"))).drop("_cut")


def nearest_before(df: DataFrame, parts: list[str], order: str, cond: Column, value: Column, name: str) -> DataFrame:
    """The value of the nearest earlier row that meets cond, or null."""
    w = Window.partitionBy(*parts).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.last(F.when(cond, value), ignorenulls=True).over(w))


def nearest_after(df: DataFrame, parts: list[str], order: str, cond: Column, value: Column, name: str) -> DataFrame:
    w = Window.partitionBy(*parts).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    return df.withColumn(name, F.first(F.when(cond, value), ignorenulls=True).over(w))


def gaps(df: DataFrame, doc: str, value: str) -> DataFrame:
    """doc, start, stop: neighbouring distinct values that leave integers out between them."""
    after = F.lead(value).over(Window.partitionBy(doc).orderBy(value))
    return df.select(doc, value).distinct().withColumn("stop", after).where(F.col("stop") - F.col(value) > 1).select(doc, F.col(value).alias("start"), "stop")


def repeated(df: DataFrame, doc: str, value: str) -> DataFrame:
    return df.groupBy(doc, value).agg(F.count("*").alias("n")).where("n > 1")


def accepted(values: Column, gap: int = 3) -> tuple[Column, Column]:
    """(accepted, had a gap) of an array of footnote numbers in reading order.

    The first is accepted up to 1 + gap; later ones if they are the next number, or at most `gap` beyond it.
    """
    state = F.aggregate(
        values,
        F.struct(F.lit(0).alias("last"), F.lit(False).alias("gap"), F.array().cast("array<int>").alias("all")),
        lambda s, x: F.when((x > s["last"]) & (x <= s["last"] + gap + 1), F.struct(x.cast("int").alias("last"), (s["gap"] | (x > s["last"] + 1)).alias("gap"), F.concat(s["all"], F.array(x.cast("int"))).alias("all"))).otherwise(s),
    )
    return state["all"], state["gap"]


def margin(df: DataFrame, page: list[str], x0: Column, qualifies: Column, default: float = 30.0) -> DataFrame:
    """Rows with their page's effective margin: the least x0 of qualifying blocks, or the default."""
    return df.withColumn("margin", F.coalesce(F.min(F.when(qualifies, x0)).over(Window.partitionBy(*page)), F.lit(default)))


def in_body(y0: Column, y1: Column, height: Column, x0: Column, x1: Column, width: Column, text: Column) -> Column:
    """A block of the body: between 10 and 90 % of the height, narrower than 90 % of the width, longer than 10 characters."""
    return (y0 > 0.1 * height) & (y1 < 0.9 * height) & (x1 - x0 < 0.9 * width) & (F.length(F.trim(text)) > 10)
