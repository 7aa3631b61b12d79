"""Readers: every source gets an explicit schema, and broken rows are kept apart instead of lost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexgrid.functions import text as T
from lexgrid.operators.documents import PAGES
from lexgrid.runtime import durable

LAW = "act string, title_it string, title_fr string, title_de string, publicationDate string, decisionDate string, entryintoforceDate string, nolongerinforceDate string, status string, typeDoc_it string, typeDoc_fr string, typeDoc_de string, ruLabel string, roLabel string, asLabel string"
REFERENCE = "struct<id:string,fn_number:string,type:string,text:string>"
FINAL = f"source_file string, document_title string, title_id string, sections_list array<struct<marker_id:string,marker:string,title:string,text:string,fn_indexes:array<int>>>, references_list array<{REFERENCE}>"
NA = ["", "NA", "N/A", "NaN", "nan", "null", "NULL", "None"]


def csv(spark: SparkSession, path: str, schema: str, sep: str = ",", quote: str = '"', na: list[str] = NA, trim: bool = False, comment: str | None = None) -> DataFrame:
    """A CSV with header. Several tokens may stand for null; `comment` drops lines that start with it."""
    reader = spark.read.schema(schema).option("header", True).option("sep", sep).option("quote", quote).option("ignoreLeadingWhiteSpace", trim).option("nullValue", "")
    df = (reader.option("comment", comment) if comment else reader).csv(path)
    return df.select(*[T.blank_tokens(F.col(f.name), na).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f.name) for f in df.schema])


def csv_cut_comments(spark: SparkSession, path: str, columns: list[str], comment: str = "/", sep: str = ",") -> DataFrame:
    """A CSV whose lines end at a comment character, as text columns; the header line is dropped."""
    lines = spark.read.text(path).select(F.substring_index("value", comment, 1).alias("line")).where(F.trim("line") != "")
    parts = F.split("line", sep)
    rows = lines.select(*[F.trim(F.get(parts, F.lit(i))).alias(c) for i, c in enumerate(columns)])
    return rows.where(F.col(columns[0]) != columns[0])


def dict_rows(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A CSV by header names: an optional line of three quotes before it, blanks around names dropped, required names checked."""
    lines = spark.read.text(path).where(~F.trim("value").isin('"""', ""))
    header = lines.limit(1).first()
    names = [n.strip() for n in header["value"].split(",")] if header else []
    missing = [n for n in required if n not in names]
    if missing:
        raise ValueError(f"columns missing: {missing}")
    parsed = lines.where(F.col("value") != header["value"]).select(F.from_csv("value", ", ".join(f"`{n}` string" for n in names)).alias("r"))
    return parsed.select("r.*")


def repaired_fields(lines: DataFrame, value: str = "value") -> DataFrame:
    """Lines cut at commas, blanks and quotes around fields dropped, empty fields dropped: one array `fields`."""
    fields = F.transform(F.split(value, ","), lambda x: F.trim(F.regexp_replace(F.trim(x), '^"+|"+$', "")))
    return lines.withColumn("fields", F.filter(fields, lambda x: x != ""))


def repaired_records(lines: DataFrame, doc: str, order: str, value: str = "value", start: str = '"https://') -> DataFrame:
    """Continuation lines appended to the record they belong to: a record starts where a line starts with `start`."""
    from lexgrid.operators.sequences import joined_segments

    return joined_segments(lines, doc, order, F.col(value).startswith(start), value).where("segment > 0")


def json_documents(spark: SparkSession, path: str, schema: str = FINAL) -> DataFrame:
    """One document a file; category and file from the path; a broken file is a row with _corrupt_record set."""
    df = spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", True).option("recursiveFileLookup", True).option("mode", "PERMISSIVE").json(path)
    parts = F.split(F.col("_metadata.file_path"), "/")
    return df.select("*", F.element_at(parts, -2).alias("category"), F.element_at(parts, -1).alias("file"))


def page_trees(spark: SparkSession, path: str) -> DataFrame:
    """doc, pages: span trees as JSON, one file a document; the stand-in for a PDF reader."""
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path)
    return raw.select(F.regexp_replace(F.element_at(F.split("_metadata.file_path", "/"), -1), r"\.json$", "").alias("doc"), F.from_json("value", PAGES).alias("pages"))


def texts(spark: SparkSession, path: str) -> DataFrame:
    """file, text: one row a file."""
    raw = spark.read.option("wholetext", True).text(path)
    return raw.select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), F.col("value").alias("text"))


def page_counts(flat: DataFrame) -> DataFrame:
    return flat.groupBy("doc").agg((F.max("page") + 1).alias("n_pages"))


def page_text(flat: DataFrame, separator: str = "\npage_break\n") -> DataFrame:
    """doc, text: spans joined to lines, lines to pages, with a separator between pages."""
    rows = F.array_sort(F.collect_list(F.struct("seq", "text")))
    pages = flat.groupBy("doc", "page").agg(F.array_join(F.transform(rows, lambda r: r["text"]), " ").alias("text"))
    ordered = F.array_sort(F.collect_list(F.struct("page", "text")))
    return pages.groupBy("doc").agg(F.array_join(F.transform(ordered, lambda r: r["text"]), separator).alias("text"))


def page_blocks(flat: DataFrame) -> DataFrame:
    """doc, page, block, y0, text: spans of a block joined in order."""
    rows = F.array_sort(F.collect_list(F.struct("seq", "text")))
    return flat.groupBy("doc", "page", "block").agg(F.min("block_y0").alias("y0"), F.array_join(F.transform(rows, lambda r: r["text"]), " ").alias("text"))


def hrefs(df: DataFrame, markup: str, key: str) -> DataFrame:
    """key, place, href: link targets in order, from markup that need not be well-formed."""
    return df.select(key, F.posexplode(F.regexp_extract_all(F.col(markup), F.lit('href="([^"]*)"'), F.lit(1))).alias("place", "href"))


def element(df: DataFrame, markup: str, tag: str) -> DataFrame:
    """df with `text`: the first element of that name without tags."""
    inner = F.regexp_extract(markup, rf"(?s)<{tag}\b[^>]*>(.*?)</{tag}>", 1)
    return df.withColumn("text", T.collapse(F.regexp_replace(inner, "<[^>]*>", " ")))


def flatten(df: DataFrame, column: str) -> DataFrame:
    """The fields of a struct column as columns."""
    return df.select(f"{column}.*")


def bindings(spark: SparkSession, path: str, variables: list[str]) -> DataFrame:
    """The rows of a saved SPARQL answer: one text column a variable, null where it is unbound."""
    one = ", ".join(f"`{v}`: struct<value: string>" for v in variables)
    raw = spark.read.schema(f"results struct<bindings: array<struct<{one}>>>").option("multiLine", True).json(path)
    return raw.select(F.explode("results.bindings").alias("b")).select(*[F.col(f"b.`{v}`.value").alias(v) for v in variables])


def search_hits(spark: SparkSession, path: str, source: str) -> DataFrame:
    """The hits of a saved search answer; `source` is the DDL of a hit's fields."""
    raw = spark.read.schema(f"hits struct<hits: array<struct<_id: string, _score: double, _source: struct<{source}>>>>").option("multiLine", True).json(path)
    return raw.select(F.explode("hits.hits").alias("h")).select("h._id", "h._score", "h._source.*")


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """df with _row: the rows' order, for first- and last-write-wins. Ranges are numbered in parallel, then offset.

    The ranges come from a sample, so the rows are written with theirs before they are counted and numbered.
    """
    ranged = durable(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    inside = ranged.withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    before = inside.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = before.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")  # one row a partition
    return inside.join(F.broadcast(starts), "_part").withColumn("_row", F.col("_start") + F.col("_in") - 1).drop("_part", "_in", "_start")
