"""The queries of this subpackage: each applies one operator to its whole table. SQL stands beside a query where DuckDB can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrid.llm import mixing
from lexgrid.runtime import prepare, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexgrid.llm import html_extract

    return html_extract.extract(table(prepare(spark), sf_dir, "pages"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexgrid.llm import langid

    return langid.identify(table(prepare(spark), sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexgrid.llm import pieces

    return pieces.digest(table(prepare(spark), sf_dir, "documents"), tokenizer_path())


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexgrid.llm import substring_dedup

    return substring_dedup.deduplicate(table(prepare(spark), sf_dir, "documents"), digests=True)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexgrid.llm import pii

    return pii.find(table(prepare(spark), sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexgrid.llm import quality

    return quality.report(table(prepare(spark), sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(prepare(spark), sf_dir, "documents"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexgrid.llm import ann

    return ann.search(table(prepare(spark), sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexgrid.llm import jaccard

    return jaccard.join(table(prepare(spark), sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexgrid.llm import secrets

    return secrets.scan(table(prepare(spark), sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_html_extract, op2_langid, op3_sentencepiece, op4_substring_dedup, op5_pii, op6_quality, op7_mixing, op8_ann, op9_jaccard_join, op10_secrets)}

SQL: dict[str, str] = {"op7_mixing": mixing.SQL}
