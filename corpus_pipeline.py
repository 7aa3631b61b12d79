"""The corpus pipeline: five stages from raw documents to encoded training text, each on what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrid.llm import jaccard, mixing, pieces, pii, quality
from lexgrid.llm.queries import tokenizer_path
from lexgrid.runtime import durable, prepare, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the base rules and the risk-controlled cutoffs keep."""
    docs = docs.select(*COLUMNS)
    measured = durable(quality.measures(docs, ["doc_id", "lang"]))
    chosen = quality.cutoffs(measured, table(prepare(spark), sf_dir, "labels"))
    # Measuring again costs less than joining the verdicts to the texts would.
    return quality.with_verdict(quality.measures(docs, COLUMNS), chosen).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked rows the first, whole: the one with the least id, nulls last; of equal texts of an id one stays.

    Rows of one id with texts that are not linked are in classes of their own.
    """
    docs = docs.select(*COLUMNS)
    firsts = jaccard.classify(docs).where("row_id = first").select("row_id").distinct()
    return docs.withColumn("row_id", jaccard.row_id()).join(firsts, "row_id", "left_semi").dropDuplicates(["row_id"]).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced by the kind's name; n_chars is the new length."""
    return pii.mask(docs.select(*COLUMNS))


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's documents, each as often as whole passes take it; the one at a source's cut stays whole.

    Each row comes as often as the mix takes that row, also if its id is null or stands in other rows.
    """
    row = F.md5(F.to_json(F.struct("doc_id", F.md5("text").alias("text"), "lang", "source", "n_chars")))
    docs = docs.select(*COLUMNS, F.unhex(row).alias("_row"))
    taken = mixing.mix(docs, carried=("_row",)).select("_row", F.ceil(F.col("taken") / F.greatest(F.col("size"), F.lit(1))).alias("times"))
    chosen = durable(taken.groupBy("_row").agg(F.sum("times").cast("int").alias("times"), F.count("*").alias("copies")).where("times > 0"))
    # Of equal rows one stands for all that the mix takes of them; they are few, so their texts alone are shuffled for it.
    copied = durable(chosen.where("copies > 1"))
    repeated = docs.join(chosen.where("copies = 1"), "_row").unionByName(docs.join(copied, "_row").dropDuplicates(["_row"]))
    return repeated.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("times"))).alias("_time")).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document of the mix."""
    return pieces.digest(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("mixing sources to target weights", target_mix),
    ("SentencePiece encoding and decoding", encoded),
]

#: SQL can express neither the learned cutoffs nor the encoding; tests/llm/test_pipeline.py holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each but the last is written to the shared folder and read by the next."""
    docs = table(prepare(spark), sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(prepare(spark), docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = durable(docs)
    return docs
