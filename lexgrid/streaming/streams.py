"""Streams: idempotent upserts of micro-batches, and windows over event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrid.graph import model


def upsert_into(path: str, key: str, order: str, columns: list[str], first: bool = True) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that merges a batch into versions of a table: path/v=<batch>; the highest is current.

    A batch that is run again rewrites its own version from the one before it, so a restart changes nothing.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = current(spark, path, batch.select(*columns).schema, number)
        rows = model.first_wins(batch, before, key, order) if first else model.last_wins(batch, before, key, order)
        rows.write.mode("overwrite").parquet(f"{path}/v={number}")

    return merge


def current(spark: SparkSession, path: str, schema, below: int | None = None) -> DataFrame:
    """The table after the last batch, or before batch `below`."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [int(s.getPath().getName()[2:]) for s in fs.listStatus(hadoop) if s.getPath().getName().startswith("v=")] if fs.exists(hadoop) else []
    found = [v for v in found if below is None or v < below]
    return spark.read.schema(schema).parquet(f"{path}/v={max(found)}") if found else spark.createDataFrame([], schema)


def windowed(events: DataFrame, time: str = "ts", length: str = "1 day", late: str = "1 hour", by: list[str] = ("event_type",)) -> DataFrame:
    """start, by..., n, total: tumbling windows with a watermark; works on streams and tables."""
    stamped = events.withColumn(time, F.col(time).cast("timestamp"))
    counted = stamped.withWatermark(time, late).groupBy(F.window(time, length), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").alias("start"), *by, "n", "total")


def sessions(events: DataFrame, user: str = "user_id", time: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user, start, stop, n: events of a user with less than `gap` between them."""
    stamped = events.withColumn(time, F.col(time).cast("timestamp"))
    grouped = stamped.withWatermark(time, late).groupBy(F.session_window(time, gap), user).agg(F.count("*").alias("n"))
    return grouped.select(user, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")
