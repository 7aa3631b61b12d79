"""Sinks: JSON, CSV, Markdown, reports and a store of named snapshots."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str, by: list[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*by).json(path) if by else df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def markdown_lines(flat: DataFrame) -> DataFrame:
    """doc, text: one Markdown text a document; headings by size and weight. flat: doc, seq, text, size, bold."""
    from lexgrid.functions.text import heading_level

    level = heading_level(F.col("size"), F.col("bold"), F.col("text"))
    line = F.when(level > 0, F.concat(F.repeat(F.lit("#"), level), F.lit(" "), F.col("text"))).otherwise(F.col("text"))
    rows = F.array_sort(F.collect_list(F.struct("seq", line.alias("line"))))
    return flat.groupBy("doc").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n\n").alias("text"))


def report(title: str, df: DataFrame, limit: int = 200) -> str:
    """A text report of a small table: its first `limit` rows, and a line with the number of those left out."""
    rows = df.limit(limit + 1).collect()
    lines = ["\t".join("" if v is None else str(v) for v in r) for r in rows[:limit]]
    if len(rows) > limit:
        lines.append(f"({df.count() - limit} more rows)")
    return "\n".join([title, "=" * len(title), "\t".join(df.columns), *lines])


class SnapshotStore:
    """Tables by name and run under one folder: name/run=.../, a manifest of one JSON row a run, and the latest run's name.

    A run is listed only after its tables are written, so readers never see part of one.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def save(self, run: str, tables: dict[str, DataFrame]) -> None:
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.root}/{name}/run={run}")
        row = json.dumps({"run": run, "tables": sorted(tables), "order": len(self.runs())})
        self.spark.createDataFrame([(row,)], "value string").coalesce(1).write.mode("append").text(f"{self.root}/_manifest")

    def runs(self) -> list[dict]:
        try:
            rows = self.spark.read.text(f"{self.root}/_manifest").collect()
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise
        return sorted((json.loads(r["value"]) for r in rows), key=lambda r: (r["order"], r["run"]))

    def load(self, name: str, run: str | None = None) -> DataFrame:
        """A table of a run, by default of the one saved last, whatever its name."""
        run = run or [r["run"] for r in self.runs() if name in r["tables"]][-1]
        return self.spark.read.parquet(f"{self.root}/{name}/run={run}")
