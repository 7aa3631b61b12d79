"""Property graphs: node tables by label, one edge table, a catalog of named projections, and path patterns as joins."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class PropertyGraph:
    """nodes: a table for each label, keyed by `id`; edges: src, dst, rel_type and properties."""

    nodes: dict[str, DataFrame]
    edges: DataFrame
    keys: dict[str, str] = field(default_factory=dict)

    def all_nodes(self) -> DataFrame:
        """id, label of all node tables."""
        parts = [df.select(F.col(self.keys.get(label, "id")).alias("id"), F.lit(label).alias("label")) for label, df in self.nodes.items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def label_counts(self) -> DataFrame:
        return self.all_nodes().groupBy("label").agg(F.count("*").alias("n"))

    def relation_counts(self) -> DataFrame:
        return self.edges.groupBy("rel_type").agg(F.count("*").alias("n"))

    def property_types(self) -> list[tuple[str, str, str]]:
        """(label, property, type) from the schemas; no data is read."""
        return [(label, f.name, f.dataType.simpleString()) for label, df in self.nodes.items() for f in df.schema]

    def undirected(self) -> DataFrame:
        """Every edge in both directions; a pattern without direction matches each edge twice."""
        swapped = self.edges.select(*[F.col({"src": "dst", "dst": "src"}.get(c, c)).alias(c) for c in self.edges.columns])
        return self.edges.unionByName(swapped)


class GraphCatalog:
    """Named projections (nodes, edges), made once and cached; dropping one frees it."""

    def __init__(self):
        self._held: dict[str, tuple[DataFrame, DataFrame]] = {}

    def project(self, name: str, edges: DataFrame, nodes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """Without node table the projection has the edges' endpoints only."""
        if name in self._held:
            raise ValueError(f"projection {name} exists")
        if nodes is None:
            nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        self._held[name] = (nodes.cache(), edges.cache())
        return self._held[name]

    def names(self) -> list[str]:
        return sorted(self._held)

    def drop(self, name: str) -> bool:
        held = self._held.pop(name, None)
        for df in held or ():
            df.unpersist()
        return held is not None


def two_hop(owns: DataFrame, cites: DataFrame) -> DataFrame:
    """(owner)-[owns]->(part)-[cites]->(target): src, part, dst, rel_type. owns: src, part; cites: part, dst, rel_type."""
    return owns.join(cites, "part").select("src", "part", "dst", "rel_type")


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ids (one column `id`)."""
    a, b = ids.select(F.col("id").alias("src")), ids.select(F.col("id").alias("dst"))
    return edges.join(a, "src", "left_semi").join(b, "dst", "left_semi")


def weighted(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src", "dst", "rel_type").agg(F.count("*").alias("weight"))


# Sinks: set-based forms of the upserts.


def first_wins(rows: DataFrame, existing: DataFrame, key: str, order: str) -> DataFrame:
    """Existing rows, and for each new key the first row in `order`; rows without key are skipped."""
    first = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*rows.columns), order).alias("r")).select("r.*").drop(order)
    return existing.unionByName(first.join(existing.select(key), key, "left_anti").select(*existing.columns))


def last_wins(rows: DataFrame, existing: DataFrame, key: str, order: str) -> DataFrame:
    """For each new key the last row in `order`, and the existing rows of other keys."""
    last = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*").drop(order)
    return last.select(*existing.columns).unionByName(existing.join(last.select(key), key, "left_anti").select(*existing.columns))


def merge_edges(new: DataFrame, existing: DataFrame) -> DataFrame:
    return existing.unionByName(new).dropDuplicates(["src", "rel_type", "dst"])


def update_existing(rows: DataFrame, changes: DataFrame, key: str, columns: dict) -> DataFrame:
    """rows with `columns` (name: expression over both sides as r and c) where a change has the key."""
    r, c = rows.alias("r"), changes.alias("c")
    joined = r.join(c, F.col(f"r.{key}") == F.col(f"c.{key}"), "left")
    return joined.select(*[columns[x].alias(x) if x in columns else F.col(f"r.{x}") for x in [*rows.columns, *(k for k in columns if k not in rows.columns)]])
