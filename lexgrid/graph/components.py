"""Connected components over an edge table: large-star and small-star rounds to a forest, then pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrid.runtime import durable


def _jumped(e: DataFrame) -> tuple[DataFrame, int]:
    """(e with each b replaced by the least node that b hangs under, number of rows that moved). Each a of e stands once."""
    up = e.select(F.col("a").alias("b"), F.col("b").alias("m"))
    new = durable(e.join(up, "b", "left").select("a", F.coalesce("m", "b").alias("b"), F.col("m").isNotNull().alias("moved")))
    return new.select("a", "b"), new.where("moved").count()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 60) -> DataFrame:
    """node, component: the least node of its component, for every endpoint of an edge (directions ignored).

    Ids may be of any type that can be ordered; edges with a null end are ignored. Rows hang a node under a lesser one.
    A round hangs it under the least that its own lesser nodes hang under, and those under the least of them, until
    each node hangs under one; such a forest needs one join a round. The number of rounds grows with the logarithm of
    the longest path. Minima are written to the shared folder before they are joined back, so that Spark knows their
    size and can split the rows of a hub among tasks.
    """
    pairs = durable(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null").distinct())
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    e = pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    for _ in range(rounds):
        e = durable(e)
        least = durable(e.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
        if least.where("n > 1").isEmpty():
            break
        up = least.select(F.col("a").alias("b"), "m")
        lower = durable(e.join(up, "b", "left").select("a", F.coalesce("m", "b").alias("b")).distinct())
        least = durable(lower.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
        small = lower.join(least.where("n > 1").drop("n"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = least.select("a", F.col("m").alias("b")).unionByName(small).distinct()
    else:
        raise RuntimeError("components did not settle")
    for _ in range(rounds):
        e, moved = _jumped(e)
        if not moved:
            break
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(e, nodes["node"] == e["a"], "left").select("node", F.coalesce("b", "node").alias("component"))
