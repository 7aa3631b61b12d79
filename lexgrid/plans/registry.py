"""The registered queries: each applies an operator to the driver's tables, with the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrid.runtime import prepare, sized, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of one folder, and how they stand in for acts, sections and citations."""

    #: What tells line items apart: their numbers alone don't.
    PART = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = prepare(spark), sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return sized(table(self.spark, self.dir, name))

    @property
    def laws(self) -> DataFrame:
        return self.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("validity"), F.col("o_orderpriority").alias("type_law"), F.col("o_orderdate").cast("date").alias("published"), F.col("o_custkey").alias("customer"))

    @property
    def sections(self) -> DataFrame:
        return self.lineitem.select(F.col("l_orderkey").alias("src"), F.concat_ws("/", *self.PART).alias("part"))

    @property
    def cites(self) -> DataFrame:
        return self.lineitem.select(F.concat_ws("/", *self.PART).alias("part"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("rel_type"))

    @property
    def edges(self) -> DataFrame:
        """Law to law, one row a citation, without self-loops, targets known."""
        raw = self.lineitem.select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("rel_type"), F.concat_ws("/", "l_orderkey", "l_linenumber").alias("edge_id"))
        return raw.where("src <> dst").join(self.orders.select(F.col("o_orderkey").alias("dst")), "dst", "left_semi").select("src", "dst", "rel_type", "edge_id")

    @property
    def chain(self) -> DataFrame:
        """Each order to the next of its customer: a sparse graph."""
        from pyspark.sql import Window

        after = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
        return self.orders.select(F.col("o_orderkey").alias("src"), after.alias("dst")).where("dst is not null")

    @property
    def references(self) -> DataFrame:
        """Customer nation to supplier nation, one row a line item: the category graph."""
        c, s, n = self.customer, self.supplier, self.nation
        a, b = n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("src_cat")), n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("dst_cat"))
        rows = self.lineitem.select("l_orderkey", "l_suppkey").join(self.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        return rows.join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(s.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(a, "c_nationkey").join(b, "s_nationkey").select("src_cat", "dst_cat")


#: The same tables for DuckDB, put before queries that name them.
WITH = """
with recursive laws as (select o_orderkey as id, o_orderstatus as validity, o_orderpriority as type_law, cast(o_orderdate as date) as published, o_custkey as customer from orders),
edges as (select l_orderkey as src, l_partkey as dst, l_returnflag as rel_type, l_orderkey || '/' || l_linenumber as edge_id from lineitem where l_orderkey <> l_partkey and l_partkey in (select o_orderkey from orders)),
chain as (select * from (select o_orderkey as src, lead(o_orderkey) over (partition by o_custkey order by o_orderkey) as dst from orders) where dst is not null),
refs as (select a.n_name as src_cat, b.n_name as dst_cat, count(*) as n from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey join nation a on c_nationkey = a.n_nationkey join nation b on s_nationkey = b.n_nationkey group by 1, 2)
"""


def query(name: str, sql: str | None = None, tables: bool = True):
    """Registers a function of Tables. `sql` continues the WITH list where `tables` is set."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            SQL[name] = f"{WITH}{sql}" if tables else sql
        return f

    return add
