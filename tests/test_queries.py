"""Every registered query of the library against DuckDB on the smallest tables, and the entry without the optional subpackage."""

import math
import os
import subprocess
import sys

import duckdb
import pytest

from lexgrid.plans import graph, relational, texts, trees  # noqa: F401
from lexgrid.plans.registry import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"create view {name} as select * from read_parquet('{FOLDER}/{name}.parquet')")
    return con


def rows(values):
    plain = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else round(v, 6) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(map(plain, r)) for r in values), key=lambda r: tuple(map(str, r)))


#: Iterative ones on small tables are covered in test_graph.
SLOW = {"g9_louvain", "g5_betweenness_sampled", "g7_eigenvector", "g2_pagerank_normalised", "g14_strong_components", "g6_betweenness_exact", "g1_pagerank20"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = rows([r[c] for c in columns] for r in df.collect())
    if name in SQL:
        want = duck.sql(SQL[name])
        assert sorted(want.columns) == columns
        at = [want.columns.index(c) for c in columns]
        assert got == rows([r[i] for i in at] for r in want.fetchall())


def test_entry_without_the_optional_subpackage(tmp_path):
    for x in os.listdir(ROOT):
        if x not in ("corpus_pipeline.py", ".git", "lexgrid", "tests"):
            os.symlink(f"{ROOT}/{x}", tmp_path / x)
    os.mkdir(tmp_path / "lexgrid")
    for x in os.listdir(f"{ROOT}/lexgrid"):
        if x != "llm":
            os.symlink(f"{ROOT}/lexgrid/{x}", tmp_path / "lexgrid" / x)
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text(open(f"{ROOT}/__spark_entry__.py").read())
    code = "import __spark_entry__ as e; n = e.queries(); assert len(n) > 100 and not any(k.startswith('op1_') for k in n); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_partitions_grow_with_the_table(spark, tmp_path, monkeypatch):
    from lexgrid import runtime

    spark.conf.unset(runtime.INITIAL_PARTS)
    monkeypatch.setattr(runtime, "PART_BYTES", 1000)
    try:
        graph.Tables(spark, FOLDER).lineitem  # noqa: B018
        assert int(spark.conf.get(runtime.INITIAL_PARTS)) >= os.path.getsize(f"{FOLDER}/lineitem.parquet") // 1000
    finally:
        spark.conf.unset(runtime.INITIAL_PARTS)


def test_top_phrases_shuffle_texts_only(spark):
    plan = QUERIES["a28_top_phrases"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
