import math

import numpy as np
from pyspark.sql import functions as F

from lexgrid.llm import ann


def _data(n=3000, d=16, seed=3):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(12, d))
    x = centre[rng.integers(0, 12, n)] + 0.15 * rng.normal(size=(n, d))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _brute(rows, k):
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in good:
        if q % 20 == 0:
            out[q] = sorted((-float(v @ w), i) for i, w in good if i != q)[:k]
    return out


def test_recall_and_exact_scores(spark):
    x = _data()
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.search(df, F.col("vec_id") % 20 == 0).toPandas()
    want = _brute(rows, 20)
    assert len(got) == 20 * len(want) and got.groupby("query_id")["rank"].apply(list).map(lambda r: sorted(r) == list(range(1, 21))).all()
    hits = sum(len(set(part.vec_id) & {i for _, i in want[q]}) for q, part in got.groupby("query_id"))
    assert hits / (20 * len(want)) >= 0.9
    for r in got.head(200).itertuples():
        assert abs(r.score - float(x[r.query_id].astype(float) @ x[r.vec_id].astype(float))) < 1e-12


def test_odd_vectors_copies_and_few_candidates(spark):
    same = [1.0, 2.0, 0.5]
    rows = [(i, same) for i in range(60)] + [(100, None), (120, [0.0, 0.0, 0.0]), (140, [1.0, None, 2.0]), (160, [float("nan"), 1.0, 1.0]), (180, [float("inf"), 1.0, 1.0]), (None, same), (200, [3.0, 1.0, 1.0]), (200, [3.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1))
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert sorted(got) == [0, 20, 40, 200]
    assert [i for _, i in sorted(got[0])] == [200, *range(1, 20)]
    assert [i for _, i in sorted(got[20])] == [200, *range(19)]
    assert [i for _, i in sorted(got[200])] == list(range(20))
    assert ann.search(df.where("vec_id in (0, 1)"), F.col("vec_id") % 20 == 0).count() == 1
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_large_leaves_are_split_and_queries_dealt(spark, monkeypatch):
    for name, value in dict(SAMPLE=400, CALIBRATION=40, SPLIT=100, SPLIT_SAMPLE=80, SHARD=150, QUERY_BLOCK=20, MERGE=3).items():
        monkeypatch.setattr(ann, name, value)
    grafted = []
    graft = ann.Tree.graft
    monkeypatch.setattr(ann.Tree, "graft", lambda self, found: (graft(self, found), grafted.append(len(found))))
    x, short = _data(), _data(300, 5)
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)] + [(5000 + i, [float(a) for a in v]) for i, v in enumerate(short)] + [(9000, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.search(df, F.col("vec_id") % 20 == 0).toPandas()
    assert max(grafted) > 3
    want = {**_brute(rows[:3000], 20), **_brute(rows[3000:3300], 20)}
    assert set(got.query_id) == set(want) and len(got) == 20 * len(want)  # the only vector of length one has no candidate
    hits = sum(len(set(part.vec_id) & {i for _, i in want[q]}) for q, part in got.groupby("query_id"))
    assert hits / (20 * len(want)) >= 0.9
    assert all((r.query_id < 5000) == (r.vec_id < 5000) for r in got.itertuples())


def test_grafted_tree_assigns_and_visits_every_leaf_once():
    x = _data(2000).astype(float)
    tree = ann.Tree(x[:300])
    leaf = tree.assign(x)
    subtrees = {int(i): ann.Tree(x[leaf == i]) for i in np.unique(leaf) if (leaf == i).sum() > 60}
    before = tree.leaves
    tree.graft(subtrees)
    assert tree.leaves == before + sum(t.leaves - 1 for t in subtrees.values()) > before
    assert sorted(tree.visit(x[0], tree.leaves)) == list(range(tree.leaves))
    assert set(tree.assign(x)) <= set(range(tree.leaves)) and np.bincount(tree.assign(x)).max() < 2 * ann.LEAF + 60
