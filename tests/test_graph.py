from collections import deque

import pytest
from pyspark.sql import functions as F

from lexgrid.graph import algorithms as G
from lexgrid.graph import model as M
from lexgrid.graph.components import connected_components

EDGES = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 4), (7, 8), (2, 5), (1, 2)]
NODES = list(range(1, 10))


@pytest.fixture(scope="module")
def graph(spark):
    return spark.createDataFrame([(n,) for n in NODES], "id int"), spark.createDataFrame(EDGES, "src int, dst int")


def brandes(directed):
    near = {n: set() for n in NODES}
    for a, b in EDGES:
        near[a].add(b)
        if not directed:
            near[b].add(a)
    score = dict.fromkeys(NODES, 0.0)
    for s in NODES:
        order, before, paths, depth = [], {n: [] for n in NODES}, dict.fromkeys(NODES, 0), {s: 0}
        paths[s] = 1
        queue = deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in near[v]:
                if w not in depth:
                    depth[w] = depth[v] + 1
                    queue.append(w)
                if depth[w] == depth[v] + 1:
                    paths[w] += paths[v]
                    before[w].append(v)
        part = dict.fromkeys(NODES, 0.0)
        for w in reversed(order):
            for v in before[w]:
                part[v] += paths[v] / paths[w] * (1 + part[w])
            if w != s:
                score[w] += part[w]
    return score


@pytest.mark.parametrize("directed", [True, False])
def test_betweenness(graph, directed):
    nodes, edges = graph
    got = {r.id: r.score for r in G.betweenness(nodes, edges, nodes, directed).collect()}
    assert got == pytest.approx(brandes(directed))


def test_components(graph, spark):
    nodes, edges = graph
    weak = {r.id: r.component for r in G.weak_components(nodes, edges).collect()}
    assert weak == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 7, 8: 7, 9: 9}
    strong = {r.id: r.component for r in G.strong_components(nodes, edges).collect()}
    assert strong == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: 7, 8: 8, 9: 9}
    path = spark.createDataFrame([(i, i + 1) for i in range(60)], "src int, dst int")
    assert {r.component for r in connected_components(path).collect()} == {0}
    assert connected_components(path.limit(0)).count() == 0


def test_pagerank_forms(graph):
    nodes, edges = graph
    total = G.pagerank_normalised(nodes, edges).agg(F.sum("score")).first()[0]
    assert total == pytest.approx(1.0, abs=1e-6)
    scores = {r.id: r.score for r in G.pagerank(nodes, edges, 1).collect()}
    assert scores[9] == pytest.approx(0.15) and scores[8] == pytest.approx(0.15 + 0.85 * 0.15)
    assert sum(r.score**2 for r in G.eigenvector(nodes, edges, 5).collect()) == pytest.approx(1.0)


def test_louvain_finds_cliques(spark):
    pairs = [(a + k, b + k) for k in (0, 10, 20) for a in range(5) for b in range(a)] + [(0, 10), (10, 20)]
    edges = spark.createDataFrame(pairs, "src int, dst int")
    parts = G.louvain(edges)
    assert parts.count() == 15
    q = G.modularity(edges, parts).first().q
    want = G.modularity(edges, parts.select("id", F.floor(F.col("id") / 10).alias("part"))).first().q
    assert q >= want - 1e-9


def test_catalog_and_upserts(graph, spark):
    nodes, edges = graph
    catalog = M.GraphCatalog()
    n, _ = catalog.project("g", edges)
    assert n.count() == 8 and catalog.names() == ["g"]
    with pytest.raises(ValueError):
        catalog.project("g", edges)
    assert catalog.drop("g") and not catalog.drop("g")
    old = spark.createDataFrame([("a", 0), ("b", 0)], "k string, v int")
    new = spark.createDataFrame([("b", 1, 1), ("c", 1, 2), ("c", 2, 3), (None, 9, 4)], "k string, v int, o int")
    assert sorted(map(tuple, M.first_wins(new, old, "k", "o").collect())) == [("a", 0), ("b", 0), ("c", 1)]
    assert sorted(map(tuple, M.last_wins(new, old, "k", "o").collect())) == [("a", 0), ("b", 1), ("c", 2)]


def test_betweenness_in_parts(spark):
    """Searches that reach more than `most` nodes are halved; the sums stay."""
    nodes, edges = spark.range(4), spark.createDataFrame([(0, 1), (1, 2), (2, 3), (0, 2), (3, 0)], "src long, dst long")
    whole, parts = ({r.id: r.score for r in G.betweenness(nodes, edges, nodes, most=m).collect()} for m in (1000, 10))
    assert whole == parts == {0: 3.0, 1: 0.0, 2: 3.0, 3: 3.0}


def test_components_of_a_forest_take_one_write_a_round(spark, monkeypatch):
    """Chains hang each node under one other from the start: a join a round, no minima."""
    from lexgrid.graph import components

    written = []
    monkeypatch.setattr(components, "durable", lambda df, real=components.durable: (written.append(1), real(df))[1])
    path = spark.createDataFrame([(i, i + 1) for i in range(64)], "src int, dst int")
    assert {r.component for r in connected_components(path).collect()} == {0}
    assert len(written) <= 11


def test_components_of_a_random_graph(spark):
    import random

    draw = random.Random(5)
    pairs = [(draw.randrange(300), draw.randrange(300)) for _ in range(190)] + [(299, i) for i in range(0, 60, 2)] + [(7, None), (None, None)]
    near = {}
    for a, b in pairs[:-2]:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for n in sorted(near):
        todo = [n] if n not in want else []
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = n
                todo += near[x]
    assert {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "src int, dst int")).collect()} == want


def test_rounds_leave_held_links_in_place(spark):
    """A round shuffles what is sent, not the links; nodes that stand twice send and get twice, unknown ends get nothing."""
    from lexgrid.runtime import held

    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 9)], "src int, dst int")
    nodes = spark.createDataFrame([(1,), (2,), (2,), (3,)], "id int")
    links = held(edges.withColumn("n", F.lit(1)), "src")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scores = nodes.groupBy("id").agg(F.count("*").alias("copies"), F.lit(1.0).alias("score"))
        plan = G._received(links, scores, scores.select("id", "copies", F.lit(0.0).alias("own")), "n")._jdf.queryExecution().executedPlan().toString()
        assert plan.split("InMemoryRelation")[0].count("Exchange hashpartitioning(src") == 0
        got = sorted((r.id, round(r.score, 6)) for r in G.pagerank(nodes, edges, 2).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        links.unpersist()
    first = {1: 0.15 + 0.85 * 0.15, 2: 0.15 + 0.85 * 0.15, 3: 0.15 + 0.85 * 0.15}
    want = {1: 0.15 + 0.85 * first[2], 2: 0.15 + 0.85 * first[1], 3: 0.15 + 0.85 * first[2]}
    assert got == sorted((i, round(want[i], 6)) for i in (1, 2, 2, 3))


def test_strong_components_bridge_chains(spark, monkeypatch):
    """A ring and a chain of one-in-one-out nodes are bridged in few rounds; colours don't walk along them."""
    rounds = []
    monkeypatch.setattr(G, "_spread", lambda c, e, real=G._spread: (rounds.append(e.count()), real(c, e))[1])
    pairs = [(i, (i + 1) % 40) for i in range(40)] + [(0, 50)] + [(i, i + 1) for i in range(50, 60)] + [(60, 61), (61, 60)]
    nodes, edges = spark.createDataFrame([(i,) for i in range(70)], "id int"), spark.createDataFrame(pairs, "src int, dst int")
    got = {r.id: r.component for r in G.strong_components(nodes, edges).collect()}
    assert got == {i: 0 if i < 40 else 60 if i in (60, 61) else i for i in range(70)}
    assert sum(rounds) < 20


def test_louvain_of_a_bounded_graph_takes_one_task(spark, monkeypatch):
    """No rounds over all tasks: the links, the nodes and the result are written, and nothing else."""
    written = []
    monkeypatch.setattr(G, "durable", lambda df, real=G.durable: (written.append(1), real(df))[1])
    pairs = [(a + k, b + k) for k in range(0, 200, 10) for a in range(6) for b in range(a)] + [(k, k + 10) for k in range(0, 190, 10)] + [(3, 3)]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    parts = G.louvain(edges)
    assert parts.count() == 120 and len(written) <= 3
    want = G.modularity(edges, parts.select("id", F.floor(F.col("id") / 10).alias("part"))).first().q
    assert G.modularity(edges, parts).first().q >= want - 1e-9


def test_louvain_of_a_larger_graph(spark):
    """Beyond the bound a level takes rounds over all tasks; its contracted graph goes to one task, with what lies inside its nodes."""
    pairs = [(a + k, b + k) for k in range(0, 40, 10) for a in range(5) for b in range(a)] + [(k, (k + 10) % 40) for k in range(0, 40, 10)]
    edges = spark.createDataFrame([(f"n{a:02}", f"n{b:02}") for a, b in pairs], "src string, dst string")
    parts = G.louvain(edges, moves=2, most=40)
    assert parts.count() == 20
    want = G.modularity(edges, parts.select("id", F.substring("id", 2, 1).alias("part"))).first().q
    assert G.modularity(edges, parts).first().q >= want - 0.1
