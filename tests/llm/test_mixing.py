import random
import re

import duckdb

from lexgrid.llm import mixing


def _targets(size_of):
    order = sorted(size_of, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    free, left, out = set(order), 1.5 * sum(size_of.values()), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level >= 2 * size_of[s]}
        if not over:
            return out | {s: weight[s] * level for s in free}
        for s in over:
            out[s] = 2.0 * size_of[s]
            left -= out[s]
        free -= over
    return out


def test_against_water_filling_and_sql(spark):
    rng = random.Random(5)
    rows = []
    for i in range(600):
        source = rng.choice(["a", "a", "a", "a", "b", "c", "d", None, "é"])
        rows.append((i if i % 50 else None, rng.choice([None, "", "w " * rng.randrange(40), "é\tü\n"]), source, 7))
    rows += rows[:5]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.mix(df).toPandas()
    assert len(got) == len(rows)
    size_of = {}
    for _, text, source, _ in rows:
        size_of[source] = size_of.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = _targets(size_of)
    for source, total in size_of.items():
        part = got[(got.source_size == total) & ((got.target - want[source]).abs() < 1e-6)]
        assert len(part)
        assert part.taken.sum() % int(want[source]) == 0
    assert (got.taken <= 2 * got["size"]).all()
    documents = df.toPandas()
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    expected = duckdb.sql(mixing.SQL).df()
    assert len(expected) == len(got)
    for c in ("size", "source_size", "taken"):
        assert sorted(expected[c]) == sorted(got[c])
    assert abs(expected.target - got.sort_values("target").target.values[0]).min() < 1e-6
    assert mixing.mix(df.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a b", "s")], "doc_id long, text string, source string")
    plan = mixing.mix(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert [tuple(r) for r in mixing.mix(df).collect()] == [(1, 2, 2, 3.0, 3)]
