import numpy as np

from lexgrid.operators import tables as O


def test_sample_is_the_same_at_every_run(spark):
    df = spark.range(500)
    a, b = ({r.id for r in O.sample(df.repartition(n), "id", 20).collect()} for n in (1, 7))
    assert len(a) == 20 and a == b


def test_mmr_equals_brute_force(spark):
    x = np.random.default_rng(2).normal(size=(40, 4))
    df = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(x)], "label int, vec_id long, embedding array<double>")
    q = np.array([1.0, 0.5, 0.0, -1.0])
    near, chosen = x @ q, []
    while len(chosen) < 5:
        score = near if not chosen else 0.5 * near - 0.5 * (x @ x[chosen].T).max(1)
        chosen.append(int(max((i for i in range(40) if i not in chosen), key=lambda i: score[i])))
    assert [r.vec_id for r in O.mmr(df, q.tolist()).orderBy("rank").collect()] == chosen


def test_mmr_ranks_all_rows_of_a_group(spark):
    rng = np.random.default_rng(3)
    q = np.array([1.0, 0.5, 0.0, -1.0])
    x = np.concatenate([q + rng.normal(size=(300, 4)) / 1000, rng.normal(size=(60, 4))])
    rows = [(label, i, v.tolist()) for label in (1, None) for i, v in enumerate(x)] + [(2, 7, x[0].tolist()), (2, 7, x[0].tolist())]
    near, chosen = x @ q, []
    while len(chosen) < 5:
        score = near if not chosen else 0.5 * near - 0.5 * (x @ x[chosen].T).max(1)
        chosen.append(int(max((i for i in range(len(x)) if i not in chosen), key=lambda i: score[i])))
    assert max(chosen) >= 300
    got = O.mmr(spark.createDataFrame(rows, "label int, vec_id long, embedding array<double>"), q.tolist()).orderBy("rank").collect()
    assert [r.vec_id for r in got if r.label == 1] == chosen
    assert [r.vec_id for r in got if r.label is None] == chosen
    assert [(r["rank"], r.vec_id) for r in got if r.label == 2] == [(1, 7), (2, 7)]


def test_mmr_without_a_vector(spark):
    df = spark.createDataFrame([(2, 7, [1.0]), (2, 8, None)], "label int, vec_id long, embedding array<double>")
    assert [tuple(r) for r in O.mmr(df, [1.0]).collect()] == [(2, 1, 7)]
