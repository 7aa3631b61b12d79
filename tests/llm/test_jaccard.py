import random
import re

from pyspark.sql import functions as F

from lexgrid.llm import jaccard


def shingle_set(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if 0 < len(w) < n:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, least[find(i)], links[i]) for i, (d, _) in enumerate(rows))


def test_equals_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    fresh = lambda n: [rng.choice("abcdefgh") + str(rng.randrange(300)) + rng.choice("éüß") for _ in range(n)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "a b"), (4, "a  b"), (5, "b a"), (6, "x y z w v"), (7, "x y z w v")]
    for base in (fresh(300), fresh(120), fresh(60), fresh(2000)):
        for _ in range(25):
            words = list(base)
            for _ in range(rng.randrange(1 + len(base) // 60)):
                words[rng.randrange(len(words))] = "edit" + str(rng.randrange(1000))
            rows.append((len(rows) * 7 % 1009, " ".join(words[rng.randrange(3) :])))
    rows += [(2000 + i, " ".join(fresh(80))) for i in range(40)] + [(3000, rows[20][1]), rows[20], rows[20]]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, component int")
    for block in (256, 5):
        monkeypatch.setattr(jaccard, "BLOCK", block)
        assert sorted(map(tuple, jaccard.join(df).collect())) == brute(rows), block
    assert jaccard.join(df.limit(0)).count() == 0
    assert jaccard.join(df.where("doc_id in (0, 6)")).count() == 2


def test_band_number_reaches_recall():
    b = jaccard.bands(0.8, 5, 0.9999)
    assert 1 - (1 - 0.8**5) ** b >= 0.9999 > 1 - (1 - 0.8**5) ** (b - 1)


def test_rows_without_an_id_link(spark):
    rng = random.Random(6)
    base = [rng.choice("abcdefgh") + str(rng.randrange(300)) for _ in range(200)]
    text = lambda i: " ".join([*base[:i], "edit", *base[i + 1 :]])
    other = " ".join("z" + w for w in base)
    rows = [(None, text(3)), (None, text(3)), (None, text(90)), (8, text(120)), (9, "quite another text of its own here"), (None, other), (None, other + " more"), (None, None)]
    got = sorted(map(str, (tuple(r) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect())))
    assert got == sorted(["(None, 8, 3)"] * 3 + ["(8, 8, 3)", "(9, 9, 0)"] + ["(None, None, 1)"] * 2 + ["(None, None, 0)"])


def test_work_per_document_is_flat_in_a_chain(spark):
    """Each text is like its next neighbours only, so all hang together, but none needs more than its neighbours."""
    rng = random.Random(9)
    words = [rng.choice("abcdefgh") + str(rng.randrange(100_000)) for _ in range(4000)]
    rows = [(i, " ".join(words[5 * i : 5 * i + 100])) for i in range(600)]
    sent = {}
    for n in (60, 600):
        df = spark.createDataFrame(rows[:n], "doc_id long, text string")
        sketched = jaccard.sketch(df.withColumn("row_id", jaccard.row_id()), 5, 24, 5)
        classes = sketched.select("digest", "doc_id", "row_id", F.lit(1).cast("long").alias("copies"), "size", "bands")
        sent[n] = jaccard.needed(classes, 0.8).count() / n
        got = jaccard.join(df).collect()
        assert {r.class_id for r in got} == {0} and all(2 <= r.n_links <= 4 for r in got[3:-3])
    assert sent[600] < 1.2 * sent[60] and sent[600] < 24


def test_large_texts_make_blocks_of_their_own(spark, monkeypatch):
    rng = random.Random(3)
    base = [rng.choice("abcdefgh") + str(rng.randrange(3000)) for _ in range(30_000)]
    rows = [(i, " ".join([*base[: 900 * i], f"edit{i}", *base[900 * i + 1 :]])) for i in range(12)]
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 70_000)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, digest string")
    assert sorted(map(tuple, jaccard.join(df).collect())) == [(i, 0, 11) for i in range(12)]
