import hashlib
import random
import re

import numpy as np

from lexgrid.llm import substring_dedup as sd


def brute(rows, window):
    docs = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, w in docs:
        for s in range(len(w) - window + 1 if i is not None else 0):
            key = tuple(w[s : s + window])
            least[key] = min(least.get(key, i), i)
    out = []
    for i, w in docs:
        cover = set()
        for s in range(len(w) - window + 1 if i is not None else 0):
            if least[tuple(w[s : s + window])] < i:
                cover |= set(range(s, s + window))
        kept = [x for j, x in enumerate(w) if j not in cover]
        out.append((i, len(w), len(cover), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def cases():
    rng = random.Random(11)
    fresh = lambda n: [rng.choice("abcdefghij") + rng.choice("éüxyz") + str(rng.randrange(40)) for _ in range(n)]
    passages = [fresh(n) for n in (50, 51, 60, 49, 120, 300)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rng.randrange(4)):
            words += fresh(rng.randrange(40)) + (rng.choice(passages) if rng.random() < 0.7 else [])
        rows.append((i * 3 % 119, rng.choice([" ", "\n", " \t"]).join(words)))
    base = fresh(200)
    for i in range(40):  # near copies
        words = list(base)
        words[rng.randrange(200)] = "edit"
        rows.append((1000 + i, " ".join(words)))
    rows += [(2000, " ".join(["same"] * 400)), (2001, " ".join(["same"] * 130)), (2002, None), (2003, ""), (None, " ".join(base)), (1000, rows[-1][1]), (1000, rows[-1][1])]
    return rows


def test_equals_brute_force_in_whole_and_dealt_groups(spark):
    rows = cases()
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_words int")
    want = brute(rows, 50)
    for size in (400_000, 900, 120):
        got = sorted(map(tuple, sd.deduplicate(df, digests=True, tree_words=size).collect()), key=str)
        assert got == want, size
    assert sd.deduplicate(df.limit(0)).count() == 0


def test_kept_text(spark):
    long = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(1, long), (2, f"a\n{long}  z")], "doc_id long, text string")
    assert sorted(map(tuple, sd.deduplicate(df).collect())) == [(1, 50, 0, long), (2, 52, 50, "a z")]


def test_suffix_tree_shares_what_neighbours_share():
    rng = random.Random(2)
    words = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(1, 40))] for _ in range(30)] + [[b"a"] * 70, [b"a"] * 70]
    offset, order, shared = sd.suffix_tree(words)
    text, end = [], []
    for i, w in enumerate(words):
        text += [*w, i]
        end += [i] * (len(w) + 1)
    suffix = lambda x: text[x : offset[end[x]] + len(words[end[x]])]
    assert sorted(order.tolist()) == list(range(len(text)))
    for a, b, n in zip(order, order[1:], shared[1:]):
        x, y = suffix(a), suffix(b)
        assert n == next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))


def test_nodes_are_the_repeats_and_know_their_length():
    base = [f"w{i}".encode() for i in range(80)]
    words = [base, base[5:65], [b"x", *base[10:62], b"y"]]
    run, which, node, depth = sd.nodes(words, np.array([31, 11, 5]), 50)
    by_window = {}
    for r, k, n in zip(run, which, node):
        by_window.setdefault(tuple(words[r][k : k + 50]), set()).add(n)
    assert all(len(n) == 1 for n in by_window.values()) and len(set.union(*by_window.values())) == len(by_window)
    assert depth[node[(run == 1) & (which == 0)][0]] == 60 and depth[node[(run == 2) & (which == 1)][0]] == 52


def test_very_long_runs_and_periods(spark):
    a, b = " ".join(["same"] * 300_000), " ".join(["one", "two", "three"] * 50_000)
    rows = [(1, a), (2, a + " end"), (3, b), (4, "start " + b), (5, "w " * 49)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (400_000, 100_000):
        got = sorted((r.doc_id, r.n_words, r.n_removed) for r in sd.deduplicate(df, digests=True, tree_words=size).collect())
        assert got == [(1, 300_000, 0), (2, 300_001, 300_000), (3, 150_000, 0), (4, 150_001, 150_000), (5, 49, 0)]
