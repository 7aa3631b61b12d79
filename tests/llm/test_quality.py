import random
import re
from math import comb

import numpy as np
import pytest

from lexgrid.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows, covered, seen, dup = {}, set(), set(), 0
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    for at in windows.values():
        if len(at) > 1:
            covered |= {i + j for i in at for j in range(5)}
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_measures_equal_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", " \n\t", "é#ü $", "a b c d e a b c d e f", "x\nx\n \n \nx ", "a b c d\x0be"] + [" ".join(rng.choice(["a", "b", "é\n", "#", "\n", "d*d"]) for _ in range(rng.randrange(80))) for _ in range(200)]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.report(df, labels).collect()}
    for i, t in enumerate(texts):
        r, want = got[i], brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert r.kept == (not r.base_failed)


def test_bound_is_the_exact_binomial_one():
    for k, n, delta in ((0, 50, 0.05), (3, 200, 0.01), (7, 90, 0.001)):
        p = quality.upper_bound(k, n, delta)
        assert sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) == pytest.approx(delta, rel=1e-4)
    assert quality.upper_bound(0, 0, 0.05) == 1.0
    assert quality.upper_bound(1_000_000, 50_000_000, 0.01) == pytest.approx(0.02 + 2.33 * (0.02 * 0.98 / 50e6) ** 0.5, rel=1e-5)


def test_path_is_nested_and_takes_the_purest_rows_first():
    rng = np.random.default_rng(0)
    x = rng.integers(20, 50, (400, len(quality.RULES)))
    good = np.arange(400) % 4 > 0
    x[~good, 1] = 5
    x[:8, 2], good[:8] = 3, False
    x[5, 2], good[5] = 3, True
    path = quality.lay_path(x, good)
    assert path[0] == (1, 5) and (2, 3) in path
    by_rule = {}
    for rule, step in path:
        assert step > by_rule.get(rule, -1)
        by_rule[rule] = step
    assert quality.lay_path(np.zeros((0, 5), int), np.zeros(0, bool)) == []
    assert quality.lay_path(x, np.ones(400, bool)) == []


def test_choose_stops_at_the_first_step_that_fails():
    assert quality.choose({}, {0: 10, 1: 10}, 200, 2, 1) == 1
    assert quality.choose({1: 9}, {0: 10, 1: 500}, 200, 2, 1) == 0
    assert quality.choose({}, {0: 10}, quality.LEAST - 1, 1, 1) is None
    assert quality.choose({}, {0: 10}, quality.LEAST, 1, 2) is None
    assert quality.choose({}, {}, 500, 1, 1) is None


def test_cutoffs_reject_bad_and_keep_good(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(2200):  # odd ids, en, stand for a large stratum; null for another, and every 8th is a language of its own
        words = [rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randrange(1, 9) + str(rng.randrange(999)) for _ in range(40)]
        bad = i % 5 == 0
        rows.append((i, " ".join(w + "%%%" if bad else w for w in words), "en" if i % 2 else None if i % 8 else f"rare{i}", "x"))
        if i < 2100:
            labels += [(i, 0 if bad else 1)] * (2 if i % 7 == 0 else 1)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string")
    got = quality.report(df, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(got) == 2200
    assert all(not r.kept for r in got if r.doc_id % 5 == 0)
    good = [r.kept for r in got if r.doc_id % 5]
    assert sum(good) >= 0.98 * len(good)
    twice = quality.report(df.unionByName(df.where("doc_id < 20")), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(twice) == 2220 and {r.doc_id for r in twice if not r.kept} == {r.doc_id for r in got if not r.kept}
    assert quality.report(df.limit(0), spark.createDataFrame(labels, "doc_id long, quality int")).count() == 0
