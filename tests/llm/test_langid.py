import random
import zlib

import numpy as np

from lexgrid.llm import langid

WORDS = {"aa": "the of and ing tion", "bb": "der die und ung ch", "çç": "que de la ción ñ"}


def _rows(n):
    rng = random.Random(6)
    rows = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        rows.append((i, " ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.randrange(4, 60))), lang, "x"))
    return rows


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 256, (5, 4)).astype(np.uint8), np.array([0, 1, 2, 1])
    net = langid.BiGRU(["a", "b", "c"], hidden=3)
    _, grad = net.loss(x, y)
    for name, g in grad.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        kept, losses = net.p[name][at], []
        for step in (1e-5, -1e-5):
            net.p[name][at] = kept + step
            losses.append(net.loss(x, y)[0])
        net.p[name][at] = kept
        assert abs((losses[0] - losses[1]) / 2e-5 - g[at]) < 1e-6


def test_folded_run_equals_forward_pass_and_pools_positions():
    net = langid.BiGRU(["a", "b"], hidden=4)
    text = "abc é " * 30
    data = np.frombuffer(text.encode(), np.uint8)[: langid.SEGMENT]
    x = data[:, None]
    f, b = net._forward(x, "f"), net._forward(x[::-1], "b")
    state = np.concatenate([np.stack([s[5] for s in f]), np.stack([s[5] for s in b])[::-1]], 2)
    logits = state @ net.p["v"] + net.p["c"]
    want = np.exp(logits) / np.exp(logits).sum(2, keepdims=True)
    assert np.abs(net.positions(x) - want).max() < 1e-4
    assert np.abs(net.texts(data, np.array([0, len(data)]))[0] - want.mean((0, 1))).max() < 1e-4
    assert len(net.label_positions(text)) == len(text.encode())


def test_held_out_accuracy_and_odd_rows(spark):
    rows = _rows(900) + [(5000, None, "aa", "x"), (5001, "", "aa", "x"), (5002, "123 !?", "aa", "x"), (None, "the of and the of", "bb", "x"), (5003, "la de que", None, "x"), (5003, "la de que", None, "x")]
    rare = [i for i in range(7000, 7100) if zlib.crc32(str(i).encode()) % 5][:3]
    rows += [(i, "жук лес мир ночь " * 5, "rare", "x") for i in rare] + [(6000, "лес мир " * 200_000, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = langid.identify(df).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    truth = {i: lang for i, _, lang, _ in rows[:900]}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(by_id[i].held_out == (i in set(held)) for i in truth)
    assert sum(by_id[i].lang_pred == truth[i] for i in held) >= 0.95 * len(held)
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (5000, 5001, 5002))
    assert by_id[6000].lang_pred == "rare"  # a language of three rows is learned, and a long text read whole
    assert by_id[None].lang_pred in WORDS and by_id[None].held_out is False
    assert all(0 <= r.score <= 1 for r in got)
    assert langid.identify(df.limit(0)).count() == 0
    unlabelled = langid.identify(df.where("lang is null")).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}
