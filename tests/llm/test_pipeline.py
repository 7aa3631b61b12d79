import hashlib
import math
import random
import re

import duckdb
import pandas as pd
import public_tokenizers
import sentencepiece

import corpus_pipeline
from lexgrid.llm import mixing

from tests.llm import test_jaccard, test_pii, test_quality


def _documents():
    rng = random.Random(8)
    fresh = lambda n: [rng.choice("abcdefgh") + str(rng.randrange(500)) + "x" for _ in range(n)]
    rows, base = [], fresh(90)
    for i in range(80):
        words = list(base) if i % 4 == 0 else fresh(rng.choice([5, 30, 60]))
        words[rng.randrange(len(words))] = rng.choice(["4111111111111111", "a.b@c.de", "edit", "10.0.0.1"])
        if i % 9 == 0:
            words = words[:6] * 8
        rows.append((i, " ".join(words) + "\n", "en", rng.choice(["s1", "s2", "s3"]), 1))
    return rows + [(200, None, "en", "s1", None), (201, "", None, None, 0)]


def _masked(text):
    spans = [x.split(":") for x in test_pii.brute(text).split(",") if x]
    out, at = "", 0
    for kind, s, e in spans:
        if int(s) >= at:
            out += text[at : int(s)] + f"[{kind.upper()}]"
        at = max(at, int(e))
    return out + text[at:]


def test_run_equals_plain_python(spark, tmp_path):
    rows = _documents()
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    kept = [r for r in rows if (m := test_quality.brute(r[1]))[0] >= 10 and 100 * m[4] <= 20 * m[0]]
    classes = test_jaccard.brute([(r[0], r[1]) for r in kept])
    firsts = {d for d, c, _ in classes if d == c}
    assert 10 < len(firsts) < len(kept) < len(rows)
    documents = pd.DataFrame([(i, _masked(t), lang, s, n) for i, t, lang, s, n in kept if i in firsts], columns=columns)
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = []
    for r in duckdb.sql(mixing.SQL).df().itertuples():
        text = documents[documents.doc_id == r.doc_id].text.iloc[0]
        ids = [*sp.encode(text), 2]
        row = (r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())
        want += [row] * math.ceil(r.taken / max(1, r.size))
    assert got == sorted(want)


def test_stages_keep_columns(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == corpus_pipeline.COLUMNS, name
    assert re.match(r"\w", corpus_pipeline.STAGES[-1][0])


def test_mix_takes_rows_without_an_id_and_rows_of_one_id(spark):
    rng = random.Random(5)
    words = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randrange(500)) for _ in range(n))
    rows = [(i, words(20), "en", rng.choice(["s1", "s2"]), 1) for i in range(30)]
    rows += [(None, words(n), "en", s, None) for n in (11, 12, 13) for s in ("s1", "s2", None)] + [(None, "twice here", "en", "s1", 1)] * 2
    rows += [(500, words(14), "en", "s1", 1), (500, words(15), "en", "s2", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(map(str, (tuple(r) for r in corpus_pipeline.target_mix(spark, docs, "").collect())))

    # Sizes of the rows without an id, or of one id, differ within a source, but for the equal ones.
    taken = {}
    for r in mixing.mix(docs.withColumn("s", docs.source), carried=("s",)).collect():
        taken.setdefault((r.doc_id, r.s, r.size), []).append(math.ceil(r.taken / max(1, r.size)))
    want = []
    for key, group in {(r[0], r[3], len(r[1].split())): r for r in rows}.items():
        want += [str(group)] * sum(taken[key])
    assert got == sorted(want) and sum("(None" in x for x in got) >= 10


def test_near_duplicates_removes_only_equal_or_linked_texts(spark):
    rng = random.Random(7)
    fresh = lambda: " ".join(rng.choice("abcdefgh") + str(rng.randrange(500)) for _ in range(60))
    a, b, c, d = (fresh() for _ in range(4))
    rows = [(1, a), (2, a + " end"), (2, b), (2, b), (3, c), (3, d), (None, c + " end"), (None, b), (None, d[:150]), (None, d[:150])]
    docs = spark.createDataFrame([(i, t, "en", "s1", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((str(r.doc_id), r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert got == sorted([("1", a), ("2", b), ("3", c), ("3", d), ("None", d[:150])])


def test_quality_stage_uses_learned_cutoffs(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        words = [rng.choice("abcdefgh") + str(rng.randrange(5000)) + "x" for _ in range(40)]
        rows.append((i, " ".join(w + "%$" if i % 5 == 0 else w for w in words), "en" if i % 2 else None, "s1", 1, "clash"))
    spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(500)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    got = corpus_pipeline.quality_rules(spark, docs, str(tmp_path))
    assert got.columns == corpus_pipeline.COLUMNS
    assert sorted(r.doc_id for r in got.collect()) == [i for i in range(600) if i % 5]
