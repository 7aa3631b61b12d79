import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from lexgrid.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    found = []
    for rank, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            digits = re.sub(r"[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 12 <= len(digits) <= 19 and sum(int(d) if i % 2 == 0 else sum(map(int, str(2 * int(d)))) for i, d in enumerate(digits[::-1])) % 10 == 0,
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                found.append((m.start(), rank, kind, m.end()))
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(found))


FIXED = [None, "", "é𝄞 a.b@c.de x@y @z.de a@b..c a@b.c@d.e", "1.2.3.4.5.6.7.8 256.1.1.1 0000.01.1.255", "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111", "+1 (988) 555-2485 or +49.30.1234567. +1", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7", "a" * 20000 + "@", "1" * 20000, "+" + "1 " * 3000]


def test_base_equals_brute_force(spark):
    rng = random.Random(7)
    texts = FIXED + ["".join(rng.choice("0123456789  .-+()@ab\n") for _ in range(rng.randrange(120))) for _ in range(400)]
    texts += [" ".join(rng.choice(["4111111111111111", "+1 (988) 555-2485", "10.0.0.1", "x.y@z.com", "12-34", "zz"]) for _ in range(9)) for _ in range(100)]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, row int")
    rows = pii.find(df, seeds=10**9).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        assert r.spans == want, texts[r.doc_id][:200]
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(want.count(f"{k}:") for k in PATTERNS)


def test_contexts_of_seeds_find_unseen_identifiers(spark):
    rows = [(i, f"some words then mail me at user{i}@mail{i}.org today or never again", None) for i in range(12)]
    rows += [(50, "please mail me at kontakt(at)99firma today, built in 1999ish style", None), (51, None, None), (50, "please mail me at kontakt(at)99firma today, built in 1999ish style", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in pii.find(df).collect()}
    text = rows[12][1]
    s = text.index("kontakt")
    assert got[50].spans == f"id:{s}:{s + len('kontakt(at)99firma')}" and got[50].n_added == 1
    assert got[51].spans == "" and got[3].n_email == 1
    masked = {r.doc_id: r.text for r in pii.mask(df).collect()}
    assert masked[50] == "please mail me at [ID] today, built in 1999ish style"
    assert masked[0] == "some words then mail me at [EMAIL] today or never again" and masked[51] is None
    assert pii.find(df.limit(0)).count() == 0 and pii.mask(df.limit(0)).count() == 0


def test_found_instances_induce_further_patterns(spark):
    """Mails teach "mail me at", which finds codes; these teach "ticket holder", which finds a code that stands nowhere else."""
    code = lambda i: f"code{i}x{i * 7}x"
    rows = [f"some words then mail me at user{i}@mail{i}.org today" for i in range(12)]
    rows += [f"or mail me at {code(i)} any time" for i in range(10)]
    rows += [f"every ticket holder {code(i)} waits outside" for i in range(10)] + ["every ticket holder unseen_77 waits inside"]
    rows += [f"about item no_{i}5 of some" for i in range(30)]
    df = spark.createDataFrame(list(enumerate(rows)) + [(len(rows), rows[32]), (None, rows[32])], "doc_id long, text string").withColumn("row", F.lit("clash"))
    got = [(r.doc_id, r.spans) for r in pii.find(df).collect()]
    want = lambda t, x: f"id:{t.index(x)}:{t.index(x) + len(x)}"
    spans = dict(got)
    assert len(got) == len(rows) + 2
    for i in range(10):
        assert spans[12 + i] == want(rows[12 + i], code(i)) and spans[22 + i] == want(rows[22 + i], code(i))
    assert spans[32] == spans[len(rows)] == spans[None] == want(rows[32], "unseen_77")
    assert all(spans[i] == "" for i in range(33, 63))


def test_fixed_point_equals_plain_python(spark):
    rng = random.Random(5)
    edges = sorted({(rng.randrange(40), rng.randrange(120)) for _ in range(420)} | {(p, i) for p in range(3) for i in range(12)})
    seed = {i for i in range(120) if i < 12 or rng.random() < 0.12}
    df = spark.createDataFrame([(p, i, i in seed) for p, i in edges], "pattern long, instance long, seed boolean")
    got = {r.pattern: r.confidence for r in pii.score_patterns(df, 3, 0.4).collect()}
    score = {i: 1.0 for i in seed if any(j == i for _, j in edges)}
    while True:
        own = {p: [score.get(i, 0.0) for q, i in edges if q == p] for p, _ in edges}
        admitted = {p: sum(x) / len(x) for p, x in own.items() if sum(y >= 0.4 for y in x) >= 3 and sum(x) / len(x) >= 0.4}
        new = {i: 1.0 for i in score if i in seed}
        for i in {i for p, i in edges if p in admitted and i not in seed}:
            doubt = 1.0
            for p in {p for p, j in edges if j == i and p in admitted}:
                doubt *= max(1 - admitted[p], 1e-9)
            new[i] = round(1 - doubt, 3)
        if new == score:
            break
        score = new
    assert len(admitted) > 3 and got.keys() == admitted.keys()
    assert all(abs(got[p] - admitted[p]) < 1e-3 for p in got)


def test_pattern_filter_has_every_pattern(spark):
    values = [0, 1, -1, 7, (1 << 25) - 1, 1 << 25, -(1 << 63), (1 << 63) - 1, 123456789123]
    bits = pii._filter(spark.createDataFrame([(v,) for v in values], "pattern long"))
    assert np.flatnonzero(np.unpackbits(bits, bitorder="little")).tolist() == sorted({v % (1 << 25) for v in values})


def test_a_pattern_must_be_specific(spark):
    rows = [f"write to user{i}@mail{i}.org today" for i in range(12)] + ["we go to town and to work and to bed"] * 9 + ["write to box_number_9 or go to code_5555 now"]
    got = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    s = rows[21].index("box_number_9")
    assert got[21] == f"id:{s}:{s + 12}"
