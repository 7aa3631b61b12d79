import hashlib
import random

import public_tokenizers
import sentencepiece

from lexgrid.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  a  b  ", "\t a\nb", "▁x", "a ▁ b", "x\r\n y", "</s> <0x0A>", " ", "a\x00b", "ﬁ　ü", "word" * 5000, " " * 999, "é " * 3000, "日本語 テキスト"]


def _expected(text):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    ids = [*sp.encode(text or ""), 2]
    return ids, sp.decode(ids)


def test_equals_library_on_odd_and_random_texts():
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(" \n\tabcé▁1<>日") for _ in range(rng.randrange(60))) for _ in range(400)]
    codec = pieces.ChunkCodec(MODEL)
    got, sums = codec.encode(texts), list(codec.digests(texts))
    for text, ids, (n, a, b) in zip(texts, got, sums):
        want, decoded = _expected(text)
        assert ids == want
        assert (n, a, b) == (len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_frames(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (2, "a  b\n", "z"), (2, "a  b\n", "z")], "doc_id long, text string, ids string")
    rows = sorted(map(tuple, pieces.digest(df, MODEL).collect()))
    assert [r[:2] for r in rows] == [(1, 1), (2, 1), (2, len(_expected("a  b\n")[0])), (2, len(_expected("a  b\n")[0]))]
    encoded = pieces.encode(df, MODEL)
    assert encoded.columns == ["doc_id", "text", "ids"]
    assert {r.decoded for r in pieces.decode(encoded, MODEL).collect()} == {"", "a  b\n"}
    assert pieces.digest(df.limit(0), MODEL).count() == 0
