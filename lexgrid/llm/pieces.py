"""SentencePiece encoding and decoding through a table of distinct chunks.

No piece of the model holds a whitespace marker after another character, so no merge crosses from a character to a
marker that follows it. The marked text therefore falls apart into chunks `markers + word` that are segmented
independently. Each distinct chunk of a task's rows is segmented once; ids, counts and decoded text are then joined
back by position. The table is a task's own, so no occurrence is shuffled: a corpus-wide table would have to move
every word of every text to its chunk and back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lexgrid.llm.words import buffers, ranges

MARK = "▁"
#: Entries after which a task starts a new table; bounds its memory, not what is encoded.
TABLE_ENTRIES = 400_000
#: Chunks longer than this are segmented but not kept in the table.
KEPT_LENGTH = 64
_CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def crosses(processor) -> bool:
    """Whether a piece holds a marker after another character; the chunk table is then not exact."""
    return any(MARK in piece.lstrip(MARK) for piece in map(processor.id_to_piece, range(processor.get_piece_size())))


class ChunkCodec:
    """Encodes and decodes texts with a SentencePiece model, each distinct chunk once.

    Needs a model that keeps white space as it is and puts a marker before the text, as its own flags say; a model
    whose pieces cross markers is refused.
    """

    def __init__(self, model: str, end_id: bool = True):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        if crosses(self.model) or "".join(map(self.model.id_to_piece, self.model.encode("a  a "))) != f"{MARK}a{MARK * 2}a{MARK}":
            raise ValueError("pieces of this model cross white space, or it rewrites white space")
        #: The ids of a chunk of one marker: the library has none for an empty text.
        self.mark = self.model.encode("a ")[len(self.model.encode("a")) :]
        self.end = [self.model.eos_id()] if end_id else []
        #: Of each chunk the number of ids, the ids as text and the decoded text.
        self.table: dict[str, tuple[int, str, str]] = {}

    def chunks(self, text: str) -> list[str]:
        return _CHUNK.findall(MARK + text.replace(" ", MARK)) if text else []

    def _entries(self, chunks: set[str]) -> dict[str, tuple[int, str, str]]:
        if len(self.table) + len(chunks) > TABLE_ENTRIES:
            self.table = {}
        new = [c for c in chunks if c not in self.table]
        # The model puts a marker of its own before each text, so a chunk goes in without its first one.
        ids = [x if c != MARK else self.mark for c, x in zip(new, self.model.encode([c[1:] for c in new], num_threads=1) if new else ())]
        found = {c: (len(x), " ".join(map(str, x)), " " + t) for c, x, t in zip(new, ids, self.model.decode(ids, num_threads=1) if new else ())}
        self.table.update((c, e) for c, e in found.items() if len(c) <= KEPT_LENGTH)
        return self.table if all(len(c) <= KEPT_LENGTH for c in new) else self.table | found

    def entries(self, texts: list[str]) -> tuple[list[list[str]], dict]:
        split = [self.chunks(t) for t in texts]
        return split, self._entries(set().union(*map(set, split)) if split else set())

    def encode(self, texts: list[str]) -> list[list[int]]:
        split, table = self.entries(texts)
        return [[int(i) for c in chunks for i in table[c][1].split()] + self.end for chunks in split]

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids)

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """Number of ids, SHA-256 of the ids as text, SHA-256 of the decoded text; ids are never all held."""
        split, table = self.entries(texts)
        end = " ".join(map(str, self.end))
        for chunks in split:
            rows = [table[c] for c in chunks]
            ids = " ".join([r[1] for r in rows if r[1]] + ([end] if end else []))
            text = "".join([r[2] for r in rows])[1:]
            yield sum([r[0] for r in rows]) + len(self.end), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def _texts(column: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    _, offsets = buffers(column)
    for lo, hi in ranges(offsets):
        yield lo, hi, [t or "" for t in column.slice(lo, hi - lo).to_pylist()]


def encode(df: DataFrame, model: str, text: str = "text", out: str = "ids", end_id: bool = True) -> DataFrame:
    """df with a column `out` of ids; a column of that name is replaced. A null or empty text has the end id only."""
    kept = [c for c in df.columns if c != out]

    def run(batches):
        codec = ChunkCodec(model, end_id)
        for batch in batches:
            for lo, hi, texts in _texts(batch.column(text)):
                part = batch.slice(lo, hi - lo).select(kept)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(codec.encode(texts), pa.list_(pa.int32()))], names=[*kept, out])

    schema = df.select(*[df[c] for c in kept]).schema.add(out, T.ArrayType(T.IntegerType()))
    return df.mapInArrow(run, schema)


def decode(df: DataFrame, model: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with a column `out` of the text of its ids; null ids give a null text."""
    kept = [c for c in df.columns if c != out]

    def run(batches):
        codec = ChunkCodec(model)
        for batch in batches:
            texts = [None if x is None else codec.decode(x) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.select(kept).columns, pa.array(texts, pa.string())], names=[*kept, out])

    return df.mapInArrow(run, df.select(*[df[c] for c in kept]).schema.add(out, T.StringType()))


def digest(df: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text of a table with doc_id and text.

    A null text counts as empty and has the end id only. Repeated rows give repeated results; other columns are
    not read. No row gives no row.
    """

    def run(batches):
        codec = ChunkCodec(model)
        for batch in batches:
            for lo, hi, texts in _texts(batch.column(1)):
                rows = list(codec.digests(texts))
                n, ids, decoded = zip(*rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
