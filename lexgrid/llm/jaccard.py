"""N-gram Jaccard join by MinHash banding, with links verified on full n-gram sets.

1. Each text becomes its set of five-word shingles; texts with equal sets are one class, represented by a digest.
2. Bands and rows are chosen so that a pair at the threshold meets in a band with the target probability. Classes are
   shuffled on band hashes. Of buckets with the same members only the first band's is kept.
3. A bucket's classes meet in blocks of bounded size, two at a time. A pair belongs to the first band in which it meets,
   so no pair is compared twice. Signatures tell which classes have such a partner of fitting size in a pair of blocks;
   only their texts are sent there.
4. The blocks compare full sets. Per class they return its number of links and one link to the least class it hangs
   together with in these blocks, never pairs. What hangs together over all blocks is joined last.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrid.graph.components import connected_components
from lexgrid.llm.words import Group, grams, groups, mix
from lexgrid.runtime import durable

NGRAM = 5
THRESHOLD = 0.8
ROWS = 5
#: Probability with which a pair at the threshold meets.
RECALL = 0.9999
#: Classes, and shingles of all of them, in a block of a bucket.
BLOCK, BLOCK_SHINGLES = 1024, 4_000_000
#: Distinct shingles compared at once.
COLUMNS = 8192


def bands(threshold: float = THRESHOLD, rows: int = ROWS, recall: float = RECALL) -> int:
    """The least number of bands with 1 - (1 - threshold ** rows) ** bands >= recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def shingles(g: Group, n: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's distinct shingles, sorted within the row, and the rows' offsets among them.

    A text of fewer than n words, but at least one, has its whole word sequence as its only shingle.
    """
    h = g.hashes()
    window, at = grams(h, g.doc, n)
    row = g.doc[at]
    counts = np.diff(g.first_word())
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        first = g.first_word()
        extra = []
        for i in short:
            value = np.uint64(0x51ED270B)
            for w in h[first[i] : first[i + 1]]:
                value = mix(np.array([value ^ w]))[0] + np.uint64(1)
            extra.append(value)
        window, row = np.concatenate([window, np.array(extra, np.uint64)]), np.concatenate([row, short])
    order = np.lexsort((window, row))
    window, row = window[order], row[order]
    new = np.ones(len(window), bool)
    new[1:] = (window[1:] != window[:-1]) | (row[1:] != row[:-1])
    window, row = window[new], row[new]
    return window, np.searchsorted(row, np.arange(g.n + 1))


def signatures(window: np.ndarray, offsets: np.ndarray, n_bands: int, rows: int) -> np.ndarray:
    """A hash for each row and band over `rows` minima; rows without shingles get zeros."""
    full = np.flatnonzero(np.diff(offsets) > 0)
    out = np.zeros((len(offsets) - 1, n_bands), np.uint64)
    if not len(full):
        return out
    starts = offsets[full]
    low, high = window, mix(window ^ np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
    for b in range(n_bands):
        key = np.full(len(full), b + 1, np.uint64)
        for r in range(rows):
            i = np.array([b * rows + r + 1], np.uint64)
            # Multiply-shift by a seed of its own for each minimum.
            seed = mix(i * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
            value = (low + i * high) * seed
            value ^= value >> np.uint64(31)
            key = mix(key ^ np.minimum.reduceat(value * np.uint64(0xD6E8FEB86659FD93), starts))
        out[full, b] = key
    return out


def digest_of(shingle_set: np.ndarray) -> bytes:
    return hashlib.blake2b(shingle_set.tobytes(), digest_size=16).digest()


def row_id() -> Column:
    """A hash of doc_id and text, null ids and texts included: the same for equal rows only."""
    return F.unhex(F.md5(F.to_json(F.struct("doc_id", F.md5("text").alias("text")))))


def sketch(df: DataFrame, n: int, n_bands: int, rows: int) -> DataFrame:
    """doc_id, row_id, digest (null without shingles), size, bands of each row of df (doc_id, text, row_id)."""

    def run(batches):
        for batch in batches:
            for g in groups(batch.column(1)):
                window, offsets = shingles(g, n)
                sizes = np.diff(offsets)
                digests = [digest_of(window[a:b]) if b > a else None for a, b in zip(offsets, offsets[1:])]
                signed = signatures(window, offsets, n_bands, rows).view(np.int64)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, signed.size + 1, n_bands), pa.int32()), pa.array(signed.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(g.lo, g.n), batch.column(2).slice(g.lo, g.n), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), flat], names=["doc_id", "row_id", "digest", "size", "bands"])

    return df.mapInArrow(run, "doc_id long, row_id binary, digest binary, size long, bands array<long>")


def _members(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])


def common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every left with every right set, some columns of the 0-1 matrices at a time."""
    (a, i), (b, j) = _members(left), _members(right)
    shared = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), np.float32)
    ca, cb = np.searchsorted(shared, a), np.searchsorted(shared, b)
    ok_a = (ca < len(shared)) & (shared[np.minimum(ca, len(shared) - 1)] == a) if len(shared) else np.zeros(len(a), bool)
    ok_b = (cb < len(shared)) & (shared[np.minimum(cb, len(shared) - 1)] == b) if len(shared) else np.zeros(len(b), bool)
    ca, i, cb, j = ca[ok_a], i[ok_a], cb[ok_b], j[ok_b]
    for lo in range(0, len(shared), COLUMNS):
        x, y = np.zeros((len(left), COLUMNS), np.float32), np.zeros((len(right), COLUMNS), np.float32)
        in_a, in_b = (ca >= lo) & (ca < lo + COLUMNS), (cb >= lo) & (cb < lo + COLUMNS)
        x[i[in_a], ca[in_a] - lo] = 1
        y[j[in_b], cb[in_b] - lo] = 1
        out += x @ y.T
    return out


@dataclass
class _Side:
    """The classes of one block: digests, MinHash bands (classes, bands), set sizes, and what else a row carries."""

    digest: list = field(default_factory=list)
    bands: list = field(default_factory=list)
    size: list = field(default_factory=list)
    rest: list = field(default_factory=list)

    def add(self, digest: bytes, bands: bytes, size: int, rest) -> None:
        self.digest.append(digest)
        self.bands.append(bands)
        self.size.append(size)
        self.rest.append(rest)


def _meeting(left: _Side, right: _Side | None, band: int, threshold: float) -> np.ndarray:
    """Which pairs of two blocks, or of one with itself, meet in this band first and have sizes that allow a link."""
    table = lambda side: np.frombuffer(b"".join(side.bands), np.int64).reshape(len(side.digest), -1)
    a, s = table(left), np.array(left.size, float)
    b, t = (a, s) if right is None else (table(right), np.array(right.size, float))
    out = np.minimum(s[:, None], t) >= threshold * np.maximum(s[:, None], t) - 1e-9
    for earlier in range(band):
        out &= a[:, earlier, None] != b[:, earlier]
    if right is None:
        np.fill_diagonal(out, False)
    return out


def _roots(linked: np.ndarray, digest: list[bytes]) -> list[tuple[bytes, bytes]]:
    """(digest, least digest) of the rows that hang together by a symmetric link matrix, the least themselves left out."""
    order = sorted(range(len(digest)), key=digest.__getitem__)
    linked = linked[np.ix_(order, order)]
    label, n = np.arange(len(order)), len(order)
    while True:
        new = np.minimum(label, np.where(linked, label, n).min(1))
        new = new[new]
        if (new == label).all():
            break
        label = new
    return [(digest[order[i]], digest[order[x]]) for i, x in enumerate(label.tolist()) if i != x]


def _links(left: _Side, right: _Side | None, band: int, threshold: float) -> list[tuple]:
    """(digest, links, other) rows of two blocks whose rows carry (copies, set), or of one block with itself."""
    both = common([r[1] for r in left.rest], [r[1] for r in (right or left).rest])
    union = np.array(left.size)[:, None] + np.array((right or left).size) - both
    linked = _meeting(left, right, band, threshold) & (both >= threshold * union - 1e-9)
    sides = [(left, right or left, linked)] + ([(right, left, linked.T)] if right else [])
    rows = []
    for own, others, matrix in sides:
        links = matrix @ np.array([r[0] for r in others.rest], np.int64)
        rows += [(own.digest[k], int(links[k]), None) for k in np.flatnonzero(matrix.any(1))]
    if right is None:
        return rows + [(x, 0, y) for x, y in _roots(linked, left.digest)]
    n, m = linked.shape
    whole = np.zeros((n + m, n + m), bool)
    whole[:n, n:], whole[n:, :n] = linked, linked.T
    return rows + [(x, 0, y) for x, y in _roots(whole, left.digest + right.digest)]


def shared_buckets(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(buckets, kept): digest, band, hash of all classes; and band, hash, blocks of the buckets to compare.

    Of buckets of the same classes, told by two 64-bit sums, the first band's is kept: it is where their pairs meet first.
    """
    buckets = classes.select("digest", "size", F.posexplode("bands").alias("band", "hash"))
    known = (F.bit_xor(F.xxhash64("digest")).alias("x"), F.bit_xor(F.xxhash64("digest", F.lit(1))).alias("y"))
    full = buckets.groupBy("band", "hash").agg(F.count("*").alias("m"), F.sum("size").alias("shingles"), *known).where("m > 1")
    first = full.groupBy("m", "shingles", "x", "y").agg(F.min(F.struct("band", "hash")).alias("first"))
    blocks = F.ceil(F.greatest(F.col("m") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    return buckets.select("digest", "band", "hash"), durable(first.select("first.band", "first.hash", blocks.alias("blocks")))


KEY = ("band", "hash", "a", "b")


def _blocks(batches, side_of):
    """(key, left, right or None) of each pair of blocks, from rows ordered by KEY and `other`; side_of adds a batch's rows."""
    key, sides = None, None
    for batch in batches:
        keys = list(zip(*(batch.column(i).to_pylist() for i in range(4))))
        for i, add in side_of(batch):
            if keys[i] != key:
                if key is not None:
                    yield key, sides[0], None if key[2] == key[3] else sides[1]
                key, sides = keys[i], (_Side(), _Side())
            add(sides)
    if key is not None:
        yield key, sides[0], None if key[2] == key[3] else sides[1]


def _dealt(df: DataFrame) -> DataFrame:
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(partitions, *KEY).sortWithinPartitions(*KEY)


def needed(classes: DataFrame, threshold: float) -> DataFrame:
    """KEY, other, digest, fetched (the representative's name), copies, size, bands: the classes with a partner to be compared in a pair of blocks."""
    buckets, kept = shared_buckets(classes)
    block, blocks = F.pmod(F.xxhash64("digest", F.lit(2)), F.col("blocks")).cast("int"), F.col("blocks")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda x: F.struct(F.least(F.col("block"), x).alias("a"), F.greatest(F.col("block"), x).alias("b"), (F.col("block") > x).alias("other")))
    placed = buckets.join(kept, ["band", "hash"]).withColumn("block", block)
    carried = classes.select("digest", _fetched(F.col("row_id")), "copies", "size", F.col("bands").alias("all"))
    packed = F.unhex(F.array_join(F.transform("all", lambda x: F.lpad(F.hex(x), 16, "0")), "")).alias("bands")
    rows = placed.join(carried, "digest").select("band", "hash", F.explode(pairs).alias("p"), "digest", "fetched", "copies", "size", packed)
    rows = rows.select("band", "hash", "p.a", "p.b", "p.other", "digest", "fetched", "copies", "size", "bands")

    def side_of(batch):
        other, digest, name, copies, size, bands = (batch.column(i).to_pylist() for i in range(4, 10))
        for i in range(len(digest)):
            yield i, lambda sides, i=i: sides[other[i]].add(digest[i], bands[i], size[i], (name[i], copies[i]))

    names = rows.columns

    def run(batches):
        out: list[tuple] = []
        for key, left, right in _blocks(batches, side_of):
            if not left.digest or (right is not None and not right.digest):
                continue
            meets = _meeting(left, right, key[0], threshold)
            for other, side, wanted in ((False, left, meets.any(1)), (True, right, meets.any(0))):
                if side is not None:
                    out += [(*key, other, side.digest[i], *side.rest[i], side.size[i], side.bands[i]) for i in np.flatnonzero(wanted)]
            if len(out) > 4096:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.binary())

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return _dealt(rows).mapInArrow(run, rows.schema)


def _fetched(row: Column) -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), F.hex(row))).alias("fetched")


def verify(wanted: DataFrame, texts: DataFrame, threshold: float, n: int) -> DataFrame:
    """digest, links, other: counts of verified links, and links to the least class of those that hang together in two blocks."""
    # Texts without an id are fetched by the row's hash; of equal ones one is enough.
    named = texts.where("doc_id is not null").select(_fetched(row_id()), "text")
    unnamed = texts.where("doc_id is null").select(_fetched(row_id()), "text").dropDuplicates(["fetched"])
    rows = wanted.join(named.unionByName(unnamed), "fetched").select(*KEY, "other", "digest", "copies", "size", "bands", "text")

    def side_of(batch):
        other, digest, copies, size, bands = (batch.column(i).to_pylist() for i in range(4, 9))
        for g in groups(batch.column(9)):
            window, offsets = shingles(g, n)
            for j in range(g.n):
                i, own = g.lo + j, window[offsets[j] : offsets[j + 1]]

                def add(sides, i=i, own=own):
                    side = sides[other[i]]
                    # Rows of one id may hold other texts, or the same one again.
                    if digest_of(own) == digest[i] and digest[i] not in side.digest:
                        side.add(digest[i], bands[i], size[i], (copies[i], own.copy()))

                yield i, add

    def run(batches):
        for key, left, right in _blocks(batches, side_of):
            if not left.digest or (right is not None and not right.digest):
                continue
            found = _links(left, right, key[0], threshold)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), (pa.binary(), pa.int64(), pa.binary()))], names=["digest", "links", "other"])

    return _dealt(rows).mapInArrow(run, "digest binary, links long, other binary")


def classify(df: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM, recall: float = RECALL, rows: int = ROWS) -> DataFrame:
    """doc_id, row_id, class_id, n_links, first for every row of df (doc_id, text), as in join().

    first is the row_id of the class's first row: the one with the least doc_id, nulls last, then the least row_id. A
    row without shingles is its own.
    """
    source = df.select("doc_id", "text")
    n_bands = bands(threshold, rows, recall)
    sketched = durable(sketch(source.select("doc_id", "text", row_id().alias("row_id")), n, n_bands, rows))
    head = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_id")).alias("head")
    classes = durable(
        sketched.where("digest is not null")
        .groupBy("digest")
        .agg(head, F.count("*").alias("copies"), F.first("size").alias("size"), F.first("bands").alias("bands"))
        .select("digest", "head.doc_id", "head.row_id", "copies", "size", "bands")
    )
    wanted = durable(needed(classes, threshold))
    verified = durable(verify(wanted, source, threshold, n))
    links = verified.groupBy("digest").agg(F.sum("links").alias("links"))
    spanning = verified.where("other is not null").select(F.col("digest").alias("src"), F.col("other").alias("dst"))
    joined = connected_components(spanning)
    grouped = classes.join(links, "digest", "left").join(joined, classes["digest"] == joined["node"], "left").select("digest", "doc_id", "row_id", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "digest").alias("component"))
    least = grouped.groupBy("component").agg(head).select("component", F.col("head.doc_id").alias("class_id"), F.col("head.row_id").alias("first"))
    named = grouped.join(least, "component").select("digest", "class_id", "first", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    blank = F.col("digest").isNull()
    return sketched.select("doc_id", "row_id", "digest").join(named, "digest", "left").select("doc_id", "row_id", F.when(blank, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(blank, F.col("row_id")).otherwise(F.col("first")).alias("first"))


def join(df: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM, recall: float = RECALL, rows: int = ROWS) -> DataFrame:
    """doc_id, class_id, n_links for every row of df (doc_id, text).

    class_id is the least doc_id among the rows connected by links; n_links the number of other rows whose shingle set
    has a Jaccard similarity of at least `threshold` with the row's. Rows with equal sets, repeated rows included, are
    linked. A null, empty or blank text has no shingle: no link and its own doc_id as class. Rows
    without an id link like others; a class of theirs alone has a null class_id. No rows give none; other columns are
    not read.
    """
    return classify(df, threshold, n, recall, rows).select("doc_id", "class_id", "n_links")
