"""Substring deduplication with prefix-partitioned suffix trees over words.

A passage counts as repeated in a document if its first `window` words also stand in a document with a smaller id.

1. Prefixes. Any window holds the least hash of its k-word prefixes, so suffixes need only start at these anchors (about
   one word in 22 for the shortest), and windows that are equal share an anchor. One aggregation finds the anchors that
   occur in several documents; all others are dropped, with no repeat lost.
2. Groups. A group is the suffixes that start with one anchor prefix, each with the words of its windows around it.
   Prefixes have variable length: where a group's words would exceed the memory of a tree, its windows take a longer
   prefix of theirs instead, and so on up to the longest. What still is too large, such as a passage in a third of all
   documents, shares every longer prefix as well; it is dealt into parts of the tree's size by document.
3. Trees. The suffixes of some groups, up to a memory budget, form one generalized suffix tree in its array form: the
   sorted suffixes and the lengths of the prefixes that neighbours share. Stretches that share at least `window` words
   are the deep internal nodes, whose leaves are the places of a maximal repeat; the least document among them keeps it.
   Trees of one prefix's parts pass on each node's leaves of its least document, as one row with a 128-bit hash of the
   window; these few meet in an aggregation.
4. Removal. Overlapping windows of a document merge into spans, which are joined to its text once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrid.llm.words import Group, groups, mix
from lexgrid.runtime import durable

WINDOW = 50
#: Words of an anchor prefix: the shortest first, the longer ones for groups too large for a tree.
PREFIXES = (8, 16, 32)
#: Words that the trees built at once may hold; also the size of a group beyond which its prefix grows.
TREE_WORDS = 400_000
#: Marks a prefix whose windows take a longer one.
LONGER = -1


def anchors(h: np.ndarray, doc: np.ndarray, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each window that lies within a row: its first word, and the least hash of its prefixes, which is its anchor."""
    if len(h) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = h[: len(h) - prefix + 1].copy()
    for j in range(1, prefix):
        g = mix(g) + h[j : j + len(g)]
    g = mix(g)
    span = window - prefix + 1
    # Sliding minima by doubling: least[i] is the least of g[i : i + width].
    least, width = g, 1
    while width < span:
        step = min(width, span - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    at = np.flatnonzero(doc[: len(least)] == doc[window - 1 : window - 1 + len(least)])
    return at, least[at]


def _runs(start: np.ndarray, row: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where runs of windows begin that follow each other in a row with one key. A run of equal words is one run."""
    flag = np.ones(len(start), bool)
    flag[1:] = (start[1:] != start[:-1] + 1) | (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    return np.flatnonzero(flag)


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _keyed(g: Group, window: int, prefixes: tuple[int, ...], lists: pa.Array | None, last: int) -> tuple[np.ndarray, ...]:
    """(first word, row, anchor, parts, whether level `last` is reached) of all windows, by each row's list of (level, anchor, parts).

    A window goes from level to level as long as its anchor is marked LONGER, up to `last`. It comes with the last
    anchor it had and that anchor's parts, 0 if the list hasn't it.
    """
    h = g.hashes()
    at, hashed = anchors(h, g.doc, window, prefixes[0])
    row = g.doc[at]
    key, parts, reached = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), np.ones(len(at), bool)
    for level in range(last + 1):
        reached &= (parts == LONGER) | (level == 0)
        if not reached.any():
            break
        own = _signed(hashed if level == 0 else anchors(h, g.doc, window, prefixes[level])[1])
        known = np.zeros(len(at), np.int64) if lists is None else _parts(own, row, level, lists, g.n)
        key, parts = np.where(reached, own, key), np.where(reached, known, parts)
    return at, row, key, parts, reached


def anchor_rows(df: DataFrame, window: int, prefixes: tuple[int, ...], level: int) -> DataFrame:
    """doc_id, anchor, words: once for each run of windows with one anchor of this level. df: doc_id, text and, but for level 0, known."""

    def run(batches):
        for batch in batches:
            ids = np.array(batch.column(0))
            for g in groups(batch.column(1)):
                at, row, key, _, reached = _keyed(g, window, prefixes, batch.column(2).slice(g.lo, g.n) if level else None, level)
                at, row, key = at[reached], row[reached], key[reached]
                head = _runs(at, row, key)
                words = np.diff(np.append(head, len(at))) + window - 1
                yield pa.RecordBatch.from_arrays([pa.array(ids[g.lo + row[head]]), pa.array(key[head]), pa.array(words)], names=["doc_id", "anchor", "words"])

    return df.mapInArrow(run, "doc_id long, anchor long, words long")


SEGMENT = "anchor long, part int, parts int, doc_id long, place int, lead int, words binary"


def segments(df: DataFrame, window: int, prefixes: tuple[int, ...]) -> DataFrame:
    """The runs of windows with a shared anchor as suffixes to group, from rows of doc_id, text, known.

    A run comes with the words of all its windows: `lead` windows, the first at word `place`.
    """

    def run(batches):
        for batch in batches:
            ids = np.array(batch.column(0))
            for g in groups(batch.column(1)):
                at, row, key, parts, _ = _keyed(g, window, prefixes, batch.column(2).slice(g.lo, g.n), len(prefixes) - 1)
                keep = np.flatnonzero(parts > 0)
                at, row, key, parts = at[keep], row[keep], key[keep], parts[keep]
                if not len(at):
                    continue
                head = _runs(at, row, key)
                lead, lo, row, parts = np.diff(np.append(head, len(at))), at[head], row[head], parts[head]
                hi = lo + lead - 1 + window
                raw, doc = g.data.tobytes(), ids[g.lo + row]
                words = [raw[a:b] for a, b in zip(g.start[lo].tolist(), g.end[hi - 1].tolist())]
                part = (mix(doc.astype(np.uint64)) % parts.astype(np.uint64)).astype(np.int32)
                place = lo - g.first_word()[row]
                columns = (key[head], part, parts.astype(np.int32), doc, place.astype(np.int32), lead.astype(np.int32))
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(words, pa.binary())], names=["anchor", "part", "parts", "doc_id", "place", "lead", "words"])

    return df.mapInArrow(run, SEGMENT)


def _parts(anchor: np.ndarray, row: np.ndarray, level: int, lists: pa.Array, n: int) -> np.ndarray:
    """Of each anchor of a level the number of parts that its row's list gives it; 0 where the list doesn't have it."""
    lengths = np.diff(np.array(lists.offsets))
    entries = lists.flatten()
    own = np.flatnonzero(np.array(entries.field("level")) == level) if len(entries) else np.zeros(0, np.int64)
    if not len(own):
        return np.zeros(len(anchor), np.int64)
    owner = np.repeat(np.arange(n), lengths)[own]
    key = lambda a, r: mix(a.view(np.uint64)) ^ mix(r.astype(np.uint64) + np.uint64(1))
    have, parts = key(np.array(entries.field("anchor")).astype(np.int64)[own], owner), np.array(entries.field("parts"))[own]
    order = np.argsort(have)
    have, parts, want = have[order], parts[order], key(anchor, row)
    at = np.minimum(np.searchsorted(have, want), len(have) - 1)
    return np.where(have[at] == want, parts[at], 0)


def suffix_tree(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The generalized suffix tree of some word sequences in array form.

    Returns where each sequence begins in the numbered text, the suffixes in order, and the number of words that each
    shares with the one before it. Suffixes are sorted by prefixes of doubling length; the ranks of all lengths then
    give the shared words, the longest first.
    """
    lengths = np.array([len(w) for w in words])
    table: dict[bytes, int] = {}
    flat = np.array([table.setdefault(w, len(table)) for sequence in words for w in sequence], np.int64)
    offset = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
    # A separator of its own ends each sequence, so that no suffix runs into the next.
    rank = np.empty(len(flat) + len(words), np.int64)
    rank[np.arange(len(flat)) + np.repeat(np.arange(len(words)), lengths)] = flat + 1
    rank[offset + lengths] = len(table) + 1 + np.arange(len(words))
    ranks, width, top = [rank], 1, len(table) + len(words) + 1
    while top < len(rank) or width == 1:
        pair = rank * (top + 1)
        pair[:-width] += rank[width:] + 1
        values, rank = np.unique(pair, return_inverse=True)
        rank, width, top = rank.astype(np.int64), 2 * width, len(values)
        ranks.append(rank)
    order = np.argsort(rank)
    left, right, shared = order[:-1].copy(), order[1:].copy(), np.zeros(len(order), np.int64)
    for power in range(len(ranks) - 2, -1, -1):
        inside = np.maximum(left, right) < len(rank)
        same = np.flatnonzero(inside)[ranks[power][left[inside]] == ranks[power][right[inside]]]
        left[same] += 1 << power
        right[same] += 1 << power
        shared[same + 1] += 1 << power
    return offset, order, shared


def nodes(words: list[list[bytes]], lead: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of runs of windows, given as word sequences: each window as (run, place in it, its node), and each node's depth in words.

    Run i holds `lead[i]` windows, each starting one word later. Neighbours in the suffix tree's order that share at
    least `window` words are leaves of one internal node; its depth is what all its leaves share, the length of a
    maximal repeat to the right. A window that shares so much with none is a node of its own.
    """
    offset, order, shared = suffix_tree(words)
    head = np.flatnonzero(shared < window)
    node = np.empty(len(order), np.int64)
    node[order] = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(order))))
    within = shared.copy()
    within[head] = np.iinfo(np.int64).max
    depth = np.minimum.reduceat(within, head)
    run = np.repeat(np.arange(len(words)), lead)
    which = np.arange(len(run)) - np.repeat(np.cumsum(lead) - lead, lead)
    return run, which, node[offset[run] + which], np.where(depth == np.iinfo(np.int64).max, window, depth)


def _merged(keys: tuple[np.ndarray, ...], start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in the input, start, stop) of the stretches that the windows at `start` cover together, for each of the keys apart, in their order."""
    order = np.lexsort((start, *keys[::-1]))
    start, flag = start[order], np.ones(len(order), bool)
    flag[1:] = start[1:] > start[:-1] + window
    for k in keys:
        flag[1:] |= k[order][1:] != k[order][:-1]
    head = np.flatnonzero(flag)
    return order[head], start[head], start[np.append(head[1:], len(start)) - 1] + window


def _listed(keys: tuple[np.ndarray, ...], start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """For each run of equal keys its place and the list of its stretches."""
    flag = np.zeros(len(start), bool)
    flag[:1] = True
    for k in keys:
        flag[1:] |= k[1:] != k[:-1]
    head = np.flatnonzero(flag)
    entries = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(stop, pa.int32())], names=["start", "stop"])
    return head, pa.ListArray.from_arrays(pa.array(np.append(head, len(start)), pa.int32()), entries)


_FOUND = "doc_id long, spans array<struct<start:int,stop:int>>, low long, high long"


def tree_spans(df: DataFrame, window: int, tree_words: int = TREE_WORDS) -> DataFrame:
    """doc_id, spans (start, stop in words), low, high: repeats to remove within parts, without hashes, and what parts pass on, with them.

    df holds whole parts in each partition, in order.
    """

    def flush(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if not rows:
            return
        parts, doc, place, lead, words = (np.array(x) if i < 4 else list(x) for i, x in enumerate(list(zip(*rows))[2:]))
        run, which, node, _ = nodes(words, lead, window)
        least = np.full(int(node.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, node, doc[run])
        own, start = doc[run], place[run] + which
        found = np.flatnonzero(least[node] < own)
        if len(found):
            at, begin, stop = _merged((own[found],), start[found], window)
            documents = own[found][at]
            head, lists = _listed((documents,), begin, stop)
            yield _batch(documents[head], lists)
        passed = np.flatnonzero((parts[run] > 1) & (least[node] == own))
        if len(passed):
            at, begin, stop = _merged((node[passed], own[passed]), start[passed], window)
            first = passed[at]
            head, lists = _listed((node[first], own[first]), begin, stop)
            hashes = [xxhash.xxh3_128_digest(b" ".join(words[run[i]][which[i] : which[i] + window])) for i in first[head]]
            yield _batch(own[first[head]], lists, np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2))

    def run(batches):
        rows, held = [], 0
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(7)]
            for anchor, part, parts, doc, place, lead, words in zip(*columns):
                if held > tree_words and rows[-1][:2] != (anchor, part):
                    yield from flush(rows)
                    rows, held = [], 0
                split = words.split()
                rows.append((anchor, part, parts, doc, place, lead, split))
                held += len(split)
        yield from flush(rows)

    return df.mapInArrow(run, _FOUND)


def _batch(doc: np.ndarray, lists: pa.Array, hashes: np.ndarray | None = None) -> pa.RecordBatch:
    pair = [pa.nulls(len(doc), pa.int64())] * 2 if hashes is None else [pa.array(hashes[:, 0]), pa.array(hashes[:, 1])]
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), lists, *pair], names=["doc_id", "spans", "low", "high"])


def shared_prefixes(named: DataFrame, window: int, prefixes: tuple[int, ...], tree_words: int) -> DataFrame:
    """doc_id, known: the list of (level, anchor, parts) of each document's anchors that occur in several documents."""
    levels = []
    for level in range(len(prefixes)):
        source = named
        if level:
            hot = levels[0].where(F.col("parts") == LONGER)
            for x in levels[1:]:
                hot = hot.unionByName(x.where(F.col("parts") == LONGER))
            source = named.join(hot.groupBy("doc_id").agg(F.collect_set(F.struct("level", "anchor", "parts")).alias("known")), "doc_id").select("doc_id", "text", "known")
        rows = anchor_rows(source, window, prefixes, level)
        rows = durable(rows) if level else rows  # at level 0 finding them again costs less than writing them
        count = rows.groupBy("anchor").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.sum("words").alias("words")).where("least < most")
        dealt = F.ceil(F.col("words") / tree_words).cast("int")
        parts = dealt if level == len(prefixes) - 1 else F.when(dealt > 1, F.lit(LONGER)).otherwise(dealt)
        shared = durable(count.select("anchor", F.lit(level).alias("level"), parts.alias("parts")))
        levels.append(durable(rows.select("doc_id", "anchor").join(shared, "anchor").select("doc_id", "level", "anchor", "parts")))
        if shared.where(F.col("parts") == LONGER).isEmpty():
            break
    every = levels[0]
    for x in levels[1:]:
        every = every.unionByName(x)
    return every.groupBy("doc_id").agg(F.collect_set(F.struct("level", "anchor", "parts")).alias("known"))


def spans(df: DataFrame, window: int = WINDOW, prefixes: tuple[int, ...] = PREFIXES, tree_words: int = TREE_WORDS) -> DataFrame:
    """doc_id, spans (array of start, stop in words): what to remove from the documents of df (doc_id, text)."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = df.select("doc_id", "text").where("doc_id is not null")
    known = shared_prefixes(named, window, prefixes, tree_words)
    placed = durable(segments(named.join(known, "doc_id").select("doc_id", "text", "known"), window, prefixes))
    grouped = placed.repartition(partitions, "anchor", "part").sortWithinPartitions("anchor", "part")
    trees = durable(tree_spans(grouped, window, tree_words))
    passed = trees.where("low is not null")
    least = durable(passed.groupBy("low", "high").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("low", "high", "least"))
    across = passed.join(least, ["low", "high"]).where("doc_id > least").select("doc_id", "spans")
    return durable(trees.where("low is null").select("doc_id", "spans").unionByName(across).groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans")))


def kept_words(n: int, removed: list[tuple[int, int]]) -> np.ndarray:
    flags = np.zeros(n + 1, np.int64)
    for a, b in removed:
        flags[a] += 1
        flags[min(b, n)] -= 1
    return np.cumsum(flags)[:n] == 0


def deduplicate(df: DataFrame, window: int = WINDOW, digests: bool = False, prefixes: tuple[int, ...] = PREFIXES, tree_words: int = TREE_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by one space) for every row of df (doc_id, text).

    With `digests`, kept_sha256 stands in place of kept. A null text has no words. A null doc_id is neither smaller nor
    larger than others: its words stay and remove none. Rows of one doc_id are places of one document, so they don't
    remove each other's words; a window in any of them is removed from all larger documents. No rows give none.
    """
    joined = df.select("doc_id", "text").join(spans(df, window, prefixes, tree_words), "doc_id", "left").select("doc_id", "text", "spans")

    def run(batches):
        for batch in batches:
            for g in groups(batch.column(1)):
                first, raw = g.first_word(), g.data.tobytes()
                removed = batch.column(2).slice(g.lo, g.n).to_pylist()
                n_words, n_removed, kept = [], [], []
                for i in range(g.n):
                    a, b = int(first[i]), int(first[i + 1])
                    words = raw[g.offsets[i] : g.offsets[i + 1]].split()
                    if removed[i]:
                        keep = kept_words(b - a, [(s["start"], s["stop"]) for s in removed[i]])
                        words = [w for w, k in zip(words, keep) if k]
                    text = b" ".join(words)
                    n_words.append(b - a)
                    n_removed.append(b - a - len(words))
                    kept.append(hashlib.sha256(text).hexdigest() if digests else text.decode())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(g.lo, g.n), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    out = joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("kept", "kept_sha256") if digests else out
