"""Approximate nearest neighbours by inner product: a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample; leaves that stand for too many vectors get a subtree each, fitted in a task of
its own on a bounded sample of that leaf. Every vector is put into a leaf. A query walks the tree with a priority queue
of branches, the one with the largest bound on an inner product first, and visits leaves until the number that
calibration found enough for the target recall. Leaves are packed into shards of bounded size, a large leaf into
several; a query is sent once to each shard that has a leaf of its visit, and compared with those leaves only.

Equal vectors are searched once: only the k + 1 smallest ids of a vector can be among anybody's k nearest, since ties
go to the smaller id, so copies beyond them are dropped from the candidates, which loses no result.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrid.runtime import durable

K = 20
#: Vectors the tree is fitted on, and further ones that calibrate the number of leaves.
SAMPLE, CALIBRATION = 16_384, 256
#: A leaf that stands for more than SPLIT vectors is split by a subtree, fitted on about SPLIT_SAMPLE of them.
SPLIT, SPLIT_SAMPLE = 4096, 2048
BRANCHES, LEAF, ITERATIONS = 8, 48, 8
#: Recall to calibrate for, on held queries against brute force over the sample.
RECALL = 0.95
#: Vectors of a shard: small neighbouring leaves share one, a large leaf has several.
SHARD = 4096
#: Queries compared with a shard at once, and queries of a shard that go to one task.
QUERIES, QUERY_BLOCK = 512, 4096
#: Answers of so many shards are merged at a time.
MERGE = 32


class Tree:
    """Nodes in arrays. Node i has children first[i]:first[i] + number[i], or is leaf number leaf[i]."""

    def __init__(self, sample: np.ndarray, branches: int = BRANCHES, leaf: int = LEAF, seed: int = 0):
        self.centre, self.radius, self.first, self.number, self.leaf, self.leaves = [], [], [], [], [], 0
        rng = np.random.default_rng(seed)
        self._add(sample)
        todo = [(0, sample)]
        while todo:
            node, part = todo.pop()
            label = _kmeans(part, branches, rng) if len(part) > leaf else None
            groups = [part[label == c] for c in range(branches)] if label is not None else []
            groups = [g for g in groups if len(g)]
            if len(groups) < 2:
                self.leaf[node] = self.leaves
                self.leaves += 1
                continue
            self.first[node], self.number[node] = len(self.centre), len(groups)
            for g in groups:
                todo.append((self._add(g), g))
        self.centre, self.radius = np.array(self.centre), np.array(self.radius)
        self.first, self.number, self.leaf = map(np.array, (self.first, self.number, self.leaf))

    def _add(self, part: np.ndarray) -> int:
        centre = part.mean(0) if len(part) else np.zeros(part.shape[1])
        self.centre.append(centre)
        self.radius.append(float(np.sqrt(((part - centre) ** 2).sum(1).mean())) if len(part) else 0.0)
        self.first.append(0)
        self.number.append(0)
        self.leaf.append(-1)
        return len(self.centre) - 1

    def graft(self, subtrees: dict[int, "Tree"]) -> None:
        """Put a subtree in place of each of the given leaves; leaves get new numbers."""
        centre, radius, first, number, leaf = [self.centre], [self.radius], [self.first], [self.number], [self.leaf]
        at, nodes = {int(x): i for i, x in enumerate(self.leaf) if x >= 0}, len(self.centre)
        for place, sub in sorted(subtrees.items()):
            if sub.leaves < 2:
                continue
            move = nodes - 1  # the subtree's root becomes the leaf's node
            node = at[place]
            self.first[node], self.number[node], self.leaf[node] = sub.first[0] + move, sub.number[0], -1
            centre.append(sub.centre[1:])
            radius.append(sub.radius[1:])
            first.append(np.where(sub.number[1:] > 0, sub.first[1:] + move, 0))
            number.append(sub.number[1:])
            leaf.append(sub.leaf[1:])
            nodes += len(sub.centre) - 1
        self.centre, self.radius, self.first, self.number, self.leaf = map(np.concatenate, (centre, radius, first, number, leaf))
        ends = np.flatnonzero(self.number == 0)
        self.leaf[:] = -1
        self.leaf[ends] = np.arange(len(ends))
        self.leaves = len(ends)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: down to the nearest centre at each level."""
        node = np.zeros(len(x), np.int64)
        moving = np.flatnonzero(self.number[node] > 0)
        while len(moving):
            for parent in np.unique(node[moving]):
                own = moving[node[moving] == parent]
                children = np.arange(self.first[parent], self.first[parent] + self.number[parent])
                c = self.centre[children]
                node[own] = children[np.argmin((c**2).sum(1) - 2 * x[own] @ c.T, axis=1)]
            moving = moving[self.number[node[moving]] > 0]
        return self.leaf[node]

    def visit(self, q: np.ndarray, leaves: int) -> list[int]:
        """The first `leaves` leaves in best-bin-first order: branches by inner product with the centre plus spread."""
        bound = self.centre @ q + self.radius * (np.linalg.norm(q) * 0.5)
        queue, out = [(-bound[0], 0)], []
        while queue and len(out) < leaves:
            _, node = heapq.heappop(queue)
            if self.number[node]:
                for child in range(self.first[node], self.first[node] + self.number[node]):
                    heapq.heappush(queue, (-bound[child], child))
            else:
                out.append(int(self.leaf[node]))
        return out


def _kmeans(x: np.ndarray, k: int, rng) -> np.ndarray:
    centre = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(ITERATIONS):
        label = np.argmin((centre**2).sum(1) - 2 * x @ centre.T, axis=1)
        for c in range(len(centre)):
            if (label == c).any():
                centre[c] = x[label == c].mean(0)
    return label


def calibrate(tree: Tree, sample: np.ndarray, queries: np.ndarray, k: int = K, recall: float = RECALL) -> int:
    """The least number of leaves, widened by doubling and then narrowed, whose candidates hold `recall` of the k best of the sample.

    The queries are no part of the sample, so that none finds itself.
    """
    if tree.leaves <= 1 or not len(queries):
        return 1
    leaf = tree.assign(sample)
    best = np.argsort(-(queries @ sample.T), axis=1, kind="stable")[:, :k]
    order = [{leaf: i for i, leaf in enumerate(tree.visit(q, tree.leaves))} for q in queries]
    place = np.array([[o[leaf[b]] for b in row] for o, row in zip(order, best)])
    leaves = 1
    while leaves < tree.leaves and (place < leaves).mean() < recall:
        leaves *= 2
    low = leaves // 2
    while leaves - low > max(1, leaves // 8):
        middle = (low + leaves) // 2
        if (place < middle).mean() >= recall:
            leaves = middle
        else:
            low = middle
    return min(leaves, tree.leaves)


def usable(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """vec_id, v of the rows that take part: an id, and a vector neither null, zero nor holding null or non-finite parts."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.array(column.flatten(), np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _by_length(column: pa.Array):
    lengths = np.diff(np.array(column.offsets))
    for n in np.unique(lengths):
        yield int(n), np.flatnonzero(lengths == n)


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """v, ids: each distinct vector with its `keep` smallest ids. Tasks reduce their own rows first, so a common vector sends few."""

    def own(batches):
        held: dict[bytes, list[int]] = {}

        def out():
            for key, ids in held.items():
                held[key] = sorted(set(ids))[:keep]
            return pa.RecordBatch.from_arrays([pa.array([np.frombuffer(k) for k in held], pa.list_(pa.float64())), pa.array(list(held.values()), pa.list_(pa.int64()))], names=["v", "ids"])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for _, at in _by_length(batch.column(1)):
                for i, row in zip(at, _matrix(batch.column(1).take(pa.array(at))) + 0.0):
                    have = held.setdefault(row.tobytes(), [])
                    have.append(ids[i])
                    if len(have) > 4 * keep:
                        held[row.tobytes()] = sorted(set(have))[:keep]
            if len(held) > 20_000:
                yield out()
                held.clear()
        yield out()

    parts = rows.mapInArrow(own, "v array<double>, ids array<long>")
    return parts.groupBy("v").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids"))


def search(df: DataFrame, is_query, k: int = K, id_col: str = "vec_id", vector: str = "embedding", recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows found for each row for which `is_query` holds.

    score is the inner product in double precision of the vectors as they are. Ties go to the smaller id. Vectors that
    are null, zero or hold null or non-finite parts take no part, nor do rows without an id; vectors of different
    length are never compared. Rows with one id are one vector if equal; different vectors of one id are candidates of
    their own. A query with fewer than k candidates gets them all; no rows give none.
    """
    spark = df.sparkSession
    rows = usable(df, id_col, vector)
    vectors = durable(distinct_vectors(rows, k + 1))
    asked = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "v").dropDuplicates()
    # A bounded sample, the same at every run: the least hashes.
    total = vectors.count()
    share = min(1.0, 1.1 * (SAMPLE + CALIBRATION) / max(1, total))
    h = F.pmod(F.xxhash64("v"), F.lit(1 << 30))
    taken = vectors.where(h < int(share * (1 << 30))).orderBy(h, "v").limit(SAMPLE + CALIBRATION).select("v")
    by_length: dict[int, list] = {}
    for v in (r.v for r in taken.toLocalIterator()):
        by_length.setdefault(len(v), []).append(v)
    fitted, held, large, offset = {}, {}, {}, 0
    each = max(1.0, total / max(1, sum(map(len, by_length.values()))))  # vectors that one of the sample stands for
    for n, found in sorted(by_length.items()):
        # In order of their hashes the first ones are as random as any.
        held[n] = np.array(found[: max(1, len(found) * CALIBRATION // (SAMPLE + CALIBRATION))])
        sample = np.array(found[len(held[n]) :] or found)
        fitted[n] = (Tree(sample), sample)
        numbers = np.bincount(fitted[n][0].assign(sample), minlength=fitted[n][0].leaves) * each
        large |= {(n, int(i)): SPLIT_SAMPLE / numbers[i] for i in np.flatnonzero(numbers > SPLIT)}
    if large:
        subtrees: dict[int, dict[int, Tree]] = {}
        for n, leaf, sub in split(vectors, {n: t for n, (t, _) in fitted.items()}, large):
            subtrees.setdefault(n, {})[leaf] = sub
        for n, found in subtrees.items():
            fitted[n][0].graft(found)
    trees: dict[int, tuple[Tree, int, int]] = {}
    for n, (tree, sample) in fitted.items():
        trees[n] = (tree, calibrate(tree, sample, held[n], k, recall), offset)
        offset += tree.leaves
    shared = spark.sparkContext.broadcast(trees)  # bounded: SAMPLE bounds the leaves of the tree, SPLIT_SAMPLE those of each subtree

    def leaves_of(x: np.ndarray, query: bool) -> list:
        n = x.shape[1]
        if n not in shared.value:  # a length outside the sample: one leaf of its own, searched whole
            return [[-n - 1]] * len(x) if query else [-n - 1] * len(x)
        tree, leaves, first = shared.value[n]
        return [[first + i for i in tree.visit(q, leaves)] for q in x] if query else (first + tree.assign(x)).tolist()

    def place(query: bool):
        def run(batches):
            for batch in batches:
                for _, at in _by_length(batch.column(0)):
                    part = batch.take(pa.array(at))
                    kind = pa.list_(pa.int64()) if query else pa.int64()
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(leaves_of(_matrix(part.column(0)), query), kind)], names=[*part.schema.names, "leaf"])

        return run

    placed = durable(vectors.mapInArrow(place(False), "v array<double>, ids array<long>, leaf long"))
    # One count a leaf comes to the driver; the tree bounds their number (lengths outside the sample add one each).
    shards = pack({r["leaf"]: r["n"] for r in placed.groupBy("leaf").agg(F.count("*").alias("n")).collect()})
    located = spark.sparkContext.broadcast(shards)

    def route(batches):
        """A query's row for each shard of its leaves, with those leaves."""
        visits = place(True)
        for batch in visits(batches):
            rows, shard, wanted = [], [], []
            for i, leaves in enumerate(batch.column(1).to_pylist()):
                by_shard: dict[int, list[int]] = {}
                for leaf in leaves:
                    first, number = located.value.get(leaf, (0, 0))
                    for x in range(first, first + number):
                        by_shard.setdefault(x, []).append(leaf)
                rows += [i] * len(by_shard)
                shard += by_shard
                wanted += by_shard.values()
            for lo in range(0, len(rows), 4096):  # the vectors are copied to each row, so rows go out in parts
                part = slice(lo, lo + 4096)
                v = batch.column(0).take(pa.array(rows[part], pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(shard[part], pa.int64()), v, pa.nulls(len(v), pa.list_(pa.int64())), pa.array(wanted[part], pa.list_(pa.int64()))], names=["shard", "v", "ids", "leaves"])

    def store(batches):
        for batch in batches:
            shard = []
            for leaf, v in zip(batch.column(2).to_pylist(), batch.column(0)):
                first, number = located.value[leaf]
                shard.append(first + (xxhash.xxh3_64_intdigest(np.array(v.values).tobytes()) % number if number > 1 else 0))
            leaves = pa.ListArray.from_arrays(pa.array(range(len(batch) + 1), pa.int32()), batch.column(2).cast(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), batch.column(0), batch.column(1), leaves], names=["shard", "v", "ids", "leaves"])

    row = "shard long, v array<double>, ids array<long>, leaves array<long>"
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    routed = durable(asked.select("v").distinct().repartition(partitions, "v").mapInArrow(route, row))
    # The queries of a shard are dealt into blocks, and its vectors go to each; a shard without queries goes nowhere.
    blocks = durable(routed.groupBy("shard").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks")))
    asking = routed.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
    stored = placed.mapInArrow(store, row).join(blocks, "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    both = asking.unionByName(stored).select(F.struct("shard", "block").alias("key"), "v", "ids", "leaves")
    met = both.repartition(partitions, "key").sortWithinPartitions("key", F.col("ids").isNull()).select(F.xxhash64("key").alias("key"), "v", "ids", "leaves")

    def meet(batches):
        """A shard's vectors come first and are held; its queries follow and are answered part by part."""
        key, held = None, []
        for batch in batches:
            shard = np.array(batch.column(0))
            change = np.flatnonzero(shard[1:] != shard[:-1]) + 1
            for lo, hi in zip([0, *change], [*change, len(shard)]):
                if shard[lo] != key:
                    key, held = shard[lo], []
                part = batch.slice(lo, hi - lo)
                is_vector = np.array(part.column(2).is_valid())
                for n, at in _by_length(part.column(1)):
                    own = part.take(pa.array(at[is_vector[at]]))
                    if len(own):
                        held.append((n, _matrix(own.column(1)), own.column(2).to_pylist(), np.array(own.column(3).flatten())))
                    asking = part.take(pa.array(at[~is_vector[at]]))
                    if len(asking):
                        same = [x for x in held if x[0] == n]
                        if len(same) > 1:
                            same = [(n, np.concatenate([x[1] for x in same]), [i for x in same for i in x[2]], np.concatenate([x[3] for x in same]))]
                            held = [x for x in held if x[0] != n] + same
                        for i in range(0, len(asking) if same else 0, QUERIES):
                            yield _best(asking.slice(i, QUERIES), *same[0][1:], k, int(key % MERGE))

    found = met.mapInArrow(meet, "v array<double>, ids array<long>, scores array<double>, part int")
    pairs = F.transform(F.arrays_zip(F.col("scores").alias("score"), F.col("ids").alias("id")), lambda x: F.struct((-x["score"]).alias("minus"), x["id"].alias("id")))
    merged = lambda best: F.slice(F.array_sort(F.flatten(F.collect_list(best))), 1, k + 1).alias("best")
    # The answers of some shards are merged first, so that no row holds those of all.
    some = found.groupBy("v", "part").agg(merged(pairs))
    best = some.groupBy("v").agg(merged("best"))
    answered = asked.join(best, "v").select("query_id", F.posexplode(F.slice(F.filter("best", lambda x: x["id"] != F.col("query_id")), 1, k)).alias("rank", "b"))
    return answered.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("b.id").alias("vec_id"), (-F.col("b.minus")).alias("score"))


def split(vectors: DataFrame, trees: dict[int, Tree], shares: dict[tuple[int, int], float]):
    """(length, leaf, subtree) of each leaf in `shares`, fitted on that share of its vectors: those of the least hashes."""
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast((trees, shares))

    def sampled(batches):
        trees, shares = shared.value
        for batch in batches:
            for n, at in _by_length(batch.column(0)):
                if n not in trees:
                    continue
                x, h = _matrix(batch.column(0).take(pa.array(at))), np.array(batch.column(1))[at]
                leaf = trees[n].assign(x)
                cut = np.array([shares.get((n, int(i)), 0.0) for i in leaf])
                keep = np.flatnonzero(h < cut * (1 << 30))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keep), n)), pa.array(leaf[keep]), pa.array(list(x[keep]), pa.list_(pa.float64()))], names=["n", "leaf", "v"])

    def fit(key, rows):
        sample = np.stack([v for _, v in sorted((v.tobytes(), v) for v in (np.asarray(x, np.float64) for x in rows["v"]))])
        return pd.DataFrame([[int(key[0]), int(key[1]), pickle.dumps(Tree(sample))]], columns=["n", "leaf", "tree"])

    h = F.pmod(F.xxhash64("v", F.lit(1)), F.lit(1 << 30)).alias("h")
    rows = vectors.select("v", h).mapInArrow(sampled, "n long, leaf long, v array<double>").groupBy("n", "leaf").applyInPandas(fit, "n long, leaf long, tree binary")
    for r in rows.toLocalIterator():
        yield r["n"], r["leaf"], pickle.loads(r["tree"])


def pack(counts: dict[int, int]) -> dict[int, tuple[int, int]]:
    """(first shard, number of shards) of each leaf: leaves in order share a shard up to SHARD vectors; a larger leaf has its own."""
    out, shard, held = {}, 0, 0
    for leaf, n in sorted(counts.items()):
        if n > SHARD:
            shard += held > 0
            out[leaf] = (shard, -(-n // SHARD))
            shard, held = shard + out[leaf][1], 0
            continue
        if held + n > SHARD:
            shard, held = shard + 1, 0
        out[leaf] = (shard, 1)
        held += n
    return out


def _best(asking: pa.RecordBatch, vectors: np.ndarray, ids: list, leaf: np.ndarray, k: int, part: int) -> pa.RecordBatch:
    """v, ids, scores, part: of each query the k + 1 best ids among the vectors of its leaves.

    A matrix product picks the candidates; their scores are then summed pair by pair, so that a pair scores the same
    in any shard.
    """
    q = _matrix(asking.column(1))
    known, place = np.unique(leaf, return_inverse=True)
    wanted = np.zeros((len(q), len(known)), bool)
    lists = asking.column(3)
    at = np.searchsorted(known, np.array(lists.flatten()))
    owner = np.repeat(np.arange(len(q)), np.diff(np.array(lists.offsets)))
    at = np.minimum(at, len(known) - 1)
    good = known[at] == np.array(lists.flatten())
    wanted[owner[good], at[good]] = True
    rough = np.full((len(q), len(vectors)), -np.inf)
    for i in np.flatnonzero(wanted.any(0)):
        rows, columns = np.flatnonzero(wanted[:, i]), np.flatnonzero(place == i)
        rough[np.ix_(rows, columns)] = q[rows] @ vectors[columns].T
    keep = min(k + 1, len(vectors))
    cut = np.partition(rough, rough.shape[1] - keep, axis=1)[:, rough.shape[1] - keep]
    out_ids, out_scores = [], []
    for i, row in enumerate(rough):
        near = np.flatnonzero((row >= cut[i] - 1e-9 * (1 + abs(cut[i]))) & (row > -np.inf)) if np.isfinite(cut[i]) else np.flatnonzero(row > -np.inf)
        exact = (vectors[near] * q[i]).sum(1)
        chosen = sorted((-s, x) for s, j in zip(exact.tolist(), near.tolist()) for x in ids[j])[: k + 1]
        out_ids.append([x for _, x in chosen])
        out_scores.append([-s for s, _ in chosen])
    return pa.RecordBatch.from_arrays([asking.column(1), pa.array(out_ids, pa.list_(pa.int64())), pa.array(out_scores, pa.list_(pa.float64())), pa.array([part] * len(out_ids), pa.int32())], names=["v", "ids", "scores", "part"])
