"""Personal data by contextual bootstrapping.

Contract matches (email, ip, card, phone) are the seeds. Every token with a digit, an @ or an underscore is a possible
identifier, an instance; the words before it are its lexical patterns. Spark scores the bipartite pattern-instance
graph in rounds. A round admits the patterns that enough known instances induce and whose confidence, the mean score of
their distinct instances, is high; an instance's score is the noisy-or of the confidences of its admitted patterns,
seeds staying at one. Instances found in one round thus induce patterns in the next. Scores never fall, so the rounds
end at a fixed point. A pattern must also be specific: most of its occurrences anywhere in the corpus introduce an
instance, so words of ordinary prose don't count. What admitted patterns introduce is reported, seen before or not.
"""

from __future__ import annotations

import bisect
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrid.llm.words import Group, grams, groups, mix
from lexgrid.runtime import durable

# Kinds in the order in which they are listed.
KINDS = ("email", "ip", "card", "phone", "id")
BASE = KINDS[:4]

#: A pattern is admitted if so many distinct known instances back it and its confidence reaches the least one.
SEEDS, CONFIDENCE = 5, 0.5
#: Least share of a pattern's occurrences in the corpus that introduce an instance.
SPECIFIC = 0.5
#: Bits of the table, of 4 MB, that tells the tasks which patterns to count. Few patterns or many, its size is the same.
FILTER_BITS = 1 << 25
#: Distinct patterns that a task counts before it passes the counts on.
COUNTED = 200_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# Possessive runs and the look-behind change no match: what a run gives back is never what must follow it.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_DIGIT = re.compile(r"[0-9]")
_SIGN = re.compile(r"[0-9@_]")
_EDGE = "\"'()[]{}<>,;:!?.#=*"


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the contract's matches by start, then kind as listed."""
    found = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        last = m.end() if m else at + 1
        if m:
            found.append((start, 0, last))
        at = text.find("@", last)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return [(s, KINDS[k], e) for s, k, e in sorted(found)]


def spans_text(spans: list[tuple[int, str, int]]) -> str:
    return ",".join([f"{k}:{s}:{e}" for s, k, e in spans])


def contexts(g: Group) -> tuple[np.ndarray, np.ndarray]:
    """For each word of a group the hashes of its patterns: the word before it, and the two before it. 0 where there are none."""
    h = g.hashes()
    one, two = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
    first = np.ones(len(h), bool)
    first[1:] = g.doc[1:] != g.doc[:-1]
    one[1:] = np.where(first[1:], 0, mix(h[:-1] + np.uint64(1)).view(np.int64))
    pair, at = grams(h, g.doc, 2)
    at = at + 2
    inside = at < len(h)
    inside[inside] = g.doc[at[inside]] == g.doc[at[inside] - 2]
    two[at[inside]] = pair[inside].view(np.int64)
    return one, two


def instances(text: str, base: list[tuple[int, str, int]], one: np.ndarray, two: np.ndarray) -> list[dict]:
    """Seeds and other tokens with a digit, an @ or an underscore, each with its patterns. one, two: the contexts of the text's words."""
    if not base and not _SIGN.search(text):
        return []
    spans, cover = [(s, e, True) for s, _, e in base], iter([*base, (len(text) + 1, "", len(text) + 1)])
    tokens, before, history = [], next(cover), []
    for m in _TOKEN.finditer(text):
        while before[2] <= m.start():
            before = next(cover)
        history.append((m.start(), m.end()))
        if before[0] < m.end():
            continue
        if _SIGN.search(m[0]):
            stripped = m[0].strip(_EDGE)
            if len(stripped) >= 5 and _SIGN.search(stripped):
                start = m.start() + m[0].index(stripped)
                spans.append((start, start + len(stripped), False))
    ends = [h[1] for h in history]
    for s, e, seed in sorted(spans):
        i = bisect.bisect_right(ends, s)
        patterns = [int(x[i]) for x in (one, two) if i < len(x) and x[i]]
        tokens.append({"start": s, "stop": e, "seed": seed, "instance": xxhash.xxh3_64_intdigest(text[s:e]) - (1 << 63), "patterns": patterns})
    return tokens


_INSTANCE = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("seed", pa.bool_()), ("instance", pa.int64()), ("patterns", pa.list_(pa.int64()))])
_INSTANCE_DDL = "array<struct<start:int,stop:int,seed:boolean,instance:bigint,patterns:array<bigint>>>"


def _row() -> Column:
    """A hash of the text, which tells rows of one doc_id apart."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("row")


def scan(df: DataFrame) -> DataFrame:
    """doc_id, row, base, found of each row: one pass over the texts."""

    def run(batches):
        for batch in batches:
            for g in groups(batch.column(2)):
                part, bases, every = batch.slice(g.lo, g.n), [], []
                one, two = contexts(g)
                first = g.first_word()
                for i, x in enumerate(part.column(2)):
                    text = x.as_py() or ""
                    base = base_spans(text)
                    bases.append(spans_text(base))
                    every.append(instances(text, base, one[first[i] : first[i + 1]], two[first[i] : first[i + 1]]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(bases, pa.string()), pa.array(every, pa.list_(_INSTANCE))], names=["doc_id", "row", "base", "found"])

    return df.select("doc_id", _row(), "text").mapInArrow(run, f"doc_id long, row long, base string, found {_INSTANCE_DDL}")


def _filter(patterns: DataFrame) -> np.ndarray:
    """A bit for each remainder of a pattern's hash by FILTER_BITS, set where a pattern has it."""
    place = F.pmod("pattern", F.lit(FILTER_BITS)) + 1  # Spark's bitmaps count from one
    buckets = patterns.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in buckets.toLocalIterator():
        part = np.frombuffer(r["bits"], np.uint8)
        at = (r["bucket"] - 1) * len(part)
        bits[at : at + len(part)] = part
    return bits


def occurrences(df: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern, n: how often each of the patterns occurs before any word of the corpus, in one pass over the texts.

    The tasks count what a bit table of fixed size lets through, which is all of the patterns and few others.
    """
    wanted = df.sparkSession.sparkContext.broadcast(_filter(patterns))

    def run(batches):
        bits, held = wanted.value, {}

        def out():
            yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.int64()), pa.array(held.values(), pa.int64())], names=["pattern", "n"])

        for batch in batches:
            for g in groups(batch.column(0)):
                both = np.concatenate(contexts(g))
                place = both & (FILTER_BITS - 1)
                keys, counts = np.unique(both[(bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0], return_counts=True)
                for k, n in zip(keys.tolist(), counts.tolist()):
                    held[k] = held.get(k, 0) + n
                if len(held) > COUNTED:
                    yield from out()
                    held.clear()
        yield from out()

    counted = df.select("text").mapInArrow(run, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    return counted.join(patterns.select("pattern"), "pattern", "left_semi")


def specific_edges(df: DataFrame, scanned: DataFrame, seeds: int, specific: float) -> DataFrame:
    """pattern, instance, seed: once for each pair, of the patterns with `seeds` distinct instances that are specific."""
    edges = durable(
        scanned.where(F.size("found") > 0)
        .select(F.explode("found").alias("f"))
        .select(F.explode("f.patterns").alias("pattern"), "f.instance", "f.seed")
        .groupBy("pattern", "instance")
        .agg(F.max("seed").alias("seed"), F.count("*").alias("n"))
    )
    backed = durable(edges.groupBy("pattern").agg(F.count("*").alias("instances"), F.sum("n").alias("hits")).where(F.col("instances") >= seeds).select("pattern", "hits"))
    if backed.isEmpty():
        return edges.select("pattern", "instance", "seed").limit(0)
    good = backed.join(occurrences(df, backed), "pattern").where(F.col("hits") >= F.lit(specific) * F.col("n")).select("pattern")
    return durable(edges.join(good, "pattern", "left_semi").select("pattern", "instance", "seed"))


def score_patterns(edges: DataFrame, seeds: int = SEEDS, confidence: float = CONFIDENCE) -> DataFrame:
    """pattern, confidence of the patterns admitted when no score changes any more.

    Instances are distinct values, so copies of one document add nothing. Every round is two sums over edges; the
    state between rounds, one row for each known instance, is written to the shared folder. Scores are rounded to
    thousandths, so they can only rise so often.
    """
    score = durable(edges.where("seed").select("instance").distinct().withColumn("score", F.lit(1.0)))
    before = None
    while True:
        judged = edges.join(score, "instance", "left").groupBy("pattern").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("confidence"), F.sum((F.col("score") >= confidence).cast("int")).alias("support"))
        admitted = durable(judged.where((F.col("support") >= seeds) & (F.col("confidence") >= confidence)).select("pattern", "confidence"))
        doubt = F.exp(F.sum(F.log(F.greatest(F.lit(1.0) - F.col("confidence"), F.lit(1e-9)))))
        found = edges.join(admitted, "pattern").groupBy("instance").agg(F.round(1.0 - doubt, 3).alias("found"), F.max("seed").alias("seed"))
        known = found.where("not seed").select("instance", F.col("found").alias("score"))
        score = durable(edges.where("seed").select("instance").distinct().withColumn("score", F.lit(1.0)).unionByName(known.where(F.col("score") > 0)).groupBy("instance").agg(F.max("score").alias("score")))
        now = tuple(score.agg(F.count("*"), F.sum(F.round(F.col("score") * 1000).cast("long"))).first())
        if now == before:
            return admitted
        before = now


def discovered(scanned: DataFrame, patterns: DataFrame) -> DataFrame:
    """doc_id, row, added: the spans that confident patterns introduce and no seed covers."""
    opened = scanned.where(F.exists("found", lambda f: ~f["seed"])).dropDuplicates(["doc_id", "row"]).select("doc_id", "row", F.explode("found").alias("f")).where("not f.seed")
    return (
        opened.select("doc_id", "row", "f.start", "f.stop", F.explode("f.patterns").alias("pattern"))
        .join(patterns, "pattern", "left_semi")
        .groupBy("doc_id", "row")
        .agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("added"))
    )


def learned(df: DataFrame, scanned: DataFrame, seeds: int, confidence: float, specific: float = SPECIFIC) -> DataFrame:
    """The spans that bootstrapping adds, written to the shared folder: Spark knows their size when it joins them to the rows."""
    return durable(discovered(scanned, score_patterns(specific_edges(df, scanned, seeds, specific), seeds, confidence)))


def _with(left: DataFrame, added: DataFrame) -> DataFrame:
    right = added.select(F.col("doc_id").alias("_doc"), F.col("row").alias("_row"), "added")
    return left.join(right, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("row") == F.col("_row")), "left").drop("_doc", "_row")


def find(df: DataFrame, seeds: int = SEEDS, confidence: float = CONFIDENCE) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added for every row of df (doc_id, text).

    A null or empty text has no span. Repeated rows each get their result. Without seeds no pattern is learned. No rows
    give none. Other columns are not read.
    """
    scanned = durable(scan(df))
    rows = _with(scanned.select("doc_id", "row", "base"), learned(df, scanned, seeds, confidence))
    start = lambda s: F.element_at(F.split(s, ":"), 2).cast("int")
    base = F.filter(F.split("base", ","), lambda s: s != "")
    order = F.concat(
        F.transform(base, lambda s: F.struct(start(s).alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), F.element_at(F.split(s, ":"), 1)).alias("rank"), s.alias("s"))),
        F.transform(F.coalesce("added", F.array().cast("array<struct<start:int,stop:int>>")), lambda a: F.struct(a["start"].alias("start"), F.lit(len(KINDS)).cast("bigint").alias("rank"), F.concat_ws(":", F.lit(KINDS[-1]), a["start"], a["stop"]).alias("s"))),
    )
    return rows.select(
        "doc_id",
        *[_number(base, k).alias(f"n_{k}") for k in BASE],
        F.sha2("base", 256).alias("base_sha256"),
        F.array_join(F.transform(F.array_sort(order), lambda x: x["s"]), ",").alias("spans"),
        F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_added"),
    )


def _number(spans, kind: str):
    return F.size(F.filter(spans, lambda s: s.startswith(f"{kind}:"))).cast("long")


def mask_text(text: str, added: list[tuple[int, int]]) -> str:
    """The text with each span, and each stretch of overlapping ones, replaced by the first kind's name in brackets."""
    spans = sorted([(s, e, k) for s, k, e in base_spans(text)] + [(s, e, KINDS[-1]) for s, e in added])
    out, at = [], 0
    for i, (s, e, k) in enumerate(spans):
        if s >= at:
            out += [text[at:s], f"[{k.upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:] if spans else text


def mask(df: DataFrame, seeds: int = SEEDS, confidence: float = CONFIDENCE) -> DataFrame:
    """df with every span in `text` replaced by its kind; a column n_chars, if there, gets the new length. A null text stays null."""
    scanned = durable(scan(df))
    names = df.columns
    keyed = _with(df.withColumn("row", _row()), learned(df, scanned, seeds, confidence))

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [None if t is None else mask_text(t, [(a["start"], a["stop"]) for a in more or ()]) for t, more in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist())]
            columns = list(batch.columns)[: len(names)]
            columns[at] = pa.array(texts, pa.string())
            if "n_chars" in names:
                columns[names.index("n_chars")] = pa.array([None if t is None else len(t) for t in texts], columns[names.index("n_chars")].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return keyed.select(*names, "added").mapInArrow(run, df.schema)

