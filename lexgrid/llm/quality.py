"""Quality rules whose cutoffs come from labelled documents, with a guaranteed bound on how many good ones they reject.

A rule rejects a document whose score (share of repeated words, of symbols, of repeated lines, ...) is at or above a
cutoff. All rules together form one nested family: a path of steps, each of which moves one rule's cutoff to a stricter
place of a fixed grid, so what a step rejects every later step rejects too. The path is laid greedily on a bounded
sample of the labelled rows, which then take no further part. On the other labelled rows, the holdout, the good ones
that each step rejects are counted in each stratum. The exact binomial (Clopper-Pearson) upper bound of the rate of
rejected good documents must be at most `risk`, at confidence 1 - `alpha` / strata: Bonferroni's correction over
strata. Within a stratum the steps are tested from the mildest on and testing stops at the first that fails
(fixed-sequence testing), so the path needs no further correction. Of the accepted steps the one with the best balance
of bad and good holdout documents rejected is taken, the mildest of equal ones; without gain nothing is rejected.

Strata with fewer than LEAST good holdout documents can't be certified by themselves. They are tested as one stratum
together, and the bound then holds for their mixture.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lexgrid.llm.words import SPACE, Group, counts, grams, groups, mix
from lexgrid.runtime import durable

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
#: Most good documents of a stratum that may be rejected, and the probability with which any bound may fail.
RISK, ALPHA = 0.05, 0.05
#: Bad documents that must be rejected for each good one.
COST = 5
#: Grid of the cutoffs: step i of a rule rejects scores of at least 1 - i / GRID; the mildest comes first.
GRID = 50
#: The path is laid on at most so many labelled rows, one in DESIGN_SHARE of them.
DESIGN_ROWS, DESIGN_SHARE = 3000, 3
#: Good holdout documents that a stratum of its own needs: with fewer, no step could pass even as the only test.
LEAST = math.ceil(math.log(ALPHA) / math.log(1 - RISK))
RULES = ("repeat", "symbols", "dup_lines", "few_distinct", "long_words")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_BLANK = b" \t\n\x0b\x0c\r"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct")
MEASURE_DDL = ", ".join(f"{m} long" for m in MEASURES)


def measure(g: Group) -> list[np.ndarray]:
    """The measures of each row of a group."""
    words = np.diff(g.first_word())
    solid = ~SPACE[g.data] & ((g.data & 0xC0) != 0x80)
    lines, dup = np.zeros(g.n, np.int64), np.zeros(g.n, np.int64)
    raw = g.data.tobytes()
    for i in range(g.n):
        seen: set[bytes] = set()
        for line in raw[g.offsets[i] : g.offsets[i + 1]].split(b"\n"):
            if line in seen:
                lines[i] += 1
                dup[i] += 1
            elif line.strip(_BLANK):
                lines[i] += 1
                seen.add(line)
    h = g.hashes()
    salt = mix(g.doc.astype(np.uint64) + np.uint64(1))
    window, at = grams(h, g.doc, WINDOW)
    covered = np.zeros(len(h) + 1, np.int64)
    if len(at):
        _, inverse, times = np.unique(window ^ salt[at], return_inverse=True, return_counts=True)
        again = at[times[inverse] > 1]
        np.add.at(covered, again, 1)
        np.add.at(covered, again + WINDOW, -1)
    repeat = np.bincount(g.doc[np.cumsum(covered)[:-1] > 0], minlength=g.n)
    distinct = np.bincount(g.doc[np.unique(h ^ salt, return_index=True)[1]], minlength=g.n)
    return [words, counts(g, solid), counts(g, _SYMBOL[g.data]), lines, dup, repeat, distinct]


def measures(df: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` with each row's measures of `text`; a null text has no word."""

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for g in groups(batch.column(at)):
                part = batch.slice(g.lo, g.n).select(keep)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(m, pa.int64()) for m in measure(g))], names=[*keep, *MEASURES])

    columns = [df[c] for c in dict.fromkeys([*keep, "text"])]
    schema = df.select(*[df[c] for c in keep]).schema
    for m in MEASURES:
        schema = schema.add(m, "long")
    return df.select(*columns).mapInArrow(run, schema)


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def score(rule: str):
    """A rule's score from 0 to 1 as a column over the measures; larger is worse."""
    words, share = F.greatest(F.col("n_words"), F.lit(1)), None
    if rule == "repeat":
        share = F.col("n_repeat_words") / words
    elif rule == "symbols":
        share = F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))
    elif rule == "dup_lines":
        share = F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))
    elif rule == "few_distinct":
        # Longer texts have fewer distinct words; the square root of the length evens that out.
        share = 1 - F.least(F.lit(1.0), F.col("n_distinct") / (F.sqrt(words) * F.lit(8.0)))
    else:
        share = F.least(F.lit(1.0), F.col("word_chars") / words / F.lit(40.0))
    return share.cast("double")


def _tail(k: int, n: int, p: float) -> float:
    """The probability of at most k successes in n trials: the regularized incomplete beta function by its continued fraction."""

    def fraction(a: float, b: float, x: float) -> float:
        front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
        c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
        out = d
        for m in range(1, 100_000):
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            for term in (even, odd):
                d, c = 1 + term * d, 1 + term / c
                d, c = 1 / (d or 1e-300), c or 1e-300
                out *= c * d
            if abs(c * d - 1) < 1e-12:
                break
        return front * out / a

    if p <= 0.0 or k >= n:
        return 1.0
    if p >= 1.0:
        return 0.0
    a, b, x = n - k, k + 1, 1 - p
    return fraction(a, b, x) if x < (a + 1) / (a + b + 2) else 1 - fraction(b, a, p)


def upper_bound(rejected: int, n: int, delta: float) -> float:
    """Clopper-Pearson: the largest rate at which as few as `rejected` of n still have probability `delta`."""
    if n == 0 or rejected >= n:
        return 1.0
    low, high = rejected / n, 1.0
    while high - low > 1e-10:
        middle = (low + high) / 2
        if _tail(rejected, n, middle) > delta:
            low = middle
        else:
            high = middle
    return high


def steps() -> list:
    """For each rule the grid step at which it first rejects a measured row: 0 is the mildest cutoff, GRID rejects all."""
    return [F.ceil((1 - score(r)) * GRID - 1e-9).cast("int") for r in RULES]


def lay_path(x: np.ndarray, good: np.ndarray, cost: float = COST) -> list[tuple[int, int]]:
    """The path: (rule, grid step) moves. x: the grid steps of labelled rows, (rows, rules).

    Each move rejects the rows with the best share of bad ones among those left, of equal shares the most, then of the
    first rule at the mildest step. A move that no longer rejects `cost` bad rows for a good one ends the path.
    """
    left, path = np.ones(len(x), bool), []
    at = [-1] * x.shape[1]
    while left.any():
        best, move = (cost / (cost + 1), 0.0), None
        for rule in range(x.shape[1]):
            bad = np.cumsum(np.bincount(x[left & ~good, rule], minlength=GRID + 1))
            all_ = np.cumsum(np.bincount(x[left, rule], minlength=GRID + 1))
            for step in np.flatnonzero(np.diff(bad, prepend=0)):
                gain = (bad[step] / all_[step], float(bad[step]))
                if step > at[rule] and step < GRID and gain > best:
                    best, move = gain, (rule, int(step))
        if move is None:
            break
        path.append(move)
        at[move[0]] = move[1]
        left &= x[:, move[0]] > move[1]
    return path


def position(path: list[tuple[int, int]]):
    """The first move of the path that rejects a measured row, from 0; null if none does."""
    by_rule = []
    for rule, step in zip(range(len(RULES)), steps()):
        own = sorted((s, i) for i, (r, s) in enumerate(path) if r == rule)
        found = F.lit(None).cast("int")
        for s, i in reversed(own):
            found = F.when(step <= s, F.lit(i)).otherwise(found)
        by_rule.append(found)
    return F.least(*by_rule) if path else F.lit(None).cast("int")


def choose(good: dict[int, int], bad: dict[int, int], n: int, moves: int, tests: int, risk: float = RISK, alpha: float = ALPHA) -> int | None:
    """The last move of the path to use, or None. good, bad: holdout documents by position; n: good ones in all."""
    found, best = None, 0
    lost = caught = 0
    for i in range(moves):
        lost, caught = lost + good.get(i, 0), caught + bad.get(i, 0)
        if lost > risk * n or upper_bound(lost, n, alpha / tests) > risk:
            break
        if caught - COST * lost > best:
            found, best = i, caught - COST * lost
    return found


class Cutoffs(NamedTuple):
    """The path, and per stratum the last move that counts: those of `own` (stratum, last) by themselves, `other` for all else."""

    path: list[tuple[int, int]]
    own: list[tuple]
    other: int | None


def cutoffs(measured: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, alpha: float = ALPHA) -> Cutoffs:
    """The certified cutoffs from the labelled documents that the base rules keep.

    A document with several labels counts as good if any says so. To the driver come DESIGN_ROWS rows of grid steps at
    most, and one count for each position, label and stratum of at least LEAST good holdout documents.
    """
    label = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg((F.max("quality") == 1).alias("good"))
    # A hash of the id deals the rows, so that copies of a row are never on both sides.
    deal = F.xxhash64("doc_id", F.lit("design"))
    rows = durable(measured.where(~base_failed()).join(label, "doc_id").select("good", F.col(stratum).alias("stratum"), deal.alias("deal"), *MEASURES))
    design = F.pmod("deal", F.lit(DESIGN_SHARE)) == 0
    sample = rows.where(design).orderBy("deal", *MEASURES, "good").limit(DESIGN_ROWS).select("good", *[s.alias(f"s{i}") for i, s in enumerate(steps())]).collect()
    path = lay_path(np.array([r[1:] for r in sample], np.int64).reshape(-1, len(RULES)), np.array([r[0] for r in sample], bool))
    holdout = rows.where(~design).groupBy("stratum", position(path).alias("position"), "good").count()
    large = holdout.where("good").groupBy("stratum").agg(F.sum("count").alias("n")).where(F.col("n") >= LEAST).select(F.col("stratum").alias("own"), F.lit(True).alias("large"))
    dealt = holdout.join(large, F.col("stratum").eqNullSafe(F.col("own")), "left").withColumn("own", F.col("large").isNotNull())
    counted = dealt.groupBy(F.when(F.col("own"), F.col("stratum")).alias("stratum"), "own", "position", "good").agg(F.sum("count").alias("n")).collect()
    found: dict = {}
    for r in counted:
        found.setdefault((r["own"], r["stratum"]), ({}, {}))[r["good"]][r["position"]] = r["n"]
    last = {key: choose(good, bad, sum(good.values()), len(path), len(found), risk, alpha) for key, (bad, good) in found.items()}
    return Cutoffs(path, sorted(((s, i) for (own, s), i in last.items() if own), key=str), last.get((False, None)))


def with_verdict(measured: DataFrame, chosen: Cutoffs, stratum: str = "lang") -> DataFrame:
    """measured with base_failed and kept: whether neither the base rules nor a move up to its stratum's last one reject a row.

    The strata's cutoffs are a table, which Spark sends to all tasks if its files are small.
    """
    spark = measured.sparkSession
    judged = measured.withColumn("base_failed", base_failed()).withColumn("_position", F.when(~F.col("base_failed"), position(chosen.path)))
    last = F.lit(chosen.other).cast("int")
    if chosen.own:
        table = durable(spark.createDataFrame([(s, i) for s, i in chosen.own], StructType([StructField("_stratum", measured.schema[stratum].dataType), StructField("_last", IntegerType())])).withColumn("_own", F.lit(True)))
        judged = judged.join(table, F.col(stratum).eqNullSafe(F.col("_stratum")), "left")
        last = F.when(F.col("_own"), F.col("_last")).otherwise(last)
    kept = ~F.col("base_failed") & ~F.coalesce(F.col("_position") <= last, F.lit(False))
    return judged.withColumn("kept", kept).drop("_position", "_stratum", "_last", "_own")


def judge(df: DataFrame, labels: DataFrame, keep: list[str] | None = None, risk: float = RISK, alpha: float = ALPHA) -> DataFrame:
    """The columns `keep` (doc_id and lang at least), the measures, base_failed and kept for every row of df.

    df has doc_id, text and lang; labels has doc_id and quality (1 is good). Texts are measured once and the measures
    written to the shared folder, for they are read again after the cutoffs are known. A null or empty text fails the
    base rules; a null lang is a stratum of its own; repeated rows each get their result; no rows give none. Without
    labelled good documents only the base rules reject.
    """
    keep = list(dict.fromkeys(["doc_id", "lang", *(keep or [])]))
    measured = durable(measures(df, keep))
    return with_verdict(measured, cutoffs(measured, labels, "lang", risk, alpha))


def report(df: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the measures, base_failed and kept for every row of df; nulls, empty texts and repeated rows as in judge()."""
    return judge(df, labels).select("doc_id", *MEASURES, "base_failed", "kept")
