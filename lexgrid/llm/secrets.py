"""Secret scans weighed by corpus-wide ownership, with DataFrame functions only.

Each text is scanned once for candidates. A candidate's value is hashed and counted over the corpus by distinct
repositories (documents) and owners (sources): a value copied through many of them is an example that everybody
quotes; one that stays with few and looks random is a live-looking credential of its owner. Contract spans (`base`)
always stay; candidates of further formats are added if they are owner-specific and live-looking.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrid.runtime import durable

# The formats, in the order in which they are listed.
BASE = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
#: What may stand between the lines of a key: white space, also escaped, and marks of strings, quotes and comments.
BREAK = r"""(?:\\[nrt]|[\s\\"',>#|])"""
ADDED = {
    "bearer": (r"(?i:bearer)\x20+([A-Za-z0-9_.=-]{20,})", 1, 20),
    "github": (r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    "slack": (r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    "stripe": (r"[sr]k_live_[A-Za-z0-9]{16,}", 0, 24),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30),
    # The span is the header line, which all keys of a type share; the value is the key that follows, up to END or as far as whole lines go.
    "pem": (
        rf"-----BEGIN [A-Z ]*PRIVATE KEY-----(?={BREAK}*+(?:[A-Za-z-]++:[^\r\n\\]*+{BREAK}++)*+"
        rf"""([A-Za-z0-9+/=\s\\"',>#|]++(?=-----END)|[A-Za-z0-9+/=]{{16,}}+(?:{BREAK}++[A-Za-z0-9+/=]{{16,}}+)*+|))""",
        1,
        20,
    ),
}
KINDS = [*BASE, *ADDED]

#: A value in this many documents of this many owners counts as copied.
COPIED_REPOSITORIES = 5
COPIED_OWNERS = 3
#: A live-looking value has this many distinct characters.
LIVE_CHARACTERS = 8


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sums(x: Column) -> Column:
    """Sums up to and with each place of an array. An array grows by copying, so n values go in about sqrt(n) blocks of sqrt(n)."""

    def plain(part: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
        return F.aggregate(part, start, lambda s, v: F.struct((s["at"] + v).alias("at"), F.concat(s["all"], F.array(s["at"] + v)).alias("all")), lambda s: s["all"])

    def whole(x: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(x))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.size(x) - 1, width), lambda i: plain(F.slice(x, i + 1, width)))
        return _let(blocks, lambda b: _let(plain(F.transform(b, lambda y: F.element_at(y, -1))), lambda ends: F.flatten(F.transform(b, lambda y, i: _shift(y, F.when(i > 0, F.get(ends, i - 1)).otherwise(F.lit(0)))))))

    def _shift(y: Column, by: Column) -> Column:
        return _let(by, lambda n: F.transform(y, lambda v: v + n))

    return F.when(F.size(x) > 0, _let(x, whole)).otherwise(F.array().cast("array<int>"))


_SPANS = "array<struct<start:int,stop:int,kind:string,value:string>>"


def found(text: Column, kind: str) -> Column:
    """array<struct<start, stop, kind, value>> of one kind: leftmost matches without overlap, positions in code points.

    The text is split at the matches, so the lengths of pieces and matches give the positions.
    """
    pattern, group, least = (BASE | ADDED)[kind]
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    if kind == "pem":
        # A key is the same under any line breaks and indents. A header without a key counts as itself.
        key = lambda v: F.regexp_replace(v, r"\\[nrt]|[^A-Za-z0-9+/=]", "")
        values = F.zip_with(matches, values, lambda m, v: F.when(F.length(key(v)) >= least, key(v)).otherwise(m))
    stops = _sums(F.zip_with(F.slice(between, F.lit(1), F.size(matches)), matches, lambda b, m: F.length(b) + F.length(m)))
    zipped = F.arrays_zip(matches.alias("m"), values.alias("v"), stops.alias("stop"))
    spans = F.transform(zipped, lambda x: F.struct((x["stop"] - F.length(x["m"])).alias("start"), x["stop"].alias("stop"), F.lit(kind).alias("kind"), x["v"].alias("value")))
    return F.when(text.rlike(pattern), F.filter(spans, lambda s: F.length(s["value"]) >= least)).otherwise(F.array().cast(_SPANS))


def spans_text(spans: Column) -> Column:
    """kind:start:end, by start and then kind as listed, comma-joined."""
    order = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("rank"), s["stop"].alias("stop"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(order), lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def _number(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def candidates(df: DataFrame, repository: str = "doc_id", owner: str = "source") -> DataFrame:
    """doc_id, row, repository, owner, spans of every row: one scan of the texts. row tells rows of one doc_id apart by their text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return df.select("doc_id", F.xxhash64(text).alias("row"), F.col(repository).cast("string").alias("repository"), F.col(owner).cast("string").alias("owner"), F.concat(*[found(text, k) for k in KINDS]).alias("spans"))


def ownership(scanned: DataFrame) -> DataFrame:
    """value (its hash), repositories, owners: in how many distinct ones each candidate value occurs. Nulls count as one more."""
    seen = scanned.select(F.explode("spans").alias("s"), "repository", "owner").select(F.xxhash64(F.col("s.value")).alias("value"), F.coalesce("repository", F.lit("")).alias("repository"), F.coalesce("owner", F.lit("")).alias("owner"))
    owners = seen.groupBy("value", "owner", "repository").agg(F.lit(1)).groupBy("value", "owner").agg(F.count("*").alias("n"))
    return owners.groupBy("value").agg(F.sum("n").alias("repositories"), F.count("*").alias("owners"))


def scan(df: DataFrame, repository: str = "doc_id", owner: str = "source") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_copied, n_live, verdicts for every row of df (doc_id, text, source).

    verdicts lists value hash, kind, repositories, owners and live for each span. A null or empty text has no spans.
    Repeated rows each get their result. No rows give none. Other columns are not read.
    """
    scanned = durable(candidates(df, repository, owner))
    each = scanned.where(F.size("spans") > 0).select("doc_id", "row", "spans").dropDuplicates(["doc_id", "row"])
    owned = durable(ownership(scanned))  # a table of known size, so that Spark can send it to all tasks or split a common value
    opened = each.select("doc_id", "row", F.explode("spans").alias("s")).withColumn("value", F.xxhash64(F.col("s.value")))
    live = ((F.col("repositories") < COPIED_REPOSITORIES) | (F.col("owners") < COPIED_OWNERS)) & (F.size(F.array_distinct(F.split(F.col("s.value"), ""))) >= LIVE_CHARACTERS)
    judged = (
        opened.join(owned, "value")
        .select("doc_id", "row", F.struct("s.start", "s.stop", "s.kind", "value", "repositories", "owners", live.alias("live")).alias("v"))
        .groupBy("doc_id", "row")
        .agg(F.sort_array(F.collect_list("v")).alias("verdicts"))
    )
    # A null doc_id joins itself too.
    rows = scanned.alias("a").join(judged.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.row") == F.col("b.row")), "left")
    verdicts = F.coalesce(F.col("b.verdicts"), F.array().cast(judged.schema["verdicts"].dataType))
    base = F.filter("a.spans", lambda s: s["kind"].isin(*BASE))
    kept = F.filter(verdicts, lambda v: v["kind"].isin(*BASE) | v["live"])
    return rows.select(
        F.col("a.doc_id").alias("doc_id"),
        *[_number("a.spans", k) for k in BASE],
        F.sha2(spans_text(base), 256).alias("base_sha256"),
        spans_text(kept).alias("spans"),
        F.size(F.filter(verdicts, lambda v: (v["repositories"] >= COPIED_REPOSITORIES) & (v["owners"] >= COPIED_OWNERS))).cast("long").alias("n_copied"),
        F.size(F.filter(verdicts, lambda v: v["live"])).cast("long").alias("n_live"),
        verdicts.alias("verdicts"),
    )
