"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a random key from a hash of its id. A source's documents in key order are its shuffled sequence;
the mix takes whole passes over it and then its first words up to the source's exact budget. The order is global but
never sorted in one task: the key's first hex digits cut a source into equal ranges, sums over ranges give each
range's offset, and only the inside of a range is sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Repeating weights of the sources in code point order, null last.
WEIGHTS = (3, 1, 2)
#: All targets together, as a multiple of all sizes; a source's target is at most CAP times its size.
SHARE = 1.5
CAP = 2.0
#: Hex digits of the key that name a range: 16 ** 3 ranges a source.
RANGE_DIGITS = 3

WORDS = r"[^\x20\x09-\x0D]+"


def sizes(df: DataFrame, text: str = "text", carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size (words; a null text has none), and the carried columns."""
    return df.select("doc_id", "source", *carried, F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long").alias("size"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, target: `share` of all words dealt by weight, with the excess over `cap` x size dealt again.

    A source is at its cap if the level at which all sources below its own cap share the rest reaches it. In order of
    cap / weight the capped ones come first, so sums over that order find the level in one pass. One row a source.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row for each source: these two windows are over a table of the sources, not of the documents.
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = by_source.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("double"))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    sums = weighed.select(
        "*",
        F.sum("source_size").over(everything).alias("all_size"),
        (F.sum("source_size").over(order) - F.col("source_size")).alias("size_before"),
        (F.sum("weight").over(everything) - F.sum("weight").over(order) + F.col("weight")).alias("weight_left"),
    )
    level = (F.lit(share) * F.col("all_size") - F.lit(cap) * F.col("size_before")) / F.col("weight_left")
    capped = F.col("weight") * level >= F.lit(cap) * F.col("source_size")
    leveled = sums.select("*", capped.alias("capped"), level.alias("level_here"))
    # The level of the first source that is not capped holds for all that are not.
    final = F.min(F.when(~F.col("capped"), F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source", "level_here"))).over(everything)["level_here"]
    return leveled.select("source", "source_size", F.when(F.col("capped"), F.lit(cap) * F.col("source_size")).otherwise(F.col("weight") * final).cast("double").alias("target"))


def mix(df: DataFrame, text: str = "text", carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken, and the carried columns, for every row of df (doc_id, source, `text`).

    Words taken of a source add up to its target, rounded down; the document at the cut is taken in part. Rows of one
    doc_id come in order of size and of the carried columns; equal ones are alike. A null doc_id hashes as the empty text; a null source is a
    source of its own and comes last; a source without words has target 0. No rows give none.
    """
    sized = sizes(df, text, carried).withColumn("key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).withColumn("range", F.substring("key", 1, RANGE_DIGITS))
    sums = sized.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    ahead = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    planned = targets(sums.select("source", F.col("range_size").alias("size")))
    starts = sums.withColumn("range_start", F.coalesce(F.sum("range_size").over(ahead), F.lit(0)))
    # Sums over ranges joined with one row a source, then with the documents by (source, range): no document is sent by its source alone.
    offsets = starts.alias("s").join(planned.alias("p"), F.col("s.source").eqNullSafe(F.col("p.source"))).select("s.source", "s.range", "s.range_start", "p.source_size", "p.target")
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size", *carried).rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("range_before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = placed.alias("d").join(offsets.alias("o"), F.col("d.source").eqNullSafe(F.col("o.source")) & (F.col("d.range") == F.col("o.range")))
    budget = F.floor(F.col("o.target")).cast("long")
    passes = F.when(F.col("o.source_size") > 0, F.floor(budget / F.col("o.source_size"))).otherwise(F.lit(0)).cast("long")
    left = budget - passes * F.col("o.source_size") - F.col("o.range_start") - F.col("d.range_before")
    taken = passes * F.col("d.size") + F.least(F.col("d.size"), F.greatest(left, F.lit(0)))
    return joined.select("d.doc_id", "d.size", "o.source_size", "o.target", taken.cast("long").alias("taken"), *[f"d.{c}" for c in carried])


#: The same in DuckDB's SQL.
SQL = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         md5(coalesce(cast(doc_id as varchar), '')) as key
  from documents),
by_source as (
  select source, sum(size)::bigint as source_size from sized group by source),
weighed as (
  select *, cast([3, 1, 2][((row_number() over (order by source nulls last) - 1) % 3) + 1] as double) as weight from by_source),
sums as (
  select *, cast(sum(source_size) over () as bigint) as all_size,
         cast(sum(source_size) over (order by source_size / weight, source nulls last) as bigint) - source_size as size_before,
         sum(weight) over () - sum(weight) over (order by source_size / weight, source nulls last) + weight as weight_left
  from weighed),
leveled as (
  select *, (1.5::double * all_size - 2.0::double * size_before) / weight_left as level_here from sums),
capped as (
  select *, weight * level_here >= 2.0::double * source_size as is_capped from leveled),
level as (
  select level_here from capped where not is_capped order by source_size / weight, source nulls last limit 1),
planned as (
  select source, source_size,
         case when is_capped then 2.0::double * source_size else weight * (select level_here from level) end as target
  from capped),
placed as (
  select d.doc_id, d.size, p.source_size, p.target, cast(floor(p.target) as bigint) as budget,
         cast(coalesce(sum(d.size) over (partition by d.source order by d.key, d.doc_id, d.size
              rows between unbounded preceding and 1 preceding), 0) as bigint) as before
  from sized d join planned p on d.source is not distinct from p.source),
passed as (
  select *, case when source_size > 0 then budget // source_size else 0 end as passes from placed)
select doc_id, size, source_size, target,
       cast(passes * size + least(size, greatest(budget - passes * source_size - before, 0)) as bigint) as taken
from passed
"""
