"""Table operators: pivots, shares, ranks, dedupes, set operations, samples and category analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexgrid.runtime import durable


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """column, n, share of the non-null values."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    total = F.broadcast(counts.agg(F.sum("n").alias("total")))  # one row
    return counts.join(total).select(column, "n", (F.col("n") / F.col("total")).alias("share"))


def pivot(df: DataFrame, row: str, column: str, value: str, columns: list) -> DataFrame:
    """Rows by `row`, one column for each of `columns`, missing cells 0; rows with a null key are dropped."""
    return df.where(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(row).pivot(column, columns).agg(F.first(value)).fillna(0)


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def top_per_group(df: DataFrame, group: list[str], n: int, *order: Column) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows by the least hash of key and seed: random, and the same at every run."""
    return df.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)


def first_rows(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def duplicated(df: DataFrame, keys: list[str], order: str, keep: str | None = "first") -> DataFrame:
    """Rows whose keys stand in an earlier row (keep='first'), or in any other row (keep=None)."""
    w = Window.partitionBy(*keys)
    flag = F.row_number().over(w.orderBy(order)) > 1 if keep == "first" else F.count("*").over(w) > 1
    return df.withColumn("_d", flag).where("_d").drop("_d")


def describe(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """mean, median, sample deviation, least and most of a value."""
    return df.groupBy(*group).agg(F.avg(value).alias("mean"), F.median(value).alias("median"), F.stddev_samp(value).alias("std"), F.min(value).alias("least"), F.max(value).alias("most"))


def rank_points(metrics: dict[str, DataFrame], top_n: int = 10) -> DataFrame:
    """id, points, appearances: each metric's best top_n rows (id, value) give top_n + 1 - rank points."""
    parts = []
    for name, df in sorted(metrics.items()):
        best = df.orderBy(F.desc("value"), "id").limit(top_n)
        ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("value"), "id")))  # over top_n rows
        parts.append(ranked.select("id", F.lit(name).alias("metric"), (F.lit(top_n + 1) - F.col("rank")).alias("points")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("id").agg(F.sum("points").alias("points"), F.count("*").alias("appearances"))


def category_map(sources: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(map, discrepancies) of id, category tables: the first source that has an id wins; others that differ are listed."""
    every = None
    for i, s in enumerate(sources):
        part = s.select("id", "category", F.lit(i).alias("_source"))
        every = part if every is None else every.unionByName(part)
    best = every.groupBy("id").agg(F.min_by("category", "_source").alias("category"))
    other = every.join(best.withColumnRenamed("category", "kept"), "id").where("category <> kept").select("id", "kept", "category").distinct()
    return best, other


def unknown_target(category: Column, target: Column) -> Column:
    return F.coalesce(category, F.when(target.startswith("RU"), "Unknown RU").when(target.startswith("FF"), "Unknown FF").otherwise("Unknown"))


def category_references(edges: DataFrame, categories: DataFrame) -> DataFrame:
    """src_cat, dst_cat, n: references (src, dst) between categories (id, category); unknown targets are bucketed by prefix."""
    a, b = categories.select(F.col("id").alias("src"), F.col("category").alias("src_cat")), categories.select(F.col("id").alias("dst"), F.col("category").alias("dst_known"))
    joined = edges.join(a, "src").join(b, "dst", "left").withColumn("dst_cat", unknown_target(F.col("dst_known"), F.col("dst").cast("string")))
    return joined.groupBy("src_cat", "dst_cat").agg(F.count("*").alias("n"))


def category_metrics(references: DataFrame) -> DataFrame:
    """Per source category: total, internal, external, percent internal, and the external target with most references (ties: the first name)."""
    inside = F.col("src_cat") == F.col("dst_cat")
    out = F.when(~inside, F.struct(-F.col("n"), F.col("dst_cat")))
    return references.groupBy("src_cat").agg(
        F.sum("n").alias("total"), F.sum(F.when(inside, F.col("n")).otherwise(0)).alias("internal"), F.sum(F.when(~inside, F.col("n")).otherwise(0)).alias("external"), F.min(out).alias("_best")
    ).select("src_cat", "total", "internal", "external", F.round(100.0 * F.col("internal") / F.col("total"), 6).alias("pct_internal"), F.col("_best.dst_cat").alias("top_external"))


def circle(df: DataFrame, order: str) -> DataFrame:
    """df with x, y of a circular layout in the given order. For tables of categories."""
    place = F.row_number().over(Window.orderBy(order)) - 1
    angle = 2 * F.pi() * place / F.count("*").over(Window.partitionBy())
    return df.withColumn("x", F.cos(angle)).withColumn("y", F.sin(angle))


def multilabel_f1(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row micro, macro from (id, label) tables of true and predicted labels."""
    t, p = truth.distinct().withColumn("t", F.lit(1)), predicted.distinct().withColumn("p", F.lit(1))
    by_label = t.join(p, ["id", "label"], "full_outer").fillna(0, ["t", "p"]).groupBy("label").agg(F.sum(F.col("t") * F.col("p")).alias("tp"), F.sum((1 - F.col("t")) * F.col("p")).alias("fp"), F.sum(F.col("t") * (1 - F.col("p"))).alias("fn"))
    f1 = lambda tp, fp, fn: F.when(2 * tp + fp + fn > 0, 2.0 * tp / (2 * tp + fp + fn)).otherwise(0.0)
    return by_label.agg(f1(F.sum("tp"), F.sum("fp"), F.sum("fn")).alias("micro"), F.avg(f1(F.col("tp"), F.col("fp"), F.col("fn"))).alias("macro"))


def tfidf(tokens: DataFrame, vocabulary: int = 1000) -> DataFrame:
    """id, term, weight: tf * (ln((1 + n) / (1 + df)) + 1), each id's weights of length 1, over the most frequent terms. tokens: id, term."""
    counts = durable(tokens.groupBy("id", "term").agg(F.count("*").alias("tf")))  # read three times
    terms = counts.groupBy("term").agg(F.sum("tf").alias("all"), F.count("*").alias("df")).orderBy(F.desc("all"), "term").limit(vocabulary)
    n = F.broadcast(counts.agg(F.countDistinct("id").alias("n")))  # one row
    weighed = counts.join(F.broadcast(terms), "term").join(n).withColumn("raw", F.col("tf") * (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0))  # at most `vocabulary` terms
    norm = weighed.groupBy("id").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return weighed.join(norm, "id").select("id", "term", (F.col("raw") / F.col("norm")).alias("weight"))


def mmr(df: DataFrame, query: list[float], k: int = 5, diversity: float = 0.5, group: str = "label", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """group, rank, key: per group k rows by maximal marginal relevance to `query`, from all its rows.

    A round picks one row of each group: the best by (1 - diversity) * nearness - diversity * the greatest similarity
    to the rows picked before; ties go to the nearer row, then to the least key. A null group is a group; rows without
    a vector of the query's length can't be ranked.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    v = F.col(vector).cast("array<double>")
    # Written once, so that a row keeps its number through the rounds; equal rows are told apart by it.
    rows = durable(df.select(F.col(group).alias("_group"), F.col(key).alias("_key"), F.col(vector).alias("_vector"), dot(v, q).alias("_near")).where("_near is not null").withColumn("_row", F.monotonically_increasing_id()))
    v, picks = F.col("_vector").cast("array<double>"), None
    for rank in range(1, k + 1):
        scored = rows.withColumn("_score", F.col("_near"))
        if picks is not None:
            # At most k rows a group.
            chosen = picks.groupBy(F.col("_group").alias("_of")).agg(F.collect_list("_row").alias("_rows"), F.collect_list(F.col("_vector").cast("array<double>")).alias("_vectors"))
            like = F.array_max(F.transform("_vectors", lambda c: dot(v, c)))
            left = rows.join(chosen, F.col("_group").eqNullSafe(F.col("_of"))).where(~F.array_contains("_rows", F.col("_row")))
            scored = left.withColumn("_score", (1 - diversity) * F.col("_near") - diversity * like)
        best = scored.groupBy("_group").agg(F.min(F.struct((-F.col("_score")).alias("score"), (-F.col("_near")).alias("near"), "_key", "_vector", "_row")).alias("_best"))
        found = durable(best.select("_group", F.lit(rank).alias("_rank"), "_best._key", "_best._vector", "_best._row"))
        picks = found if picks is None else picks.unionByName(found)
    return picks.select(F.col("_group").alias(group), F.col("_rank").alias("rank"), F.col("_key").alias(key))
