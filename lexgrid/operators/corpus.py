"""Text statistics of a corpus (lang, folder, file, section_no, text) and their roll-up, accuracy against a second source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrid.functions import text as T


def section_metrics(sections: DataFrame) -> DataFrame:
    """Per section: words, sentences, characters, mean and median lengths, type-token ratio, readability by language."""
    w, s = T.words(F.col("text")), T.sentences(F.col("text"))
    rows = sections.withColumn("_w", w).withColumn("_n", F.size(s).cast("long")).withColumn("n_words", F.size("_w").cast("long"))
    chars = F.length("text").cast("double")
    solid = F.aggregate("_w", F.lit(0), lambda a, x: a + F.length(x)).cast("double")
    lengths = F.transform("_w", lambda x: F.length(x).cast("double"))
    nw, ns = F.col("n_words").cast("double"), F.col("_n").cast("double")
    readable = F.when(F.col("lang") == "fr", T.readability_fr(solid, nw, ns)).when(F.col("lang") == "de", T.readability_de(solid, nw, ns)).otherwise(T.gulpease(chars, nw, ns))
    return rows.select(
        *sections.columns, "n_words", F.col("_n").alias("n_sentences"), F.length("text").cast("long").alias("n_characters"), T.mean(lengths).alias("word_length"), T.median(lengths).alias("median_length"),
        T.deviation(lengths).alias("length_std"), T.type_token_ratio(F.col("_w")).alias("ttr"), readable.alias("readability"), F.size(F.array_distinct(F.transform("_w", F.lower))).cast("long").alias("n_types"),
    )


def strict_metrics(sections: DataFrame) -> DataFrame:
    """Second variant: rows without words or sentences are left out instead of counting as zeros."""
    m = section_metrics(sections).where("n_words > 0 and n_sentences > 0")
    return m.select("lang", "n_words", "n_sentences", (F.col("n_characters") / F.col("n_words")).alias("chars_per_word"), (F.col("n_words") / F.col("n_sentences")).alias("words_per_sentence"), "ttr")


def roll_up(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Levels from sections up along `keys` (language, folder, file): counts add up, means are means of the level below.

    Medians are medians of medians, the ratio is recomputed from summed types and words; rows without words are left
    out. One row for each node of each level, with its depth.
    """
    level = metrics.where("n_words > 0").select(*keys, "n_words", "n_sentences", "n_types", "word_length", "median_length", "readability")
    out = None
    for depth in range(len(keys), 0, -1):
        k = keys[:depth]
        level = level.groupBy(*k).agg(*[F.sum(c).alias(c) for c in ("n_words", "n_sentences", "n_types")], F.avg("word_length").alias("word_length"), F.median("median_length").alias("median_length"), F.avg("readability").alias("readability"))
        part = level.select(F.lit(depth).alias("depth"), *[(F.col(c) if c in k else F.lit(None).cast("string")).cast("string").alias(c) for c in keys], "n_words", "n_sentences", (F.col("n_types") / F.col("n_words")).alias("ttr"), "word_length", "median_length", "readability")
        out = part if out is None else out.unionByName(part)
    return out


def map_sum(df: DataFrame, group: list[str], column: str) -> DataFrame:
    """group, map: maps of counts added up by key."""
    sums = df.select(*group, F.explode(column).alias("k", "v")).groupBy(*group, "k").agg(F.sum("v").alias("v"))
    return sums.groupBy(*group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias(column))


def overlap(golden: DataFrame, found: DataFrame, doc: str = "doc", item: str = "item", folder: str = "folder") -> DataFrame:
    """folder, doc, n_golden, n_found: distinct golden items (folder, doc, item) and those the other source has too."""
    g, f = golden.select(folder, doc, item).distinct(), found.select(doc, item).distinct().withColumn("_hit", F.lit(1))
    return g.join(f, [doc, item], "left").groupBy(folder, doc).agg(F.count(item).alias("n_golden"), F.count("_hit").alias("n_found"))


def overlap_totals(pairs: DataFrame, folder: str = "folder") -> DataFrame:
    """Per folder and in all (folder null): sums and percent found; a folder without golden items counts as 100."""
    return pairs.rollup(folder).agg(F.sum("n_golden").alias("n_golden"), F.sum("n_found").alias("n_found")).withColumn("pct", F.when(F.col("n_golden") > 0, F.round(100.0 * F.col("n_found") / F.col("n_golden"), 6)).otherwise(100.0))


def section_score(golden: Column, found: Column) -> Column:
    """Sections are scored by number, capped at the golden number; none expected counts as 0."""
    return F.when(golden > 0, F.least(golden, found) / golden).otherwise(0.0)


def match_languages(corpora: DataFrame, folders: DataFrame) -> DataFrame:
    """key, file, and one text a language: documents of one file in folders that mean the same. folders: lang, folder, key."""
    one = corpora.join(folders, ["lang", "folder"]).groupBy("key", "file", "lang").agg(F.min("folder").alias("folder"))
    return one.groupBy("key", "file").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("lang", "folder")))).alias("by_lang")).where(F.size("by_lang") > 1)


def phrase_counts(df: DataFrame, key: str, phrases: str, n: int = 2) -> DataFrame:
    """key, place, phrase, n: each key's most frequent phrases; of equal ones the first seen."""
    from lexgrid.operators.tables import top_per_group

    seen = df.select(key, F.posexplode(phrases).alias("at", "phrase")).groupBy(key, "phrase").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    return top_per_group(seen, [key], n, F.desc("n"), F.col("at")).select(key, F.col("rank").alias("place"), "phrase", "n")


def word_frequencies(df: DataFrame, group: str, text: str, stop: DataFrame) -> DataFrame:
    """group, word, n without the stop words (one column `word`)."""
    return df.select(group, F.explode(T.words(F.lower(text))).alias("word")).join(stop, "word", "left_anti").groupBy(group, "word").agg(F.count("*").alias("n"))
