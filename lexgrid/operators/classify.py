"""Classification of citations and documents through a predictor protocol: any callable from texts to labels.

The default is a rule on words. It stands in for a trained model and doesn't claim its accuracy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexgrid.functions import dates, ids
from lexgrid.functions import text as T

Predictor = Callable[[], Callable[[list[str]], list[str]]]


def keyword_predictor() -> Callable[[list[str]], list[str]]:
    """Loads nothing; a real one would load its model here, once a worker."""
    rules = (("ABROGATES", ("abrog", "aufgehoben")), ("AMENDS", ("modific", "änder", "modifi")), ("INTRODUCES", ("introdo", "eingefügt", "introdui")))

    def predict(texts: list[str]) -> list[str]:
        return [next((label for label, words in rules if any(w in t for w in words)), "CITES") for t in map(str.lower, texts)]

    return predict


def predict(df: DataFrame, text: str, predictor: Predictor = keyword_predictor, out: str = "label") -> DataFrame:
    """df with the predictor's label; the predictor is made once a worker, and its errors fail the job.

    Marked as not deterministic, so that a filter on the label doesn't ask for it once more.
    """

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = predictor()
        for part in parts:
            yield pd.Series(model(part.fillna("").tolist()))

    return df.withColumn(out, run.asNondeterministic()(F.col(text)))


def prompts(sections: DataFrame, refs: DataFrame, decided: DataFrame, window: int = 200) -> DataFrame:
    """doc, marker, fn, target, prompt: for each section's footnote the first reference of that number, its date and context.

    sections: doc, marker, text, fn_indexes; refs: doc, place, fn_number, type, text; decided: code, decision_date.
    """
    notes = sections.select("doc", "marker", "text", F.explode("fn_indexes").alias("fn"))
    first = refs.where("fn_number is not null").withColumn("_n", F.row_number().over(Window.partitionBy("doc", "fn_number").orderBy("place"))).where("_n = 1")
    first = first.select("doc", F.col("fn_number").cast("int").alias("fn"), ids.canonical(F.col("type"), F.col("text")).alias("target"))
    dated = decided.groupBy(F.col("code").alias("target")).agg(F.min("decision_date").alias("decision_date"))
    rows = notes.join(first, ["doc", "fn"]).join(dated, "target", "left")
    around = T.context(F.col("text"), F.concat(F.lit("[FN_"), F.col("fn"), F.lit("]")), window)
    return rows.select("doc", "marker", "fn", "target", F.concat_ws("\n", dates.italian(F.col("decision_date")), around).alias("prompt"))


def label_maps(classified: DataFrame) -> DataFrame:
    """doc, marker, fn_labels: the labels of a section's footnotes as a map."""
    entry = F.struct(F.col("fn").cast("string"), F.col("label"))
    return classified.groupBy("doc", "marker").agg(F.map_from_entries(F.array_sort(F.collect_set(entry))).alias("fn_labels"))


def citations(labelled: DataFrame, refs: DataFrame) -> DataFrame:
    """src, rel_type, dst: every reference of a labelled footnote; labels outside the domain give no edge."""
    notes = labelled.select("doc", ids.section_id(F.col("doc"), F.col("marker")).alias("src"), F.explode("fn_labels").alias("fn", "rel_type")).where(ids.valid_label(F.col("rel_type")))
    given = refs.select("doc", F.col("fn_number").alias("fn"), ids.canonical(F.col("type"), F.col("text")).alias("dst"))
    return notes.join(given, ["doc", "fn"]).select("src", "rel_type", "dst").distinct()


def cited(acts: DataFrame, decided: DataFrame, predictor: Predictor = keyword_predictor, window: int = 200) -> DataFrame:
    """src, rel_type, dst: what citations(label_maps(predict(prompts(..))), refs) gives, from whole acts; labels outside the domain give no edge.

    Where sections of a marker repeat a number with other labels, each label gives edges (a map of labels can't hold both and fails).

    acts: doc, sections (array of marker, text, fn_indexes), references (array of place, fn_number, type, text); decided:
    code, decision_date. Notes and references of a number meet in a window within their act: nothing is joined to an act, and no
    text is shuffled where acts are dealt by doc.
    """
    place = acts.schema["references"].dataType.elementType["place"].dataType
    none = lambda kind: F.lit(None).cast(kind)
    note = lambda s, fn: F.struct(fn.cast("int").alias("fn"), F.lit(True).alias("is_note"), s["marker"].alias("marker"), s["text"].alias("text"), none(place).alias("place"), none("string").alias("number"), none("string").alias("type"))
    notes = F.flatten(F.filter(F.transform("sections", lambda s: F.transform(s["fn_indexes"], lambda fn: note(s, fn))), lambda x: x.isNotNull()))
    given = F.transform("references", lambda r: F.struct(r["fn_number"].try_cast("int").alias("fn"), F.lit(False).alias("is_note"), none("string").alias("marker"), r["text"].alias("text"), r["place"].alias("place"), r["fn_number"].alias("number"), r["type"].alias("type")))
    rows = acts.select("doc", F.explode(F.concat(F.coalesce(notes, F.array()), F.coalesce(given, F.array()))).alias("e")).select("doc", "e.*").where("fn is not null")
    mark = F.concat(F.lit("[FN_"), F.col("fn"), F.lit("]"))
    section = F.when(F.col("is_note"), F.struct(ids.section_id(F.col("doc").cast("string"), F.col("marker")).alias("src"), T.context(F.col("text"), mark, window).alias("around")))
    code = F.when(~F.col("is_note"), ids.canonical(F.col("type"), F.col("text")))
    rows = rows.select("doc", "fn", section.alias("section"), code.alias("code"), "place", (F.col("number") == F.col("fn").cast("string")).alias("exact"))
    # Of the references of a number the first by place gives the prompt its date, and all of them get edges.
    within = Window.partitionBy("doc", "fn")
    first = F.min(F.when(F.col("section").isNull(), F.struct("place", F.col("code").alias("target")))).over(within)
    met = rows.select("section", first.alias("first"), F.collect_set(F.when(F.col("exact"), F.col("code"))).over(within).alias("given"))
    met = met.where("section is not null and first is not null").select("first.target", "given", "section.src", "section.around")
    dated = decided.groupBy(F.col("code").alias("target")).agg(F.min("decision_date").alias("decision_date"))
    asked = met.join(dated, "target", "left").select("src", "given", F.concat_ws("\n", dates.italian(F.col("decision_date")), F.col("around")).alias("prompt"))
    return predict(asked, "prompt", predictor, "rel_type").where(ids.valid_label(F.col("rel_type"))).select("src", "rel_type", F.explode("given").alias("dst")).distinct()


def train_topics(rows: DataFrame, text: str, label: str, features: int = 4096):
    """One-vs-rest logistic regression over hashed words; the stand-in for a fine-tuned model."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression, OneVsRest
    from pyspark.ml.feature import HashingTF, IDF, StringIndexer, Tokenizer

    steps = [StringIndexer(inputCol=label, outputCol="_y"), Tokenizer(inputCol=text, outputCol="_w"), HashingTF(inputCol="_w", outputCol="_tf", numFeatures=features), IDF(inputCol="_tf", outputCol="_x")]
    return Pipeline(stages=[*steps, OneVsRest(classifier=LogisticRegression(maxIter=10), featuresCol="_x", labelCol="_y")]).fit(rows)
