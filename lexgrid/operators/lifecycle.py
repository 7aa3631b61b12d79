"""Amendment timelines: event types, order, dedupe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def event_type(process_uri: Column, label: Column) -> Column:
    """The event's type by the last part of its process URI, or by its label where there is no URI."""
    tail = F.lower(F.element_at(F.split(process_uri, "/"), -1))
    return (
        F.when(tail.rlike("scope|geltungsbereich"), "Campo d'applicazione")
        .when(tail.rlike("repeal|abrogation|aufhebung"), "Abrogazione")
        .when(process_uri.isNull() & label.rlike("Abrogazione|Aufhebung|Abrogation"), "Abrogazione")
        .otherwise("Modifica")
    )


EVENT = ("type", "date", "decision_date", "source_label", "source_uri")


def timeline(events: DataFrame, key: str) -> DataFrame:
    """Distinct events of each key with their place: latest first by date, then decision date; nulls last."""
    distinct = events.select(key, *EVENT).dropDuplicates()
    order = [F.desc_nulls_last("date"), F.desc_nulls_last("decision_date"), *[F.col(c).asc_nulls_first() for c in ("type", "source_label", "source_uri")]]
    return distinct.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def nested(ordered: DataFrame, key: str) -> DataFrame:
    """key, events: the ordered list of a timeline. A key's own events only, as many as its law has amendments."""
    return ordered.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", *EVENT))), lambda e: e.dropFields("place")).alias("events"))
