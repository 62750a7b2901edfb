"""Bounded training samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def labelled_texts(documents: DataFrame, labels: DataFrame, label_col: str, *, rows_per_class: int, max_bytes: int, held_out, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int]]:
    """At most ``rows_per_class`` (text, label) of each class 0 and 1, of at most ``max_bytes`` bytes, in order of an id hash.

    Rows that ``held_out`` (a condition on the id) marks, null labels and null texts are left out; an id with both labels
    counts as 1. Ids are drawn from the labels alone, so a document's text is read only if its id was drawn.
    """
    order = F.xxhash64("id")
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)").where(~held_out)
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    drawn = None
    for c in (0, 1):
        part = known.where(F.col("label") == c).orderBy(order, "id").limit(2 * rows_per_class)
        drawn = part if drawn is None else drawn.union(part)
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).between(1, max_bytes))
    # at most four times rows_per_class ids: broadcast by a parameter's bound
    found = texts.join(F.broadcast(drawn), "id").select("label", order.alias("h"), "id", "text").dropDuplicates(["id"])
    # a window over the few rows drawn
    place = F.row_number().over(Window.partitionBy("label").orderBy("h", "id"))
    rows = found.withColumn("place", place).where(F.col("place") <= rows_per_class).orderBy("label", "place").collect()
    return [(r.text, r.label) for r in rows]
