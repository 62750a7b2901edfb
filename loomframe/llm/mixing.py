"""Mix sources to target weights by systematic sampling."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomframe.llm._common import SPACE
from loomframe.llm._order import running

#: Weights of the sources in order of code point, repeated; null comes last.
WEIGHTS = (3, 1, 2)


def count_words(text) -> F.Column:
    """Number of maximal runs of characters other than space and 0x09-0x0D; 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(text, SPACE), lambda w: w != "")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...], percent: int, most: int) -> DataFrame:
    """(source, size) -> (source, source_size, target).

    All targets make up ``percent`` % of all sizes by weight; none is above ``most`` times its source's size, and what
    it would have had beyond goes to the others by weight. That is the level L with target = min(most * size, L * weight):
    sources in order of most * size / weight are full up to some place, and the rest shares what is left.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("n") - 1) % len(weights) + 1).cast("int"))
    one = Window.partitionBy(F.lit(0))
    # sources, not documents, meet in this window
    table = sources.withColumn("n", F.row_number().over(one.orderBy(F.col("source").asc_nulls_last()))).withColumn("weight", weight)
    table = table.withColumn("cap", (F.col("source_size") * most).cast("double"))
    by_fill = one.orderBy(F.col("cap") / F.col("weight"), "n")
    earlier = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    budget = F.sum("source_size").over(one) * percent / 100.0
    full = F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))
    left = F.sum("weight").over(by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    table = table.withColumn("level", (budget - full) / left)
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    table = table.withColumn("water", F.first(fits, ignorenulls=True).over(by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("water") * F.col("weight")))
    return table.select("source", "source_size", target.alias("target"))


def offset(seed: int) -> float:
    """The one random offset, in (0, 1)."""
    return random.Random(seed).uniform(0.001, 0.999)


def plan_mix(documents: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, percent: int = 150, most: int = 2, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: (doc_id, size, source_size, target, taken, copies, key).

    size: words of the text, 0 for null or empty. A document's expected copies are its source's target over its size, at
    most ``most``. Within a source, in order of (size, id, text hash), a document is taken once per whole number between
    the sums of expected copies before and after it, shifted by one random offset fixed by ``seed``; the order by size
    keeps the words taken close to the target. Reruns agree; rows equal in all three are interchangeable. A null source
    is a source. A source without words has target 0 and gives nothing. Empty input gives no rows.
    """
    narrow = documents.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        count_words(F.col(text_col)).alias("size"),
        F.xxhash64(F.col(id_col), F.col(source_col), F.col(text_col)).alias("key"),
    )
    placed = running(narrow, ["source"], ["size", "id", "key"], "size", "mix-order")
    # grouped from what is written, so texts are read once
    targets = source_targets(placed.select("source", "size"), weights, percent, most)
    targets = targets.withColumnRenamed("source", "of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = placed.join(targets, placed["source"].eqNullSafe(targets["of"])).withColumn("rate", rate)
    u = F.lit(offset(seed))
    copies = F.floor(F.col("rank") * F.col("rate") + u) - F.floor((F.col("rank") - 1) * F.col("rate") + u)
    joined = joined.withColumn("copies", copies)
    return joined.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "key")


def mix_sources(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents, with all their columns, each as often as ``plan_mix`` takes it.

    Equal rows share the copies planned for all of them. Documents without words are taken as often as their place among
    the documents of their source says; a source without words gives nothing. Null sources and ids take part like others.
    Empty input gives no rows.
    """
    plan = plan_mix(documents, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    # equal rows have one key: they share the copies that the plan has for all of them
    plan = plan.groupBy(F.col("key").alias("__lf_key")).agg(F.sum("copies").alias("__lf_all"), F.count("*").alias("__lf_of")).where("__lf_all > 0")
    keyed = documents.withColumn("__lf_at", F.xxhash64(F.col(id_col), F.col(source_col), F.col(text_col)))
    own = keyed.join(plan, F.col("__lf_at") == F.col("__lf_key"))
    place = F.row_number().over(Window.partitionBy("__lf_key").orderBy(id_col))
    times = own.withColumn("__lf_n", place).withColumn("__lf_times", F.expr("(__lf_all * __lf_n) div __lf_of - (__lf_all * (__lf_n - 1)) div __lf_of").cast("int"))
    emitted = times.where("__lf_times > 0").withColumn("__lf_copy", F.explode(F.sequence(F.lit(1), F.col("__lf_times"))))
    return emitted.select(*[documents[c] for c in documents.columns])
