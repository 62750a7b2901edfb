"""A corpus pipeline over ``documents``: rules, near copies, decontamination, mixing, shards.

Stages take any table with the columns of ``documents``; further columns pass through all but the last stage, whatever
their names. Empty tables give empty tables. Rows that repeat an id are judged each by their own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomframe.llm._common import materialize, read_table
from loomframe.llm.decontamination import drop_contaminated
from loomframe.llm.jaccard_join import keep_one_per_class
from loomframe.llm.mixing import mix_sources
from loomframe.llm.quality_rules import keep_good
from loomframe.llm.sharding import assign_shards


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep; null, empty and wordless texts go. A tie with the threshold stays."""
    return keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of five-word shingle similarity 0.8 or more: its smallest id, of equal rows one.

    Texts without words, and rows without an id, are in no class and stay.
    """
    return keep_one_per_class(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none, and an empty benchmark drops nothing."""
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; null is a source like others, and ties in size go by id."""
    return mix_sources(docs, seed=7)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and place of each row; null ids come first, null texts have no bytes, equal rows are interchangeable."""
    return assign_shards(docs, 40)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_copies", near_copies),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: The second stage's classes and the first stage's hashes are not expressible.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
