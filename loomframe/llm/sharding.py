"""Contiguous shards of equal bytes, cut from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm._order import running

#: Bytes that a document takes besides its text.
OVERHEAD = 16


def _sharded(documents: DataFrame, shards: int, id_col: str, text_col: str, *carried: str) -> DataFrame:
    """(id, size, crc, shard, slot, and the columns ``carried``) of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = documents.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text).cast("long") + OVERHEAD).alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.xxhash64(text).alias("hash"),
        *[F.col(c).alias("carried_" + c) for c in carried],
    )
    placed = running(narrow, [], ["hash", "id"], "size", "shard-order")
    total = placed.agg(F.sum("size").alias("total"))
    # one row: the total of all bytes
    cut = F.expr(f"least({shards - 1}, ((2 * before + size) * {shards}) div (2 * total))").cast("int")
    sharded = placed.join(F.broadcast(total)).withColumn("shard", cut)
    first = sharded.groupBy("shard").agg(F.min("rank").alias("first"))
    return sharded.join(F.broadcast(first), "shard").withColumn("slot", F.col("rank") - F.col("first"))


def assign_shards(documents: DataFrame, shards: int = 40, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (doc_id, size, text_crc32, law, shard, slot, grown_shard).

    Documents stand in order of (text hash, id), so equal texts are neighbours and no source or time of arrival clusters.
    A document whose middle byte lies in the k-th of ``shards`` equal stretches of all bytes goes to shard k: sizes of
    shards differ from the mean by less than one document. ``slot`` counts from 0 within the shard. A null text has no
    bytes (size 16, crc32 0); a null id sorts first. Rows equal in id and text are interchangeable. Empty input: no rows.
    A document longer than a stretch leaves shards beside it empty. grown_shard is null: the law is ``bytes``.
    """
    return _sharded(documents, shards, id_col, text_col).select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(documents: DataFrame, path: str, shards: int = 40, *, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write (doc_id, text, slot) as Parquet under ``shard=N`` folders, rows in order of slot.

    Places are those of ``assign_shards``; texts travel with their rows, so equal rows, ties, null ids, null and empty texts
    are each written once. An empty table writes no shard.
    """
    placed = _sharded(documents, shards, id_col, text_col, text_col)
    rows = placed.select(F.col("id").alias(id_col), F.col("carried_" + text_col).alias(text_col), "shard", "slot")
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
