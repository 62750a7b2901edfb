"""Distributed ranks and running totals: range partitions, their totals, and sums within each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomframe.llm._common import materialize


def running(df: DataFrame, groups: list[str], by: list[str], weight: str, label: str) -> DataFrame:
    """Add ``rank`` (from 1) and ``before`` (sum of ``weight`` of earlier rows), within ``groups``, in order of ``by``.

    Rows are range-partitioned by groups and order, so a group of any size spreads over tasks; the partition of each row
    is written with it, and only one total per partition and group is added up by itself. Rows equal in ``by`` are
    ranked in an arbitrary order. Nulls come first and form their own group.
    """
    ranged = df.repartitionByRange(*groups, *by).withColumn("__part", F.spark_partition_id())
    ranged = materialize(ranged, label)
    mine = Window.partitionBy("__part", *groups)
    totals = ranged.groupBy("__part", *groups).agg(F.count("*").alias("__rows"), F.sum(weight).alias("__sum"))
    earlier = (Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("__part").alias("__p"),
        *[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)],
        F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__rank0"),
        F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before0"),
    )
    same = F.col("__part") == F.col("__p")
    for i, g in enumerate(groups):
        same &= F.col(g).eqNullSafe(F.col(f"__g{i}"))
    order = mine.orderBy(*by)
    local = ranged.withColumn("__rank", F.row_number().over(order)).withColumn("__upto", F.sum(weight).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = local.join(offsets, same)
    return out.select(*df.columns, (F.col("__rank0") + F.col("__rank")).alias("rank"), (F.col("__before0") + F.col("__upto") - F.col(weight)).alias("before"))
