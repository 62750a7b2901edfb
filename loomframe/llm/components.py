"""Connected components of an edge table by alternating large-star and small-star rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm._common import discard, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) long edges -> (node, component): the smallest node that links reach; only nodes on an edge appear.

    Null ends and loops are ignored and repeated edges count once; no edges give no rows. Each round writes its edges
    to the shared folder, so lineage stays short and nothing but a row count and a checksum reaches the driver.
    """
    up = F.greatest("a", "b").alias("u")
    low = F.least("a", "b").alias("v")
    now = materialize(edges.where("a <> b").select(up, low).distinct(), "edges")
    before = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # minima are aggregated before any shuffle, and a join on a node of very many edges is split by AQE
        lowest = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(lowest, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.*")
            .where("u <> v")
            .distinct()
        )
        last, now = now, materialize(small, "edges")
        discard(last)
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            break
        before = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
