"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.llm._common import SPACE, materialize

#: Partitions by size: documents of up to 2**p shingles share partition p; longer ones share the last.
LAST_PARTITION = 26
#: Items of so many shingles or fewer are looked up shingle by shingle: MinHash misses longer ones with probability 0.37**10 at most.
FEW_SHINGLES = 9
#: Item signature rows, or candidate documents, up to which a side is broadcast (at most about 40 bytes each).
BROADCAST_ROWS = 1_000_000


def words_of(text: Column) -> Column:
    """Lower-cased words; none for a null text."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE), lambda w: w != "")


def _shingle_hashes(width: int) -> Column:
    """Hashes of the shingles of the column ``hashes``, the hashes of a text's words."""
    h = F.col("hashes")
    at = F.sequence(F.lit(0), F.size(h) - width)
    return F.when(F.size(h) >= width, F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))).otherwise(F.array().cast("array<bigint>"))


def _signed(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, p, h): one-permutation MinHash with 2**p bins of the column ``s``.

    Of the sorted hashes, the least of each run with equal p leading bits. The sorted array is a column of its own, so
    that it is sorted once.
    """
    ordered = rows.select(*keys, "p", F.sort_array("s").alias("o"))
    o, shift = F.col("o"), F.lit(64) - F.col("p")
    bin_of = lambda x: F.call_function("shiftrightunsigned", x, shift)
    least = F.filter(o, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(o, i - 1))))
    # explode() would add a filter on the array's size, pushed below the columns that make it and evaluated per element
    return ordered.select(*keys, "p", least.alias("least")).select(*keys, "p", F.explode_outer("least").alias("h")).where("h is not null")


def _sized(rows: int, df: DataFrame) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def find_contaminated(documents: DataFrame, benchmark: DataFrame, *, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shared, n_item) for every item of which a document holds ``percent`` % or more of the shingles.

    A shingle is ``width`` consecutive lower-cased words; an item of fewer words is one shingle, its whole sequence.
    Documents are partitioned by their number of shingles; partition p signs a text with 2**p bins, so a document's own
    shingle is the least of its bin with probability 0.63 or more whatever the lengths, and one equal bin makes a candidate.
    An item with s shared shingles is missed with probability 0.37**s at most, so items of FEW_SHINGLES or fewer are looked up
    by all their shingles besides, which misses none. Candidates are verified on the words themselves.

    Items without words and null texts match nothing. Null ids take part as one document, or item, with id null; so do rows
    that repeat an id. Empty tables give no rows. Other columns are not read.
    """
    items = benchmark.select(F.col(item_col).alias("item"), words_of(F.col(item_text)).alias("words")).where(F.size("words") > 0)
    items = items.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w))).withColumn("w", F.least(F.size("hashes"), F.lit(width)))
    level = F.explode(F.sequence(F.lit(1), F.lit(LAST_PARTITION))).alias("p")
    signed = materialize(_signed(items.where(F.col("w") == width).select(_shingle_hashes(width).alias("s"), level)).distinct(), "item-signatures")
    n_signed = signed.count()
    # one array per width, so that each is one expression
    probes = [items.where(F.col("w") == k).select("w", F.array_distinct(_shingle_hashes(k)).alias("s")) for k in range(1, width + 1)]
    few = probes[0]
    for more in probes[1:]:
        few = few.union(more)
    few = materialize(few.where(F.size("s") <= FEW_SHINGLES).select("w", F.explode("s").alias("h")).distinct(), "few-shingles")
    widths = sorted(r.w for r in few.select("w").distinct().collect())

    texts = documents.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    hashed = texts.select("doc", F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("hashes"))
    shingled = hashed.select("doc", _shingle_hashes(width).alias("s"))
    partition = F.least(F.lit(LAST_PARTITION), F.greatest(F.lit(1), F.ceil(F.log2(F.size("s").cast("double"))).cast("int")))
    found = _signed(shingled.withColumn("p", partition), "doc").join(_sized(n_signed, signed), ["p", "h"], "left_semi").select("doc")
    for k in widths:
        each = hashed.select("doc", F.explode_outer(_shingle_hashes(k)).alias("h")).where("h is not null")
        found = found.union(each.join(_sized(few.count(), few.where(F.col("w") == k).select("h")), "h", "left_semi").select("doc"))
    candidates = materialize(found.distinct(), "candidates")

    chosen = candidates.select(F.col("doc").alias("chosen"))
    near = texts.join(_sized(candidates.count(), chosen), F.col("doc").eqNullSafe(F.col("chosen")), "left_semi")
    spelled = lambda k: F.transform(F.sequence(F.lit(1), F.size("words") - k + 1), lambda i: F.concat_ws(" ", F.slice("words", i, k)))
    none = F.array().cast("array<string>")
    in_items = items.select("item", F.explode(F.when(F.size("words") < width, F.array(F.concat_ws(" ", "words"))).otherwise(spelled(width))).alias("shingle"))
    in_items = materialize(in_items.distinct(), "item-shingles")
    sizes = in_items.groupBy("item").agg(F.count("*").alias("n_item"))
    in_docs = near.select("doc", words_of(F.col("text")).alias("words"))
    of_doc = F.concat(*[F.when(F.size("words") >= k, spelled(k)).otherwise(none) for k in sorted({*widths, width})])
    in_docs = in_docs.select("doc", F.explode_outer(of_doc).alias("shingle")).where("shingle is not null")
    # most shingles are in no item: the join comes before they are made distinct
    shared = in_docs.join(_sized(in_items.count(), in_items), "shingle").distinct().groupBy("doc", "item").agg(F.count("*").alias("n_shared"))
    held = shared.join(sizes.withColumnRenamed("item", "of"), F.col("item").eqNullSafe(F.col("of")))
    return held.where(100 * F.col("n_shared") >= percent * F.col("n_item")).select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "n_shared", "n_item")


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, with all their columns, that hold no item. Each row's own text decides, also where ids repeat or are null.

    Null and empty texts hold none and stay; an empty benchmark drops nothing; an empty table gives no rows.
    """
    row = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text"))
    rows = documents.select(row.alias("__lf_row"), text_col)
    found = find_contaminated(rows, benchmark, id_col="__lf_row", text_col=text_col, **options).select(F.col("__lf_row").alias("__lf_found")).distinct()
    found = materialize(found, "contaminated")
    return documents.join(_sized(found.count(), found), row.eqNullSafe(F.col("__lf_found")), "left_anti")
