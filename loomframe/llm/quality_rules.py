"""Quality rules: base rules, then a length-normalised hashed n-gram log-likelihood ratio."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.llm._common import SPACE

#: Hash buckets of each multinomial; fixed, so the table of ratios has a fixed size.
BUCKETS = 1 << 16
#: Added to every bucket's count.
SMOOTHING = 0.5
#: A document is kept if its mean log ratio per n-gram is this or more.
THRESHOLD = -0.25
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5


def _base(documents: DataFrame, doc: Column, text_col: str) -> DataFrame:
    """(doc, hashes, grams, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) for each row.

    Arrays that a later expression reads element by element are columns of their own, so that they are computed once.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = documents.select(
        doc.alias("doc"),
        F.filter(F.split(text, SPACE), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        (F.size(F.split(text, SYMBOLS)) - 1).cast("long").alias("n_symbols"),
    )
    rows = rows.select("*", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"), F.length(F.array_join("words", "")).cast("long").alias("word_chars")).drop("words")
    h, n, none = F.col("hashes"), F.size("hashes"), F.array().cast("array<bigint>")
    pairs = F.when(n >= 2, F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1)))).otherwise(none)
    rows = rows.select("*", n.cast("long").alias("n_words"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), pairs.alias("pairs")).drop("lines")
    # five words are two pairs and a word
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(F.get("pairs", i), F.get("pairs", i + 2), F.get(h, i + 4)))).otherwise(none)
    rows = rows.select("*", windows.alias("windows"), F.concat(h, "pairs").alias("grams")).drop("hashes", "pairs")
    rows = rows.withColumn("placed", _placed(F.col("windows"))).withColumn("n_repeat_words", _repeated_words(F.col("placed")))
    return rows.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).drop("windows", "placed")


def _placed(w: Column) -> Column:
    """The windows (hash, place) in order; none where all differ."""
    again = F.size(F.array_distinct(w)) < F.size(w)
    return F.when(again, F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i"))))).otherwise(F.array().cast("array<struct<w:bigint,i:int>>"))


def _repeated_words(placed: Column) -> Column:
    """Words in five-word windows that the text has twice or more, each word counted once."""
    # in order of hash, a window that occurs again has an equal neighbour
    again = F.filter(placed, lambda x, i: (x["w"] == F.get(placed, i - 1)["w"]) | (x["w"] == F.get(placed, i + 1)["w"]))
    return F.aggregate(
        F.sort_array(F.transform(again, lambda x: x["i"])),
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("bigint").alias("n")),
        lambda acc, x: F.struct(x.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), x - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )


def log_ratios(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> list[float]:
    """log(p_target / p_raw) per bucket: raw are all documents, target those without a mark against them.

    A document is trusted if it passes the base rules, repeats no line and no five-word window and has no symbol.
    All documents count, whole; what reaches the driver are the ``buckets`` counts.
    """
    rows = _base(documents, F.col(id_col), text_col)
    trusted = ~F.col("base_failed") & (F.col("n_repeat_words") == 0) & (F.col("n_dup_lines") == 0) & (F.col("n_symbols") == 0)
    # explode() would add a filter on the array's size, pushed below the columns that make it and evaluated per element
    grams = rows.select(trusted.cast("long").alias("t"), "grams").select("t", F.explode_outer("grams").alias("g")).where("g is not null")
    counted = grams.groupBy(F.pmod("g", F.lit(buckets)).alias("b")).agg(F.count("*").alias("raw"), F.sum("t").alias("target")).collect()
    raw, target = [SMOOTHING] * buckets, [SMOOTHING] * buckets
    for b, r, t in counted:
        raw[b] += r
        target[b] += t
    shift = math.log(sum(raw)) - math.log(sum(target))
    return [math.log(t) - math.log(r) + shift for t, r in zip(target, raw)]


def _scored(documents: DataFrame, doc: Column, id_col: str, text_col: str, buckets: int) -> DataFrame:
    ratios = log_ratios(documents, id_col=id_col, text_col=text_col, buckets=buckets)
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")
    total = F.aggregate("grams", F.lit(0.0), lambda acc, g: acc + F.get(table, F.pmod(g, F.lit(buckets)).cast("int")))
    rows = _base(documents, doc, text_col)
    return rows.withColumn("score", F.when(F.size("grams") > 0, total / F.size("grams")).otherwise(F.lit(0.0))).drop("grams")


def judge_quality(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score.

    score: the mean over the text's words and pairs of words of log(p_target / p_raw) of their bucket; 0 without any.
    kept: not base_failed, and score >= threshold. A null text counts as an empty one, which fails the base rules. Rows
    that repeat an id, or have none, are judged each by its text. Empty input gives no rows. Only id and text are read.
    """
    rows = _scored(documents, F.col(id_col), id_col, text_col, buckets)
    kept = ~F.col("base_failed") & (F.col("score") >= threshold)
    return rows.select(F.col("doc").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "score")


def keep_good(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, that ``judge_quality`` keeps.

    Null, empty and wordless texts fail the base rules and go. Rows that repeat an id, or have none, are judged each by its
    text. Ties with the threshold stay. Empty input gives no rows; other columns pass through, whatever their names.
    """
    whole = F.struct(*[documents[c] for c in documents.columns])
    rows = _scored(documents, whole, id_col, text_col, buckets)
    kept = rows.select("doc", (~F.col("base_failed") & (F.col("score") >= threshold)).alias("kept"))
    # a filter on "kept" would be pushed below the columns that make it; one on a generated column stays above
    return kept.select("doc", F.explode_outer(F.array("kept")).alias("stays")).where("stays").select("doc.*")
