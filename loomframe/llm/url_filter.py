"""URL filters: host and path rules first, then boosted trees on lexical features learnt from the URLs that rules label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.llm._common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host and path); a short list, as each rule is an expression.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Values of a feature after binning.
BINS = 16
TREES, DEPTH, RATE, LEAF_PENALTY = 8, 3, 0.4, 1.0


def split_url(pages: DataFrame, url_col: str) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a URL; both empty without ``://`` or for null."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """(rule, its verdict): the longest rule whose host is the URL's or above it and whose path starts the URL's; else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _lexical(rows: DataFrame) -> DataFrame:
    """Add ``suffix`` and ``lex``: binned length, depth, digit share, entropy and parameter counts of (url, host, path)."""
    url, host, path = F.col("url"), F.col("host"), F.col("path")
    rows = rows.withColumn("chars", F.filter(F.split(host, ""), lambda c: c != "")).withColumn("kinds", F.array_distinct("chars"))
    chars, n = F.col("chars"), F.greatest(F.size("chars"), F.lit(1))
    share = F.transform("kinds", lambda k: F.size(F.filter(chars, lambda c: c == k)) / n)
    entropy = F.aggregate(share, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))
    digits = F.length(url) - F.length(F.translate(url, "0123456789", ""))
    count = lambda text, c: F.length(text) - F.length(F.translate(text, c, ""))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    values = [
        F.length(url) / 8,
        F.length(host) / 3,
        F.length(path) / 3,
        count(path, "/"),
        digits * 3 * BINS / F.greatest(F.length(url), F.lit(1)),
        entropy * 4,
        F.when(query == "", F.lit(0)).otherwise(count(query, "&") + 1),
        count(host, "."),
        count(host, "-"),
        count(url, "#") + 2 * count(url, "%"),
    ]
    binned = F.array(*[F.least(F.lit(BINS - 1), F.floor(v).cast("int")) for v in values])
    return rows.withColumn("suffix", F.substring_index(host, ".", -1)).withColumn("lex", binned).drop("chars", "kinds")


def tree_value(tree: tuple, bins: Column) -> Column:
    """A tree (feature, bin, left, right) or leaf (value,) as an expression: left where the feature's bin is at most ``bin``."""
    if len(tree) == 1:
        return F.lit(float(tree[0]))
    f, b, left, right = tree
    return F.when(F.get(bins, F.lit(f)) <= b, tree_value(left, bins)).otherwise(tree_value(right, bins))


def boost(examples: DataFrame, trees: int = TREES, depth: int = DEPTH) -> list[tuple]:
    """Gradient-boosted trees for the log loss of (bins array<int>, label 0/1, weight).

    Each level of a tree is one aggregation of gradients by node, feature and bin, over all examples; the driver sees
    those sums, at most 2**depth * features * BINS rows, and picks the splits. No examples give no trees.
    """
    bins, model = F.col("bins"), []
    for _ in range(trees):
        z = sum((tree_value(t, bins) for t in model), F.lit(0.0))
        p = 1 / (1 + F.exp(-z))
        graded = examples.select("bins", (F.col("weight") * (F.col("label") - p)).alias("g"), (F.col("weight") * p * (1 - p)).alias("h"))
        # nodes by path of (feature, bin, side); open ones are split further
        nodes: dict[int, tuple] = {1: ()}
        splits: dict[int, tuple[int, int]] = {}
        leaves: dict[int, float] = {}
        for level in range(depth + 1):
            live = [k for k in nodes if k not in splits and k not in leaves]
            if not live:
                break
            node = F.lit(1)
            for _step in range(level):
                here = node
                node = F.lit(0)
                for k, (f, b) in splits.items():
                    if k.bit_length() - 1 == _step:
                        node = F.when(here == k, F.when(F.get(bins, F.lit(f)) <= b, F.lit(2 * k)).otherwise(F.lit(2 * k + 1))).otherwise(node)
            spread = graded.select(node.alias("node"), "bins", "g", "h").where(F.col("node") > 0).select("node", "g", "h", F.posexplode_outer("bins").alias("f", "b"))
            sums: dict[int, dict[int, dict[int, tuple[float, float]]]] = {}
            for k, f, b, g, h in spread.groupBy("node", "f", "b").agg(F.sum("g"), F.sum("h")).collect():
                sums.setdefault(k, {}).setdefault(f, {})[b] = (g, h)
            for k in live:
                by_feature = sums.get(k, {})
                total = by_feature.get(0, {})
                g_all, h_all = sum(x[0] for x in total.values()), sum(x[1] for x in total.values())
                leaves[k] = RATE * g_all / (h_all + LEAF_PENALTY)
                best = (1e-6, None)
                for f in sorted(by_feature) if level < depth else ():
                    g_left = h_left = 0.0
                    for b in sorted(by_feature[f])[:-1]:
                        g_left += by_feature[f][b][0]
                        h_left += by_feature[f][b][1]
                        g_right, h_right = g_all - g_left, h_all - h_left
                        gain = g_left**2 / (h_left + LEAF_PENALTY) + g_right**2 / (h_right + LEAF_PENALTY) - g_all**2 / (h_all + LEAF_PENALTY)
                        if gain > best[0] + 1e-9:
                            best = (gain, (f, b))
                if best[1]:
                    splits[k] = best[1]
                    del leaves[k]
                    nodes[2 * k] = nodes[2 * k + 1] = ()

        def built(k: int, splits=splits, leaves=leaves) -> tuple:
            return (*splits[k], built(2 * k), built(2 * k + 1)) if k in splits else (leaves.get(k, 0.0),)

        tree = built(1)
        if tree == (0.0,):
            break
        model.append(tree)
    return model


def judge_urls(pages: DataFrame, *, rules: tuple[tuple[str, str], ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: (page_id, host, path, rule, verdict, score).

    The longest fitting rule decides; pages without one are judged by trees learnt from all pages with one, at whole
    table: block where the log odds ``score`` are above 0. A null URL, or one without ``://``, has empty host and path,
    fits no rule and is judged by its features. Without labelled pages score is 0 and the verdict allow. Rows that
    repeat an id are judged each by its URL. Empty input gives no rows; other columns are not read.
    """
    host, path = split_url(pages, url_col)
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = materialize(_lexical(rows.withColumn("rule", rule).withColumn("by_rule", verdict)).drop("url"), "urls")
    # equal features collapse to one weighted example
    known = rows.where("by_rule is not null").groupBy("suffix", "lex", (F.col("by_rule") == "block").cast("int").alias("label")).agg(F.count("*").alias("weight"))
    known = materialize(known, "url-examples")
    blocked = F.sum(F.col("label") * F.col("weight"))
    stats = known.groupBy("suffix").agg(F.floor((blocked + 1) * BINS / (F.sum("weight") + 2)).cast("int").alias("rate"))
    stats = materialize(stats, "url-suffixes")
    features = F.concat("lex", F.array(F.coalesce(F.least(F.col("rate"), F.lit(BINS - 1)), F.lit(BINS // 2))))
    examples = known.join(stats, "suffix", "left").select(features.alias("bins"), "label", "weight")
    examples = materialize(examples.groupBy("bins", "label").agg(F.sum("weight").alias("weight")), "url-bins")
    model = boost(examples)
    scored = rows.join(stats, "suffix", "left").withColumn("bins", features)
    score = sum((tree_value(t, F.col("bins")) for t in model), F.lit(0.0))
    scored = scored.withColumn("score", score)
    by_trees = F.when(F.col("score") > 0, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("by_rule", by_trees).alias("verdict"), "score")
