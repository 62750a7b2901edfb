"""N-gram Jaccard join over R-trees of group-count vectors.

Every document is a set of word shingles. Shingle hashes fall into groups, whose number grows with the set; the counts per
group are the document's point. The overlap of two sets is at most the sum over groups of the smaller count, and the same
holds for two boxes of an R-tree with their largest counts, so a join of trees that drops box pairs below the overlap that
the similarity asks for loses nothing. Trees fold points to ``GROUPS`` coordinates; pairs that leave a tree meet the bound
on all groups both have, then on fine points of a group a member, and what is left is verified on the exact sets.

One tree over a whole corpus would not be distributable, so points are first dealt to blocks that provably hold every
pair: two sets of similarity ``t`` share a shingle among the first ``n - ceil(t n) + 1`` of each under any common order,
and their first shared shingle stands at places that leave room for the overlap asked for. The order puts shingles that
many documents hold last, the commonest at the very end, so that what tells near copies apart comes first. Equal sets are
one point. Each block has its tree. Trees are joined twice: first every point meets its smallest and its most similar
surviving partner, then, once those links are verified and merged, all surviving pairs across what is still apart, each
pair in the first block that both are known to share.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomframe.llm._common import discard, materialize, mix, shingle_set
from loomframe.llm.components import connected_components

#: Coordinates of a tree's points, and the most of any point.
GROUPS, MOST_GROUPS = 128, 1 << 14
#: Members of a set to a group of its point, half of this to this. Two unrelated sets of n members have a bound of about
#: n - sqrt(n groups / 3.14), and a similarity of 80 % asks for 0.89 n, so n / 16 groups tell them apart at any n.
POINT_MEMBERS = 16
#: The largest count that a coordinate of a tree, and one of a point, holds; a coordinate with it bounds nothing.
FULL, BYTE_FULL = 65535, 255
#: Children of a tree node.
FANOUT = 16
#: Points of one tree; larger blocks are joined tile by tile.
TREE_POINTS = 2048
#: Blocks are joined when so many rows, or bytes of points, are at hand; pairs are given on when so many are found.
HELD_ROWS, HELD_BYTES, FOUND_PAIRS = 20_000, 32 << 20, 50_000
#: Blocks that a row names as the first of its set, so that pairs are given on once.
WITNESSES = 8
#: Shingles per counting block, and the fewest documents of a block that make a shingle a candidate for "frequent".
COUNT_BLOCK, COUNT_LEAST = 1_000_000, 4
#: A shingle in one document of this many counts as frequent, so frequent ones number at most that times a document's mean shingles.
FREQUENT_SHARE = 1000
#: Rows (40 bytes at most) up to which a table is broadcast; beyond, its join shuffles.
BROADCAST_ROWS = 500_000


def needed_overlap(total: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of two sets of ``total`` members together that meets the similarity: ceil(p total / (100 + p))."""
    return -((-percent * total) // (100 + percent))


def _sets(documents: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(kind, doc, n, sig, amount): a row per document (kind 0) and one per locally frequent shingle (kind 1; doc is its hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def frequent(held: list[np.ndarray]) -> pa.RecordBatch:
            x = np.sort(np.concatenate(held))
            first = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
            amount = np.diff(np.append(first, len(x)))
            keep = amount >= COUNT_LEAST
            k = int(keep.sum())
            return pa.RecordBatch.from_arrays(
                [pa.array(np.ones(k, np.int32)), pa.array(x[first][keep].view(np.int64)), pa.array(np.zeros(k, np.int64)), pa.nulls(k, pa.binary()), pa.array(amount[keep].astype(np.int64))],
                names=["kind", "doc", "n", "sig", "amount"],
            )

        held, size = [], 0
        for batch in batches:
            sig, n = [], np.empty(batch.num_rows, np.int64)
            for i, text in enumerate(batch.column(1)):
                s = shingle_set(text.as_py(), words)
                n[i] = len(s)
                sig.append(_signature(s))
                held.append(s)
                size += len(s)
                if size >= COUNT_BLOCK:
                    yield frequent(held)
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(n), np.int32)), batch.column(0), pa.array(n), pa.array(sig, pa.binary()), pa.array(np.zeros(len(n), np.int64))],
                names=["kind", "doc", "n", "sig", "amount"],
            )
        if size:
            yield frequent(held)

    rows = documents.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "kind int, doc long, n long, sig binary, amount long")


def _signature(s: np.ndarray) -> bytes:
    """16 bytes that stand for a whole set."""
    with np.errstate(over="ignore"):
        return np.array([mix(s).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D)), initial=np.uint64(len(s)))], np.uint64).tobytes()


def count_point(s: np.ndarray, least: int, most: int, members: int) -> bytes:
    """Counts of a set's members per group; a power of 2 of groups, at ``members`` a group or fewer within ``least`` and ``most``."""
    groups = min(most, max(least, 1 << max(0, math.ceil(math.log2(len(s) / members)))))
    return np.minimum(np.bincount((s & np.uint64(groups - 1)).astype(np.intp), minlength=groups), BYTE_FULL).astype(np.uint8).tobytes()


def fine_overlap(a: bytes, b: bytes) -> int | None:
    """An upper bound of the overlap of two sets by their fine points; None where a full count leaves it open."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if x.max() == BYTE_FULL or y.max() == BYTE_FULL:
        return None
    groups = min(len(x), len(y))
    # a group of fewer groups is the union of those with the same low bits
    x, y = (v.reshape(-1, groups).sum(axis=0, dtype=np.int64) for v in (x, y))
    return int(np.minimum(x, y).sum())


def _points(documents: DataFrame, id_col: str, text_col: str, words: int, percent: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc, n, sig, point, fine, cool, short, keys): the points of every set that is not empty, and its blocks in the common order.

    The first ``cool`` keys are not frequent; at the first ``short`` a set may meet larger ones, after them only smaller ones.
    """
    shared = documents.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, rank = shared.value
        for batch in batches:
            keep, n, sig, point, fine, keys, cools = [], [], [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                s = shingle_set(text.as_py(), words)
                if not len(s):
                    continue
                take = len(s) - int(-((-percent * len(s)) // 100)) + 1
                chosen, cool = s[:take], take
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
                    is_hot = hot[at] == s
                    chosen = s[~is_hot][:take]
                    cool = len(chosen)
                    if cool < take:
                        warm = np.flatnonzero(is_hot)
                        chosen = np.concatenate((chosen, s[warm[np.argsort(rank[at[warm]])[: take - cool]]]))
                keep.append(i)
                n.append(len(s))
                sig.append(_signature(s))
                point.append(count_point(s, GROUPS, MOST_GROUPS, POINT_MEMBERS))
                fine.append(count_point(s, 1, 1 << 30, 1))
                cools.append(cool)
                keys.append(chosen.view(np.int64).copy())  # a slice would keep the whole set
            size = np.array(n, np.int64)
            lengths = np.cumsum([0, *map(len, keys)])
            flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
            columns = {
                "doc": batch.column(0).take(pa.array(keep, pa.int64())), "n": pa.array(size), "sig": pa.array(sig, pa.binary()), "point": pa.array(point, pa.binary()), "fine": pa.array(fine, pa.binary()),
                "cool": pa.array(cools, pa.int32()), "short": pa.array((size - needed_overlap(2 * size, percent) + 1).astype(np.int32)), "keys": pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(flat)),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    rows = documents.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc long, n long, sig binary, point binary, fine binary, cool int, short int, keys array<long>")


def _sized(table: DataFrame) -> DataFrame:
    """A written table, marked for a broadcast if it is small enough for one."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _exact_sets(texts: DataFrame, reps: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """(node, members) of the sets in ``pairs``, each from the text of one document that has it."""
    both = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    # at most two rows a pair
    wanted = _sized(materialize(both.join(reps.select("node", F.col("rep").alias("doc"), "sig"), "node"), "wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sets = [], []
            for node, text, sig in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                s = shingle_set(text.as_py(), words)
                if _signature(s) == sig:
                    nodes.append(node)
                    sets.append(s.view(np.int64))
            members = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), members], names=["node", "members"])

    # an id may have several texts: those whose set is another one are left out there
    rows = texts.join(wanted, "doc").select("node", "text", "sig")
    return rows.mapInArrow(run, "node long, members array<long>")


def tree_join(block: np.ndarray, n: np.ndarray, vec: np.ndarray, side: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Index pairs that may meet the similarity, and the bounds of their overlap, from a join of all R-trees of a block with each other.

    ``block`` must be in order. ``side``: 2 joins with all, 0 only with 1 and 2. The trees are packed: points in order of
    size, FANOUT to a leaf, FANOUT leaves to a node, FANOUT nodes to a root; a block of more than FANOUT**3 points has
    several roots, and every two of them meet.
    """
    order = np.lexsort((vec[:, 0], n, block))
    block, n, vec, side = block[order], n[order], vec[order], side[order]
    starts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
    place = np.arange(len(block)) - np.repeat(starts, np.diff(np.append(starts, len(block))))
    # levels[k]: the first child of each node, the boxes' largest counts and their sizes' range
    levels = [(None, vec, n, n)]
    unbounded = len(vec) and int(vec.max()) == FULL
    cuts = [place % FANOUT**k == 0 for k in (1, 2, 3)]
    for k, cut in enumerate(cuts):
        first_point = np.flatnonzero(cut)
        below = np.arange(len(block)) if k == 0 else np.cumsum(cuts[k - 1]) - 1
        child = below[first_point]
        _, box, low, high = levels[-1]
        levels.append((np.append(child, len(low)), np.maximum.reduceat(box, child), np.minimum.reduceat(low, child), np.maximum.reduceat(high, child)))
    root_block = block[cuts[2]]
    # each root meets itself and all later roots of its block
    mates = np.searchsorted(root_block, root_block, side="right") - np.arange(len(root_block))
    first = np.repeat(np.arange(len(root_block)), mates)
    second = first + np.arange(len(first)) - np.repeat(np.cumsum(mates) - mates, mates)
    stack = [(3, first, second)]
    while stack:
        level, a, b = stack.pop()
        child = levels[level][0]
        size_a, size_b = child[a + 1] - child[a], child[b + 1] - child[b]
        many = np.cumsum(size_a * size_b)
        if len(a) > 1 and many[-1] > 40_000:
            half = max(1, min(len(a) - 1, int(np.searchsorted(many, many[-1] // 2))))
            stack += [(level, a[:half], b[:half]), (level, a[half:], b[half:])]
            continue
        pair = np.repeat(np.arange(len(a)), size_a * size_b)
        inner = np.arange(len(pair)) - (many - size_a * size_b)[pair]
        x = child[a][pair] + inner // size_b[pair]
        y = child[b][pair] + inner % size_b[pair]
        once = x <= y if level > 1 else x < y
        once |= a[pair] != b[pair]
        x, y = x[once], y[once]
        _, box, low, high = levels[level - 1]
        fits = (100 * high[x] >= percent * low[y]) & (100 * high[y] >= percent * low[x])
        if level == 1:
            fits &= (side[x] != side[y]) | (side[x] == 2)
        x, y = x[fits], y[fits]
        least = np.minimum(box[x], box[y])
        bound = least.sum(axis=1, dtype=np.int64)
        if unbounded:
            bound[(least == FULL).any(axis=1)] = np.iinfo(np.int64).max
        fits = bound >= needed_overlap(low[x] + low[y], percent)
        x, y = x[fits], y[fits]
        if level == 1:
            yield order[x], order[y], bound[fits]
        elif len(x):
            stack.append((level - 1, x, y))


class _Rows:
    """Rows of whole blocks, in order of block and tile, with their points at every number of groups."""

    def __init__(self, rows: pd.DataFrame, percent: int):
        self.percent = percent
        self.node, self.n, self.pos = rows["node"].to_numpy(), rows["n"].to_numpy(), rows["pos"].to_numpy()
        self.comp, self.side = rows["comp"].to_numpy(), rows["side"].to_numpy()
        #: The blocks before this one that a row names, and how many it names.
        first = rows["first"].to_list()
        self.named = np.array([len(f) for f in first], np.int64)
        self.first = np.zeros((len(rows), WITNESSES), np.int64)
        self.first[np.arange(WITNESSES) < self.named[:, None]] = np.concatenate([np.empty(0, np.int64), *first])
        key = rows[["bid", "tile"]].to_numpy()
        self.block = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]).any(axis=1))))
        self.point = rows["point"].to_numpy()
        self.groups = np.array([len(p) for p in self.point], np.int64)
        self.full = np.zeros(len(rows), bool)
        self.folded: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        place, tree = self._at(GROUPS)
        tree[self.full] = FULL
        self.tree = tree

    def _at(self, groups: int) -> tuple[np.ndarray, np.ndarray]:
        """(place of each row, counts) of the rows that have ``groups`` or more, folded to so many."""
        if groups not in self.folded:
            place = np.cumsum(self.groups >= groups) - 1
            out = np.empty((int((self.groups >= groups).sum()), groups), np.uint16)
            for size in np.unique(self.groups[self.groups >= groups]):
                rows = np.flatnonzero(self.groups == size)
                counts = np.frombuffer(b"".join(self.point[rows]), np.uint8).reshape(len(rows), -1, groups)
                self.full[rows] |= (counts == BYTE_FULL).any(axis=(1, 2))
                out[place[rows]] = counts.sum(axis=1, dtype=np.uint16)
            self.folded[groups] = (place, out)
        return self.folded[groups]

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(x, y, bound) of the surviving pairs that may share no block before theirs."""
        for x, y, bound in tree_join(self.block, self.n, self.tree, self.side, self.percent):
            need = needed_overlap(self.n[x] + self.n[y], self.percent)
            room = (self.pos[x] + need <= self.n[x]) & (self.pos[y] + need <= self.n[y]) & (self.comp[x] != self.comp[y])
            x, y, bound, need = x[room], y[room], bound[room], need[room]
            groups = np.where(self.full[x] | self.full[y], GROUPS, np.minimum(self.groups[x], self.groups[y]))
            for size in np.unique(groups[groups > GROUPS]):
                place, counts = self._at(int(size))
                every, step = np.flatnonzero(groups == size), max(1, (4 << 20) // int(size))
                for at in range(0, len(every), step):
                    some = every[at : at + step]
                    bound[some] = np.minimum(counts[place[x[some]]], counts[place[y[some]]]).sum(axis=1, dtype=np.int64)
            fits = bound >= need
            yield x[fits], y[fits], bound[fits]

    def once(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """False where both rows name a block before this one that holds both."""
        again = np.zeros(len(x), bool)
        for i in range(WITNESSES):
            for j in range(WITNESSES):
                again |= (self.first[x, i] == self.first[y, j]) & (i < self.named[x]) & (j < self.named[y])
        return ~again

    def partners(self) -> np.ndarray:
        """(a, b): each row with its smallest and its most similar partner."""
        least, best = np.arange(len(self.node)), np.arange(len(self.node))
        score = np.zeros(len(self.node))
        for x, y, bound in self.pairs():
            alike = bound / np.maximum(1, self.n[x] + self.n[y] - bound)
            for p, q in ((x, y), (y, x)):
                p1, q1, _ = _first_of(p, q, self.node[q])
                better = self.node[q1] < self.node[least[p1]]
                least[p1[better]] = q1[better]
                p2, q2, at = _first_of(p, q, -alike)
                better = alike[at] > score[p2]
                best[p2[better]], score[p2[better]] = q2[better], alike[at][better]
        own = np.arange(len(self.node))
        a, b = np.concatenate((own, own)), np.concatenate((least, best))
        return self._nodes(a[a != b], b[a != b])

    def _nodes(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.stack((np.minimum(self.node[x], self.node[y]), np.maximum(self.node[x], self.node[y])), axis=1)

    def all_pairs(self) -> Iterator[np.ndarray]:
        """(a, b) of all surviving pairs, each where it is not known to be found elsewhere."""
        found, size = [], 0
        for x, y, _ in self.pairs():
            once = self.once(x, y)
            found.append(self._nodes(x[once], y[once]))
            size += len(found[-1])
            if size >= FOUND_PAIRS:
                yield np.concatenate(found)
                found, size = [], 0
        if size:
            yield np.concatenate(found)


def _first_of(p: np.ndarray, q: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each p the q with the least ``by``, and its place."""
    order = np.lexsort((by, p))
    order = order[np.concatenate(([True], p[order][1:] != p[order][:-1]))] if len(p) else order
    return p[order], q[order], order


def _block_pairs(rows: DataFrame, percent: int, across: bool) -> DataFrame:
    """Rows (bid, tile, node, n, pos, comp, side, first, point) -> distinct (a, b), a < b, of pairs whose comp differ.

    ``across``: all surviving pairs; else for each point its smallest and its most similar surviving partner. ``first``:
    blocks before this one that hold the node.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def joined(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
            whole = _Rows(part, percent)
            for pairs in whole.all_pairs() if across else [whole.partners()]:
                yield pd.DataFrame(pairs, columns=["a", "b"]).drop_duplicates()

        held: list[pd.DataFrame] = []
        size = 0
        for rows in batches:
            held.append(rows)
            size += int(rows["point"].str.len().sum())
            if sum(map(len, held)) < HELD_ROWS and size < HELD_BYTES:
                continue
            rows = pd.concat(held, ignore_index=True)
            key = rows[["bid", "tile"]].to_numpy()
            last = int(np.flatnonzero((key != key[-1]).any(axis=1))[-1]) + 1 if (key != key[-1]).any() else 0
            held = [rows.iloc[last:]]
            size = int(held[0]["point"].str.len().sum())
            if last:
                yield from joined(rows.iloc[:last].reset_index(drop=True))
        if held and (rows := pd.concat(held, ignore_index=True)).shape[0]:
            yield from joined(rows)

    return rows.repartition("bid", "tile").sortWithinPartitions("bid", "tile").mapInPandas(run, "a long, b long").distinct()


def _promising(pairs: DataFrame, fine: DataFrame, percent: int) -> DataFrame:
    """The pairs whose fine points do not rule the similarity out; ``fine`` has (node, n, fine)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            need = needed_overlap(batch.column("na").to_numpy() + batch.column("nb").to_numpy(), percent)
            bounds = (fine_overlap(x.as_py(), y.as_py()) for x, y in zip(batch.column("fa"), batch.column("fb")))
            fits = pa.array([bound is None or bound >= least for bound, least in zip(bounds, need)], pa.bool_())
            yield batch.select(["a", "b"]).filter(fits)

    left = fine.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("fine").alias("fa"))
    right = fine.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("fine").alias("fb"))
    return pairs.join(right, "b").join(left, "a").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose exact sets meet the similarity."""
    sets = sets.dropDuplicates(["node"])
    left = sets.select(F.col("node").alias("a"), F.col("members").alias("ma"))
    right = sets.select(F.col("node").alias("b"), F.col("members").alias("mb"))
    both = F.size(F.array_intersect("ma", "mb"))
    union = F.size("ma") + F.size("mb") - both
    return pairs.join(right, "b").join(left, "a").where(100 * both >= percent * union).select("a", "b")


def _blocks(points: DataFrame, frequent: int, percent: int) -> DataFrame:
    """(key, node, n, pos, held): the blocks of every point, without rows that no other row of their block can link to.

    Of two sets that link, the smaller has their first shared key among its ``short`` first ones. Windows run over keys
    that few documents hold; frequent keys, of which there are few, are counted by an aggregate and keep all their rows.
    """
    keyed = points.select("node", "n", "cool", "short", F.posexplode("keys").alias("pos", "key"))
    keyed = keyed.select("key", "node", "n", "pos", (F.col("pos") < F.col("short")).alias("short"), (F.col("pos") >= F.col("cool")).alias("hot"))
    of_key = Window.partitionBy("key")
    by_size = of_key.orderBy("n")
    smaller = F.last(F.when(F.col("short"), F.col("n")), ignorenulls=True).over(by_size.rowsBetween(Window.unboundedPreceding, -1))
    close = (100 * smaller >= percent * F.col("n")) | (F.col("short") & (percent * F.lead("n").over(by_size) <= 100 * F.col("n")))
    cool = keyed.where(~F.col("hot")).withColumn("close", F.coalesce(close, F.lit(False))).where("close")
    cool = cool.withColumn("held", F.count("*").over(of_key)).select("key", "node", "n", "pos", "held")
    hot = keyed.where("hot")
    counts = hot.groupBy("key").agg(F.count("*").alias("held"))
    hot = hot.join(F.broadcast(counts) if frequent <= BROADCAST_ROWS else counts, "key").where("held > 1")
    return cool.union(hot.select("key", "node", "n", "pos", "held"))


def _chunk(parts: Column) -> Column:
    return F.pmod(F.xxhash64("node", "key"), parts)


def _tiles() -> Column:
    """The (tile, side) rows of a row of a block of ``total`` rows, ``most`` of them in its largest component (``main`` rows).

    A block of TREE_POINTS rows or fewer is one tile. Else rows of the largest component, which need not meet each other,
    stand in one chunk each, and the others meet every chunk of them, and every chunk of the others.
    """
    mains = F.ceil(F.col("most") / TREE_POINTS).cast("long")
    others = F.ceil((F.col("total") - F.col("most")) / TREE_POINTS).cast("long")
    at = lambda tile, side: F.struct(tile.cast("long").alias("tile"), F.lit(side).cast("int").alias("side"))
    chunk = _chunk(others)
    with_main = F.transform(F.sequence(F.lit(0).cast("long"), mains - 1), lambda o: at(o, 1))
    with_others = F.transform(
        F.sequence(F.lit(0).cast("long"), others - 1),
        lambda o: F.struct(
            (mains + F.least(o, chunk) * others + F.greatest(o, chunk)).alias("tile"),
            F.when(o == chunk, F.lit(2)).when(chunk < o, F.lit(0)).otherwise(F.lit(1)).alias("side"),
        ),
    )
    return F.when(F.col("total") <= TREE_POINTS, F.array(at(F.lit(0), 2))).when(F.col("main"), F.array(at(_chunk(mains), 0))).otherwise(F.concat(with_main, with_others))


def similarity_classes(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: (doc_id, n_shingles, component_id).

    Words are maximal runs of characters other than space and 0x09-0x0D, A-Z lower-cased; a document's set is its distinct
    ``words``-word shingles, the whole sequence where it has fewer words. Two documents link when
    ``100 * |A and B| >= percent * |A or B|``; component_id is the smallest id that links reach.

    Null and wordless texts have no shingles and link with nothing: component_id is their own id. Rows that repeat an id
    are one node whose links are united, also where their texts differ; each keeps its row. A null id keeps its row with a
    null component and links nothing. An empty table gives no rows; other columns, whatever their names, are not read.
    """
    found = materialize(_sets(documents, id_col, text_col, words), "sets")
    rows = found.where("kind = 0").select("doc", "n", "sig")
    known = rows.where("n > 0 and doc is not null")
    # a set's number is fixed once it is written
    reps = materialize(known.groupBy("sig").agg(F.min("doc").alias("rep"), F.max("n").alias("n")).withColumn("node", F.monotonically_increasing_id()), "reps")
    frequent = _frequent(found)
    points = _points(documents, id_col, text_col, words, percent, frequent)
    points = points.join(reps.select(F.col("rep").alias("doc"), "sig", "node"), ["doc", "sig"]).dropDuplicates(["doc", "sig"])
    points = materialize(points.drop("doc", "sig"), "points")
    blocks = materialize(_blocks(points, len(frequent[0]), percent), "blocks")
    vectors, fine = points.select("node", "point"), points.select("node", "n", "fine")
    texts = documents.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))

    # links between the sets that rows of one id have, whatever the sets
    several = known.groupBy("doc").agg(F.min("sig").alias("x"), F.max("sig").alias("y")).where("x <> y").select("doc")
    owned = known.join(several, "doc", "left_semi").select("doc", "sig").distinct().join(reps.select("sig", "node"), "sig")
    first = owned.groupBy("doc").agg(F.min("node").alias("a"))
    own = owned.join(first, "doc").where("node <> a").select("a", F.col("node").alias("b"))

    none = F.array().cast("array<long>").alias("first")
    parts = F.ceil(F.col("held") / TREE_POINTS).cast("long")
    first = blocks.select(F.col("key").alias("bid"), _chunk(parts).alias("tile"), "node", "n", "pos", F.col("node").alias("comp"), F.lit(2).alias("side"), none)
    pairs = materialize(_promising(_block_pairs(first.join(vectors, "node"), percent, across=False), fine, percent), "pairs")
    links = materialize(_verified(pairs, _exact_sets(texts, reps, pairs, words), percent).union(own), "links")
    merged = connected_components(links)
    discard(pairs, links)

    in_class = materialize(blocks.join(merged, "node", "left").select("key", "node", "n", "pos", F.coalesce("component", "node").alias("comp")), "in-class")
    shares = in_class.groupBy("key", "comp").agg(F.count("*").alias("k"))
    shares = shares.groupBy("key").agg(F.sum("k").alias("total"), F.max(F.struct("k", "comp")).alias("top")).where("top.k < total")
    open_rows = in_class.join(shares.select("key", "total", F.col("top.k").alias("most"), F.col("top.comp").alias("of")), "key").withColumn("main", F.col("comp") == F.col("of")).drop("of")
    open_rows = materialize(open_rows, "open")
    # a set's blocks number at most its members
    witnesses = open_rows.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct("pos", "key"))), 1, WITNESSES).alias("firsts"))
    before = F.transform(F.filter("firsts", lambda f: f["pos"] < F.col("pos")), lambda f: f["key"]).alias("first")
    second = open_rows.join(vectors.join(witnesses, "node"), "node").select("key", "node", "n", "pos", "comp", before, "point", F.explode(_tiles()).alias("t"))
    second = second.select(F.col("key").alias("bid"), "t.tile", "node", "n", "pos", "comp", "t.side", "first", "point")
    pairs = materialize(_promising(_block_pairs(second, percent, across=True), fine, percent), "pairs")
    rest = _verified(pairs, _exact_sets(texts, reps, pairs, words), percent)
    links = materialize(rest.union(merged.where("node <> component").select("component", "node")), "links")
    classes = connected_components(links)
    discard(points, blocks, in_class, open_rows, pairs, links)

    # most sets are in no class but their own: only classes of several are looked up
    smallest = classes.join(reps.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("least"))
    smallest = materialize(smallest, "smallest")
    members = classes.join(_sized(smallest), "component").select("node", "least")
    to_class = reps.join(members, "node", "left").select("sig", F.coalesce("least", "rep").alias("least"))
    joined = rows.join(to_class, "sig", "left")
    component = F.when(F.col("doc").isNotNull(), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc")))
    return joined.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))


def _frequent(found: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes held by one document of FREQUENT_SHARE or more, in order, and their ranks by documents; at most FREQUENT_SHARE times the mean set size."""
    total = found.where("kind = 0").count()
    least = max(64, math.ceil(total / FREQUENT_SHARE))
    heavy = found.where("kind = 1").groupBy("doc").agg(F.sum("amount").alias("amount")).where(F.col("amount") >= least).collect()
    hashes, amount = np.array([r[0] for r in heavy], np.int64).view(np.uint64), np.array([r[1] for r in heavy], np.int64)
    order = np.argsort(hashes)
    hashes, amount = hashes[order], amount[order]
    rank = np.empty(len(hashes), np.int64)
    rank[np.lexsort((hashes, amount))] = np.arange(len(hashes))
    return hashes, rank


def keep_one_per_class(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The documents, with all their columns, that are the smallest id of their class; of equal rows of an id one stays.

    Classes are of texts, not of ids: a hash of (id, text) is the node, so unrelated texts under one id are kept each.
    Among linked texts of the smallest id the one with the least hash stays. Rows without an id stay.
    """
    node = F.xxhash64(id_col, text_col)
    known = documents.where(F.col(id_col).isNotNull())
    nodes = known.select(F.col(id_col).alias("id"), node.alias("node"), F.col(text_col).alias("text"))
    classes = similarity_classes(nodes, id_col="node", text_col="text", words=words, percent=percent)
    classes = classes.groupBy("node").agg(F.min("component_id").alias("class"), F.count("*").alias("rows"))
    owners = materialize(nodes.groupBy("node").agg(F.min("id").alias("id")).join(classes, "node"), "owners")
    least = owners.groupBy("class").agg(F.min(F.struct("id", "node"))["node"].alias("least"), F.count("*").alias("k")).where("k > 1")
    judged = owners.join(_sized(materialize(least, "least")), "class", "left").withColumn("stays", F.coalesce(F.col("node") == F.col("least"), F.lit(True)))
    # most documents stay as they are: only what goes, or stands there more than once, is looked up
    odd = materialize(judged.where(~F.col("stays") | (F.col("rows") > 1)).select(F.col("node").alias("__lf_node"), "stays"), "odd")
    sized = F.broadcast if odd.count() <= BROADCAST_ROWS else lambda df: df
    rest = documents.join(sized(odd.select("__lf_node")), F.col(id_col).isNotNull() & (node == F.col("__lf_node")), "left_anti")
    twice = known.join(sized(odd.where("stays").select("__lf_node")), node == F.col("__lf_node"), "left_semi")
    rank = F.row_number().over(Window.partitionBy(node).orderBy(F.lit(0)))
    return rest.union(twice.withColumn("__lf_rank", rank).where("__lf_rank = 1").drop("__lf_rank"))
