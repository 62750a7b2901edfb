"""Toxicity: a sparse linear classifier with a counterfactual penalty on identity terms."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm._common import byte_prefix_hash, fold, mix, range_hash, sorted_distinct, word_bounds
from loomframe.llm._sample import labelled_texts

# Terms that name groups of people, by kind; within a kind each can stand for another.
IDENTITY_TERMS = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("women", "men", "girls", "boys"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("disabled", "blind", "deaf"),
    ("musulmans", "chrétiens", "juifs"),
    ("femmes", "hommes"),
    ("frauen", "männer"),
    ("muslime", "christen", "juden"),
    ("mujeres", "hombres"),
    ("musulmanes", "cristianos", "judíos"),
)
# What a sentence says in place of any group, by the language of the terms above.
NEUTRAL_TERMS = ("people", "people", "people", "people", "people", "people", "gens", "gens", "leute", "leute", "personas", "personas")

#: 0 for letters, digits and bytes of longer characters, which make words; 1 for the rest.
_PLAIN = bytes(int(not (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)) for b in range(256))


@dataclass(frozen=True)
class ToxicitySettings:
    """Bounds of the sample, the least documents of a feature, and the weights of the penalties.

    The counterfactual penalty learns from ``sentences`` sentences at most, half of them of each class, and at most
    ``sentences_per_text`` of a text, evenly spaced over the whole of it.
    """

    rows_per_class: int = 1500
    max_bytes: int = 8192
    least_documents: int = 6
    sparsity: float = 5e-4
    fairness: float = 20.0
    sentences: int = 600
    sentences_per_text: int = 3
    rounds: int = 400
    prefixes: tuple[int, ...] = (4, 5)


def features(text: str | None, prefixes: tuple[int, ...]) -> np.ndarray:
    """Sorted distinct hashes of a text's words and of their first bytes."""
    data = (text or "").lower().encode("utf-8", "surrogatepass")
    start, end = word_bounds(data, _PLAIN)
    if not len(start):
        return np.empty(0, np.uint64)
    prefix = byte_prefix_hash(np.frombuffer(data, np.uint8))
    found = [mix(range_hash(prefix, start, end))]
    for k in prefixes:
        long = end - start > k
        found.append(mix(range_hash(prefix, start[long], start[long] + k) + np.uint64(k)))
    return sorted_distinct(np.concatenate(found))


class SparseLogit:
    """Hashes with weights; a text's score is the logistic of the weights of the hashes it holds."""

    def __init__(self, vocabulary: np.ndarray, weights: np.ndarray, bias: float, prefixes: tuple[int, ...]):
        live = weights != 0
        self.vocabulary, self.weights, self.bias, self.prefixes = vocabulary[live], weights[live], bias, prefixes

    def score(self, text: str | None) -> float:
        z = self.bias
        if len(self.vocabulary):
            x = features(text, self.prefixes)
            at = np.minimum(np.searchsorted(self.vocabulary, x), len(self.vocabulary) - 1)
            hit = self.vocabulary[at] == x
            z += float(self.weights[at[hit]].sum())
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))))


def labelled_sentences(rows: list[tuple[str, int]], settings: ToxicitySettings) -> list[str]:
    """Sentences of three words or more from texts of either class in turn, at most half of the limit from each."""
    each: dict[int, list[str]] = {0: [], 1: []}
    for text, label in rows:
        if len(each[label]) >= settings.sentences // 2:
            continue
        found = [x for x in re.split(r"[.!?\n]+", text) if len(x.split()) >= 3]
        k = min(len(found), settings.sentences_per_text)
        each[label] += [found[i * len(found) // k] for i in range(k)]
    each = {c: v[: settings.sentences // 2] for c, v in each.items()}
    return [x for i in range(max(map(len, each.values()))) for x in (each[0][i : i + 1] + each[1][i : i + 1])]


def swapped_sentences(sentences: list[str], groups: tuple[tuple[str, ...], ...] = IDENTITY_TERMS, neutral: tuple[str, ...] = NEUTRAL_TERMS) -> list[tuple[str, str]]:
    """Pairs of a labelled sentence with one identity term and with another of its kind, and with its neutral word.

    A sentence that names a group is taken as it is; others lend their middle word's place. Terms take turns, so every
    term is swapped.
    """
    pairs: list[tuple[str, str]] = []
    kind_of = {t: (g, neutral[k]) for k, g in enumerate(groups) for t in g}
    turn = [t for g in groups for t in g]
    for n, sentence in enumerate(sentences):
        words = sentence.lower().split()
        at = next((i for i, w in enumerate(words) if w in kind_of), None)
        if at is None:
            at = len(words) // 2
            words[at] = turn[n % len(turn)]
        group, plain = kind_of[words[at]]
        other = group[(group.index(words[at]) + 1) % len(group)]
        pairs += [(" ".join(words), " ".join([*words[:at], swap, *words[at + 1 :]])) for swap in (other, plain)]
    return pairs


def _steepness(row: np.ndarray, col: np.ndarray, weight: np.ndarray, pairs: int, penalty: list[tuple[np.ndarray, np.ndarray, float]], scale: np.ndarray, fairness: float) -> float:
    """The largest curvature of loss and penalty, by power iteration on their bound; the last coordinate is the bias."""
    x = np.random.default_rng(5).random(len(scale) + 1)
    top = 1.0
    for _ in range(40):
        x /= np.linalg.norm(x)
        z = 0.25 * weight * (np.bincount(row, weights=(x[:-1] * scale)[col], minlength=len(weight)) + x[-1])
        y = np.append(np.bincount(col, weights=z[row], minlength=len(scale)) * scale, z.sum())
        change = sum((sign * np.bincount(r, weights=(x[:-1] * scale)[c], minlength=pairs) for r, c, sign in penalty), np.zeros(pairs))
        for r, c, sign in penalty:
            y[:-1] += sign * np.bincount(c, weights=change[r], minlength=len(scale)) * scale * fairness / pairs
        top = float(np.linalg.norm(y))
        x = y if top else np.ones_like(x)
    return top


def fit_toxicity(rows: list[tuple[str, int]], settings: ToxicitySettings = ToxicitySettings()) -> SparseLogit:
    """Accelerated proximal gradient on: log loss, classes alike + L1 + fairness / 2 * mean squared score change of swaps.

    The step is the inverse of the steepest curvature of loss and penalty together, so no weight of the penalty diverges.
    """
    s, y = settings, np.array([c for _, c in rows], np.float64)
    if len(set(y)) < 2:
        return SparseLogit(np.empty(0, np.uint64), np.empty(0), 2.0 if len(y) and y[0] else -2.0, s.prefixes)
    held = [features(t, s.prefixes) for t, _ in rows]
    pairs = [(features(a, s.prefixes), features(b, s.prefixes)) for a, b in swapped_sentences(labelled_sentences(rows, s))]
    words, count = np.unique(np.concatenate(held), return_counts=True)
    terms = np.concatenate([features(t, s.prefixes) for g in (*IDENTITY_TERMS, NEUTRAL_TERMS) for t in g])
    words = np.union1d(words[count >= s.least_documents], terms)

    def matrix(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        x = np.concatenate([np.empty(0, np.uint64), *sets])
        at = np.minimum(np.searchsorted(words, x), len(words) - 1)
        known = words[at] == x
        return row[known], at[known]

    row, col = matrix(held)
    m, every = max(1, len(pairs)), len(words)
    swaps = [(*matrix([p[k] for p in pairs]), sign) for k, sign in ((0, 1.0), (1, -1.0))] if pairs else []
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    w, bias = np.zeros(every), 0.0
    look, look_bias, t = w.copy(), 0.0, 1.0
    # features that hold in about half of the texts, and those that swaps change, make the sum steep: scale each by that
    share = np.bincount(col, weights=weight[row], minlength=every)
    changed = np.zeros(every)
    if pairs:
        a, b = (np.unique(r * np.int64(every) + c) for r, c, _ in swaps)
        changed = np.bincount(np.setxor1d(a, b) % every, minlength=every) * s.fairness / m
    scale = 1.0 / np.sqrt(np.maximum(share * (1 - share), 1e-3) + 4 * changed)
    scale /= scale.max()
    # power iteration comes from below: leave it a tenth
    rate = 1 / (1.1 * max(_steepness(row, col, weight, m, swaps, scale, s.fairness), 1e-6))
    for _ in range(s.rounds):
        z = np.bincount(row, weights=(look * scale)[col], minlength=len(y)) + look_bias
        d = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g = np.bincount(col, weights=d[row], minlength=every).astype(np.float64)
        change = sum((sign * np.bincount(r, weights=(look * scale)[c], minlength=m) for r, c, sign in swaps), np.zeros(m)) * s.fairness / m
        for r, c, sign in swaps:
            g += sign * np.bincount(c, weights=change[r], minlength=every)
        step = look - rate * g * scale
        new = np.sign(step) * np.maximum(np.abs(step) - rate * s.sparsity, 0)
        new_bias = look_bias - rate * d.sum()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, look_bias = new + (t - 1) / t_new * (new - w), new_bias + (t - 1) / t_new * (new_bias - bias)
        w, bias, t = new, new_bias, t_new
    return SparseLogit(words, w * scale, bias, s.prefixes)


def train_toxicity(documents: DataFrame, labels: DataFrame, *, folds: int = 5, settings: ToxicitySettings = ToxicitySettings()) -> SparseLogit:
    rows = labelled_texts(documents, labels, "toxic", rows_per_class=settings.rows_per_class, max_bytes=settings.max_bytes, held_out=fold("id", folds) == 0)
    return fit_toxicity(rows, settings)


def score_toxicity(documents: DataFrame, labels: DataFrame, *, folds: int = 5, threshold: float = 0.5, settings: ToxicitySettings = ToxicitySettings()) -> DataFrame:
    """One row per document: (doc_id, held_out, score, predicted); every text is read whole.

    A null or empty text holds no feature and gets the score of the bias. A null id is not held out. Rows that repeat an
    id are scored each by its text. Without labels of both classes the score is constant. Only id and text are read.
    """
    model = documents.sparkSession.sparkContext.broadcast(train_toxicity(documents, labels, folds=folds, settings=settings))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.array([model.value.score(t.as_py()) for t in batch.column(2)], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = documents.select("doc_id", F.coalesce(fold("doc_id", folds) == 0, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
