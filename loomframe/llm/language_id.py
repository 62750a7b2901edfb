"""Language identification: family first, then one-versus-one linear support vector machines within it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomframe.llm._common import fold

# Families of language codes; a code not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "pl", "cs", "uk", "bg", "sk", "sr", "hr"),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageSettings:
    """Bounds: the machines learn from at most ``rows`` texts together, spread over languages, of ``max_bytes`` at most."""

    rows: int = 3200
    max_bytes: int = 4096
    buckets: int = 2048
    grams: tuple[int, ...] = (1, 2, 3)
    rounds: int = 120
    penalty: float = 1e-4


def gram_profile(text: str, settings: LanguageSettings) -> np.ndarray:
    """Root shares of hashed byte n-grams of the lower-cased text, of length 1."""
    data = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8)
    out = np.zeros(settings.buckets, np.float32)
    for at in range(0, len(data), 1 << 20):
        raw = data[at : at + (1 << 20) + max(settings.grams) - 1].astype(np.uint32)
        for k in settings.grams:
            if len(raw) < k:
                continue
            code = raw[: len(raw) - k + 1].copy()
            for j in range(1, k):
                code = code * np.uint32(257) + raw[j : len(raw) - k + 1 + j]
            code = (code * np.uint32(2654435761)) >> np.uint32(32 - int(np.log2(settings.buckets)))
            out += np.bincount(code.astype(np.intp), minlength=settings.buckets)
    out = np.sqrt(out)
    return out / max(float(np.linalg.norm(out)), 1e-9)


def _svm(x: np.ndarray, y: np.ndarray, settings: LanguageSettings) -> np.ndarray:
    """Weights (last: bias) of a linear machine with squared hinge loss, classes alike; y is +1 or -1."""
    x = np.concatenate((x, np.ones((len(x), 1), np.float32)), axis=1)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = look = np.zeros(x.shape[1], np.float32)
    t = 1.0
    for _ in range(settings.rounds):
        slack = np.maximum(0, 1 - y * (x @ look))
        g = -2 * x.T @ (share * y * slack) + settings.penalty * look
        new = look - 0.25 * g
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, w, t = new + np.float32((t - 1) / t_new) * (new - w), new, t_new
    return w


class LanguageTree:
    """One machine per family against the rest; one per pair of languages within a family."""

    def __init__(self, settings: LanguageSettings):
        self.s = settings
        self.families: dict[str, list[str]] = {}
        self.of_family: dict[str, np.ndarray] = {}
        self.of_pair: dict[tuple[str, str], np.ndarray] = {}

    def fit(self, rows: list[tuple[str, str]]) -> LanguageTree:
        if not rows:
            return self
        lang = np.array([x for _, x in rows])
        x = np.stack([gram_profile(t, self.s) for t, _ in rows])
        for code in sorted(set(lang)):
            self.families.setdefault(FAMILY_OF.get(code, code), []).append(code)
        family = np.array([FAMILY_OF.get(c, c) for c in lang])
        if len(self.families) > 1:
            self.of_family = {f: _svm(x, np.where(family == f, 1, -1).astype(np.float32), self.s) for f in self.families}
        for codes in self.families.values():
            for a, b in combinations(codes, 2):
                two = (lang == a) | (lang == b)
                self.of_pair[a, b] = _svm(x[two], np.where(lang[two] == a, 1, -1).astype(np.float32), self.s)
        return self

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score); the score is the logistic of the smallest margin on the way. No letter, or nothing learnt: unknown."""
        if not text or not self.families or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        x = np.append(gram_profile(text, self.s), np.float32(1))
        margin, family = 2.0, next(iter(self.families))
        if self.of_family:
            scores = sorted(((float(w @ x), f) for f, w in self.of_family.items()), reverse=True)
            margin, family = scores[0][0] - scores[1][0], scores[0][1]
        codes = self.families[family]
        wins = dict.fromkeys(codes, 0)
        total = dict.fromkeys(codes, 0.0)
        for a, b in combinations(codes, 2):
            m = float(self.of_pair[a, b] @ x)
            wins[a if m >= 0 else b] += 1
            total[a] += m
            total[b] -= m
        best = max(codes, key=lambda c: (wins[c], total[c]))
        for a, b in combinations(codes, 2):
            if best in (a, b):
                margin = min(margin, float(self.of_pair[a, b] @ x) * (1 if best == a else -1))
        return best, float(1 / (1 + np.exp(-2 * np.clip(margin, -15, 15))))


def train_languages(documents: DataFrame, *, folds: int = 4, held: int = 2, settings: LanguageSettings = LanguageSettings()) -> LanguageTree:
    """Learn from documents with a language whose fold is not ``held``: a sample by id hash, as many of each language."""
    texts = documents.select(F.col("doc_id").alias("id"), "text", "lang").where(F.col("lang").isNotNull() & (fold("doc_id", folds) != held))
    texts = texts.where(F.octet_length(F.coalesce("text", F.lit(""))).between(20, settings.max_bytes))
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    counts = {r[0]: r[1] for r in texts.groupBy("lang").count().collect()}
    each = max(1, settings.rows // max(1, len(counts)))
    if not counts:
        return LanguageTree(settings)
    # the hash range holds about twice the rows wanted of a language, so one scan finds them and little is sorted
    limit = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, int(min(1.0, 2.0 * each / n + 0.001) * (1 << 30)))])
    place = F.row_number().over(Window.partitionBy("lang").orderBy(share, "id"))
    drawn = texts.where(share < limit[F.col("lang")]).withColumn("place", place).where(F.col("place") <= each).orderBy("lang", "place")
    return LanguageTree(settings).fit([(r.text, r.lang) for r in drawn.select("text", "lang").collect()])


def identify_languages(documents: DataFrame, *, folds: int = 4, held: int = 2, settings: LanguageSettings = LanguageSettings()) -> DataFrame:
    """One row per document: (doc_id, held_out, lang_pred, score); every text is read whole.

    A null text, and one without a letter, is ``und`` with score 0; so is all if no document has a language to learn. A
    null id is not held out and not learnt from. Rows that repeat an id are judged each by its text.
    """
    model = documents.sparkSession.sparkContext.broadcast(train_languages(documents, folds=folds, held=held, settings=settings))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.value.predict(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = documents.select("doc_id", F.coalesce(fold("doc_id", folds) == held, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
