"""Quality classifier: a byte-level convolutional network in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm._common import fold
from loomframe.llm._sample import labelled_texts


@dataclass(frozen=True)
class CnnSettings:
    """Bounds and shape. The network learns from at most ``rows_per_class`` texts a class, of at most ``max_bytes`` each."""

    filters: int = 12
    width: int = 10
    #: A chunk is two neighbouring blocks of this many positions, so chunks overlap by half.
    block: int = 128
    rows_per_class: int = 500
    max_bytes: int = 4096
    epochs: int = 16
    batch: int = 25
    rate: float = 0.02
    decay: float = 1e-4
    seed: int = 11
    #: Bytes that are looked at in one go while scoring; a multiple of ``block``.
    segment: int = 1 << 18


class ByteCnn:
    """Bytes -> filters over ``width`` bytes -> ReLU -> mean per chunk -> maximum over chunks -> one probability."""

    def __init__(self, settings: CnnSettings):
        self.s = s = settings
        rng = np.random.default_rng(s.seed)
        self.p = {
            "bytes": rng.normal(0, 0.15, (s.width, 256, s.filters)).astype(np.float32),
            "bias": np.zeros(s.filters, np.float32),
            "out": rng.normal(0, 0.5, s.filters).astype(np.float32),
            "base": np.zeros(1, np.float32),
        }

    def _hidden(self, raw: np.ndarray, n: int) -> np.ndarray:
        """Filter outputs at the first ``n`` positions; ``raw`` is padded by width - 1 bytes."""
        h = np.repeat(self.p["bias"][None, :], n, axis=0)
        for j in range(self.s.width):
            h += self.p["bytes"][j][raw[j : j + n]]
        return np.maximum(h, 0, out=h)

    def _chunk_means(self, h: np.ndarray) -> np.ndarray:
        b = self.s.block
        sums = np.add.reduceat(h, np.arange(0, len(h), b), axis=0)
        sizes = np.full(len(sums), b, np.float32)
        sizes[-1] = len(h) - b * (len(sums) - 1)
        if len(sums) > 1:
            sums, sizes = sums[:-1] + sums[1:], sizes[:-1] + sizes[1:]
        return sums / sizes[:, None]

    def pooled(self, data: bytes) -> np.ndarray:
        """The largest chunk mean of each filter over the whole text, in segments that overlap by a block."""
        s, best = self.s, np.zeros(self.s.filters, np.float32)
        n = max(1, len(data))
        raw = np.frombuffer(data + bytes(s.width), np.uint8)
        for at in range(0, max(1, n - s.block if n > s.segment else n), s.segment):
            upto = min(n, at + s.segment + s.block)
            h = self._hidden(raw[at : upto + s.width - 1], upto - at)
            best = np.maximum(best, self._chunk_means(h).max(axis=0))
        return best

    def score(self, data: bytes) -> float:
        z = float(self.pooled(data) @ self.p["out"] + self.p["base"][0])
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))

    def fit(self, rows: list[tuple[bytes, int]]) -> ByteCnn:
        """Adam on the mean log loss, classes weighted alike; without both classes the score is constant."""
        s, labels = self.s, [y for _, y in rows]
        if len(set(labels)) < 2:
            self.p["out"][:] = 0
            self.p["base"][0] = 2.0 if not labels or labels[0] else -2.0
            return self
        weight = {c: len(labels) / 2 / labels.count(c) for c in (0, 1)}
        rng = np.random.default_rng(s.seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step = 0
        for _ in range(s.epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), s.batch):
                g = {k: np.zeros_like(x) for k, x in self.p.items()}
                part = order[at : at + s.batch]
                for i in part:
                    self._gradient(*rows[i], weight[rows[i][1]] / len(part), g)
                step += 1
                rate = s.rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for k, x in self.p.items():
                    d = g[k] + s.decay * x
                    m[k] += 0.1 * (d - m[k])
                    v[k] += 0.001 * (d * d - v[k])
                    x -= rate * m[k] / (np.sqrt(v[k]) + 1e-6)
        return self

    def _gradient(self, data: bytes, label: int, weight: float, g: dict[str, np.ndarray]) -> None:
        s, n = self.s, max(1, len(data))
        raw = np.frombuffer(data + bytes(s.width), np.uint8)
        h = self._hidden(raw[: n + s.width - 1], n)
        means = self._chunk_means(h)
        at = means.argmax(axis=0)
        top = means[at, np.arange(s.filters)]
        z = top @ self.p["out"] + self.p["base"][0]
        dz = np.float32(weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label))
        g["out"] += dz * top
        g["base"] += dz
        for f in range(s.filters):
            lo = int(at[f]) * s.block
            hi = min(n, lo + 2 * s.block)
            live = lo + np.flatnonzero(h[lo:hi, f] > 0)
            if not len(live):
                continue
            d = dz * self.p["out"][f] / (hi - lo)
            g["bias"][f] += d * len(live)
            for j in range(s.width):
                g["bytes"][j, :, f] += d * np.bincount(raw[live + j], minlength=256)


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def train_quality(documents: DataFrame, labels: DataFrame, *, folds: int = 5, settings: CnnSettings = CnnSettings()) -> ByteCnn:
    """The network, learnt from rows of ``labels`` whose fold is not 0; see ``labelled_texts`` for the sample."""
    rows = labelled_texts(documents, labels, "quality", rows_per_class=settings.rows_per_class, max_bytes=settings.max_bytes, held_out=fold("id", folds) == 0)
    return ByteCnn(settings).fit([(_bytes(t), y) for t, y in rows])


def score_quality(documents: DataFrame, labels: DataFrame, *, folds: int = 5, threshold: float = 0.3, settings: CnnSettings = CnnSettings()) -> DataFrame:
    """One row per document: (doc_id, held_out, score, predicted); every text is read whole.

    A null or empty text is scored as one padding byte. A null id is not held out. Rows that repeat an id are scored each
    by its text. Without labels of both classes the score is constant. Only id and text are read; no rows give none.
    """
    model = documents.sparkSession.sparkContext.broadcast(train_quality(documents, labels, folds=folds, settings=settings))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.array([model.value.score(_bytes(t.as_py())) for t in batch.column(2)], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = documents.select("doc_id", F.coalesce(fold("doc_id", folds) == 0, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
