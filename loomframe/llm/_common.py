"""Helpers shared by the training-data operators: shared storage, folds, numpy text hashing."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Regular expression for the separators between words: space and the ASCII controls 0x09-0x0D.
SPACE = r"[\x20\x09-\x0D]+"

#: Rows and bytes of an Arrow batch on its way to Python and back.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20

_OWN_DIRS: dict[str, str] = {}
_WRITTEN: list[tuple[SparkSession, str]] = []


def _one_process(spark: SparkSession) -> bool:
    return bool(re.match(r"local($|\[)", spark.conf.get("spark.master", "")))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``, or a temporary one where it is unset and Spark is one process."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not _one_process(spark):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = "file://" + tempfile.mkdtemp(prefix="loomframe-")
    return _OWN_DIRS[app]


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; removed when this Python process ends."""
    path = f"{shared_dir(spark)}/loomframe/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"
    _WRITTEN.append((spark, path))
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: lineage ends there, a lost executor costs nothing.

    On a cluster the shuffle files behind the table are let go.

    The result has the same rows and columns; an empty input gives an empty table.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    with _small_batches(spark):
        df.write.parquet(path)
    # shuffle files go when the driver's JVM collects the finished plan; unasked, it may hold them for half an hour
    if not _one_process(spark):
        spark._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._loomframe_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``materialize`` wrote and nothing reads any more."""
    for table in tables:
        _remove(table.sparkSession, table._loomframe_path)


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """While a table is written, Arrow batches hold BATCH_ROWS rows and about BATCH_BYTES bytes at most, not 10,000 texts."""
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
    before = {k: spark.conf.get(k, None) for k in limits}
    for k, v in limits.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def _remove(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


@atexit.register
def _remove_written() -> None:
    for spark, path in _WRITTEN:
        try:
            _remove(spark, path)
        except Exception:  # the JVM may be gone already; the folder is the cluster's scratch space
            return


def fold(doc_id: str, k: int) -> Column:
    """crc32 of the id's decimal text modulo ``k``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % k


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- numpy text hashing -------------------------------------------------------------------------------------------

_MIX_A, _MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _POWERS[k] = np.multiply.accumulate(out)
    return _POWERS[0][:n], _POWERS[1][:n]


def byte_prefix_hash(raw: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash: any byte range hashes as a difference times an inverse power."""
    power, _ = _powers(len(raw))
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE_CODE[raw] * power, out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges [start, end) of the text behind ``prefix``; equal bytes give equal hashes."""
    _, inverse = _powers(len(prefix))
    x = (prefix[end] - prefix[start]) * inverse[start]
    return (x ^ (x >> np.uint64(32))) * _MIX_A


#: Marks the bytes that separate words.
SPACE_BYTES = bytes(int(b == 0x20 or 0x09 <= b <= 0x0D) for b in range(256))


def word_bounds(data: bytes, separators: bytes = SPACE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the maximal runs of bytes that ``separators`` marks with 0."""
    mark = np.frombuffer(b"\x01" + data.translate(separators) + b"\x01", np.uint8)
    edge = np.flatnonzero(mark[1:] != mark[:-1])
    return edge[::2], edge[1::2]


def word_hashes(text: str | None) -> np.ndarray:
    """One 64-bit hash per word, A-Z lower-cased; none for a null text."""
    if not text:
        return np.empty(0, np.uint64)
    data = text.encode("utf-8", "surrogatepass").lower()
    start, end = word_bounds(data)
    if not len(start):
        return np.empty(0, np.uint64)
    return range_hash(byte_prefix_hash(np.frombuffer(data, np.uint8)), start, end)


def sorted_distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the ``words``-word shingles; a shorter text is one shingle; no word, none."""
    h = word_hashes(text)
    if not len(h):
        return h
    width = min(words, len(h))
    out = np.full(len(h) - width + 1, np.uint64(width), np.uint64)
    for k in range(width):
        out *= _BASE
        out += h[k : len(h) - width + 1 + k]
        out ^= out >> np.uint64(31)
    return sorted_distinct(mix(out))
