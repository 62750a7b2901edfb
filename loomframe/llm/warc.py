"""WARC archives of Zstandard frames: one frame per record, the dictionary in a leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm._common import materialize, new_path

# Magic numbers of the dictionary's skippable frame and of a Zstandard frame, and the profile of a revisit.
DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: The dictionary learns from at most this many pages of at most so many bytes, and has this size.
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 300, 1 << 15, 1 << 15
#: An archive is closed when it has this many bytes.
ARCHIVE_BYTES = 1 << 26
READ_BYTES = 1 << 18
READ_TASKS = 20_000
RECORD_SCHEMA = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def train_dictionary(pages: DataFrame, id_col: str, html_col: str) -> bytes:
    """A dictionary from a bounded sample in order of id hash; its content is the sample itself where training finds too little."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    sized = pages.where(F.octet_length(html).between(1, SAMPLE_BYTES)).select(F.xxhash64(id_col, html_col).alias("h"), html.alias("html"))
    # hashes are drawn first: texts of one sample reach the driver, not those of one sample per task
    drawn = [r.h for r in sized.select("h").distinct().orderBy("h").limit(SAMPLE_PAGES).collect()]
    rows = sized.where(F.col("h") <= drawn[-1]).groupBy("h").agg(F.min("html").alias("html")).orderBy("h").collect() if drawn else []
    samples = [r.html.encode("utf-8", "surrogatepass") for r in rows]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def _uri(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(uri: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d*)>", uri)
    if not found:
        raise ValueError(f"not a page's record id: {uri}")
    return int(found[1]) if found[1] else None


def encode_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A response with its payload, or a revisit (``refers_to`` given) with the HTTP header alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_uri(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest_of(payload)}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_uri(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(lines: list[bytes], where: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.decode("utf-8", "surrogatepass").partition(":")
        if not colon or not name or name != name.strip() or name.lower() in out:
            raise ValueError(f"{where}: bad header {line[:80]!r}")
        out[name.lower()] = value.strip()
    return out


def _length(headers: dict[str, str], where: str) -> int:
    if not re.fullmatch(r"\d+", headers.get("content-length", "")):
        raise ValueError(f"{where}: no content length")
    return int(headers["content-length"])


def decode_record(data: bytes, where: str) -> dict:
    """One record's fields; a ValueError names the place if version, headers, lengths or payload digest are wrong."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not mark or first not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError(f"{where}: not a WARC record")
    h = _headers(lines, where)
    for name in ("warc-type", "warc-record-id", "warc-date", "warc-payload-digest"):
        if name not in h:
            raise ValueError(f"{where}: no {name}")
    if _length(h, where) != len(rest) - 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError(f"{where}: the block has {len(rest) - 4} bytes, not {h['content-length']}")
    http, mark, payload = rest[:-4].partition(b"\r\n\r\n")
    status, *lines = http.split(b"\r\n")
    if not mark or not status.startswith(b"HTTP/"):
        raise ValueError(f"{where}: no HTTP header")
    size = _length(_headers(lines, where), where)
    kind, digest = h["warc-type"], h["warc-payload-digest"].removeprefix("sha1:")
    if kind not in ("response", "revisit") or (kind == "revisit") != ("warc-refers-to" in h):
        raise ValueError(f"{where}: {kind} with wrong headers")
    if kind == "response" and (len(payload) != size or digest_of(payload) != digest):
        raise ValueError(f"{where}: the payload is not what its headers say")
    url = h.get("warc-target-uri")
    return {
        "page_id": _page(h["warc-record-id"]),
        "url": None if url is None else re.sub(r"%([01][0-9A-F]|20|7F|25)", lambda m: chr(int(m[1], 16)), url),
        "record_type": kind,
        "payload_digest": digest,
        "payload_bytes": size,
        "refers_to": _page(h["warc-refers-to"]) if kind == "revisit" else None,
        "payload": payload if kind == "response" else None,
    }


class _Archives:
    """The archives of one attempt of a task. Names hold the attempt, so another attempt never replaces what a manifest lists."""

    def __init__(self, folder: str, dictionary: bytes, archive_bytes: int = ARCHIVE_BYTES):
        self.fs, self.folder = pyarrow.fs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.uri, self.dictionary, self.archive_bytes = folder, dictionary, archive_bytes
        kept = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.packer = zstandard.ZstdCompressor(level=3, dict_data=kept, write_checksum=True, write_content_size=True)
        task = TaskContext.get()
        self.part, self.attempt = (task.partitionId(), task.taskAttemptId()) if task else (0, 0)
        self.n, self.out = 0, None

    def add(self, record: bytes) -> tuple[str, int, int] | None:
        if self.out is None:
            self.name = f"part-{self.part:06d}-{self.attempt}-{self.n:04d}.warc.zst"
            self.out = self.fs.open_output_stream(f"{self.folder}/.{self.name}", compression=None)
            self.size = self.records = 0
            if self.dictionary:
                self._put(struct.pack("<II", DICTIONARY_MAGIC, len(self.dictionary)) + self.dictionary)
        self._put(self.packer.compress(record))
        self.records += 1
        return self.close() if self.size >= self.archive_bytes else None

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> tuple[str, int, int] | None:
        if self.out is None:
            return None
        self.out.close()
        self.fs.move(f"{self.folder}/.{self.name}", f"{self.folder}/{self.name}")
        self.out, self.n = None, self.n + 1
        return f"{self.uri}/{self.name}", self.records, self.size


def write_archives(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write one record per page under ``folder`` and return (path, records, bytes) of the archives.

    Of pages with equal payloads of ``least_bytes`` bytes or more the one with the largest id is a response, and the
    others revisit it; rows that repeat that id are responses too. Null html is an empty payload. Pages without an id are
    responses if no page with an id has their payload. An empty table writes no archive. A lost task writes its archives
    again under names of its own; the manifest, written when a task commits, names those that count.
    """
    dictionary = train_dictionary(pages, id_col, html_col)
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"))
    digest = F.sha1(F.col("html").cast("binary"))
    many = rows.where(F.octet_length("html") >= least_bytes).groupBy(digest.alias("digest")).agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = rows.withColumn("of", digest).join(many, F.col("of") == F.col("digest"), "left")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("kept")), F.col("kept"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archives, done = _Archives(folder, dictionary, archive_bytes), []
        for batch in batches:
            for page_id, url, text, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                done.append(archives.add(encode_record(page_id, url, text.encode("utf-8", "surrogatepass"), refers_to, date)))
        done.append(archives.close())
        kept = [x for x in done if x]
        yield pa.RecordBatch.from_pylist([dict(zip(("path", "records", "bytes"), x)) for x in kept], schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return materialize(joined.select("page_id", "url", "html", refers.alias("refers_to")).mapInArrow(run, "path string, records long, bytes long"), "warc-manifest")


def read_frames(stream, where: str) -> Iterator[tuple[int, bytes]]:
    """(record number, record) of an open archive, one frame at a time; only one record is held."""
    data = stream.read(8)
    unpacker = zstandard.ZstdDecompressor()
    if len(data) == 8 and struct.unpack("<I", data[:4])[0] == DICTIONARY_MAGIC:
        size = struct.unpack("<I", data[4:])[0]
        kept = stream.read(size)
        if len(kept) != size:
            raise ValueError(f"{where}: the dictionary is cut short")
        if kept[:4] == struct.pack("<I", FRAME_MAGIC):
            kept = unpacker.decompressobj().decompress(kept)
        unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(kept))
        data = b""
    number = 0
    while data or (data := stream.read(READ_BYTES)):
        frame, parts = unpacker.decompressobj(), []
        while True:
            parts.append(frame.decompress(data))
            if frame.eof:
                data = frame.unused_data
                break
            if not (data := stream.read(READ_BYTES)):
                raise ValueError(f"{where}: record {number} is cut short")
        yield number, b"".join(parts)
        number += 1


def read_archives(manifest: DataFrame) -> DataFrame:
    """Records of the archives in column ``path``: page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload.

    A revisit's payload is null; its digest and size are those of the page it stands for. There are as many tasks as
    archives, up to READ_TASKS, and each streams its archives. Damaged archives raise a ValueError that names the place.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = pyarrow.fs.FileSystem.from_uri(path)
                held, size = [], 0
                with fs.open_input_stream(name, compression=None) as stream:
                    for number, data in read_frames(stream, path):
                        held.append(decode_record(data, f"{path}, record {number}"))
                        size += len(data)
                        if size >= 1 << 23 or len(held) >= 2000:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)

    # a number of its own, or AQE would put all archives of the tiny manifest into one task
    return manifest.select("path").repartition(max(1, min(READ_TASKS, manifest.count())), "path").mapInArrow(run, RECORD_SCHEMA)


def roundtrip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read all records back."""
    return read_archives(write_archives(pages, new_path(spark, "warc")))
