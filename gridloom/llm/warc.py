"""WARC archives in Zstandard form: a dictionary in the leading skippable frame, a frame per record.

``write_archives`` writes pages as archives into a shared folder and returns their manifest;
``read_archives`` reads the records back, frame by frame, and checks headers and lengths.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, written

VERSION = b"WARC/1.1"
#: Magic number of the skippable frame that holds the dictionary, and of a Zstandard frame.
DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
#: Payload bytes in an archive, records that its dictionary is trained on, and dictionary bytes.
ARCHIVE_BYTES, SAMPLE_RECORDS, DICTIONARY_BYTES = 32_000_000, 200, 16_384
_CHUNK = 65_536


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def page_of(record: str) -> int | None:
    name = record.removeprefix("<urn:page:").removesuffix(">")
    return None if name == "null" else int(name)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _block(headers: list[tuple[str, str]], body: bytes) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in headers).encode() + b"\r\n" + body


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, response: bool, refers_to: int | None) -> bytes:
    """A response with its payload, or a revisit whose block is the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if response else http
    headers = [
        ("WARC-Type", "response" if response else "revisit"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", DATE),
        *([("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%~"))] if url else []),
        ("WARC-Payload-Digest", "sha1:" + digest),
        *([] if response else [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to))]),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return VERSION + b"\r\n" + _block(headers, block) + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Fields of a decoded record; raises ``ValueError`` where headers or lengths are wrong."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or lines[0] != VERSION:
        raise ValueError("not a WARC/1.1 record")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError(f"header without a colon: {line[:80]!r}")
        headers[name.decode().lower()] = value.decode().strip()
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length"} - headers.keys()
    if missing:
        raise ValueError(f"headers missing: {sorted(missing)}")
    size = int(headers["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"{headers['warc-record-id']}: Content-Length is {size}, the frame holds {len(rest) - 4}")
    http, found, payload = rest[:size].partition(b"\r\n\r\n")
    if not found or not http.startswith(b"HTTP/1.1 "):
        raise ValueError(f"{headers['warc-record-id']}: no HTTP header")
    told = next((int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
    kind, digest = headers["warc-type"], headers.get("warc-payload-digest", "")
    if kind == "response":
        if told != len(payload) or digest != "sha1:" + sha1_base32(payload):
            raise ValueError(f"{headers['warc-record-id']}: payload and its length or digest disagree")
    elif kind != "revisit" or headers.get("warc-profile") != PROFILE or payload or "warc-refers-to" not in headers or told is None:
        raise ValueError(f"{headers['warc-record-id']}: unknown or incomplete {kind}")
    return {
        "page_id": page_of(headers["warc-record-id"]),
        "url": headers.get("warc-target-uri"),
        "record_type": kind,
        "payload": payload if kind == "response" else None,
        "payload_bytes": told,
        "payload_digest": digest.removeprefix("sha1:"),
        "refers_to": page_of(headers["warc-refers-to"]) if kind == "revisit" else None,
    }


def train_dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A trained dictionary, or the samples themselves as raw content where they are too few."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=3)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-DICTIONARY_BYTES:] or b"WARC/1.1\r\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def dictionary_frame(dictionary: zstandard.ZstdCompressionDict) -> bytes:
    data = zstandard.ZstdCompressor(level=9).compress(dictionary.as_bytes())
    return struct.pack("<II", DICTIONARY_MAGIC, len(data)) + data


def read_dictionary(read: Callable[[int], bytes]) -> zstandard.ZstdCompressionDict:
    """From the leading skippable frame, whose content may itself be a Zstandard frame."""
    head = read(8)
    if len(head) < 8:
        raise ValueError("no leading frame")
    magic, size = struct.unpack("<II", head)
    if magic != DICTIONARY_MAGIC:
        raise ValueError(f"leading frame has magic number {magic:#x}")
    data = read(size)
    if len(data) != size:
        raise ValueError("the dictionary frame is cut off")
    if data[:4] == struct.pack("<I", FRAME_MAGIC):
        data = zstandard.ZstdDecompressor().decompress(data)
    return zstandard.ZstdCompressionDict(data)


def read_frames(read: Callable[[int], bytes]) -> Iterator[bytes]:
    """The content of each frame after the dictionary, with one frame in memory at a time."""
    plain = zstandard.ZstdDecompressor(dict_data=read_dictionary(read))
    left = b""
    while left or (left := read(_CHUNK)):
        frame, parts = plain.decompressobj(), []
        while not frame.eof:
            if not left and not (left := read(_CHUNK)):
                raise ValueError("the last frame is cut off")
            parts.append(frame.decompress(left))
            left = frame.unused_data if frame.eof else b""
        yield b"".join(parts)


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)


class _Archive:
    """An archive that is being written: the first records wait until the dictionary is trained."""

    def __init__(self, folder: str):
        self.system, place = _file_system(folder)
        self.system.create_dir(place, recursive=True)
        self.name = f"{uuid.uuid4().hex}.warc.zst"  # an attempt that fails leaves a file that no manifest names
        self.out = self.system.open_output_stream(f"{place}/{self.name}")
        self.waiting: list[bytes] = []
        self.press = None
        self.records = self.payload = self.size = 0

    def add(self, record: bytes) -> None:
        self.records += 1
        self.payload += len(record)
        if self.press is None:
            self.waiting.append(record)
            if len(self.waiting) >= SAMPLE_RECORDS or self.payload >= ARCHIVE_BYTES // 4:
                self._start()
        else:
            self._put(self.press.compress(record))

    def _put(self, data: bytes) -> None:
        self.size += len(data)
        self.out.write(data)

    def _start(self) -> None:
        dictionary = train_dictionary(self.waiting)
        self._put(dictionary_frame(dictionary))
        self.press = zstandard.ZstdCompressor(level=3, dict_data=dictionary)
        for record in self.waiting:
            self._put(self.press.compress(record))
        self.waiting = []

    def close(self) -> dict:
        if self.press is None:
            self._start()
        self.out.close()
        return {"archive": self.name, "records": self.records, "bytes": self.size}


#: A digest of more than this share of the repeated payloads is common; there are at most 1 / HOT.
HOT = 0.001


def with_digests(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``payload`` (html in UTF-8, null as empty), ``sha1`` (hexadecimal)."""
    return pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary")).alias("payload")).withColumn("sha1", F.sha1("payload"))


def with_record_types(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Add ``first``: of rows with equal payloads of at least ``least_bytes``, the largest page_id.

    Sums by digest are made before rows move. Digests of more than ``HOT`` of all rows, which
    are few, are broadcast, so that a common page's rows stay where they are; only the others
    are joined by a shuffle.
    """
    keyed = with_digests(pages)
    counts = keyed.where(F.length("payload") >= least_bytes).groupBy(F.col("sha1").alias("_sha1")).agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    several = written(counts.where("n > 1"), "warc-several")
    total = several.agg(F.sum("n")).first()[0] or 0
    common = F.col("n") > HOT * total
    marked = keyed.join(F.broadcast(several.where(common)), F.col("sha1") == F.col("_sha1"), "left")
    rest = marked.where("n is null").drop("_sha1", "first", "n").join(several.where(~common), F.col("sha1") == F.col("_sha1"), "left")
    return marked.where("n is not null").unionByName(rest).drop("_sha1", "n")


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) into archives under ``folder``;
    returns their manifest: ``archive``, ``records``, ``bytes``.

    A task writes its own archives, under names of its own, and starts another after
    ``ARCHIVE_BYTES``; only archives that the manifest names count, so a repeated task does no
    harm. Null html is an empty payload. Rows that share both payload and the largest page_id are
    all responses; a null page_id is a revisit where another page has the payload.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, done = None, []
        for batch in batches:
            for row in range(batch.num_rows):
                page, url, payload, digest, first = (batch.column(c)[row].as_py() for c in ("page_id", "url", "payload", "sha1", "first"))
                response = first is None or first == page
                archive = archive or _Archive(folder)
                archive.add(make_record(page, url, payload, base64.b32encode(bytes.fromhex(digest)).decode(), response, None if response else first))
                if archive.payload >= ARCHIVE_BYTES:
                    done.append(archive.close())
                    archive = None
        if archive:
            done.append(archive.close())
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return written(with_record_types(pages, least_bytes).select("page_id", "url", "payload", "sha1", "first").mapInArrow(run, "archive string, records long, bytes long"), "warc-manifest")


#: What ``read_archives`` returns.
RECORD = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"
_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])


def read_archives(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the archives that ``manifest`` names, validated; ``payloads=False`` leaves
    the payloads out once they have been checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = _file_system(folder)
        for batch in batches:
            for name, records in zip(batch.column("archive").to_pylist(), batch.column("records").to_pylist(), strict=True):
                rows, size, n = [], 0, 0
                with system.open_input_stream(f"{place}/{name}") as source:
                    for data in read_frames(source.read):
                        row = parse_record(data)
                        n += 1
                        if not payloads:
                            row["payload"] = None
                        rows.append(row)
                        size += len(row["payload"] or b"") + 200
                        if size > 4_000_000:
                            yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)
                            rows, size = [], 0
                if n != records:
                    raise ValueError(f"{name}: {n} records, {records} were written")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)

    spread = manifest.repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism))
    return spread.mapInArrow(run, RECORD)


def archived(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read their records back."""
    folder = fresh_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder), folder, payloads=False)
