"""WARC archives compressed with Zstandard: one frame per record and a shared dictionary.

An archive begins with a skippable frame that holds the dictionary. Each record is a frame
of its own, so a reader holds one record at a time.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import chunks, shared_folder, stored

# The formats' magic numbers, names and line ends.
DICTIONARY_FRAME = 0x184D2A5D
ZSTD_FRAME = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("WARC-Record-ID", "Content-Length", "WARC-Date", "WARC-Type")

# A new archive is begun after so many bytes; the dictionary is trained on its first
# records, up to so many bytes of them.
ARCHIVE_BYTES = 256 << 20
SAMPLE_BYTES = 1 << 20
DICTIONARY_BYTES = 16 << 10


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- records ----------------------------------------------------------------------------


def _id(page: int | None) -> str:
    return f"<urn:page:{'null' if page is None else page}>"


def _page(record_id: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+|null)>", record_id)
    if found is None:
        raise ValueError(f"record id {record_id!r}")
    return None if found[1] == "null" else int(found[1])


def make_record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """A response record, or a revisit record, whose block ends before the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": _id(page),
        "WARC-Date": date,
        "WARC-Payload-Digest": f"sha1:{payload_digest(payload)}",
        "WARC-Block-Digest": f"sha1:{payload_digest(block)}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if url is not None:  # blanks and control characters may not stand in a field
        fields["WARC-Target-URI"] = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    if revisit:
        fields |= {"WARC-Refers-To": _id(refers_to), "WARC-Profile": PROFILE}
    head = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode()
    return head + b"\r\n" + block + b"\r\n\r\n"


class Record(NamedTuple):
    page: int | None
    url: str | None
    type: str
    payload: bytes | None
    payload_bytes: int
    payload_digest: str
    refers_to: int | None


def _fields(lines: list[bytes]) -> dict[str, str]:
    found = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not re.fullmatch(rb"[!#$%&'*+\-.^_`|~0-9A-Za-z]+", name):
            raise ValueError(f"header line {line[:80]!r}")
        found[name.decode().lower()] = value.strip().decode()
    return found


def _number(fields: dict[str, str], name: str) -> int:
    value = fields.get(name.lower(), "")
    if not re.fullmatch(r"[0-9]+", value):
        raise ValueError(f"{name} {value!r}")
    return int(value)


def read_record(data: bytes) -> Record:
    """Check the headers, lengths and digests of a record; ValueError where one is wrong."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in (VERSION, b"WARC/1.0"):
        raise ValueError("no WARC header")
    fields = _fields(lines[1:])
    for name in MANDATORY:
        if name.lower() not in fields:
            raise ValueError(f"no {name}")
    length = _number(fields, "Content-Length")
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length {length}, but the block and its end have {len(rest)} bytes")
    block = rest[:length]
    if fields.get("warc-block-digest", f"sha1:{payload_digest(block)}") != f"sha1:{payload_digest(block)}":
        raise ValueError("block digest")
    kind = fields["warc-type"]
    if kind not in ("response", "revisit"):
        raise ValueError(f"record type {kind!r}")
    http, gap, body = block.partition(b"\r\n\r\n")
    status = http.split(b"\r\n")
    if not gap or not status[0].startswith(b"HTTP/"):
        raise ValueError("no HTTP header")
    size = _number(_fields(status[1:]), "Content-Length")
    if len(body) != (0 if kind == "revisit" else size):
        raise ValueError(f"HTTP Content-Length {size}, but {len(body)} bytes")
    digest = fields.get("warc-payload-digest", "")
    if kind == "response" and digest != f"sha1:{payload_digest(body)}":
        raise ValueError("payload digest")
    return Record(
        _page(fields["warc-record-id"]), fields.get("warc-target-uri"), kind,
        body if kind == "response" else None, size, digest.removeprefix("sha1:"),
        _page(fields["warc-refers-to"]) if kind == "revisit" else None,
    )


# --- archives ---------------------------------------------------------------------------


def _dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:  # too few samples to train on: their text itself
        return zstandard.ZstdCompressionDict(
            b"".join(samples)[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT
        )


class ArchiveWriter:
    """Writes one archive under a temporary name and renames it when it is whole."""

    def __init__(self, uri: str) -> None:
        self.files, self.path = pafs.FileSystem.from_uri(uri)
        self.uri, self.records, self.bytes = uri, 0, 0
        self.waiting: list[bytes] | None = []
        self.sampled = 0
        self.files.create_dir(self.path.rpartition("/")[0], recursive=True)
        task = TaskContext.get()
        self.temporary = f"{self.path}.{task.taskAttemptId() if task else 0}.tmp"
        self.out = self.files.open_output_stream(self.temporary, compression=None)

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def _begin(self) -> None:
        trained = _dictionary(self.waiting)
        packed = zstandard.ZstdCompressor().compress(trained.as_bytes())
        self._write(struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed)
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=trained, write_checksum=True)
        waiting, self.waiting = self.waiting, None
        for record in waiting:
            self._write(self.compressor.compress(record))

    def add(self, record: bytes) -> None:
        self.records += 1
        if self.waiting is None:
            self._write(self.compressor.compress(record))
            return
        self.waiting.append(record)
        self.sampled += len(record)
        if self.sampled >= SAMPLE_BYTES:
            self._begin()

    def close(self) -> dict:
        if self.waiting is not None:
            self._begin()
        self.out.close()
        self.files.move(self.temporary, self.path)
        return {"archive": self.uri, "records": self.records, "bytes": self.bytes}


def read_archive(uri: str, block: int = 1 << 20) -> Iterator[Record]:
    """The records of an archive, one at a time; ValueError names what is wrong in which."""
    files, path = pafs.FileSystem.from_uri(uri)
    with files.open_input_stream(path, compression=None) as source:
        head = source.read(8)
        if len(head) < 8 or struct.unpack("<I", head[:4])[0] != DICTIONARY_FRAME:
            raise ValueError(f"{uri}: no dictionary frame")
        size = struct.unpack("<I", head[4:])[0]
        content = source.read(size)
        if len(content) != size:
            raise ValueError(f"{uri}: dictionary frame cut off")
        if content[:4] == ZSTD_FRAME:  # the dictionary may be compressed
            content = zstandard.ZstdDecompressor().decompress(content)
        # A dictionary with tables has its own magic number; anything else is text.
        decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
        data, number = b"", 0
        while True:
            data = data or source.read(block)
            if not data:
                return
            frame, pieces = decompressor.decompressobj(), []
            try:
                while not frame.eof:
                    if not data:
                        data = source.read(block)
                        if not data:
                            raise ValueError("frame cut off")
                    pieces.append(frame.decompress(data))
                    data = frame.unused_data if frame.eof else b""
                yield read_record(b"".join(pieces))
            except (ValueError, zstandard.ZstdError) as wrong:
                raise ValueError(f"{uri}, record {number}: {wrong}") from wrong
            number += 1


# --- the operators ----------------------------------------------------------------------

ARCHIVES = "archive string, records bigint, bytes bigint"
RECORDS = (
    "page_id bigint, url string, record_type string, payload binary, payload_bytes bigint, "
    "payload_digest string, refers_to bigint"
)


def write_archives(
    df: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html",
    least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z",
) -> DataFrame:
    """Write a record per row into archives below `folder` (a path that all executors see)
    and return one row per archive.

    Of rows with equal payloads of at least `least_bytes` bytes that with the smallest id is
    a response, the others are revisits of it. A NULL payload is empty. Rows without id come
    after all others; among rows without id alone all are responses, as are rows that share
    the smallest id. A NULL url has no field. Other columns are ignored.
    """
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    rows = df.select(
        F.col(key).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"),
        F.sha1(payload).alias("_digest"),
    )
    # Stored, so that the join can split a payload that very many rows share.
    firsts = stored(
        df.select(F.col(key).cast("bigint").alias("page_id"), F.length(payload).alias("_n"), F.sha1(payload).alias("_digest"))
        .filter(F.col("_n") >= least_bytes)
        .groupBy("_digest").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_rows"))
        .filter("_rows > 1").select("_digest", "_first"),
        "warc-firsts",
    )
    revisit: Column = F.col("_first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("_first")))
    told = rows.join(firsts, "_digest", "left").select("page_id", "url", "payload", "_first", revisit.alias("_revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done, writer = TaskContext.get().partitionId(), [], None
        for batch in chunks(batches, "payload"):
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "_first", "_revisit")]
            for page, address, body, first, again in zip(*columns):
                writer = writer or ArchiveWriter(f"{folder}/part-{part:06d}-{len(done):04d}.warc.zst")
                writer.add(make_record(page, address, body, first, bool(again), date))
                if writer.bytes >= ARCHIVE_BYTES:
                    done.append(writer.close())
                    writer = None
        if writer:
            done.append(writer.close())
        if done:
            yield pa.RecordBatch.from_pylist(done)

    return stored(told.mapInArrow(run, ARCHIVES), "warc-archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of archives, given a table with their paths in `archive`.

    Returns page_id, url, record_type, payload (NULL for revisits), payload_bytes and
    payload_digest (both of the full payload), refers_to. A record with wrong headers,
    lengths or digests is an error that names the archive.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.strip().split(" ")[0] for x in RECORDS.split(",")]
        schema = pa.schema([
            pa.field(n, t) for n, t in zip(
                names, (pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64())
            )
        ])
        for batch in batches:
            for uri in batch.column("archive").to_pylist():
                rows, size = [], 0
                for record in read_archive(uri):
                    rows.append(record)
                    size += len(record.payload or b"") + 200
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    number = max(archives.count(), 1)
    return archives.select("archive").repartition(number).mapInArrow(run, RECORDS)


def archive_round_trip(df: DataFrame, **options) -> DataFrame:
    """Write rows into archives in the shared folder and read them back."""
    folder = shared_folder(df.sparkSession, "warc")
    return read_archives(write_archives(df, folder, **options))
