"""WARC archives: written as one gzip stream each, normalised to one member a record with an offset index, and read by it."""

from __future__ import annotations

import base64
import hashlib
import json
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import delete, materialize, qualified, shared_dir

#: Payloads of fewer bytes are stored in every record.
LEAST_REVISIT = 1000
#: Bytes of records in one archive; a larger record has an archive of its own.
ARCHIVE_BYTES = 256 << 20
#: Bytes that are read, inflated or deflated at once.
CHUNK = 1 << 20
#: Copies of each repeated digest, so that the pages of a frequent payload meet their response in as many tasks.
SALTS = 64

_IDS = uuid.uuid5(uuid.NAMESPACE_URL, "warc-pages")
_CONTROL = re.compile(r"[\x00-\x20\x7f-\x9f  ]")
_LENGTH = re.compile(rb"\r\ncontent-length:[ \t]*([0-9]+)[ \t]*\r\n", re.I)
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# --- records ---------------------------------------------------------------------------------------------------------------


def record_id(page_id: int | None, digest: str) -> str:
    """The record id of a page: the same for every row of that page and payload."""
    return f"<urn:uuid:{uuid.uuid5(_IDS, f'{page_id}:{digest}')}>"


def _fields(names: dict) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in names.items() if v is not None).encode()


def response_record(page_id: int | None, url: str | None, payload: bytes, digest: str, date: str) -> bytes:
    """A response record: WARC fields, the HTTP header, the payload. digest is the payload's SHA-1 in hex."""
    head = b"HTTP/1.1 200 OK\r\n" + _fields({"Content-Type": "text/html; charset=utf-8", "Content-Length": len(payload)}) + b"\r\n"
    uri = _CONTROL.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or f"urn:page:{page_id}")
    names = {
        "WARC-Type": "response", "WARC-Record-ID": record_id(page_id, digest), "WARC-Date": date, "WARC-Target-URI": uri, "WARC-Page-ID": page_id,
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(), "Content-Type": "application/http; msgtype=response", "Content-Length": len(head) + len(payload),
    }
    return b"WARC/1.1\r\n" + _fields(names) + b"\r\n" + head + payload + b"\r\n\r\n"


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """The fields of a record, by lower-case name, and its block."""
    head, _, rest = record.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not first.startswith(b"WARC/"):
        raise ValueError(f"no WARC record: {first[:40]!r}")
    fields = {}
    for line in lines:
        name, _, value = line.partition(b":")
        fields[name.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
    return fields, rest[: int(fields["content-length"])]


def to_revisit(record: bytes, refers_to: int) -> bytes:
    """A response record as a revisit of an equal payload that page refers_to has: its HTTP header stays, the payload goes."""
    fields, block = parse(record)
    head = block[: block.index(b"\r\n\r\n") + 4]
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    names = {
        "WARC-Type": "revisit", "WARC-Record-ID": fields["warc-record-id"], "WARC-Date": fields["warc-date"], "WARC-Target-URI": fields["warc-target-uri"], "WARC-Page-ID": fields.get("warc-page-id"),
        "WARC-Payload-Digest": fields["warc-payload-digest"], "WARC-Profile": _REVISIT_PROFILE, "WARC-Refers-To": record_id(refers_to, digest), "WARC-Refers-To-Page-ID": refers_to,
        "Content-Type": fields["content-type"], "Content-Length": len(head),
    }
    return b"WARC/1.1\r\n" + _fields(names) + b"\r\n" + head + b"\r\n\r\n"


def described(record: bytes) -> dict:
    """page_id, payload_bytes, payload_digest (hex), record_type and refers_to of a record. Bytes and digest are taken from the payload
    of a response, which has to agree with its digest field, and from the fields of a revisit."""
    fields, block = parse(record)
    page = lambda name: int(fields[name]) if name in fields else None
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    at = block.index(b"\r\n\r\n") + 4
    if fields["warc-type"] == "revisit":
        length = int(_LENGTH.search(block[:at])[1])
    else:
        length = len(block) - at
        if hashlib.sha1(memoryview(block)[at:], usedforsecurity=False).hexdigest() != digest:
            raise ValueError(f"payload of {fields['warc-record-id']} doesn't have its digest")
    return {"page_id": page("warc-page-id"), "payload_bytes": length, "payload_digest": digest, "record_type": fields["warc-type"], "refers_to": page("warc-refers-to-page-id")}


def inflated(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The bytes of a gzip stream of any number of members, at most about CHUNK at a time."""
    stream = None
    for raw in chunks:
        while raw:
            if stream is None or stream.eof:
                stream = zlib.decompressobj(31)
            yield stream.decompress(raw, CHUNK)
            raw = stream.unconsumed_tail or stream.unused_data
    while stream and not stream.eof and (rest := stream.decompress(b"", CHUNK)):
        yield rest
    if stream and not stream.eof:
        raise ValueError("gzip stream ends early")


def split_records(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The records of an inflated archive, each with the two line ends that close it. Holds one record and one chunk at most."""
    buffer, need = bytearray(), 0  # need: the length of the record that the buffer begins with, 0 while its fields are incomplete
    for chunk in chunks:
        buffer += chunk
        at = 0
        while at < len(buffer):
            if not need:
                end = buffer.find(b"\r\n\r\n", at)
                if end < 0:
                    break
                length = _LENGTH.search(buffer, at, end + 2)
                if not buffer.startswith(b"WARC/", at) or not length:
                    raise ValueError(f"no WARC record: {bytes(buffer[at : at + 40])!r}")
                need = end - at + 8 + int(length[1])
            if len(buffer) - at < need:
                break
            yield bytes(buffer[at : at + need])
            at, need = at + need, 0
        del buffer[:at]
    if buffer:
        raise ValueError("archive ends within a record")


def member(record: bytes, level: int = 6) -> bytes:
    """A record as a gzip member of its own, without a time, so that equal records give equal bytes."""
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(record) + pack.flush()


# --- files -----------------------------------------------------------------------------------------------------------------


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder that driver and executors share (file, hdfs, s3, gs), and its path there."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", uri)
    return fs.FileSystem.from_uri(uri)


class _Archive:
    """An archive that a task writes under a name of its own, as one gzip stream."""

    def __init__(self, folder: str, level: int):
        self.files, at = _opened(folder)
        self.files.create_dir(at)
        self.name = f"{uuid.uuid4().hex}.warc.gz"
        self.sink = self.files.open_output_stream(posixpath.join(at, self.name), compression=None)
        self.pack, self.size, self.rows = zlib.compressobj(level, zlib.DEFLATED, 31), 0, []

    def add(self, record: bytes, page_id: int | None, digest: str, length: int) -> None:
        self.sink.write(self.pack.compress(record))
        self.rows.append((self.name, len(self.rows), page_id, digest, length))
        self.size += len(record)

    def close(self) -> pa.RecordBatch:
        self.sink.write(self.pack.flush())
        self.sink.close()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*self.rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["file", "place", "page_id", "digest", "bytes"])


def write_archives(pages: DataFrame, folder: str, *, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES, level: int = 1) -> DataFrame:
    """page_id, url, html as response records in archives of one gzip stream each: file, place, page_id, digest, bytes of every record.

    Tasks write under random names, and only names in the returned rows count, so that a repeated task adds no record twice;
    write those rows before reading an archive.
    """

    def run(batches):
        archive = None
        for batch in batches:
            for page_id, url, html in zip(*(batch.column(c) for c in ("page_id", "url", "html")), strict=True):
                payload = html.as_py() or b""
                digest = hashlib.sha1(payload, usedforsecurity=False).hexdigest()
                archive = archive or _Archive(folder, level)
                archive.add(response_record(page_id.as_py(), url.as_py(), payload, digest, date), page_id.as_py(), digest, len(payload))
                if archive.size >= archive_bytes:
                    yield archive.close()
                    archive = None
        if archive:
            yield archive.close()

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").cast("binary").alias("html"))
    return rows.mapInArrow(run, "file string, place long, page_id long, digest string, bytes long")


def revisits(records: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """file, place, refers_to of the records whose payload of at least `least` bytes a page with a larger id has too."""
    large = records.where(F.col("bytes") >= least)
    held = large.groupBy(F.col("digest").alias("of"), F.col("bytes").alias("size")).agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1")
    held = held.withColumn("with", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = large.withColumn("salt", F.pmod(F.xxhash64("file", "place"), F.lit(SALTS)).cast("int"))
    found = salted.join(held, F.expr("digest = of and bytes = size and salt = with"))
    return found.where("page_id is null or page_id < refers_to").where("refers_to is not null").select("file", "place", "refers_to")


def normalise(files: DataFrame, changes: DataFrame, source: str, target: str, *, level: int = 6) -> DataFrame:
    """Archives of `source` (files: file) rewritten into `target`, one gzip member a record: file, records, bytes of each.

    An archive is one group and its stream is inflated once, a chunk at a time, by one task, as a single stream can't be entered in
    the middle; from then on any part of it can be read alone. changes: file, place, refers_to of the records that become
    revisits. Beside each archive goes its index, <name>.index, a line of JSON with file, offset and length for each
    record. Both get their final name when they are whole, and a repeated task writes the same bytes.
    """

    def run(key: tuple, archive: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(archive):
            return pd.DataFrame({"file": [], "records": [], "bytes": []})
        name = key[0]
        refers = dict(zip(own["place"].tolist(), own["refers_to"].tolist(), strict=True))
        files_, from_ = _opened(source)
        _, to = _opened(target)
        for part in ("_writing", "archives", "index"):
            files_.create_dir(posixpath.join(to, part))
        writing = posixpath.join(to, "_writing", uuid.uuid4().hex)
        offset = records = 0
        with files_.open_input_stream(posixpath.join(from_, name), compression=None) as raw, files_.open_output_stream(writing, compression=None) as out, files_.open_output_stream(writing + ".index", compression=None) as index:
            for record in split_records(inflated(iter(lambda: raw.read(CHUNK), b""))):
                if records in refers:
                    record = to_revisit(record, refers[records])
                one = member(record, level)
                out.write(one)
                index.write((json.dumps({"file": name, "offset": offset, "length": len(one)}) + "\n").encode())
                offset, records = offset + len(one), records + 1
        files_.move(writing, posixpath.join(to, "archives", name))
        files_.move(writing + ".index", posixpath.join(to, "index", name + ".index"))
        return pd.DataFrame({"file": [name], "records": [records], "bytes": [offset]})

    files, changes = files.select(F.col("file").alias("archive")), changes.select(F.col("file").alias("of"), "place", "refers_to")
    return files.groupBy("archive").cogroup(changes.groupBy("of")).applyInPandas(run, "file string, records long, bytes long")


def read_index(spark: SparkSession, target: str) -> DataFrame:
    """file, offset, length of every record of normalised archives."""
    return spark.read.schema("file string, offset long, length long").json(f"{target}/index")


def read_records(index: DataFrame, target: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the indexed records, each inflated alone at its offset."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches):
        files_, at = _opened(target)
        name = source = None
        try:
            for batch in batches:
                found = []
                for row in batch.to_pylist():
                    if row["file"] != name:
                        if source:
                            source.close()
                        name, source = row["file"], files_.open_input_file(posixpath.join(at, "archives", row["file"]))
                    found.append(described(zlib.decompress(source.read_at(row["length"], row["offset"]), 31)))
                yield pa.RecordBatch.from_pylist(found, schema)
        finally:
            if source:
                source.close()

    return index.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, *, archive_bytes: int = ARCHIVE_BYTES, least: int = LEAST_REVISIT) -> DataFrame:
    """The records of all pages as read back from normalised archives: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Pages are written as archives of one gzip stream by the tasks that scan them, so no html is shuffled; only digests are,
    salted against a payload that many pages share. Of records with equal payloads of at least `least` bytes that of the largest
    page_id is the response and the others are revisits; smaller ones are all responses. The normaliser turns them into
    revisits while it rewrites the archives; the result is read from these by their offset indexes.

    A null html is an empty payload, a null url becomes urn:page:<id>, and control characters and blanks of a url are written as %XX. Rows
    that repeat a page_id have a record each: those of the largest id with a payload are all responses. Rows with a null
    page_id have no id field and are revisits of any page with their payload that has an id, else responses. A very long html is a
    record like any other; a task holds one record and one chunk. Other columns are ignored. An empty table gives an empty
    result. The folder of spark.checkpoint.dir has to be one that pyarrow.fs opens too. Archives stay there until the application
    ends; call the steps yourself to keep them elsewhere.
    """
    spark = pages.sparkSession
    folder = qualified(spark, f"{shared_dir(spark)}/tidemark-warc-{uuid.uuid4().hex}")
    delete(spark, folder, on_exit=True)
    records = materialize(write_archives(pages, f"{folder}/raw", archive_bytes=archive_bytes), "warc-records")
    changes = revisits(records, least)
    done = materialize(normalise(records.select("file").distinct(), changes, f"{folder}/raw", folder), "warc-files")
    delete(spark, f"{folder}/raw")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    if not done.limit(1).count():
        return spark.createDataFrame([], schema)
    return read_records(read_index(spark, folder), folder)
