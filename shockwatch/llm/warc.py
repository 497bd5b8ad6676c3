"""Dictionary-compressed WARC archives (.warc.zst): written, and read back.

A task trains a Zstandard dictionary from the first records of an archive (TRAIN_BYTES at most; an archive
of too few records to train from takes their last bytes as a dictionary of plain content),
writes it as a leading skippable frame, and compresses every record as a frame of its own, so any
record can be read with the dictionary alone. Archives are closed at ARCHIVE_BYTES. Files get names
of their own per attempt and are moved into place when complete; only archives in the stored list of
finished tasks count, so a repeated task leaves no double records.

Of equal payloads of at least ``revisit_from`` bytes the row with the largest page_id is a response,
the others are revisits that refer to its record. Reading checks the block digest of every record and
the payload digest of every response, and finds the page behind a reference by joining record ids.

Defined cases: null html is an empty payload; a null url becomes urn:page:<id>; rows with a null
page_id refer to the response if there is one and are responses otherwise; the same page stored twice
with one payload is a response both times; an empty table writes no archive; a record of any length
is one frame; only page_id, url and html are read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shockwatch.session import run_dir

from .common import store, text_of

MAGIC = 0x184D2A5D
FORMATTED = bytes.fromhex("37a430ec")  # how a trained dictionary begins; others are content as it is
DICTIONARY, TRAIN_BYTES, ARCHIVE_BYTES = 64 << 10, 2 << 20, 64 << 20
LEVEL, READ = 6, 64 << 10
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}').urn}>"


def record(page_id: int | None, url: str | None, payload: bytes, response: int | None, date: str = DATE) -> bytes:
    """One WARC record; a revisit if ``response`` names the page that holds the payload."""
    digest = base32_sha1(payload)
    revisit = response is not None and response != page_id
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode()) for c in url) if url else ""
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}",
            f"WARC-Target-URI: {target or f'urn:page:{page_id}'}", f"WARC-Payload-Digest: sha1:{digest}",
            f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/http; msgtype=response",
            f"Content-Length: {len(block)}"]
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(response, digest)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Fields of a record; ValueError if a length or digest does not hold."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(line[15:]) for line in http.split(b"\r\n") if line.startswith(b"Content-Length:"))
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if lines[0] != "WARC/1.1" or rest[len(block):] != b"\r\n\r\n" or (
            fields["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}") or kind == "response" and (
            base32_sha1(payload) != digest or len(payload) != length):
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    page = fields.get("Page-ID")
    return {"page_id": None if page is None else int(page), "payload_bytes": length, "payload_digest": digest,
            "record_type": kind, "record_id": fields["WARC-Record-ID"], "refers_to_record": fields.get("WARC-Refers-To"),
            "url": fields["WARC-Target-URI"], "payload": payload if kind == "response" else None}


def dictionary(records: list[bytes]) -> bytes:
    """A dictionary trained from records; where they are too few to train from, their last bytes as they are."""
    import zstandard
    try:
        return zstandard.train_dictionary(DICTIONARY, records, k=512, d=8, level=LEVEL).as_bytes()
    except zstandard.ZstdError as error:
        if "Src size" not in str(error):
            raise
    raw = b"".join(records)[-DICTIONARY:]
    return raw[1:] if raw.startswith(FORMATTED) else raw


class Archive:
    """One archive in the making: records are held until there are enough to train from."""

    def __init__(self, folder: str):
        from pyarrow import fs
        self.files, path = fs.FileSystem.from_uri(folder)
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.path, self.open_path = f"{path}/{self.name}", f"{path}/.{self.name}.open"
        self.held: list[bytes] = []
        self.waiting = self.written = self.records = 0
        self.stream = None

    def add(self, raw: bytes) -> None:
        self.records += 1
        if self.stream is None:
            self.held.append(raw)
            self.waiting += len(raw)
            if self.waiting >= TRAIN_BYTES:
                self.begin()
        else:
            self.put(self.compressor.compress(raw))

    def put(self, data: bytes) -> None:
        self.stream.write(data)
        self.written += len(data)

    def begin(self) -> None:
        import zstandard
        learned = dictionary(self.held)
        made = zstandard.ZstdCompressionDict(learned) if learned else None
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_checksum=True)
        self.files.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.stream = self.files.open_output_stream(self.open_path, compression=None)
        if learned:
            self.put(struct.pack("<II", MAGIC, len(learned)) + learned)
        for raw in self.held:
            self.put(self.compressor.compress(raw))
        self.held = []

    def close(self) -> pa.RecordBatch:
        if self.stream is None:
            self.begin()
        self.stream.close()
        self.files.move(self.open_path, self.path)
        return pa.RecordBatch.from_pydict({"archive": [self.name], "records": [self.records], "bytes": [self.written]})


def records(folder: str, name: str) -> Iterator[bytes]:
    """The records of an archive, one frame after the other."""
    import zstandard
    from pyarrow import fs
    files, path = fs.FileSystem.from_uri(folder)
    with files.open_input_stream(f"{path}/{name}", compression=None) as stream:
        pending = stream.read(READ)
        known = None
        if len(pending) >= 8 and struct.unpack("<I", pending[:4])[0] == MAGIC:
            size = struct.unpack("<I", pending[4:8])[0]
            while len(pending) < 8 + size:
                pending += stream.read(READ) or _cut(name)
            known, pending = zstandard.ZstdCompressionDict(pending[8:8 + size]), pending[8 + size:]
        reader = zstandard.ZstdDecompressor(dict_data=known)
        while pending or (pending := stream.read(READ)):
            frame, parts = reader.decompressobj(), []
            while True:
                parts.append(frame.decompress(pending))
                if frame.eof:
                    pending = frame.unused_data
                    break
                pending = stream.read(READ) or _cut(name)
            yield b"".join(parts)


def _cut(name: str) -> bytes:
    raise ValueError(f"{name} ends inside a frame")


def payload_rows(pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    """page_id, url, html, and the page that holds the response where a payload occurs several times."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        text_of("html").cast("string").alias("html"))
    digest = F.sha2(F.col("html").cast("binary"), 256)
    size = F.octet_length("html")
    several = store(rows.filter(size >= revisit_from).groupBy(digest.alias("_digest"), size.alias("_size")).agg(
        F.max("page_id").alias("response"), F.count("*").alias("_n")).filter("_n > 1").drop("_n"), "warc-several")
    return rows.withColumns({"_digest": digest, "_size": size}).join(several, ["_digest", "_size"], "left").select(
        "page_id", "url", "html", "response")


def write(pages: DataFrame, folder: str, revisit_from: int = 0, archive_bytes: int = ARCHIVE_BYTES,
          date: str = DATE) -> DataFrame:
    """Write a record per row below ``folder``; the stored list of archives: archive, records, bytes."""
    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                columns = (batch.slice(at, 256).column(c).to_pylist() for c in ("page_id", "url", "html", "response"))
                for page_id, url, html, response in zip(*columns, strict=True):
                    archive = archive or Archive(folder)
                    archive.add(record(page_id, url, html.encode(), response, date))
                    if archive.written >= archive_bytes:
                        yield archive.close()
                        archive = None
        if archive:
            yield archive.close()

    return store(payload_rows(pages, revisit_from).mapInArrow(save, "archive string, records long, bytes long"),
                 "warc-archives")


def read(spark: SparkSession, archives: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """The records of the listed archives: their fields, and the payload of responses if wanted."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "record_id", "refers_to_record", "url"]
    types = [pa.int64(), pa.int64(), *[pa.string()] * 5]
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, record_id string, " \
             "refers_to_record string, url string"
    if payloads:
        names, types, schema = [*names, "payload"], [*types, pa.binary()], schema + ", payload binary"

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in held], t) for n, t in zip(
                names, types, strict=True)], names=names)

        for batch in batches:
            for name in batch.column("archive").to_pylist():
                for raw in records(folder, name):
                    held.append(parse(raw))
                    if len(held) >= 1024:
                        yield out()
                        held.clear()
        if held:
            yield out()

    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return archives.select("archive").repartition(width).mapInArrow(load, schema)


def round_trip(pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    """Archive all pages in the shared folder and report what the archives hold, a row per page."""
    spark = pages.sparkSession
    folder = f"{run_dir(spark)}/warc-{uuid.uuid4().hex}"
    found = store(read(spark, write(pages, folder, revisit_from), folder), "warc-records")
    responses = found.filter("record_type = 'response'").groupBy("record_id").agg(F.max("page_id").alias("refers_to"))
    return found.join(responses.withColumnRenamed("record_id", "refers_to_record"), "refers_to_record", "left").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
r AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS m FROM p)
SELECT page_id, strlen(h) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((
           ('0x' || substr(x, CAST(1 + (5 * i) // 4 AS BIGINT), 2))::BIGINT >> (3 - (5 * i) % 4)) & 31) AS BIGINT), 1)), '')
           AS payload_digest,
       CASE WHEN m IS NULL OR page_id = m THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> m THEN m END AS refers_to
FROM r
"""
