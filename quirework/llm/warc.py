"""WARC archives as a chunked record table.

A record is one or more rows (record identifier, chunk number, bytes): small records are one row; the payload of an
oversized one goes out CHUNK bytes at a time, each row with the SHA-1 of the payload up to there, so that neither writer
nor reader holds a second copy of a whole record. Each record's rows, one after another, are one gzip member of a
standard WARC/1.1 file. Readers take one-row records as they come; rows of oversized ones are dealt by record, sorted by
chunk number and read as a stream, and every running digest is verified.

Of equal payloads of at least SMALLEST bytes the record with the largest page id is a response; the others are revisits
that refer to it and carry no payload (their HTTP header keeps its length, their WARC header its digest). Payloads are
equal if length, SHA-1 and SHA-256 are.

Edge cases: null html is an empty payload; empty and short payloads are always responses; a null url has no target
header; a null page id is the smallest; rows repeated in every column are separate records, of which one is the
response; other columns are not read. An empty table gives an empty archive. `pages` must be a deterministic read (a
stored table), as it is scanned twice. A record that lacks a row (the first, one between, or the last), has one twice or has
changed bytes stops the reading with an error; only a record all of whose rows are gone leaves no sign.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, kept, materialise, new_path, ship, small_or_not

#: Payload bytes of a row; records with more payload have several rows.
CHUNK = 1 << 20
#: Payloads under this are never revisits.
SMALLEST = 1000
ROWS = "record string, chunk int, last boolean, data binary, payload_sha1 string"
_DIGESTS = "uid long, page_id long, n long, sha1 binary, sha256 binary"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def record_id(page_id: int | None, uid: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}:{uid}')}>"


def _payloads(column: pa.Array) -> Iterator[memoryview]:
    """Views of the values' UTF-8 bytes in the batch's own buffer; null is empty."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = memoryview(column.buffers()[2] or b"")
    for a, b, ok in zip(offsets[:-1].tolist(), offsets[1:].tolist(), column.is_valid().to_pylist(), strict=True):
        yield body[a:b] if ok else memoryview(b"")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept("warc")
    for batch in batches:
        sizes, one, two = [], [], []
        for payload in _payloads(batch.column("html")):
            sizes.append(len(payload))
            one.append(hashlib.sha1(payload, usedforsecurity=False).digest())
            two.append(hashlib.sha256(payload).digest())
        yield pa.record_batch([batch.column("uid"), batch.column("page_id"), pa.array(sizes, pa.int64()), pa.array(one, pa.binary()), pa.array(two, pa.binary())], names=["uid", "page_id", "n", "sha1", "sha256"])


def _head(row: dict, size: int, digest: bytes) -> bytes:
    """The WARC header and the HTTP header of a record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    revisit = row["ref_uid"] is not None
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(row["page_id"], row["uid"])),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", None if row["url"] is None else "".join(c if c > " " else f"%{ord(c):02X}" for c in row["url"])),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(digest).decode()),
        ("Page-ID", row["page_id"]),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(http) + (0 if revisit else size)),
    ]
    if revisit:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(row["ref_page_id"], row["ref_uid"])), ("Refers-To-Page-ID", row["ref_page_id"])]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None).encode() + b"\r\n" + http


def _write(chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.string(), pa.int32(), pa.bool_(), pa.binary(), pa.string())
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["record", "chunk", "last", "data", "payload_sha1"])

        for batch in batches:
            rows, size = [], 0
            light = batch.drop_columns(["html"]).to_pylist()
            for row, payload in zip(light, _payloads(batch.column("html")), strict=True):
                name = record_id(row["page_id"], row["uid"])
                whole = hashlib.sha1(payload, usedforsecurity=False)
                parts = [] if row["ref_uid"] is not None else [payload[i : i + chunk] for i in range(0, len(payload), chunk)]
                press, running = zlib.compressobj(1, wbits=31), hashlib.sha1(usedforsecurity=False)
                head = press.compress(_head(row, len(payload), whole.digest()))
                for i, part in enumerate(parts or [b""]):
                    running.update(part)
                    last = i + 1 >= len(parts)
                    data = head + press.compress(part) + (press.compress(b"\r\n\r\n") + press.flush() if last else press.flush(zlib.Z_SYNC_FLUSH))
                    rows.append((name, i, last, data, running.hexdigest()))
                    head, size = b"", size + len(data)
                    if size > chunk:
                        yield out(rows)
                        rows, size = [], 0
            if rows:
                yield out(rows)

    return run


class Reader:
    """Reads one record from its rows, in order; payload bytes pass through and are not kept."""

    def __init__(self):
        self.inflate, self.head, self.fields = zlib.decompressobj(wbits=31), b"", None
        self.running = hashlib.sha1(usedforsecurity=False)
        self.size = self.left = 0

    def row(self, data: bytes, last: bool, sha1: str) -> tuple | None:
        """Take the next row; the record's (page_id, payload_bytes, payload_digest, record_type, refers_to) at the end."""
        data = self.inflate.decompress(data)
        if self.fields is None:
            warc, cut, rest = (self.head + data).partition(b"\r\n\r\n")
            http, cut2, body = rest.partition(b"\r\n\r\n")
            if not cut or not cut2:
                raise ValueError("a record's first row ends within its headers")
            lines = warc.decode().split("\r\n")[1:]
            self.fields = dict(x.split(": ", 1) for x in lines)
            self.http = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
            self.left = int(self.fields["Content-Length"]) - len(http) - 4
            data = body
        part = data[: self.left]
        self.left -= len(part)
        self.size += len(part)
        self.running.update(part)
        revisit = self.fields["WARC-Type"] == "revisit"
        if not revisit and self.running.hexdigest() != sha1:
            raise ValueError(f"record {self.fields['WARC-Record-ID']}: a running digest differs")
        if not last:
            return None
        digest = base64.b32decode(self.fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        if self.left or not revisit and digest != self.running.hexdigest():
            raise ValueError(f"record {self.fields['WARC-Record-ID']}: the payload is not what its header says")
        number = lambda x: None if x is None else int(x)
        return number(self.fields.get("Page-ID")), int(self.http["Content-Length"]) if revisit else self.size, digest, self.fields["WARC-Type"], number(self.fields.get("Refers-To-Page-ID"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    readers: dict[str, tuple[Reader, int]] = {}
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    for batch in batches:
        rows = []
        for record, chunk, last, data, sha1 in zip(batch.column("record").to_pylist(), batch.column("chunk").to_pylist(), batch.column("last").to_pylist(), batch.column("data"), batch.column("payload_sha1").to_pylist(), strict=True):
            reader, wanted = readers.pop(record, None) or (Reader(), 0)
            if chunk != wanted:
                raise ValueError(f"record {record}: chunk {wanted} is missing or comes twice")
            if readers:  # rows of a record stand together, in order: another one must have ended
                raise ValueError(f"record {next(iter(readers))}: its last chunk is missing")
            done = reader.row(data.as_py(), last, sha1)
            if done is None:
                readers[record] = reader, chunk + 1
            else:
                rows.append(done)
        if rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
    if readers:
        raise ValueError(f"record {next(iter(readers))}: its last chunk is missing")


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_rows: int = BROADCAST_ROWS, chunk: int = CHUNK) -> None:
    """Write a record for every row of pages as a chunked record table at path, `chunk` payload bytes a row."""
    ship(pages.sparkSession)
    rows = pages.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    narrow = materialise(rows.select("uid", "page_id", "html").mapInArrow(_digest, _DIGESTS), "payloads").filter(F.col("n") >= SMALLEST)
    by = ["n", "sha1", "sha256"]
    groups = narrow.groupBy(*by).agg(F.count("*").alias("rows"), F.max(F.struct("page_id", F.bitwise_not("uid").alias("at"))).alias("best")).filter("rows > 1")
    groups = materialise(groups.select(*by, F.col("best.page_id").alias("ref_page_id"), F.bitwise_not("best.at").alias("ref_uid")), "payload-copies")
    revisits = materialise(narrow.join(groups, by).filter("uid <> ref_uid").select("uid", "ref_page_id", "ref_uid"), "revisits")
    dealt = rows.join(small_or_not(revisits, broadcast_rows), "uid", "left")
    dealt.mapInArrow(_write(chunk), ROWS).write.option("compression", "uncompressed").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every record of the table at path."""
    ship(spark)
    table = spark.read.schema(ROWS).parquet(path)
    kinds = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    alone = (F.col("chunk") == 0) & F.col("last")
    small = table.filter(alone).mapInArrow(_read, kinds)
    large = table.filter(~alone).repartition("record").sortWithinPartitions("record", "chunk").mapInArrow(_read, kinds)
    return small.unionByName(large)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write the archive to a new folder under the shared one, and read it back."""
    path = new_path(pages.sparkSession, "warc")
    write(pages, path, **options)
    return read(pages.sparkSession, path)


def export(spark: SparkSession, path: str, file: str) -> None:
    """One standard .warc.gz file on the driver from the table at path, row by row."""
    with open(file, "wb") as f:
        for r in spark.read.schema(ROWS).parquet(path).orderBy("record", "chunk").select("data").toLocalIterator():
            f.write(r.data)
