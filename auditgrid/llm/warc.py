"""Seekable Zstandard WARC bundles, written, indexed and read back.

A bundle is a `.warc.zst` file of independent Zstandard frames, each holding whole WARC
records up to about ``frame_bytes``, and a footer seek table (a skippable frame, as in
Zstandard's public seekable format) with each frame's compressed and plain size.  The
record index maps a page to (bundle, frame, offset within the frame, length): with the
footer, one record costs one ranged read and one frame's decompression.

Records of equal payloads of ``revisit_bytes`` or more: the one with the largest page id
is a response, the others are revisits that refer to it.  Digests are taken by Spark; only
digests that come more than once are joined back to the pages: as a broadcast while their
number is at most ``broadcast_digests``, else as a shuffled join that adaptive execution
splits where one digest is hot.

Each task writes its own bundles under a name of its own, in place of nothing, and the
index is committed by Spark's writer: bundles of a lost or repeated attempt are in no
index and are never read.

A null html is an empty payload.  A null page id has no id in its record (nor a revisit:
its record is a response); rows of the same page id and payload are all responses when
that id is the largest.  A null or odd url is written as a percent-encoded one.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, worker, written

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 512 << 20
BUNDLE_ROWS = 1 << 18  # index rows wait until their bundle is closed
READ_BYTES, READ_ROWS = 8 << 20, 512  # payloads and records that leave a reader together
REVISIT_BYTES = 1000
BROADCAST_DIGESTS = 100_000
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX = "page_id long, bundle string, frame int, offset long, length long"
WARC_DATE = "1970-01-01T00:00:00Z"


# ------------------------------------------------------------------------------ format


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = WARC_DATE) -> bytes:
    """One WARC 1.1 record: a response with its payload, or a revisit without."""
    uri = quote(url or "urn:x-no-url", safe="!#$%&'()*+,/:;=?@[]~-._")
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:x-page:{'' if page_id is None else page_id}>"), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload)))]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    else:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:x-page:{refers_to}>")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Header fields, page_id, refers_to and payload (None in a revisit) of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"no WARC record: {first[:40]!r}")
    fields = dict(x.split(": ", 1) for x in lines)
    number = lambda x: int(x[len("<urn:x-page:") : -1]) if x and x != "<urn:x-page:>" else None
    block = rest[: int(fields["Content-Length"])]
    revisit = fields["WARC-Type"] == "revisit"
    return {"fields": fields, "page_id": number(fields["WARC-Record-ID"]), "refers_to": number(fields.get("WARC-Refers-To")), "payload": None if revisit else block.partition(b"\r\n\r\n")[2]}


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The footer for frames of (compressed, plain) sizes."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(fs: pafs.FileSystem, path: str) -> list[tuple[int, int, int]]:
    """(place, compressed size, plain size) of each frame of a bundle, from its footer."""
    with fs.open_input_file(path) as f:
        size = f.size()
        n, _, magic = struct.unpack("<IBI", f.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"no seek table: {path}")
        body = f.read_at(8 * n, size - 9 - 8 * n)
    out, at = [], 0
    for packed, plain in struct.iter_unpack("<II", body):
        out.append((at, packed, plain))
        at += packed
    return out


class Bundle:
    """A bundle being written; ``close`` returns the index rows of its records."""

    def __init__(self, fs: pafs.FileSystem, folder: str, name: str, frame_bytes: int):
        import zstandard

        self.fs, self.name, self.frame_bytes = fs, name, frame_bytes
        self.out = fs.open_output_stream(f"{folder}/{name}", compression=None)
        self.compress = zstandard.ZstdCompressor(level=3, write_checksum=True).compress
        self.frames: list[tuple[int, int]] = []
        self.held: list[bytes] = []
        self.plain = self.size = 0
        self.rows: list[tuple] = []

    def add(self, page_id: int | None, record: bytes) -> None:
        if self.held and self.plain + len(record) > self.frame_bytes:
            self.flush()
        self.rows.append((page_id, self.name, len(self.frames), self.plain, len(record)))
        self.held.append(record)
        self.plain += len(record)

    def flush(self) -> None:
        if self.held:
            frame = self.compress(b"".join(self.held))
            self.out.write(frame)
            self.frames.append((len(frame), self.plain))
            self.size += len(frame)
            self.held, self.plain = [], 0

    def close(self) -> pa.RecordBatch:
        self.flush()
        self.out.write(seek_table(self.frames))
        self.out.close()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 1 else pa.int32() if i == 2 else pa.int64()) for i, c in enumerate(zip(*self.rows, strict=True))], names=["page_id", "bundle", "frame", "offset", "length"])


# --------------------------------------------------------------------------- operators


def with_revisits(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES, broadcast_digests: int = BROADCAST_DIGESTS) -> DataFrame:
    """page_id, url, payload, digest and refers_to (null in a response)."""
    raw = F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), raw.alias("payload")).withColumn("digest", F.sha1("payload"))
    large = F.octet_length("payload") >= revisit_bytes
    copies = rows.filter(large).groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first_id")
    copies = written(copies, "digests")
    side = F.broadcast(copies) if copies.count() <= broadcast_digests else copies
    refers = F.when(large & F.col("page_id").isNotNull() & (F.col("first_id") != F.col("page_id")), F.col("first_id"))
    return rows.join(side, "digest", "left").withColumn("refers_to", refers).drop("first_id")


def write_bundles(pages: DataFrame, path: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, revisit_bytes: int = REVISIT_BYTES) -> None:
    """Bundles of all pages under ``path``/bundles, their index as Parquet in ``path``/index."""
    small_batches(pages.sparkSession)
    folder = f"{path}/bundles"

    @worker
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        bundle: Bundle | None = None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                bundle = bundle or Bundle(fs, root, f"{uuid.uuid4().hex}.warc.zst", frame_bytes)
                bundle.add(row[0], record_bytes(*row))
                if bundle.size >= bundle_bytes or len(bundle.rows) >= BUNDLE_ROWS:
                    yield bundle.close()
                    bundle = None
        if bundle:
            yield bundle.close()

    with_revisits(pages, revisit_bytes).mapInArrow(run, INDEX).write.parquet(f"{path}/index")


def read_bundles(spark: SparkSession, path: str, where=None, payload: bool = True) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, payload of indexed records.

    ``where``: a Column over the index, to read some records only.  A response's digest
    and length are taken anew from the payload read; a revisit's come from its header.
    Without ``payload`` the column is left out.  A worker holds one frame and at most
    ``READ_BYTES`` of payloads beside it, or one payload that is larger.
    """
    index = spark.read.schema(INDEX).parquet(f"{path}/index")
    index = index.filter(where) if where is not None else index
    folder = f"{path}/bundles"
    small_batches(spark)
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
    kinds |= {"payload": pa.binary()} if payload else {}

    def records(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))

    @worker
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        fs, root = pafs.FileSystem.from_uri(folder)
        decompress = zstandard.ZstdDecompressor().decompress
        name, frame, places, plain = None, None, [], b""
        out: list[tuple] = []
        held = 0
        for batch in batches:
            for _, bundle, number, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bundle != name:
                    places, name, frame = read_seek_table(fs, f"{root}/{bundle}"), bundle, None
                if number != frame:
                    at, packed, size = places[number]
                    with fs.open_input_file(f"{root}/{bundle}") as f:
                        plain, frame = decompress(f.read_at(packed, at), max_output_size=size), number
                r = parse_record(plain[offset : offset + length])
                body = r["payload"]
                digest = r["fields"]["WARC-Payload-Digest"].removeprefix("sha1:") if body is None else hashlib.sha1(body).hexdigest()
                out.append((r["page_id"], int(r["fields"]["X-Payload-Length"]) if body is None else len(body), digest, r["fields"]["WARC-Type"], r["refers_to"], *([body] if payload else [])))
                held += len(body or b"") if payload else 0
                if held >= READ_BYTES or len(out) >= READ_ROWS:
                    yield records(out)
                    out, held = [], 0
        if out:
            yield records(out)

    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    by_frame = index.repartition(tasks, "bundle", "frame").sortWithinPartitions("bundle", "frame", "offset")
    return by_frame.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", payload binary" if payload else ""))
