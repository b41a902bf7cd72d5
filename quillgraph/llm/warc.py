"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent frames; a skippable frame at the end of every bundle lists
the sizes of all frames, so a reader seeks to any one of them. The index maps a record's
identifier to bundle, frame and the record's place in the frame's plain bytes.

Of records with equal payloads of at least ``revisit_bytes`` bytes, the one with the largest
page id is the response and the others are revisits of it. Bundles go to a folder of their own
below ``spark.checkpoint.dir`` (any file system that pyarrow opens by URI). A task writes under
names of its own attempt and only the attempts whose index rows were committed are ever read.

Defined cases: a null html is an empty payload; a null page id is larger than none, so such a
record is a response only if all equal ones are null, and it has the identifier ``null``;
repeated rows are repeated records, all responses if theirs is the largest id; a null url leaves
the target out; an empty table gives no bundles; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.storage import new_path, stored

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
CHECKSUMS = 0x80
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = (
    "bundle string, frame int, frame_start long, offset long, length long, "
    "record_id string, page_id long, record_type string"
)
RECORDS = (
    "record_id string, page_id long, url string, record_type string, refers_to long, "
    "payload_bytes long, payload_digest string, payload binary"
)


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def page_of(identifier: str | None) -> int | None:
    name = (identifier or "").removeprefix("<urn:page:").removesuffix(">")
    return int(name) if name.lstrip("-").isdigit() else None


def encode_record(
    page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str
) -> bytes:
    """One WARC/1.1 record; a revisit carries the response headers alone."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (b"" if revisit else payload)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {date}",
    ]
    if url is not None:
        clean = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)
        lines.append(f"WARC-Target-URI: {clean}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def decode_record(data: memoryview) -> tuple[dict[str, str], bytes, bytes, int]:
    """Headers, HTTP head, payload and the record's whole length."""
    head_end = bytes(data[: 1 << 16]).find(b"\r\n\r\n")
    if head_end < 0:
        head_end = bytes(data).find(b"\r\n\r\n")
    version, *rest = bytes(data[:head_end]).decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"no record here: {version[:40]!r}")
    headers = dict(line.split(": ", 1) for line in rest)
    start, size = head_end + 4, int(headers["Content-Length"])
    block = bytes(data[start : start + size])
    if bytes(data[start + size : start + size + 4]) != b"\r\n\r\n":
        raise ValueError("a record does not end where its length says")
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, http, payload, start + size + 4


class BundleWriter:
    """Frames of about ``frame_bytes`` plain bytes, and their seek table at the end."""

    def __init__(self, sink, frame_bytes: int, level: int):
        import xxhash
        import zstandard

        self._sink, self._limit, self._hash = sink, frame_bytes, xxhash.xxh64_intdigest
        self._compress = zstandard.ZstdCompressor(level=level).compress
        self._plain, self._table, self.position = bytearray(), [], 0

    def add(self, record: bytes) -> tuple[int, int, int]:
        """Number and start of the record's frame, and its offset there."""
        if self._plain and len(self._plain) + len(record) > self._limit:
            self._flush()
        place = len(self._table), self.position, len(self._plain)
        self._plain += record
        return place

    def _flush(self) -> None:
        plain = bytes(self._plain)
        packed = self._compress(plain)
        self._sink.write(packed)
        self._table.append((len(packed), len(plain), self._hash(plain) & 0xFFFFFFFF))
        self.position += len(packed)
        self._plain.clear()

    def close(self) -> None:
        if self._plain:
            self._flush()
        entries = b"".join(struct.pack("<III", *row) for row in self._table)
        footer = struct.pack("<IBI", len(self._table), CHECKSUMS, SEEKABLE)
        self._sink.write(struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer)
        self._sink.close()


def seek_table(source) -> list[tuple[int, int, int, int]]:
    """(start, packed size, plain size, checksum) of every frame, from the end of a bundle."""
    size = source.size()
    source.seek(size - 9)
    count, descriptor, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE or descriptor != CHECKSUMS:
        raise ValueError("the bundle has no seek table")
    source.seek(size - 9 - 12 * count)
    rows, at = [], 0
    for packed, plain, check in struct.iter_unpack("<III", source.read(12 * count)):
        rows.append((at, packed, plain, check))
        at += packed
    return rows


def read_frame(source, row: tuple[int, int, int, int]) -> bytes:
    import xxhash
    import zstandard

    start, packed, plain, check = row
    source.seek(start)
    data = zstandard.ZstdDecompressor().decompress(source.read(packed), max_output_size=plain)
    if len(data) != plain or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
        raise ValueError(f"the frame at {start} is damaged")
    return data


def _open(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


def with_revisits(pages: DataFrame, revisit_bytes: int = 1000) -> DataFrame:
    """page_id, url, payload, digest and, for a revisit, the page it refers to."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    digested = rows.withColumn("digest", F.sha1("payload"))
    keepers = (
        digested.where(F.octet_length("payload") >= revisit_bytes)
        .groupBy("digest")
        .agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
        .where("n > 1 and keeper is not null")
        .select("digest", "keeper")
    )
    refers = F.when(F.col("page_id").eqNullSafe(F.col("keeper")), None).otherwise(F.col("keeper"))
    return digested.join(keepers, "digest", "left").select(
        "page_id", "url", "payload", "digest", refers.alias("refers_to")
    )


def write_archives(
    pages: DataFrame,
    folder: str | None = None,
    revisit_bytes: int = 1000,
    frame_bytes: int = 1 << 20,
    bundle_bytes: int = 256 << 20,
    level: int = 3,
    date: str = "2024-01-01T00:00:00Z",
) -> DataFrame:
    """Write all pages and return the stored index of records."""
    spark = pages.sparkSession
    target = folder or new_path(spark, "archive")
    fs, path = _open(target)
    fs.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _open(target)
        task = TaskContext.get().partitionId()
        writer, name, rows = None, "", []

        def flush() -> pa.RecordBatch:
            schema = [f.split() for f in INDEX.split(", ")]
            kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
            columns = list(zip(*rows, strict=True)) or [()] * len(schema)
            rows.clear()
            arrays = [pa.array(c, kinds[k]) for c, (_, k) in zip(columns, schema, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in schema])

        for batch in batches:
            for k in range(batch.num_rows):
                page, url, payload, digest, refers = (c[k].as_py() for c in batch.columns)
                if writer is None:
                    name = f"{target}/pages-{task:06d}-{uuid.uuid4().hex}.warc.zst"
                    writer = BundleWriter(
                        fs.open_output_stream(f"{path}/{name.rsplit('/', 1)[1]}", compression=None),
                        frame_bytes,
                        level,
                    )
                record = encode_record(page, url, payload, digest, refers, date)
                frame, start, offset = writer.add(record)
                kind = "response" if refers is None else "revisit"
                rows.append((name, frame, start, offset, len(record), record_id(page), page, kind))
                if writer.position >= bundle_bytes:
                    writer.close()
                    writer = None
            if writer is None or len(rows) >= 10_000:
                yield flush()
        if writer is not None:
            writer.close()
        yield flush()

    return stored(with_revisits(pages, revisit_bytes).mapInArrow(write, INDEX), "archive-index")


def read_archives(index: DataFrame) -> DataFrame:
    """All records of the bundles that the index names, one task per bundle, frame by frame.

    Payloads of responses are checked against their digests. A revisit has no payload; its
    length comes from the response headers that it kept.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        names = [f.split()[0] for f in RECORDS.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for bundle in batch.column(0).to_pylist():
                fs, path = _open(bundle)
                with fs.open_input_file(path) as source:
                    for row in seek_table(source):
                        plain, at, rows = memoryview(read_frame(source, row)), 0, []
                        while at < len(plain):
                            headers, http, payload, size = decode_record(plain[at:])
                            at += size
                            kind = headers["WARC-Type"]
                            digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                            length = int(http.rsplit(b"Content-Length: ", 1)[1])
                            if kind == "response" and (
                                length != len(payload) or hashlib.sha1(payload).hexdigest() != digest
                            ):
                                raise ValueError(f"{headers['WARC-Record-ID']}: payload and digest differ")
                            rows.append(
                                (
                                    headers["WARC-Record-ID"],
                                    page_of(headers["WARC-Record-ID"]),
                                    headers.get("WARC-Target-URI"),
                                    kind,
                                    page_of(headers.get("WARC-Refers-To")),
                                    length,
                                    digest,
                                    payload if kind == "response" else None,
                                )
                            )
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                            names=names,
                        )

    spark = index.sparkSession
    bundles = stored(index.select("bundle").distinct(), "bundles")
    tasks = max(1, min(bundles.count(), 4 * spark.sparkContext.defaultParallelism))
    return bundles.repartition(tasks).mapInArrow(read, RECORDS)


def read_one(index: DataFrame, identifier: str) -> list[bytes]:
    """Payloads of the records with an identifier, read by seeking to their frames alone."""
    found = []
    for row in index.where(F.col("record_id") == identifier).collect():
        fs, path = _open(row["bundle"])
        with fs.open_input_file(path) as source:
            plain = memoryview(read_frame(source, seek_table(source)[row["frame"]]))
            found.append(decode_record(plain[row["offset"] : row["offset"] + row["length"]])[2])
    return found
