"""WARC archives as seekable Zstandard bundles, with record ids mapped to frame-relative offsets.

A bundle is a run of independent Zstandard frames, each holding whole WARC records, and a footer:
a skippable frame with the compressed and plain size of every frame (the public seekable format).
The index maps a record to bundle, frame, and offset and length within the plain frame. A reader
takes the frame's place from the footer, so a record costs one small read and one frame's
decompression, and a plain ``zstd -d`` still gives the WARC file.

Each task writes bundles of its own under names that no other attempt uses, and the index rows of
the attempt that succeeded are what counts. Bundles of lost attempts are in no index.
"""

import base64
import hashlib
import re
import struct
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, BatchesIn, column, shared_path, written

#: Plain bytes after which a frame, and compressed bytes after which a bundle is closed.
FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 26
#: Plain bytes that one task reads back, about.
READ_BYTES = 1 << 25
#: Payloads smaller than this are never replaced by a revisit.
MIN_REVISIT_BYTES = 0

# Fixed values of the seekable Zstandard format and of WARC 1.1.
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EPOCH = "1970-01-01T00:00:00Z"

_INDEX = pa.schema(
    [
        ("record_id", pa.string()),
        ("bundle", pa.string()),
        ("frame", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
    ]
)
_INDEX_DDL = "record_id string, bundle string, frame long, start long, length long"


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The footer for frames of these compressed and plain sizes."""
    body = b"".join(struct.pack("<II", *pair) for pair in sizes) + struct.pack("<IBI", len(sizes), 0, _SEEKABLE)
    return struct.pack("<II", _SKIPPABLE, len(body)) + body


class BundleReader:
    """Random access to one bundle. Keeps the frame read last."""

    def __init__(self, path: str):
        filesystem, name = pafs.FileSystem.from_uri(path)
        self.file = filesystem.open_input_file(name)
        end = self.file.size()
        count, flags, magic = struct.unpack("<IBI", self.file.read_at(9, end - 9))
        if magic != _SEEKABLE or flags:
            raise ValueError(f"{path} has no seek table")
        sizes = struct.unpack(f"<{2 * count}I", self.file.read_at(8 * count, end - 9 - 8 * count))
        self.places, at = [], 0
        for packed, plain in zip(sizes[::2], sizes[1::2], strict=True):
            self.places.append((at, packed, plain))
            at += packed
        self.last: tuple[int, bytes] = (-1, b"")

    def frame(self, number: int) -> bytes:
        if self.last[0] != number:
            at, packed, plain = self.places[number]
            data = zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, at), max_output_size=plain)
            self.last = number, data
        return self.last[1]

    def record(self, frame: int, start: int, length: int) -> bytes:
        return self.frame(frame)[start : start + length]


class _BundleWriter:
    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        filesystem, name = pafs.FileSystem.from_uri(self.path)
        filesystem.create_dir(name.rpartition("/")[0], recursive=True)
        self.file = filesystem.open_output_stream(name, compression=None)  # frames are compressed here
        self.zstd = zstandard.ZstdCompressor(level=3)
        self.frame, self.plain, self.packed, self.sizes = [], 0, 0, []

    def add(self, record: bytes) -> tuple[int, int, int]:
        """Frame, start and length of the record."""
        place = len(self.sizes), self.plain, len(record)
        self.frame.append(record)
        self.plain += len(record)
        if self.plain >= FRAME_BYTES:
            self._end_frame()
        return place

    def _end_frame(self) -> None:
        if self.frame:
            data = self.zstd.compress(b"".join(self.frame))
            self.file.write(data)
            self.sizes.append((len(data), self.plain))
            self.packed += len(data)
            self.frame, self.plain = [], 0

    def close(self) -> None:
        self._end_frame()
        self.file.write(seek_table(self.sizes))
        self.file.close()


def record_name(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def warc_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> tuple[str, bytes]:
    """Record id and record: a response with its payload, or a revisit with the HTTP header alone."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    name = record_name(page_id, digest)
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": name,
        "WARC-Date": _EPOCH,
        # A line break inside a url would end the header.
        "WARC-Target-URI": None if url is None else re.sub(r"[\x00-\x1f\x7f]", lambda c: f"%{ord(c[0]):02X}", url),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Profile": _PROFILE if refers_to is not None else None,
        "WARC-Refers-To": record_name(refers_to, digest) if refers_to is not None else None,
        "X-Page-ID": page_id,
        "X-Refers-To-Page-ID": refers_to,
        "Content-Type": "application/http;msgtype=response",
        "Content-Length": len(block),
    }
    head = "".join(f"{key}: {value}\r\n" for key, value in fields.items() if value is not None)
    return name, f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def parse_record(record: bytes) -> dict:
    """Header fields, the payload (None for a revisit), its size and its digest."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    response = fields["WARC-Type"] == "response"
    stated = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = base32_sha1(body) if response else fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if response and (len(body) != stated or fields["WARC-Payload-Digest"] != f"sha1:{digest}"):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {"fields": fields, "payload": body if response else None, "bytes": stated, "digest": digest}


def write_archive(pages: DataFrame, folder: str | None = None, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write a record per row of ``pages`` (``page_id``, ``url``, ``html``) and return the index.

    Of equal payloads of at least ``min_revisit_bytes`` the row with the largest ``page_id`` becomes
    a response and others revisits of it; rows repeated with that id are all responses, and rows
    without an id revisit one that has an id or, if none has, are all responses. A null html is
    an empty payload, a null url leaves out the target. Other columns are ignored. An empty table
    gives an empty index.
    """
    folder = folder or shared_path(pages.sparkSession, "warc")
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("key", F.unhex(F.sha1("payload")))
    keepers = (
        rows.where(F.octet_length("payload") >= min_revisit_bytes)
        .groupBy("key")
        .agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n")
    )
    refers_to = F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper"))
    records = rows.join(keepers, "key", "left").select(
        F.col("page_id").cast("long").alias("page_id"), "url", "payload", refers_to.cast("long").alias("refers_to")
    )

    def write(batches: BatchesIn) -> Batches:
        bundle, places = None, []

        def index() -> pa.RecordBatch:
            names, paths, *numbers = zip(*places, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (names, paths, *numbers)], schema=_INDEX)

        for batch in batches:
            for row in zip(*(column(batch, c) for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                bundle = bundle or _BundleWriter(folder)
                name, record = warc_record(*row)
                places.append((name, bundle.path, *bundle.add(record)))
                if bundle.packed >= BUNDLE_BYTES:
                    bundle.close()
                    yield index()
                    bundle, places = None, []
        if bundle:
            bundle.close()
            yield index()

    return written(records.mapInArrow(write, _INDEX_DDL), "warc-index")


_READ_DDL = (
    "record_id string, page_id long, url string, payload binary, payload_bytes long, payload_digest string, "
    "record_type string, refers_to long"
)
_READ = pa.schema(
    [
        ("record_id", pa.string()),
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("payload", pa.binary()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
    ]
)


def _read(batches: BatchesIn) -> Batches:
    reader, path = None, None
    whole = lambda value: None if value is None else int(value)
    for batch in batches:
        rows, held = [], 0
        for name, bundle, *place in zip(*(column(batch, c) for c in _INDEX.names), strict=True):
            if bundle != path:
                reader, path = BundleReader(bundle), bundle
            got = parse_record(reader.record(*place))
            fields = got["fields"]
            if fields["WARC-Record-ID"] != name:
                raise ValueError(f"{bundle} holds {fields['WARC-Record-ID']} where the index has {name}")
            rows.append(
                (
                    name,
                    whole(fields.get("X-Page-ID")),
                    fields.get("WARC-Target-URI"),
                    got["payload"],
                    got["bytes"],
                    got["digest"],
                    fields["WARC-Type"],
                    whole(fields.get("X-Refers-To-Page-ID")),
                )
            )
            held += place[-1]
            if held > 1 << 24:
                yield _rows(rows)
                rows, held = [], 0
        if rows:
            yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _READ.types, strict=True)], schema=_READ
    )


def read_archive(index: DataFrame) -> DataFrame:
    """The records that ``index`` (all or some rows of it) points at, payloads checked by digest.

    ``payload`` is null for revisits; ``payload_bytes`` and ``payload_digest`` are those of the full
    payload for either type.
    """
    # The index is small, what it points at is not: tasks by the records' size, not by the index's.
    size = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-size // READ_BYTES))
    frames = index.repartition(tasks, "bundle", "frame").sortWithinPartitions("bundle", "frame", "start")
    return frames.mapInArrow(_read, _READ_DDL)
