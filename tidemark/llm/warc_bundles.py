"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames of about ``FRAME_BYTES`` that are compressed apart, so each can be read alone. A skippable
frame at the end of the file, which plain decompressors pass over, is the seek table of the Zstandard seekable format:

    u4 magic 184D2A5E, u4 size; for each frame: u4 compressed bytes, u4 bytes, u4 low half of its xxh64
    u4 frames, u1 descriptor (80: with checksums), u4 magic 8F92EAB1          (all little-endian)

The index maps every record identifier to file, frame, offset inside the decompressed frame, and length. ``fetch``
reads records by it: the footer, then only the frames that hold something wanted. ``read_archives`` reads everything, dealt by
runs of frames, so one archive is read by many tasks.

Equal payloads are stored once: the record with the largest id is a response, the others are revisits that refer to
it and carry its digest and, as extension fields, the payload's length and both ids. Which payloads repeat is found on
(id, SHA-256) alone; the payloads are shuffled once, by (id, SHA-256), and the rows that say whom to revisit arrive in
front of the record they are for. A payload that a third of all pages share is a third of small revisit records, dealt by their
ids. Reading recomputes each response's digest and stops at one that differs.

A task that runs again writes files of its own under fresh names; only those in the index are ever read. Paths go
through pyarrow.fs, in a folder that all executors share.

Defined results: a null payload is an empty one; payloads shorter than ``least_bytes`` are always responses; a null id
is smaller than all others; of repeated rows (equal id and payload) one is the response; a null address has no address
field, and control characters and blanks in one are percent-encoded; an empty table has no archives and an empty index; other columns are
never read, whatever they are called.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.shared import new_path, settle

FRAME_BYTES = 1 << 20
ARCHIVE_BYTES = 1 << 28
LEVEL = 3
#: Frames that one reading task takes at once.
RUN = 64
MOST_READERS = 20_000
DATE = "1970-01-01T00:00:00Z"
BATCH = 2_000

SKIPPABLE, SEEKABLE, WITH_CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
_HEAD, _ENTRY, _FOOT = struct.Struct("<II"), struct.Struct("<III"), struct.Struct("<IBI")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_ESCAPED = {c: f"%{c:02X}" for c in [*range(0x21), 0x7F]}
_NAMES = uuid.UUID("5f0c1f6e-6d0a-5f5e-9a53-7a1b7f5d2c11")

INDEX = "page_id bigint, record_id string, file string, frame int, offset bigint, length bigint"
RECORD = "page_id bigint, record_id string, record_type string, refers_to bigint, url string, payload_bytes bigint, payload_digest string, payload binary"
_INDEX_TYPES = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("file", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])
_RECORD_TYPES = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def digest_of(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str, copy: int = 0) -> str:
    """The same for the same page and payload; later copies of a row count up."""
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page_id}/{digest}/{copy}')}>"


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, revisit: bool, lead: int | None, copy: int) -> tuple[str, bytes]:
    """Identifier and bytes of a page's record."""
    digest = digest_of(payload)
    name = record_id(page_id, digest, copy)
    fields: list[tuple[str, object]] = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name), ("WARC-Date", DATE), ("WARC-Target-URI", None if url is None else url.translate(_ESCAPED)),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response"), ("Page-Number", page_id),
    ]
    if not revisit:
        return name, _record(fields, _HTTP % len(payload) + payload)
    fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(lead, digest)), ("Refers-To-Page-Number", lead), ("Payload-Length", len(payload))]
    return name, _record(fields, _HTTP % len(payload))


class Bundle:
    """An archive being written to ``out``: frames, then the seek table."""

    def __init__(self, out) -> None:
        self.out, self.entries, self.held, self.size = out, [], io.BytesIO(), 0
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)

    def add(self, record: bytes) -> tuple[int, int]:
        """Frame and offset of the record."""
        if self.held.tell() and self.held.tell() + len(record) > FRAME_BYTES:
            self.flush()
        at = len(self.entries), self.held.tell()
        self.held.write(record)
        return at

    def flush(self) -> None:
        if plain := self.held.getvalue():
            packed = self.packer.compress(plain)
            self.out.write(packed)
            self.size += len(packed)
            self.entries.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
            self.held = io.BytesIO()

    def close(self) -> None:
        self.flush()
        table = b"".join(_ENTRY.pack(*e) for e in self.entries) + _FOOT.pack(len(self.entries), WITH_CHECKSUMS, SEEKABLE)
        self.out.write(_HEAD.pack(SKIPPABLE, len(table)) + table)


class Frames:
    """The frames of an archive opened for reading; ``frame(i)`` reads one."""

    def __init__(self, file, size: int):
        self.file = file
        file.seek(size - _FOOT.size)
        n, described, magic = _FOOT.unpack(file.read(_FOOT.size))
        if magic != SEEKABLE or described != WITH_CHECKSUMS:
            raise ValueError("no seek table")
        begin = size - _FOOT.size - n * _ENTRY.size
        file.seek(begin - _HEAD.size)
        if _HEAD.unpack(file.read(_HEAD.size)) != (SKIPPABLE, size - begin):
            raise ValueError("the seek table is no skippable frame")
        self.entries = list(_ENTRY.iter_unpack(file.read(n * _ENTRY.size)))
        self.starts = [0]
        for packed, _, _ in self.entries:
            self.starts.append(self.starts[-1] + packed)

    def __len__(self) -> int:
        return len(self.entries)

    def frame(self, i: int) -> bytes:
        packed, size, checksum = self.entries[i]
        self.file.seek(self.starts[i])
        plain = zstandard.ZstdDecompressor().decompress(self.file.read(packed), max_output_size=size)
        if len(plain) != size or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {i} is damaged")
        return plain


def parse_records(plain: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields (lower-case names) and block of each record."""
    at = 0
    while at < len(plain):
        end = plain.index(b"\r\n\r\n", at)
        version, *lines = plain[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("no record")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        begin = end + 4
        at = begin + int(fields["content-length"])
        yield fields, plain[begin:at]
        at += 4


def page_row(fields: dict[str, str], block: bytes) -> tuple | None:
    """A row of RECORD from a page's record; None for other records."""
    kind = fields["warc-type"]
    if kind not in ("response", "revisit"):
        return None
    number = lambda name: int(fields[name]) if name in fields else None
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    payload = block[block.index(b"\r\n\r\n") + 4 :] if kind == "response" else None
    if payload is not None and digest_of(payload) != digest:
        raise ValueError(f"payload of {fields['warc-record-id']} is damaged")
    size = len(payload) if payload is not None else number("payload-length")
    return number("page-number"), fields["warc-record-id"], kind, number("refers-to-page-number"), fields.get("warc-target-uri"), size, digest, payload


def _store(path: str):
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _in_tables(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in batches of a bounded number of rows and bytes of payload."""
    held, size = [], 0

    def table() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        size += len(row[-1]) if isinstance(row[-1], bytes) else 0
        if len(held) == BATCH or size > 4 * FRAME_BYTES:
            yield table()
            held, size = [], 0
    if held:
        yield table()


def _marked(df: DataFrame, id_col: str, url_col: str, payload_col: str, least_bytes: int) -> DataFrame:
    """id, key, lead, url, payload: of each (id, key) first the row that names the largest id with the payload, if
    several records have it, and then the records; url and payload are null in the former, is_page tells them apart."""
    pages = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{url_col}`").alias("url"), F.coalesce(F.col(f"`{payload_col}`"), F.lit("")).alias("payload"))
    pages = pages.withColumn("key", F.unhex(F.sha2("payload", 256)))
    keys = pages.where(F.octet_length("payload") >= least_bytes).select("id", "key")
    repeated = keys.groupBy("key").agg(F.max("id").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "lead")
    leads = keys.join(repeated, "key").selectExpr("id", "key", "false AS is_page", "lead", "CAST(NULL AS string) AS url", "CAST(NULL AS string) AS payload")
    return leads.unionByName(pages.selectExpr("id", "key", "true AS is_page", "CAST(NULL AS bigint) AS lead", "url", "payload"))


def write_archives(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write the archives; the stored index, a row per page: page_id, record_id, file, frame, offset, length."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _store(folder)

        def rows() -> Iterator[tuple]:
            bundle: Bundle | None = None
            name = ""
            of: tuple | None = None
            repeated, lead, copies = False, None, 0
            for batch in batches:
                ids, keys, pages, leads, urls = (batch.column(i).to_pylist() for i in range(5))
                for i, (page, key, is_page, to, url) in enumerate(zip(ids, keys, pages, leads, urls, strict=True)):
                    if of != (page, key):
                        of, repeated, lead, copies = (page, key), False, None, 0
                    if not is_page:
                        repeated, lead = True, to
                        continue
                    if bundle is None:
                        fs.create_dir(top, recursive=True)
                        name = f"{uuid.uuid4().hex}.warc.zst"
                        bundle = Bundle(fs.open_output_stream(f"{top}/{name}", compression=None))
                        bundle.add(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                    revisit = repeated and (page != lead or copies > 0)
                    record, data = page_record(page, url, (batch.column(5)[i].as_py() or "").encode(), revisit, lead, copies)
                    yield page, record, name, *bundle.add(data), len(data)
                    copies += 1
                    if bundle.size >= ARCHIVE_BYTES:
                        bundle.close()
                        bundle.out.close()
                        bundle = None
            if bundle is not None:
                bundle.close()
                bundle.out.close()

        yield from _in_tables(rows(), _INDEX_TYPES)

    marked = _marked(df, id_col, url_col, payload_col, least_bytes)
    dealt = marked.repartition("id", "key").sortWithinPartitions(F.col("id").asc_nulls_first(), "key", "is_page")
    return settle(dealt.select("id", "key", "is_page", "lead", "url", "payload").mapInArrow(write, INDEX))


def _records(file_rows: DataFrame, folder: str, wanted: bool) -> DataFrame:
    """RECORD rows of (file, first, last) runs of frames, or of (file, frame, places) where some records are wanted."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _store(folder)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for run in batch.to_pylist():
                    path = f"{top}/{run['file']}"
                    with fs.open_input_file(path) as file:
                        frames = Frames(file, file.size())
                        if wanted:
                            plain = frames.frame(run["frame"])
                            for place in run["places"]:
                                yield from (r for x in parse_records(plain[place["offset"] : place["offset"] + place["length"]]) if (r := page_row(*x)))
                            continue
                        for i in range(run["first"], run["last"] + 1):
                            yield from (r for x in parse_records(frames.frame(i)) if (r := page_row(*x)))

        yield from _in_tables(rows(), _RECORD_TYPES)

    return file_rows.mapInArrow(read, RECORD)


def read_archives(spark: SparkSession, folder: str, index: DataFrame) -> DataFrame:
    """All pages' records of the archives that the index names (columns: RECORD)."""
    sizes = index.groupBy("file").agg(F.max("frame").alias("last"))
    runs = settle(sizes.select("file", "last", F.explode(F.sequence(F.lit(0), "last", F.lit(RUN))).alias("first")).selectExpr("file", "first", f"least(last, first + {RUN - 1}) AS last"))
    # A number of partitions, as adaptive execution would else put these small rows into one task.
    return _records(runs.repartition(max(1, min(runs.count(), MOST_READERS)), "file", "first"), folder, False)


def fetch(folder: str, wanted: DataFrame) -> DataFrame:
    """The records that rows of the index name, reading each frame they lie in once and no other."""
    places = F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("places")  # bounded by the records of a frame
    return _records(wanted.select("file", "frame", "offset", "length").distinct().groupBy("file", "frame").agg(places), folder, True)


def through_archives(df: DataFrame) -> DataFrame:
    """Write pages as archives into the shared folder and read them back: a digest row per page."""
    spark = df.sparkSession
    folder = new_path(spark, "warc")
    read = read_archives(spark, folder, write_archives(df, folder))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
