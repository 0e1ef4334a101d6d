"""WARC archives as seekable Zstandard bundles.

An archive is a run of independent Zstandard frames of whole WARC records, closed by a seek table
in the public seekable format: a skippable frame with the compressed and decompressed size and
the checksum of each frame, then the number of frames, a descriptor and a magic number.  Any
Zstandard tool reads it whole; with the seek table one frame is read and decompressed alone.  An
index table maps each record identifier to archive, frame and offset within the frame.

Records of equal payloads: one is a ``response``, the others are ``revisit`` records that name it
and its digest and hold the HTTP header only, whose Content-Length is that of the full payload.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import scratch_path, written
from graphloom.llm.sstable import file_system

FRAME_BYTES = 256 << 10
ARCHIVE_BYTES = 256 << 20
LEVEL = 3
SALTS = 64
DATE = "1970-01-01T00:00:00Z"  #: the tables carry no date of capture
# fixed values of the seekable format
SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
ENTRY, FOOTER = struct.Struct("<III"), struct.Struct("<IBI")


class BundleWriter:
    """Writes records into frames of about ``frame_bytes``; a longer record stands alone in its frame."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        self.out, self.frame_bytes = out, frame_bytes
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.frames: list[tuple[int, int, int]] = []
        self.held: list[bytes] = []
        self.size = self.at = 0

    def add(self, record: bytes) -> tuple[int, int]:
        """The frame of the record and its offset in the decompressed frame."""
        if self.held and self.size + len(record) > self.frame_bytes:
            self._flush()
        place = len(self.frames), self.size
        self.held.append(record)
        self.size += len(record)
        return place

    def _flush(self) -> None:
        data = b"".join(self.held)
        packed = self.packer.compress(data)
        self.out.write(packed)
        self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.at += len(packed)
        self.held, self.size = [], 0

    def finish(self) -> None:
        if self.held:
            self._flush()
        table = b"".join(ENTRY.pack(*f) for f in self.frames) + FOOTER.pack(len(self.frames), CHECKSUMS, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


class BundleReader:
    """Frames of one archive, each read by its own range of bytes."""

    def __init__(self, uri: str):
        fs, path = file_system(uri)
        self.uri, self.file = uri, fs.open_input_file(path)
        size = self.file.size()
        n, flags, magic = FOOTER.unpack(self._get(size - FOOTER.size, FOOTER.size))
        if magic != SEEKABLE or not flags & CHECKSUMS:
            raise ValueError(f"{uri} has no seek table with checksums")
        raw = self._get(size - FOOTER.size - n * ENTRY.size, n * ENTRY.size)
        self.frames, at = [], 0
        for packed, full, check in ENTRY.iter_unpack(raw):
            self.frames.append((at, packed, full, check))
            at += packed

    def _get(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def frame(self, i: int) -> bytes:
        at, packed, full, check = self.frames[i]
        data = zstandard.ZstdDecompressor().decompress(self._get(at, packed), max_output_size=full)
        if len(data) != full or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {i} of {self.uri} is damaged")
        return data

    def records(self) -> Iterator[tuple[dict[str, str], bytes]]:
        for i in range(len(self.frames)):
            data, at = self.frame(i), 0
            while at < len(data):
                head, block, at = parse(data, at)
                yield head, block

    def close(self) -> None:
        self.file.close()


def sha1_32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_name(page_id: int | None, digest: str) -> str:
    """The URI that identifies a page's record; equal rows share it."""
    return f"<urn:x-page:{'' if page_id is None else page_id}:{digest}>"


def page_of(name: str) -> int | None:
    """The page id inside a record's identifier."""
    page = name.rsplit(":", 2)[1]
    return int(page) if page else None


def _line(text: str) -> str:
    """A header value on one line: control characters and blanks as percent codes."""
    return "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in text)


def warc_record(kind: str, name: str, block: bytes, **fields: str) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": name, "WARC-Date": DATE, **fields, "WARC-Block-Digest": f"sha1:{sha1_32(block)}", "Content-Length": str(len(block))}
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode() + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> tuple[str, bytes]:
    digest = sha1_32(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = {"WARC-Target-URI": _line(url or "about:blank"), "Content-Type": "application/http;msgtype=response", "WARC-Payload-Digest": f"sha1:{digest}"}
    if revisit:
        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_name(refers_to, digest)}
    name = record_name(page_id, digest)
    return name, warc_record("revisit" if revisit else "response", name, http if revisit else http + payload, **fields)


def parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Header fields and block of the record at ``at``, and where the next one begins."""
    end = data.index(b"\r\n\r\n", at)
    version, *lines = data[at:end].decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record stands here")
    head = dict(x.split(": ", 1) for x in lines)
    start, size = end + 4, int(head["Content-Length"])
    block = data[start : start + size]
    if data[start + size : start + size + 4] != b"\r\n\r\n" or head.get("WARC-Block-Digest", f"sha1:{sha1_32(block)}") != f"sha1:{sha1_32(block)}":
        raise ValueError(f"record {head.get('WARC-Record-ID')} is damaged")
    return head, block, start + size + 4


def payload_of(head: dict[str, str], block: bytes) -> tuple[bytes, int]:
    """The payload that a page's record holds (none in a revisit) and the length of the full one."""
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    if head["WARC-Type"] == "response" and (len(payload) != length or head["WARC-Payload-Digest"] != f"sha1:{sha1_32(payload)}"):
        raise ValueError(f"payload of {head['WARC-Record-ID']} is damaged")
    return payload, length


def with_roles(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", text_col: str = "html", url_col: str = "url") -> DataFrame:
    """``(page_id, url, html, first)``: ``first`` is the smallest page id of an equal payload, null if the row's payload stands once.

    Payloads are told apart by length and sha256.  Counts and smallest ids are taken by (payload,
    salt) and joined back by the same pair, so a payload that a third of all rows share is
    ``SALTS`` groups; only payloads that stand more than once go into the join.
    """
    html = F.coalesce(F.col(text_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"))
    key = F.concat_ws(":", F.octet_length("html"), F.sha2("html", 256))
    # shorter payloads are no group of their own; their key is never asked for
    alone = F.concat_ws(":", F.lit("alone"), F.col("page_id"), F.xxhash64("url"))
    rows = rows.withColumn("key", F.when(F.octet_length("html") >= min_bytes, key).otherwise(alone)).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
    parts = rows.where(F.octet_length("html") >= min_bytes).groupBy("key", "salt").agg(F.min("page_id").alias("low"), F.count(F.lit(1)).alias("n"))
    firsts = parts.groupBy("key").agg(F.min("low").alias("first"), F.sum("n").alias("n")).where("n > 1").select("key", "first")
    roles = parts.select("key", "salt").join(firsts, "key").withColumn("shared", F.lit(True))
    return rows.join(roles, ["key", "salt"], "left").select("page_id", "url", "html", "first", F.coalesce("shared", F.lit(False)).alias("shared"))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, frame_bytes: int = FRAME_BYTES, archive_bytes: int = ARCHIVE_BYTES, **columns) -> DataFrame:
    """Writes a record per page and returns the index ``(uri, record_id, page_id, record_type, frame, offset, length)``.

    A task writes archives of at most about ``archive_bytes`` one after the other and holds one
    frame.  Names carry the task's attempt, and the index is a written table, so it names only
    archives of attempts that were committed; what a lost executor had begun is never read.

    Payloads are UTF-8 (null: empty).  Of equal payloads of at least ``min_bytes`` bytes the
    smallest page id is the response; a null id comes last; repeated rows of that id are all
    responses.  Null urls are written as ``about:blank``; other columns are ignored; an empty
    table gives an empty index.
    """
    fs, root = file_system(folder)
    fs.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        where, (store, base) = TaskContext.get(), file_system(folder)
        out = writer = None
        number = 0
        rows: list[tuple] = []
        try:
            for batch in batches:
                for row in range(batch.num_rows):
                    page_id, url, html, first, shared = (c[row].as_py() for c in batch.columns)
                    if writer is None:
                        name = f"pages-{where.partitionId():06d}-{where.taskAttemptId()}-{number:04d}.warc.zst"
                        out = store.open_output_stream(f"{base}/{name}", compression=None)  # frames are compressed here
                        writer = BundleWriter(out, frame_bytes)
                        writer.add(warc_record("warcinfo", f"<urn:x-archive:{name}>", b"format: WARC File Format 1.1\r\n", **{"Content-Type": "application/warc-fields"}))
                    revisit = shared and page_id != first
                    record_id, record = page_record(page_id, url, html.encode(), first, revisit)
                    rows.append((f"{folder}/{name}", record_id, page_id, "revisit" if revisit else "response", *writer.add(record), len(record)))
                    if writer.at >= archive_bytes:
                        writer.finish()
                        out.close()
                        out = writer = None
                        number += 1
                if rows:
                    yield _index(rows)
                    rows = []
            if writer is not None:
                writer.finish()
        finally:
            if out is not None:
                out.close()

    schema = "uri string, record_id string, page_id long, record_type string, frame int, offset long, length long"
    return written(with_roles(pages, min_bytes, **columns).mapInArrow(run, schema), "warc-index")[0]


def _index(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["uri", "record_id", "page_id", "record_type", "frame", "offset", "length"])


def read_archives(index: DataFrame) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of every page's record, read from the archives that an index names.

    A task reads an archive frame by frame; checksums of frames, blocks and payloads are verified.
    """
    uris = index.select("uri").distinct()
    n = max(1, uris.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                reader, rows = BundleReader(uri), []
                for head, block in reader.records():
                    if head["WARC-Type"] == "warcinfo":
                        continue
                    _, length = payload_of(head, block)
                    refers = head.get("WARC-Refers-To")
                    rows.append((page_of(head["WARC-Record-ID"]), length, head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"], refers and page_of(refers)))
                    if len(rows) == 10_000:
                        yield _read(rows)
                        rows = []
                reader.close()
                if rows:
                    yield _read(rows)

    return uris.repartition(n).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _read(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def fetch(index: DataFrame, pages: DataFrame, id_col: str = "page_id", partitions: int = 64) -> DataFrame:
    """``(page_id, html)`` of wanted pages: only their frames are read; a revisit is fetched at the record it refers to.

    ``pages`` has the wanted ids; ids that stand twice count once, unknown ones give no row.  Wanted records are dealt by
    archive and frame, so a frame is read once.
    """
    wanted = pages.select(F.col(id_col).cast("long").alias("page_id")).distinct()
    digest = F.element_at(F.split("record_id", ":"), -1)
    found = index.join(wanted, index.page_id.eqNullSafe(wanted.page_id), "left_semi").select("page_id", digest.alias("digest")).distinct()
    full = index.where("record_type = 'response'").groupBy(digest.alias("digest")).agg(F.min(F.struct("uri", "frame", "offset")).alias("at"))
    asked = found.join(full, "digest").select("page_id", "at.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, held, data = None, None, b""
        for batch in batches:
            for page_id, uri, frame, offset in zip(*(c.to_pylist() for c in batch.columns)):
                if reader is None or reader.uri != uri:
                    if reader is not None:
                        reader.close()
                    reader, held = BundleReader(uri), None
                if held != frame:
                    held, data = frame, reader.frame(frame)
                head, block, _ = parse(data, offset)
                yield pa.RecordBatch.from_arrays([pa.array([page_id], pa.int64()), pa.array([payload_of(head, block)[0].decode()])], ["page_id", "html"])
        if reader is not None:
            reader.close()

    return asked.repartition(partitions, "uri", "frame").sortWithinPartitions("uri", "frame", "offset").mapInArrow(run, "page_id long, html string")


def round_trip(pages: DataFrame, min_bytes: int = 0, folder: str | None = None, **columns) -> DataFrame:
    """Writes archives (to ``folder``, else a new one in the shared folder) and returns what is read back from them."""
    return read_archives(write_archives(pages, folder or scratch_path(pages.sparkSession, "warc"), min_bytes, **columns))
