"""Sorted-string-table shards of token ids: written in id order, looked up by binary search.

A shard file is a run of data blocks, an index block, a Bloom filter and a fixed footer.

* entry: shared key length, key suffix length, value length (varints), key suffix, value.  Keys
  are prefix-compressed against the entry before; the first entry of a block shares nothing.
* key: tag byte (0 null, 1 integer), then the id as a big-endian offset-binary 64-bit integer, so that byte order
  is id order, nulls first.  value: ids, little-endian, 2 bytes wide if every id of the
  tokenizer fits, else 4.
* block: entries, then crc32 of them.  index: for each block its last key, offset and length.
* Bloom filter: bit array with ``BLOOM_PROBES`` probes by double hashing of the key.
* footer (fixed size): offsets and lengths of index and filter, entry count, token count, id
  width, magic.
"""

from __future__ import annotations

import hashlib
import os
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm import pieces
from graphloom.llm.shared import arrow_batches, checkpointed, scratch_path

MAGIC = b"GLSST001"
FOOTER = struct.Struct("<QQQQQQQ8s")
BLOCK_BYTES = 64 << 10
BLOOM_BITS_PER_KEY, BLOOM_PROBES = 10, 7
SHARD_BYTES = 64 << 20
#: Bytes of a batch of texts, and of the table of pieces that a worker keeps: an executor has a worker a core beside its heap.
BATCH_BYTES, KEPT_BYTES = 2 << 20, 48 << 20


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder: local, or any scheme that Arrow can open."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def encode_key(doc_id: int | None) -> bytes:
    return b"\x00" if doc_id is None else b"\x01" + struct.pack(">Q", doc_id + (1 << 63))


def decode_key(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(buf, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = buf[at]
        at += 1
        n |= (byte & 0x7F) << shift
        if byte < 0x80:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    h1, h2 = struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())
    return [(h1 + i * (h2 | 1)) % bits for i in range(BLOOM_PROBES)]


class ShardWriter:
    """Writes one shard; keys must come in order (equal keys are allowed and stay in order)."""

    def __init__(self, out, width: int):
        self.out, self.width, self.at = out, width, 0
        self.block, self.block_size, self.last = [], 0, b""
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.entries = self.tokens = 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        shared = len(os.path.commonprefix([self.last, key])) if self.block else 0
        value = ids.astype(f"<u{self.width}").tobytes()
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.block.append(entry)
        self.block_size += len(entry)
        if key != self.last or not self.keys:
            self.keys.append(key)
        self.last = key
        self.entries += 1
        self.tokens += len(ids)
        if self.block_size >= BLOCK_BYTES:
            self._flush()

    def _put(self, data: bytes) -> tuple[int, int]:
        self.out.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)

    def _flush(self) -> None:
        if self.block:
            data = b"".join(self.block)
            self.index.append((self.last, *self._put(data + struct.pack("<I", zlib.crc32(data)))))
            self.block, self.block_size = [], 0

    def finish(self) -> None:
        self._flush()
        bits = max(64, len(self.keys) * BLOOM_BITS_PER_KEY)
        bloom = np.zeros(bits, np.uint8)
        for key in self.keys:
            bloom[_probes(key, bits)] = 1
        index = b"".join(_varint(len(k)) + k + _varint(o) + _varint(n) for k, o, n in self.index)
        index_at = self._put(index)
        bloom_at = self._put(struct.pack("<Q", bits) + np.packbits(bloom).tobytes())
        self._put(FOOTER.pack(*index_at, *bloom_at, self.entries, self.tokens, self.width, MAGIC))


class ShardReader:
    """Random and sequential access to one shard file."""

    def __init__(self, uri: str):
        fs, path = file_system(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        index_at, index_n, bloom_at, bloom_n, self.entries, self.tokens, self.width, magic = FOOTER.unpack(self._get(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no shard")
        raw, at, self.index = self._get(index_at, index_n), 0, []
        while at < len(raw):
            n, at = _read_varint(raw, at)
            key, at = raw[at : at + n], at + n
            offset, at = _read_varint(raw, at)
            length, at = _read_varint(raw, at)
            self.index.append((key, offset, length))
        raw = self._get(bloom_at, bloom_n)
        self.bits = struct.unpack_from("<Q", raw)[0]
        self.bloom = np.unpackbits(np.frombuffer(raw, np.uint8, offset=8))

    def _get(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, offset, length = self.index[i]
        raw = self._get(offset, length)
        data = raw[:-4]
        if zlib.crc32(data) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError("a block's checksum is wrong")
        at, key = 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            own, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + own]
            at += own
            yield key, np.frombuffer(data, f"<u{self.width}", size // self.width, at)
            at += size

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for i in range(len(self.index)):
            yield from self._block(i)

    def may_hold(self, key: bytes) -> bool:
        return bool(self.bloom[_probes(key, self.bits)].all())

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every entry with this key: filter, then binary search of the index, then a block scan."""
        key, found = encode_key(doc_id), []
        if not self.may_hold(key):
            return found
        for i in range(bisect_left(self.index, key, key=lambda x: x[0]), len(self.index)):
            for k, ids in self._block(i):
                if k == key:
                    found.append(ids)
                elif k > key:
                    return found
        return found

    def close(self) -> None:
        self.file.close()


def write_shards(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int | None = 0, id_width: int | None = None, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode whole texts and write them as shards in ascending id order; the manifest is returned.

    Texts are dealt by range of (id, text hash), sorted in their partition, then encoded and
    written block by block, so a task holds one batch.  A shard is written under a name of its
    own attempt and then moved to its final name: a lost executor's task writes it again whole.

    Manifest: ``shard, uri, n_docs, n_tokens, start`` (``start``: ids in all shards before).  A
    null text is empty (only the end id), a null id sorts first under a key of its own, repeated
    rows are kept as entries of one key, other columns are ignored, an empty table gives no shard.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes), spark.sparkContext.defaultParallelism if total > (8 << 20) else 1)
    file_system(folder)[0].create_dir(file_system(folder)[1], recursive=True)
    dealt = rows.repartitionByRange(shards, F.col("id").asc_nulls_first(), F.xxhash64("text"))
    dealt = dealt.withColumn("shard", F.spark_partition_id()).sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text"))
    splits = pieces.splits_safely(tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = pieces.Encoder(tokenizer_path, KEPT_BYTES) if splits else None
        writer, out, end = None, None, np.array([] if end_id is None else [end_id], "<u4")
        size = id_width or (2 if _vocabulary(tokenizer_path) <= 1 << 16 else 4)
        fs, root = file_system(folder)
        for batch in batches:
            if writer is None and batch.num_rows:
                shard = batch.column(2)[0].as_py()
                own = f"{root}/shard-{shard:06d}.sst.{TaskContext.get().taskAttemptId()}"
                out = fs.open_output_stream(own)
                writer = ShardWriter(out, size)
            for key, ids in zip(batch.column(0).to_pylist(), pieces.ids(tokenizer_path, batch.column(1), encoder)):
                writer.add(encode_key(key), np.concatenate([ids, end]))
        del encoder
        pieces.give_back()
        if writer is not None:
            writer.finish()
            out.close()
            fs.move(own, f"{root}/shard-{shard:06d}.sst")
            uri = f"{folder}/shard-{shard:06d}.sst"
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((shard, pa.int32()), (uri, pa.string()), (writer.entries, pa.int64()), (writer.tokens, pa.int64()))], ["shard", "uri", "n_docs", "n_tokens"])

    with arrow_batches(spark, BATCH_BYTES):
        manifest = checkpointed(dealt.mapInArrow(run, "shard int, uri string, n_docs long, n_tokens long"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _vocabulary(path: str) -> int:
    tokenizer = pieces.load_tokenizer(path)
    return tokenizer.get_piece_size() if path.endswith(".model") else tokenizer.get_vocab_size()


def read_shards(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every entry, read from the shard files.

    One task a shard; blocks are read one after the other, so a task holds one block.
    ``ids_crc32`` is the crc32 of the ids as little-endian unsigned 32-bit integers.
    """
    n = max(1, manifest.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader, rows = ShardReader(uri), []
                for key, ids in reader:
                    rows.append((decode_key(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) == 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["id", "start", "n_tokens", "ids_crc32"])
                        rows = []
                reader.close()
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["id", "start", "n_tokens", "ids_crc32"])

    out = manifest.select("uri", "start").repartition(n).mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long")
    return out.withColumnRenamed("id", id_col)


def lookup(manifest: DataFrame, doc_id: int | None) -> list[np.ndarray]:
    """The ids of one document: a scan of the small manifest, then Bloom filter and binary search per shard."""
    found = []
    for row in manifest.orderBy("shard").toLocalIterator():
        reader = ShardReader(row.uri)
        found += reader.get(doc_id)
        reader.close()
    return found


def token_shards(docs: DataFrame, tokenizer_path: str, end_id: int | None = 0, folder: str | None = None, **columns) -> DataFrame:
    """Write shards (to ``folder``, else a new one in the shared folder) and return what is read back."""
    spark: SparkSession = docs.sparkSession
    folder = folder or scratch_path(spark, "token-shards")
    return read_shards(write_shards(docs, folder, tokenizer_path, end_id, **columns), columns.get("id_col", "doc_id"))


