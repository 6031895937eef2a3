"""Sorted-string-table shards of token ids: documents keyed by identifier, found again by binary search.

A shard holds, in this order: data blocks; a sparse index with the last key, place and length of each block; a Bloom
filter over the keys; a footer of fixed size. In a block a key drops the prefix that it shares with the key before it;
the first key of a block is whole. Keys are 8-byte big-endian with the sign bit turned, so byte order is number order;
a null identifier has the empty key and comes first. Values are ids in two or four little-endian bytes each, one width
per shard. Every block ends with its CRC-32.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, written
from .tokens import encoder

MAGIC = b"SWSST001"
#: Data bytes after which a block is closed.
BLOCK_BYTES = 64 << 10
#: Bloom filter: bits per key and probes.
BLOOM_BITS, BLOOM_PROBES = 10, 7
_FOOTER = struct.Struct("<QQQQQQQB8s")
MANIFEST = "shard int, path string, n_docs long, n_tokens long, first_key binary, last_key binary, bytes long"
#: Bytes of text of a shard, if the session's number of shuffle partitions does not make it smaller; runs of shards whose
#: borders are sent to all tasks by a lookup; parts into which rows with one identifier are dealt.
SHARD_BYTES, MOST_RUNS, SALTS = 256 << 20, 10_000, 64


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key, "big") - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(raw: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = raw[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, n_bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1
    return [(a + k * b + k * k) % n_bits for k in range(BLOOM_PROBES)]


class TableWriter:
    """Writes one shard. Keys must come in ascending order; equal keys are kept, each with its value."""

    def __init__(self, out, width: int):
        self.out, self.width, self.at = out, width, 0
        self.block, self.last, self.index, self.keys = bytearray(), b"", [], []
        self.first: bytes | None = None
        self.tokens = self.docs = 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.first is None:
            self.first = key
        elif key < self.last:
            raise ValueError("keys must ascend")
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        value = ids.astype("<u2" if self.width == 2 else "<u4").tobytes()
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(key)
        self.tokens += len(ids)
        self.docs += 1
        if len(self.block) >= BLOCK_BYTES:
            self._close_block()

    def _put(self, raw: bytes) -> None:
        self.out.write(raw)
        self.at += len(raw)

    def _close_block(self) -> None:
        if self.block:
            raw = bytes(self.block)
            self.index.append((self.last, self.at, len(raw) + 4))
            self._put(raw + struct.pack("<I", zlib.crc32(raw)))
            self.block.clear()

    def finish(self) -> None:
        self._close_block()
        index_at = self.at
        self._put(b"".join(_varint(len(k)) + k + _varint(a) + _varint(n) for k, a, n in self.index))
        bloom_at, n_bits = self.at, max(64, BLOOM_BITS * len(self.keys))
        bits = np.zeros(-(-n_bits // 8), np.uint8)
        for key in dict.fromkeys(self.keys):
            for p in _probes(key, n_bits):
                bits[p >> 3] |= 1 << (p & 7)
        self._put(bits.tobytes())
        self._put(_FOOTER.pack(index_at, len(self.index), bloom_at, n_bits, self.docs, self.tokens, self.at, self.width, MAGIC))


class TableReader:
    """Reads one shard; only the footer, index, filter and the blocks asked for."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        index_at, n_blocks, bloom_at, self.n_bits, self.docs, self.tokens, end, self.width, magic = _FOOTER.unpack(
            source.read_at(_FOOTER.size, size - _FOOTER.size)
        )
        if magic != MAGIC or end != size - _FOOTER.size:
            raise ValueError("not a whole shard")
        raw, at, self.blocks = source.read_at(bloom_at - index_at, index_at), 0, []
        for _ in range(n_blocks):
            n, at = _read_varint(raw, at)
            key = raw[at : at + n]
            place, at = _read_varint(raw, at + n)
            length, at = _read_varint(raw, at)
            self.blocks.append((key, place, length))
        self.last_keys = [b[0] for b in self.blocks]
        self.bloom = source.read_at(end - bloom_at, bloom_at)

    def _entries(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, place, length = self.blocks[k]
        raw = self.source.read_at(length, place)
        if zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError(f"block {k} is damaged")
        at, key = 0, b""
        while at < length - 4:
            shared, at = _read_varint(raw, at)
            own, at = _read_varint(raw, at)
            n, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + own]
            at += own + n
            yield key, np.frombuffer(raw[at - n : at], "<u2" if self.width == 2 else "<u4").astype("<u4")

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for k in range(len(self.blocks)):
            yield from self._entries(k)

    def get(self, key: bytes) -> list[np.ndarray]:
        """The values of a key; the filter answers most misses, binary search finds the block."""
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.n_bits)):
            return []
        found, k = [], bisect.bisect_left(self.last_keys, key)
        while k < len(self.blocks):
            found += [v for e, v in self._entries(k) if e == key]
            if self.last_keys[k] > key:
                break
            k += 1
        return found


def write_tables(
    docs: DataFrame,
    tokenizer_path: str,
    path: str | None = None,
    n_shards: int | None = None,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Writes every row's ids into shards in ascending identifier order and returns their manifest, itself written.

    A null text counts as empty (the end id alone); a null identifier comes first; rows with equal identifiers are all
    kept, next to each other, in the order of their texts within a shard. Only the two named columns are read. An empty table gives
    no shards. A shard is written under a temporary name and renamed, so a repeated task replaces it by the same bytes; what
    lost tasks leave is removed in the end. Shards are as many as the bytes of text ask for, and an identifier that many
    rows share may have several.
    """
    spark = docs.sparkSession
    path = path or fresh_path(spark, "sstable")
    if n_shards is None:
        size = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
        n_shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, made, end = TaskContext.get().partitionId(), None, np.array([end_id], "<u4")
        enc = encoder(tokenizer_path)
        width = 2 if max(enc.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                if made is None:
                    fs, root = pafs.FileSystem.from_uri(path)
                    fs.create_dir(root, recursive=True)
                    name = f"{root}/shard-{shard:06d}.sst"
                    draft = f"{name}.{uuid.uuid4().hex}.draft"
                    out = fs.open_output_stream(draft)
                    made = TableWriter(out, width)
                texts = [t or "" for t in part.column(1).to_pylist()]
                for key, raw in zip(part.column(0).to_pylist(), enc.encode(texts), strict=True):
                    made.add(key_of(key), np.concatenate([np.frombuffer(raw, "<u4"), end]))
        if made is not None:
            made.finish()
            out.close()
            fs.move(draft, name)
            row = [shard, f"{path}/shard-{shard:06d}.sst", made.docs, made.tokens, made.first, made.last, made.at]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, arrow, strict=True)], schema=arrow)

    arrow = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("first_key", pa.binary()), ("last_key", pa.binary()), ("bytes", pa.int64())])
    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("body"))
    order = [F.col("key").asc_nulls_first(), "same", "salt"]
    rows = rows.withColumns({"same": F.xxhash64("body"), "salt": F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS))})
    sorted_rows = rows.repartitionByRange(n_shards, *order).sortWithinPartitions(order[0], "body").select("key", "body")
    found = written(sorted_rows.mapInArrow(run, MANIFEST), "manifest")
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for left in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/*.draft")) or []:
        fs.delete(left.getPath(), False)
    return found


def _open(path: str) -> TableReader:
    fs, name = pafs.FileSystem.from_uri(path)
    return TableReader(fs.open_input_file(name))


def read_tables(manifest: DataFrame) -> DataFrame:
    """Reads the shards back: ``doc_id, start, n_tokens, ids_crc32`` with ``start`` the ids of all documents before it."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one short row per shard
    shards = manifest.select("shard", "path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch() -> pa.RecordBatch:
            cols = [list(c) for c in zip(*rows, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

        names, rows = ["doc_id", "start", "n_tokens", "ids_crc32"], []
        for shard in batches:
            for path, start in zip(shard.column(1).to_pylist(), shard.column(2).to_pylist(), strict=True):
                for key, ids in _open(path):
                    rows.append((id_of(key), start, len(ids), zlib.crc32(ids.tobytes())))
                    start += len(ids)
                    if len(rows) >= 10_000:
                        yield batch()
        if rows:
            yield batch()

    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return shards.repartition(n, "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(spark: SparkSession, manifest: DataFrame, keys: DataFrame, key_col: str = "doc_id") -> DataFrame:
    """Ids of the asked documents: ``doc_id, ids``; a key without documents gives no row, one in several shards those of all.

    A key first finds its runs of consecutive shards, of which there are at most ``MOST_RUNS``, then, by a join, the shards of
    the run that may hold it; a shard is opened once, for all its keys.
    """
    width = max(1, -(-(manifest.agg(F.max("shard")).first()[0] or 0) // MOST_RUNS))
    runs = manifest.groupBy(F.floor(F.col("shard") / width).alias("run")).agg(F.min("first_key").alias("lo"), F.max("last_key").alias("hi")).orderBy("run").collect()
    places, lows, highs = [r.run for r in runs], [bytes(r.lo) for r in runs], [bytes(r.hi) for r in runs]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id in batch.column(0).to_pylist():
                key = key_of(doc_id)
                out += [(doc_id, key, places[k]) for k in range(bisect.bisect_left(highs, key), bisect.bisect_right(lows, key))]
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int64())], names=["doc_id", "key", "run"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, reader = None, None
        for batch in batches:
            found = []
            for doc_id, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own != path:
                    path, reader = own, _open(own)
                found += [(doc_id, v.tolist()) for v in reader.get(key_of(doc_id))]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    asked = keys.select(F.col(key_col).cast("long").alias("doc_id")).distinct().mapInArrow(place, "doc_id long, key binary, run long")
    shards = manifest.select(F.floor(F.col("shard") / width).alias("run"), "path", "first_key", "last_key")
    held = asked.join(shards, "run").filter("first_key <= key and key <= last_key").select("doc_id", "path")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return held.repartition(n, "path").sortWithinPartitions("path", "doc_id").mapInArrow(run, "doc_id long, ids array<long>")
