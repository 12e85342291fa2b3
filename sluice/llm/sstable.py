"""Token ids of documents in sorted-string-table shards.

A shard is one file: data blocks, an index block, a Bloom filter, and a footer.

* data block: zstd of entries and restart points.  Entry: varints (bytes shared with the
  previous key, further key bytes, value bytes), those key bytes, the value.  Every
  ``RESTART``-th entry shares nothing; the block ends with the offsets of those entries
  and their number (unsigned 32-bit).
* index block: zstd of one entry a data block: its last key, offset, size, crc32.
* Bloom filter: bit array over the xxh64 of the keys, ``BLOOM_PROBES`` probes.
* footer (fixed size): offsets and sizes of index and filter, counts, magic number.

A key is the document id as eight bytes whose byte order is the ids' order (a null id is
the empty key, which comes first); a value is the ids as little-endian unsigned 32-bit.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import common, tokens

BLOCK_BYTES = 64 * 1024
RESTART = 16
BLOOM_BITS_PER_KEY = 10
BLOOM_PROBES = 7
MAGIC = 0x534C_5549_4345_3031
_FOOTER = struct.Struct("<QQQQQQQQ")
_INDEX = struct.Struct("<QII")


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


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _shared(a: bytes, b: bytes) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


class Writer:
    """Writes one shard to a binary stream; keys must not decrease (equal keys may repeat)."""

    def __init__(self, out, block_bytes: int = BLOCK_BYTES) -> None:
        import xxhash
        import zstandard

        self._out, self._limit, self._at = out, block_bytes, 0
        self._hash, self._pack = xxhash.xxh64_intdigest, zstandard.ZstdCompressor(level=1).compress
        self._entries, self._restarts, self._n, self._last = bytearray(), [], 0, b""
        self._index, self._hashes = bytearray(), []
        self.docs = self.tokens = self.blocks = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        key = key_of(doc_id)
        if self.docs and key < self._last:
            raise ValueError("keys must not decrease")
        same = _shared(self._last, key)
        if self._n % RESTART == 0:
            self._restarts.append(len(self._entries))
            same = 0
        self._entries += _varint(same) + _varint(len(key) - same) + _varint(len(ids)) + key[same:] + ids
        self._hashes.append(self._hash(key))
        self._last, self._n = key, self._n + 1
        self.docs += 1
        self.tokens += len(ids) // 4
        if len(self._entries) >= self._limit:
            self._flush()

    def _write(self, data: bytes) -> tuple[int, int]:
        self._out.write(data)
        self._at += len(data)
        return self._at - len(data), len(data)

    def _flush(self) -> None:
        tail = struct.pack(f"<{len(self._restarts) + 1}I", *self._restarts, len(self._restarts))
        data = self._pack(bytes(self._entries) + tail)
        at, size = self._write(data)
        self._index += _varint(len(self._last)) + self._last + _INDEX.pack(at, size, zlib.crc32(data))
        self._entries, self._restarts, self._n = bytearray(), [], 0
        self.blocks += 1

    def close(self) -> int:
        """The shard's size in bytes."""
        if self._n:
            self._flush()
        index = self._write(self._pack(bytes(self._index)))
        bits = bytearray((max(1, len(self._hashes)) * BLOOM_BITS_PER_KEY + 7) // 8)
        for h in self._hashes:
            for k in _probes(h, len(bits) * 8):
                bits[k >> 3] |= 1 << (k & 7)
        bloom = self._write(bytes(bits))
        self._write(_FOOTER.pack(*index, *bloom, self.docs, self.tokens, self.blocks, MAGIC))
        return self._at


def _probes(h: int, n_bits: int) -> list[int]:
    low, high = h & 0xFFFFFFFF, h >> 32 | 1
    return [(low + i * high) % n_bits for i in range(BLOOM_PROBES)]


class Table:
    """Reads a shard from a seekable binary file: in order, or one key by binary search."""

    def __init__(self, file) -> None:
        import xxhash
        import zstandard

        self._file, self._hash = file, xxhash.xxh64_intdigest
        self._unpack = zstandard.ZstdDecompressor().decompress
        file.seek(0, 2)
        end = file.tell()
        (i_at, i_size, b_at, b_size, self.docs, self.tokens, self.blocks, magic) = _FOOTER.unpack(
            self._bytes(end - _FOOTER.size, _FOOTER.size)
        )
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        self._bloom = self._bytes(b_at, b_size)
        self._keys: list[bytes] = []
        self._places: list[tuple[int, int, int]] = []
        data, at = self._unpack(self._bytes(i_at, i_size)), 0
        while at < len(data):
            n, at = _read_varint(data, at)
            self._keys.append(data[at : at + n])
            self._places.append(_INDEX.unpack_from(data, at + n))
            at += n + _INDEX.size

    def _bytes(self, at: int, size: int) -> bytes:
        self._file.seek(at)
        return self._file.read(size)

    def _block(self, k: int) -> tuple[bytes, list[int]]:
        at, size, crc = self._places[k]
        data = self._bytes(at, size)
        if zlib.crc32(data) != crc:
            raise ValueError(f"block {k} is damaged")
        data = self._unpack(data)
        (n,) = struct.unpack_from("<I", data, len(data) - 4)
        end = len(data) - 4 * (n + 1)
        return data[:end], list(struct.unpack_from(f"<{n}I", data, end))

    @staticmethod
    def _entries(data: bytes, at: int = 0) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < len(data):
            same, at = _read_varint(data, at)
            more, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:same] + data[at : at + more]
            at += more
            yield key, data[at : at + size]
            at += size

    def __iter__(self) -> Iterator[tuple[int | None, bytes]]:
        for k in range(len(self._places)):
            for key, value in self._entries(self._block(k)[0]):
                yield id_of(key), value

    def may_hold(self, doc_id: int | None) -> bool:
        """False only if the shard surely lacks the document."""
        return all(self._bloom[k >> 3] >> (k & 7) & 1 for k in _probes(self._hash(key_of(doc_id)), len(self._bloom) * 8))

    def get(self, doc_id: int | None) -> list[bytes]:
        """All values of a document, in file order; none if it isn't there."""
        key, out = key_of(doc_id), []
        if not self.may_hold(doc_id):
            return out
        for k in range(bisect_left(self._keys, key), len(self._keys)):
            data, restarts = self._block(k)
            lo, hi = 0, len(restarts) - 1
            while lo < hi:  # the last restart point whose key is smaller
                mid = (lo + hi + 1) // 2
                lo, hi = (mid, hi) if next(self._entries(data, restarts[mid]))[0] < key else (lo, mid - 1)
            for found, value in self._entries(data, restarts[lo] if restarts else 0):
                if found > key:
                    return out
                if found == key:
                    out.append(value)
        return out


def write_shards(docs: DataFrame, path: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode *docs* and write them under *path* as shards that follow each other in id order.

    Returns the shards: shard, path, n_docs, n_tokens.  The rows are range-partitioned by
    (id, hash of the text), so that rows that share an id may part, and each task streams
    its sorted rows through one writer: memory is one Arrow batch, one block and eight
    bytes a key.  A task writes under a name of its own attempt, and only the table of shards, which
    one attempt of each task gets into, says which files count; the others are deleted.  Null texts count as empty;
    null ids come first; rows that share an id follow each other in the order of the texts'
    hashes; an empty table gives one empty shard or none.  Other columns are not read.
    """
    table = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    table = table.withColumn("h", F.xxhash64("text"))
    table = table.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
    path = common.qualified(docs.sparkSession, path)

    def write(batches):
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        final = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.sst"
        encode, end = tokens.encoder(vocabulary).encode, struct.pack("<I", end_id)
        with store.open_output_stream(final) as out:
            writer = Writer(out)
            for batch in batches:
                for k in range(0, batch.num_rows, 1000):
                    rows = batch.slice(k, 1000)
                    for doc, x in zip(rows.column("doc_id").to_pylist(), encode(rows.column("text").to_pylist())):
                        writer.add(doc, x + end)
            writer.close()
        yield pa.RecordBatch.from_pydict(
            {"shard": [shard], "path": [final], "n_docs": [writer.docs], "n_tokens": [writer.tokens]},
            schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]),
        )

    shards = common.stage(table.select("doc_id", "text").mapInArrow(write, "shard int, path string, n_docs long, n_tokens long"), "shards", keep=True)
    common.keep_only(docs.sparkSession, path, {r["path"].rsplit("/", 1)[1] for r in shards.select("path").collect()})
    return shards


def read_shards(spark: SparkSession, root: str, shards: DataFrame) -> DataFrame:
    """Read shards back: doc_id, start (ids of all documents before it), ids (binary).

    Only the shards' counts, one row a file, come to the driver, to place the files' starts.
    """
    root, base, rows = common.qualified(spark, root), 0, []
    for r in shards.orderBy("shard").collect():
        rows.append((r["shard"], r["path"], base))
        base += r["n_tokens"]
    places = spark.createDataFrame(rows, "shard int, path string, base long").repartition(max(1, len(rows)), "shard")

    def read(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(root)
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            for x in batch.to_pylist():
                with store.open_input_file(x["path"]) as f:
                    at, out, size = x["base"], [], 0
                    for doc, ids in Table(f):
                        out.append((doc, at, ids))
                        at, size = at + len(ids) // 4, size + len(ids)
                        if size >= 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                            out, size = [], 0
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return places.mapInArrow(read, "doc_id long, start long, ids binary")


def op7_sstable(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Every document's place and checksum, from the shards written for the whole table."""
    root = common.scratch_path(spark, "sstable")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    shards = write_shards(docs, root, vocabulary or tokens.vocabulary("byte_bpe_50k.json"), end_id=2)
    back = read_shards(spark, root, shards)
    return back.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
