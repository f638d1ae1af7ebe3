"""Token ids in sorted-string-table shards.

A shard holds documents in ascending key order:

    magic | data blocks | sparse index | Bloom filter | footer

A key is 13 bytes: 0 for a null id or 1, the id big-endian with its sign flipped, and the ordinal among rows of the same id. In a
block each entry stores how many bytes its key shares with the one before, the rest of the key, and the ids as little-endian
unsigned integers of the footer's width; a crc32 ends the block. The index has each block's first key, place and length. A lookup
asks the Bloom filter, bisects the index and reads one block.

Documents are dealt to shards by range of the id and sorted there; each task streams one shard to a name of its own attempt, and
the manifest (a row a shard, a written table) has that of the attempt that Spark took, so a task that is repeated, or runs
twice at once, never touches a file that is read. Places of
documents among all ids follow from the manifest's running sum. Results: a null text counts as empty; rows of equal id follow each other,
ordered by a hash of the text; null ids come first; an empty table makes no shard and an empty result.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, batch, ids_and_texts, in_slices, spark_schema
from .tokens import encoder

MAGIC = b"VEILSST1"
FOOTER = struct.Struct("<QQQQQQQ8s")  # index at, entries; Bloom at, bytes; documents, tokens, width, magic
INDEX = struct.Struct("<13sQI")
BLOCK_BYTES = 64 << 10
BLOOM_BITS, BLOOM_HASHES = 10, 7


def key_of(doc_id: int | None, ordinal: int = 0) -> bytes:
    head = b"\0" + bytes(8) if doc_id is None else b"\1" + (doc_id + (1 << 63)).to_bytes(8, "big")
    return head + ordinal.to_bytes(4, "big")


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else int.from_bytes(key[1:9], "big") - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _bloom_bits(key: bytes, bits: int) -> list[int]:
    """Of the id alone, without the ordinal."""
    a, b = zlib.crc32(key[:9]), zlib.crc32(key[:9], 0x5BD1E995) | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class ShardWriter:
    """Takes entries in ascending key order; holds one block, the index and the keys' hashes."""

    def __init__(self, out, width: int) -> None:
        self.out, self.width, self.at = out, width, 0
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.n_tokens = 0
        self._put(MAGIC)
        self._open()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _open(self) -> None:
        self.block, self.first, self.last = bytearray(), b"", b""

    def _close(self) -> None:
        if self.block:
            self.index.append((self.first, self.at, len(self.block) + 4))
            self._put(bytes(self.block) + struct.pack("<I", zlib.crc32(self.block)))
        self._open()

    def add(self, key: bytes, ids: bytes) -> None:
        """``ids``: unsigned 32-bit little-endian."""
        if self.keys and key <= self.keys[-1]:
            raise ValueError("keys must ascend")
        value = np.frombuffer(ids, dtype="<u4").astype(f"<u{self.width}").tobytes()
        self.n_tokens += len(ids) // 4
        shared = 0
        if self.block:
            while shared < 13 and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        self.block += _varint(shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(key)
        if len(self.block) >= BLOCK_BYTES:
            self._close()

    def finish(self) -> None:
        self._close()
        index_at = self.at
        for entry in self.index:
            self._put(INDEX.pack(*entry))
        bloom_at, bits = self.at, max(64, BLOOM_BITS * len(self.keys))
        bloom = bytearray(-(-bits // 8))
        for k in self.keys:
            for b in _bloom_bits(k, len(bloom) * 8):
                bloom[b >> 3] |= 1 << (b & 7)
        self._put(bytes(bloom))
        self._put(FOOTER.pack(index_at, len(self.index), bloom_at, len(bloom), len(self.keys), self.n_tokens, self.width, MAGIC))


class ShardReader:
    """Reads a shard through a seekable file."""

    def __init__(self, file) -> None:
        self.file = file
        file.seek(0, 2)
        file.seek(file.tell() - FOOTER.size)
        index_at, n, bloom_at, bloom_len, self.n_docs, self.n_tokens, self.width, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        file.seek(index_at)
        self.index = list(INDEX.iter_unpack(file.read(n * INDEX.size)))
        file.seek(bloom_at)
        self.bloom = file.read(bloom_len)

    def _block(self, at: int, length: int) -> Iterator[tuple[bytes, np.ndarray]]:
        self.file.seek(at)
        data = self.file.read(length)
        if struct.unpack("<I", data[-4:])[0] != zlib.crc32(data[:-4]):
            raise ValueError("a block is damaged")
        p, end, key = 0, len(data) - 4, b""
        while p < end:
            numbers = []
            for _ in range(2):
                n = shift = 0
                while True:
                    byte = data[p]
                    p += 1
                    n |= (byte & 127) << shift
                    shift += 7
                    if byte < 128:
                        break
                numbers.append(n)
            shared, size = numbers
            key = key[:shared] + data[p : p + 13 - shared]
            p += 13 - shared
            yield key, np.frombuffer(data, dtype=f"<u{self.width}", count=size // self.width, offset=p)
            p += size

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for _, at, length in self.index:
            for key, ids in self._block(at, length):
                yield id_of(key), ids

    def may_hold(self, doc_id: int | None) -> bool:
        return all(self.bloom[b >> 3] >> (b & 7) & 1 for b in _bloom_bits(key_of(doc_id), len(self.bloom) * 8))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every row of that id."""
        out: list[np.ndarray] = []
        if not self.may_hold(doc_id):
            return out
        first = key_of(doc_id)
        at = max(0, bisect_right(self.index, first, key=lambda e: e[0]) - 1)
        for _, place, length in self.index[at:]:
            for key, ids in self._block(place, length):
                if key[:9] == first[:9]:
                    out.append(ids)
                elif key > first:
                    return out
        return out


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


MANIFEST = pa.schema([("shard", pa.int32()), ("uri", pa.string()), ("first_id", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
ROWS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def write_shards(docs: DataFrame, scratch: Scratch, tokenizer: str, end_id: int, docs_per_shard: int = 8192, shard_bytes: int = 256 << 20) -> DataFrame:
    """Writes shards under ``scratch`` and returns the manifest, ordered by ``shard``; ``scratch`` must be shared. A shard has about
    ``shard_bytes`` of text, or ``docs_per_shard`` documents where that gives at most four shards a core."""
    light = ids_and_texts(docs)
    size = light.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    n = max(1, -(-size.bytes // shard_bytes), min(-(-size.n // docs_per_shard), 4 * docs.sparkSession.sparkContext.defaultParallelism))
    root = scratch.path("shards")
    dealt = light.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        shard, encode = task.partitionId(), encoder(tokenizer).encode
        fs, place = _filesystem(root)
        fs.create_dir(place, recursive=True)
        name = f"{shard:07d}-{task.taskAttemptId()}.sst"
        end = end_id.to_bytes(4, "little")
        writer, out, last, ordinal, first = None, None, None, 0, None
        for b in in_slices(batches):
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                if writer is None:
                    out = fs.open_output_stream(f"{place}/{name}")
                    writer, first = ShardWriter(out, 2 if encoder(tokenizer).whole.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4), doc_id
                    ordinal = 0
                else:
                    ordinal = ordinal + 1 if doc_id == last else 0
                last = doc_id
                writer.add(key_of(doc_id, ordinal), encode(text or "") + end)
        if writer is not None:
            writer.finish()
            out.close()
            yield batch(MANIFEST, shard=[shard], uri=[f"{root}/{name}"], first_id=[first], n_docs=[len(writer.keys)], n_tokens=[writer.n_tokens])

    return scratch.save(dealt.mapInArrow(run, spark_schema(MANIFEST)), "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """Each document as read back: doc_id, start, n_tokens, ids_crc32."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    placed = manifest.select("uri", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"))

    def run(batches):
        for b in batches:
            for uri, start in zip(b.column("uri").to_pylist(), b.column("start").to_pylist()):
                fs, place = _filesystem(uri)
                with fs.open_input_file(place) as file:
                    rows: list[tuple] = []
                    for doc_id, ids in ShardReader(file):
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                    yield batch(ROWS, **dict(zip(ROWS.names, map(list, zip(*rows)))))

    return placed.repartition(max(1, manifest.count())).mapInArrow(run, spark_schema(ROWS))
