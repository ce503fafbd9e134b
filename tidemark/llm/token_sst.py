"""Token ids in sorted-string-table shards.

A shard holds documents in ascending order of their key: prefix-compressed data
blocks with restart points and a checksum, a sparse index with the last key of
each block, a Bloom filter over the keys and a fixed footer.  A lookup reads the
footer, asks the filter, bisects the index and then the restart points of one
block.  Shards are written by the tasks that hold a range of ids; a shard counts
only if the manifest names it, so that attempts of lost executors do no harm.
"""

from __future__ import annotations

import bisect
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, shared_fs
from .fast_tokens import encoder

MAGIC = b"TIDESST1"
FOOTER = struct.Struct("<QQQQQQBBxxI8s")  # index, filter (offset, length), documents, tokens, bytes of an id, hashes, checksum, magic
BLOCK_BYTES, RESTART_EVERY, BLOOM_BITS, BLOOM_HASHES = 64 << 10, 16, 10, 7
#: Texts (characters) that are encoded in one call.
ENCODE_CHARS = 4 << 20


def key_of(doc_id: int | None) -> bytes:
    """Bytes in the order of the ids, null first."""
    return b"\x00" if doc_id is None else b"\x01" + ((doc_id + (1 << 63)) & ((1 << 64) - 1)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return None if key == b"\x00" else int.from_bytes(key[1:9], "big") - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, at
        shift += 7


def _bloom_places(keys: list[bytes], bits: int) -> np.ndarray:
    import xxhash

    h = np.array([(xxhash.xxh64_intdigest(k, 1), xxhash.xxh64_intdigest(k, 2) | 1) for k in keys], np.uint64).reshape(-1, 2)
    return (h[:, :1] + np.arange(BLOOM_HASHES, dtype=np.uint64) * h[:, 1:]) % np.uint64(bits)


class SSTWriter:
    """Takes (key, ids) in ascending order of key; equal keys may repeat."""

    def __init__(self, sink, width: int):
        self.sink, self.width, self.at = sink, width, 0
        self.block, self.restarts, self.in_block, self.last = bytearray(), [], 0, b""
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.tokens = 0

    def add(self, key: bytes, ids: bytes) -> None:
        if self.keys and key < self.last:
            raise ValueError("keys must ascend")
        shared = 0
        if self.in_block % RESTART_EVERY == 0:
            self.restarts.append(len(self.block))
        else:
            limit = min(len(key), len(self.last))
            while shared < limit and key[shared] == self.last[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(ids)) + key[shared:] + ids
        self.in_block += 1
        self.last = key
        self.keys.append(key)
        self.tokens += len(ids) // self.width
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _put(self, data: bytes) -> tuple[int, int]:
        self.sink.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)

    def _flush(self) -> None:
        if self.in_block:
            body = bytes(self.block) + struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts))
            self.index.append((self.last, *self._put(body + struct.pack("<I", zlib.crc32(body)))))
            self.block, self.restarts, self.in_block = bytearray(), [], 0

    def close(self) -> dict:
        self._flush()
        index = self._put(b"".join(struct.pack("<H", len(k)) + k + struct.pack("<QI", o, n) for k, o, n in self.index))
        bits = max(64, len(self.keys) * BLOOM_BITS)
        filled = np.zeros(-(-bits // 8) * 8, bool)
        for i in range(0, len(self.keys), 100_000):
            filled[_bloom_places(self.keys[i : i + 100_000], bits).ravel().astype(np.int64)] = True
        bloom = self._put(struct.pack("<Q", bits) + np.packbits(filled, bitorder="little").tobytes())
        start = FOOTER.pack(*index, *bloom, len(self.keys), self.tokens, self.width, BLOOM_HASHES, 0, MAGIC)
        self._put(FOOTER.pack(*index, *bloom, len(self.keys), self.tokens, self.width, BLOOM_HASHES, zlib.crc32(start), MAGIC))
        return {"docs": len(self.keys), "tokens": self.tokens, "bytes": self.at}


class SSTReader:
    """Over an open, seekable file.  Raises ValueError where a checksum fails."""

    def __init__(self, source):
        self.source = source
        size = source.seek(0, 2)
        self.index_at, self.index_len, self.bloom_at, self.bloom_len, self.docs, self.tokens, self.width, self.hashes, check, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC or check != zlib.crc32(FOOTER.pack(self.index_at, self.index_len, self.bloom_at, self.bloom_len, self.docs, self.tokens, self.width, self.hashes, 0, MAGIC)):
            raise ValueError("not a complete table")
        raw, at = self._read(self.index_at, self.index_len), 0
        self.last_keys: list[bytes] = []
        self.blocks: list[tuple[int, int]] = []
        while at < len(raw):
            (n,) = struct.unpack_from("<H", raw, at)
            self.last_keys.append(raw[at + 2 : at + 2 + n])
            self.blocks.append(struct.unpack_from("<QI", raw, at + 2 + n))
            at += 14 + n
        self._bloom: bytes | None = None

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def _block(self, i: int) -> tuple[bytes, list[int], int]:
        raw = self._read(*self.blocks[i])
        body, (check,) = raw[:-4], struct.unpack("<I", raw[-4:])
        if zlib.crc32(body) != check:
            raise ValueError(f"block {i} is damaged")
        (n,) = struct.unpack("<I", body[-4:])
        end = len(body) - 4 * (n + 1)
        return body, list(struct.unpack_from(f"<{n}I", body, end)), end

    @staticmethod
    def _entry(body: bytes, at: int, before: bytes) -> tuple[bytes, int, int]:
        shared, at = _read_varint(body, at)
        own, at = _read_varint(body, at)
        n, at = _read_varint(body, at)
        return before[:shared] + body[at : at + own], at + own, at + own + n

    def may_hold(self, key: bytes) -> bool:
        if self._bloom is None:
            self._bloom = self._read(self.bloom_at, self.bloom_len)
        (bits,) = struct.unpack("<Q", self._bloom[:8])
        return all(self._bloom[8 + p // 8] >> p % 8 & 1 for p in _bloom_places([key], bits)[0].tolist())

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document of this id, by binary search."""
        key, out = key_of(doc_id), []
        if not self.docs or not self.may_hold(key):
            return out
        for i in range(bisect.bisect_left(self.last_keys, key), len(self.blocks)):
            body, restarts, end = self._block(i)
            low = max(0, bisect.bisect_left(restarts, key, key=lambda r: self._entry(body, r, b"")[0]) - 1)
            at, k = restarts[low], b""
            while at < end:
                k, value, at = self._entry(body, at, k)
                if k == key:
                    out.append(np.frombuffer(body[value:at], f"<u{self.width}"))
                elif k > key:
                    return out
            if self.last_keys[i] > key:
                break
        return out

    def scan(self) -> Iterator[tuple[int | None, bytes]]:
        for i in range(len(self.blocks)):
            body, _, end = self._block(i)
            at, k = 0, b""
            while at < end:
                k, value, at = self._entry(body, at, k)
                yield id_of(k), body[value:at]


def write_tables(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int | None = 1, doc_id: str = "doc_id", text: str = "text", shards: int | None = None) -> list[dict]:
    """Encodes every whole text, appends ``end_id`` and writes tables in ascending order of id; returns the manifest.

    Null text is empty; null ids come first; rows of one id stand together, in
    the order of their texts' hashes.  An empty table writes no shard.  The
    manifest (a row for each shard: path, docs, tokens, bytes, start) is also
    written to ``path``/manifest.json.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "sst")
    fs, local = shared_fs(path)
    fs.create_dir(local, recursive=True)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ranged = rows.repartitionByRange(shards, "doc_id") if shards else rows.repartitionByRange("doc_id")
    ordered = ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))

    def write(batches):
        enc, writer, sink, name = encoder(tokenizer), None, None, ""
        end = b"" if end_id is None else np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for part in _by_chars(batch.column(1)):
                texts = part.to_pylist()
                for doc, own in zip(ids, enc.encode(texts), strict=False):
                    if writer is None:
                        name = f"{local}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.sst"
                        sink = shared_fs(path)[0].open_output_stream(name)
                        writer = SSTWriter(sink, enc.dtype.itemsize)
                    writer.add(key_of(doc), own + end)
                ids = ids[len(texts) :]
        if writer is not None:
            done = writer.close()
            sink.close()
            yield pa.RecordBatch.from_pylist([done | {"path": name, "shard": TaskContext.get().partitionId()}], schema=_MANIFEST)

    found = sorted((r.asDict() for r in ordered.mapInArrow(write, "shard int, path string, docs long, tokens long, bytes long").collect()), key=lambda r: r["shard"])
    start = 0
    for r in found:
        r["start"] = start
        start += r["tokens"]
    with fs.open_output_stream(f"{local}/manifest.json") as f:
        f.write(json.dumps({"root": path, "shards": found}).encode())
    return [r | {"root": path} for r in found]


_MANIFEST = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())])


def _by_chars(column: pa.Array) -> Iterator[pa.Array]:
    """Slices of about ENCODE_CHARS bytes."""
    sizes = np.cumsum(column.nbytes // max(len(column), 1) * np.ones(len(column))) if column.null_count else np.cumsum(np.diff(np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]))
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + ENCODE_CHARS, side="right")))
        yield column.slice(at, end - at)
        at = end


def read_tables(spark: SparkSession, manifest: list[dict]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files; ``start`` counts all ids before it."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not manifest:
        return spark.createDataFrame([], schema)

    def read(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                shard = manifest[i]
                with shared_fs(shard["root"])[0].open_input_file(shard["path"]) as f:
                    table, start, out = SSTReader(f), shard["start"], []
                    for doc, raw in table.scan():
                        n = len(raw) // table.width
                        wide = np.frombuffer(raw, f"<u{table.width}").astype("<u4").tobytes()
                        out.append((doc, start, n, zlib.crc32(wide)))
                        start += n
                        if len(out) == 10_000:
                            yield _result(out)
                            out = []
                    if out:
                        yield _result(out)

    n = len(manifest)
    return spark.range(0, n, 1, n).mapInArrow(read, schema)


def _result(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def lookup(manifest: list[dict], doc_id: int | None) -> list[np.ndarray]:
    """The ids of one document: asks each shard's filter, then bisects."""
    out: list[np.ndarray] = []
    for shard in manifest:
        with shared_fs(shard["root"])[0].open_input_file(shard["path"]) as f:
            out += SSTReader(f).get(doc_id)
    return out
