"""Token ids in plane files: fixed-size id blocks transposed into bit or byte planes, each plane a zstd frame.

File: magic, the planes of every block one behind the other, then a chunk index (zstd-compressed JSON: for
each block its offset, ids, crc32 and plane sizes), the index's length, and the magic again. A plane of zeros
has size 0 and no bytes. Blocks decode independently, so a reader needs the index and the blocks it wants.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oriel.llm.common import file_system, prepare, slices
from oriel.llm.tokens import ByteBpe, shared
from oriel.session import scratch

MAGIC = b"OBPLANE1"
BLOCK_IDS = 1 << 16
#: Text bytes encoded at once; encoding takes some 40 times as much memory for its tables of code points.
ENCODED_BYTES = 1 << 20


def to_planes(ids: np.ndarray, mode: str) -> list[np.ndarray]:
    """Byte planes (4, low byte first) or bit planes (32, low bit first) of unsigned 32-bit ids."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    if mode == "byte":
        return list(np.ascontiguousarray(ids.view(np.uint8).reshape(-1, 4).T))
    if mode == "bit":
        bits = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
        return list(np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little"))
    raise ValueError(f"mode is bit or byte, not {mode!r}")


def from_planes(planes: list[np.ndarray | None], n: int, mode: str) -> np.ndarray:
    """Ids of planes; None stands for a plane of zeros."""
    width = n if mode == "byte" else -(-n // 8)
    full = np.stack([p if p is not None else np.zeros(width, np.uint8) for p in planes])
    if mode == "byte":
        return np.ascontiguousarray(full.T).view("<u4").ravel()
    bits = np.unpackbits(full, axis=1, count=n, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u4").ravel()


class PlaneWriter:
    """Appends ids to one file; call close() for the index."""

    def __init__(self, stream, mode: str = "byte", block: int = BLOCK_IDS, level: int = 3) -> None:
        self.stream, self.mode, self.block, self.coder = stream, mode, block, zstandard.ZstdCompressor(level=level)
        self.stream.write(MAGIC)
        self.at, self.waiting, self.n_waiting, self.chunks, self.total = len(MAGIC), [], 0, [], 0

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        self.total += len(ids)
        if self.n_waiting >= self.block:
            every = np.concatenate(self.waiting)
            whole = len(every) // self.block * self.block
            for i in range(0, whole, self.block):
                self._put(every[i : i + self.block])
            self.waiting, self.n_waiting = [every[whole:]], len(every) - whole

    def _put(self, ids: np.ndarray) -> None:
        frames = [self.coder.compress(p) if p.any() else b"" for p in map(np.ascontiguousarray, to_planes(ids, self.mode))]
        self.chunks.append([self.at, len(ids), zlib.crc32(np.ascontiguousarray(ids, dtype="<u4")), [len(f) for f in frames]])
        self.stream.write(b"".join(frames))
        self.at += sum(map(len, frames))

    def close(self) -> None:
        if self.n_waiting:
            self._put(np.concatenate(self.waiting))
        index = self.coder.compress(json.dumps({"mode": self.mode, "block": self.block, "chunks": self.chunks}).encode())
        self.stream.write(index + struct.pack("<I", len(index)) + MAGIC)
        self.stream.close()


class PlaneReader:
    """Random access to the ids of one file; remembers the block read last."""

    def __init__(self, file) -> None:
        self.file, self.coder = file, zstandard.ZstdDecompressor()
        size = file.size()
        tail = file.read_at(len(MAGIC) + 4, size - len(MAGIC) - 4)
        if tail[4:] != MAGIC:
            raise ValueError("not a plane file, or cut short")
        length = struct.unpack("<I", tail[:4])[0]
        index = json.loads(self.coder.decompress(file.read_at(length, size - len(MAGIC) - 4 - length)))
        self.mode, self.block, self.chunks = index["mode"], index["block"], index["chunks"]
        self.last, self.ids = -1, np.zeros(0, np.uint32)

    def chunk(self, k: int) -> np.ndarray:
        if k != self.last:
            at, n, crc, sizes = self.chunks[k]
            raw, planes, width = self.file.read_at(sum(sizes), at), [], n if self.mode == "byte" else -(-n // 8)
            for size in sizes:
                planes.append(np.frombuffer(self.coder.decompress(raw[:size], max_output_size=width), np.uint8) if size else None)
                raw = raw[size:]
            self.ids, self.last = from_planes(planes, n, self.mode), k
            if zlib.crc32(self.ids) != crc:
                raise ValueError(f"block {k} doesn't have the ids that were written")
        return self.ids

    def read(self, start: int, n: int) -> np.ndarray:
        parts = []
        while n > 0:
            k, skip = divmod(start, self.block)
            part = self.chunk(k)[skip : skip + n]
            if not len(part):
                raise ValueError("past the end of the file")
            parts.append(part.copy())
            start, n = start + len(part), n - len(part)
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def write_ids(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0, mode: str = "byte", block: int = BLOCK_IDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every text, append ``end_id``, and write plane files below ``path`` in ascending order of key.

    One file per range of keys; the returned table (stored below ``path``/index) has a row per document: key,
    part (number of its file), file, at (ids before it in the file), n_tokens. Nulls and empty texts have the
    end id alone; null keys come first; rows with equal keys go by their text's hash. Each task attempt writes
    a file of its own and only those of committed attempts are listed, so lost executors leave no half files
    in the index.
    """
    spark = docs.sparkSession
    prepare(spark)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()  # what tasks before this one left in the worker
        bpe, part, writer = shared(ByteBpe, tokenizer), TaskContext.get().partitionId(), None
        name = f"part-{part:06d}-{uuid.uuid4().hex[:8]}.obp"
        for batch in batches:
            column = batch.column(1)
            if writer is None:
                system, base = file_system(path)
                system.create_dir(base, recursive=True)
                writer = PlaneWriter(system.open_output_stream(f"{base}/{name}", compression=None), mode, block)
            counts, at = [], writer.total
            for row, rows in slices(column, ENCODED_BYTES):
                ids, n = bpe.encode(column.slice(row, rows))
                ends = np.cumsum(n)
                writer.add(np.insert(ids, ends, end_id))  # the end id goes behind each document
                counts.append(n + 1)
            n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            starts = at + np.cumsum(n) - n
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([part] * len(n), pa.int32()), pa.array([name] * len(n), pa.string()), pa.array(starts, pa.int64()), pa.array(n, pa.int64())], names=["k", "part", "file", "at", "n_tokens"])
        if writer is not None:
            writer.close()

    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    tie = F.xxhash64("t")
    ordered = rows.repartitionByRange(F.col("k").asc_nulls_first(), tie).sortWithinPartitions(F.col("k").asc_nulls_first(), tie)
    listed = ordered.mapInArrow(run, f"k {kind}, part int, file string, at long, n_tokens long")
    listed.write.parquet(f"{path}/index")
    return spark.read.parquet(f"{path}/index").withColumnRenamed("k", key)


def read_ids(index: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """Read plane files back: per document key, start (ids of all documents before it), n_tokens, ids_crc32.

    Each task decodes just the blocks that its rows lie in. The table of file sizes has a row per written
    partition, which is what makes its broadcast and its one-task running sum safe.
    """
    kind = index.schema[key].dataType.simpleString()
    sizes = index.groupBy("part", "file").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.select("file", F.coalesce(before, F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(path)
        opened, reader = None, None
        for batch in batches:
            crcs = []
            for name, at, n in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if name != opened:
                    opened, reader = name, PlaneReader(system.open_input_file(f"{base}/{name}"))
                crcs.append(zlib.crc32(np.ascontiguousarray(reader.read(at, n), dtype="<u4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(4), batch.column(3), pa.array(crcs, pa.int64())], names=["k", "start", "n_tokens", "ids_crc32"])

    rows = index.join(F.broadcast(bases), "file").select(F.col(key).alias("k"), "file", "at", "n_tokens", (F.col("base") + F.col("at")).alias("start"))
    return rows.mapInArrow(run, f"k {kind}, start long, n_tokens long, ids_crc32 long").withColumnRenamed("k", key)


def roundtrip(docs: DataFrame, tokenizer: str, mode: str = "byte", path: str | None = None) -> DataFrame:
    """Write the ids of ``docs`` in the shared folder and return what reading them back gives."""
    path = path or scratch(docs.sparkSession, "ids")
    return read_ids(write_ids(docs, tokenizer, path, mode=mode), path)
