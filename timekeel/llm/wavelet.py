"""Token ids in wavelet matrices, one compressed file per shard.

A wavelet matrix holds one plane of bits per binary digit of an id, highest first; after
each plane the ids with a 0 there stand before those with a 1. With counts of ones every
512 bits, the id at a place (`access`), how often an id occurs before a place (`rank`), its
k-th place (`select`) and its total count come from the planes alone, one step per plane.

File: magic, one header, then for each plane its zeros and its bits, each plane compressed
with zstd only where that makes it smaller; then ids, lengths and nulls of the documents.
A shard holds whole documents, so it is as large as `SHARD_TOKENS` or its longest document.

Writing: documents are dealt by ranges of doc_id, so partitions follow each other in
ascending order, and each task encodes its texts and closes a shard when it is full. Shards
are kept in a table with one file per row (partition, number, bytes), which any store that
Spark writes to can hold. Where a shard starts follows from the totals of the partitions
before it: one number per partition.

Cases: a null text is empty and has its end id only; null ids come first; rows that share an
id follow each other by a hash of their text; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from timekeel.session import scratch_path

from .common import id_and_text, ship, slices
from .tokens import encoder

END_ID = 2
SHARD_TOKENS = 1 << 20
BLOCK_BITS = 512
MAGIC = b"WVM1"
HEADER = struct.Struct("<4sBQQ")
FILES = "part int, shard int, n_docs long, n_tokens long, start_in_part long, file binary"


class WaveletMatrix:
    """n ids of `levels` binary digits."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int]):
        self.n, self.planes, self.zeros, self.levels = n, planes, zeros, len(planes)
        self._ones: list[np.ndarray] | None = None

    @classmethod
    def of(cls, ids: np.ndarray) -> "WaveletMatrix":
        ids = np.asarray(ids, dtype=np.uint32)
        levels = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        now = ids.astype(np.uint16) if levels <= 16 else ids
        planes, zeros = [], []
        for level in range(levels - 1, -1, -1):
            bit = (now & now.dtype.type(1 << level)) != 0
            planes.append(np.packbits(bit, bitorder="little"))
            low = np.compress(~bit, now)
            zeros.append(len(low))
            now = np.concatenate([low, np.compress(bit, now)])
        return cls(len(ids), planes, zeros)

    def ids(self) -> np.ndarray:
        """All ids in their order, the planes undone from the last to the first."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        now = np.zeros(self.n, dtype=kind)
        for level in range(self.levels - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            # `now` follows the order after this plane; first those with a 0, then those with a 1.
            here = np.empty(self.n, dtype=kind)
            here[np.flatnonzero(~bit)] = now[: self.zeros[level]]
            here[np.flatnonzero(bit)] = now[self.zeros[level]:] | kind(1 << (self.levels - 1 - level))
            now = here
        return now.astype(np.uint32)

    def ones(self, level: int) -> np.ndarray:
        """Ones before each block of bits of a plane."""
        if self._ones is None:
            self._ones = []
            for plane in self.planes:
                full = np.zeros(-(-len(plane) * 8 // BLOCK_BITS) * BLOCK_BITS // 8, dtype=np.uint8)
                full[: len(plane)] = plane
                self._ones.append(np.concatenate([[0], np.cumsum(np.bitwise_count(full.reshape(-1, BLOCK_BITS // 8)).sum(axis=1, dtype=np.int64))]))
        return self._ones[level]

    def rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block = i // BLOCK_BITS
        first = block * BLOCK_BITS // 8
        part = self.planes[level][first: i // 8]
        rest = int(self.planes[level][i // 8]) & ((1 << i % 8) - 1) if i % 8 else 0
        return int(self.ones(level)[block]) + int(np.bitwise_count(part).sum()) + rest.bit_count()

    def select_bit(self, level: int, one: bool, k: int) -> int:
        """The place of the k-th (from 0) bit of a kind."""
        low, high = 0, self.n
        while low < high:
            mid = (low + high) // 2
            ones = self.rank1(level, mid + 1)
            if (ones if one else mid + 1 - ones) <= k:
                low = mid + 1
            else:
                high = mid
        return low

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.levels):
            one = int(self.planes[level][i // 8]) >> i % 8 & 1
            ones = self.rank1(level, i)
            i = self.zeros[level] + ones if one else i - ones
            value = value << 1 | one
        return value

    def _range(self, value: int, i: int) -> tuple[int, int]:
        """Where the occurrences of `value` among the first i ids stand after the last plane."""
        low, high = 0, i
        if value >> self.levels:
            return 0, 0
        for level in range(self.levels):
            a, b = self.rank1(level, low), self.rank1(level, high)
            low, high = (self.zeros[level] + a, self.zeros[level] + b) if value >> (self.levels - 1 - level) & 1 else (low - a, high - b)
        return low, high

    def rank(self, value: int, i: int) -> int:
        """How often `value` occurs among the first i ids."""
        low, high = self._range(value, i)
        return high - low

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def select(self, value: int, k: int) -> int:
        """The place of the k-th (from 0) occurrence of `value`."""
        low, high = self._range(value, self.n)
        if not 0 <= k < high - low:
            raise IndexError(k)
        i = low + k
        for level in range(self.levels - 1, -1, -1):
            one = bool(value >> (self.levels - 1 - level) & 1)
            i = self.select_bit(level, one, i - self.zeros[level] if one else i)
        return i

    def to_bytes(self) -> bytes:
        out = [struct.pack("<QB", self.n, self.levels)]
        for plane, zeros in zip(self.planes, self.zeros):
            out += [struct.pack("<Q", zeros), block(plane.tobytes())]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, raw: memoryview) -> tuple["WaveletMatrix", int]:
        """The matrix and how many bytes it took."""
        n, levels = struct.unpack_from("<QB", raw)
        at, planes, zeros = 9, [], []
        for _ in range(levels):
            zeros.append(struct.unpack_from("<Q", raw, at)[0])
            plane, at = unblock(raw, at + 8)
            planes.append(np.frombuffer(plane, dtype=np.uint8))
        return cls(n, planes, zeros), at


def block(raw: bytes) -> bytes:
    """Length and bytes, compressed where that is smaller."""
    small = zstandard.ZstdCompressor(level=1).compress(raw)
    packed = len(small) < len(raw)
    body = small if packed else raw
    return struct.pack("<BQ", packed, len(body)) + body


def unblock(raw: memoryview, at: int) -> tuple[bytes, int]:
    packed, n = struct.unpack_from("<BQ", raw, at)
    body = bytes(raw[at + 9: at + 9 + n])
    return (zstandard.ZstdDecompressor().decompress(body) if packed else body), at + 9 + n


def file_of(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """One shard file: ids of the documents, their lengths, and the matrix of all their tokens."""
    lengths = np.array([len(x) // 4 for x in ids], dtype=np.uint32)
    names = np.array([d or 0 for d in doc_ids], dtype=np.int64)
    nulls = np.packbits(np.array([d is None for d in doc_ids], dtype=bool))
    matrix = WaveletMatrix.of(np.frombuffer(b"".join(ids), dtype=np.uint32))
    return b"".join([HEADER.pack(MAGIC, 1, len(ids), matrix.n), block(names.tobytes()), block(lengths.tobytes()), block(nulls.tobytes()), matrix.to_bytes()])


def opened(raw: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """doc_ids, lengths and the matrix of a shard file."""
    magic, _, n_docs, _ = HEADER.unpack_from(raw)
    if magic != MAGIC:
        raise ValueError("not a shard file")
    view, at = memoryview(raw), HEADER.size
    names, at = unblock(view, at)
    lengths, at = unblock(view, at)
    nulls, at = unblock(view, at)
    missing = np.unpackbits(np.frombuffer(nulls, np.uint8), count=n_docs).astype(bool)
    doc_ids = [None if m else int(d) for d, m in zip(np.frombuffer(names, np.int64), missing)]
    return doc_ids, np.frombuffer(lengths, np.uint32), WaveletMatrix.from_bytes(view[at:])[0]


def write_shards(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode every document and write the shard files under `path`."""
    ship(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, part = encoder(vocabulary), np.uint32(end_id).tobytes(), TaskContext.get().partitionId()
        names, ids, held, shard, start = [], [], 0, 0, 0

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"part": part, "shard": shard, "n_docs": len(names), "n_tokens": held, "start_in_part": start, "file": file_of(names, ids)}],
                                              schema=pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("start_in_part", pa.int64()), ("file", pa.binary())]))

        for b in slices(batches):
            for doc, x in zip(b.column(0).to_pylist(), encode.batch(b.column(1).to_pylist())):
                names.append(doc)
                ids.append(x + end)
                held += len(x) // 4 + 1
                if held >= shard_tokens:
                    yield closed()
                    names, ids, shard, start, held = [], [], shard + 1, start + held, 0
        if names:
            yield closed()

    # The hash keeps the order of rows that share an id the same in every run.
    ordered = id_and_text(docs).withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    ordered.select("doc_id", "text").mapInArrow(rows, FILES).write.parquet(path)


def read_shards(spark, path: str) -> DataFrame:
    """One row per shard file, with the number of ids before it."""
    files = spark.read.schema(FILES).parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = totals.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    return files.join(F.broadcast(starts) if starts_fit(starts) else starts, "part").select("part", "shard", "n_docs", "n_tokens", (F.col("base") + F.col("start_in_part")).alias("start"), "file")


def starts_fit(starts: DataFrame, most: int = 1_000_000) -> bool:
    """Whether one number per partition is few enough to be sent to every task."""
    return starts.limit(most + 1).count() <= most


def shard_documents(files: DataFrame) -> DataFrame:
    """Position, length and checksum of every document, read from the shard files."""
    ship(files.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, raw in zip(b.column(0).to_pylist(), b.column(1)):
                doc_ids, lengths, matrix = opened(raw.as_py())
                ids = matrix.ids()
                ends = np.cumsum(lengths, dtype=np.int64)
                crc = [zlib.crc32(ids[e - n:e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(start + ends - lengths), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("start", "file").mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long")


def occurrences(files: DataFrame, token: int) -> DataFrame:
    """How often a token occurs, and its first place, in each shard, without decoding the shard."""
    ship(files.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, shard, start, raw in zip(*(b.column(k).to_pylist() for k in range(4))):
                matrix = opened(raw)[2]
                n = matrix.count(token)
                yield pa.RecordBatch.from_pylist([{"part": part, "shard": shard, "n": n, "first": start + matrix.select(token, 0) if n else None}], schema=pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("n", pa.int64()), ("first", pa.int64())]))

    return files.select("part", "shard", "start", "file").mapInArrow(rows, "part int, shard int, n long, first long")


def round_trip(docs: DataFrame, vocabulary: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write the shard files and give what is read back from them."""
    path = scratch_path(docs.sparkSession, "wavelet")
    write_shards(docs, path, vocabulary, end_id, shard_tokens)
    return shard_documents(read_shards(docs.sparkSession, path))
