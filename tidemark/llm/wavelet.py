"""Token ids in wavelet-matrix shards (operator 4).

A shard holds the ids of consecutive documents as bit-planes, highest bit first: plane l has bit l of every id in the
order that the planes before left behind (zeros first, stable). With rank over the planes one file gives access to a
token, counts of an id before a place and, by select, the places of an id, without unpacking the sequence.

File: b"TMWM1\\n", five little-endian uint64 (tokens, planes, documents, bytes of documents' part, first plane's place),
documents' part (zstd: ids as int64 differences with a null mask, lengths), then per plane two uint64 (zeros; bytes)
and its bits, packed and zstd-compressed. Rank directories (ones before every 512 bits) are rebuilt on opening.

Documents are range-partitioned by id; each task writes its shards under the partition's number, so a repeated task
writes the same files. Shards are renamed into place when whole.

Defined cases: a null or empty text is the end id alone; null ids come first in the order; repeated ids keep their rows,
in the order of their texts; an empty table gives no shards and no rows.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import cut, ids_and_texts, shared_dir
from .files import reading, writing
from .tokens import encoder

MAGIC = b"TMWM1\n"
SHARD_TOKENS = 1 << 22
BLOCK = 512


class WaveletMatrix:
    """A sequence of unsigned integers as bit-planes with rank and select."""

    def __init__(self, planes: list[np.ndarray], zeros: list[int], n: int) -> None:
        self.planes, self.zeros, self.n = planes, zeros, n
        self._ranks: list[np.ndarray] | None = None

    @classmethod
    def build(cls, values: np.ndarray, width: int | None = None) -> WaveletMatrix:
        width = width or max(1, int(values.max(initial=0)).bit_length())
        now = values.astype(np.uint16 if width <= 16 else np.uint32)
        planes, zeros = [], []
        for level in range(width - 1, -1, -1):
            ones = (now & now.dtype.type(1 << level)).astype(bool)
            planes.append(np.packbits(ones))
            zeros.append(len(now) - int(np.count_nonzero(ones)))
            after = np.empty_like(now)
            np.compress(ones, now, out=after[zeros[-1] :])
            np.compress(np.logical_not(ones, out=ones), now, out=after[: zeros[-1]])
            now = after
        return cls(planes, zeros, len(values))

    def values(self) -> np.ndarray:
        """The whole sequence: the planes undone from the last to the first."""
        now = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for k in range(len(self.planes) - 1, -1, -1):
            ones = np.unpackbits(self.planes[k], count=self.n).view(bool)
            now[self.zeros[k] :] |= now.dtype.type(1 << (len(self.planes) - 1 - k))
            before = np.empty_like(now)
            before[np.flatnonzero(ones)] = now[self.zeros[k] :]
            before[np.flatnonzero(np.logical_not(ones, out=ones))] = now[: self.zeros[k]]
            now = before
        return now.astype(np.uint32)

    def _rank1(self, k: int, i: int) -> int:
        """Ones in plane k before place i."""
        if self._ranks is None:
            self._ranks = []
            for p in self.planes:
                counts = np.bitwise_count(np.pad(p, (0, -len(p) % (BLOCK // 8)))).reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.int64)
                self._ranks.append(np.concatenate(([0], np.cumsum(counts))))
        block = i // BLOCK
        bits = self.planes[k][block * (BLOCK // 8) : (i + 7) // 8]
        part = int(np.bitwise_count(bits).sum()) if len(bits) else 0
        if i % 8 and len(bits):
            part -= int(bits[-1] & (0xFF >> i % 8)).bit_count()
        return int(self._ranks[k][block]) + part

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k in range(len(self.planes)):
            one = self.planes[k][i >> 3] >> (7 - (i & 7)) & 1
            ones = self._rank1(k, i)
            value = value << 1 | int(one)
            i = self.zeros[k] + ones if one else i - ones
        return value

    def _range(self, value: int, start: int, end: int) -> tuple[int, int]:
        if value >> len(self.planes):
            return 0, 0
        for k in range(len(self.planes)):
            a, b = self._rank1(k, start), self._rank1(k, end)
            start, end = (self.zeros[k] + a, self.zeros[k] + b) if value >> (len(self.planes) - 1 - k) & 1 else (start - a, end - b)
        return start, end

    def count(self, value: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of value in start:end."""
        a, b = self._range(value, start, self.n if end is None else end)
        return b - a

    def select(self, value: int, j: int) -> int:
        """Place of the j-th occurrence (from 0) of value."""
        a, b = self._range(value, 0, self.n)
        if not 0 <= j < b - a:
            raise IndexError(j)
        i = a + j
        for k in range(len(self.planes) - 1, -1, -1):
            one = value >> (len(self.planes) - 1 - k) & 1
            target, low, high = (i - self.zeros[k] if one else i) + 1, 0, self.n
            while low < high:  # the least place with `target` such bits before it
                mid = (low + high) // 2
                ones = self._rank1(k, mid + 1)
                if (ones if one else mid + 1 - ones) < target:
                    low = mid + 1
                else:
                    high = mid
            i = low
        return i

    def places(self, value: int) -> list[int]:
        return [self.select(value, j) for j in range(self.count(value))]


def write_shard(f, values: np.ndarray, ids: list[int | None], lengths: np.ndarray) -> None:
    z = zstandard.ZstdCompressor(level=1)
    known = np.array([i is not None for i in ids])
    steps = np.diff(np.array([i or 0 for i in ids], np.int64), prepend=0)
    docs = z.compress(np.packbits(known).tobytes() + steps.astype("<i8").tobytes() + lengths.astype("<u4").tobytes())
    w = WaveletMatrix.build(values)
    f.write(MAGIC + struct.pack("<5Q", w.n, len(w.planes), len(ids), len(docs), len(MAGIC) + 40 + len(docs)) + docs)
    for plane, zeros in zip(w.planes, w.zeros, strict=True):
        data = z.compress(plane.tobytes())
        f.write(struct.pack("<2Q", zeros, len(data)) + data)


def read_shard(data: bytes) -> tuple[WaveletMatrix, list[int | None], np.ndarray]:
    if not data.startswith(MAGIC):
        raise ValueError("not a wavelet shard")
    z = zstandard.ZstdDecompressor()
    n, width, m, size, at = struct.unpack_from("<5Q", data, len(MAGIC))
    docs = z.decompress(data[at - size : at])
    mask = -(-m // 8)
    known = np.unpackbits(np.frombuffer(docs, np.uint8, mask), count=m)
    ids = np.cumsum(np.frombuffer(docs, "<i8", m, mask))
    lengths = np.frombuffer(docs, "<u4", m, mask + 8 * m).astype(np.int64)
    planes, zeros = [], []
    for _ in range(width):
        z0, size = struct.unpack_from("<2Q", data, at)
        planes.append(np.frombuffer(z.decompress(data[at + 16 : at + 16 + size]), np.uint8))
        zeros.append(z0)
        at += 16 + size
    return WaveletMatrix(planes, zeros, n), [int(i) if k else None for i, k in zip(ids, known, strict=True)], lengths


def write_tokens(docs: DataFrame, folder: str, vocabulary: str = "word_bpe_49k.json", end: int = 2, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """part, shard, uri, n_tokens of the files written. docs: doc_id, text."""
    schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("uri", pa.string()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard = TaskContext.get().partitionId(), 0
        coder = encoder(vocabulary)
        ids: list[int | None] = []
        arrays: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            uri = f"{folder}/part-{part:06d}-{shard:05d}.tmwm"
            with writing(uri) as f:
                write_shard(f, np.concatenate(arrays), ids, np.array([len(a) for a in arrays]))
            return pa.RecordBatch.from_pydict({"part": [part], "shard": [shard], "uri": [uri], "n_tokens": [held]}, schema=schema)

        for b in batches:
            for doc, found in zip(b.column(0).to_pylist(), coder.encode([t or "" for t in b.column(1).to_pylist()]), strict=True):
                ids.append(doc)
                arrays.append(np.append(found, np.uint32(end)))
                held += len(arrays[-1])
                if held >= shard_tokens:
                    yield flush()
                    ids, arrays, held, shard = [], [], 0, shard + 1
        if ids:
            yield flush()

    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return cut(ordered.mapInArrow(run, "part int, shard int, uri string, n_tokens long"), "shards")


def read_tokens(shards: DataFrame) -> DataFrame:
    """doc_id, start, ids (little-endian uint32) of every document in the files, by undoing the planes."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])
    # starts: totals of the partitions (as many as there are tasks), then within each of them
    before, total = {}, 0
    for r in sorted(shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect(), key=lambda r: r["part"]):
        before[r["part"]], total = total, total + r["n"]
    offsets = shards.sparkSession.sparkContext.broadcast(before)
    own = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = shards.withColumn("inside", F.coalesce(F.sum("n_tokens").over(own), F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, uri, inside in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with reading(uri) as f:
                    matrix, ids, lengths = read_shard(f.read())
                values = matrix.values().astype("<u4")
                ends = np.cumsum(lengths)
                starts = offsets.value[part] + inside + ends - lengths
                for i in range(0, len(ids), 2000):
                    s = slice(i, i + 2000)
                    data = [values[e - n : e].tobytes() for e, n in zip(ends[s].tolist(), lengths[s].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[s], pa.int64()), pa.array(starts[s], pa.int64()), pa.array(data, pa.binary())], schema=schema)

    tasks = max(1, min(shards.count(), 4 * int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return placed.select("part", "uri", "inside").repartition(tasks).mapInArrow(run, "doc_id long, start long, ids binary")


def token_round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, **options) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 as the files say after they were written and read back."""
    docs = ids_and_texts(docs, id_col, text_col)
    found = read_tokens(write_tokens(docs, folder or f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}", **options))
    return found.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
