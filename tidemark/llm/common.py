"""What the operators of this subpackage share: whole-text batches, word and shingle hashes, fixed-size sketches."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import collect_garbage, cut, discard, shared_dir, ship

__all__ = ["Bits", "Hasher", "collect_garbage", "cut", "discard", "filter_of", "ids_and_texts", "mix", "prepare", "runs", "shared_dir", "sketch", "table", "texts_of"]

U64 = np.uint64
#: Rows of whole texts in one Arrow batch; long texts make rows of 100 kB.
BATCH_ROWS = "400"


def prepare(spark: SparkSession) -> None:
    """What a session needs before an operator with Python stages runs over whole texts."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ids_and_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs, under names of our own; other columns cannot clash."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


#: Called in a worker before it reads texts for anything but tokens: to drop what was kept for those.
on_other_work: list = []
_calls = [0]


def give_back() -> None:
    """Return freed memory to the system now and then: a worker is used for many tasks, and keeps what it ever held."""
    _calls[0] += 1
    if _calls[0] % 2 == 0:
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value; null is empty."""
    for forget in on_other_work:
        forget()
    give_back()
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift and multiply)."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


#: log2 of the most bits (16 MiB) of a filter that keeps rows without a partner out of a shuffle.
FILTER_BITS = 27
SPREAD = 0x9E3779B97F4A7C15
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


class Hasher:
    """Prefix polynomial hashes modulo 2**64 over random values of the bytes; made once in each worker."""

    def __init__(self, most: int = 1 << 22) -> None:
        random = np.random.default_rng(20240229)
        self.values = random.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
        base = int(random.integers(1, 2**62)) * 4 + 3
        self.base, self.inverse = base % 2**64, pow(base, -1, 2**64)
        self.steps = random.integers(1, 2**63, 16, dtype=np.uint64) * U64(2) + U64(1)
        self.most, self.powers, self.inverses = 0, np.ones(1, U64), np.ones(1, U64)
        self._grow(1 << 16)

    def _grow(self, n: int) -> None:
        while self.most < n:
            more = max(1 << 16, 2 * self.most)
            up, down = np.full(more, self.base, U64), np.full(more, self.inverse, U64)
            up[0] = down[0] = 1
            self.powers, self.inverses, self.most = np.multiply.accumulate(up), np.multiply.accumulate(down), more

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """P with P[j] - P[i] the hash of data[i:j] times base**i."""
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, U64)
        np.cumsum(self.values[data] * self.powers[: len(data)], out=out[1:])
        return out

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(hash of every word, bounds): words bounds[k]:bounds[k+1] belong to text k. Texts are lower-cased (A-Z)."""
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        data = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
        inside = ~SPACE[data]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside)).view(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        p = self.prefix(data)
        hashes = mix((p[ends] - p[starts]) * self.inverses[starts] + (ends - starts).astype(U64))
        bounds = np.searchsorted(starts, np.concatenate(([0], np.cumsum(lengths))))
        return hashes, bounds

    def shingle_sets(self, texts: list[bytes], size: int = 5) -> list[np.ndarray]:
        """Sorted distinct shingle hashes of each text; with fewer words the whole sequence is one shingle."""
        out: list[np.ndarray] = []
        for part in slices(texts):
            words, bounds = self.words(part)
            n = len(words) - size + 1
            if n > 0:
                rolled = np.zeros(n, U64)
                for k in range(size):
                    rolled += words[k : k + n] * self.steps[k]
                rolled = mix(rolled)
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if b - a >= size:
                    out.append(np.unique(rolled[a : b - size + 1]))
                elif b > a:
                    out.append(mix(np.array([(words[a:b] * self.steps[: b - a]).sum() + U64(b - a)], U64)))
                else:
                    out.append(np.zeros(0, U64))
        return out


_hasher: list[Hasher] = []


def hasher() -> Hasher:
    """The worker's hasher."""
    if not _hasher:
        _hasher.append(Hasher())
    return _hasher[0]


def slices(texts: list[bytes], most: int = 1 << 19) -> Iterator[list[bytes]]:
    """Consecutive runs of about `most` bytes, whole texts each."""
    part: list[bytes] = []
    size = 0
    for t in texts:
        part.append(t)
        size += len(t) + 1
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def packed(counts: np.ndarray) -> bytes:
    small = counts.max(initial=0) < 2**16
    return b"sl"[not small : 1 + (not small)] + counts.astype(np.uint16 if small else np.int64).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint16 if data[:1] == b"s" else np.int64, offset=1).astype(np.int64)


def sketch(df: DataFrame, keys, bits: int) -> np.ndarray:
    """Counts of hashed keys in 2**bits counters over all rows of df.

    keys(batch) gives uint64 keys; a task sends one table of fixed size in blocks, blocks are added up by
    executors, and the driver receives 2**bits counters however large df is.
    """
    block = min(1 << 13, 1 << bits)

    schema = pa.schema([("part", pa.int64()), ("block", pa.int32()), ("counts", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for b in batches:
            k = keys(b)
            if len(k):
                np.add.at(total, (k >> U64(64 - bits)).astype(np.int64), 1)
        part = TaskContext.get().partitionId()
        for i in range(0, 1 << bits, block):
            if total[i : i + block].any():
                yield pa.RecordBatch.from_pydict({"part": [part], "block": [i // block], "counts": [packed(total[i : i + block])]}, schema=schema)

    def add(t: pa.Table) -> pa.Table:
        total = sum(unpacked(x) for x in t.column("counts").to_pylist())
        return pa.table({"part": [t.column("part")[0].as_py()], "block": [t.column("block")[0].as_py()], "counts": [packed(total)]}, schema=schema)

    parts = df.mapInArrow(count, "part long, block int, counts binary")
    for _ in range(3):  # at most 256 tables meet in a task at the first two steps, and few at the last
        parts = parts.withColumn("part", F.col("part") / 256).withColumn("part", F.floor("part")).groupBy("part", "block").applyInArrow(add, "part long, block int, counts binary")
    out = np.zeros(1 << bits, np.int64)
    for row in parts.collect():
        out[row["block"] * block : (row["block"] + 1) * block] += unpacked(row["counts"])
    return out


class Bits:
    """A set of hashed longs by their leading bits: a member is always found, others seldom."""

    def __init__(self, bits: int) -> None:
        self.bits, self.data = bits, np.zeros(max(1, 1 << bits >> 3), np.uint8)

    def has(self, keys: np.ndarray) -> np.ndarray:
        k = keys.view(U64) >> U64(64 - self.bits)
        return (self.data[(k >> U64(3)).astype(np.int64)] >> (k & U64(7)).astype(np.uint8) & 1).astype(bool)


def filter_of(ids: DataFrame):
    """Broadcast bits that hold every (hashed, not null) long of a one-column frame, sized by its rows up to FILTER_BITS.

    Executors set the bits, so the driver gets at most 2**FILTER_BITS of them; with more rows the filter lets more pass.
    """
    found = Bits(min(FILTER_BITS, max(16, (16 * ids.count()).bit_length())))
    place = F.shiftrightunsigned(ids.columns[0], 64 - found.bits).alias("place")
    parts = ids.select(place).groupBy(F.shiftright("place", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("place").bitwiseAND(F.lit(32767))).alias("bits"))
    for row in parts.collect():
        own = np.frombuffer(row["bits"], np.uint8)
        found.data[row["part"] * 4096 : (row["part"] + 1) * 4096] = own[: len(found.data) - row["part"] * 4096]
    return ids.sparkSession.sparkContext.broadcast(found)


def runs(batches: Iterator[pa.RecordBatch], key: int = 0) -> Iterator[list[np.ndarray]]:
    """Columns of whole runs of equal keys, from batches sorted by key: several runs at once."""
    rest: list[np.ndarray] | None = None
    for b in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if rest is not None:
            columns = [np.concatenate(x) for x in zip(rest, columns, strict=True)]
        k = columns[key]
        if not len(k):
            continue
        end = int(np.searchsorted(k, k[-1]))
        if end:
            yield [c[:end] for c in columns]
        rest = [c[end:] for c in columns]
    if rest is not None and len(rest[0]):
        yield rest
