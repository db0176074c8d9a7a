"""Best-fit packing of token sequences (operator 2).

Bounded-space online best-fit: each task keeps at most `open_bins` bins open, in a bitset keyed by their free space; a
piece goes into the open bin that it fills best (one shift and one lowest-bit step), and when one bin more would be open
the fullest closes. The pieces of one Arrow batch come longest first. What is still open when a task ends is packed once
more by fewer tasks, so the number of half-filled sequences does not follow the number of partitions.

A document is its ids and the id `end`. Only a document longer than `length` is cut: into pieces of `length`, of which
the first may be shorter. Tokenising and packing happen in one pass over the documents, without a shuffle of texts.

Defined cases: a null or empty text is the id `end` alone; a text of any length is cut into as many pieces as it needs; of
bins with equal free space the last one used is taken; a null or repeated id is carried as it is; other columns are not
read; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ids_and_texts
from .tokens import encoder

OPEN_BINS = 1024
#: Pieces that the second round sorts together.
SORTED = 20_000
#: Tokens that a task of the second round packs at least.
SECOND_ROUND = 1 << 21


class Bins:
    """Open bins of a fixed capacity, found by free space in a bitset."""

    def __init__(self, capacity: int, most: int) -> None:
        self.capacity, self.most = capacity, most
        self.bits, self.by_free, self.count, self.made = 0, {}, 0, 0

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset) of a piece of this size; closes the fullest bin when too many are open."""
        fitting = self.bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            name = self._take(free)
        else:
            free, name = self.capacity, self.made
            self.made += 1
        left = free - size
        if left:
            self.by_free.setdefault(left, []).append(name)
            self.bits |= 1 << left
            self.count += 1
            if self.count > self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
        return name, self.capacity - free

    def _take(self, free: int) -> int:
        names = self.by_free[free]
        name = names.pop()
        if not names:
            del self.by_free[free]
            self.bits &= ~(1 << free)
        self.count -= 1
        return name

    def open(self) -> list[int]:
        return [n for names in self.by_free.values() for n in names]


COLUMNS = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, sequence_id long, offset long, open boolean"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("open", pa.bool_())])


def _packed(batches, length: int, open_bins: int, high: int) -> Iterator[pa.RecordBatch]:
    """Give every piece its sequence and offset. batches: lists of (doc_id, piece, start, length, crc, ids)."""
    bins = Bins(length, open_bins)
    first = high + (TaskContext.get().partitionId() << 32)
    held: dict[int, list[tuple]] = {}  # pieces of bins that may stay open

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA)

    for rows in batches:
        for r in sorted(rows, key=lambda r: -r[3]):
            name, offset = bins.place(r[3])
            held.setdefault(name, []).append((*r, first + name, offset))
        still = set(bins.open())
        done = [(*r, False) for name in [n for n in held if n not in still] for r in held.pop(name)]
        if done:
            yield out(done)
    if held:
        yield out([(*r, True) for rs in held.values() for r in rs])


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.json", length: int = 2048, end: int = 0, open_bins: int = OPEN_BINS, with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids (little-endian uint32; null unless with_ids), sequence_id, offset."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces():
            coder = encoder(vocabulary)
            for b in batches:
                rows = []
                for doc, ids in zip(b.column(0).to_pylist(), coder.encode([t or "" for t in b.column(1).to_pylist()]), strict=True):
                    ids = np.append(ids, np.uint32(end)).astype("<u4")
                    cuts = [0, *range(len(ids) % length or length, len(ids) + 1, length)]
                    for k, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        data = ids[s:e].tobytes()
                        rows.append((doc, k, s, e - s, zlib.crc32(data), data if with_ids else None))
                yield rows

        yield from _packed(pieces(), length, open_bins, 0)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces():
            rows: list[tuple] = []
            for b in batches:
                rows += zip(*(c.to_pylist() for c in b.columns), strict=True)
                if len(rows) >= SORTED:
                    yield rows
                    rows = []
            yield rows

        yield from _packed(pieces(), length, open_bins, 1 << 62)

    done = cut(ids_and_texts(docs, id_col, text_col).mapInArrow(first, COLUMNS), "packed")
    left = done.where("open").select("doc_id", "piece", "start", "length", "ids_crc32", "ids")
    tokens = left.agg(F.sum("length")).first()[0] or 0
    # a task is filled by its share of the pieces, longest first within its batches
    more = left.repartition(max(1, tokens // SECOND_ROUND)).mapInArrow(again, COLUMNS)
    return done.where("not open").union(more).drop("open")
