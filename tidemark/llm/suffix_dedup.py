"""Removal of byte strings that occur more than once, by sorted suffixes (operator 9).

A byte goes if it lies in a string of `length` bytes that also starts somewhere else, in the same document or another.

1. Winnowing: of every window of `length` bytes the least hash of its 32-byte grams is its anchor. Equal windows have
   equal anchors at equal places, so windows are only compared within an anchor; neighbouring windows with one anchor
   form a run, and a run travels as a 128-bit digest. An anchor that one run has alone is done with.
2. Runs of one anchor with equal digests repeat as a whole: the digests are of SHA-256, which no two strings share.
3. The other runs of a shared anchor are fetched, and the suffixes at their window starts sorted: bottom-up mergesort in
   which two suffixes are compared by their longest common extension, found by binary search over prefix polynomial
   hashes. Neighbours that agree over `length` bytes repeat; their bytes are compared in full, against collisions.

Within a task equal texts and equal runs are sent once, so a hot passage or copy sends two rows a task at most. Texts are
named by their digest: copies share their spans, whatever their ids. Groups with more than `group_most` runs are sorted
in shards: each window under its anchor, its first and its last gram, of equal windows of a task one (two serve others).

Defined cases: a null text is empty; texts shorter than `length` bytes lose nothing; texts of any length are taken whole;
a repeated row repeats all its strings; ids may be null or repeated; an empty table gives no rows; columns to carry may
have any names. Bytes are removed as they are, so what is kept may begin or end within a UTF-8 character.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, cut, discard, filter_of, hasher, mix, runs, slices, texts_of

LENGTH, GRAM = 200, 32
#: Distinct runs of one anchor that are sorted in one task.
GROUP_MOST = 12_000
#: Suffix bytes that are sorted together.
LOT_BYTES = 1 << 19
PLACE_BITS = 24


def text_key(text: bytes) -> tuple[int, int]:
    """128 bits of SHA-256, as two signed longs."""
    return struct.unpack("<qq", hashlib.sha256(text).digest()[:16])


def window_runs(data: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window start, number of windows, anchor hash) of the runs in the concatenated texts bounds[k]:bounds[k+1]."""
    none = np.zeros(0, np.int64)
    n = len(data) - length + 1
    if n <= 0:
        return none, none, none
    h = hasher()
    p = h.prefix(data)
    m = len(data) - gram + 1
    grams = mix((p[gram:] - p[:m]) * h.inverses[:m])
    width = length - gram + 1
    anchor = np.empty(n, np.int64)
    step = (1 << PLACE_BITS) - width + 1
    for a in range(0, n, step):  # pieces whose places fit PLACE_BITS
        k = min(step, n - a)
        piece = grams[a : a + k + width - 1]
        keys = (piece >> U64(PLACE_BITS) << U64(PLACE_BITS)) | np.arange(len(piece), dtype=U64)
        # sliding minimum over `width` keys: minima from both ends of blocks
        padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, U64)
        padded[: len(keys)] = keys
        blocks = padded.reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:k], ahead[width - 1 : width - 1 + k])
        anchor[a : a + k] = (least & U64((1 << PLACE_BITS) - 1)).astype(np.int64) + a
    # windows of one text only
    valid = np.zeros(n, bool)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= length:
            valid[a : b - length + 1] = True
    owner = np.where(valid, anchor, -1)
    edge = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    # texts of exactly `length` bytes follow each other without a gap: a run also ends where its text does
    starts = np.union1d(edge, bounds[:-1][(bounds[:-1] < n)])
    sizes = np.diff(np.append(starts, n))
    keep = valid[starts]
    return starts[keep], sizes[keep], grams[anchor[starts[keep]]]


POSTING = "anchor long, d1 long, d2 long, t1 long, t2 long, start long, size long"
POSTING_SCHEMA = pa.schema([(x.split()[0], pa.int64()) for x in POSTING.split(", ")])


def postings(docs: DataFrame, length: int) -> DataFrame:
    """A row for each run of each distinct text of a task.

    size is the number of windows. Runs that the task has met before have size below 0 (they repeat, whatever others
    have) and come under an anchor of their own; one row without a text (size 0) stands in for them under the true one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], bool] = {}
        texts: dict[tuple[int, int], bool] = {}

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], schema=POSTING_SCHEMA)

        for b in batches:
            for part in slices([t for t in texts_of(b.column(1)) if len(t) >= length]):
                rows: list[tuple] = []
                new = []
                for t in part:
                    key = text_key(t)
                    if key in texts:
                        if not texts[key]:  # the first copy of this text repeats as a whole
                            texts[key] = True
                            rows.append((key[0], 0, 0, *key, 0, -(len(t) - length + 1)))
                            new.append((t, None))  # its runs once more, without a text
                    else:
                        texts[key] = False
                        new.append((t, key))
                if not new:
                    if rows:
                        yield out(rows)
                    continue
                joined = b"".join(t for t, _ in new)
                bounds = np.concatenate(([0], np.cumsum([len(t) for t, _ in new])))
                starts, sizes, anchors = window_runs(np.frombuffer(joined, np.uint8), bounds, length, GRAM)
                owner = np.searchsorted(bounds, starts, side="right") - 1
                inside = starts - bounds[owner]
                for s, n, a, o, i in zip(starts.tolist(), sizes.tolist(), anchors.view(np.int64).tolist(), owner.tolist(), inside.tolist(), strict=True):
                    d = text_key(joined[s : s + n + length - 1])
                    key = new[o][1]
                    met = seen.get(d)
                    if met is None:
                        seen[d] = False
                        rows.append((a, *d, *(key or (0, 0)), i, n if key else 0))
                    else:
                        if not met:
                            seen[d] = True
                            rows.append((a, *d, 0, 0, 0, 0))
                        if key:
                            rows.append((key[0] ^ i, 0, 0, *key, i, -n))
                if rows:
                    yield out(rows)

    return docs.mapInArrow(run, POSTING)


FOUND = "t1 long, t2 long, start long, size long, anchor long"
FOUND_SCHEMA = pa.schema([(x.split()[0], pa.int64()) for x in FOUND.split(", ")])


def shared_runs(posts: DataFrame) -> DataFrame:
    """t1, t2, start, size, anchor: runs that repeat as a whole (anchor null), and runs to compare under a shared anchor.

    Of equal runs one is compared, with its size below 0: it only serves the others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for anchor, d1, d2, t1, t2, start, size in runs(batches):
            said = size < 0
            out = [(t1[said], t2[said], start[said], -size[said], np.zeros(int(said.sum()), np.int64), np.zeros(int(said.sum()), bool))]
            keep = ~said
            anchor, d1, d2, t1, t2, start, size = (x[keep] for x in (anchor, d1, d2, t1, t2, start, size))
            if len(anchor):
                new_anchor = np.concatenate(([True], anchor[1:] != anchor[:-1]))
                new = new_anchor | np.concatenate(([True], (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])))
                cls = np.cumsum(new) - 1
                group = np.cumsum(new_anchor) - 1
                many = np.bincount(cls)[cls] > 1
                distinct = np.bincount(group[new])[group]
                real = size > 0
                whole = many & real
                out.append((t1[whole], t2[whole], start[whole], size[whole], anchor[whole], np.zeros(int(whole.sum()), bool)))
                # the first row with a text stands for its digest
                order = np.lexsort((~real, cls))
                first = np.zeros(len(cls), bool)
                first[order[np.concatenate(([True], cls[order][1:] != cls[order][:-1]))]] = True
                need = first & real & (distinct > 1)
                out.append((t1[need], t2[need], start[need], np.where(many[need], -size[need], size[need]), anchor[need], np.ones(int(need.sum()), bool)))
            cols = [np.concatenate(x) for x in zip(*out, strict=True)]
            if len(cols[0]):
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in cols[:4]), pa.array(cols[4], mask=~cols[5])], schema=FOUND_SCHEMA)

    return posts.repartition("anchor").sortWithinPartitions("anchor", "d1", "d2").mapInArrow(run, FOUND)


class Suffixes:
    """Suffixes of a buffer, compared over at most `length` bytes by their longest common extension."""

    def __init__(self, data: np.ndarray, length: int) -> None:
        self.data, self.length = data, length
        h = hasher()
        self.prefix, self.inverse = h.prefix(data), h.inverses

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes x and y have in common: binary search over prefix hashes."""
        p, inv = self.prefix, self.inverse
        px, py, ix, iy = p[x], p[y], inv[x], inv[y]
        low = np.zeros(len(x), np.int64)
        step = 1 << (self.length.bit_length() - 1)
        while step:
            to = low + step
            good = to <= self.length
            to = np.minimum(to, self.length)
            good &= (p[x + to] - px) * ix == (p[y + to] - py) * iy
            low[good] += step
            step >>= 1
        return low

    def above(self, x: np.ndarray, y: np.ndarray, or_equal: bool) -> np.ndarray:
        """Is suffix x greater than y (or equal)? -1 stands behind everything."""
        out = np.zeros(len(x), bool)
        out[(x < 0) & ((y >= 0) | or_equal)] = True
        both = np.flatnonzero((x >= 0) & (y >= 0))
        if len(both):
            a, b = x[both], y[both]
            e = self.extension(a, b)
            same = e >= self.length
            last = np.minimum(e, self.length - 1)
            out[both] = np.where(same, or_equal, self.data[a + last] > self.data[b + last])
        return out

    def sort(self, groups: np.ndarray) -> np.ndarray:
        """Each row of groups (a power of two of starts, -1 as filling) in order: mergesort, from runs of one upwards."""
        rows, m = groups.shape
        width = 1
        while width < m:
            pairs = groups.reshape(-1, 2, width)
            left, right = pairs[:, 0, :], pairs[:, 1, :]
            out = np.empty((len(pairs), 2 * width), groups.dtype)
            at = np.arange(width)[None, :]
            line = np.arange(len(pairs))[:, None]
            out[line, at + self._rank(left, right, False)] = left
            out[line, at + self._rank(right, left, True)] = right
            groups = out
            width *= 2
        return groups.reshape(rows, m)

    def _rank(self, own: np.ndarray, other: np.ndarray, or_equal: bool) -> np.ndarray:
        """How many of the sorted row `other` stand before each of `own` (equal ones too, with or_equal)."""
        n, width = own.shape
        low, high = np.zeros(n * width, np.int64), np.full(n * width, width, np.int64)
        x, line = own.ravel(), np.repeat(np.arange(n), width)
        for _ in range(width.bit_length()):
            open_ = low < high
            if not open_.any():
                break
            mid = (low + high) >> 1
            i = np.flatnonzero(open_)
            up = self.above(x[i], other[line[i], mid[i]], or_equal)
            low[i[up]] = mid[i[up]] + 1
            high[i[~up]] = mid[i[~up]]
        return low.reshape(n, width)


def repeated_windows(chunks: list[bytes], groups: list[int], anchors_at: list[int], length: int) -> np.ndarray:
    """For every window start of the concatenated chunks: does its window occur twice within its group?

    anchors_at: place of the anchor in each chunk; equal windows have it at the same place, so only such are compared.
    """
    data = np.frombuffer(b"".join(chunks), np.uint8)
    sizes = np.array([len(c) for c in chunks])
    starts = np.cumsum(sizes) - sizes
    counts = sizes - length + 1
    window = np.concatenate([np.arange(s, s + n) for s, n in zip(starts.tolist(), counts.tolist(), strict=True)])
    place = np.repeat(starts + np.array(anchors_at), counts) - window
    key = np.repeat(np.array(groups, np.int64), counts) * (length + 1) + place
    order = np.argsort(key, kind="stable")
    key, window = key[order], window[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    members = np.diff(np.append(first, len(key)))
    repeated = np.zeros(len(data), bool)
    suffixes = Suffixes(data, length)
    views = np.lib.stride_tricks.sliding_window_view(data, length)
    for bits in range(1, int(members.max(initial=1) - 1).bit_length() + 1):
        m = 1 << bits
        chosen = np.flatnonzero((members > m // 2) & (members <= m))
        most = max(1, (1 << 15) // m)
        for i in range(0, len(chosen), most):
            own = chosen[i : i + most]
            index = first[own][:, None] + np.arange(m)[None, :]
            table = np.where(np.arange(m)[None, :] < members[own][:, None], window[np.minimum(index, len(window) - 1)], -1)
            table = suffixes.sort(table)
            a, b = table[:, :-1].ravel(), table[:, 1:].ravel()
            real = (a >= 0) & (b >= 0)
            a, b = a[real], b[real]
            equal = suffixes.extension(a, b) >= length
            a, b = a[equal], b[equal]
            for j in range(0, len(a), 1 << 15):  # collisions: the bytes themselves decide
                x, y = a[j : j + (1 << 15)], b[j : j + (1 << 15)]
                good = (views[x] == views[y]).all(axis=1)
                repeated[x[good]] = True
                repeated[y[good]] = True
                for s in x[~good].tolist():
                    others = window[key == key[np.flatnonzero(window == s)[0]]]
                    repeated[s] |= sum(bool((views[s] == views[o]).all()) for o in others.tolist()) > 1
    return repeated


def spans_of(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first window, number of windows) of the runs of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), (edge[1::2] - edge[::2]).tolist(), strict=True))


def keyed_texts(docs: DataFrame, wanted) -> DataFrame:
    """t1, t2, text of the texts that a fixed-size filter lets through, once in a task."""
    schema = pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("text", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in batches:
            rows = []
            texts = texts_of(b.column(1))
            keys = [text_key(t) for t in texts]
            for t, key, likely in zip(texts, keys, wanted.value.has(np.array([k[0] for k in keys], np.int64)).tolist(), strict=True):
                if likely and key not in seen:
                    seen.add(key)
                    rows.append((*key, t))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.mapInArrow(run, "t1 long, t2 long, text binary").groupBy("t1", "t2").agg(F.first("text").alias("text"))


def compared(need: DataFrame, docs: DataFrame, length: int, group_most: int) -> DataFrame:
    """t1, t2, start, size: windows that repeat among the distinct runs of an anchor."""
    texts = keyed_texts(docs, filter_of(need.select("t1")))
    piece = F.expr(f"substring(text, cast(start + 1 as int), cast(abs(size) + {length - 1} as int))")
    chunks = need.join(texts, ["t1", "t2"]).select("anchor", "t1", "t2", "start", "size", piece.alias("chunk"))
    counts = need.groupBy("anchor").count()
    schema = pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("start", pa.int64()), ("size", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch], single: bool = False) -> Iterator[pa.RecordBatch]:
        """Sort the suffixes of each group; single: the groups are shards, and each chunk is one window."""

        def work(cols: list[np.ndarray]) -> pa.RecordBatch | None:
            anchor, t1, t2, start, size, chunk = cols
            ids = np.unique(anchor, return_inverse=True)[1].tolist()
            chunks = chunk.tolist()
            where = [0 if single else anchor_place(c, a, length) for c, a in zip(chunks, anchor.tolist(), strict=True)]
            flags = repeated_windows(chunks, ids, where, length)
            at, rows = 0, []
            for c, x, y, s, n in zip(chunks, t1.tolist(), t2.tolist(), start.tolist(), size.tolist(), strict=True):
                if n > 0:
                    rows += [(x, y, s + a, k) for a, k in spans_of(flags[at : at + n])]
                at += len(c)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], schema=schema) if rows else None

        held: list[list[np.ndarray]] = []
        size = 0
        for cols in runs(batches):
            held.append(cols)
            size += sum(map(len, cols[5]))
            if size >= LOT_BYTES:
                if (b := work([np.concatenate(x) for x in zip(*held, strict=True)])) is not None:
                    yield b
                held, size = [], 0
        if held and (b := work([np.concatenate(x) for x in zip(*held, strict=True)])) is not None:
            yield b

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The windows of large groups: one of equal ones goes to its shard, with a stand-in where there are more; these repeat."""
        shard_schema = pa.schema([("shard", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("start", pa.int64()), ("size", pa.int64()), ("window", pa.binary())])
        met: dict[bytes, bool] = {}
        for b in batches:
            rows = []
            for anchor, t1, t2, start, size, chunk in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for i in range(abs(size)):
                    w = chunk[i : i + length]
                    if w in met and size > 0:
                        rows.append((None, t1, t2, start + i, 1, None))
                    if not met.get(w):
                        met[w] = w in met
                        key = hashlib.blake2b(struct.pack("<q", anchor) + w[:GRAM] + w[-GRAM:], digest_size=8).digest()
                        real = size > 0 and not met[w]
                        rows.append((struct.unpack("<q", key)[0], t1, t2, start + i, 1 if real else -1, w))
                if len(met) > 50_000:
                    met.clear()
                if len(rows) > 5_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), shard_schema, strict=True)], schema=shard_schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), shard_schema, strict=True)], schema=shard_schema)

    large_anchors = counts.where(F.col("count") > group_most).select("anchor")
    spans = "t1 long, t2 long, start long, size long"
    small = chunks.join(large_anchors, "anchor", "left_anti")
    sorted_ = small.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, spans)
    if large_anchors.isEmpty():
        return sorted_
    windows = cut(chunks.join(large_anchors, "anchor", "left_semi").mapInArrow(split, "shard long, t1 long, t2 long, start long, size long, window binary"), "windows")
    known = windows.where("window is null").select("t1", "t2", "start", "size")
    shards = windows.where("window is not null").repartition("shard").sortWithinPartitions("shard")
    return sorted_.union(known).union(shards.mapInArrow(lambda batches: run(batches, single=True), spans))


def anchor_place(chunk: bytes, anchor: int, length: int) -> int:
    """Where in a run its anchor stands: the place of the least gram of its first window."""
    data = np.frombuffer(chunk[:length], np.uint8)
    h = hasher()
    p = h.prefix(data)
    m = length - GRAM + 1
    grams = mix((p[GRAM : GRAM + m] - p[:m]) * h.inverses[:m])
    return int(np.flatnonzero(grams.view(np.int64) == anchor)[0])


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, group_most: int = GROUP_MOST, carry: list[str] | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary), kept_sha256 and, in a struct, the columns to carry: a row per row of docs."""
    carried = F.struct(*(F.col(f"`{c}`") for c in carry)) if carry else F.lit(None).cast("struct<none: int>")
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), carried.alias("carried"))
    plain = docs.select("doc_id", "text")
    found = cut(shared_runs(postings(plain, length)), "runs")
    whole = found.where("anchor is null").select("t1", "t2", "start", "size")
    need = found.where("anchor is not null")
    parts = cut(compared(need, plain, length, group_most), "spans")
    spans = cut(whole.union(parts).where("size > 0").groupBy("t1", "t2").agg(F.collect_set(F.struct("start", "size")).alias("spans")), "spans")
    discard(found, parts)
    wanted = filter_of(spans.select("t1"))
    mid = pa.schema([("doc_id", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("text", pa.binary()), ("hit", pa.bool_())])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = texts_of(b.column(1))
            keys = [text_key(t) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(texts, pa.binary()), pa.array(wanted.value.has(np.array([k[0] for k in keys], np.int64))), b.column(2)], names=[*mid.names, "carried"])

    kind = docs.schema["carried"].dataType.simpleString()
    every = docs.mapInArrow(keyed, f"doc_id long, t1 long, t2 long, text binary, hit boolean, carried {kind}")
    ends = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("kept_sha256", pa.string())])

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, own in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                cuts = merged([(s["start"], s["start"] + s["size"] + length - 1) for s in own or ()])
                parts, at = [], 0
                for s, e in cuts:
                    parts.append(text[at:s])
                    at = e
                kept = b"".join((*parts, text[at:]))
                rows.append((len(text), len(text) - len(kept), len(cuts), kept, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, f.type) for c, f in zip(cols, list(ends)[1:], strict=True)), b.column(3)], names=[*ends.names, "carried"])

    out = f"doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string, carried {kind}"
    # only texts that may have spans take part in the join
    some = every.where("hit").join(spans, ["t1", "t2"], "left").select("doc_id", "text", "spans", "carried")
    none = every.where("not hit").select("doc_id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"), "carried")
    return some.mapInArrow(removed, out).union(none.mapInArrow(removed, out))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans, touching ones as one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out
