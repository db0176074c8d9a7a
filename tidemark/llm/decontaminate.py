"""Benchmark decontamination under edit distance (operator 3).

An item is found where a stretch of a text is within `allowed` * length edits of it.

1. Windows: cut into d + 1 stretches, an item that occurs with at most d edits leaves one stretch whole, so the exact
   grams in these stretches (of `q` bytes, the rarest of the stretch among the items, or all of a shorter stretch) tell
   without loss where windows of an item's size class are worth a look. They do not say which item it is.
2. Embedding: a window goes through CGK random walks (the character is copied to the embedding, and a random bit of step
   and character decides whether the walk moves on), which map edit distance to Hamming distance.
3. Bit-sampling LSH: of each walk a few positions are sampled; a window meets the items in the same bucket (size class,
   walk and samples). Samples follow from the number of items; walks are repeated until items with edits at the limit,
   tried out on a bounded sample of them, meet with the recall that is aimed at. An exact copy meets its item in all.
4. What meets is verified exactly: bit-parallel edit distance of the item to the best-fitting stretch.

Texts are compared with A-Z lower-cased and runs of white space as one space.

Items are broadcast in lots of a fixed size, each lot a pass over the documents.

Defined cases: a null or blank text holds nothing; a text of any length is looked at whole; items without a non-space
character are ignored; items shorter than `q` characters are looked up as they are; items with the same text all count,
and so do items with a null id (found as null); an item has one find in a text, the least distance, of ties the first
found; repeated rows all stay; columns to carry may have any names; an empty table of either kind gives rows without
finds, or no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, cut, mix, texts_of

#: Bytes of items in a lot that is broadcast; a larger benchmark takes more passes.
ITEM_BYTES = 8 << 20
ALLOWED = 0.08
Q = 12
#: Recall aimed at for items with edits at the limit, the items that it is tried out on, the least and the most walks.
RECALL, TRIED, REPEATS = 0.98, 64, (12, 256)
#: Share of equal characters among unlike texts; buckets are made so small that an item seldom meets one by chance.
BY_CHANCE = 0.07
#: Sizes of one class differ by this factor; walks are sampled in so many steps a character, before items of a class end.
WIDTH, STEPS = 1.1, 1.8
END = 256
#: Rows and bytes of documents whose windows walk together.
LOT_ROWS, LOT_BYTES = 4000, 32 << 20
_SPACE = re.compile(rb"[ \t-\r]+")


def plain(text: bytes) -> bytes:
    return _SPACE.sub(b" ", text.lower()).strip(b" ")


def size_class(n: int) -> int:
    return int(math.log(n) / math.log(WIDTH) + 1e-9)


class Walks:
    """CGK random walks: the bit of a step and a character is the high bit of a multiply-add hash drawn for the step."""

    def __init__(self, repeats: int, samples: int, most: int) -> None:
        random = np.random.default_rng(7)
        steps = int(STEPS * most) + 2
        self.mul = random.integers(0, 2**63, (repeats, steps), dtype=np.uint64) * U64(2) + U64(1)
        self.add = random.integers(0, 2**63, (repeats, steps), dtype=np.uint64) * U64(2)
        self.places = np.sort(random.random((repeats, samples)), axis=1)

    def at(self, text: np.ndarray, starts: np.ndarray, k: int, places: np.ndarray) -> np.ndarray:
        """Characters at sorted places of the embeddings, under walk k, of the strings that begin at starts and end in END."""
        at = starts.copy()
        out = np.empty((len(starts), len(places)), np.int16)
        wanted: dict[int, list[int]] = defaultdict(list)
        for i, p in enumerate(places.tolist()):
            wanted[p].append(i)
        last = int(places[-1])
        chars = np.arange(1, END + 2, dtype=U64)
        for block in range(0, last + 1, 1024):
            steps = slice(block, min(block + 1024, last + 1))
            bits = ((self.mul[k, steps, None] * chars + self.add[k, steps, None]) >> U64(63)).astype(np.int64)
            bits[:, END] = 0  # a walk that has come to the end stays there
            for step, moves in enumerate(bits, block):
                c = text[at]
                for i in wanted.get(step, ()):
                    out[:, i] = c
                at += moves[c]
        return out

    def keys(self, text: np.ndarray, starts: np.ndarray, k: int, kind: int) -> np.ndarray:
        """The bucket of each string of a size class under walk k."""
        places = (self.places[k] * STEPS * WIDTH**kind).astype(np.int64)
        h = np.full(len(starts), kind + 1, U64)
        for c in self.at(text, starts, k, places).T:
            h = mix(h * U64(0x100000001B3) + c.astype(U64))
        return h


def laid_out(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(characters with END after each string, starts)."""
    lengths = np.array([len(s) + 1 for s in strings], np.int64)
    ends = np.cumsum(lengths)
    text = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int16)
    text[ends - 1] = END
    return text, ends - lengths


def with_edits(s: bytes, edits: int, random: np.random.Generator) -> bytes:
    out = bytearray(s)
    for _ in range(edits):
        at, kind = int(random.integers(len(out))), int(random.integers(3))
        if kind == 0:
            out[at] = int(random.integers(97, 123))
        elif kind == 1:
            out.insert(at, int(random.integers(97, 123)))
        elif len(out) > 1:
            del out[at]
    return bytes(out)


def distance(pattern: bytes, text: bytes) -> tuple[int, int]:
    """(least edit distance of pattern to any stretch of text, where that stretch ends): bit-parallel."""
    m = len(pattern)
    if not m:
        return 0, 0
    masks: dict[int, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | ~(xh | plus) & full, plus & xh
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = (down | ~(xv | up)) & full, up & xv
        if score < best:
            best, end = score, j + 1
    return best, end


class Index:
    """Items by size class and bucket, and the grams that lead to windows; made once in each worker."""

    def __init__(self, items: list[tuple[int | None, bytes]], allowed: float, q: int, recall: float = RECALL) -> None:
        self.q, self.allowed = q, allowed
        self.short = [(i, t) for i, t in items if 0 < len(t) < q]
        self.items = [(i, t) for i, t in items if len(t) >= q]
        self.kinds = np.array([size_class(len(t)) for _, t in self.items], np.int64)
        most = max([1, *(len(t) for _, t in self.items)])
        samples = max(3, math.ceil(math.log(20 * max(1, len(self.items))) / -math.log(BY_CHANCE)))
        self.walks = Walks(self._repeats(samples, recall), samples, most)
        #: gram length -> (gram -> (size class, place in the item), and the filter of its keys)
        self.tables: dict[int, tuple[dict[int, set[tuple[int, int]]], np.ndarray]] = {}
        common = Counter(h for _, t in self.items for h in self.hashes(t, q))
        for kind, (_, t) in zip(self.kinds.tolist(), self.items, strict=True):
            d = int(allowed * len(t))
            step = max(1, len(t) // (d + 1))
            size = min(q, step)
            table, likely = self.tables.setdefault(size, (defaultdict(set), np.zeros(1 << 20, bool)))
            grams = self.hashes(t, size)
            for j in range(min(d + 1, len(t))):
                places = range(j * step, (j + 1) * step - size + 1)
                at = min(places, key=lambda p: (common[grams[p]], p)) if size == q else j * step
                table[grams[at]].add((kind, at))
                likely[grams[at] >> 44] = True
        #: walk -> (sorted buckets, their items)
        self.buckets: list[tuple[np.ndarray, np.ndarray]] = []
        text, starts = laid_out([t for _, t in self.items])
        for k in range(len(self.walks.places)):
            keys = np.zeros(len(self.items), U64)
            for kind in np.unique(self.kinds).tolist():
                own = np.flatnonzero(self.kinds == kind)
                keys[own] = self.walks.keys(text, starts[own], k, kind)
            order = np.argsort(keys, kind="stable")
            self.buckets.append((keys[order], order))

    def _repeats(self, samples: int, recall: float) -> int:
        """Walks that items with edits at the limit need to meet with the recall, tried out on some of them."""
        random = np.random.default_rng(11)
        with_some = [t for _, t in self.items if int(self.allowed * len(t))]
        tried = [with_some[i] for i in random.permutation(len(with_some))[:TRIED]]
        agree = []
        walks = Walks(8, samples, max([1, *map(len, tried)]))
        for t in tried:
            text, starts = laid_out([t, with_edits(t, int(self.allowed * len(t)), random)])
            places = np.arange(max(1, int(STEPS * WIDTH ** size_class(len(t)))))
            found = [walks.at(text, starts, k, places) for k in range(8)]
            agree.append(np.mean([(a == b).mean() ** samples for a, b in found]))
        if not agree:
            return 1
        meets = np.array(agree)
        return next((r for r in range(*REPEATS) if (1 - (1 - meets) ** r).mean() >= recall), REPEATS[1])

    def hashes(self, t: bytes, size: int) -> list[int]:
        return next((h.tolist() for _, h in self.grams(np.frombuffer(t, np.uint8), [size])), [])

    @staticmethod
    def grams(data: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
        """(size, hash of every gram of that many bytes) for rising sizes, each grown from the last."""
        wide = data.astype(U64)
        h = np.zeros(len(data), U64)
        at = 0
        for size in sizes:
            n = len(data) - size + 1
            if n <= 0:
                return
            h = h[:n]
            for j in range(at, size):
                h = h * U64(0x100000001B3) + wide[j : j + n]
            at = size
            yield size, mix(h)

    def windows(self, data: bytes) -> set[tuple[int, int]]:
        """(size class, start) of the windows worth a look."""
        found: set[tuple[int, int]] = set()
        for size, h in self.grams(np.frombuffer(data, np.uint8), sorted(self.tables)):
            table, likely = self.tables[size]
            places = np.flatnonzero(likely[(h >> U64(44)).astype(np.int64)])
            for p, key in zip(places.tolist(), h[places].tolist(), strict=True):
                for kind, at in table.get(key, ()):
                    found.add((kind, max(0, p - at)))
        return found

    def candidates(self, texts: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(item, text, start) of the windows of texts that meet an item in a bucket."""
        by_kind: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, t in enumerate(texts):
            for kind, s in self.windows(t):
                by_kind[kind].append((i, s))
        for kind, where in by_kind.items():
            size = math.ceil(WIDTH ** (kind + 1))
            lot = max(1, (1 << 24) // size)
            for a in range(0, len(where), lot):
                part = where[a : a + lot]
                text, starts = laid_out([texts[i][s : s + size] for i, s in part])
                met: set[tuple[int, int]] = set()
                for k, (keys, order) in enumerate(self.buckets):
                    own = self.walks.keys(text, starts, k, kind)
                    low, high = np.searchsorted(keys, own, side="left"), np.searchsorted(keys, own, side="right")
                    for j in np.flatnonzero(low < high).tolist():
                        met.update((int(x), j) for x in order[low[j] : high[j]])
                yield from ((x, *part[j]) for x, j in met)

    def finds(self, texts: list[bytes]) -> list[list[tuple[int | None, int, int, int]]]:
        """For each text (item_id, start, end, distance) of the items found, one find for an item."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for k, i, s in self.candidates(texts):
            pattern = self.items[k][1]
            n, d = len(pattern), int(self.allowed * len(pattern))
            if (k, i) in best and best[k, i][0] == 0:
                continue
            if texts[i].startswith(pattern, s):
                best[k, i] = 0, s, s + n
                continue
            low = max(0, s - d)
            found, end = distance(pattern, texts[i][low : s + n + d])
            if found <= d and ((k, i) not in best or found < best[k, i][0]):
                best[k, i] = found, max(low, low + end - n), low + end
        out: list[list] = [[] for _ in texts]
        for (k, i), (found, start, end) in best.items():
            out[i].append((self.items[k][0], start, end, found))
        for i, t in enumerate(texts):
            out[i] += [(item, t.find(p), t.find(p) + len(p), 0) for item, p in self.short if p in t]
            out[i].sort(key=lambda f: (f[0] is None, f[0] or 0, f[1:]))
        return out


_index: dict[int, Index] = {}


def made(value: tuple) -> Index:
    """The worker's index of these items."""
    key = hash((tuple(value[0]), *value[1:]))
    if key not in _index:
        _index.clear()
        _index[key] = Index(*value)
    return _index[key]


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", allowed: float = ALLOWED, q: int = Q, carry: list[str] | None = None, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """doc_id, contaminated, finds (array of item_id, start, end, distance; places in the plain text): one row per row of docs.

    The columns to carry come along in a struct `carried`.
    """
    items = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("item_id"), F.col(f"`{item_text_col}`").cast("string").alias("text"))
    lots = int((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // item_bytes) + 1
    carried = F.struct(*(F.col(f"`{c}`") for c in carry)) if carry else F.lit(None).cast("struct<none: int>")
    finds = "array<struct<item_id: long, start: long, end: long, distance: long>>"
    out = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), carried.alias("carried"), F.array().cast(finds).alias("finds"))
    for lot in range(lots):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(lots)) == lot)
        rows = sorted(((r["item_id"], plain((r["text"] or "").encode())) for r in own.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        out = _one_lot(out, rows, allowed, q)
        if lot < lots - 1:
            out = cut(out, "finds")
    return out.select("doc_id", (F.size("finds") > 0).alias("contaminated"), "finds", "carried")


def _one_lot(docs: DataFrame, rows: list[tuple], allowed: float, q: int) -> DataFrame:
    """docs (doc_id, text, carried, finds) with the finds of these items added."""
    shared = docs.sparkSession.sparkContext.broadcast((rows, allowed, q))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = made(shared.value)

        def found(held: list[pa.RecordBatch], texts: list[bytes]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            kind = held[0].column(3).type
            value = [before + [dict(zip(("item_id", "start", "end", "distance"), f, strict=True)) for f in new] for before, new in zip(t.column("finds").to_pylist(), index.finds(texts), strict=True)]
            return pa.RecordBatch.from_arrays([*(t.column(c).combine_chunks() for c in names[:3]), pa.array(value, kind)], names=names)

        held: list[pa.RecordBatch] = []
        texts: list[bytes] = []
        size = 0
        for b in batches:
            new = [plain(t) for t in texts_of(b.column(1))]
            held.append(b)
            texts += new
            size += sum(map(len, new))
            if len(texts) >= LOT_ROWS or size >= LOT_BYTES:
                yield found(held, texts)
                held, texts, size = [], [], 0
        if texts:
            yield found(held, texts)

    return docs.mapInArrow(run, docs.schema)
