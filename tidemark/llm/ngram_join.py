"""N-gram Jaccard self-join and its connected components (operator 1).

Method: prefix filters under several global orders of the shingles, intersected before anything is verified. A pair of
Jaccard >= t shares a token among the first n - ceil(t * n) + 1 tokens of both sets under *every* total order.

1. One pass makes a signature of every set: its prefix under the first order (rare tokens first, by a fixed-size count
   sketch over all documents), its prefixes under two independent orders (16 or 32 bits a token: tokens that are equal
   stay equal), and a small odd sketch; large sets, which would crowd it, have one more by their size.
2. The first order is the index. Tokens that two or three sets share give their pairs by one aggregation. Sets that share
   a more frequent token are paired with three of them, the anchors.
3. Pairs whose prefixes do not meet under the second and the third order go, before any text moves. The others are
   verified on their whole sets, and the links contracted to components.
4. What still lies in different components under a frequent token is compared within the token's run, by size, place and
   odd sketch. A run with too many such pairs is split by the tokens of the second order, then of the third: sets that
   may link share one of each, so the index under several orders at once loses nothing. Its pairs pass step 3 too.

Copies: documents with the same shingle set are one class, and only classes are joined. A group of g near copies costs
about g comparisons; pairs within a component are not made, so no link between components is lost and links are not
counted.

Defined cases: null or blank text has an empty set, is linked with nothing and is its own component; fewer words than
the shingle size make one shingle; a text of any length is one set; equal sets tie on their least id; a repeated id is
one more document of that id; a null id stays null and never names a component (a component of null ids only has a null
component_id); other columns of docs are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPREAD, U64, cut, discard, filter_of, hasher, ids_and_texts, mix, runs, sketch, texts_of

SKETCH_BITS = 20
#: log2 of the bits in the odd sketch of a set.
ODD_BITS = 9
#: Independent token orders, besides the first, whose prefixes must intersect.
ORDERS = (0x27D4EB2F165667C5, 0xC2B2AE3D27D4EB4F)
#: Prefixes of at most so many tokens have 16 bits a token, longer ones 32.
NARROW = 128
#: Rows of frequent tokens, pairs or names of texts that may be broadcast (three longs each); more take a shuffle.
BROADCAST_TOKENS = 1_000_000
#: Pairs in different components that one run of a token may compare; a run with more is split by another order.
RUN_PAIRS = 4_000_000
#: Pairs that a task holds, to send each once.
HELD_PAIRS = 1 << 19


def prefix_length(n: int, t: Fraction) -> int:
    return n - math.ceil(t * n) + 1


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a sorted set, as two signed longs."""
    a = int(mix(s).sum(dtype=U64))
    b = int(mix(s * U64(0xA0761D6478BD642F) + U64(len(s))).sum(dtype=U64))
    return a - (a >> 63 << 64), b - (b >> 63 << 64)


def odd_sketch(s: np.ndarray, bits: int = ODD_BITS) -> bytes:
    """Bit i is the parity of the members that hash to i: the sketches of two sets differ in at most as many bits as the sets."""
    return np.packbits(np.bincount((mix(s ^ U64(SPREAD)) >> U64(64 - bits)).astype(np.int64), minlength=1 << bits) & 1).tobytes()


def large_sketch(s: np.ndarray) -> bytes | None:
    """For a set whose members crowd the small sketch, one of as many bits as members (up to twice as many); else none."""
    bits = (len(s) - 1).bit_length()
    return odd_sketch(s, bits) if bits > ODD_BITS else None


def differing(x: bytes, y: bytes) -> int:
    """Bits in which two odd sketches differ; the finer one is folded to the length of the other."""
    a, b = (np.unpackbits(np.frombuffer(v, np.uint8)) for v in (x, y))
    while len(a) > len(b):
        a = a[::2] ^ a[1::2]
    while len(b) > len(a):
        b = b[::2] ^ b[1::2]
    return int(np.count_nonzero(a != b))


def rank_levels(docs: DataFrame, size: int, bits: int = SKETCH_BITS) -> np.ndarray:
    """For each counter of the sketch the octave of its count: common shingles come last in the first order."""
    counts = sketch(docs, lambda b: np.concatenate([np.zeros(0, U64), *hasher().shingle_sets(texts_of(b.column(1)), size)]), bits)
    return np.floor(2 * np.log2(np.maximum(counts, 1))).astype(np.uint8)


def first_prefix(s: np.ndarray, t: Fraction, levels: np.ndarray) -> np.ndarray:
    """The prefix under the first order, in that order."""
    bits = int(math.log2(len(levels)))
    rank = (levels[(s >> U64(64 - bits)).astype(np.int64)].astype(U64) << U64(56)) | (mix(s) >> U64(8))
    k = prefix_length(len(s), t)
    first = np.argpartition(rank, k - 1)[:k] if k < len(s) else np.arange(len(s))
    return s[first[np.argsort(rank[first])]]


def other_prefix(s: np.ndarray, order: int, t: Fraction) -> bytes:
    """The prefix under the order of mix(token ^ order): the high bits of another hash of its tokens."""
    k = prefix_length(len(s), t)
    by = mix(s ^ U64(order))
    if k < len(s):
        by = by[np.argpartition(by, k - 1)[:k]]
    bits = 16 if k <= NARROW else 32
    return (mix(by) >> U64(64 - bits)).astype(f"<u{bits // 8}").tobytes()


def signatures(docs: DataFrame, size: int, t: Fraction, levels) -> DataFrame:
    """doc_id, text_hash, n_shingles, d1, d2 (digest of the set; null where it is empty) of every document and, once for each set of a task: first, second, third (prefixes), small and large (odd sketches)."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("first", pa.list_(pa.int64())), ("second", pa.binary()), ("third", pa.binary()), ("small", pa.binary()), ("large", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # 8 bytes a set; forgetting only sends a copy again
        for b in batches:
            if len(seen) > 1_000_000:
                seen.clear()
            ds, more = [], []
            sizes = []
            for s in hasher().shingle_sets(texts_of(b.column(1)), size):
                d = digest(s) if len(s) else (None, None)
                new = len(s) > 0 and d[0] not in seen
                ds.append(d)
                sizes.append(len(s))
                more.append((first_prefix(s, t, levels.value).view(np.int64), *(other_prefix(s, o, t) for o in ORDERS), odd_sketch(s), large_sketch(s)) if new else (None,) * 5)
                if new:
                    seen.add(d[0])
            columns = [b.column(0), b.column(2), pa.array(sizes, pa.int64()), *(pa.array([d[i] for d in ds], pa.int64()) for i in (0, 1))]
            columns += [pa.array([m[i] for m in more], schema.field(5 + i).type) for i in range(5)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, d1 long, d2 long, first array<long>, second binary, third binary, small binary, large binary")


def shared_tokens(posts: DataFrame) -> DataFrame:
    """token, n (rows), x and y (least and greatest set), z (all of them by exclusive or) of tokens in the prefix of two sets or more."""
    return posts.groupBy("token").agg(F.count("*").alias("n"), F.min("d1").alias("x"), F.max("d1").alias("y"), F.bit_xor("d1").alias("z")).where("x < y")


def few_pairs(tokens: DataFrame) -> DataFrame:
    """All pairs (a, b) of the sets of tokens with at most three rows: the third one is what the other two leave of z."""
    few = tokens.where("n <= 3").withColumn("m", F.expr("z ^ x ^ y"))
    third = F.when((F.col("n") == 3) & (F.col("m") != F.col("x")) & (F.col("m") != F.col("y")), F.array(F.struct(F.least("x", "m").alias("a"), F.greatest("x", "m").alias("b")), F.struct(F.least("y", "m").alias("a"), F.greatest("y", "m").alias("b"))))
    every = F.concat(F.array(F.struct(F.col("x").alias("a"), F.col("y").alias("b"))), F.coalesce(third, F.array().cast("array<struct<a: long, b: long>>")))
    return few.select(F.inline(every))


def anchor_pairs(posts: DataFrame) -> DataFrame:
    """Pairs (a, b) of every set with its token's anchors. posts: token, d1, n_shingles, n (rows of the token).

    The hub is the set whose prefix is the most shared for its length: a text that others were made from has no tokens of
    its own. The other anchors are the sets of the least and the greatest hash. Tokens of one group agree on all three;
    aggregation gives them with map-side combining, and no run is gathered.
    """
    shared = posts.groupBy("d1").agg((F.sum(F.log2("n")) / F.max("n_shingles")).alias("shared"))
    h = F.xxhash64("d1")
    best = posts.join(shared, "d1").groupBy("token").agg(F.max_by("d1", F.col("shared") + F.pmod(h, F.lit(1000)) / 1e9).alias("x1"), F.min_by("d1", h).alias("x2"), F.max_by("d1", h).alias("x3"))
    pairs = posts.select("token", "d1").join(best, "token").select(F.col("d1").alias("u"), F.explode(F.array_distinct(F.array("x1", "x2", "x3"))).alias("v")).where("u != v")
    return pairs.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))


def meet(x: bytes, n: int, y: bytes, m: int, t: Fraction) -> bool:
    """May two prefixes (of sets of n and m) have a token in common? Of different widths, the high 16 bits decide."""
    wide = [prefix_length(k, t) > NARROW for k in (n, m)]
    a, b = (np.frombuffer(v, np.uint32 if w else np.uint16) for v, w in zip((x, y), wide, strict=True))
    if wide[0] != wide[1]:
        a, b = (v >> 16 if w else v for v, w in zip((a, b), wide, strict=True))
    return bool(np.isin(a, b).any())


def distinct_signatures(sets: DataFrame) -> DataFrame:
    """d1, n, small, second, third, sure: one row for each set. sure: no other set has the same first half of its digest."""
    own = sets.where("small is not null")
    return own.groupBy("d1").agg(F.first(F.struct(F.col("n_shingles").alias("n"), "small", "large", "second", "third")).alias("s"), (F.min("d2") == F.max("d2")).alias("sure")).select("d1", "s.*", "sure")


def both_sides(pairs: DataFrame, have: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, then the columns of a's signature, then those of b's."""
    one = have.select(F.col("d1").alias("a"), *columns)
    two = have.select(F.col("d1").alias("b"), *(F.col(c).alias(f"q_{c}") for c in columns))
    return pairs.join(one, "a").join(two, "b").select("a", "b", *columns, *(f"q_{c}" for c in columns))


def meeting(pairs: DataFrame, have: DataFrame, t: Fraction) -> DataFrame:
    """The pairs (a, b) whose sizes and odd sketches allow a Jaccard of t and whose prefixes meet under every order."""
    low, high = t.numerator, t.denominator
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def kept(b: pa.RecordBatch, good: np.ndarray, sure: tuple[int, int]) -> Iterator[pa.RecordBatch]:
        keep = pa.array(good | ~np.logical_and(*(b.column(i).to_numpy(zero_copy_only=False).astype(bool) for i in sure)))
        yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], schema=schema)

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                n, m = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 5))
                x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint64).reshape(b.num_rows, -1) for i in (3, 6))
                overlap = (n + m - np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)) // 2
                yield from kept(b, (overlap * (high + low) >= low * (n + m)) & (high * np.minimum(n, m) >= low * np.maximum(n, m)), (4, 7))

    def closer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                n, x, m, y = (b.column(i).to_pylist() for i in (2, 3, 5, 6))
                overlap = [(n[i] + m[i] - (differing(x[i], y[i]) if x[i] and y[i] else 0)) // 2 for i in range(b.num_rows)]
                yield from kept(b, np.array([o * (high + low) >= low * (i + j) for o, i, j in zip(overlap, n, m, strict=True)]), (4, 7))

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                n, m = (b.column(i).to_pylist() for i in (2, 6))
                p = [b.column(i).to_pylist() for i in (3, 4, 7, 8)]
                yield from kept(b, np.array([all(meet(p[k][i], n[i], p[2 + k][i], m[i], t) for k in (0, 1)) for i in range(b.num_rows)]), (5, 9))

    def left_in(pairs: DataFrame) -> DataFrame:
        """The signatures of the pairs' sets, where pairs are few: only these travel then."""
        if pairs.count() > BROADCAST_TOKENS:
            return have
        return have.join(F.broadcast(pairs.select(F.explode(F.array("a", "b")).alias("d1")).distinct()), "d1", "left_semi")

    narrow = cut(both_sides(pairs, have, ["n", "small", "sure"]).mapInArrow(alike, "a long, b long"), "alike")
    narrow = cut(both_sides(narrow, left_in(narrow), ["n", "large", "sure"]).mapInArrow(closer, "a long, b long"), "closer")
    return both_sides(narrow, left_in(narrow), ["n", "second", "third", "sure"]).mapInArrow(ordered, "a long, b long")


def across(posts: DataFrame, labels: DataFrame, have: DataFrame, t: Fraction, run_pairs: int = RUN_PAIRS) -> DataFrame:
    """Pairs (a, b) of a token's run that lie in different components, after the filters on size, place and odd sketch.

    posts: token, d1, n_shingles, place. Counts with map-side combining find the runs of more than one component, and
    those with more than run_pairs pairs to compare; these are split by the tokens of the second, then the third order.
    """
    low, high = t.numerator, t.denominator
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def distinct() -> np.ndarray:
            every = np.concatenate(held)
            return every[np.unique(every.view("i8,i8"), return_index=True)[1]]

        for token, d1, n_all, place, component, small in runs(batches):
            bounds = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1], [True])))
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                order = np.argsort(n_all[s:e], kind="stable") + s
                d, c, n, p = d1[order], component[order], n_all[order], place[order]
                if (c == c[0]).all():
                    continue
                sketches = np.frombuffer(b"".join(small[order]), np.uint64).reshape(len(n), -1)
                for i in range(len(n) - 1):
                    # sizes: high * n_i >= low * n_j; place: the rest of both sets must still reach the overlap
                    j = slice(i + 1, int(np.searchsorted(n, high * n[i] // low, side="right")))
                    # whole-number overlap for Jaccard >= t: o * (high + low) >= low * (n_i + n_j)
                    need = low * (n[i] + n[j])
                    at = np.flatnonzero((c[j] != c[i]) & ((np.minimum(n[i] - p[i], n[j] - p[j]) + np.minimum(p[i], p[j])) * (high + low) >= need))
                    if len(at):
                        other = at + i + 1
                        apart = np.bitwise_count(sketches[other] ^ sketches[i]).sum(axis=1, dtype=np.int64)
                        other = other[(n[i] + n[other] - apart) // 2 * (high + low) >= need[at]]
                        if len(other):
                            held.append(np.stack((np.minimum(d[other], d[i]), np.maximum(d[other], d[i])), axis=1))
                            size += len(other)
                if size > 2 * HELD_PAIRS:  # a pair shares many tokens, and goes out once in a task
                    held = [distinct()]
                    size = len(held[0])
                    if size > HELD_PAIRS:
                        yield pa.RecordBatch.from_arrays([pa.array(held[0][:, 0]), pa.array(held[0][:, 1])], schema=schema)
                        held, size = [], 0
        if held:
            out = distinct()
            yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], schema=schema)

    def finer(order: str, posts: DataFrame) -> DataFrame:
        """The same postings under token and each token of another prefix (its high 16 bits)."""
        own = have.select("d1", order)
        narrow = prefix_length_at_most(NARROW, t)

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                token, n = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
                parts = [np.unique(np.frombuffer(v, np.uint16) if k <= narrow else np.frombuffer(v, np.uint32) >> 16) for v, k in zip(b.column(5).to_pylist(), n.tolist(), strict=True)]
                lengths = np.array([len(x) for x in parts], np.int64)
                which = np.repeat(np.arange(b.num_rows), lengths)
                keys = mix(token.view(U64)[which] + np.concatenate([np.zeros(0, U64), *(x.astype(U64) for x in parts)]) * U64(SPREAD)).view(np.int64)
                for i in range(0, len(which), 100_000):
                    k = slice(i, i + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[k]), *(b.column(j).take(pa.array(which[k])) for j in (1, 2, 3, 4))], names=["token", "d1", "n_shingles", "place", "component"])

        return posts.join(own, "d1").select("token", "d1", "n_shingles", "place", "component", order).mapInArrow(split, "token long, d1 long, n_shingles long, place long, component long")

    def weighed(posts: DataFrame) -> DataFrame:
        """posts, with the pairs of different components of their token: none are left out."""
        c = posts.groupBy("token", "component").agg(F.count("*").cast("double").alias("c"))
        pairs = c.groupBy("token").agg(((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2).alias("pairs")).where("pairs > 0")
        return cut(posts.join(pairs, "token"), "runs")

    now = weighed(posts.join(labels, "d1", "left").select("token", "d1", "n_shingles", "place", F.coalesce("component", "d1").alias("component")))
    parts = []
    for order in ("second", "third"):
        parts.append(now.where(F.col("pairs") <= run_pairs).drop("pairs"))
        now = now.where(F.col("pairs") > run_pairs).drop("pairs")
        if now.isEmpty():
            break
        now = weighed(finer(order, now))
    else:
        parts.append(now.drop("pairs"))  # they share tokens under all three orders
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    joined = every.join(have.select("d1", "small"), "d1").select("token", "d1", "n_shingles", "place", "component", "small")
    tasks = int(posts.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a row is worth many comparisons: not fewer by bytes
    return joined.repartition(tasks, "token").sortWithinPartitions("token").mapInArrow(run, "a long, b long").distinct()


def prefix_length_at_most(k: int, t: Fraction) -> int:
    """The largest set size whose prefix has at most k tokens."""
    n = k
    while prefix_length(n + 1, t) <= k:
        n += 1
    return n


def texts_by_set(docs: DataFrame, sets: DataFrame, ends: DataFrame) -> DataFrame:
    """d1, d2, text (zstd) of the sets that ends (d1) names: one text of each, fetched by its hash."""
    chosen = cut(sets.where("d1 is not null").join(ends, "d1", "left_semi").groupBy("d1", "d2").agg(F.min("text_hash").alias("text_hash")), "chosen")
    likely = filter_of(chosen.select("text_hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        seen: set[int] = set()
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False)
            keep = likely.value.has(keys)
            for i in np.flatnonzero(keep).tolist():  # a task sends a text once
                keep[i] = int(keys[i]) not in seen
                seen.add(int(keys[i]))
            if len(seen) > 1_000_000:
                seen.clear()
            texts = [z.compress(x) for x in texts_of(b.column(1).filter(pa.array(keep)))]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep)), pa.array(texts, pa.binary())], names=["text_hash", "text"])

    found = docs.select("text_hash", F.col("text").cast("binary").alias("text")).mapInArrow(run, "text_hash long, text binary")
    chosen = F.broadcast(chosen) if chosen.count() <= BROADCAST_TOKENS else chosen
    # dealt by d1 alone, as the joins of the pairs want it: texts travel once for both of their sides
    return found.join(chosen, "text_hash").repartition("d1").groupBy("d1", "d2").agg(F.min("text").alias("text"))


def verified(pairs: DataFrame, texts: DataFrame, size: int, t: Fraction) -> DataFrame:
    """The pairs (a1, a2, b1, b2: digests) whose sets have a Jaccard of at least t."""
    low, high = t.numerator, t.denominator
    schema = pa.schema([(x, pa.int64()) for x in ("a1", "a2", "b1", "b2")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[int, int], np.ndarray] = {}
        held = 0
        z = zstandard.ZstdDecompressor()
        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            left, right = list(zip(cols[0], cols[1], strict=True)), list(zip(cols[3], cols[4], strict=True))
            new = {d: x for d, x in (*zip(left, cols[2], strict=True), *zip(right, cols[5], strict=True)) if d not in kept}
            for d, s in zip(new, hasher().shingle_sets([z.decompress(x) for x in new.values()], size), strict=True):
                kept[d] = s
                held += len(s)
            rows = []
            for x, y in zip(left, right, strict=True):
                s, u = kept[x], kept[y]
                inter = len(s) + len(u) - len(np.union1d(s, u))
                if high * inter >= low * (len(s) + len(u) - inter):
                    rows.append((*x, *y))
            if held > 1 << 20:
                kept, held = {}, 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], schema=schema)

    one = texts.select(F.col("d1").alias("a1"), F.col("d2").alias("a2"), F.col("text").alias("at"))
    two = texts.select(F.col("d1").alias("b1"), F.col("d2").alias("b2"), F.col("text").alias("bt"))
    joined = pairs.join(one, pairs.a == one.a1).join(two, pairs.b == two.b1).select("a1", "a2", "at", "b1", "b2", "bt")
    return joined.mapInArrow(run, "a1 long, a2 long, b1 long, b2 long")


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """node, component (least node): alternating large-star and small-star steps until nothing changes.

    Every step is written to the shared folder; edges never come to the driver, only a count of changes does.
    """
    now = cut(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u != v").distinct(), "edges")
    before = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: every node and its smaller neighbours go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        last, now = now, cut(small, "edges")
        discard(last)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == state:
            return now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
        before = state


def ngram_jaccard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, run_pairs: int = RUN_PAIRS) -> DataFrame:
    """doc_id, n_shingles, component_id, n_class, component_key, text_hash: one row per row of docs.

    Two documents link when 100 * |intersection| >= percent * |union| of their distinct `size`-word shingles.
    component_id is the least doc_id reachable over links; n_class counts the documents with the same shingle set;
    component_key names the component (null for an empty set), also where all of its ids are null; text_hash (xxhash64)
    tells rows of one id apart.
    """
    spark = docs.sparkSession
    t = Fraction(percent, 100)
    docs = ids_and_texts(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    levels = spark.sparkContext.broadcast(rank_levels(docs, size))
    sets = cut(signatures(docs, size, t, levels), "sets")
    posts = sets.where("first is not null").select("d1", "n_shingles", F.posexplode("first").alias("place", "token")).withColumn("place", F.col("place").cast("long"))
    tokens = cut(shared_tokens(posts), "tokens")
    frequent = tokens.where("n > 3").select("token", "n")
    frequent = F.broadcast(frequent) if frequent.count() <= BROADCAST_TOKENS else frequent
    many = cut(posts.join(frequent, "token").select("token", "d1", "n_shingles", "place", "n"), "postings")
    have = cut(distinct_signatures(sets), "signatures")
    full, sets = sets, cut(sets.select("doc_id", "text_hash", "n_shingles", "d1", "d2"), "classes")
    discard(full)

    def links(pairs: DataFrame) -> DataFrame:
        pairs = cut(meeting(pairs, have, t), "pairs")
        ends = pairs.select(F.explode(F.array("a", "b")).alias("d1")).distinct()
        out = cut(verified(pairs, texts_by_set(docs, sets, ends), size, t), "links")
        discard(pairs)
        return out

    first = cut(few_pairs(tokens).union(anchor_pairs(many)).distinct(), "candidates")
    discard(tokens)
    edges = links(first)
    labels = cut(components(edges.select(F.col("a1").alias("u"), F.col("b1").alias("v"))).withColumnRenamed("node", "d1"), "labels")
    every = edges.union(links(across(many, labels, have, t, run_pairs).join(first, ["a", "b"], "left_anti")))
    classes = sets.where("d1 is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n_class"))
    # nodes are 128-bit digests; d1 alone names one, but for sets that collide in it
    node = lambda a, b: F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0"))
    final = components(every.select(node("a1", "a2").alias("u"), node("b1", "b2").alias("v")))
    classes = classes.withColumn("node", node("d1", "d2")).join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = classes.groupBy("component").agg(F.min("least_id").alias("component_id"))
    classes = classes.join(ids, "component").select("d1", "d2", "component_id", "n_class", F.col("component").alias("component_key"))
    discard(many, have, first, labels)
    linked = sets.where("d1 is not null").join(classes, ["d1", "d2"]).select("doc_id", "n_shingles", "component_id", "n_class", "component_key", "text_hash")
    alone = sets.where("d1 is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("n_class"), F.lit(None).cast("string").alias("component_key"), "text_hash")
    return linked.union(alone)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, with all their columns, of which one stays for each component: that of the least id.

    Rows with an empty set all stay; of rows that repeat id and text one stays, null ids among them. docs may have
    columns of any names.
    """
    found = cut(ngram_jaccard(docs, id_col, text_col, **options).select("doc_id", "component_key", "text_hash"), "classes")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    stay = found.where("component_key is not null").groupBy("component_key").agg(F.min(order).alias("o"), F.count("*").alias("n")).select(F.col("o.doc_id").alias("id"), F.col("o.text_hash").alias("hash"), F.lit(False).alias("blank"))
    blank = found.where("component_key is null").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), F.lit(True).alias("blank")).distinct()
    keys = stay.union(blank)
    text = F.col(f"`{text_col}`").cast("string")
    named = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{id_col}`").cast("long").alias("own_id"), F.xxhash64(text).alias("own_hash"))
    kept = named.join(keys, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_hash") == F.col("hash"))).select("row", "own_id", "own_hash", "blank")
    repeated = found.where("component_key is not null").groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count()
    if repeated:
        kept = kept.where("blank").union(kept.where("not blank").dropDuplicates(["own_id", "own_hash"]))
    return kept.select("row.*")
