"""Hashed maximum-entropy language model with a class-factored softmax (operator 8).

log p(word | history) = log p(group | history) + log p(class | group, history) + log p(word | class). The first two
factors are softmaxes over 16 groups and 16 classes in each, log-linear in hashed features of the history: the classes of
the word before, the one before that and the third before (skips), and the two words before as an n-gram. The commonest
words of the training part are classes of their own; the others are in a class by their last two bytes, where the only
feature is the word itself, whose maximum-entropy solution is its share of the class (with 0.1 added to each count and to
one slot for all unknown words).

Training: rounds of distributed AdaGrad. In a round each task starts from the common weights, makes sparse numpy batches
of its documents and sends its weights, of fixed size; their mean by tokens is the next round's start. Every training
document serves in one round, with each of its tokens, the end among them, as a target.

Counts are exact over all training documents. Documents are dealt once, in the shared folder, to chunks of about
`chunk_bytes`, in the order in which they are read, so equal rows do not meet in one chunk. A chunk counts its words (as
64-bit hashes); the counts are added up by word with map-side combining, the totals come back to the chunks that have
the word, and a chunk is scored beside this dictionary: no vocabulary is broadcast.

Defined cases: a null or blank text is the end token alone; a null id counts as the empty text, whose crc32 is 0, so the
document is held out; a text of any length is one document of one chunk; without training documents every count is 0 and
N = V = 0; of words of one count the one of the least hash has a class of its own; repeated rows all count; other columns
are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, U64, collect_garbage, cut, hasher, ids_and_texts, mix, slices, texts_of

GROUPS = 16
CLASSES = GROUPS * GROUPS
OWN = CLASSES // 2  # classes of single words, the end token the first of them
SKIPS, PAIRS = 3, 2048  # the second a power of two
#: Rows of weights: of a class at each skip, of the hashed n-gram, of the constant. Lines of weights fit 16 bits.
ROWS = SKIPS * CLASSES + PAIRS + 1
LINES = ROWS * (1 + GROUPS)
ADDED = 0.1
ROUNDS, RATE, BATCH = 4, 0.3, 2048
CHUNK_BYTES = 12 << 20
END = 0x5851F42D4C957F2D
BLOCK = 1 << 16

def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, class by last bytes) of every token, an end after each text's words, and bounds."""
    out_h, out_s, counts = [], [], []
    for part in slices(texts):
        h, bounds = hasher().words(part)
        data = np.frombuffer(b" " + b"\n".join(part).lower() + b"\n", np.uint8)
        inside = ~SPACE[data]
        ends = np.flatnonzero(inside[:-1] & ~inside[1:])
        last, before = data[ends].astype(np.int64), data[ends - 1].astype(np.int64)
        s = OWN + (last * 31 + np.where(SPACE[before.astype(np.uint8)], 0, before)) % (CLASSES - OWN)
        out_h.append(np.insert(h, bounds[1:], U64(END)))
        out_s.append(np.insert(s, bounds[1:], 0))
        counts.append(np.diff(bounds) + 1)
    if not counts:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(1, np.int64)
    return np.concatenate(out_h), np.concatenate(out_s), np.concatenate(([0], np.cumsum(np.concatenate(counts))))


class Model:
    """Weights, and the words that are classes of their own.

    Lines of weights, each over 16 outcomes: of a feature row for the groups, then of a feature row and a group for its classes.
    """

    def __init__(self, own: np.ndarray, weights: np.ndarray) -> None:
        self.own, self.weights = own, weights.reshape(LINES, GROUPS)
        self.order = np.argsort(own)

    def classes(self, h: np.ndarray, suffix: np.ndarray) -> np.ndarray:
        """The class of each token: its own (its rank), or that of its last bytes."""
        ranked = self.own[self.order]
        at = np.minimum(np.searchsorted(ranked, h), len(ranked) - 1)
        return np.where(ranked[at] == h, self.order[at], suffix)

    @staticmethod
    def features(h: np.ndarray, c: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Rows of weights for each token: the classes before it, the n-gram before it, and the constant."""
        before = [np.where(place > k, np.roll(c, k + 1), 0) + k * CLASSES for k in range(SKIPS)]  # the end stands before a text
        one, two = (np.where(place > k, np.roll(h, k + 1), U64(0)) for k in (0, 1))
        pair = (mix(one * U64(3) + two) & U64(PAIRS - 1)).astype(np.int64) + SKIPS * CLASSES
        return np.stack((*before, pair, np.full(len(h), ROWS - 1))).T

    def logits(self, f: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        top, below = self.weights[:ROWS], self.weights[ROWS:]
        one, two = np.zeros((len(f), GROUPS), np.float32), np.zeros((len(f), GROUPS), np.float32)
        for k in range(f.shape[1]):
            one += top.take(f[:, k], axis=0)
            two += below.take(f[:, k] * GROUPS + g, axis=0)
        return one, two

    def log10(self, f: np.ndarray, c: np.ndarray) -> np.ndarray:
        """log10 of the probability of each class."""
        out = np.empty(len(c))
        for i in range(0, len(c), BATCH):
            s = slice(i, i + BATCH)
            g, k = np.divmod(c[s], GROUPS)
            line = np.arange(len(g))
            total = np.zeros(len(g))
            for x, y in zip(self.logits(f[s], g), (g, k), strict=True):
                x = x.T.copy()
                x -= x.max(axis=0)
                total += x[y, line] - np.log(np.exp(x).sum(axis=0))
            out[s] = total / np.log(10)
        return out

    def step(self, f: np.ndarray, c: np.ndarray, squares: np.ndarray, rate: float) -> None:
        """One AdaGrad step over a sparse batch."""
        g, k = np.divmod(c, GROUPS)
        grad = np.concatenate(self.logits(f, g)).T.copy()  # outcomes in lines, since numpy is quicker across lines
        grad -= grad.max(axis=0)
        np.exp(grad, out=grad)
        grad /= grad.sum(axis=0)
        grad[np.concatenate((g, k)), np.arange(grad.shape[1])] -= 1
        # the line of weights of each feature of each token, by its place among those that occur
        lines = np.stack((f.T, ROWS + f.T * GROUPS + g)).ravel()
        seen = np.zeros(LINES, bool)
        seen[lines] = True
        used = np.flatnonzero(seen)
        place = np.empty(LINES, np.int64)
        place[used] = np.arange(len(used))
        lines = place[lines]
        total = np.empty((len(used), GROUPS), np.float32)
        every = np.empty((2, f.shape[1], len(c)))
        for x in range(GROUPS):
            every[:] = grad[x].reshape(2, 1, -1)
            total[:, x] = np.bincount(lines, every.ravel(), len(used)) / len(c)
        s = squares.take(used, axis=0) + total * total
        squares[used] = s
        s += np.float32(1e-8)
        total *= np.float32(rate)
        total /= np.sqrt(s, out=s)
        self.weights[used] = np.subtract(self.weights.take(used, axis=0), total, out=total)


def places(bounds: np.ndarray, n: int) -> np.ndarray:
    """Place of each token in its text."""
    return np.arange(n) - np.repeat(bounds[:-1], np.diff(bounds))


def targets(model: Model, h: np.ndarray, suffix: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features and class of every token of some training texts."""
    c = model.classes(h, suffix)
    return model.features(h, c, places(bounds, len(h))), c


def trained(train: DataFrame, own: np.ndarray, weights: np.ndarray, rounds: int, rate: float) -> np.ndarray:
    """Weights after some rounds over disjoint parts of the training documents. train: doc_id, text, part."""
    context = train.sparkSession.sparkContext
    schema = pa.schema([("part", pa.int64()), ("block", pa.int32()), ("n", pa.float64()), ("sums", pa.binary())])
    ddl = "part long, block int, n double, sums binary"
    for r in range(rounds):
        start = context.broadcast((own, weights))

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = Model(start.value[0], start.value[1].copy())
            squares = np.full_like(model.weights, 1e-4)
            n = 0
            held: list[tuple[np.ndarray, np.ndarray]] = []
            for b in batches:
                h, s, bounds = words(texts_of(b.column(1)))
                held.append(targets(model, h, s, bounds))
                if sum(len(x) for _, x in held) >= BATCH:
                    f, c = (np.concatenate(x) for x in zip(*held, strict=True))
                    held = []
                    for i in range(0, len(c), BATCH):
                        model.step(f[i : i + BATCH], c[i : i + BATCH], squares, rate)
                    n += len(c)
            if held:
                f, c = (np.concatenate(x) for x in zip(*held, strict=True))
                if len(c):
                    model.step(f, c, squares, rate)
                    n += len(c)
            if n:
                flat = model.weights.ravel() * np.float32(n)
                part = TaskContext.get().partitionId()
                for i in range(0, len(flat), BLOCK):
                    yield pa.RecordBatch.from_pydict({"part": [part], "block": [i // BLOCK], "n": [float(n)], "sums": [flat[i : i + BLOCK].tobytes()]}, schema=schema)

        def add(t: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in t.column("sums").to_pylist())
            return pa.table({"part": [t.column("part")[0].as_py()], "block": [t.column("block")[0].as_py()], "n": [sum(t.column("n").to_pylist())], "sums": [total.astype(np.float32).tobytes()]}, schema=schema)

        parts = train.where(F.col("part") == r).select("doc_id", "text").mapInArrow(learn, ddl)
        for _ in range(3):
            parts = parts.withColumn("part", F.floor(F.col("part") / 64)).groupBy("part", "block").applyInArrow(add, ddl)
        flat, n = np.zeros(weights.size, np.float64), 0.0
        for row in parts.collect():  # as many values as there are weights
            flat[row["block"] * BLOCK : row["block"] * BLOCK + len(row["sums"]) // 4] += np.frombuffer(row["sums"], np.float32)
            n += row["n"] if row["block"] == 0 else 0
        if n:
            weights = (flat / n).astype(np.float32).reshape(weights.shape)
        start.unpersist()
        collect_garbage(train.sparkSession)
    return weights


def dealt_to_chunks(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """docs (doc_id, text, held_out) with a chunk: the next rows of a task, until they have chunk_bytes."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("held_out", pa.bool_()), ("chunk", pa.int64())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        held = 0
        for b in batches:
            sizes = np.array([len(t) for t in texts_of(b.column(1))], np.int64)
            chunk = first + (held + np.cumsum(sizes) - sizes) // chunk_bytes
            held += int(sizes.sum())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(chunk)], schema=schema)

    return cut(docs.mapInArrow(deal, "doc_id long, text string, held_out boolean, chunk long"), "dealt")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, rate: float = RATE, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of docs."""
    spark = docs.sparkSession
    docs = ids_and_texts(docs, id_col, text_col)
    text_id = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    dealt = dealt_to_chunks(docs.withColumn("held_out", F.crc32(text_id.cast("binary")) % 10 == 0), chunk_bytes)

    # the words of a chunk: their counts in training documents there
    schema = pa.schema([("chunk", pa.int64()), ("h", pa.int64()), ("suffix", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def summed(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            h, s, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            return u, s[first], np.bincount(inverse, weights=n, minlength=len(u)).astype(np.int64)

        def out(c: int) -> Iterator[pa.RecordBatch]:
            u, s, n = summed(held.pop(c))
            for i in range(0, len(u), 100_000):
                k = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u[k]), c)), pa.array(u[k].view(np.int64)), pa.array(s[k].astype(np.int32)), pa.array(n[k])], schema=schema)

        for b in batches:
            h, s, bounds = words(texts_of(b.column(1)))
            train = ~b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            chunk = b.column(3).to_numpy(zero_copy_only=False)
            sizes = np.diff(bounds)
            token_train, token_chunk = np.repeat(train, sizes).astype(np.int64), np.repeat(chunk, sizes)
            here = np.unique(chunk).tolist()
            for c in here:
                own = token_chunk == c
                parts = held.setdefault(c, [])
                parts.append(summed([(h[own], s[own], token_train[own])]))
                if len(parts) > 16:
                    held[c] = [summed(parts)]
            for c in [c for c in held if c not in here]:  # rows of a chunk follow each other
                yield from out(c)
        for c in list(held):
            yield from out(c)

    local = cut(dealt.mapInArrow(count, "chunk long, h long, suffix int, n long"), "words")
    totals = cut(local.groupBy("h").agg(F.sum("n").alias("c"), F.min("suffix").alias("suffix")), "counts")
    known = totals.where("c > 0")
    row = known.agg(F.sum("c"), F.count("*")).first()
    total, distinct = row[0] or 0, row[1]
    end = U64(END).astype(np.int64)
    found = known.where(F.col("h") != int(end)).orderBy(F.desc("c"), "h").limit(OWN - 1).collect()  # at most as many rows as there are classes
    top = [r["h"] for r in found]
    own = np.array([int(end), *top], np.int64).view(U64)
    rest = known.where(~F.col("h").isin([int(end), *top])).groupBy("suffix").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    mass, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in rest:
        mass[r["suffix"]], kinds[r["suffix"]] = r["n"], r["v"]
    ends = known.where(F.col("h") == int(end)).agg(F.sum("c")).first()[0] or 0
    mass[: 1 + len(found)] = [ends, *(r["c"] for r in found)]
    start = np.zeros((LINES, GROUPS), np.float32)
    shares = (mass + ADDED).reshape(GROUPS, GROUPS)  # training starts from the shares of groups and classes
    start[ROWS - 1] = np.log(shares.sum(axis=1) / shares.sum())
    start[-GROUPS:] = np.log(shares / shares.sum(axis=1, keepdims=True))
    weights = trained(dealt.where("not held_out").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(rounds))), own, start, rounds, rate)
    shared = spark.sparkContext.broadcast((own, weights, mass, kinds))
    out = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        own, weights, mass, kinds = shared.value
        model = Model(own, weights)
        keys = right.column("h").to_numpy().view(U64)
        order = np.argsort(keys)
        keys, counts = keys[order], right.column("c").to_numpy()[order]
        texts = [x or b"" for x in left.column("text").cast(pa.binary()).to_pylist()]
        results: list[np.ndarray] = []
        at = 0
        while at < len(texts):  # lots of about a megabyte
            part, size = [], 0
            while at < len(texts) and size < 1 << 20:
                part.append(texts[at])
                size += len(texts[at])
                at += 1
            h, s, bounds = words(part)
            c = counts[np.searchsorted(keys, h)]
            cls = model.classes(h, s)
            inside = np.where(cls < OWN, 0.0, np.log10((c + ADDED) / (mass[cls] + ADDED * (kinds[cls] + 1))))
            log = model.log10(model.features(h, cls, places(bounds, len(h))), cls) + inside
            base = np.log10((c + ADDED) / (total + ADDED * (distinct + 1)))
            results.append(np.stack([np.add.reduceat(x, bounds[:-1]) for x in (np.ones(len(h)), c > 0, base, log)]))
        n, k, base, log = np.concatenate(results, axis=1) if results else np.zeros((4, 0))
        m = len(texts)
        return pa.table([left.column("doc_id"), left.column("held_out"), pa.array(n.astype(np.int64)), pa.array(k.astype(np.int64)), pa.array(np.full(m, total, np.int64)), pa.array(base), pa.array(log)], schema=out)

    # a common word is in every chunk: its row of totals meets many, in a join whose large partitions can be split
    # (a chunk that two tasks counted may have a word twice, with the same total)
    dictionary = local.select("chunk", "h").join(totals.select("h", "c"), "h").select("chunk", "h", "c")
    return dealt.groupBy("chunk").cogroup(dictionary.groupBy("chunk")).applyInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
