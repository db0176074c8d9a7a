"""Merges of a byte-pair vocabulary on many words at once, in numpy.

A word is a column of symbols; in each round every word does the merge of its lowest rank, leftmost among equal ones, as
the library does word by word. A pair's rank is kept beside its left symbol, so a round looks up two pairs a word.
"""

from __future__ import annotations

import numpy as np

#: Bytes of a word at most, the mark before it included; longer ones are left to the library.
LONGEST = 40
#: Words that go through the rounds together, so that their columns stay in the processor's cache.
COLUMNS = 1 << 13
#: A symbol that takes part in no merge, and a pair without a rank.
NONE, NEVER = (1 << 31) - 1, (1 << 31) - 1
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def byte_signs() -> list[str]:
    """The character by which byte-level vocabularies write each byte."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Merges:
    """ids of words from the vocabulary's own list of merges."""

    def __init__(self, vocabulary: dict[str, int], merges: list, suffix: str) -> None:
        """suffix: what the last symbol of a word carries."""
        signs = byte_signs()
        self.inner = np.array([vocabulary[s] for s in signs], np.int32)
        self.last = np.array([vocabulary[s + suffix] for s in signs], np.int32)
        pairs: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            pairs[vocabulary[a] << 32 | vocabulary[b]] = rank, vocabulary[a + b]
        self.made = np.zeros(len(merges), np.int32)
        for rank, new in pairs.values():
            self.made[rank] = new
        self.bits = (4 * len(pairs)).bit_length()
        keys = np.fromiter(pairs, np.uint64, len(pairs))
        ranks = np.fromiter((r for r, _ in pairs.values()), np.int32, len(pairs))
        self.keys, self.ranks = np.full(1 << self.bits, NONE, np.uint64), np.full(1 << self.bits, NEVER, np.int32)
        at = self._places(keys)
        while len(keys):  # of those that want one free place the first gets it, the others look further
            free = np.flatnonzero(self.ranks[at] == NEVER)
            got = free[np.unique(at[free], return_index=True)[1]]
            self.keys[at[got]], self.ranks[at[got]] = keys[got], ranks[got]
            keys, ranks, at = np.delete(keys, got), np.delete(ranks, got), np.delete(at, got)
            at = (at + 1) & ((1 << self.bits) - 1)

    @classmethod
    def of(cls, model: dict) -> Merges | None:
        """The merges of a tokenizer's model, or none where it does more than to merge."""
        more = ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")
        suffix = model.get("end_of_word_suffix") or ""
        if model.get("type") != "BPE" or any(model.get(k) for k in more) or any(s + x not in model["vocab"] for s in byte_signs() for x in ("", suffix)):
            return None
        return cls(model["vocab"], model["merges"], suffix)

    def _places(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        at = self._places(keys)
        out = self.ranks[at]
        far = np.flatnonzero((self.keys[at] != keys) & (out != NEVER))
        out[far] = NEVER
        while len(far):
            at[far] = (at[far] + 1) & ((1 << self.bits) - 1)
            found = self.ranks[at[far]]
            here = self.keys[at[far]] == keys[far]
            out[far[here]] = found[here]
            far = far[~here & (found != NEVER)]
        return out

    def encode(self, words: list[bytes], spaced: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start of each word's, number of each word's), spaced: with a space before each word as its first symbol.

        No word is empty or has LONGEST bytes or more.
        """
        data = np.frombuffer(b" " + b" ".join(words), np.uint8)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        begins = np.cumsum(lengths + 1) - lengths
        return self.encode_at(data, begins - spaced, lengths + spaced)

    def encode_at(self, data: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for words that lie at these places of some bytes; each has LONGEST bytes at most, a space before it included."""
        order = np.argsort(lengths, kind="stable")
        starts, sizes = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        out, total = [np.zeros(0, np.int32)], 0
        for i in range(0, len(lengths), COLUMNS):
            own = order[i : i + COLUMNS]
            ids, n = self._merged(data, begins[own], lengths[own])
            starts[own], sizes[own] = total + np.cumsum(n) - n, n
            out.append(ids)
            total += len(ids)
        return np.concatenate(out), starts, sizes

    def _merged(self, data: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, rows = len(lengths), int(lengths.max()) + 2  # the first and the last row hold no symbol
        column = np.arange(n)
        place = np.arange(rows - 1)[:, None]
        within = place < lengths
        taken = data[np.minimum(begins + place, len(data) - 1)]
        symbols = np.full((rows, n), NONE, np.int32)
        symbols[1:] = np.where(within, self.inner[taken], NONE)
        symbols[lengths, column] = self.last[taken[lengths - 1, column]]
        best = np.full((rows, n), NEVER, np.int32)
        found = self._ranks(symbols[1:-1].ravel(), symbols[2:].ravel()).reshape(rows - 2, n)
        best[1:-1] = np.where(found == NEVER, NEVER, found * 64 + place[1:])
        before, after = np.repeat(np.arange(-1, rows - 1, dtype=np.int8)[:, None], n, 1), np.repeat(np.arange(1, rows + 1, dtype=np.int8)[:, None], n, 1)
        alive = np.zeros((rows, n), bool)
        alive[1:] = within
        symbols_, best_, before_, after_, alive_ = (x.reshape(-1) for x in (symbols, best, before, after, alive))
        while True:
            least = best.min(axis=0)
            own = np.flatnonzero(least != NEVER)
            if not len(own):
                break
            least = least[own]
            left = (least & 63) * n + own
            right = after_[left].astype(np.int64) * n + own
            new = self.made[least >> 6]
            alive_[right] = False
            best_[right] = NEVER
            symbols_[left] = new
            following = after_[right]
            after_[left] = following
            following = following.astype(np.int64) * n + own
            before_[following] = least & 63
            place = before_[left].astype(np.int64)
            previous = place * n + own
            ranks = self._ranks(np.concatenate((new, symbols_[previous])), np.concatenate((symbols_[following], new)))
            ranks, earlier = ranks[: len(own)], ranks[len(own) :]
            best_[left] = np.where(ranks == NEVER, NEVER, ranks * 64 + (least & 63))
            best_[previous] = np.where(earlier == NEVER, NEVER, earlier * 64 + place)
        return symbols.T[alive.T], np.count_nonzero(alive, axis=0)
