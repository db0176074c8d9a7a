"""Token ids of whole texts with the tokenizers library, many texts at a time.

Both vocabularies split a text at a single space between two other characters before anything else happens, so the ids
of such a piece do not depend on its neighbours. Pieces are encoded once and remembered (a bounded table); every text is
put together from its pieces. The result is that of encoding the whole text: a text in which the string of an added token
occurs (such as an end-of-text mark) goes through the library whole.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator, Sequence
from itertools import product, repeat

import numpy as np

from .common import give_back, on_other_work
from .keys import LONGEST_KEY, Keys, hashed, keys_of
from .merges import LONGEST, Merges

#: New pieces that are learned together.
PIECES = 1 << 16
#: Pieces that a worker remembers; then only those met again are kept, or none if these are more than half.
REMEMBERED = 300_000
#: Signs that end a word; an apostrophe may begin a token with letters.
SIGNS = "!#$%&*,.:;?"
#: Characters whose lower case may depend on more than the character, or on the library.
FAR = re.compile("[\u0130\u0250-\U0010ffff]")
#: White space other than space and line feed, and the zero byte.
EXOTIC = re.compile("[\0\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
INNER = re.compile(r"(?<=\S) (?=\S)")
#: Bytes of characters that are no white space, in a text without EXOTIC.
GRAPHIC = ~np.isin(np.arange(256), [0, 0x0A, 0x20])


def kinds() -> tuple[np.ndarray, np.ndarray]:
    """Kind and lower case of the characters before U+0250, and of one that stands for all others."""
    kind, lower = np.zeros(0x251, np.uint8), np.arange(0x251, dtype=np.uint32)
    for i in range(0x250):
        c = chr(i)
        if c.isalpha() and not FAR.search(c) and ord(c.lower()) < 0x250:
            kind[i], lower[i] = LETTER, ord(c.lower())
    kind[[ord(c) for c in SIGNS]] = SIGN
    kind[[ord(" "), ord("\n")]] = BLANK, FEED
    return kind, lower


LETTER, SIGN, FEED, BLANK = 1, 2, 3, 4
KIND, LOWER = kinds()
#: Signs of a run at most, and characters of a piece at most, that numpy puts together.
SIGNS_AT_MOST, PLAIN = 8, 100
#: By the kinds of a piece's runs, three bits each: a word, signs behind it, and the same once more behind a line feed.
SHAPES = np.zeros(1 << 18, bool)
for _first, _word, _second in product(((), (BLANK,)), ((LETTER,), (LETTER, SIGN)), ((), (FEED, LETTER), (FEED, LETTER, SIGN))):
    SHAPES[sum(k << 3 * i for i, k in enumerate((*_first, *_word, *_second)))] = True


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of one of each, for every line which of these it equals)."""
    _, first, own = np.unique(hashed(keys), return_index=True, return_inverse=True)
    if (keys[first[own]] != keys).any():  # two keys of one hash
        _, first, own = np.unique(keys, axis=0, return_index=True, return_inverse=True)
    return first, own.reshape(-1)


class Encoder:
    """encode(texts) -> an array of uint32 ids for each text."""

    def __init__(self, path: str, keep_space: bool) -> None:
        from tokenizers import Tokenizer

        self.path, self.tokenizer = path, Tokenizer.from_file(path)
        # strings of added tokens, in any case: the library takes them out of a text before anything else
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)), re.IGNORECASE) if added else None
        self.lead = " " if keep_space else ""
        self.folds = self.tokenizer.normalizer is not None and "Lowercase" in str(self.tokenizer.normalizer)
        self.merges = Merges.of(json.loads(self.tokenizer.to_str())["model"])
        self.forget()

    def forget(self) -> None:
        #: piece -> place in starts and sizes; the first piece of a text has a space before it as its key
        self.known: dict[str, int] = {}
        self.flat, self.starts, self.sizes = array("I"), array("q"), array("q")
        self.short = Keys()  # those of at most LONGEST_KEY bytes from _by_bytes again, by their bytes
        self.again = bytearray()  # by place: met after the batch in which it was learned

    def trim(self) -> None:
        """Keep only the pieces that were met again since they were learned or last kept."""
        again = np.frombuffer(self.again, bool)
        known: dict[str, int] = {}
        ids, sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        keys, codes = np.zeros((0, 3), np.uint64), np.zeros(0, np.int64)
        if 2 * np.count_nonzero(again) <= REMEMBERED:
            ids, sizes = self._gather(np.flatnonzero(again))
            places = np.where(again, np.cumsum(again) - 1, -1)
            keys, codes = self.short.held()
            keys, codes = keys[again[codes]], places[codes[again[codes]]]
            place = places.tolist()
            known = {p: place[c] for p, c in self.known.items() if place[c] >= 0}
        self.forget()
        self._add([], ids, np.cumsum(sizes) - sizes, sizes)
        self.known = known
        self.short.add(keys, codes)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        give_back()
        for part in parts(texts):
            if len(self.known) > REMEMBERED:
                self.trim()
            out += self._encode(part)
        return out

    def _atoms(self, p: str) -> list[str]:
        """Pieces whose ids make up those of p: one line feed inside and signs behind a letter share no token with the rest.

        A vocabulary without case folds what it can, and one without spaces needs no mark of a text's first word.
        """
        if "\n" in p:
            x, _, y = p.partition("\n")
            if x and y and "\n" not in y and not x[-1].isspace() and not y[0].isspace():
                return [*self._atoms(x), " \n", *self._atoms(" " + y)]
        stem = p.rstrip(SIGNS)
        signs = p[len(stem) :] if stem[-1:].isalpha() else ""
        if not signs:
            stem = p
        if self.folds and (stem.isascii() or not FAR.search(stem)):
            stem = stem.lower()
        if not self.lead and stem[:1] == " " and stem[1:].isalpha():
            stem = stem[1:]
        return [stem, " " + signs] if signs else [stem]

    def _learn(self, missing: list[str]) -> None:
        """Encode new pieces: those of a plain shape in numpy, of the others their atoms first, as far as those are new too."""
        if self.merges:
            missing = [p for i in range(0, len(missing), PIECES) for p in self._learn_plain(missing[i : i + PIECES])]
        known = self.known
        alone, folded, made = [], [], []
        for p in missing:
            if not p.isalpha():
                made.append((p, self._atoms(p)))
            elif self.folds and (p.isascii() or not FAR.search(p)) and (q := p.lower()) != p:
                folded.append((p, q))
            else:
                alone.append(p)
        alone += [q for _, q in folded if q not in known]
        alone += [a for _, x in made for a in x if a not in known]
        self._learn_atoms(list(dict.fromkeys(alone)))
        known.update([(p, known[q]) for p, q in folded])
        known.update([(p, known[x[0]]) for p, x in made if len(x) == 1])
        joined = [y for y in made if len(y[1]) > 1]
        if joined:
            counts = np.fromiter((len(x) for _, x in joined), np.int64, len(joined))
            codes = np.fromiter((known[a] for _, x in joined for a in x), np.int64, int(counts.sum()))
            ids, n = self._gather(codes)
            sizes = np.add.reduceat(n, np.cumsum(counts) - counts)
            self._add([p for p, _ in joined], ids, np.cumsum(sizes) - sizes, sizes)

    def _learn_plain(self, missing: list[str]) -> list[str]:
        """Encode the pieces whose runs of letters and signs have one of SHAPES, as `_atoms` would part them; returns the others."""
        short = [p for p in missing if len(p) <= PLAIN]
        if not short:
            return missing
        code = np.minimum(np.frombuffer("".join(short).encode("utf-32-le"), np.uint32), len(KIND) - 1)
        kind = KIND[code]
        lengths = np.fromiter(map(len, short), np.int64, len(short))
        begins = np.cumsum(lengths) - lengths
        edge = np.append(True, kind[1:] != kind[:-1])
        edge[begins] = True
        runs = np.flatnonzero(edge)  # of characters of one kind in one piece
        first = (np.cumsum(edge) - 1)[begins]  # each piece's first run
        counts = np.diff(first, append=len(runs))
        place = np.arange(len(runs)) - np.repeat(first, counts)
        what, size = kind[runs].astype(np.int64), np.diff(runs, append=len(kind))

        # the text's UTF-8 bytes with a space before each run of letters
        low = LOWER[code] if self.folds else code
        wide = low >= 0x80
        step = 1 + wide.astype(np.int64)
        step[runs[what == LETTER]] += 1
        at = np.cumsum(step) - 1 - wide
        data = np.full(int(step.sum()), 0x20, np.uint8)
        data[at] = np.where(wide, 0xC0 | low >> 6, low)
        data[at[wide] + 1] = 0x80 | low[wide] & 0x3F
        width = np.append(at, len(data))[runs + size - 1] + 1 + wide[runs + size - 1] - at[runs]

        fits = np.select([what == LETTER, what == SIGN, what == 0], [width < LONGEST, size <= SIGNS_AT_MOST, False], size == 1)
        shape = np.add.reduceat(np.where(place < 6, what << 3 * np.minimum(place, 5), 0), first)
        good = SHAPES[shape] & (counts <= 6) & np.logical_and.reduceat(fits, first)
        if not good.any():
            return missing
        own = np.repeat(good, counts)
        runs, what, size, place, width = (x[own] for x in (runs, what, size, place, width))

        letters, signs = what == LETTER, (what == SIGN) | (what == FEED)
        marked = (bool(self.lead) & (place == 0))[letters]  # words with the space before them as their first symbol
        ids, starts, sizes = self.merges.encode_at(data, at[runs[letters]] - marked, width[letters] + marked)
        packed = np.zeros(np.count_nonzero(signs), np.uint64)
        for j in range(SIGNS_AT_MOST):
            has = np.flatnonzero(size[signs] > j)
            packed[has] |= code[runs[signs][has] + j].astype(np.uint64) << np.uint64(8 * j)
        kept, inverse = np.unique(packed, return_inverse=True)
        names = [" " + x.tobytes().rstrip(b"\0").decode() for x in kept.astype("<u8")]
        self._learn_atoms([x for x in names if x not in self.known])
        sign_ids, sign_sizes = self._gather(np.array([self.known[x] for x in names], np.int64))
        sign_starts = np.cumsum(sign_sizes) - sign_sizes

        pool = np.concatenate((sign_ids, ids.astype(np.uint32)))
        start, n = np.zeros(len(runs), np.int64), np.zeros(len(runs), np.int64)
        start[letters], n[letters] = starts + len(sign_ids), sizes
        start[signs], n[signs] = sign_starts[inverse], sign_sizes[inverse]
        ends = np.cumsum(n)
        every = pool[np.arange(int(n.sum())) + np.repeat(start - (ends - n), n)]
        counts = counts[good]
        totals = np.add.reduceat(n, np.cumsum(counts) - counts)
        self._add([p for p, g in zip(short, good.tolist(), strict=True) if g], every, np.cumsum(totals) - totals, totals)
        return [p for p in missing if p not in self.known]

    def _gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these pieces one after another, and how many each has."""
        n = np.frombuffer(self.sizes, np.int64)[codes]
        ends = np.cumsum(n)
        index = np.arange(ends[-1] if len(ends) else 0) + np.repeat(np.frombuffer(self.starts, np.int64)[codes] - (ends - n), n)
        return np.frombuffer(self.flat, np.uint32)[index], n

    def _learn_atoms(self, missing: list[str]) -> None:
        """Encode: plain words by the vocabulary's merges, many at once; the others by the library."""
        plain: dict[bool, tuple[list[str], list[bytes]]] = {True: ([], []), False: ([], [])}
        rest = []
        for p in missing:
            first = p[:1] == " "
            word = p[1:] if first else p
            if self.merges and word.isalpha() and (word.isascii() or not FAR.search(word)) and len(data := word.encode()) < LONGEST:
                names, words = plain[bool(self.lead) and not first]
                names.append(p)
                words.append(data)
            else:
                rest.append(p)
        for spaced, (names, words) in plain.items():
            if names:
                self._add(names, *self.merges.encode(words, spaced))
        for i in range(0, len(rest), 2048):
            part = rest[i : i + 2048]
            found = [e.ids for e in self.tokenizer.encode_batch_fast([p[1:] if p[:1] == " " else self.lead + p for p in part], add_special_tokens=False)]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            self._add(part, np.fromiter((x for y in found for x in y), np.int64, int(sizes.sum())), np.cumsum(sizes) - sizes, sizes)

    def _add(self, part: Sequence[str], ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.starts)
        self.known.update(zip(part, range(n, n + len(part)), strict=True))
        self.starts.frombytes((starts + len(self.flat)).astype(np.int64).tobytes())
        self.sizes.frombytes(sizes.astype(np.int64).tobytes())
        self.flat.frombytes(ids.astype(np.uint32).tobytes())
        self.again += bytes(len(sizes))

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        """A text that holds the string of an added token is encoded whole, all others piece by piece."""
        ways: dict = {self._whole: [], self._by_strings: [], self._by_bytes: []}
        for i, t in enumerate(texts):
            ways[self._whole if self.added and self.added.search(t) else self._by_strings if EXOTIC.search(t) else self._by_bytes].append(i)
        out = [np.zeros(0, np.uint32)] * len(texts)
        for way, own in ways.items():
            for i, ids in zip(own, way([texts[i] for i in own]) if own else (), strict=True):
                out[i] = ids
        return out

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) for t in texts]

    def _by_strings(self, texts: list[str]) -> list[np.ndarray]:
        """Texts with any white space."""
        pieces: list[str] = []
        counts = []
        for t in texts:
            p = INNER.split(t)
            p[0] = " " + p[0]
            pieces += p
            counts.append(len(p))
        codes = self._codes(pieces)
        return self._texts(codes, np.array(counts))

    def _by_bytes(self, texts: list[str]) -> list[np.ndarray]:
        """Texts whose white space is space and line feed, without zero bytes: pieces are found, told apart and looked up in numpy."""
        joined = (" " + "\0 ".join(texts) + "\0").encode()
        data = np.frombuffer(joined + bytes(LONGEST_KEY), np.uint8)
        bare = data[: len(joined)]
        inside = GRAPHIC[bare]
        split = bare == 0
        split[1:-1] |= (bare[1:-1] == 0x20) & inside[:-2] & inside[2:]
        ends = np.flatnonzero(split)
        starts = np.append(0, ends[:-1] + 1)
        counts = np.diff(np.flatnonzero(bare[ends] == 0), prepend=-1)
        sizes = ends - starts
        codes = np.empty(len(ends), np.int64)
        long = np.flatnonzero(sizes > LONGEST_KEY)
        if len(long):
            codes[long] = self._codes([joined[a:b].decode() for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)])
        short = np.flatnonzero(sizes <= LONGEST_KEY)
        keys = keys_of(data, starts[short], sizes[short])
        found = self.short.find(keys)
        np.frombuffer(self.again, bool)[found[found >= 0]] = True
        new = np.flatnonzero(found < 0)
        if len(new):
            first, own = distinct(keys[new])
            at = short[new[first]]
            names = [joined[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            learned = self._codes(names)
            self.short.add(keys[new[first]], learned)
            found[new] = learned[own]
        codes[short] = found
        return self._texts(codes, counts)

    def _codes(self, pieces: list[str]) -> np.ndarray:
        """Places of the pieces; those not known are learned."""
        codes = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        at = np.flatnonzero(codes < 0).tolist()
        np.frombuffer(self.again, bool)[codes[codes >= 0]] = True
        if at:
            new = [pieces[i] for i in at]
            self._learn(list(dict.fromkeys(new)))
            codes[at] = np.fromiter(map(self.known.get, new), np.int64, len(new))
        return codes

    def _texts(self, codes: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
        """The ids of each text, from its pieces."""
        every, n = self._gather(codes)
        bounds = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], np.cumsum(counts)))]
        return [every[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def parts(texts: list[str], most: int = 1 << 21) -> Iterator[list[str]]:
    part: list[str] = []
    size = 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


_made: dict[tuple[str, bool], Encoder] = {}


def forget() -> None:
    """A worker that turns to another operator gives back what its encoders remember."""
    for e in _made.values():
        e.forget()


on_other_work.append(forget)


def encoder(name: str) -> Encoder:
    """The worker's encoder of a public vocabulary: a name in public_tokenizers, or a path."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if "/" in name:
        path = name
    else:
        import public_tokenizers

        path = public_tokenizers.path(name)
    key = path, "byte_bpe" in path
    if key not in _made:
        _made[key] = Encoder(*key)
    return _made[key]
