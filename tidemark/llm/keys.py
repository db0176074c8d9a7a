"""Codes of short byte strings, found many at once in numpy.

A string without zero bytes is a key of as many 64-bit numbers as LONGEST_KEY bytes fill, padded with zeros, so a key
stands for one string alone; hashes only say where to look.
"""

from __future__ import annotations

import numpy as np

LONGEST_KEY = 24
SPREAD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], np.uint64)
#: By number of bytes: the bits that they fill.
BITS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def keys_of(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A line of three numbers for each string; data goes on for LONGEST_KEY bytes behind the last."""
    at_any = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    out = np.empty((len(starts), 3), np.uint64)
    for k in range(3):
        out[:, k] = at_any[starts + 8 * k] & BITS[np.clip(sizes - 8 * k, 0, 8)]
    return out


def hashed(keys: np.ndarray) -> np.ndarray:
    x = keys[:, 0] * SPREAD[0] + keys[:, 1] * SPREAD[1] + keys[:, 2] * SPREAD[2]
    return (x ^ (x >> np.uint64(32))) * SPREAD[2]


class Keys:
    """An open-addressed table; a line holds a key and its code."""

    def __init__(self, bits: int = 14) -> None:
        self.bits, self.n = bits, 0
        self.lines = np.zeros((1 << bits, 4), np.uint64)

    def _places(self, keys: np.ndarray) -> np.ndarray:
        return (hashed(keys) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The code of each key, or -1."""
        out = np.full(len(keys), -1, np.int64)
        at, left = self._places(keys), np.arange(len(keys))
        while len(left):
            line = self.lines.take(at, axis=0)
            same = (line[:, 0] == keys[:, 0]) & (line[:, 1] == keys[:, 1]) & (line[:, 2] == keys[:, 2])
            out[left[same]] = line[same, 3].astype(np.int64)
            far = np.flatnonzero(~same & (line[:, 0] != 0))
            at, left, keys = (at[far] + 1) & (len(self.lines) - 1), left[far], keys[far]
        return out

    def add(self, keys: np.ndarray, codes: np.ndarray) -> None:
        """Keys that differ and are not in the table."""
        if 2 * (self.n + len(keys)) > len(self.lines):
            old_keys, old_codes = self.held()
            self.__init__((4 * (self.n + len(keys))).bit_length())
            self.add(old_keys, old_codes)
        self.n += len(keys)
        at, codes = self._places(keys), codes.astype(np.uint64)
        while len(keys):  # of those that want one free place the first gets it, the others look further
            free = np.flatnonzero(self.lines[at, 0] == 0)
            got = free[np.unique(at[free], return_index=True)[1]]
            self.lines[at[got], :3], self.lines[at[got], 3] = keys[got], codes[got]
            rest = np.ones(len(keys), bool)
            rest[got] = False
            keys, codes, at = keys[rest], codes[rest], (at[rest] + 1) & (len(self.lines) - 1)

    def held(self) -> tuple[np.ndarray, np.ndarray]:
        """All keys and their codes."""
        used = self.lines[self.lines[:, 0] != 0]
        return used[:, :3].copy(), used[:, 3].astype(np.int64)
