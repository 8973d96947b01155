"""A wavelet matrix over small codes, asked for many places at once."""

from __future__ import annotations

import numpy as np

WORD = 64
HALVES = (32, 16, 8, 4, 2, 1)


class Bits:
    """A bit vector with counts before each 64-bit word."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        padded = np.zeros((self.n // WORD + 1) * 8, np.uint8)
        padded[: len(packed)] = packed
        self.words = padded.view("<u8")
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, places: np.ndarray) -> np.ndarray:
        """Ones before each place, 0 to n."""
        word, bit = places // WORD, (places % WORD).astype(np.uint64)
        low = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low)

    def select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Places of the k-th ones (or zeros), counted from 0; each must exist."""
        before = self.before if one else np.arange(len(self.before)) * WORD - self.before
        word = np.searchsorted(before, k, "right") - 1
        bits, left = self.words[word] if one else ~self.words[word], k - before[word]
        place = np.zeros(len(k), np.uint64)
        for half in HALVES:  # in which half of the word's rest it lies
            low = np.bitwise_count((bits >> place) & ((np.uint64(1) << np.uint64(half)) - np.uint64(1))).astype(np.int64)
            up = left >= low
            left = np.where(up, left - low, left)
            place += np.where(up, np.uint64(half), np.uint64(0))
        return word * WORD + place.astype(np.int64)


class WaveletMatrix:
    """Counts and places of codes below 2**width in a sequence of n codes."""

    def __init__(self, codes: np.ndarray, width: int):
        self.n, self.levels, self.zeros = len(codes), [], []
        for level in reversed(range(width)):
            ones = (codes >> level) & 1 == 1
            self.levels.append((level, Bits(ones)))
            self.zeros.append(self.n - int(ones.sum()))
            codes = np.concatenate([codes[~ones], codes[ones]])

    def _down(self, code: int, places: np.ndarray) -> np.ndarray:
        for (level, bits), zeros in zip(self.levels, self.zeros, strict=True):
            ones = bits.rank(places)
            places = zeros + ones if code >> level & 1 else places - ones
        return places

    def rank(self, code: int, places: np.ndarray) -> np.ndarray:
        """How many of this code lie before each place."""
        return self._down(code, places) - self._down(code, np.zeros(1, np.int64))

    def select(self, code: int, k: np.ndarray) -> np.ndarray:
        """Places of the k-th of this code, counted from 0; each must exist."""
        place = self._down(code, np.zeros(1, np.int64)) + k
        for (level, bits), zeros in zip(reversed(self.levels), reversed(self.zeros), strict=True):
            place = bits.select(place - zeros, True) if code >> level & 1 else bits.select(place, False)
        return place

    def count(self, codes: tuple[int, ...], places: np.ndarray) -> np.ndarray:
        """How many of these codes lie before each place: their ranks, added up."""
        return sum((self.rank(c, places) for c in codes), np.zeros(len(places), np.int64))

    def behind(self, codes: tuple[int, ...], k: np.ndarray) -> np.ndarray:
        """The places right behind the k-th of these codes, counted from 1; each must exist.

        One code is a select; several are a bisection on the sum of their ranks.
        """
        if len(codes) == 1:
            return self.select(codes[0], k - 1) + 1
        low, high = np.zeros(len(k), np.int64), np.full(len(k), self.n, np.int64)
        while (open_ := low < high).any():
            middle = (low + high) // 2
            enough = self.count(codes, middle) >= k
            high = np.where(open_ & enough, middle, high)
            low = np.where(open_ & ~enough, middle + 1, low)
        return low
