"""Hashes of the words of many texts at once, straight from an Arrow column's bytes.

A word's hash is the sum of a fixed random 64-bit number for each byte times the power of an odd number
for its place. Sums over all bytes of a block are taken in one go, so no word becomes a Python object.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
BLOCK = 1 << 17  # bytes hashed at a time; a longer word makes a longer block
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
_draw = np.random.default_rng(20240229)
BASE = int(_draw.integers(1 << 62)) * 2 + 1
#: A number for each byte; A-Z have those of a-z, white space has none.
BYTES = _draw.integers(0, 1 << 64, 256, dtype=np.uint64)
BYTES[65:91] = BYTES[97:123]
BYTES[SPACES] = 0


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_places = {}


def places(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n."""
    if len(_places.get("up", ())) < n:
        size = max(n, BLOCK)
        _places["up"], _places["down"] = powers(BASE, size), powers(pow(BASE, -1, 1 << 64), size)
    return _places["up"], _places["down"]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and where each row begins and the last ends; null is empty."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("")
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def slices(column: pa.Array, most: int):
    """The column in slices of about `most` bytes; a longer row is a slice of its own."""
    _, at = bytes_of(column)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield column.slice(first, last - first)
        first = last


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z as a-z, in order; and where each row's words begin and the last's end."""
    raw, at = bytes_of(column)
    return hash_words(raw, at)[:2]


def hash_words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, the rows' places among the words, and the byte where each word begins."""
    space = SPACES[raw]
    first = ~space
    first[1:] &= space[:-1]
    heads = at[:-1][at[:-1] < np.minimum(at[1:], len(raw))]
    first[heads] = ~space[heads]
    begins = np.flatnonzero(first)
    rows = np.searchsorted(begins, at)
    hashes = np.empty(len(begins), np.uint64)
    done = 0
    while done < len(begins):
        low = begins[done]
        upto = int(np.searchsorted(begins, low + BLOCK, "right")) - 1
        upto = max(upto, done + 1)
        high = begins[upto] if upto < len(begins) else len(raw)
        up, down = places(int(high - low))
        v = BYTES[raw[low:high]]
        v *= up[: len(v)]
        own = begins[done:upto] - low
        hashes[done:upto] = np.add.reduceat(v, own) * down[own]
        done = upto
    return mixed(hashes), rows, begins


class Known:
    """Numbers by hash, found and added for many hashes at once: a table with linear probing. What finds no place is not kept."""

    def __init__(self, slots: int = 1 << 21, probes: int = 12):
        self.keys, self.numbers, self.probes = np.zeros(slots, np.uint64), np.zeros(slots, np.int32), probes

    def slot(self, h: np.ndarray, k: int) -> np.ndarray:
        return ((h >> U(20)) + U(k)) & U(len(self.keys) - 1)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash; 0 for those not kept."""
        out, left = np.zeros(len(h), np.int64), np.arange(len(h))
        for k in range(self.probes):
            own = h[left]
            slot = self.slot(own, k)
            keys = self.keys[slot]
            hit = keys == own
            out[left[hit]] = self.numbers[slot[hit]]
            left = left[~hit & (keys != 0)]
            if not len(left):
                break
        return out

    def add(self, h: np.ndarray, numbers: np.ndarray) -> None:
        """Keeps distinct hashes that find() doesn't know."""
        left = np.arange(len(h))
        for k in range(self.probes):
            slot = self.slot(h[left], k)
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[left[free]]
            won = self.keys[slot] == h[left]
            self.numbers[slot[won]] = numbers[left[won]]
            left = left[~won]
            if not len(left):
                break
