"""Token ids of whole texts, and containers of many documents' ids with Elias-Fano coded boundaries.

A container is one binary value: a header, the ids of its documents one after another in two or four
bytes each, and the places where documents begin. The n+1 places are coded by their low bits, packed,
and their high bits in unary, about 2 + log2(ids / documents) bits a document; samples of every 64th
set bit, in four bytes each, let a select find a place without reading the rest.
"""

from __future__ import annotations

import os
import re
import struct
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa

from wardline.llm.wordhash import BLOCK, Known, U, bytes_of, mixed, places

TOKENIZER = "byte_bpe_50k.json"
MAGIC = b"WEF2"
HEADER = struct.Struct("<4sBBxxIQQII")  # magic, bytes per id, low bits, documents, ids, high bits, bytes of low bits, samples
SAMPLE = 64
#: A blank inside white space, where a cut would part what the tokenizer takes as one piece.
INNER_BLANK = re.compile(r"\s (?:\s|\Z)")
PYTHON_SPACES = np.zeros(256, bool)
PYTHON_SPACES[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True
#: Bytes that are or may be part of white space.
ODD = PYTHON_SPACES | (np.arange(256) >= 0x80)
MARKS = np.zeros(256, bool)
MARKS[list(b".,;:!?|")] = True
ALNUM = np.zeros(256, bool)
ALNUM[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")] = True
#: A number for each byte, the same for no two of them.
EXACT = np.random.default_rng(20240301).integers(0, 1 << 64, 256, dtype=np.uint64)


class Encoder:
    """Ids by the tokenizers library, of texts cut where its own rule ends a piece.

    That rule ends one before every blank that has no white space on one of its sides, and what the
    tokenizer makes of a piece doesn't depend on the rest. So texts are cut there (and at some line breaks
    and marks, see cut) and equal pieces are encoded once. A text that holds any other blank is encoded in
    one go. Pieces are told apart by 64-bit hashes of their bytes, and found for a whole batch at once.
    """

    def __init__(self, path: str | None = None, most: int = 1_000_000, longest: int = 48, together: int = 256):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path(TOKENIZER))
        self.width = 2 if self.tokenizer.get_vocab_size() <= 65_536 else 4
        self.code, self.kind = ("H", np.uint16) if self.width == 2 else ("I", np.uint32)
        self.most, self.longest, self.together = most, longest, together
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else -1
        if len(line) != 1:
            self.together = 1
        self.known = Known()
        self.first, self.count, self.n = np.zeros(4096, np.int64), np.zeros(4096, np.int32), 1  # piece 0 is none
        self.store, self.used = np.zeros(1 << 16, self.kind), 0

    def forget(self) -> None:
        """Keeps the half that was met first, which is met most."""
        self.n = self.most // 2
        self.used = int(self.first[self.n - 1] + self.count[self.n - 1])
        kept = (self.known.numbers > 0) & (self.known.numbers < self.n)
        keys, numbers = self.known.keys[kept], self.known.numbers[kept]
        self.known = Known()
        self.known.add(keys, numbers)

    def ids(self, texts: list[str], plain: list[bool]) -> list[bytes]:
        """The ids of each text by the library. Those without white space, but for a blank before them, go many in a call with a line break between. plain: known to be such."""
        one = [i for i, (t, known) in enumerate(zip(texts, plain, strict=True)) if known or ((t[1:] if t[:1] == " " else t).split() == [t.lstrip(" ")] and t[:2] != "  ")]
        groups = [one[i : i + self.together] for i in range(0, len(one), self.together)]
        out: list = [None] * len(texts)
        for group, x in zip(groups, self.tokenizer.encode_batch_fast(["\n".join([texts[i] for i in g]) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(x.ids, self.kind)
            ends = np.append(np.flatnonzero(ids == self.line), len(ids)).tolist()
            if len(ends) == len(group):  # else some text takes part in what stands between, and all go by themselves
                raw, at, w = ids.tobytes(), 0, self.width
                for i, end in zip(group, ends, strict=True):
                    out[i] = raw[at * w : end * w]
                    at = end + 1
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = array(self.code, x.ids).tobytes()
        return out

    def put(self, ids: list[bytes]) -> np.ndarray:
        """Numbers of new pieces with these ids."""
        flat = np.frombuffer(b"".join(ids), self.kind)
        size = np.array([len(x) // self.width for x in ids], np.int64)
        while self.n + len(ids) > len(self.first):
            self.first, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.count))
        while self.used + len(flat) > len(self.store):
            self.store = np.concatenate([self.store, np.zeros_like(self.store)])
        self.store[self.used : self.used + len(flat)] = flat
        self.first[self.n : self.n + len(ids)] = self.used + np.cumsum(size) - size
        self.count[self.n : self.n + len(ids)] = size
        self.n, self.used = self.n + len(ids), self.used + len(flat)
        return np.arange(self.n - len(ids), self.n)

    def encode_column(self, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each text and the end id, one after another, and where each text's begin and the last's end."""
        if self.n > self.most:
            self.forget()
        raw, at = bytes_of(column)
        n = len(at) - 1
        if not n:
            return np.zeros(0, self.kind), at
        begin, stop, after_blank, first = self.cut(raw, at)
        h = hash_ranges(raw, begin, stop)
        h[after_blank] = mixed(h[after_blank]) | U(1)
        piece = self.known.find(h)
        missing = np.flatnonzero(piece == 0)
        if len(missing):
            different, one, back = np.unique(h[missing], return_index=True, return_inverse=True)
            where = missing[one]
            parts = [(" " if blank else "") + raw[a:b].tobytes().decode("utf-8", "surrogatepass") for a, b, blank in zip(begin[where].tolist(), stop[where].tolist(), after_blank[where].tolist(), strict=True)]
            odd = np.append(0, np.cumsum(ODD[raw]))
            plain = (odd[begin[where]] == odd[stop[where]]) & (begin[where] < stop[where])
            number = self.put(self.ids(parts, plain.tolist()))
            kept = stop[where] - begin[where] <= self.longest
            self.known.add(different[kept], number[kept])
            piece[missing] = number[back]
        heads = np.flatnonzero(first)
        ends = np.append(heads[1:], len(piece))
        piece = np.insert(piece, ends, self.put([array(self.code, [end]).tobytes()])[0])
        size = self.count[piece]
        upto = np.cumsum(size)
        out = self.store[np.repeat(self.first[piece] - upto + size, size) + np.arange(upto[-1])]
        self.n, self.used = self.n - 1, self.used - 1
        return out, np.append(0, upto[ends + np.arange(n)])

    @staticmethod
    def cut(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where pieces begin and stop, whether a blank belongs before them, and whether they begin a text.

        Besides blanks, pieces end before and behind a line break with no white space beside it, and
        before a mark between an ASCII letter or digit and white space or the text's end.
        """
        n = len(at) - 1
        whole = np.zeros(n, bool)  # texts encoded in one go
        for i in np.unique(np.searchsorted(at, doubtful_blanks(raw, at), "right") - 1).tolist():
            whole[i] = INNER_BLANK.search(raw[at[i] : at[i + 1]].tobytes().decode("utf-8", "surrogatepass")) is not None

        def in_cut_texts(x: np.ndarray) -> np.ndarray:
            return x[~whole[np.searchsorted(at, x, "right") - 1]] if len(x) else x

        edge = np.zeros(len(raw) + 2, bool)  # edge[i + 1]: byte i begins a text
        edge[at + 1] = True
        blank = in_cut_texts(np.flatnonzero(raw == 0x20))
        line = np.flatnonzero(raw == 0x0A)
        line = line[~edge[line + 1] & ~edge[line + 2]]
        line = in_cut_texts(line[~maybe_space_before(raw, line) & ~maybe_space_after(raw, line)])
        mark = np.flatnonzero(MARKS[raw])
        mark = mark[~edge[mark + 1]]
        behind = raw[np.minimum(mark + 1, len(raw) - 1)]
        mark = in_cut_texts(mark[ALNUM[raw[mark - 1]] & ((behind == 0x20) | (behind == 0x0A) | edge[mark + 2])])
        begin = np.concatenate([blank + 1, line, line + 1, mark, at[:-1]])  # a piece that is empty at a text's end comes before the next text
        kind = np.zeros(len(begin), np.int8)
        kind[: len(blank)], kind[len(begin) - n :] = 1, 2
        order = np.argsort(begin, kind="stable")
        begin, kind = begin[order], kind[order]
        stop = np.append(begin[1:] - (kind[1:] == 1), at[-1:])
        return begin, stop, kind == 1, kind == 2

    def encode(self, texts: list[str], end: int) -> list[bytes]:
        """The ids of each text and the end id, as bytes in this encoder's width."""
        ids, at = self.encode_column(pa.array(texts, pa.large_string()), end)
        return [ids[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)]


def hash_ranges(raw: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A hash of each range of bytes, which rise and don't overlap. Never 0."""
    out = np.empty(len(begin), np.uint64)
    done = 0
    while done < len(begin):
        low = int(begin[done])
        upto = int(np.searchsorted(begin, low + BLOCK, "right"))
        high = max(int(stop[upto - 1]), low + 1)
        up, down = places(high - low + 1)
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(EXACT[raw[low:high]] * up[: high - low], out=total[1:])
        own, end = begin[done:upto] - low, stop[done:upto] - low
        out[done:upto] = (total[end] - total[own]) * down[own] + (end - own).astype(np.uint64)
        done = upto
    return mixed(out) | U(1)


def maybe_space_before(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character before each place may be white space, all bytes that end one counted."""
    before = raw[at - 1]
    return PYTHON_SPACES[before] | (before >= 0x80) & (before <= 0xAF) & np.isin(raw[at - 2], [0xC2, 0x9A, 0x80, 0x81])


def maybe_space_after(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character behind each place may be white space, all bytes that begin one counted."""
    after = raw[np.minimum(at + 1, len(raw) - 1)]
    return PYTHON_SPACES[after] | np.isin(after, [0xC2, 0xE1, 0xE2, 0xE3])


def doubtful_blanks(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Blanks that may have white space on both sides, a text's end counted as such."""
    blank = np.flatnonzero(raw == 0x20)
    if not len(blank):
        return blank
    ends = np.zeros(len(raw) + 1, bool)
    ends[at[1:]] = True
    return blank[maybe_space_before(raw, blank) & (maybe_space_after(raw, blank) | ends[blank + 1])]


def pack_low(values: np.ndarray, bits: int) -> bytes:
    if not bits:
        return b""
    planes = (values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def write_container(ids: np.ndarray, ends: np.ndarray) -> bytes:
    """One container of documents' ids, one after another; ends: where each begins and the last ends."""
    ends = ends.astype(np.uint64)
    n, total = len(ends) - 1, int(ends[-1])
    low = max(0, (total // (n + 1)).bit_length() - 1)
    ones = (ends >> np.uint64(low)).astype(np.int64) + np.arange(n + 1)
    high = np.zeros(int(ones[-1]) + 1, np.uint8)
    high[ones] = 1
    samples = ones[::SAMPLE].astype("<u4")
    lows = pack_low(ends, low)
    head = HEADER.pack(MAGIC, ids.itemsize, low, n, total, len(high), len(lows), len(samples))
    return b"".join([head, samples.tobytes(), lows, np.packbits(high, bitorder="little").tobytes(), ids.tobytes()])


class Container:
    """Reads what write_container wrote."""

    def __init__(self, data: bytes):
        magic, self.width, self.low, self.n, self.total, n_high, n_low, n_samples = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a container")
        at = HEADER.size
        self.samples = np.frombuffer(data, "<u4", n_samples, at)
        at += 4 * n_samples
        self.lows = np.frombuffer(data, np.uint8, n_low, at)
        at += n_low
        self.high = np.frombuffer(data, np.uint8, -(-n_high // 8), at)
        at += len(self.high)
        self.ids = np.frombuffer(data, f"<u{self.width}", self.total, at)

    def low_part(self, i: int) -> int:
        first = i * self.low
        read = int.from_bytes(self.lows[first >> 3 : (first + self.low + 7) >> 3].tobytes(), "little")
        return read >> (first & 7) & ((1 << self.low) - 1)

    def start(self, i: int) -> int:
        """Where document i begins (i = n: the end of the last): a select from the nearest sample, which reads up to the next one at most."""
        k = i // SAMPLE
        first = int(self.samples[k])
        last = int(self.samples[k + 1]) if k + 1 < len(self.samples) else 8 * len(self.high)
        bits = np.unpackbits(self.high[first >> 3 : (last + 7) >> 3], bitorder="little")
        at = first + int(np.flatnonzero(bits[first & 7 :])[i % SAMPLE])
        return (at - i) << self.low | self.low_part(i)

    def starts(self) -> np.ndarray:
        """All n + 1 places at once."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n + 1]
        out = (ones - np.arange(self.n + 1)) << self.low
        if self.low:
            bits = np.unpackbits(self.lows, bitorder="little")[: (self.n + 1) * self.low].reshape(-1, self.low)
            out = out | bits @ (1 << np.arange(self.low))
        return out.astype(np.int64)

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.start(i) : self.start(i + 1)]
