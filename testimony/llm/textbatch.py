"""Whole-batch text work in numpy: words, lines and rolling hashes over the bytes of an Arrow string column."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash

#: Texts are taken together up to so many bytes; one longer text is taken alone and whole.
GROUP_BYTES = 1 << 20

#: Spans of up to so many bytes are hashed eight bytes at a time, others whole.
SHORT = 64

_U = np.uint64
_STEP = 0xD1B54A32D192ED03 | 1


def byte_table(pattern: str) -> np.ndarray:
    """Which bytes belong to a set written as a regular expression class of single bytes."""
    import re

    one = re.compile(pattern.encode("latin-1"))
    return np.array([bool(one.fullmatch(bytes([b]))) for b in range(256)])


#: Word bytes: all but ASCII white space.
PLAIN_WORD = byte_table(r"[^\x20\x09-\x0D]")
#: Word bytes: letters and digits of ASCII and everything beyond it. For lower-cased text.
ALNUM_WORD = byte_table(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
LEAD_BYTE = (np.arange(256) & 0xC0) != 0x80


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd base modulo 2**64 and those of its inverse, at least n of each."""
    size = max(1 << 16, 1 << max(n - 1, 1).bit_length())
    return _powers(base, size), _powers(pow(base, -1, 1 << 64), size)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class Texts:
    """The texts of some rows as one byte array. Null is an empty text."""

    def __init__(self, column: pa.Array, lower: bool = False):
        column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
        if column.null_count:
            column = column.fill_null("")
        self.n = len(column)
        _, offsets, data = column.buffers()
        offs = np.frombuffer(offsets, dtype=np.int64, count=self.n + 1 + column.offset)[column.offset :] if self.n else np.zeros(1, np.int64)
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.bytes = raw[offs[0] : offs[-1]]
        self.offsets = offs - offs[0]
        if lower:
            self.bytes = _LOWER[self.bytes]

    def text(self, row: int) -> bytes:
        return self.bytes[self.offsets[row] : self.offsets[row + 1]].tobytes()

    def find_words(self, member: np.ndarray) -> None:
        """Sets starts, ends (bytes), first (index of the first word of each text, n + 1 entries) and doc (text of each word)."""
        inside = member[self.bytes]
        before = np.empty_like(inside)
        after = np.empty_like(inside)
        if len(inside):
            before[0] = False
            before[1:] = inside[:-1]
            after[-1] = False
            after[:-1] = inside[1:]
            edges = self.offsets[1:-1]
            edges = edges[(edges > 0) & (edges < len(inside))]
            before[edges] = False
            after[edges - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.doc = np.repeat(np.arange(self.n), np.diff(self.first))

    def find_lines(self) -> None:
        r"""Sets line_starts, line_ends (bytes, without the \n), line_first and line_doc. Every text has at least one line."""
        breaks = np.flatnonzero(self.bytes == 10)
        self.line_starts = np.sort(np.concatenate([self.offsets[:-1], breaks + 1]), kind="stable")
        self.line_ends = np.sort(np.concatenate([breaks, self.offsets[1:]]), kind="stable")
        per = np.searchsorted(breaks, self.offsets[1:]) - np.searchsorted(breaks, self.offsets[:-1]) + 1
        self.line_first = np.concatenate([[0], np.cumsum(per)])
        self.line_doc = np.repeat(np.arange(self.n), per)

    def span_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each byte span: eight bytes at a time, scrambled after each, so that no sum of bytes and
        places can cancel; long spans by XXH64."""
        if not hasattr(self, "_eights"):
            padded = np.concatenate([self.bytes, np.zeros(8, np.uint8)])
            self._eights = np.ndarray(len(self.bytes) + 1, "<u8", padded, strides=(1,))
        length = ends - starts
        out = mix(length.astype(np.uint64) + _U(_STEP))
        going = np.flatnonzero((length > 0) & (length <= SHORT))
        at = 0
        while len(going):
            left = np.minimum(length[going] - at, 8).astype(np.uint64)
            eight = self._eights[starts[going] + at] & (_U(0xFFFFFFFFFFFFFFFF) >> (_U(64) - _U(8) * left))
            out[going] = mix(out[going] ^ eight)
            at += 8
            going = going[length[going] > at]
        for i in np.flatnonzero(length > SHORT).tolist():
            out[i] ^= _U(xxhash.xxh64_intdigest(self.bytes[starts[i] : ends[i]], 11))
        return out

    def word_hash(self) -> np.ndarray:
        return self.span_hash(self.starts, self.ends)

    def points(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How many code points stand in each of some spans that are not empty, in order and apart."""
        edges = np.stack([starts, ends], axis=1).ravel()
        lead = np.append(LEAD_BYTE[self.bytes], False)
        return np.add.reduceat(lead, edges, dtype=np.int64)[::2] if len(edges) else np.zeros(0, np.int64)

    def count(self, member: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How many bytes of a set stand in each span."""
        at = np.flatnonzero(member[self.bytes])
        return np.searchsorted(at, ends) - np.searchsorted(at, starts)


def gram_sums(hashes: np.ndarray, step: int = _STEP) -> np.ndarray:
    """Running sums for rolling hashes of some tens of words. Of 16 words that two texts hold in the worst order, 13 bits
    cancel in the products of powers; the words' own hashes don't."""
    power, _ = powers(step, len(hashes) + 1)
    out = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * power[: len(hashes)], out=out[1:])
    return out


def grams(sums: np.ndarray, n: int, at: np.ndarray | None = None, step: int = _STEP) -> np.ndarray:
    """Rolling hashes of n words, at every start or at the given ones; sums come from gram_sums."""
    _, inverse = powers(step, len(sums))
    if at is None:
        size = len(sums) - n
        return mix((sums[n:] - sums[:size]) * inverse[:size]) if size > 0 else np.zeros(0, np.uint64)
    return mix((sums[at + n] - sums[at]) * inverse[at])


def covered(size: int, starts: np.ndarray, n: int) -> np.ndarray:
    """Which of ``size`` places lie in a span of n from one of the starts."""
    opens = np.bincount(starts, minlength=size)[:size]
    closes = np.zeros_like(opens)
    closes[n:] = opens[: max(size - n, 0)]
    return np.cumsum(opens - closes) > 0


def groups(batch: pa.RecordBatch, column: str = "text", limit: int = GROUP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` bytes of text each, or one row."""
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(ends):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
