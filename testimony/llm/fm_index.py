"""An FM-index over word codes: suffix order, wavelet matrix of the Burrows-Wheeler text, sampled positions."""

from __future__ import annotations

import numpy as np

#: Every so many words a position is kept; locating an occurrence walks fewer steps than this.
SAMPLE = 16
END, BREAK = 0, 1


def suffix_order(codes: np.ndarray, alphabet: int) -> np.ndarray:
    """Starts of all suffixes in order. The last code must be smaller than all others.

    The first sort reads as many words as fit 62 bits; then only suffixes still tied are sorted, by their own and
    the rank that stands as far ahead as is known, which doubles each time.
    """
    n = len(codes)
    bits = max(int(alphabet - 1).bit_length(), 1)
    ahead = max(62 // bits, 1)
    key = np.zeros(n, np.int64)
    for k in range(ahead):
        key <<= bits
        if k < n:
            key[: n - k] |= codes[k:]
    # Whole arrays are as many at a time, and as wide, as they must be: a worker keeps what it once held.
    narrow = np.int32 if n < 1 << 31 else np.int64
    order = np.argsort(key)
    key = key[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    del key
    rank = np.empty(n, narrow)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=narrow), narrow(0)))
    order = order.astype(narrow)
    tied = np.flatnonzero(~(new & np.append(new[1:], True)))
    while len(tied):
        at = order[tied]
        beyond = at.astype(np.int64) + ahead
        key = rank[at].astype(np.int64) * (n + 1) + np.where(beyond < n, rank[np.minimum(beyond, n - 1)].astype(np.int64) + 1, 0)
        sub = np.argsort(key)
        at, key = at[sub], key[sub]
        order[tied] = at
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        rank[at] = np.maximum.accumulate(np.where(new, tied, 0))
        tied = tied[~(new & np.append(new[1:], True))]
        ahead *= 2
    return order


class FMIndex:
    """Counts and locates word sequences in one shard. Words are given as 64-bit hashes."""

    def __init__(self, n: int, vocabulary: np.ndarray, smaller: np.ndarray, levels: np.ndarray, marked: np.ndarray, samples: np.ndarray):
        self.n, self.vocabulary, self.smaller, self.levels, self.marked, self.samples = n, vocabulary, smaller, levels, marked, samples
        self.before = [_directory(x) for x in levels]
        self.zeros = [n - int(b[-1]) for b in self.before]
        self.marked_before = _directory(marked)

    @classmethod
    def build(cls, hashes: np.ndarray, breaks: np.ndarray) -> FMIndex:
        """hashes: of the words; breaks: how many words stand before the end of each text."""
        vocabulary, inverse = np.unique(hashes, return_inverse=True)
        n = len(hashes) + len(breaks) + 1
        codes = np.full(n, BREAK, np.int32 if n < 1 << 30 else np.int64)
        at = np.arange(len(hashes)) + np.searchsorted(breaks, np.arange(len(hashes)), side="right")
        codes[at] = inverse + 2
        codes[-1] = END
        del inverse, at
        alphabet = len(vocabulary) + 2
        order = suffix_order(codes, alphabet)
        current = codes[order - 1].astype(np.uint32)
        smaller = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=alphabet))])
        height = max(int(alphabet - 1).bit_length(), 1)
        levels = []
        for level in range(height - 1, -1, -1):
            bit = (current >> np.uint32(level)) & np.uint32(1)
            bit = bit.view(np.uint8)[::4].astype(bool)
            levels.append(_pack(bit))
            current = np.concatenate([current[~bit], current[bit]])
        kept = order % SAMPLE == 0
        return cls(n, vocabulary, smaller, np.stack(levels), _pack(kept), (order[kept] // SAMPLE).astype(np.uint32))

    def to_bytes(self) -> bytes:
        head = np.array([self.n, len(self.vocabulary), len(self.levels), self.levels.shape[1], len(self.samples)], "<i8")
        counts = np.diff(self.smaller).astype("<u4").view(np.uint8).reshape(-1, 4).T
        return b"".join(x.tobytes() for x in (head, self.vocabulary, np.ascontiguousarray(counts), self.levels, self.marked, self.samples))

    @classmethod
    def from_bytes(cls, data: bytes) -> FMIndex:
        n, words, height, width, kept = np.frombuffer(data, "<i8", 5).tolist()
        at = 40
        vocabulary = np.frombuffer(data, "<u8", words, at)
        at += 8 * words
        counts = np.ascontiguousarray(np.frombuffer(data, np.uint8, 4 * (words + 2), at).reshape(4, -1).T).view("<u4").ravel()
        at += 4 * (words + 2)
        levels = np.frombuffer(data, np.uint8, height * width * 8, at)
        at += height * width * 8
        marked = np.frombuffer(data, np.uint8, width * 8, at)
        at += width * 8
        return cls(n, vocabulary, np.concatenate([[0], np.cumsum(counts.astype(np.int64))]), levels.view("<u8").reshape(height, width) if at % 8 == 0 else np.frombuffer(levels.tobytes(), "<u8").reshape(height, width), np.frombuffer(marked.tobytes(), "<u8"), np.frombuffer(data, "<u4", kept, at))

    def _step(self, level: int, at: np.ndarray, ones: np.ndarray) -> np.ndarray:
        """Where a place goes in the next level if its bit is one, else zero."""
        set_before = _rank(self.levels[level], self.before[level], at)
        return np.where(ones, self.zeros[level] + set_before, at - set_before)

    def find(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all phrases at once: the first row and the row after the last of each one's suffixes.

        ``phrases`` is (m, longest) word hashes, filled from the left."""
        m, longest = phrases.shape
        code = np.searchsorted(self.vocabulary, phrases)
        code = np.minimum(code, max(len(self.vocabulary) - 1, 0))
        known = (self.vocabulary[code] == phrases) if len(self.vocabulary) else np.zeros(phrases.shape, bool)
        used = np.arange(longest)[None, :] < lengths[:, None]
        low, high = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        alive = np.flatnonzero((known | ~used).all(axis=1) & (lengths > 0))
        high[(~(known | ~used)).any(axis=1) | (lengths == 0)] = 0
        height = len(self.levels)
        for back in range(longest):
            alive = alive[lengths[alive] > back]
            if not len(alive):
                break
            c = code[alive, lengths[alive] - 1 - back].astype(np.int64) + 2
            at = np.concatenate([low[alive], high[alive], np.zeros(len(alive), np.int64)])
            three = np.tile(c, 3)
            for level in range(height):
                at = self._step(level, at, (three >> (height - 1 - level)) & 1 == 1)
            lo, hi, base = at.reshape(3, -1)
            low[alive] = self.smaller[c] + lo - base
            high[alive] = self.smaller[c] + hi - base
            alive = alive[hi > lo]
        return low, np.maximum(high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, given by their rows: walk back until a sampled one."""
        out = np.zeros(len(rows), np.int64)
        open_ = np.arange(len(rows))
        at = rows.astype(np.int64)
        height = len(self.levels)
        for steps in range(SAMPLE):
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = (self.marked[word] >> bit) & np.uint64(1) == 1
            place = _rank(self.marked, self.marked_before, at[hit])
            out[open_[hit]] = self.samples[place].astype(np.int64) * SAMPLE + steps
            open_, at = open_[~hit], at[~hit]
            if not len(open_):
                break
            base, code = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            for level in range(height):
                one = (self.levels[level][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
                both = self._step(level, np.concatenate([at, base]), np.tile(one, 2))
                at, base = both.reshape(2, -1)
                code = code * 2 + one
            at = self.smaller[code] + at - base
        return out


def _pack(bits: np.ndarray) -> np.ndarray:
    data = np.packbits(bits, bitorder="little")
    return np.concatenate([data, np.zeros(-len(data) % 8 + 8, np.uint8)]).view("<u8")


def _directory(words: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])


def _rank(words: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Set bits before each place."""
    word = at >> 6
    low = words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
    return before[word] + np.bitwise_count(low).astype(np.int64)
