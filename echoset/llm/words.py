"""Words of many texts at once: numpy over the UTF-8 bytes of an Arrow batch.

Texts are never turned into Python strings: a table maps every byte to its
lower-case form or to "not in a word", runs of word bytes are the words, and
each word's 64-bit hash comes from prefix sums of a polynomial. Bytes of
characters beyond ASCII are never below 0x80, so a rule that treats all of them
alike can be applied byte by byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 21  # bytes hashed at once (memory of a task)
ROWS_BYTES = 1 << 22  # bytes of text handled at once
_P = 0x9E3779B97F4A7C55  # odd, so that it has an inverse modulo 2**64
_Q = np.uint64(0xD6E8FEB86659FD93)


def word_table(is_word) -> np.ndarray:
    """256 entries: the lower-case byte (A-Z only) if it belongs to words, else 0."""
    table = np.zeros(256, np.uint8)
    for b in range(256):
        low = b + 32 if 65 <= b <= 90 else b
        if is_word(low):
            table[b] = low
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POW = [_powers(1, _P), _powers(1, pow(_P, -1, 1 << 64))]


def _pow(n: int) -> list[np.ndarray]:
    if len(_POW[0]) < n:
        _POW[:] = [_powers(max(n, BLOCK), _P), _powers(max(n, BLOCK), pow(_P, -1, 1 << 64))]
    return _POW


class Words:
    """Words of a run of texts: byte ``start`` and ``end``, ``hash``, and ``first``.

    ``first[i]`` is the number of the first word of text i (one more entry at
    the end); ``data`` are the texts' bytes, to which start and end refer.
    """

    def __init__(self, texts: pa.Array, table: np.ndarray, hashed: bool = True):
        texts = pc.fill_null(texts, "")
        wide = pa.types.is_large_string(texts.type)
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
        self.data, self.table = data[at[0]:at[-1]], table
        bounds = at - at[0]
        parts = []
        lo, n = 0, len(self.data)
        while lo < n:
            hi = self._block_end(lo, min(n, lo + BLOCK), n)
            parts.append(self._block(lo, hi, bounds, hashed))
            lo = hi
        self.start, self.end, self.hash = (
            [np.concatenate(x) for x in zip(*parts)] if parts
            else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)]
        )
        self.first = np.searchsorted(self.start, bounds)
        self.bounds = bounds

    def _block_end(self, lo: int, hi: int, n: int) -> int:
        """The last place up to hi where no word is cut, or the next one after it."""
        if hi == n:
            return n
        gap = np.flatnonzero(self.table[self.data[lo:hi]] == 0)
        if len(gap):
            return lo + int(gap[-1]) + 1
        while hi < n:
            gap = np.flatnonzero(self.table[self.data[hi:hi + BLOCK]] == 0)
            if len(gap):
                return hi + int(gap[0]) + 1
            hi = min(n, hi + BLOCK)
        return n

    def _block(self, lo: int, hi: int, bounds: np.ndarray, hashed: bool):
        low = self.table[self.data[lo:hi]]
        word = low != 0
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        inner = bounds[np.searchsorted(bounds, lo):np.searchsorted(bounds, hi)] - lo
        begins[inner] |= word[inner]
        stops = word.copy()
        stops[:-1] &= ~word[1:]
        before = inner[inner > 0] - 1
        stops[before] |= word[before]
        s, e = np.flatnonzero(begins), np.flatnonzero(stops)
        if not hashed:
            return s + lo, e + 1 + lo, np.empty(0, np.uint64)
        powers, inverse = _pow(len(low))
        total = np.cumsum(low * powers[:len(low)], dtype=np.uint64)
        h = (total[e] - total[s] + low[s] * powers[s]) * inverse[s]
        return s + lo, e + 1 + lo, mix(h)

    def text(self, i: int, n: int) -> bytes:
        """n words from number i on, lower-case, joined by spaces."""
        return b" ".join(self.table[self.data[s:e]].tobytes() for s, e in zip(self.start[i:i + n], self.end[i:i + n]))

    def grams(self, k: int) -> np.ndarray:
        """Hashes of all runs of k words (runs over two texts included; see ``whole``)."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        g = np.zeros(n, np.uint64)
        for j in range(k):
            g = g * _Q + self.hash[j:j + n]
        return mix(g + np.uint64(k))

    def whole(self, n: int) -> np.ndarray:
        """For each run of n words, whether it lies in one text."""
        count = max(0, len(self.start) - n + 1)
        ends = np.repeat(self.first[1:], np.diff(self.first))[:count]
        return np.arange(count) + n <= ends


def slices(texts: pa.Array, limit: int = ROWS_BYTES):
    """(from row, to row) of runs of about ``limit`` bytes of text; a longer text is alone."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    lo = held = 0
    for i, size in enumerate(sizes):
        if i > lo and held + size > limit:
            yield lo, i
            lo, held = i, 0
        held += size
    if lo < len(sizes):
        yield lo, len(sizes)
