"""Vectorised text handling shared by the corpus operators.

Texts stay as the UTF-8 bytes of an Arrow column. A block of them (about half a
megabyte) is cut into words, lines and word n-grams with numpy, so no Python
object is made per word. All hashes are 64 bit: a polynomial over randomised
byte values for words and lines, mixed again for n-grams.

Words are runs of ``[^\\x20\\x09-\\x0D]``; lines are what lies between ``\\n``.
A null text counts as an empty one.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 19
_RNG = np.random.default_rng(20240917)
_BYTE_VALUE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_RNG.integers(1 << 62, 1 << 63)) * 4 + 1 & (1 << 64) - 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = 0x9E3779B97F4A7C15
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def series(base: int) -> np.ndarray:
        out = np.empty(n, np.uint64)
        out[0] = 1
        done = 1
        while done < n:
            more = min(done, n - done)
            out[done : done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
            done += more
        return out

    return series(_BASE), series(_BASE_INVERSE)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values; each salt gives another one."""
    x = x + np.uint64((salt * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngrams(hashes: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hash of each run of n values; shorter input gives none. Each salt has a polynomial of its own, so what two runs share under one tells nothing about the other."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:m].copy()
    step = np.uint64((_STEP + 2 * salt * 0xD1B54A32D192ED03) & (1 << 64) - 1)
    for j in range(1, n):
        out *= step
        out += hashes[j : j + m]
    return mix(out, salt + n)


class Block:
    """A few texts as bytes, with the words found in them.

    first, last: byte range of each word. doc: number of its text in the block.
    hash: its hash. doc_first: number of the first word of each text, and at the
    end the number of words.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = _LOWER[data] if lower else data
        self.offsets = offsets.astype(np.int64)
        self.docs = len(offsets) - 1
        n = len(data)
        self.word_byte = ~_IS_SPACE[self.data]
        self._sums = None
        if not n:
            self.first = self.last = self.doc = np.zeros(0, np.int64)
            self.doc_first = np.zeros(self.docs + 1, np.int64)
            self.hash = np.zeros(0, np.uint64)
            return
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        starts, ends = self.word_byte.copy(), self.word_byte.copy()
        starts[1:] &= ~self.word_byte[:-1] | edge[1:-1]
        ends[:-1] &= ~self.word_byte[1:] | edge[1:-1]
        self.first, self.last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        self.doc_first = np.searchsorted(self.first, self.offsets)
        self.doc = np.repeat(np.arange(self.docs), np.diff(self.doc_first))
        self.hash = self.span_hash(self.first, self.last)

    def span_hash(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hash of the bytes from first to last, for many spans."""
        n = len(self.data)
        size = 1 << max(12, int(n).bit_length())
        up, down = _powers(size)
        if self._sums is None:
            self._sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE_VALUE[self.data] * up[:n], out=self._sums[1:])
        return mix((self._sums[last] - self._sums[first]) * down[first] + (last - first).astype(np.uint64))

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sum over the bytes of each text."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return np.diff(total[self.offsets])

    def word_chars(self) -> np.ndarray:
        """Code points in the words of each text."""
        return self.per_doc(self.word_byte & ((self.data & 0xC0) != 0x80))

    def grams(self, n: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the first words of all n-word runs within one text, and their hashes."""
        g = ngrams(self.hash, n, salt)
        at = np.flatnonzero(self.doc[: len(g)] == self.doc[n - 1 :]) if len(g) else np.zeros(0, np.int64)
        return at, g[at]

    def shingles(self, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """(text number, hash) of distinct n-word shingles, sorted; a text with fewer words gives its whole sequence."""
        at, g = self.grams(n)
        doc = self.doc[at]
        count = np.diff(self.doc_first)
        few = np.flatnonzero((count > 0) & (count < n))
        if len(few):
            short = np.array([ngrams(self.hash[self.doc_first[d] : self.doc_first[d + 1]], int(count[d]))[0] for d in few])
            doc, g = np.concatenate([doc, few]), np.concatenate([g, short])
        order = np.lexsort((g, doc))
        doc, g = doc[order], g[order]
        keep = np.ones(len(g), bool)
        keep[1:] = (doc[1:] != doc[:-1]) | (g[1:] != g[:-1])
        return doc[keep], g[keep]

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text number, byte range and hash of each line; texts are cut at each \\n, so a text has one line more than it has \\n."""
        cut = np.flatnonzero(self.data == 10)
        first = np.sort(np.concatenate([self.offsets[:-1], cut + 1]), kind="stable")
        doc = np.repeat(np.arange(self.docs), self.per_doc(self.data == 10) + 1)
        last = np.sort(np.concatenate([self.offsets[1:], cut]), kind="stable")
        return doc, first, last, self.span_hash(first, last)

    def text(self, first: int, last: int) -> str:
        return self.data[first:last].tobytes().decode("utf-8", "replace")


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return bytes_[offs[0] : offs[-1]], offs - offs[0]


def blocks(column: pa.Array | pa.ChunkedArray, lower: bool = False, size: int = BLOCK_BYTES) -> Iterator[tuple[int, Block]]:
    """Blocks of neighbouring texts of about so many bytes, each with the row number of its first text; a longer text is a block of its own."""
    data, offs = text_buffers(column)
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
        j = min(j, n, i + 50_000)
        yield i, Block(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], lower)
        i = j
    give_back()


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Returns freed memory to the system, as a worker that waits for its next task would hold it otherwise."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def covered(starts: np.ndarray, length: int, total: int) -> np.ndarray:
    """Which of so many positions lie in a run of that length from one of the starts."""
    step = np.zeros(total + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + length, total), -1)
    return np.cumsum(step[:-1]) > 0
