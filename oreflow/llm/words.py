"""Vectorised word kernel shared by the Arrow-backed operators.

A word is a maximal run of bytes outside ``\\x20 \\x09-\\x0D``.  The kernel works
on the UTF-8 buffer of a whole Arrow batch at once, so a batch costs a fixed
number of numpy passes and no Python object per word.  Words are identified by a
64-bit hash; the probability that two different words of one corpus collide is
about ``distinct**2 / 2**65``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """Words of a batch: byte spans, hashes, and the first word of each document.

    ``first`` has one entry more than there are documents; document ``i`` owns the
    words ``first[i]:first[i+1]``.
    """

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """64-bit hash of every word, from eight bytes at a time."""
        size = self.end - self.start
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        chunk = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded.data, strides=(1,))
        out = mix(chunk[self.start] & _MASK[np.minimum(size, 8)] ^ size.astype(np.uint64) * _STEP)
        at, rest = np.flatnonzero(size > 8), 8
        while len(at):
            left = np.minimum(size[at] - rest, 8)
            out[at] = mix(out[at] * _STEP ^ chunk[self.start[at] + rest] & _MASK[left])
            rest += 8
            at = at[size[at] > rest]
        return out

    def grams(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each position; whether these lie in one document."""
        n = len(hashes)
        if n < k:
            return np.zeros(n, np.uint64), np.zeros(n, bool)
        out = hashes[: n - k + 1] * _STEP
        for j in range(1, k):
            out = (out ^ (out >> np.uint64(29))) * _M1 + hashes[j : n - k + 1 + j]
        out = np.concatenate([mix(out), np.zeros(k - 1, np.uint64)])
        ends = np.repeat(self.first[1:], self.counts)
        return out, np.arange(n) + k <= ends


def texts_of(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """One contiguous large_string array, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    return column.cast(pa.large_string()).fill_null("")


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one after the other, and the offset of each."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def words(texts: pa.Array, lower: bool = False) -> Words:
    """Word spans of every text, A-Z lower-cased if asked."""
    data, offsets = buffer_of(texts)
    data = _LOWER[data] if lower else data
    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True  # a document's first byte begins a word whatever stands before it
    before = edge[:-1].copy()
    before[1:] |= space[:-1]
    after = edge[1:].copy()
    after[:-1] |= space[1:]
    start = np.flatnonzero(~space & before)
    end = np.flatnonzero(~space & after) + 1
    return Words(data, start, end, np.searchsorted(start, offsets))


def pieces(table: pa.Table | pa.RecordBatch, column: str = "text", most: int = 4 << 20) -> Iterator[pa.Table | pa.RecordBatch]:
    """The table's rows in order, cut so that a piece holds about ``most`` bytes of text (one row at least)."""
    if table.num_rows == 0:
        return
    import pyarrow.compute as pc

    size = pc.binary_length(table.column(column)).fill_null(0)
    total = np.cumsum(size.to_numpy(zero_copy_only=False) if isinstance(size, pa.Array) else size.to_numpy())
    at = 0
    while at < table.num_rows:
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + most, side="right")))
        yield table.slice(at, to - at)
        at = to
