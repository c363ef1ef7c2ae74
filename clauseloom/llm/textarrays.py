"""Words, lines and shingles of many texts at once, as numpy arrays over the UTF-8 bytes of an Arrow column.

A word is a run of bytes other than space and ``\\t \\n \\v \\f \\r``; these are ASCII, so
words can be cut on bytes without decoding. Words and lines are identified by 64-bit
hashes that are the same in every process. Work goes in pieces of a few MB, and a piece
holds at least one whole text, so memory follows the longest text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 2_000_000
_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the splitmix64 finaliser)."""
    x = x + _STEP
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


BYTE_VALUES = mixed(np.arange(1, 257, dtype=_U))
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(n: int, known: list[np.ndarray] = [np.ones(1, _U)]) -> np.ndarray:  # noqa: B006 - grows on purpose
    """1, B, B^2, ... modulo 2^64; at least n of them."""
    have = known[0]
    base = _U(0xD6E8FEB86659FD93)
    while len(have) < n:
        have = np.concatenate([have, have * (have[-1:] * base)])
        if len(have) <= 1 << 16:
            known[0] = have
    return have


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


class Piece:
    """Some consecutive texts of a batch: ``n`` texts from text number ``first`` on."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.first, self.n = first, len(offsets) - 1
        self.data = data[offsets[0]:offsets[-1]]
        self.at = offsets - offsets[0]

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs of True bytes; a run never crosses texts."""
        if not len(inside):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        edges = self.at[1:-1]
        edges = edges[(edges > 0) & (edges < len(inside))]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        first[edges] = inside[edges]
        last[:-1] &= ~inside[1:]
        last[edges - 1] = inside[edges - 1]
        return np.flatnonzero(first), np.flatnonzero(last) + 1

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        return self.runs(~SEPARATORS[self.data])

    def texts_of(self, positions: np.ndarray) -> np.ndarray:
        """The text (0 .. n-1) that holds each byte position."""
        return np.searchsorted(self.at[1:], positions, side="right")

    def hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
        """64-bit hashes of disjoint, ordered, non-empty byte spans."""
        if not len(starts):
            return np.zeros(0, _U)
        data = LOWER[self.data] if lower else self.data
        lengths = ends - starts
        first = np.cumsum(lengths) - lengths
        within = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
        values = BYTE_VALUES[data[within + np.repeat(starts, lengths)]] * _powers(int(lengths.max()))[within]
        return mixed(np.add.reduceat(values, first) + lengths.astype(_U))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Per text, the sum of one value per byte."""
        total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return total[self.at[1:]] - total[self.at[:-1]]


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[Piece]:
    data, offsets = text_buffers(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield Piece(data, offsets[first:last + 1], first)
        first = last


def ngrams(hashes: np.ndarray, texts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first-word index of every run of n words within one text."""
    if len(hashes) < n:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    count = len(hashes) - n + 1
    out = hashes[:count].copy()
    for k in range(1, n):
        out = mixed(out * _U(3) + hashes[k:k + count])
    index = np.flatnonzero(texts[:count] == texts[n - 1:])
    return out[index], index
