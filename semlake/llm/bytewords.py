"""Words and their 64-bit hashes in Arrow string columns, with NumPy over the UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once (a longer text is worked on alone).
SLICE = 1 << 19

ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
#: Space and 0x09-0x0D.
IS_WHITE = np.zeros(256, bool)
IS_WHITE[[32, *range(9, 14)]] = True
#: All ASCII but letters and digits.
IS_GAP = np.zeros(256, bool)
IS_GAP[[i for i in range(128) if not chr(i).isalnum()]] = True

_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of the 64-bit numbers (xor-shifts and odd multipliers)."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them and their end); null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = "int64" if pa.types.is_large_string(column.type) else "int32"
    offsets = np.frombuffer(column.buffers()[1], wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row, n = 0, len(column)
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE, "right")) - 1)
        end = min(end, n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """_ODD to the powers 0..n-1, modulo 2**64."""
    global _POWERS
    while len(_POWERS) < n:
        _POWERS = np.concatenate([_POWERS, _POWERS * (_POWERS[-1:] * _ODD)])
    return _POWERS


def words(data: np.ndarray, offsets: np.ndarray, is_gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of the words, and of each row the number of its first word (and the end).
    A word ends with its row."""
    inside = ~is_gap[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    borders = offsets[1:-1]
    borders = borders[(borders > 0) & (borders < len(data))]
    first[borders] = inside[borders]
    last[borders - 1] = inside[borders - 1]
    starts = np.flatnonzero(first)
    lengths = np.flatnonzero(last) - starts + 1
    return starts, lengths, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash of each word's bytes: a polynomial of random byte values, then mixed with the length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    ends = np.cumsum(lengths)
    place = np.arange(int(ends[-1])) - np.repeat(ends - lengths, lengths)
    terms = _BYTES[data[np.repeat(starts, lengths) + place]] * powers(int(lengths.max()))[place]
    return mix(np.add.reduceat(terms, ends - lengths) + lengths.astype(np.uint64))
