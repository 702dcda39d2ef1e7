"""Words of whole texts as numpy arrays, for work inside Arrow tasks.

Texts stay UTF-8 bytes from Arrow's buffers on: every separator of both word
rules is one ASCII byte and no byte of a longer character is one, so a word is
a run of non-separator bytes. Lower-casing touches A-Z only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that one numpy pass handles at most, unless one text is longer.
SLICE_BYTES = 1 << 20

# The separators of the two word rules.
BLANKS = [0x20, *range(0x09, 0x0E)]
NOT_ALNUM = [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def _byte_codes() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * MULTIPLIER)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; one to one."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_table(separators: list[int]) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    table[separators] = False
    return table


BLANK_WORDS = word_table(BLANKS)
ALNUM_WORDS = word_table(NOT_ALNUM)


def text_slices(
    batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with at most ``limit`` text bytes."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offsets of its rows; a null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)
    offsets = offsets[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Words of a run of texts: row, start, end (bytes) and 64-bit code of each."""

    def __init__(self, column: pa.Array, table: np.ndarray, lower: bool = True):
        data, self.offsets = text_bytes(column)
        self.data = _LOWER[data] if lower else data
        self.rows = len(column)
        inside = table[self.data]
        n = len(inside)
        edges = self.offsets[:-1][self.offsets[:-1] < n]
        starts = inside.copy()
        starts[1:] &= ~inside[:-1]
        starts[edges] = inside[edges]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        last = edges[edges > 0] - 1
        ends[last] = inside[last]
        self.starts = np.flatnonzero(starts)
        self.ends = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, self.offsets)  # first word of each row
        self.row = np.repeat(np.arange(self.rows), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.starts)

    def codes(self) -> np.ndarray:
        """Hash of each word: a polynomial of its bytes modulo 2**64, mixed."""
        if not len(self):
            return np.zeros(0, np.uint64)
        n = len(self.data)
        power = _powers(_BASE, n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[self.data] * power, out=total[1:])
        inverse = _powers(_BASE_INVERSE, n)
        length = (self.ends - self.starts).astype(np.uint64)
        value = (total[self.ends] - total[self.starts]) * inverse[self.starts]
        return mix(value + length * MULTIPLIER)


_BYTES = _byte_codes()
_kept: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept for the next slice up to its usual size."""
    have = _kept.get(base)
    if have is None or len(have) < n:
        size = max(n, 1024)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if size <= SLICE_BYTES:
            _kept[base] = have
    return have[:n]


def windows(codes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` codes, at its first place."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(width):
        h = h * MULTIPLIER + codes[j : j + n]
    return mix(h + np.uint64(width))


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words of each row, and each row's first one.

    A row with fewer words, but not none, has its whole sequence as the only one.
    """
    codes = words.codes()
    counts = np.diff(words.first)
    short = (counts > 0) & (counts < width)
    per_row = np.where(short, 1, np.maximum(counts - width + 1, 0))
    first = np.concatenate([[0], np.cumsum(per_row)])
    out = np.zeros(first[-1], np.uint64)
    whole = windows(codes, width)
    long_rows = counts >= width
    at = np.repeat(words.first[:-1][long_rows] - first[:-1][long_rows], per_row[long_rows])
    places = np.flatnonzero(np.repeat(~short, per_row))
    out[places] = whole[places + at]
    for m in range(1, width):
        rows = np.flatnonzero(counts == m)
        if len(rows):
            begin = words.first[rows]
            h = np.zeros(len(rows), np.uint64)
            for j in range(m):
                h = h * MULTIPLIER + codes[begin + j]
            out[first[rows]] = mix(h + np.uint64(m))
    return out, first
