"""Vectorised scanning of UTF-8 text columns: words, lines and their hashes as numpy arrays.

All classes of bytes used here are ASCII, so scanning bytes equals scanning code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Words of ``[^\x20\x09-\x0D]+``.
NON_SPACE = ~SPACE
#: Words of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
ALNUM = np.ones(256, bool)
ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE2 = 0xC2B2AE3D27D4EB4F | 1
_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), or of its inverse, modulo 2 ** 64."""
    have = _POWERS.get((base, inverse))
    if have is None or len(have) < n:
        step = pow(base, -1, 1 << 64) if inverse else base
        raw = np.full(max(n, 1 << 16), step, np.uint64)
        raw[0] = 1
        have = _POWERS[base, inverse] = np.multiply.accumulate(raw)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of an unsigned 64-bit value over all others."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Text:
    """The texts of one slice of a batch: ``data`` has all bytes, text ``i`` is ``data[at[i]:at[i + 1]]``; null texts are empty."""

    def __init__(self, column: pa.Array):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if column.null_count:
            column = column.fill_null("")
        wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
        self.data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
        self.at = at - at[0]
        self.n = len(column)

    def lowered(self) -> Text:
        out = object.__new__(Text)
        out.data, out.at, out.n = LOWER[self.data], self.at, self.n
        return out

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.at[i] : self.at[i + 1]].tobytes()

    def owner(self, positions: np.ndarray) -> np.ndarray:
        """The number of the text that each byte position is in."""
        return np.searchsorted(self.at, positions, "right") - 1

    def words(self, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends (exclusive) of the maximal runs of bytes in ``kind`` within a text."""
        inside = kind[self.data]
        if not len(inside):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edge = self.at[(self.at > 0) & (self.at < len(inside))]
        first[edge] = inside[edge]
        last[edge - 1] = inside[edge - 1]
        return np.flatnonzero(first), np.flatnonzero(last) + 1

    def sums(self, base: int = _BASE) -> np.ndarray:
        """Prefix sums from which the hash of any stretch follows by one subtraction and one product."""
        out = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers(base, len(self.data)), out=out[1:])
        return out

    def hashes(self, starts: np.ndarray, ends: np.ndarray, base: int = _BASE, sums: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each stretch, a function of its bytes alone."""
        s = self.sums(base) if sums is None else sums
        return mix((s[ends] - s[starts]) * powers(base, len(self.data) + 1, True)[starts] + (ends - starts).astype(np.uint64))

    def hashes128(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.hashes(starts, ends, _BASE), self.hashes(starts, ends, _BASE2)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and text numbers of all lines, split at newline; an empty text is one empty line."""
        breaks = np.flatnonzero(self.data == 0x0A)
        who = np.concatenate([self.owner(breaks), np.arange(self.n)])
        ends = np.concatenate([breaks, self.at[1:]])
        # a break at a byte position comes before the end of its own text
        order = np.lexsort((np.concatenate([np.zeros(len(breaks), np.int8), np.ones(self.n, np.int8)]), ends, who))
        who, ends = who[order], ends[order]
        starts = np.empty_like(ends)
        fresh = np.ones(len(ends), bool)
        fresh[1:] = who[1:] != who[:-1]
        starts[1:] = ends[:-1] + 1
        starts[fresh] = self.at[who[fresh]]
        return starts, ends, who


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that a slice has at most ``most`` bytes of text or a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = Text(batch.column(batch.schema.get_field_index(column)))
        row = 0
        while row < batch.num_rows:
            end = max(row + 1, int(np.searchsorted(text.at, text.at[row] + most, "right")) - 1)
            yield batch.slice(row, end - row)
            row = end


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def counted(who: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Occurrences (or sums of integer weights) per text, as int64."""
    return np.bincount(who, weights, n).astype(np.int64)
