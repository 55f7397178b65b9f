"""Vectorised symbol streams over Arrow batches: words, rolling hashes, winnowed anchors.

A stream is the symbols (bytes or hashed words) of several documents end to end. Hashes are
polynomials over uint64 with an odd base, so any substring's hash comes from two prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
#: Symbols handled at once; a longer document is a piece of its own.
PIECE = 1 << 20

_powers = [np.ones(1, U), np.ones(1, U)]


def _random_table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, 256, dtype=U)


_BYTES = _random_table(20250101)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i up to n."""
    if len(_powers[0]) <= n:
        for j, base in enumerate((_BASE, _INVERSE)):
            p = np.full(max(n, PIECE) + 1, U(base))
            p[0] = 1
            _powers[j] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def mix(z: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    z = z ^ (z >> U(30))
    z *= U(0xBF58476D1CE4E5B9)
    z ^= z >> U(27)
    z *= U(0x94D049BB133111EB)
    z ^= z >> U(31)
    return z


def slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """A batch in parts, so that few texts are Python strings at once."""
    return (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))


class Hashes:
    """Rolling hashes of one stream."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.pw, self.inv = powers(n)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(symbols * self.pw[:n], out=self.sums[1:])

    def at(self, start: np.ndarray, length) -> np.ndarray:
        return mix((self.sums[start + length] - self.sums[start]) * self.inv[start])

    def plain(self, start: np.ndarray, length: int) -> np.ndarray:
        """The hashes before their last mixing: the high bits are even, the low ones less so."""
        return (self.sums[start + length] - self.sums[start]) * self.inv[start]

    def run(self, length: int) -> np.ndarray:
        """plain() of all starts."""
        n = len(self.sums) - length
        return (self.sums[length:] - self.sums[:n]) * self.inv[:n] if n > 0 else np.zeros(0, U)

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:n]) * self.inv[:n]) if n > 0 else np.zeros(0, U)


def pieces(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets into them) for runs of rows of about PIECE bytes."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type)
    at = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) and at[-1] > at[0] else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(at, at[row] + PIECE, side="right")) - 1)
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[97:123] = _ALNUM[128:] = True


def lower(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z in lower case."""
    return _LOWER[data]


def word_bounds(data: np.ndarray, offsets: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, word starts, word ends, word offsets per row). kind: "space" splits on blanks;
    "alnum" lower-cases A-Z and keeps digits, letters and whatever is not ASCII. Words never cross rows."""
    if kind == "alnum":
        data = _LOWER[data]
        inside = _ALNUM[data]
    else:
        inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    if len(data) == 0:
        return data, cuts[:0], cuts[:0], np.zeros(len(offsets), np.int64)
    keep = inside[cuts[:-1]]
    starts, ends = cuts[:-1][keep], cuts[1:][keep]
    return data, starts, ends, np.searchsorted(starts, offsets, side="left")


def word_symbols(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return Hashes(_BYTES[data]).at(starts, ends - starts)


def word_bags(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word's bytes in any order: enough for feature vectors, and one sum a byte."""
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTES[data], out=sums[1:])
    return mix(sums[ends] - sums[starts])


def byte_symbols(data: np.ndarray) -> np.ndarray:
    return _BYTES[data]


def pair(a: np.ndarray, b: np.ndarray, second: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Names of pairs of names: one whose high bits count and, if asked for, a second one of 64 bits."""
    return a * U(_BASE) + b, mix(a ^ mix(b + U(_BASE))) if second else None


def stream(texts: pa.Array, kind: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, symbols, row offsets); kind: "bytes", "space" or "alnum"."""
    for row, end, data, offsets in pieces(texts):
        if kind == "bytes":
            yield row, end, byte_symbols(data), offsets
        else:
            data, starts, ends, at = word_bounds(data, offsets, kind)
            yield row, end, word_symbols(data, starts, ends), at


def winnow(grams: np.ndarray, width: int) -> np.ndarray:
    """For each run of width grams, the position of the least (the leftmost of equal ones): whole hashes are compared,
    so equal runs pick alike wherever they stand."""
    n = len(grams)
    if n < width:
        return np.zeros(0, np.int64)
    best, span = np.arange(n), 1

    def less(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(grams[b] < grams[a], b, a)  # a stands left of b

    while span * 2 <= width:
        best = less(best[:-span], best[span:])
        span *= 2
    if span < width:
        best = less(best[: len(best) - (width - span)], best[width - span :])
    return best


def windows(offsets: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which starts 0 .. n - width hold a window of one row."""
    last = np.zeros(max(0, n - width + 1), bool)
    if len(last):
        step = np.zeros(len(last) + 1, np.int32)
        a, b = offsets[:-1], offsets[1:] - width + 1
        ok = b > a
        np.add.at(step, a[ok], 1)
        np.add.at(step, b[ok], -1)
        last = np.cumsum(step[:-1]) > 0
    return last
