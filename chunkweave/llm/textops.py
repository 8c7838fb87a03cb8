"""Vectorised word arithmetic over Arrow string columns.

Everything here works on the raw UTF-8 buffer of a batch: no Python string is
made per word.  A word is a maximal run of bytes outside space and 0x09-0x0D
(those separators are single bytes in UTF-8, so byte runs are also code-point
runs).  Identity is a 64-bit multilinear hash: each byte's random number times
that of its position, summed and finished by a mixer.  Unlike a polynomial
modulo 2**64 it has no family of strings that collide whatever the numbers are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
CHUNK_BYTES = 1 << 19


def _table(fold: bool) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(20240229))
    t = rng.integers(1, 1 << 63, size=256, dtype=np.uint64)
    if fold:
        t[0x41:0x5B] = t[0x61:0x7B]
    return t


_FOLDED, _EXACT = _table(True), _table(False)
def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (the public splitmix64 constants)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_MULTIPLIERS: dict[int, np.ndarray] = {}


def _multipliers(n: int, salt: int) -> np.ndarray:
    """At least n odd random numbers, one per position."""
    have = _MULTIPLIERS.get(salt)
    if have is not None and len(have) >= n:
        return have
    made = mix(np.arange(1, (1 << (n - 1).bit_length()) + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(salt)) | U64(1)
    if len(made) <= 1 << 20:  # those for longer spans aren't kept
        _MULTIPLIERS[salt] = made
    return made


def span_hashes(body: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool = False, salt: int = 0) -> np.ndarray:
    """64-bit hash of each (non-empty) span of bytes; fold: A-Z count as a-z; each salt is a hash of its own."""
    if not len(start):
        return np.zeros(0, U64)
    size = end - start
    upto = np.cumsum(size)
    first = upto - size
    place = np.arange(upto[-1]) - np.repeat(first, size)
    value = (_FOLDED if fold else _EXACT)[body[np.repeat(start, size) + place]] * _multipliers(int(size.max()), salt)[place]
    return mix(np.add.reduceat(value, first) + size.astype(U64) * U64(0xD6E8FEB86659FD93))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null texts count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    if off is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, offsets - offsets[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole rows near `limit` bytes.

    A row longer than the limit is a run of its own: texts are never cut.
    """
    body, offsets = buffers(column)
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        b = min(b, n)
        yield a, b, body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


class Words:
    """The words of a run of texts: start, end (bytes), row of each, and per-row bounds."""

    def __init__(self, body: np.ndarray, offsets: np.ndarray):
        n = len(body)
        solid = ~_SPACE[body]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], before[1:] = True, ~solid[:-1]
            before |= edge[:n]
            after[-1], after[:-1] = True, ~solid[1:]
            after |= edge[1:]
        self.body, self.offsets = body, offsets
        self.start = np.flatnonzero(solid & before)
        self.end = np.flatnonzero(solid & after) + 1
        self.bounds = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.bounds)

    def hashes(self, fold: bool, salt: int = 0) -> np.ndarray:
        """64-bit hash of each word; fold: A-Z count as a-z."""
        return span_hashes(self.body, self.start, self.end, fold, salt)


def windows(words: np.ndarray, bounds: np.ndarray, size: int, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words inside rows, with row bounds.

    whole: a row of 1 to size-1 words gives one hash of its whole sequence.
    """
    count = np.diff(bounds)
    n = len(words)
    factors = [U64(pow(0xC2B2AE3D27D4EB4F | 1, k + 1, 1 << 64)) for k in range(size)]
    per_row = np.maximum(count - size + 1, 0)
    out_bounds = np.concatenate(([0], np.cumsum(per_row)))
    if n >= size:
        acc = words[: n - size + 1] * factors[0]
        for k in range(1, size):
            acc = acc + words[k : n - size + 1 + k] * factors[k]
        first = np.repeat(bounds[:-1] - out_bounds[:-1], per_row) + np.arange(out_bounds[-1])
        full = mix(acc[first])
    else:
        full = np.zeros(0, U64)
    if not whole:
        return full, out_bounds
    short = np.flatnonzero((count > 0) & (count < size))
    if not len(short):
        return full, out_bounds
    tail = np.zeros(len(short), U64)
    for j, row in enumerate(short):
        h = U64(int(count[row]))
        for k, w in enumerate(words[bounds[row] : bounds[row + 1]]):
            with np.errstate(over="ignore"):
                h = h * factors[0] + w * factors[k]
        tail[j] = h
    out = np.insert(full, out_bounds[short], mix(tail))
    per_row = per_row.copy()
    per_row[short] = 1
    return out, np.concatenate(([0], np.cumsum(per_row)))
