"""Vectorised word splitting and hashing over Arrow string columns.

Words are the runs of bytes that a 256-entry table accepts; texts are taken whole.  Hashes are 64 bits wide: a word is a
polynomial over its bytes modulo 2**64, then mixed, so that equal words have equal hashes in every process and run.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Odd multipliers of the polynomial and of the mixer (splitmix64).
BASE, MIX1, MIX2, STEP = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93
#: Texts are handled in groups of about so many bytes, so that the temporary arrays stay small.
GROUP_BYTES = 1 << 19

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its texts; a null is an empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def groups(offsets: np.ndarray, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about limit bytes; a longer text is alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words (no word crosses texts), and the offsets of each text's words."""
    inside = ~SPACE[data]
    before = np.empty(len(data) + 1, bool)
    before[0] = False
    before[1:] = inside
    after = np.empty(len(data) + 1, bool)
    after[-1] = False
    after[:-1] = inside
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before, after = before[:-1], after[1:]
    starts_here, ends_here = inside & ~before, inside & ~after
    if len(edges):
        starts_here[edges] = inside[edges]
        ends_here[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(starts_here), np.flatnonzero(ends_here) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        m = max(n, GROUP_BYTES * 2)
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            run = np.full(m, base, U)
            run[0] = 1
            _powers[k : k + 1] = [np.cumprod(run)]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(MIX1)
    x = (x ^ (x >> U(27))) * U(MIX2)
    return x ^ (x >> U(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    p, inverse = powers(len(data) + 1)
    sums = np.empty(len(data) + 1, U)
    sums[0] = 0
    np.cumsum((data.astype(U) + U(1)) * p[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U) * U(STEP))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its width-word shingles; with fewer words its whole sequence; none without words."""
    starts, ends, at = word_bounds(data, offsets)
    words = word_hashes(data, starts, ends)
    n = len(words) - width + 1
    if n > 0:
        run = np.zeros(n, U)
        for k in range(width):
            run = run * U(BASE) + words[k : k + n]
        run = mix(run + U(width))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= width:
            s = np.sort(run[a : b - width + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            yield s[keep]
        elif b > a:
            h = U(0)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    h = h * U(BASE) + w
                yield mix(np.array([h + U(b - a)], U))
        else:
            yield np.zeros(0, U)


def ranges(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def split(key: np.ndarray, n: int, *columns: np.ndarray):
    """The columns' parts for each key that occurs."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    edges = np.searchsorted(key, np.arange(n + 1))
    columns = [c[order] for c in columns]
    for k in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
        yield k, [c[edges[k] : edges[k + 1]] for c in columns]


def joined(column: Iterable[bytes], dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype)
