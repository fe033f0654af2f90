"""Words and rolling hashes over Arrow batches of texts, as whole-array numpy work.

Texts of a batch stay in Arrow's one byte buffer. A word's hash is taken from prefix sums of a
polynomial over the bytes, so that its cost doesn't depend on the word's length.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_SEEDED = np.random.Generator(np.random.PCG64(20240607))
BYTE = _SEEDED.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BASE, INVERSE = U(0x9E3779B97F4A7C15), U(pow(0x9E3779B97F4A7C15, -1, 2**64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Byte classes: white space that parts words, and every byte that parts words of letters and digits.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def give_back() -> None:
    """Returns freed memory to the system: a worker is kept for other tasks, and would hold the most that it ever took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0 to n."""
    if len(_POWERS[0]) <= n:
        size = max(n + 1, 1 << 20)
        for k, base in enumerate((BASE, INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][: n + 1], _POWERS[1][: n + 1]


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """Sums s with s[j] - s[i] = hash of buf[i:j] times BASE**i."""
    up, _ = powers(len(buf))
    out = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(BYTE[buf] * up[:-1], out=out[1:])
    return out


def value_sums(h: np.ndarray) -> np.ndarray:
    """The same sums over 64-bit values."""
    up, _ = powers(len(h))
    out = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * up[:-1], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of buf[start:end], equal for equal bytes wherever they stand."""
    _, down = powers(len(sums) - 1)
    return mix((sums[end] - sums[start]) * down[start])


def pieces(batch: pa.RecordBatch, text: str = "text", limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Parts of a batch: (first row, row after the last, bytes, offsets of the rows in them).

    A part holds about ``limit`` bytes, or one text if that is longer. Null texts are empty.
    """
    col = batch.column(batch.schema.get_field_index(text))
    col = col.cast(pa.large_string()).fill_null("")
    n = len(col)
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + n + 1] if n else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(col.buffers()[2] or b"", dtype=np.uint8) if n else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def words(buf: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes in class ``inside``), and the first word of each row.

    The third array has one entry more than there are rows: row r has words first[r] to first[r + 1].
    """
    m = inside[buf]
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[off] = True
    before = np.zeros(len(buf), dtype=bool)
    before[1:] = m[:-1]
    start = np.flatnonzero(m & (~before | edge[:-1]))
    after = np.zeros(len(buf), dtype=bool)
    after[:-1] = m[1:]
    end = np.flatnonzero(m & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, off)


def word_hashes(buf: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all rows, and the first word of each row."""
    low = LOWER[buf]
    start, end, first = words(low, off, inside)
    return span_hash(prefix_sums(low), start, end), first


def chained(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive values of h (len(h) - k + 1 of them)."""
    n = max(0, len(h) - k + 1)
    out = np.full(n, U(k * int(BASE) % 2**64), dtype=np.uint64)
    for i in range(k):
        out = mix(out * U(0xD6E8FEB86659FD93) + h[i : i + n])
    return out


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """The sorted distinct k-word shingles of one text's word hashes; a shorter text is one shingle."""
    if not len(h):
        return np.zeros(0, dtype=np.uint64)
    return np.unique(chained(h, min(k, len(h))))
