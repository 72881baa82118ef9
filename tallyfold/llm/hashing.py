"""Vectorised hashes of words and word shingles over UTF-8 bytes.

Words are runs of anything but the bytes 09-0D and 20, with A-Z lower-cased.
A word's hash is a polynomial over its bytes modulo 2**64, taken from prefix
sums over the whole run of texts, then mixed; no Python object is made per
word.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def salt(*numbers: int) -> int:
    """One 64-bit value for a tuple of small integers."""
    out = U(0x1234567)
    with np.errstate(over="ignore"):
        for n in numbers:
            out = mix(np.array([out], U) * U(_BASE) + U(n & MASK))[0]
    return int(out)


_BYTE = mix(np.arange(1, 257, dtype=U) * U(_BASE))[LOWER]
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 18)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, U)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, last byte and row of every word of the rows that
    ``offsets`` cuts out of ``data``, in order."""
    n = len(data)
    inside = ~SPACE[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after)
    row = np.searchsorted(offsets, start, side="right") - 1
    return start, end, np.minimum(row, len(offsets) - 2)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the lower-cased bytes of each span."""
    n = len(data)
    up, down = _power_tables(n)
    sums = np.zeros(n + 1, U)
    np.cumsum(_BYTE[data] * up[:n], out=sums[1:])
    return mix((sums[end + 1] - sums[start]) * down[start])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word, in order."""
    start, end, row = word_spans(data, offsets)
    return span_hashes(data, start, end), row


def shingles(hashes: np.ndarray, row: np.ndarray, rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of ``k`` words within a row; a row with fewer
    words, but some, has one shingle of them all. Sorted by row."""
    counts = np.bincount(row, minlength=rows)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    factor = [U(salt(77, j)) | U(1) for j in range(k)]
    n = len(hashes)
    at = np.flatnonzero(row[: max(0, n - k + 1)] == row[k - 1 :]) if n >= k else np.zeros(0, np.int64)
    total = np.zeros(len(at), U)
    for j in range(k):
        total += hashes[at + j] * factor[j]
    out, out_row = mix(total), row[at]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        total = np.array([salt(78, int(c)) for c in counts[short]], U)
        for j in range(k - 1):
            has = counts[short] > j
            total[has] += hashes[first[short[has]] + j] * factor[j]
        out, out_row = np.concatenate([out, mix(total)]), np.concatenate([out_row, short])
        order = np.argsort(out_row, kind="stable")
        out, out_row = out[order], out_row[order]
    return out, out_row


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    rows = len(offsets) - 1
    hashes, row = shingles(*words(data, offsets), rows, k)
    cut = np.searchsorted(row, np.arange(rows + 1))
    out = []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        own = np.sort(hashes[a:b])
        if len(own) > 1:
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        out.append(own)
    return out
