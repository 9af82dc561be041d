"""Words of whole texts as numpy arrays: places, row numbers and 64-bit hashes.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D (in UTF-8 the
same as the pattern over characters).  Texts are taken from Arrow buffers in
slices of whole rows, so memory follows the slice or the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text hashed at once.
SLICE = 1 << 18

SEPARATOR = np.zeros(256, np.bool_)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII other than letters and digits.
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) mod 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE + 1), base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def spans_hash(values: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of values[start:end], whatever the place of the span."""
    n = len(values)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(base, n), out=total[1:])
    return (total[ends] - total[starts]) * powers(pow(base, -1, 1 << 64), n + 1)[starts]


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Mixed hash of each run of k words (over row borders too; mask those)."""
    at = np.arange(max(0, len(words) - k + 1))
    return mix(spans_hash(words, WORD_BASE, at, at + k))


@dataclass
class Words:
    """Words of rows lo..hi-1 of a batch, in order."""

    lo: int
    hi: int
    raw: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray

    def firsts(self) -> np.ndarray:
        """First word of each row, and the number of words at the end."""
        return np.searchsorted(self.row, np.arange(self.lo, self.hi + 1))


def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    col = pc.fill_null(col, "").cast(pa.large_string())
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), off


def _hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Word hashes, computed over pieces of about SLICE bytes that end between words."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + SLICE, "right")))
        lo, hi = start[i], end[j - 1]
        out[i:j] = spans_hash(raw[lo:hi].astype(np.uint64) + np.uint64(1), BYTE_BASE, start[i:j] - lo, end[i:j] - lo)
        i = j
    return mix(out ^ (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def words(col: pa.Array, *, lower: bool = False, separator: np.ndarray = SEPARATOR) -> Iterator[Words]:
    """Words of a string column, in slices of whole rows.  ``lower`` folds A-Z."""
    data, off = string_buffers(col)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + SLICE, "right")) - 1)
        raw, o = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        token = ~separator[raw]
        border = np.zeros(len(raw) + 1, np.bool_)
        border[o] = True
        n = len(raw)
        before, after = np.zeros(n, np.bool_), np.zeros(n, np.bool_)
        before[1:], after[:-1] = token[:-1], token[1:]
        start = np.flatnonzero(token & (~before | border[:n]))
        end = np.flatnonzero(token & (~after | border[1:])) + 1
        text = LOWER[raw] if lower else raw
        row = np.searchsorted(o, start, "right") - 1 + lo
        yield Words(lo, hi, raw, o, start, end, row, _hashes(text, start, end))
        lo = hi
    pa.default_memory_pool().release_unused()


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed k-word shingles of each row: sizes per row (lo..hi-1), and
    the hashes row by row in rising order.  Rows with fewer words have their
    whole sequence as one shingle; rows without words have none."""
    n_words = np.diff(w.firsts())
    n = len(w.hash)
    if n >= k:
        inside = w.row[: n - k + 1] == w.row[k - 1 :]
        g, row = grams(w.hash, k)[inside], w.row[: n - k + 1][inside]
    else:
        g, row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    few = np.flatnonzero((n_words > 0) & (n_words < k))
    if len(few):
        first = w.firsts()[few]
        whole = mix(spans_hash(w.hash, WORD_BASE, first, first + n_words[few]) ^ mix(n_words[few].astype(np.uint64)))
        g, row = np.r_[g, whole], np.r_[row, few + w.lo]
    order = np.lexsort((g, row))
    g, row = g[order], row[order]
    new = np.ones(len(g), np.bool_)
    new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    g, row = g[new], row[new]
    return np.bincount(row - w.lo, minlength=w.hi - w.lo), g
