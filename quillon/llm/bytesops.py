"""Vectorised work on whole texts inside an Arrow batch: word spans, word hashes, shingle sets.

Texts are handled as UTF-8 bytes in groups of bounded size, so that a worker's memory doesn't
depend on the batch; a single text larger than the bound makes a group of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

GROUP_BYTES = 1 << 20
U64 = np.uint64

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)
_BASE = int(_rng.integers(1 << 40, 1 << 62)) | 5
_INV = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: by byte, after lower-casing A-Z: part of a word between blanks; part of an alphanumeric word
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[32, 9, 10, 11, 12, 13]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, n at least; kept only up to a group's size."""
    if len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    out = []
    for base in (_BASE, _INV):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    if n <= 2 * GROUP_BYTES + 2:
        _powers[:] = out
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array, and its offsets; null is empty."""
    a = texts.fill_null("").cast(pa.large_binary())
    offs = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    data = np.frombuffer(a.buffers()[2], np.uint8) if len(a) and a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offs


def groups(offs: np.ndarray, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of at most limit bytes, or one text."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def spans(buf: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of the texts buf[offs[i]:offs[i + 1]], and the number of words of each text."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs) - 1, np.int64)
    m = is_word[_LOWER][buf]
    before = np.empty_like(m)
    before[0], before[1:] = False, m[:-1]
    edge = offs[:-1]
    before[edge[edge < len(buf)]] = False
    starts = np.flatnonzero(m & ~before)
    after = np.empty_like(m)
    after[-1], after[:-1] = False, m[1:]
    edge = offs[1:] - 1
    after[edge[edge >= 0]] = False
    ends = np.flatnonzero(m & ~after) + 1
    counts = np.diff(np.searchsorted(starts, offs))
    return starts, ends, counts


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the lower-cased spans, equal for equal bytes wherever they stand."""
    p, q = _power(len(buf) + 1)
    h = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[buf]] * p[: len(buf)], out=h[1:])
    return mix((h[ends] - h[starts]) * q[starts] + (ends - starts).astype(np.uint64) * U64(0x9E3779B97F4A7C15))


def word_hash(word: str) -> int:
    b = np.frombuffer(word.encode(), np.uint8)
    return int(hashes(b, np.zeros(1, np.int64), np.array([len(b)]))[0])


def shingle_sets(buf: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """For each text the sorted hashes of its distinct two-word shingles; of its one word; or nothing."""
    starts, ends, counts = spans(buf, offs, NOT_BLANK)
    w = hashes(buf, starts, ends)
    pair = mix(w[:-1] * U64(0xC2B2AE3D27D4EB4F) + (w[1:] ^ U64(0x165667B19E3779F9))) if len(w) > 1 else np.zeros(0, np.uint64)
    at = np.concatenate([[0], np.cumsum(counts)])
    out = []
    for i, n in enumerate(counts):
        s = at[i]
        out.append(np.unique(pair[s : s + n - 1]) if n > 1 else mix(w[s : s + n] ^ U64(0x27D4EB2F165667C5)))
    return out
