"""Word hashes of whole batches of texts at once, in numpy.

A word's hash is a polynomial of its bytes modulo 2^64, read off prefix sums over the
batch, and mixed.  It depends on the bytes only, so tasks and reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_R = 0x9E3779B97F4A7C15 | 1
_R_INVERSE = pow(_R, -1, 1 << 64)
#: A-Z to a-z, all other bytes as they are.
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
_IS_WORD = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
#: Bytes worked on at once; a longer text is a piece of its own.
PIECE = 1 << 20

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _powers:
        out = []
        for base in (_R, _R_INVERSE):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[size] = (out[0], out[1])
    return _powers[size]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def pieces(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Split a string array into (first row, bytes, row offsets) of about PIECE bytes; null is empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + PIECE, side="right")) - 1)
        yield row, data[ends[row]:ends[stop]], ends[row:stop + 1] - ends[row]
        row = stop


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words between white space: hashes, the words' first row positions
    (``bounds``: words of row r are bounds[r] to bounds[r + 1]), starts, ends and folded bytes."""
    low = _LOWER[data]
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = _IS_WORD[low]
    starts = inside[1:-1] & ~inside[:-2]
    first = offsets[:-1][(offsets[:-1] < len(data)) & (offsets[:-1] < offsets[1:])]
    starts[first] |= inside[1:-1][first]
    ends = inside[1:-1] & ~inside[2:]
    last = first_ends = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    ends[last] |= inside[1:-1][first_ends]
    at, to = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    power, inverse = _power_tables(max(1, len(data)))
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * power[:len(data)], out=total[1:])
    hashes = mixed((total[to] - total[at]) * inverse[at] + (to - at).astype(np.uint64))
    return hashes, np.searchsorted(at, offsets), at, to, low


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; the whole sequence if it is shorter."""
    n = len(hashes)
    k = min(size, n)
    out = np.zeros(max(1, n - k + 1), dtype=np.uint64)
    for i in range(k):
        out = mixed(out * np.uint64(0xD6E8FEB86659FD93) + hashes[i:i + len(out)] + np.uint64(i + 1))
    return out + np.uint64(k)
