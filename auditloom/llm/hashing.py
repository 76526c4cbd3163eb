"""Hashes of words and of ranges of words, for many texts at once: numpy only, no step for each word.

Words are lower-cased and parted by ASCII white space. A range's hash is a polynomial over its elements, read off prefix
sums modulo 2^64, and mixed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLANK = np.isin(np.arange(256), [32, *range(9, 14)])
#: Odd, so that its powers have inverses modulo 2^64.
BASE = 0x9E3779B97F4A7C15
#: Bytes that are hashed at once.
STRETCH = 1 << 18


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse."""
    if len(_POWERS[0]) < n:
        k = np.arange(1 << (n - 1).bit_length()) if n > 1 else np.arange(1)
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.cumprod(np.where(k == 0, np.uint64(1), np.uint64(b))) for b in (BASE, pow(BASE, -1, 1 << 64))]
    return _POWERS[0][:n], _POWERS[1][:n]


_POWERS: list[np.ndarray] = [np.empty(0, np.uint64)] * 2


def ranges_hashed(x: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """A hash of the elements of x in each range [a, z), by prefix sums."""
    power, back = powers(max(1, len(x)))
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * power[: len(x)])])
        h = (sums[z] - sums[a]) * back[a] + (z - a).astype(np.uint64)
        for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            h = (h ^ h >> np.uint64(33)) * np.uint64(m)
    return h ^ h >> np.uint64(33)


def rolled(x: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k neighbouring elements."""
    a = np.arange(max(0, len(x) - k + 1))
    return ranges_hashed(x, a, a + k)


def word_hashes(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, and each text's number of words.

    Works through the bytes in stretches of ``STRETCH`` that end between words, so a long text needs no more memory a stretch.
    """
    raw = [(t or "").lower().encode() for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    found, starts, at = [], [], 0
    while at < len(data):
        z = min(len(data), at + STRETCH)
        while not BLANK[data[z - 1]]:
            z += 1
        part = data[at:z]
        edge = np.diff(BLANK[part].view(np.int8), prepend=np.int8(1))
        a, e = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        found.append(ranges_hashed(part.astype(np.uint64) + np.uint64(1), a, e))
        starts.append(a + at)
        at = z
    ends = np.cumsum([len(r) + 1 for r in raw])
    return np.concatenate(found), np.diff(np.searchsorted(np.concatenate(starts), ends), prepend=0)


def groups(texts: pa.Array, most: int = 1 << 20):
    """Ranges of rows whose texts hold about so many bytes."""
    first, held = 0, 0
    for i in range(len(texts)):
        held += len(texts[i].as_buffer()) if texts[i].is_valid else 0
        if held >= most or i == len(texts) - 1:
            yield first, i + 1
            first, held = i + 1, 0
