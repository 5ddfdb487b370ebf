"""Words of many texts at once as 64-bit hashes, in numpy.

Texts are laid end to end with a space between. A word's hash is a polynomial over its bytes modulo 2**64, from
differences of one running sum, so that its place doesn't matter; a finaliser then mixes the bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Bytes of text that are worked on at once; a longer text is worked on alone, whole.
BLOCK = 1 << 20

_fold = np.arange(256, dtype=np.uint8)
_fold[65:91] += 32
#: Separators: white space alone, or everything in ASCII that is neither letter nor digit.
WHITE = np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True
PUNCT = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_powers = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


_caches: list[dict] = []


def cache() -> dict:
    """A dict that a stage keeps in a worker between its tasks."""
    _caches.append({})
    return _caches[-1]


def release() -> None:
    """Let go of what other stages keep: Spark's workers go on from one stage to the next."""
    for c in _caches:
        c.clear()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i below n, kept for the process."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), BLOCK + 2)
        for k, b in enumerate((BASE, INVERSE)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hashed(texts: list[bytes], breaks: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, index of each text's first word, with the end): A-Z count as a-z."""
    buf = _fold[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    out = breaks[buf]
    # ends of texts are separators even where the space would not be one
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    edge = np.flatnonzero(np.diff(np.concatenate(([True], out)).astype(np.int8)))
    starts, stops = edge[0::2], edge[1::2]
    up, down = powers(len(buf))
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64, out=total[1:])
    h = mix((total[stops] - total[starts]) * down[starts] + (stops - starts).astype(np.uint64))
    return h, np.concatenate(([0], np.searchsorted(starts, ends)))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on; the last k - 1 are missing."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * BASE + h[i : i + n]
    return mix(out)


def blocks(texts: list[bytes], size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of texts of about size bytes."""
    a = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > size:
            yield a, i
            a, total = i, 0
        total += len(t) + 1
    if a < len(texts):
        yield a, len(texts)


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct k-word shingles of each text; a shorter text has its words as one, a text without words none."""
    h, at = hashed(texts)
    g = grams(h, k)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(g[a : b - k + 1]))
        elif b > a:
            out.append(mix(grams(h[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out
