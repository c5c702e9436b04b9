"""Hashes of the words and word windows of many texts at once, in numpy.

Words are runs of bytes other than blank and 0x09 to 0x0D (all ASCII, so
bytes of UTF-8 serve), A to Z in lower case.  A word's 64-bit hash is a
polynomial over random byte values modulo 2^64, taken from prefix sums, so a
buffer of texts costs a few vector operations whatever its words are.  With
``plain`` a word has letters, digits and bytes above 0x7F only, and all letters
are in lower case."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK = 1 << 20  # bytes hashed at a time (one text at least)

_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RANDOM.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_GAP = np.ones(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = False
_PLAIN = np.array([c > 127 or chr(c).isalnum() for c in range(256)])
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit (the one of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def words(texts: list[str | None], plain: bool = False) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Word hashes of each text: yields the number of the first text of a
    chunk and one array per text."""
    chunk, size, first = [], 0, 0
    for k, text in enumerate(texts):
        text = (text or "").lower() if plain else text or ""
        data = text.encode("utf-8", "surrogatepass").lower()  # bytes: ASCII only
        chunk.append(data)
        size += len(data) + 1
        if size >= CHUNK:
            yield first, _words(chunk, plain)
            chunk, size, first = [], 0, k + 1
    if chunk:
        yield first, _words(chunk, plain)


def _words(chunk: list[bytes], plain: bool) -> list[np.ndarray]:
    data = np.frombuffer(b"\n".join(chunk) + b"\n", np.uint8)
    inside = (_PLAIN if plain else _GAP)[data]
    edge = np.flatnonzero(np.diff(np.r_[False, inside].astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    up, down = _power(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up, out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    limits = np.cumsum([len(c) + 1 for c in chunk])
    return np.split(hashes, np.searchsorted(starts, limits[:-1]))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every window of ``size`` words; with fewer words, of all of
    them as one window; of no word, nothing."""
    n = min(size, len(hashes))
    if not n:
        return hashes
    out = np.full(len(hashes) - n + 1, n, np.uint64)
    for k in range(n):
        out += hashes[k:len(hashes) - n + 1 + k] * _PLACE[k]
    return mix(out)
