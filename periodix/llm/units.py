"""Texts cut into units that a tokenizer never joins, each distinct one once.

Units of a vocabulary that drops white space are words; units of one that keeps
it start at each blank or line feed behind a character that is no ASCII white
space, and run to the next such place (a pre-tokenizer always ends a token
there).  Cutting and telling units apart is done in numpy over many texts at
once: equal units have equal pairs of 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

from periodix.llm import wordhash

CHUNK = 1 << 19  # characters cut at a time (one piece at least; some 100 bytes each while at it)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BREAK = np.zeros(256, bool)
_BREAK[[0x20, 0x0A]] = True
_OTHER = np.random.default_rng(71).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Cut:
    """The units of some texts: ``names`` (two hashes of each distinct one),
    ``which`` (the number of the distinct one, unit by unit), and ``edges`` (the
    first unit of each text, and their number)."""

    def __init__(self, texts: list[str], spaced: bool):
        parts = [t.encode("utf-8", "surrogatepass") for t in texts]
        joined = b"".join(parts)
        data = np.frombuffer(joined, np.uint8)
        limits = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        space = _SPACE[data]
        first = np.zeros(len(data) + 1, bool)
        first[limits[:-1]] = True  # of a text
        first = first[:-1]
        behind = np.concatenate([[True], space[:-1]]) if len(data) else space
        if spaced:
            starts = np.flatnonzero((_BREAK[data] & ~behind) | first)
            ends = np.append(starts[1:], len(data)) if len(starts) else starts
        else:
            starts = np.flatnonzero(~space & (behind | first))
            last = np.append(space[1:] | first[1:], True) if len(data) else space
            ends = np.flatnonzero(~space & last) + 1
        self.edges = np.searchsorted(starts, limits)
        up, down = wordhash._power(len(data) + 1)
        sizes = (ends - starts).astype(np.uint64)
        names = [wordhash.mix(self._ranges(table[data] * up[:len(data)], starts, ends) * down[starts] + sizes)
                 for table in (wordhash._BYTE, _OTHER)]
        self.which, _ = pd.factorize(names[0])
        n = int(self.which.max()) + 1 if len(starts) else 0
        at = np.zeros(n, np.int64)
        at[self.which[::-1]] = np.arange(len(starts) - 1, -1, -1)  # the first unit of each name
        if (names[1][at][self.which] != names[1]).any():  # equal by one hash only
            pair = np.stack(names, axis=1)
            _, at, self.which = np.unique(pair, axis=0, return_index=True, return_inverse=True)
            self.which = self.which.ravel()
        self.names = names[0][at], names[1][at]
        self.joined, self.starts, self.ends = joined, starts[at], ends[at]

    def bytes_of(self, numbers: np.ndarray | slice = slice(None)) -> list[bytes]:
        """The bytes of distinct units."""
        return [self.joined[a:b] for a, b in zip(self.starts[numbers].tolist(), self.ends[numbers].tolist())]

    @staticmethod
    def _ranges(terms: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(terms) + 1, np.uint64)
        np.cumsum(terms, out=sums[1:])
        return sums[ends] - sums[starts]


def pieces(text: str, most: int = CHUNK) -> Iterator[str]:
    """``text`` in pieces of about ``most`` characters, cut before a blank
    behind a character that is no white space."""
    at = 0
    while len(text) - at > most:
        cut = at + most
        while True:
            cut = text.find(" ", cut)
            if cut < 0 or not text[cut - 1].isspace():
                break
            cut += 1
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def cuts(texts: list[str], spaced: bool, most: int | None = None) -> Iterator[tuple[list[int], Cut]]:
    """Chunks of texts of about ``most`` characters (``CHUNK``): the number of
    the text behind each piece of the chunk, in order, and their units."""
    most = most or CHUNK
    owner, held, size = [], [], 0
    for k, text in enumerate(texts):
        for piece in pieces(text, most):
            owner.append(k)
            held.append(piece)
            size += len(piece)
            if size >= most:
                yield owner, Cut(held, spaced)
                owner, held, size = [], [], 0
    if held:
        yield owner, Cut(held, spaced)


def gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The ranges ``starts, sizes`` of ``values``, one after the other in the order ``which``."""
    n = sizes[which]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.arange(total) + np.repeat(starts[which] - ends + n, n)]


class Memory:
    """What is known of the first ``most`` distinct units: a run of values
    each, under the unit's two hashes, in sorted arrays (some thirty bytes a unit)."""

    def __init__(self, dtype: np.dtype, most: int):
        self.most = most
        self.names, self.others = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.values = np.zeros(0, dtype)

    def __len__(self) -> int:
        return len(self.names)

    def find(self, names: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """The place of each unit, -1 for those that are not known."""
        if not len(self.names):
            return np.full(len(names[0]), -1)
        order = np.argsort(names[0])  # neighbouring searches touch neighbouring places
        at = np.empty(len(order), np.int64)
        at[order] = np.searchsorted(self.names, names[0][order])
        at[at == len(self.names)] = 0
        return np.where((self.names[at] == names[0]) & (self.others[at] == names[1]), at, -1)

    def add(self, names: tuple[np.ndarray, np.ndarray], sizes: np.ndarray, values: np.ndarray) -> None:
        """Remembers units that ``find`` did not know, as far as there is room."""
        n = max(0, min(len(names[0]), self.most - len(self.names)))
        if not n:
            return
        sizes = sizes[:n]
        starts = len(self.values) + np.cumsum(sizes) - sizes
        self.values = np.concatenate([self.values, values[:int(sizes.sum())]])
        order = np.argsort(names[0][:n], kind="stable")
        at = np.searchsorted(self.names, names[0][:n][order])
        for field, new in (("names", names[0]), ("others", names[1]), ("starts", starts), ("sizes", sizes)):
            old = getattr(self, field)
            setattr(self, field, np.insert(old, at, new[:n][order].astype(old.dtype)))
