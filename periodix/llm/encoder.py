"""Byte-pair encoding of many texts in one Python worker.

The tokenizers library encodes a text unit by unit: its pre-tokenizer never
lets a token span a unit boundary (``units``).  ``UnitEncoder`` hands each
distinct unit to the library once and remembers the ids of the first ``memory``
distinct units a worker sees (a fixed bound on its size); other units are
encoded anew in each chunk of texts.  Unseen units go to the library many at a
time, as one text, and are told apart by the bytes their ids stand for; where
those do not fit, one by one.  A text that holds one of the vocabulary's special
strings is encoded as a whole, since the library cuts texts there.  The result
equals the library's default call ``encode(text, add_special_tokens=False)`` id
for id.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np

from periodix.llm.common import no_collection
from periodix.llm.units import Cut, Memory, cuts, gather

MEMORY = 1_000_000  # distinct units a worker remembers (about 37 bytes each)
JOINED = 2048       # characters of unseen units encoded in one call (one unit at least)

SIGNS = 10_000      # runs of signs remembered

# One word of letters whose kind and lower case (of one letter each; U+0130 has
# two) every Unicode version has alike, the blank before it, and ASCII signs
# behind it: such a unit has two pre-tokens at most.
_PLAIN = re.compile(r"( ?)((?:(?!\u0130)[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f])+)([!-/:-@\[-`{-~]*)\Z").match
# how a byte-level vocabulary writes bytes, given as the characters of their numbers
_VISIBLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_SHOWN = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _VISIBLE)}
# spaced units with white space at no outer end but the one sign before them
_CLEAN = re.compile(r"[ \n]\S(?:.*\S)?\Z", re.DOTALL).match


class UnitEncoder:
    """``spaced``: the vocabulary keeps white space; otherwise it drops it and
    folds letters to lower case."""

    def __init__(self, path: str, spaced: bool, memory: int = MEMORY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.spaced, self.signs = spaced, {}
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.known = Memory(self.dtype, memory)
        self.lengths = np.zeros(self.tokenizer.get_vocab_size(), np.int64)  # bytes of each entry
        for entry, k in self.tokenizer.get_vocab().items():
            self.lengths[k] = len(entry.removesuffix("</w>"))

    def _one_by_one(self, units: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes()
                for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]

    def _joined(self, units: list[str]) -> list[bytes]:
        """Codes of units that boundaries part for certain, from one call."""
        e = self.tokenizer.encode_batch_fast([("" if self.spaced else " ").join(units)], add_special_tokens=False)[0]
        ids = np.array(e.ids, self.dtype)
        sizes = [len(u) if u.isascii() else len((u if self.spaced else unicodedata.normalize("NFC", u).lower()).encode())
                 for u in units]
        ends, want = np.cumsum(self.lengths[ids]), np.cumsum(sizes)
        cut = np.searchsorted(ends, want) + 1
        if not len(ids) or cut[-1] != len(ids) or (ends[cut - 1] != want).any():
            return self._one_by_one(units)
        data, size = ids.tobytes(), self.dtype.itemsize
        edges = [0, *(cut * size).tolist()]
        return [data[a:b] for a, b in zip(edges, edges[1:])]

    def _model(self, pretoken: str) -> bytes:
        """Code of one pre-token, by the library's model alone."""
        shown = pretoken.encode().decode("latin-1").translate(_SHOWN)
        return array(self.dtype.char, [t.id for t in self.tokenizer.model.tokenize(shown)]).tobytes()

    def _new(self, units: list[bytes]) -> dict[bytes, bytes]:
        """Codes of distinct units from the library: those of one word, maybe
        with signs behind it, pre-token by pre-token, other clean ones joined."""
        out, clean, rest = {}, [], []
        for u in units:
            text = u.decode("utf-8", "surrogatepass")
            plain = _PLAIN(text)
            if plain and (plain[1] == " ") == self.spaced:
                word, signs = plain[1] + plain[2], plain[3]
                word = word if self.spaced else word.lower()
                code = self._model(word)
                if signs:
                    if signs not in self.signs:
                        if len(self.signs) >= SIGNS:
                            self.signs.clear()
                        self.signs[signs] = self._model(signs)
                    code += self.signs[signs]
                out[u] = code
            elif not self.spaced or _CLEAN(text):
                clean.append((u, text))
            else:
                rest.append((u, text))
        if rest:
            out.update(zip([u for u, _ in rest], self._one_by_one([t for _, t in rest])))
        if clean:
            step = np.cumsum([len(u) for u, _ in clean]) // JOINED
            edges = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(clean)]
            for a, b in zip(edges, edges[1:]):
                out.update(zip([u for u, _ in clean[a:b]], self._joined([t for _, t in clean[a:b]])))
        return out

    def _ids(self, cut: Cut) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units of a chunk, and how many each has."""
        at = self.known.find(cut.names)
        gaps = np.flatnonzero(at < 0)
        starts, sizes = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        starts[at >= 0], sizes[at >= 0] = self.known.starts[at[at >= 0]], self.known.sizes[at[at >= 0]]
        values = self.known.values
        if len(gaps):
            with no_collection():
                units = cut.bytes_of(gaps)
                new = self._new(units)
                codes = list(map(new.__getitem__, units))
            found = np.frombuffer(b"".join(codes), self.dtype)
            sizes[gaps] = np.array(list(map(len, codes)), np.int64) // self.dtype.itemsize
            starts[gaps] = len(values) + np.cumsum(sizes[gaps]) - sizes[gaps]
            values = np.concatenate([values, found])
            self.known.add((cut.names[0][gaps], cut.names[1][gaps]), sizes[gaps], found)
        return gather(values, starts, sizes, cut.which), sizes[cut.which]

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Each text's ids, in order."""
        whole = {k for k, t in enumerate(texts) if t and any(s in t for s in self.special)}
        done, parts = 0, []  # texts given out, and what there is of the next one

        def ids_of(k):
            if k in whole:
                return np.frombuffer(self._one_by_one([texts[k]])[0], self.dtype)
            return parts[0] if len(parts) == 1 else np.concatenate(parts or [np.zeros(0, self.dtype)])

        for owner, cut in cuts(["" if k in whole else t or "" for k, t in enumerate(texts)], self.spaced):
            ids, sizes = self._ids(cut)
            ends = np.concatenate([[0], np.cumsum(sizes)])[cut.edges].tolist()
            for k, a, b in zip(owner, ends, ends[1:]):
                if k > done:
                    yield ids_of(done)
                    done, parts = k, []
                parts.append(ids[a:b])
        if texts:
            yield ids_of(done)


_ENCODERS: dict[tuple, UnitEncoder] = {}


def encoder(path: str, spaced: bool) -> UnitEncoder:
    """The worker's encoder for a vocabulary file (workers are reused)."""
    key = (path, spaced)
    if key not in _ENCODERS:
        _ENCODERS[key] = UnitEncoder(path, spaced)
    return _ENCODERS[key]
