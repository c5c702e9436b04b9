"""Operator 13: alignment of two tokenizers by interval coalescing.

Tokens of A (byte-level pieces) and of B (sentence pieces with byte fallback)
are byte intervals of the same text.  ``coalesce`` sorts the intervals of both
by start, runs the maximum of their ends over them, and breaks a group where a
start reaches that maximum; inside the groups, tokens of A and B that overlap
are pairs.  A *link* is a pair whose intervals end together.

Texts are cut into units at places where tokens of both vocabularies end for
certain (before a blank or line feed behind a character that is no white space:
no piece of either spans it).  Each distinct unit is encoded and
aligned once and remembered, the first ``memory`` of a worker (a fixed bound);
unseen units are encoded many at a time and told apart by their bytes.

1. ``alignments`` writes one row per document: its counts, groups, and links as
   packed id pairs.
2. ``pair_counts`` adds up the links of every id pair over all documents.  Two
   intervals that end together are suffixes one of the other, so the pairs that
   can occur are at most the suffixes of the entries of both vocabularies
   (``pair_bound``: some hundred thousand, whatever the data); they are added up
   per task, then on Spark, and broadcast.
3. ``summaries`` looks every link of every document up.

Defined results: a text that is null, empty, or not restored byte for byte by
both vocabularies (one that holds U+2581) has no tokens: zeros, and '' for its
groups.  A null id is kept; repeated rows are separate documents and count
each; an empty table gives no rows.  Extra input columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from periodix.llm.common import no_collection, prepare, shared_folder, table
from periodix.llm.units import cuts, gather

MEMORY = 500_000     # distinct units a worker remembers (about 350 bytes each)
CHUNK = 1 << 21      # characters cut at a time
JOINED = 2048        # characters of unseen units encoded in one call (one unit at least)
CALLS = 16           # such calls aligned in one step
ROW = ("doc_id LONG, n_a LONG, n_b LONG, n_groups LONG, n_links LONG, groups_sha256 STRING, "
       "links BINARY")
SUMMARY = ("doc_id LONG, n_a LONG, n_b LONG, n_groups LONG, n_links LONG, groups_sha256 STRING, "
           "n_best LONG, count_sum LONG")
KINDS = {"LONG": pa.int64(), "STRING": pa.string(), "BINARY": pa.binary()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, KINDS[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def coalesce(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group number of every token of A and of B, from the token ends."""
    starts = np.concatenate([_starts(a_end), _starts(b_end)])
    ends = np.concatenate([a_end, b_end])
    order = np.lexsort((ends, starts))
    running = np.maximum.accumulate(ends[order])
    group = np.zeros(len(order), np.int64)
    group[order[1:]] = np.cumsum(starts[order[1:]] >= running[:-1])
    return group[:len(a_end)], group[len(a_end):]


def overlaps(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (number in A, number in B) of tokens that share a byte."""
    first = np.searchsorted(b_end, _starts(a_end), side="right")
    n = np.searchsorted(_starts(b_end), a_end, side="left") - first
    a = np.repeat(np.arange(len(a_end)), n)
    return a, np.arange(len(a)) - np.repeat(np.cumsum(n) - n - first, n)


def _starts(ends: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], ends[:-1]]) if len(ends) else ends


def byte_level(entry: str) -> bytes:
    """The bytes behind an entry of a byte-level vocabulary: printable bytes
    stand for themselves, the others for the characters from 256 on."""
    return bytes(map(_BYTE_OF.__getitem__, entry))


# units that can be encoded joined: no white space at the outer ends but the
# one sign before them
_CLEAN = re.compile(r"[ \n](?!▁)\S(?:[^▁]*[^▁\s])?\Z").match

_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_OF = {chr(b): b for b in _SHOWN} | {
    chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}


class Vocabularies:
    """Both tokenizers of a worker, and the bytes of their entries."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = SentencePieceProcessor(model_file=b_path)
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for entry, k in self.a.get_vocab().items():
            self.a_bytes[k] = byte_level(entry) if all(c in _BYTE_OF for c in entry) else entry.encode()
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode()
                        for k, p in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))]
        self.lone = self.b.piece_to_id("▁")

    def encode(self, text: str) -> tuple[list[int], list[int]] | None:
        """Ids of A and of B over ``text``, or None where either does not
        restore its bytes.  B sets a blank before what it is given."""
        a = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids
        if text[0] == " ":
            b = self.b.encode(text[1:], num_threads=1) if len(text) > 1 else [self.lone]
        else:
            b = self.b.encode(text, num_threads=1)
            if b[0] != self.lone:
                return None
            b = b[1:]
        data = text.encode()
        if b"".join([self.a_bytes[k] for k in a]) != data or b"".join([self.b_bytes[k] for k in b]) != data:
            return None
        return a, b


def pair_bound(a_path: str, b_path: str) -> int:
    """How many id pairs can be linked at most: those of which one's bytes end
    in the other's."""
    v = Vocabularies(a_path, b_path)
    bound = 0
    for one, other in ((v.a_bytes, v.b_bytes), (v.b_bytes, v.a_bytes)):
        held: dict[bytes, int] = {}
        for x in other:
            held[x] = held.get(x, 0) + 1
        bound += sum(held.get(x[k:], 0) for x in one for k in range(len(x)))
    return bound


class UnitAligner:
    """Aligns units and remembers them: a unit's groups as text, its links as
    packed id pairs, and its numbers of tokens (negative: not restored)."""

    LOST = ("", b"", -1, 0)

    def __init__(self, a_path: str, b_path: str, memory: int = MEMORY):
        self.v, self.memory, self.known = Vocabularies(a_path, b_path), memory, {}
        a, b = range(len(self.v.a_bytes)), range(len(self.v.b_bytes))
        # an id as it stands inside a group's list, and as its last one
        self.shown = [f"{k}," for k in a] + [f"{k}|" for k in a] + [f"{k}," for k in b] + [f"{k};" for k in b]
        self.a_len = np.array([len(x) for x in self.v.a_bytes])
        self.b_len = np.array([len(x) for x in self.v.b_bytes])

    def _align(self, units: list[str], ids: tuple[list[int], list[int]]) -> list[tuple]:
        """Rows of units that are cut off from each other for certain, from
        the ids over all of them."""
        a, b = (np.array(x, np.int64) for x in ids)
        a_end, b_end = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        a_group, b_group = coalesce(a_end, b_end)
        n_a, n_b = len(self.a_len), len(self.b_len)
        last = lambda g: np.append(g[1:] != g[:-1], True)
        shown = np.concatenate([a + n_a * last(a_group), b + 2 * n_a + n_b * last(b_group)])
        order = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
        texts = list(map(self.shown.__getitem__, shown[order].tolist()))
        left, right = overlaps(a_end, b_end)
        together = a_end[left] == b_end[right]
        left, right = left[together], right[together]
        pairs = (a[left] * n_b + b[right]).astype("<u4").tobytes()
        at = np.cumsum([len(u) if u.isascii() else len(u.encode()) for u in units])
        a_cut, b_cut = np.searchsorted(a_end, at, side="right"), np.searchsorted(b_end, at, side="right")
        link_cut = np.searchsorted(left, a_cut, side="left") * 4
        out, a0, b0, t0, l0 = [], 0, 0, 0, 0
        for a1, b1, t1, l1 in zip(a_cut.tolist(), b_cut.tolist(), (a_cut + b_cut).tolist(), link_cut.tolist()):
            out.append(("".join(texts[t0:t1]), pairs[l0:l1], a1 - a0, b1 - b0))
            a0, b0, t0, l0 = a1, b1, t1, l1
        return out

    def _alone(self, unit: str) -> tuple:
        ids = self.v.encode(unit)
        return self.LOST if ids is None else self._align([unit], ids)[0]

    def _new(self, units: list[str]) -> dict[str, tuple]:
        """Rows of unseen units: clean ones joined, the others one by one."""
        out: dict[str, tuple] = {}
        clean = [u for u in units if _CLEAN(u)]
        if len(clean) < len(units):
            out.update((u, self._alone(u)) for u in units if not _CLEAN(u))
        cuts = np.searchsorted(np.cumsum(list(map(len, clean))), np.arange(1, 1 + sum(map(len, clean)) // JOINED) * JOINED)
        edges = [0, *dict.fromkeys(k for k in cuts.tolist() if k), len(clean)]
        held, ids = [], ([], [])
        for k, (lo, hi) in enumerate(zip(edges, edges[1:])):
            part = clean[lo:hi]
            got = self.v.encode("".join(part)) if part else None
            if got is None:
                out.update((u, self._alone(u)) for u in part)
            else:
                held += part
                ids[0].extend(got[0])
                ids[1].extend(got[1])
            if held and (k % CALLS == CALLS - 1 or hi == len(clean)):
                out.update(zip(held, self._align(held, ids)))
                held, ids = [], ([], [])
        return out

    def rows(self, texts: list[str | None]) -> list[tuple]:
        """``n_a, n_b, n_groups, n_links, groups, links`` of every text."""
        with no_collection():
            return self._rows(texts)

    def _rows(self, texts: list[str | None]) -> list[tuple]:
        parts: list[list[tuple]] = [[] for _ in texts]
        for owner, cut in cuts([" " + t if t else "" for t in texts], True, CHUNK):
            units = [u.decode("utf-8", "surrogatepass") for u in cut.bytes_of()]
            found = list(map(self.known.get, units))
            gaps = [k for k, row in enumerate(found) if row is None]
            if gaps:
                new = self._new([units[k] for k in gaps])
                for k in gaps:
                    found[k] = new[units[k]]
                for k in gaps[:max(0, self.memory - len(self.known))]:
                    self.known[units[k]] = found[k]
            if not found:
                continue
            shown, links, n_a, n_b = zip(*found)
            sizes = np.array(list(map(len, links))) // 4
            flat = gather(np.frombuffer(b"".join(links), "<u4"), np.cumsum(sizes) - sizes, sizes, cut.which)
            n_a = np.array(n_a)
            upto = lambda v: np.concatenate([[0], np.cumsum(v[cut.which])])[cut.edges].tolist()
            a, b, lost, at = upto(n_a), upto(np.array(n_b)), upto(n_a < 0), upto(sizes)
            edges = cut.edges.tolist()
            for k, text in enumerate(owner):
                if lost[k] < lost[k + 1]:
                    parts[text].append(self.LOST)
                else:
                    groups = "".join(map(shown.__getitem__, cut.which[edges[k]:edges[k + 1]].tolist()))
                    parts[text].append((groups, flat[at[k]:at[k + 1]].tobytes(), a[k + 1] - a[k], b[k + 1] - b[k]))
        out = []
        for pieces in parts:
            shown, links, n_a, n_b = zip(*pieces) if pieces else ((), (), (), ())
            if not pieces or min(n_a) < 0:
                out.append((0, 0, 0, 0, "", b""))
                continue
            groups, packed = "".join(shown)[:-1], b"".join(links)
            out.append((sum(n_a), sum(n_b), groups.count("|"), len(packed) // 4, groups, packed))
        return out


_ALIGNERS: dict[tuple[str, str], UnitAligner] = {}


def aligner(a_path: str, b_path: str) -> UnitAligner:
    """The worker's aligner for two vocabulary files (workers are reused)."""
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = UnitAligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


def alignments(docs: DataFrame, a_path: str, b_path: str, groups: bool = False) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: counts, the groups' digest,
    the links (packed little-endian ``a_id * size of B + b_id``), and with
    ``groups`` their text ``a1,a2|b1;a3|b2,b3``."""
    prepare(docs.sparkSession)
    ddl = ROW + (", groups STRING" if groups else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = aligner(a_path, b_path)
        for batch in batches:
            rows = known.rows(batch.column(1).to_pylist())
            n_a, n_b, n_groups, n_links, shown, links = zip(*rows) if rows else ((),) * 6
            digest = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in shown]
            columns = [batch.column(0), n_a, n_b, n_groups, n_links, digest, links] + ([shown] if groups else [])
            schema = _schema(ddl)
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, ddl)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, n``: the links of each id pair over all rows."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        held: list[np.ndarray] = []

        def add():
            nonlocal pairs, n
            here, m = np.unique(np.concatenate(held or [pairs[:0]]), return_counts=True)
            all_pairs, place = np.unique(np.concatenate([pairs, here]), return_inverse=True)
            n = np.bincount(place, np.concatenate([n, m]), len(all_pairs)).astype(np.int64)
            pairs = all_pairs
            held.clear()

        for batch in batches:
            held.append(_links(batch.column(0)))
            if sum(map(len, held)) >= 1 << 22:
                add()
        add()
        yield pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(n)], names=["pair", "n"])

    return (aligned.select("links").mapInArrow(count, "pair LONG, n LONG")
            .groupBy("pair").agg(F.sum("n").alias("n")))


def _links(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4")


def summaries(aligned: DataFrame, counts: DataFrame, b_size: int) -> DataFrame:
    """Adds ``n_best`` and ``count_sum``; ``counts`` has at most
    ``pair_bound`` rows, so it is held by the driver and broadcast."""
    found = counts.orderBy("pair").toArrow()
    pairs, n = (found.column(k).to_numpy() for k in (0, 1))
    highest = np.zeros(b_size, np.int64)
    np.maximum.at(highest, pairs % b_size, n)
    shared = aligned.sparkSession.sparkContext.broadcast((pairs.astype(np.uint32), n, n == highest[pairs % b_size]))
    keep = [f.split()[0] for f in SUMMARY.split(", ")[:6]]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = shared.value
        for batch in batches:
            links = _links(batch.column(6))
            at = np.searchsorted(pairs, links)
            ends = np.cumsum(batch.column(4).to_numpy())
            sums = [np.diff(np.append(0, np.append(0, np.cumsum(x[at]))[ends])).astype(np.int64) for x in (best, n)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], *map(pa.array, sums)], schema=_schema(SUMMARY))

    return aligned.select(*keep, "links").mapInArrow(look_up, SUMMARY)


def op13_interval_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a_path, b_path = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    folder = shared_folder(spark, "alignments")
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    alignments(docs, a_path, b_path).write.parquet(folder)  # encoded once
    aligned = spark.read.parquet(folder)
    return summaries(aligned, pair_counts(aligned), len(Vocabularies(a_path, b_path).b_bytes))
