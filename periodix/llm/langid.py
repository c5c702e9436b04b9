"""Operator 3: language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text accepts exactly the
substrings of that text.  A document is parsed against it: the longest match
is read, the phrase ends where the automaton has no transition, and the next
phrase starts there.  A phrase costs ``log2(N)`` bits (a place in the ``N``
bytes of training text), so ``phrases * log2(N) / bytes`` estimates the cross
entropy; the language with the fewest normalised phrases wins, and ``score``
is its share of ``2^-bits`` tempered by ``TEMPER``.

Every label is learned.  The sample to learn from is bounded: ``TRAIN_DOCS``
documents and ``TRAIN_BYTES`` bytes per language, drawn by hash over all rows,
for up to ``FULL`` languages; more of them share the same total, so the automata
of a worker are of bounded size for any number of labels.  They are held in
groups of ``GROUP`` languages; the fewest bits over all groups win.  Texts are parsed whole, in blocks of ``BLOCK``
bytes that end a phrase: all blocks of a batch and all languages advance
together, one table look-up per byte, which keeps the work in numpy.

Defined results: ``und`` with score 0 for a null text, one without a letter
(``str.isalpha``; signs like a half or a superscript two are none), or when no
labelled row exists; ties go to the smaller language code; a null
id is never held out nor learned from; of rows with one label and id the
smallest text is learned; repeated rows get equal results; an empty table gives
no rows.  Other input columns are not looked at; one named ``language`` is
replaced by the result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from periodix.llm.common import prepare, table

TRAIN_DOCS = 400       # documents per language in the sample (expected)
TRAIN_CHARS = 4000     # characters used of each of them
TRAIN_BYTES = 40_000   # bytes per language in the automaton
FULL = 16              # languages that get the whole of these; more share FULL times as much
GROUP = 16             # languages of one table of automata
BLOCK = 512            # bytes of a block of parallel parsing
LANES = 8192           # blocks parsed at a time
ROWS = 512             # texts normalised at a time
TEMPER = 8.0           # bits that halve a language's share
REJECT_BITS = 5.5      # bits a byte above which a text is in no learned language

_LETTERS = re.compile(r"[^\W\d_]+")
RESULT = "lang_pred STRING, score DOUBLE, bits DOUBLE"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def letters(text: str | None) -> bytes:
    """Runs of letters in lower case, one blank between them, as UTF-8."""
    runs = _LETTERS.findall((text or "").lower())
    if not "".join(runs).isalpha():  # the pattern takes numeric signs along
        runs = "".join(c if c.isalpha() else " " for c in " ".join(runs)).split()
    return " ".join(runs).encode()


def sample(docs: DataFrame) -> dict[str, bytes]:
    """Bounded training text per language from ``docs(doc_id, text, lang)``;
    rows are drawn by hash at a rate taken from the counts of all rows."""
    rows = docs.where(docs["lang"].isNotNull() & docs["doc_id"].isNotNull() & docs["text"].isNotNull()
                      & ~held_out(docs["doc_id"])).select("doc_id", "text", "lang")
    counts = rows.groupBy("lang").count().orderBy("lang").collect()
    if not counts:
        return {}
    part = min(1.0, FULL / len(counts))  # of the sample of one language
    most = max(1, int(TRAIN_BYTES * part))
    rate = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(max(1, TRAIN_DOCS * part) / r["count"]))])
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < rate[F.col("lang")] * float(1 << 40)
    chosen = rows.where(drawn).groupBy("lang", "doc_id").agg(F.min(F.substring("text", 1, TRAIN_CHARS)).alias("text")).select(
        "lang", "doc_id", F.xxhash64("doc_id").alias("draw"), "text").collect()
    texts: dict[str, bytes] = {}
    for r in sorted(chosen, key=lambda r: (r["lang"], r["draw"], r["doc_id"])):
        have = texts.get(r["lang"], b"")
        if len(have) < most:
            texts[r["lang"]] = (have + b" " + letters(r["text"]))[:most]
    return {k: v for k, v in sorted(texts.items()) if v.strip()}


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that accepts every substring."""
    moves, link, length = [{}], [-1], [0]
    last = 0
    for c in text:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[new] = copy
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
        last = new
    return moves


class CrossParser:
    """The automata of some languages as one table ``next[state, symbol]``.

    The bits above ``SHIFT`` count the phrases that a look-up completes: one
    if the automaton has no transition (the state is then that of a fresh
    start with the symbol), and one for a symbol that the language never has,
    which is a phrase of its own.  Symbol 0 is padding and stays."""

    SHIFT = 29

    def __init__(self, texts: dict[str, bytes]):
        self.names = list(texts)
        seen = sorted({c for t in texts.values() for c in t})
        self.width = len(seen) + 2  # padding, bytes no language has, the rest
        codes = np.ones(256, np.uint8)
        codes[seen] = np.arange(2, self.width, dtype=np.uint8) if len(seen) < 254 else np.minimum(seen, 253) + 2
        self.codes = codes
        tables, self.roots, base = [], [], 0
        for t in texts.values():
            moves = suffix_automaton(bytes(codes[np.frombuffer(t, np.uint8)]))
            one = 1 << self.SHIFT
            fresh = np.full(self.width, base + 2 * one, np.int32)
            for c, s in moves[0].items():
                fresh[c] = base + s + one
            table = np.tile(fresh, (len(moves), 1))
            table[0] -= one  # at the root no phrase is open
            table[:, 0] = base + np.arange(len(moves))
            for s, row in enumerate(moves):
                if row:
                    table[s, list(row)] = base + np.fromiter(row.values(), np.int32, len(row))
            tables.append(table)
            self.roots.append(base)
            base += len(moves)
        self.next = np.concatenate(tables).ravel()
        self.cost = np.array([np.log2(max(2, len(t))) for t in texts.values()])

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Phrases of every text under every language."""
        out = np.zeros((len(texts), len(self.names)))
        lanes, owner = [], []
        for k, t in enumerate(texts):
            code = self.codes[np.frombuffer(t, np.uint8)]
            n = -(-len(code) // BLOCK)
            full = np.zeros(n * BLOCK, np.uint8)
            full[:len(code)] = code
            for at in range(0, n, LANES):  # a very long text fills several rounds
                part = full[at * BLOCK:(at + LANES) * BLOCK].reshape(-1, BLOCK)
                if lanes and sum(map(len, lanes)) + len(part) > LANES:
                    self._round(lanes, owner, out)
                    lanes, owner = [], []
                lanes.append(part)
                owner += [k] * len(part)
        self._round(lanes, owner, out)
        return out

    def _round(self, lanes: list[np.ndarray], owner: list[int], out: np.ndarray) -> None:
        if not owner:
            return
        steps = np.ascontiguousarray(np.concatenate(lanes).T)
        used = (steps != 0).any(axis=1)
        state = np.repeat(np.array(self.roots, np.int64)[:, None], len(owner), axis=1)
        ends = np.zeros(state.shape, np.int32)
        for symbols in steps[used]:
            got = self.next[state * self.width + symbols]
            ends += got >> self.SHIFT
            state = (got & ((1 << self.SHIFT) - 1)).astype(np.int64)
        ends += state != np.array(self.roots)[:, None]  # an open phrase ends with the block
        for k, row in enumerate(ends):
            out[:, k] += np.bincount(owner, weights=row, minlength=len(out))


class Languages:
    """All languages of a model, ``GROUP`` of them to a parser."""

    def __init__(self, texts: dict[str, bytes]):
        self.names = list(texts)
        self.parsers = [CrossParser({k: texts[k] for k in self.names[at:at + GROUP]})
                        for at in range(0, len(self.names), GROUP)]

    def bits(self, data: list[bytes]) -> np.ndarray:
        return np.hstack([p.phrases(data) * p.cost for p in self.parsers])

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        data = [letters(t) for t in texts]
        if not self.names:
            return ["und"] * len(data), np.zeros(len(data)), np.zeros(len(data))
        size = np.array([len(d) for d in data])
        bits = self.bits(data)
        best = bits.argmin(axis=1)
        least = bits[np.arange(len(data)), best]
        share = 1 / np.exp2(-np.minimum(1000, (bits - least[:, None]) / TEMPER)).sum(axis=1)
        names = [self.names[b] if n else "und" for b, n in zip(best, size)]
        return names, np.where(size > 0, share, 0.0), np.where(size > 0, least / np.maximum(size, 1), 0.0)


_MODELS: dict[tuple, Languages] = {}


def _model(texts: dict[str, bytes]) -> Languages:
    """A worker builds the automata once per model (workers are reused)."""
    key = tuple(texts.items())
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Languages(texts)
    return _MODELS[key]


def identify(docs: DataFrame, texts: dict[str, bytes], text_col: str = "text") -> DataFrame:
    """Every column of ``docs`` and a struct ``language(lang_pred, score,
    bits)`` from the whole text; rows stay where they are (no shuffle)."""
    prepare(docs.sparkSession)
    predict = _udf(texts)
    return docs.withColumn("language", predict(docs[text_col]))


def _udf(texts: dict[str, bytes]):
    import pandas as pd

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in batches:
            model, parts = _model(texts), []
            for at in range(0, len(series), ROWS):
                names, score, bits = model.predict(series.iloc[at:at + ROWS].tolist())
                parts.append(pd.DataFrame({"lang_pred": names, "score": score, "bits": bits}))
            yield pd.concat(parts) if parts else pd.DataFrame({"lang_pred": [], "score": [], "bits": []})

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    # as if it were not deterministic: a filter on two of its fields would
    # otherwise be split and run it twice, in two workers for each task
    return F.pandas_udf(run, RESULT).asNondeterministic()


def accepted(language: Column) -> Column:
    """False for documents in no learned language."""
    return (language["lang_pred"] != "und") & (language["bits"] <= REJECT_BITS)


def op3_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return identify(docs.select("doc_id", "text"), sample(docs)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "language.*")
