"""Operator 2: benchmark decontamination by spaced-seed hashing.

A seed is the hash of the words of a window at the positions a fixed mask
marks; words at the other positions may differ.  Seeds of the test items are
joined with the seeds of the training documents, and around each hit the two
texts are compared word by word on the hit's diagonal: the best-scoring
stretch (substitutions cost, so that a stretch has at least ``IDENTITY``
percent equal words) must be long enough.

Documents are scanned once.  A bit array of fixed size with the test seeds
drops the windows that match nothing before any shuffle; what is left -- a
document's hits with the words around them -- is joined by seed, so neither
side is broadcast and a test set of any size works.  Words are runs of
letters and digits in lower case.

Defined results: a null or empty text has no words and no overlap; an item of
fewer words than a mask spans (``SPAN``) has no seeds: with ``short`` (as in
the query) it is found where a document holds all its words in a row, without
it is no evidence; a null id is reported as null; repeated rows are reported once; an empty table on
either side gives no rows.  Extra input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from periodix.llm import wordhash
from periodix.llm.bits import Bits, bit_array
from periodix.llm.common import cut_lineage, prepare, table

MASKS = ("1101100101", "1110010011", "1011010110")  # 1: the word counts
SPAN = 10
CONTEXT = 64      # words kept on either side of a hit
IDENTITY = 70     # percent of equal words within an overlap
MIN_WORDS = 12    # words of an overlap, or ...
MIN_SHARE = 80    # ... percent of a shorter item's words
REGION = "region LONG, doc_id LONG, key LONG, at INT, words BINARY, places ARRAY<INT>, seeds ARRAY<LONG>"
OVERLAP = "doc_id LONG, key LONG, item_id LONG, start INT, n_words INT, n_equal INT"


def seeds(words: np.ndarray, whole: Sequence[int] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Place and hash of every window under every mask, and of all words of
    every window of a length in ``whole``."""
    places, out = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for number, mask in [*enumerate(MASKS, 1), *((len(MASKS) + k, "1" * k) for k in whole)]:
        n = len(words) - len(mask) + 1
        if n <= 0:
            continue
        h = np.full(n, number, np.uint64)
        for k, bit in enumerate(mask):
            if bit == "1":
                h += words[k:k + n] * wordhash._PLACE[k]
        places.append(np.arange(n))
        out.append(wordhash.mix(h))
    return np.concatenate(places), np.concatenate(out)


def best_stretch(equal: np.ndarray) -> tuple[int, int, int]:
    """Start, length and equal words of the best-scoring stretch."""
    score = np.cumsum(np.r_[0, np.where(equal, 100 - IDENTITY, -IDENTITY)])
    low = np.minimum.accumulate(score)
    end = int(np.argmax(score - low))
    start = int(np.argmin(score[:end + 1]))
    return start, end - start, int(equal[start:end].sum())


def items_of(benchmark: DataFrame, short: bool = False) -> DataFrame:
    """``item_id, item, words, places, seeds`` of every item long enough; of
    ``short`` ones the hash of the whole item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {k: [] for k in ("item_id", "item", "words", "places", "seeds")}
            ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, chunk in wordhash.words(batch.column(2).to_pylist(), plain=True):
                for k, words in enumerate(chunk, first):
                    at, hashes = seeds(words, [len(words)] if short and 0 < len(words) < SPAN else ())
                    if len(at):
                        for name, value in zip(rows, (ids[k], keys[k], words.tobytes(), at.tolist(), hashes.view(np.int64).tolist())):
                            rows[name].append(value)
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), kinds)], names=list(rows))

    keyed = benchmark.select("item_id", F.xxhash64("item_id", "text").alias("item"), "text").distinct()
    return keyed.mapInArrow(run, "item_id LONG, item LONG, words BINARY, places ARRAY<INT>, seeds ARRAY<LONG>")


def regions(docs: DataFrame, marks: bytes, whole: Sequence[int] = ()) -> DataFrame:
    """Stretches of documents with hits: the words from ``CONTEXT`` before the
    first to ``CONTEXT`` after the last of hits that lie close together."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Bits(marks)
        for batch in batches:
            rows: list[tuple] = []
            ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, chunk in wordhash.words(batch.column(2).to_pylist(), plain=True):
                for k, words in enumerate(chunk, first):
                    at, hashes = seeds(words, whole)
                    hit = known.has(hashes)
                    if not hit.any():
                        continue
                    at, hashes = at[hit], hashes[hit]
                    order = np.argsort(at, kind="stable")
                    at, hashes = at[order], hashes[order]
                    for group in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) > CONTEXT) + 1):
                        low = max(0, int(at[group[0]]) - CONTEXT)
                        high = int(at[group[-1]]) + SPAN + CONTEXT
                        part = words[low:high]
                        name = wordhash.mix(np.array([keys[k] & (1 << 64) - 1, (ids[k] or 0) & (1 << 64) - 1, low, ids[k] is None], np.uint64))
                        name = wordhash.mix(name[:1] * np.uint64(3) + name[1:2] * np.uint64(5) + name[2:3] * np.uint64(7)
                                            + name[3:] * np.uint64(11))
                        rows.append((int(name.view(np.int64)[0]), ids[k], keys[k], low, part.tobytes(),
                                     (at[group] - low).tolist(), hashes[group].view(np.int64).tolist()))
            columns = list(zip(*rows)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)],
                                             names=[x.split()[0] for x in REGION.split(", ")])

    keyed = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    return keyed.mapInArrow(run, REGION)


def overlaps(docs: DataFrame, benchmark: DataFrame, short: bool = False) -> DataFrame:
    """``doc_id, key, item_id, start, n_words, n_equal``: the best overlap of
    every document (``key``: xxhash64 of its text) with every test item, ``short`` ones
    (of fewer than ``SPAN`` words) by exact match."""
    prepare(docs.sparkSession)
    items = cut_lineage(items_of(benchmark, short))
    n_words = F.floor(F.octet_length("words") / 8)
    whole = sorted(r["n"] for r in items.select(n_words.alias("n")).where(F.col("n") < SPAN).distinct().collect())  # under SPAN rows
    pairs = F.explode(F.arrays_zip("places", "seeds")).alias("s")
    test = items.select("item", pairs).select("item", F.col("s.places").alias("there"), F.col("s.seeds").alias("seed"))
    found = cut_lineage(regions(docs, bit_array(test.select("seed").distinct(), "seed"), whole).dropDuplicates(["region"]))
    train = found.select("region", pairs).select("region", F.col("s.places").alias("here"), F.col("s.seeds").alias("seed"))
    lines = train.join(test, "seed").select("region", "item", (F.col("here") - F.col("there")).alias("line")).distinct()
    aligned = (lines.join(found.select("region", "doc_id", "key", "at", F.col("words").alias("doc_words")), "region")
               .join(items.select("item", "item_id", F.col("words").alias("item_words")), "item")
               .select("doc_id", "key", "item_id", "at", "line", "doc_words", "item_words"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for r in batch.to_pylist():
                doc, item = (np.frombuffer(r[k], np.uint64) for k in ("doc_words", "item_words"))
                first = max(0, -r["line"])
                n = min(len(item), len(doc) - r["line"]) - first
                start, length, same = best_stretch(doc[r["line"] + first:][:n] == item[first:][:n])
                enough = length >= MIN_WORDS or 100 * length >= MIN_SHARE * len(item)
                if length and enough:
                    rows.append((r["doc_id"], r["key"], r["item_id"], r["at"] + r["line"] + first + start, length, same))
            columns = list(zip(*rows)) or [()] * 6
            names, kinds = zip(*(x.split() for x in OVERLAP.split(", ")))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int32() if k == "INT" else pa.int64()) for c, k in zip(columns, kinds)], names=names)

    best = F.max(F.struct("n_equal", (-F.col("n_words")).alias("n"), (-F.col("start")).alias("s"))).alias("b")
    return aligned.mapInArrow(verify, OVERLAP).groupBy("doc_id", "key", "item_id").agg(best).select(
        "doc_id", "key", "item_id", (-F.col("b.s")).alias("start"), (-F.col("b.n")).alias("n_words"), F.col("b.n_equal").alias("n_equal"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents (all columns) without any overlap."""
    bad = overlaps(docs, benchmark).select(F.col("doc_id").alias("_bad"), F.col("key").alias("_key")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_bad"]) & (F.xxhash64(docs["text"]) == bad["_key"]), "left_anti")


def op2_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per contaminated document and test item."""
    return overlaps(table(spark, sf_dir, "documents", "doc_id", "text"),
                    table(spark, sf_dir, "benchmark", "item_id", "text"), short=True).drop("key")
