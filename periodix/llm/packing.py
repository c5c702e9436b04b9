"""Operator 10: packing token sequences by non-negative least squares.

1. Each document is encoded once; whole windows of 1024 ids are cut off and
   the remainder (1 to 1023 ids) is one piece.  Only piece descriptors (no
   ids) go on, through a checkpoint, so nothing is encoded twice.
2. The histogram of piece lengths -- at most 1024 numbers, whatever the data
   -- goes to the driver, where ``plan`` enumerates the shallow combinations
   (one to three lengths that fill the window exactly), solves
   ``min |A x - h|, x >= 0`` for their repeat counts, rounds, and packs the
   residual histogram greedily (largest length first, then the largest that
   still fits).
   Where a piece longer than half the window is left with few partners (many
   copies of one long document), its sequences stay part empty: the lengths
   and counts of such pieces are cut at the half window and planned anew.  The
   checksums of both halves are taken when the ids are at hand.
3. The plan is a table of blocks (length, first rank, count, first sequence,
   offset), bounded by the number of combinations.  Pieces of equal length are
   ranked across all tasks by prefix sums of per-task counts -- a length that
   a third of all pieces share is ranked in every task at once -- and each
   piece finds its block by length and rank.

Defined results: a null text is empty and has the end id only; a null id is
kept; repeated rows are separate documents; an empty table gives no pieces.
Extra input columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from periodix.llm.common import cut_lineage, prepare, shuffle_partitions, table
from periodix.llm.encoder import encoder

WINDOW = 1024
ROUNDS = 300   # of the least-squares iteration
SLACK = 8      # places a sequence may stay empty before its long piece is cut
PIECES = ("doc_id LONG, start LONG, length INT, ids_crc32 LONG, doc_tokens LONG, "
          "_head LONG, _tail LONG, _part INT, _no LONG")


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 0, window: int = WINDOW) -> DataFrame:
    """Encode ``docs(doc_id, text)`` and cut every document at multiples of
    ``window``; one row per piece with its task and its number in that task."""
    prepare(docs.sparkSession)
    half = window // 2

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no = TaskContext.get().partitionId(), 0
        code = encoder(tokenizer_path, spaced=True)
        for batch in batches:
            ids, starts, lengths, crcs, totals, heads, tails = columns = [[] for _ in range(7)]
            for doc_id, found in zip(batch.column(0).to_pylist(), code.encode(batch.column(1).to_pylist())):
                tokens = np.append(found.astype("<u4"), np.uint32(end_id))
                for at in range(0, len(tokens), window):
                    piece = tokens[at:at + window]
                    ids.append(doc_id)
                    starts.append(at)
                    lengths.append(len(piece))
                    crcs.append(zlib.crc32(piece))
                    totals.append(len(tokens))
                    cuttable = half < len(piece) < window  # only such pieces can be cut once more
                    heads.append(zlib.crc32(piece[:half]) if cuttable else None)
                    tails.append(zlib.crc32(piece[half:]) if cuttable else None)
            n = len(ids)
            columns += [[part] * n, range(no, no + n)]
            no += n
            names, kinds = zip(*(x.split() for x in PIECES.split(", ")))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int32() if k == "INT" else pa.int64()) for c, k in zip(columns, kinds)], names=names)

    return docs.select(docs["doc_id"], docs["text"]).mapInArrow(cut, PIECES)


def combinations(window: int) -> np.ndarray:
    """All combinations of one to three lengths that fill the window; 0 pads
    the shallower ones.  Rows are sorted tuples a <= b <= c."""
    a, b = np.meshgrid(np.arange(0, window // 3 + 1), np.arange(0, window // 2 + 1), indexing="ij")
    c = window - a - b
    ok = (a <= b) & (b <= c) & ((b > 0) | (a == 0))
    return np.stack([a[ok], b[ok], c[ok]], axis=1)


def nnls(combos: np.ndarray, hist: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """``min |A x - hist|^2, x >= 0`` by accelerated projected gradients; a
    column of A counts the lengths of one combination, so products with A and
    its transpose are gathers and weighted bin counts."""
    used = combos > 0
    at, flat = combos, combos.ravel()
    weight = used.ravel().astype(float)

    def forward(x):
        return np.bincount(flat, weights=np.repeat(x, 3) * weight, minlength=len(hist))

    def back(r):
        return (r[at] * used).sum(axis=1)

    v = np.ones(len(combos))
    for _ in range(20):  # largest singular value by power iteration
        v = back(forward(v / np.linalg.norm(v)))
    step = 1 / (1.05 * np.linalg.norm(v))
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        z = np.maximum(0, y - step * back(forward(y) - hist))
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        x, y = z, z + (last - 1) / t * (z - x)
    return x


def plan(hist: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Strategies ``(lengths, repeats)`` that use up ``hist`` exactly;
    ``hist[n]`` counts the pieces of length n, ``len(hist) - 1`` is the window."""
    window, left = len(hist) - 1, hist.astype(np.int64).copy()
    strategies = []
    if left.any():
        combos = combinations(window)
        combos = combos[((combos == 0) | (left[combos] > 0)).all(axis=1)]  # lengths that occur
        x = nnls(combos, hist.astype(float)) if len(combos) else np.zeros(0)
        for k in np.argsort(-x, kind="stable"):
            repeats = int(x[k] + 0.5)
            if not repeats:
                break
            lengths = [int(n) for n in combos[k] if n]
            repeats = min([repeats, *(int(left[n]) // lengths.count(n) for n in lengths)])
            if repeats:
                strategies.append((tuple(lengths), repeats))
                for n in lengths:
                    left[n] -= repeats
    while left.any():  # greedy on the residual: each turn uses up some length
        lengths, gap, free = [], window, left.copy()
        while gap:
            fits = np.flatnonzero(free[:gap + 1])
            if not len(fits):
                break
            n = int(fits[-1])
            take = min(gap // n, int(free[n]))
            lengths += [n] * take
            free[n] -= take
            gap -= take * n
        repeats = min(int(left[n]) // lengths.count(n) for n in set(lengths))
        strategies.append((tuple(lengths), repeats))
        for n in lengths:
            left[n] -= repeats
    return strategies


def blocks(strategies: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """``(length, first rank, count, first sequence, offset)`` of each place in each strategy."""
    ranks: dict[int, int] = {}
    out, sequence = [], 0
    for lengths, repeats in strategies:
        offset = 0
        for n in lengths:
            first = ranks.get(n, 0)
            out.append((n, first, repeats, sequence, offset))
            ranks[n] = first + repeats
            offset += n
        sequence += repeats
    return out


def plan_with_cuts(hist: np.ndarray) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """The strategies, and how many pieces of each length are cut at the half
    window first: those over half a window whose sequence stays more than
    ``SLACK`` places empty."""
    window, cuts = len(hist) - 1, np.zeros(len(hist), np.int64)
    strategies = plan(hist)
    for lengths, repeats in strategies:
        if window - sum(lengths) > SLACK and max(lengths) > window // 2:
            cuts[max(lengths)] += repeats
    if not cuts.any():
        return strategies, cuts
    parts = hist.astype(np.int64) - cuts
    parts[window // 2] += cuts.sum()
    parts[:window - window // 2] += cuts[window // 2:window]
    again = plan(parts)
    if sum(r for _, r in again) < sum(r for _, r in strategies):
        return again, cuts
    return strategies, np.zeros(len(hist), np.int64)


def cut_ranks(hist: np.ndarray, cuts: np.ndarray) -> list[tuple[int, int, int, int]]:
    """``(length, first rank that is cut, rank of its first half, of its second)``
    per length; halves rank behind the whole pieces of their length."""
    half = (len(hist) - 1) // 2
    whole = hist.astype(np.int64) - cuts
    heads = int(whole[half])
    out = []
    for n in np.flatnonzero(hist):
        n = int(n)
        out.append((n, int(whole[n]), heads, int(whole[n - half]) if cuts[n] else 0))
        if cuts[n]:
            if n - half == half:
                raise ValueError("a full window is never cut")
            heads += int(cuts[n])
    return out


def small(spark: SparkSession, rows: list[tuple[int, ...]], *names: str) -> DataFrame:
    """A table of the driver's integers, handed over as Arrow columns: a list of
    rows would be read by further Python workers, beside those that encode and
    keep their memory."""
    columns = np.array(rows, np.int64).reshape(-1, len(names)).T
    return spark.createDataFrame(pa.table([pa.array(c) for c in columns], names=list(names)))


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 0, window: int = WINDOW) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` of every piece."""
    spark = docs.sparkSession
    cut = cut_lineage(pieces(docs, tokenizer_path, end_id, window))  # encoded once
    counts = cut.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    hist = np.zeros(window + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("_n").alias("_n")).collect():  # at most `window` rows
        hist[r["length"]] = r["_n"]
    strategies, cuts = plan_with_cuts(hist)
    places = small(spark, blocks(strategies), "length", "_first", "_count", "_sequence", "_offset")
    halves = small(spark, cut_ranks(hist, cuts), "length", "_cut", "_heads", "_tails")

    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    local = Window.partitionBy("length", "_part").orderBy("_no")
    # broadcasts: at most `window` rows of halves, and the bounded number of
    # combinations, whatever the data
    ranked = (cut.withColumn("_local", F.row_number().over(local) - 1)
              .join(bases, ["length", "_part"]).join(F.broadcast(halves), "length")
              .withColumn("_rank", F.col("_base") + F.col("_local")))
    half, over = F.lit(window // 2), F.col("_rank") - F.col("_cut")
    piece = lambda start, n, crc, rank: F.struct(
        start.alias("start"), n.cast("int").alias("length"), crc.alias("ids_crc32"), rank.alias("_rank"))
    whole = F.array(piece(F.col("start"), F.col("length"), F.col("ids_crc32"), F.col("_rank")))
    parts = F.array(piece(F.col("start"), half, F.col("_head"), F.col("_heads") + over),
                    piece(F.col("start") + half, F.col("length") - half, F.col("_tail"), F.col("_tails") + over))
    final = ranked.select("doc_id", "doc_tokens",
                          F.explode(F.when(over >= 0, parts).otherwise(whole)).alias("_p")).select(
        "doc_id", "doc_tokens", "_p.*")
    placed = final.join(F.broadcast(places), "length").where(
        (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_first") + F.col("_count")))
    return placed.select(
        "doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens",
        (F.col("_sequence") + F.col("_rank") - F.col("_first")).alias("sequence_id"),
        F.col("_offset").alias("offset"))


def op10_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
