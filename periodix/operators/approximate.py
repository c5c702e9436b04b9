"""Approximate nearest neighbours by locality-sensitive hashing.

Unit vectors are hashed by Spark ML's bucketed random projections; ``rows`` of
its hash values make the key of one band, and a document is a candidate of a
question if they agree in any of the ``bands``.  Both sides are packed into
blocks (``retrieval``) with their band keys; where two blocks meet, sorted keys
find the candidates band by band, and a candidate agreed on by several bands is
one mark of the block's table, not several rows.  So neither a pair nor a
crowded bucket is shuffled.  Candidates are ranked by their exact cosine.  A
question with fewer than ``k`` candidates is answered by the exact search
instead.

Fewer rows or longer buckets find more candidates: on vectors without any
structure (independent normal entries, as in the test tables) a recall of 0.9
takes about two thirds of all pairs, on clustered ones a few per cent.  ``recall``
measures it against the exact search.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from periodix.operators import retrieval as R
from periodix.operators.retrieval import cosine_topk
from periodix.session import ensure_checkpoint_dir

BANDS = 32
ROWS = 3
LENGTH = 0.2   # of a bucket, on unit vectors
SEED = 20240229


def _unit(vec: Column) -> Column:
    """``vec`` at length one; null for a null, empty or zero vector."""
    v = vec.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm))


def unit_vectors(df: DataFrame, id_col: str, vec_col: str, out_id: str) -> DataFrame:
    return df.select(F.col(id_col).alias(out_id), _unit(F.col(vec_col)).alias("_unit")).dropna(subset=["_unit"])


def band_lists(units: DataFrame, model, bands: int, rows: int) -> DataFrame:
    """``units`` with the keys of all bands, ``_bands``."""
    hashed = model.transform(units.withColumn("_v", array_to_vector("_unit")))
    values = F.transform("_hashes", lambda h: F.get(vector_to_array(h), 0).cast("long"))
    bands_of = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)),
                           lambda b: F.xxhash64(b, F.slice(F.col("_values"), b * rows + 1, rows)))
    return hashed.select(*units.columns, values.alias("_values")).select(*units.columns, bands_of.alias("_bands"))


def band_keys(units: DataFrame, model, bands: int, rows: int) -> DataFrame:
    """``units`` with one row per band and its key."""
    ids = [c for c in units.columns if c != "_unit"]
    return band_lists(units, model, bands, rows).select(*ids, F.explode("_bands").alias("_band"))


def _pack(units: np.ndarray, bands: np.ndarray, ids: np.ndarray) -> tuple:
    return np.stack(units).astype(np.float64), np.stack(bands), ids


def _candidates(keys: np.ndarray, order: np.ndarray, in_order: np.ndarray, n: int) -> np.ndarray:
    """``(n, documents)``: whether a question and a document agree in a band.
    ``order`` sorts the questions by each band's key, ``in_order`` are the keys."""
    marks = np.zeros((n, len(keys)), bool)
    for band in range(keys.shape[1]):
        first = np.searchsorted(in_order[band], keys[:, band], side="left")
        cnt = np.searchsorted(in_order[band], keys[:, band], side="right") - first
        pos = np.arange(int(cnt.sum())) + np.repeat(first - np.cumsum(cnt) + cnt, cnt)
        marks[order[band][pos], np.repeat(np.arange(len(keys)), cnt)] = True
    return marks


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row and entry after entry, so that equal vectors get equal values."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def _candidate_scorer(k: int, skip_same_id: bool):
    def scorer(queries: list, top):
        qmat, qkeys, qids = queries
        order = np.argsort(qkeys.T, axis=1, kind="stable")
        in_order = np.take_along_axis(qkeys.T, order, axis=1)

        def score(docs: list, ids: list[np.ndarray]) -> None:
            mat, keys, own = docs
            step = max(1, R._CELLS_PER_STEP // len(qids))
            for lo in range(0, len(mat), step):
                marks = _candidates(keys[lo:lo + step], order, in_order, len(qids))
                if skip_same_id:
                    marks &= qids[:, None] != own[None, lo:lo + step]
                sims = np.where(marks, qmat @ mat[lo:lo + step].T, -np.inf)
                sims[np.isnan(sims)] = np.inf  # ranked as Spark ranks a NaN
                least = top.thr
                if sims.shape[1] > k:
                    least = np.maximum(least, -np.partition(-sims, k - 1, axis=1)[:, k - 1])
                row, doc = np.nonzero(marks & (sims >= least[:, None] - 1e-9))  # a little low for rounding
                exact = _cosines(qmat[row], mat[lo + doc])
                exact[np.isnan(exact)] = np.inf
                top.add(row, exact, [c[lo + doc] for c in ids])

        return score

    return scorer


def approximate_topk(docs: DataFrame, queries: DataFrame, k: int, doc_id: str = "vec_id", doc_vec: str = "embedding",
                     query_id: str = "qid", query_vec: str = "vec", bands: int = BANDS, rows: int = ROWS,
                     length: float = LENGTH, skip_same_id: bool = False) -> DataFrame:
    """``(qid, rank, doc_id, similarity)``: exact similarities of the best
    ``k`` candidates; ids are unique on both sides.  ``skip_same_id`` leaves a
    question's own id out (questions that are documents themselves)."""
    d = unit_vectors(docs, doc_id, doc_vec, "doc_id")
    q = unit_vectors(queries, query_id, query_vec, "qid")
    lsh = BucketedRandomProjectionLSH(inputCol="_v", outputCol="_hashes", numHashTables=bands * rows,
                                      bucketLength=length, seed=SEED)
    sample = d.limit(1).withColumn("_v", array_to_vector("_unit"))
    if sample.isEmpty():  # the projections take their dimension from one vector
        return cosine_topk(docs, queries, k, doc_id, doc_vec, query_id, query_vec)
    model = lsh.fit(sample)
    hashed = lambda units, own: band_lists(units, model, bands, rows).dropna(subset=[own])
    values = ["_unit", "_bands", "_own"]
    hits = R.blocked_topk(hashed(d, "doc_id").withColumn("_own", F.col("doc_id")), ["doc_id"],
                          hashed(q, "qid").withColumn("_own", F.col("qid")), ["qid"], values, k, _pack, _pack,
                          _candidate_scorer(k, skip_same_id), R.DOC_ROWS, R.QUERY_ROWS)
    hits = hits.withColumn("similarity", F.when(F.col("similarity") < float("inf"), F.col("similarity")).otherwise(float("nan")))
    ensure_checkpoint_dir(docs.sparkSession)
    hits = hits.checkpoint(eager=True)  # k rows a question, read three times
    enough = hits.where(F.col("rank") == k).select("qid")
    short = queries.join(enough, queries[query_id] == enough["qid"], "left_anti")
    if short.isEmpty():
        return hits.select("qid", "rank", "doc_id", "similarity")
    exact = exact_topk(docs, short, k, doc_id, doc_vec, query_id, query_vec, skip_same_id)
    return hits.join(enough, "qid", "left_semi").select("qid", "rank", "doc_id", "similarity").unionByName(exact)


def exact_topk(docs: DataFrame, queries: DataFrame, k: int, doc_id: str = "vec_id", doc_vec: str = "embedding",
               query_id: str = "qid", query_vec: str = "vec", skip_same_id: bool = False) -> DataFrame:
    """The exact search; with ``skip_same_id``, without a question's own id."""
    if not skip_same_id:
        return cosine_topk(docs, queries, k, doc_id, doc_vec, query_id, query_vec)
    found = cosine_topk(docs, queries, k + 1, doc_id, doc_vec, query_id, query_vec).where("qid <> doc_id")
    again = Window.partitionBy("qid").orderBy("rank")
    return found.withColumn("rank", F.row_number().over(again)).where(F.col("rank") <= k)


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """``recall``: the share of the exact hits that are among the others."""
    found = approximate.select("qid", "doc_id", F.lit(1).alias("_found"))
    return exact.join(found, ["qid", "doc_id"], "left").agg(
        F.avg(F.coalesce("_found", F.lit(0))).alias("recall"))
