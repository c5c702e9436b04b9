"""Recall, exact re-ranking and the exact way for short answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from periodix.operators import approximate as A
from tests.conftest import SF_CHECK


def sides(spark, mat, ids=None):
    rows = [(int(i), v if v is None else [float(x) for x in v]) for i, v in zip(ids or range(len(mat)), mat)]
    docs = spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<FLOAT>").repartition(3)
    return docs, docs.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec"))


@pytest.mark.parametrize("bands,rows", [(A.BANDS, A.ROWS)])
def test_recall_on_the_tables(spark, bands, rows):
    emb = spark.read.parquet(f"{SF_CHECK}/embeddings.parquet").select("vec_id", "embedding")
    asked = emb.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec"))
    got = A.approximate_topk(emb, asked, 10, bands=bands, rows=rows, skip_same_id=True).cache()
    exact = A.exact_topk(emb, asked, 10, skip_same_id=True).cache()
    assert A.recall(got, exact).first()["recall"] >= 0.9
    assert got.groupBy("qid").count().filter("count <> 10").count() == 0
    both = got.join(exact.withColumnRenamed("similarity", "_e"), ["qid", "doc_id"])
    assert both.filter(F.abs(F.col("similarity") - F.col("_e")) > 1e-12).count() == 0


def test_clusters_need_few_candidates(spark):
    """On clustered vectors narrow buckets find the neighbours among few pairs."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 32))
    mat = np.repeat(centres, 15, axis=0) + 0.05 * rng.normal(size=(600, 32))
    docs, asked = sides(spark, mat)
    got = A.approximate_topk(docs, asked, 5, bands=16, rows=8, length=0.3, skip_same_id=True)
    assert A.recall(got, A.exact_topk(docs, asked, 5, skip_same_id=True)).first()["recall"] >= 0.95
    model_pairs = _candidates(docs, asked, 16, 8, 0.3)
    assert model_pairs < 0.1 * 600 * 30


def _candidates(docs, asked, bands, rows, length):
    d, q = A.unit_vectors(docs, "vec_id", "embedding", "doc_id"), A.unit_vectors(asked, "qid", "vec", "qid")
    lsh = A.BucketedRandomProjectionLSH(inputCol="_v", outputCol="_hashes", numHashTables=bands * rows, bucketLength=length, seed=A.SEED)
    model = lsh.fit(d.withColumn("_v", A.array_to_vector("_unit")))
    return A.band_keys(q, model, bands, rows).join(A.band_keys(d, model, bands, rows), "_band").select("qid", "doc_id").distinct().count()


def test_too_few_candidates_fall_back_to_the_exact_search(spark):
    rng = np.random.default_rng(5)
    docs, asked = sides(spark, rng.normal(size=(60, 16)))
    got = A.approximate_topk(docs, asked, 4, bands=1, rows=8, length=0.01, skip_same_id=True)
    want = A.exact_topk(docs, asked, 4, skip_same_id=True)
    key = lambda df: sorted((r["qid"], r["rank"], r["doc_id"]) for r in df.collect())
    assert key(got) == key(want) and len(key(got)) == 12


def test_edges(spark):
    docs, asked = sides(spark, [[1.0, 0.0], None, [0.0, 0.0], [1.0, 0.0], [0.0, 2.0]], [20, 21, 22, 23, 40])
    got = A.approximate_topk(docs, asked, 10, bands=4, rows=1, length=0.5)
    assert sorted((r["qid"], r["rank"], r["doc_id"]) for r in got.collect()) == [
        (20, 1, 20), (20, 2, 23), (20, 3, 40), (40, 1, 40), (40, 2, 20), (40, 3, 23)]
    empty, none = sides(spark, [])
    assert A.approximate_topk(empty, none, 3).count() == 0


def test_candidates_are_marks_not_rows(spark, monkeypatch):
    """Crowded buckets: no row per band or pair of vectors is made, a pair that
    agrees in many bands counts once, copies tie and the smaller id wins."""
    monkeypatch.setattr(A, "band_keys", lambda *a: pytest.fail("a row per band"))
    rng = np.random.default_rng(6)
    mat = np.repeat(rng.normal(size=(3, 8)), 60, axis=0)
    docs, asked = sides(spark, mat)
    got = A.approximate_topk(docs, asked, 5, bands=4, rows=2, length=0.5, skip_same_id=True).collect()
    found = {(r["qid"], r["rank"]): r["doc_id"] for r in got}
    assert len(found) == len(got) == 9 * 5
    for q in range(0, 180, 20):
        first = q // 60 * 60
        assert [found[q, r] for r in range(1, 6)] == [i for i in range(first, first + 6) if i != q][:5]


def test_marks_equal_the_definition():
    rng = np.random.default_rng(7)
    asked, keys = rng.integers(0, 9, (23, 5)), rng.integers(0, 9, (41, 5))
    order = np.argsort(asked.T, axis=1, kind="stable")
    got = A._candidates(keys, order, np.take_along_axis(asked.T, order, axis=1), 23)
    assert np.array_equal(got, (asked[:, None, :] == keys[None, :, :]).any(axis=2))
