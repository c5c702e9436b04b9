"""Retrieval against brute force on small fixtures; chunking against Python."""

import hashlib
import json
import math
import os
import tempfile
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from periodix.operators import retrieval as R
from periodix.operators import text as T
from tests.conftest import SF_SMALL


def test_chunks_match_python(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    got = {(r["doc_id"], r["chunk_no"]): r["text"] for r in T.chunk_lines(docs).collect()}
    want = {}
    for r in docs.collect():
        kept = [c.strip() for c in (r["text"] or "").split("\n") if c.strip()]
        for i, c in enumerate(kept):
            want[(r["doc_id"], i)] = c
    assert got == want


def test_chunk_strip_unicode_whitespace(spark):
    text = "  a  \n\t\n　b\x1c\n​"
    df = spark.createDataFrame([(1, text)], "doc_id INT, text STRING")
    got = [r["text"] for r in T.chunk_lines(df).orderBy("chunk_no").collect()]
    assert got == [c.strip() for c in text.split("\n") if c.strip()]


def _brute_cosine(docs: pd.DataFrame, queries: pd.DataFrame, k: int):
    out = {}
    for _, q in queries.iterrows():
        qv = np.asarray(q["vec"], dtype=float)
        sims = []
        for _, d in docs.iterrows():
            dv = np.asarray(d["embedding"], dtype=float)
            sims.append((-(dv @ qv) / (np.linalg.norm(dv) * np.linalg.norm(qv)), d["vec_id"]))
        out[q["qid"]] = [i for _, i in sorted(sims)[:k]]
    return out


def test_cosine_topk_exact_and_batched(spark):
    emb = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select("vec_id", "embedding", "label")
    queries = emb.filter(F.col("label") == 3).select(F.col("vec_id").alias("qid"),
                                                     F.col("embedding").alias("vec"))
    want = _brute_cosine(emb.toPandas(), queries.toPandas(), 5)
    for dim in (64, 1 << 19):  # the second makes blocks of two vectors
        got = {}
        for r in R.cosine_topk(emb.repartition(4), queries, k=5, dim=dim).collect():
            got.setdefault(r["qid"], []).append((r["rank"], r["doc_id"]))
        got = {q: [d for _, d in sorted(v)] for q, v in got.items()}
        assert got == want


def test_cosine_fewer_docs_than_k(spark):
    docs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])],
                                 "vec_id INT, embedding ARRAY<DOUBLE>")
    q = spark.createDataFrame([(9, [1.0, 1.0])], "qid INT, vec ARRAY<DOUBLE>")
    rows = R.cosine_topk(docs, q, k=5).orderBy("rank").collect()
    assert [r["doc_id"] for r in rows] == [1, 2]  # tie -> lower id first; zero vector never returned


def test_label_centroids(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (0, [3.0, 4.0]), (1, [5.0, 5.0])],
                               "label INT, embedding ARRAY<DOUBLE>")
    got = {r["label"]: r["centroid"] for r in R.label_centroids(df).collect()}
    assert got == {0: [2.0, 3.0], 1: [5.0, 5.0]}


def _tok(s):
    import regex

    return [t for t in regex.split(r"[^\p{L}\p{N}]+", s.lower()) if t]


def test_lexical_topk_brute_force(spark):
    docs = pd.DataFrame({"id": ["a", "b", "c", "d"],
                         "text": ["the cat sat", "the dog sat down", "cats and dogs", "Кошка сидит"]})
    qs = pd.DataFrame({"qid": [1, 2], "text": ["the cat", "кошка и собака"]})
    got = R.lexical_topk(spark.createDataFrame(docs), spark.createDataFrame(qs), 2, ["id"], ["qid"]).collect()
    want = []
    for _, q in qs.iterrows():
        qc = Counter(_tok(q["text"]))
        scored = []
        for _, d in docs.iterrows():
            dc = Counter(_tok(d["text"]))
            dot = sum(qc[t] * dc[t] for t in qc)
            if dot:
                sim = dot / (math.sqrt(sum(v * v for v in qc.values())) * math.sqrt(sum(v * v for v in dc.values())))
                scored.append((-sim, d["id"]))
        for rank, (s, i) in enumerate(sorted(scored)[:2], 1):
            want.append((q["qid"], rank, i, round(-s, 12)))
    assert sorted((r["qid"], r["rank"], r["id"], round(r["similarity"], 12)) for r in got) == sorted(want)


def test_answer_and_prompt(spark):
    docs = spark.createDataFrame([("d1", "NPL rose in 2024"), ("d2", "Assets grew"), ("d3", "other")],
                                 "id STRING, text STRING")
    qs = spark.createDataFrame([(1, "NPL 2024?"), (2, "zzz")], "qid INT, question STRING")
    rows = {r["qid"]: r for r in R.answer_questions(qs, docs, k=2).collect()}
    assert rows[1]["context"] == "NPL rose in 2024"
    assert rows[1]["answer"] == "Context:\nNPL rose in 2024"
    assert rows[1]["prompt"].startswith("You are an analyst")
    assert "Question: NPL 2024?" in rows[1]["prompt"]
    assert rows[2]["answer"] == "Context:\n"


def test_repeated_questions_get_whole_contexts(spark):
    """Equal questions -- under one id or two -- see the same best hits."""
    docs = spark.createDataFrame([("d1", "npl npl"), ("d2", "npl and more"), ("d3", "other")], "id STRING, text STRING")
    qs = spark.createDataFrame([(1, "npl"), (2, "npl"), (2, "npl"), (3, None)], "qid INT, question STRING")
    got = sorted((r["qid"], r["context"]) for r in R.answer_questions(qs, docs, k=2).collect())
    both = "npl npl\n\nnpl and more"
    assert got == [(1, both), (2, both), (2, both), (3, "")]


def test_routes(spark):
    yearly = spark.createDataFrame([(2023, 2, 1e9, 1.0), (2024, 3, 2e9, 2.0)],
                                   "year INT, mfo_count BIGINT, total_assets DOUBLE, avg_npl_pct DOUBLE")
    seg = spark.createDataFrame([(2024, "non_leaders", 2, 1e9, 3.0), (2024, "leaders", 1, 1e9, 1.0)],
                                "year INT, segment STRING, mfo_count BIGINT, total_assets DOUBLE, avg_npl_pct DOUBLE")
    top = spark.createDataFrame([(2023, 1, "B", 1e9, 1.0), (2024, 1, "A", 2e9, 2.0)],
                                "year INT, rank INT, mfo_name STRING, assets DOUBLE, npl_pct DOUBLE")
    sources = spark.createDataFrame([(2024, "x.xlsx", 5), (2024, "y.xlsx", 6), (2023, "x.xlsx", 7)], "year INT, file STRING, n_records BIGINT")
    docs = spark.createDataFrame([("d", "overview of npl")], "id STRING, text STRING")
    qs = spark.createDataFrame([(1, "NPL of 2024 and 2023"), (2, "top firm"), (3, "leaders in 2024"), (4, "npl of 2050"), (5, "overview")],
                               "qid INT, question STRING")
    got = {r["qid"]: r for r in R.hybrid_answers(qs, yearly, seg, top, sources, docs).collect()}
    assert [got[k]["route"] for k in range(1, 6)] == ["yearly", "ranking", "segment", "semantic", "semantic"]
    assert got[1]["context"].split("\n\n") == ["2023: 2 MFOs, Assets 1.0B KZT, NPL 1.00%", "2024: 3 MFOs, Assets 2.0B KZT, NPL 2.00%",
                                               "overview of npl"]
    assert got[2]["context"] == "2024 no. 1: A, Assets 2.0B KZT, NPL 2.00%"
    assert got[3]["context"].startswith("2024 leaders: 1 firms")
    assert got[4]["context"] == "overview of npl" and got[4]["n_sources"] == 0 and got[1]["n_sources"] == 2


@pytest.mark.parametrize("question,want", [
    ("Is this the first time in 2000 you saw leaders?", ["segment"]),
    ("Who are the top three and the segments of 2000?", ["ranking", "segment"]),
    ("Кто крупнейший в 2000 году?", ["ranking"]), ("Обзор рынка за 2000 год", ["yearly"]),
    ("Сегменты и рейтинг 2000", ["ranking", "segment"]), ("2000 жылғы нарық шолуы", ["yearly"]),
    ("2000 жылғы ең ірі ұйым", ["ranking"]), ("2000년 상위 회사는?", ["ranking"]), ("2000년 시장 부문 비교", ["segment", "yearly"]),
    ("average NPL of market leaders in 2000", ["segment", "yearly"]), ("topics of 2000", []), ("the first small step", []), (None, [])])
def test_asked_tables(spark, question, want):
    from periodix.operators.routing import asked_tables

    df = spark.createDataFrame([(question,)], "q STRING")
    words = F.coalesce(R.tokens(F.col("q")), F.array().cast("array<string>"))
    assert df.select(asked_tables(words).alias("k")).first()["k"] == want


def test_thousands(spark):
    from periodix.functions.columns import fmt_thousands

    xs = [0.0, 999.0, 1234567.5, 2.5, -1234.0, None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x DOUBLE").select(fmt_thousands(F.col("x"))).collect()]
    assert got == [None if x is None else f"{x:,.0f}" for x in xs]


def test_summary_lines_format(spark):
    yearly = spark.createDataFrame([(2024, 3, 386706828.0, 14.831986), (2023, 2, 0.125e9, None)],
                                   "year INT, mfo_count BIGINT, total_assets DOUBLE, avg_npl_pct DOUBLE")
    rows = [r["text"] for r in T.summary_lines(yearly).orderBy("line_no").collect()]
    assert rows == ["Market Overview",
                    f"2023: 2 MFOs, Assets {0.125:.1f}B KZT, NPL nan%",
                    f"2024: 3 MFOs, Assets {0.386706828:.1f}B KZT, NPL {14.831986:.2f}%"]


def test_metadata_filter(spark):
    docs = spark.createDataFrame([("a", {"type": "summary"}), ("b", {"type": "doc"})],
                                 "id STRING, metadata MAP<STRING,STRING>")
    assert [r["id"] for r in R.metadata_filter(docs, type="summary").collect()] == ["a"]


def test_batch_question_file(spark):
    from periodix.sources.sinks import read_questions, write_answers

    d = tempfile.mkdtemp(prefix="periodix-q-")
    with open(os.path.join(d, "queries.txt"), "w") as fh:
        fh.write("Any NPL of 2024?\n\nWho leads?\nAny NPL of 2024?\n")
    qs = read_questions(spark, d)
    docs = spark.createDataFrame([("d1", "2024 NPL 7.6%")], "id STRING, text STRING")
    ans = R.answer_questions(qs, docs, k=2)
    out = os.path.join(d, "results")
    write_answers(ans, out)
    recs = [json.loads(line) for f in os.listdir(out) if f.endswith(".json")
            for line in open(os.path.join(out, f))]
    assert sorted(r["question"] for r in recs) == ["Any NPL of 2024?", "Any NPL of 2024?", "Who leads?"]
    assert len({r["qid"] for r in recs}) == 3
    assert {r["context"] for r in recs if "2024" in r["question"]} == {"2024 NPL 7.6%"}


def test_cosine_plan_has_no_cartesian(spark):
    emb = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    cents = R.label_centroids(emb).select(F.col("label").alias("qid"), F.col("centroid").alias("vec"))
    plan = R.cosine_topk(emb, cents, k=3)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_retrieval_keeps_questions_off_the_driver(spark, monkeypatch):
    """Blocks are joined on Spark: building the plan collects nothing, partial
    rows have no text column, and small blocks give the same rows."""
    docs = spark.range(500).select(F.concat(F.lit("d"), "id").alias("id"),
                                   F.concat_ws(" ", F.lit("npl"), F.col("id") % 7, F.col("id") % 11).alias("text"))
    qs = spark.range(90).select("id", F.concat_ws(" ", F.lit("npl of"), F.col("id") % 9, F.col("id") % 5).alias("question"))
    monkeypatch.setattr(type(docs), "collect", lambda self: pytest.fail("collected"))
    monkeypatch.setattr(type(docs), "toArrow", lambda self: pytest.fail("collected"))
    plan = R.answer_questions(qs, docs, k=2, qid="id")
    monkeypatch.undo()
    lines = plan._jdf.queryExecution().executedPlan().toString().splitlines()
    scored = [ln for ln in lines if "MapInPandas run" in ln and "similarity" in ln]
    assert scored and not any("_dtext" in ln for ln in scored)
    want = sorted(map(tuple, plan.collect()))
    monkeypatch.setattr(R, "DOC_ROWS", 17)
    monkeypatch.setattr(R, "QUERY_ROWS", 5)
    assert sorted(map(tuple, R.answer_questions(qs, docs.repartition(5), k=2, qid="id").collect())) == want


def _hashing_encoder(texts: pd.Series, dim: int = 64) -> list:
    """The default encoder's vectors, text by text."""
    out = []
    for text in texts:
        vec = np.zeros(dim)
        for tok in _tok(text or ""):
            h = int(hashlib.md5(tok.encode()).hexdigest()[:8], 16)
            vec[h % dim] += 1.0 if h < 1 << 31 else -1.0
        n = np.linalg.norm(vec)
        out.append(vec / n if n else vec)
    return out


def test_custom_encoder(spark):
    """Any function from texts to vectors plugs in."""
    from periodix.operators import encoding as EN

    docs = spark.createDataFrame([("a", "xx"), ("b", None), ("c", "xxxx")], "id STRING, text STRING")
    lengths = lambda texts: [[len(t or ""), 1.0] for t in texts]
    got = {r["id"]: r["embedding"] for r in EN.embed(docs, encoder=lengths).collect()}
    assert got == {"a": [2.0, 1.0], "b": [0.0, 1.0], "c": [4.0, 1.0]}


def test_jvm_encoder_equals_python_hook(spark):
    """The JVM default encoder and the Python hook give the same vectors."""
    from periodix.operators import encoding as EN

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, "... !!"), (-4, "Ещё раз: NPL 7,6%")],
                                  "doc_id BIGINT, text STRING")
    docs = docs.unionByName(extra)
    got = {r["doc_id"]: np.asarray(r["embedding"]) for r in EN.embed(docs, "text", "embedding").collect()}
    rows = docs.collect()
    want = _hashing_encoder(pd.Series([r["text"] for r in rows]))
    assert len(got) == len(rows)
    for r, w in zip(rows, want):
        assert got[r["doc_id"]].shape == (EN.DEFAULT_DIM,)
        assert np.array_equal(got[r["doc_id"]], w), r["doc_id"]
    assert not got[-1].any() and not got[-3].any()
    assert abs(np.linalg.norm(got[-4]) - 1.0) < 1e-12


@pytest.mark.parametrize("share", [0.0, 0.01, 0.2, 2.0])
def test_dense_term_path_equals_sparse(monkeypatch, share):
    """Frequent terms through the dense product give the exact sparse dots."""
    rng = np.random.default_rng(7)
    nq, n_docs, vocab = 37, 53, 40
    zipf = 1.0 / np.arange(1, vocab + 1)
    rows = [[f"t{t}" for t in rng.choice(vocab, rng.integers(0, 12), p=zipf / zipf.sum())] for _ in range(nq)]
    terms, ptr, post_q, post_tf, _ = R._postings(rows)
    entries = {(int(d), int(t)): int(rng.integers(1, 4))
               for d, t in zip(rng.integers(0, n_docs, 400), rng.choice(len(terms), 400))}
    d_of = np.array([d for d, _ in entries], dtype=np.int64)
    term = np.array([t for _, t in entries], dtype=np.int64)
    tf = np.array(list(entries.values()), dtype=np.float64)
    want = R._sparse_dot(d_of, term, tf, ptr, post_q, post_tf, n_docs, nq)
    monkeypatch.setattr(R, "_DENSE_TERM_SHARE", share)
    got = R._dot(d_of, term, tf, ptr, post_q, post_tf, n_docs, nq)
    assert np.array_equal(got, want)


def _token_blocks(rng, n, vocab=300):
    share = 1.0 / np.arange(1, vocab + 1)
    texts = [[f"t{t}" for t in rng.choice(vocab, rng.integers(0, 25), p=share / share.sum())] for _ in range(n)]
    return np.array([np.array(t, dtype=object) for t in texts] + [None], dtype=object)[:-1]


def test_bounds_spare_products_and_lose_nothing(monkeypatch):
    """The scorer multiplies few pairs term by term (not every question with
    every document), and finds what scoring all pairs finds, ties included."""
    rng = np.random.default_rng(11)
    asked, docs, k = _token_blocks(rng, 60), _token_blocks(rng, 900), 3
    docs[500:520] = [docs[3]] * 20  # ties are won by the smaller id
    counted, searched = [], np.searchsorted
    queries = R._postings(asked)
    qids = [R._term_counts(docs[lo:lo + 300]) for lo in range(0, 900, 300)]
    want = R._TopK(60, k)
    for lo, block in zip(range(0, 900, 300), qids):
        d_of, code, tf, terms, norm = block
        term = pd.Index(queries[0]).get_indexer(terms)[code]
        some = term >= 0
        dot = R._dot(d_of[some], term[some], tf[some], queries[1], queries[2], queries[3], 300, 60)
        with np.errstate(divide="ignore", invalid="ignore"):
            sims = dot / (queries[4][:, None] * norm[None, :])
        sims[dot == 0] = -np.inf
        want.offer(sims, [np.array([f"d{i}" for i in range(lo, lo + 300)], dtype=object)])
    monkeypatch.setattr(R, "_FIRST_DOCS", 20)
    whole = R._dot

    def dot(*args):
        counted.append(args[-2])
        return whole(*args)

    def search(where, what, *args, **kw):
        counted.append(len(what) / (20 * 60) if np.ndim(what) else 0)  # entries of about 20 terms a pair
        return searched(where, what, *args, **kw)

    monkeypatch.setattr(R, "_dot", dot)
    monkeypatch.setattr(R.np, "searchsorted", search)
    got = R._TopK(60, k)
    score = R._token_scorer(list(queries), got)
    for lo, block in zip(range(0, 900, 300), qids):
        score(list(block), [np.array([f"d{i}" for i in range(lo, lo + 300)], dtype=object)])
    monkeypatch.undo()
    rows = lambda top: sorted(zip(top.row.tolist(), top.sim.tolist(), top.ids[0].tolist()))
    assert rows(got) == rows(want)
    assert sum(counted) < 900 / 3  # documents' worth of whole products


def test_grid_copies_the_longer_side_least():
    """Many questions on a few lines: each question block goes to one cell."""
    assert R._grid(30, 1_000_000, 4096, 4096, 36) == (36, 1)
    assert R._grid(5_000_000, 140_000, 4096, 4096, 36) == (1, 36)
    assert R._grid(5, 5, 4096, 4096, 36) == (1, 1) == R._grid(0, 0, 4096, 4096, 36)
    for n_docs, n_queries in ((20_000, 20_000), (9_000, 300_000), (41_000, 5_000)):
        rows, columns = R._grid(n_docs, n_queries, 4096, 4096, 24)
        assert rows * columns >= min(24, -(-n_docs // 4096) * -(-n_queries // 4096))
        assert rows <= -(-n_queries // 4096) and columns <= -(-n_docs // 4096)


def test_few_documents_go_to_many_questions(spark, monkeypatch):
    """A few lines and many questions: the lines are copied, no question is."""
    seen, blocks = [], R._blocks
    monkeypatch.setattr(R, "QUERY_ROWS", 5)
    monkeypatch.setattr(R, "_blocks", lambda *a: seen.append(a[-1]) or blocks(*a))
    docs = spark.createDataFrame([("a", "npl of 3"), ("b", "npl")], "doc STRING, text STRING")
    qs = spark.range(90).select("id", F.concat_ws(" ", F.lit("npl of"), F.col("id") % 9).alias("text"))
    got = R.lexical_topk(docs, qs, 1, ["doc"], ["id"])
    cells = min(18, int(spark.conf.get("spark.sql.shuffle.partitions")))
    assert seen == [1, cells]  # documents in one column, questions in all rows
    found = {r["id"]: r["doc"] for r in got.collect()}
    assert len(found) == 90 and all(found[i] == "a" for i in range(90))


def test_documents_stream_past_held_questions(spark, monkeypatch):
    """No join collects a cell's document blocks, and question blocks beyond
    those a task holds wait in a file: the results are the same."""
    docs = spark.range(300).select(F.col("id").cast("string").alias("doc"),
                                   F.concat_ws(" ", F.lit("npl"), F.col("id") % 7, F.col("id") % 11, F.col("id")).alias("text"))
    qs = spark.range(90).select("id", F.concat_ws(" ", F.lit("npl of"), F.col("id") % 9, F.col("id")).alias("text")).repartition(6)
    want = sorted(map(tuple, R.lexical_topk(docs, qs, 2, ["doc"], ["id"]).collect()))
    monkeypatch.setattr(R, "DOC_ROWS", 9)
    monkeypatch.setattr(R, "QUERY_ROWS", 5)
    monkeypatch.setattr(R, "HELD_BLOCKS", 1, raising=False)
    got = R.lexical_topk(docs, qs, 2, ["doc"], ["id"])
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, got.collect())) == want and len(want) == 180


def test_vectors_stream_past_held_questions(spark, monkeypatch):
    """The same for vectors: no join, one question block held at a time."""
    rng = np.random.default_rng(8)
    vecs, asked = rng.normal(size=(200, 8)), rng.normal(size=(40, 8))
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "vec_id LONG, embedding ARRAY<DOUBLE>")
    qs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "qid LONG, vec ARRAY<DOUBLE>")
    monkeypatch.setattr(R, "DOC_ROWS", 9)
    monkeypatch.setattr(R, "QUERY_ROWS", 5)
    monkeypatch.setattr(R, "HELD_BLOCKS", 1, raising=False)
    got = R.cosine_topk(docs, qs, 3, dim=8)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    sims = (asked @ vecs.T) / np.outer(np.linalg.norm(asked, axis=1), np.linalg.norm(vecs, axis=1))
    best = {(r["qid"], r["rank"]): r["doc_id"] for r in got.collect()}
    assert best == {(i, k + 1): int(d) for i in range(40) for k, d in enumerate(np.argsort(-sims[i])[:3])}
