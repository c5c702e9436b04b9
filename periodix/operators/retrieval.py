"""Exact cosine retrieval, dense and lexical.

Questions meet documents in a blocked theta-join (J3).  Both sides are packed
into block rows inside their tasks (``DOC_ROWS`` documents, ``QUERY_ROWS``
questions at most): vectors become a matrix, token lists a small inverted index.
The blocks meet in a grid: a document block goes to every cell of one column, a
question block to every cell of one row, and one shuffle by the cell, sorted,
brings a cell's question blocks to a task and then its document blocks, one by
one.  ``_grid`` chooses rows and columns by the counts of both sides, so that
the longer side is copied least.  A pair of blocks is
scored in numpy -- one matrix product, or bounds that leave few pairs of texts
to multiply term by term -- and a task keeps only the best ``k`` documents of a
question; a group-limited ``row_number`` merges the columns.  So neither side
passes the driver, no row of a pair of documents exists, a task holds
``HELD_BLOCKS`` question blocks and one document block at a time however many
meet in its cell, and partial rows carry ids and similarities only: the texts of
the winners are joined at the end.

Every ranking is a total order: similarity desc, then document id asc.
"""

from __future__ import annotations

import pickle
import tempfile

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from periodix.operators import text as T
from periodix.operators.routing import asked_tables

TOKEN_SPLIT = r"[^\p{L}\p{N}]+"
DOC_ROWS = 4096       # documents of a block
QUERY_ROWS = 4096     # questions of a block
HELD_BLOCKS = 12      # question blocks that a task holds
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20  # of blocks handed to a worker at once
BLOCK_BYTES = 8 << 20  # of a block of vectors


# --- exact per-partition top-k -------------------------------------------

class _TopK:
    """Running exact top-k per question over candidate batches.

    Order: similarity desc, then document id columns asc -- the same total
    order the final Spark ``row_number`` uses, so keeping k per partition
    never drops a global winner, ties included.
    """

    def __init__(self, nq: int, k: int):
        self.nq, self.k = nq, k
        self.row = np.empty(0, dtype=np.int64)
        self.sim = np.empty(0, dtype=np.float64)
        self.ids: list[np.ndarray] | None = None
        self.thr = np.full(nq, -np.inf)

    def offer(self, sims: np.ndarray, ids: list[np.ndarray]) -> None:
        """``sims``: (nq, B) with -inf for "no match"; ``ids``: B-long arrays."""
        nq, b = sims.shape
        if b == 0:
            return
        if b > self.k:
            kth = -np.partition(-sims, self.k - 1, axis=1)[:, self.k - 1]
        else:
            kth = np.full(nq, -np.inf)
        keep = (sims >= kth[:, None]) & (sims >= self.thr[:, None]) & np.isfinite(sims)
        r, c = np.nonzero(keep)
        self.add(r, sims[r, c], [col[c] for col in ids])

    def add(self, row: np.ndarray, sim: np.ndarray, ids: list[np.ndarray]) -> None:
        """Pairs of a question (``row``) and a document; only the questions
        that have one are sorted anew."""
        if len(row) == 0:
            return
        asked = np.zeros(self.nq, bool)
        asked[row] = True
        if self.ids is None:
            self.ids = [col[:0] for col in ids]
        again = asked[self.row]
        rest_row, rest_sim, rest_ids = self.row[~again], self.sim[~again], [o[~again] for o in self.ids]
        row = np.concatenate([self.row[again], row])
        sim = np.concatenate([self.sim[again], sim])
        ids_all = [np.concatenate([o[again], n]) for o, n in zip(self.ids, ids)]
        order = np.lexsort([_sortable(col) for col in reversed(ids_all)] + [-sim, row])
        row, sim = row[order], sim[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row, side="left")
        sel = rank < self.k
        last = rank == self.k - 1
        self.thr[row[last]] = sim[last]
        self.row = np.concatenate([rest_row, row[sel]])
        self.sim = np.concatenate([rest_sim, sim[sel]])
        self.ids = [np.concatenate([o, n[order][sel]]) for o, n in zip(rest_ids, ids_all)]


def _sortable(col: np.ndarray) -> np.ndarray:
    if col.dtype.kind in "iufb":
        return col
    # strings: code-point order == Spark's UTF-8 byte order
    return np.unique(col.astype(str), return_inverse=True)[1]


def spread(df: DataFrame) -> DataFrame:
    """Text and vector work is CPU-bound per row: when a table read has fewer
    partitions than the cluster has cores (e.g. one large row group), deal
    rows out round-robin so every core works; a well-partitioned input (the
    normal case at scale) is returned untouched, with no shuffle.

    Apply it to a file read, where counting partitions plans only the scan.
    The joins below do not call it: on a derived input (after a shuffle)
    counting partitions would execute the whole upstream plan once more."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _out_schema(queries: DataFrame, qcols: list[str], docs: DataFrame, doc_ids: list[str]) -> str:
    cols = [f"`{c}` {queries.schema[c].dataType.simpleString()}" for c in qcols]
    cols += [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in doc_ids]
    return ", ".join(cols + ["similarity DOUBLE"])


# --- blocks -------------------------------------------------------------------

def _blocks(df: DataFrame, ids: list[str], values: list[str], pack, rows: int, lines: int) -> DataFrame:
    """``line, block``: the rows of ``df`` in blocks of at most ``rows``, each
    the ids and ``pack(*values)``; a partition's blocks go to the lines (rows or
    columns of the grid) in turn."""
    def run(batches):
        at = TaskContext.get().partitionId()
        for pdf in batches:
            for lo in range(0, len(pdf), rows):
                part = pdf.iloc[lo:lo + rows]
                block = ([part[c].to_numpy() for c in ids], *pack(*[part[v].to_numpy() for v in values]))
                yield pd.DataFrame({"line": [at % lines], "block": [pickle.dumps(block, 5)]})
                at += 1

    return df.select(*dict.fromkeys([*ids, *values])).mapInPandas(run, "line INT, block BINARY")


def _grid(n_docs: int, n_queries: int, doc_rows: int, query_rows: int, cells: int) -> tuple[int, int]:
    """``(rows, columns)`` of the grid: about ``cells`` cells, no more lines
    than blocks, and the fewest copied rows -- questions go to every column,
    documents to every row."""
    most_rows, most_columns = max(1, -(-n_queries // query_rows)), max(1, -(-n_docs // doc_rows))
    shapes = [(min(most_rows, -(-cells // c)), c) for c in range(1, min(most_columns, cells) + 1)]
    whole = min(cells, most_rows * most_columns)
    enough = [(r, c) for r, c in shapes if r * c >= whole] or shapes[-1:]
    return min(enough, key=lambda s: n_queries * s[1] + n_docs * s[0])


def blocked_topk(docs: DataFrame, doc_ids: list[str], queries: DataFrame, qcols: list[str], values: list[str],
                 k: int, pack_docs, pack_queries, scorer, doc_rows: int, query_rows: int) -> DataFrame:
    """The best ``k`` documents of every question over all pairs of blocks:
    ``scorer(question block, _TopK)`` makes the function that takes each
    document block and its ids and offers what it finds."""
    spark = docs.sparkSession
    size = spark.conf.get(BATCH_CONF)
    if not size.rstrip("bB").isdigit() or int(size.rstrip("bB")) > BATCH_BYTES or int(size.rstrip("bB")) <= 0:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))
    cells = max(2, min(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism))
    n_rows, n_columns = _grid(docs.count(), queries.count(), doc_rows, query_rows, cells)
    schema = _out_schema(queries, qcols, docs, doc_ids)
    to_all = lambda n, cell: F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), cell)).alias("cell")
    d = _blocks(docs, doc_ids, values, pack_docs, doc_rows, n_columns).select(
        to_all(n_rows, lambda row: row * n_columns + F.col("line")), F.col("block").alias("_d"))
    q = _blocks(queries, qcols, values, pack_queries, query_rows, n_rows).select(
        to_all(n_columns, lambda column: F.col("line") * n_columns + column), F.col("block").alias("_q"))
    # a number of partitions of its own: block rows are few and small, and a
    # cell must not be merged with others by its bytes
    met = (q.select("cell", F.lit(0).alias("role"), F.col("_q").alias("block"))
           .union(d.select("cell", F.lit(1), "_d"))
           .repartition(2 * n_rows * n_columns, "cell").sortWithinPartitions("cell", "role"))
    most = HELD_BLOCKS

    def run(batches):
        name, cell = None, _Meeting(k, scorer, most)
        for pdf in batches:
            for at, role, block in zip(pdf["cell"], pdf["role"], pdf["block"]):
                if at != name:
                    for top, qids in cell.results():
                        yield _emit(top, qids, qcols, doc_ids)
                    name, cell = at, _Meeting(k, scorer, most)
                (cell.document if role else cell.question)(block)
        for top, qids in cell.results():
            yield _emit(top, qids, qcols, doc_ids)

    w = Window.partitionBy(*qcols).orderBy(F.desc("similarity"), *[F.asc(c) for c in doc_ids])
    return (met.mapInPandas(run, schema).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select(*qcols, "rank", *doc_ids, "similarity"))


class _Meeting:
    """One cell's blocks, in order: questions, then documents.  ``most``
    question blocks are held at a time; further ones wait in a local file and
    with them the documents, which then come by once more."""

    def __init__(self, k: int, scorer, most: int):
        self.k, self.scorer, self.most = k, scorer, most
        self.held: list[tuple] = []
        self.questions = self.documents = None

    def _hold(self, block: bytes) -> None:
        qids, *packed = pickle.loads(block)
        top = _TopK(len(qids[0]), self.k)
        self.held.append((top, qids, self.scorer(packed, top)))

    def _score(self, block: bytes) -> None:
        ids, *packed = pickle.loads(block)
        for _, _, score in self.held:
            score(packed, ids)

    def question(self, block: bytes) -> None:
        if len(self.held) < self.most:
            self._hold(block)
        else:
            if self.questions is None:
                self.questions, self.documents = tempfile.TemporaryFile(), tempfile.TemporaryFile()
            pickle.dump(block, self.questions, 5)

    def document(self, block: bytes) -> None:
        if self.held:
            self._score(block)
            if self.documents is not None:
                pickle.dump(block, self.documents, 5)

    def results(self):
        """The best documents of every block of questions, and their ids."""
        waiting = _read_back(self.questions)
        while self.held:
            yield from ((top, qids) for top, qids, _ in self.held if len(top.row))
            self.held = []
            for block in waiting:
                self._hold(block)
                if len(self.held) == self.most:
                    break
            if self.held:
                for block in _read_back(self.documents):
                    self._score(block)


def _read_back(file):
    if file is not None:
        file.seek(0)
        while True:
            try:
                yield pickle.load(file)
            except EOFError:
                return


def _emit(top: _TopK, qvals: list[np.ndarray], qcols: list[str], doc_ids: list[str]) -> pd.DataFrame:
    data = {c: v[top.row] for c, v in zip(qcols, qvals)}
    data.update(dict(zip(doc_ids, top.ids)))
    data["similarity"] = top.sim
    return pd.DataFrame(data)


# --- dense ------------------------------------------------------------------

def label_centroids(vectors: DataFrame, label: str = "label", vec: str = "embedding") -> DataFrame:
    """Mean vector per label, ``(label, centroid ARRAY<DOUBLE>)``.

    ``posexplode`` + partial aggregation on (label, dim): each map task ships
    at most labels x dims partial sums, however many vectors a label has.
    """
    parts = vectors.select(label, F.posexplode(vec).alias("i", "x"))
    means = parts.groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("v"))
    return means.groupBy(label).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("centroid")
    )


def _pack_vectors(values: np.ndarray) -> tuple:
    mat = np.array([np.asarray(v, dtype=np.float64) for v in values])
    return mat, np.linalg.norm(mat, axis=1)


def _vector_scorer(queries: list, top: _TopK):
    qmat, qnorm = queries

    def score(docs: list, ids: list[np.ndarray]) -> None:
        mat, dnorm = docs
        step = max(1, _CELLS_PER_STEP // max(len(qnorm), 1))  # bounds the (nq x B) block
        for lo in range(0, len(dnorm), step):
            with np.errstate(divide="ignore", invalid="ignore"):
                sims = (qmat @ mat[lo:lo + step].T) / np.outer(qnorm, dnorm[lo:lo + step])
            sims[~np.isfinite(sims)] = -np.inf
            top.offer(sims, [c[lo:lo + step] for c in ids])

    return score


def cosine_topk(docs: DataFrame, queries: DataFrame, k: int = 3, doc_id: str = "vec_id",
                doc_vec: str = "embedding", query_id: str = "qid", query_vec: str = "vec",
                dim: int = 64) -> DataFrame:
    """R6 + R7: exact top-k documents by cosine similarity per question.

    Returns ``(qid, rank, doc_id, similarity)``; fewer than ``k`` documents
    give fewer rows; documents with a zero or missing vector are never
    returned.  ``dim`` (the vectors' usual length) only sizes the blocks.
    """
    q = queries.select(F.col(query_id).alias("qid"), F.col(query_vec).alias("_vec")).dropna(subset=["_vec"])
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_vec).alias("_vec")).dropna(subset=["_vec"])
    rows = max(1, BLOCK_BYTES // (8 * dim))
    return blocked_topk(slim, ["doc_id"], q, ["qid"], ["_vec"], k, _pack_vectors, _pack_vectors, _vector_scorer,
                        min(DOC_ROWS, rows), min(QUERY_ROWS, rows))


# --- lexical ----------------------------------------------------------------

def tokens(text) -> "F.Column":
    """Lower-cased letter/digit runs of a text column (JVM-side)."""
    return F.filter(F.split(F.lower(text), TOKEN_SPLIT), lambda x: x != "")


def term_frequencies(df: DataFrame, ids: list[str], text_col: str = "text") -> DataFrame:
    """``(ids..., token, tf)`` term-frequency vectors as a table."""
    return (df.select(*ids, F.explode(tokens(F.col(text_col))).alias("token"))
            .groupBy(*ids, "token").agg(F.count(F.lit(1)).alias("tf")))


def _term_counts(toks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(row, code, tf)`` entries by row, the terms behind the codes, and the
    rows' norms."""
    lens = np.fromiter((0 if t is None else len(t) for t in toks), np.int64, len(toks))
    flat = np.concatenate([np.asarray(t, dtype=object) for t in toks if t is not None and len(t)] or [np.zeros(0, object)])
    codes, terms = pd.factorize(flat)
    key, tf = np.unique(np.repeat(np.arange(len(toks)), lens) * max(len(terms), 1) + codes, return_counts=True)
    row, code = key // max(len(terms), 1), key % max(len(terms), 1)
    tf = tf.astype(np.float64)
    return row, code, tf, terms, np.sqrt(np.bincount(row, weights=tf * tf, minlength=len(toks)))


def _postings(toks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The inverted index of a block of questions: terms, and per term the
    questions that have it and how often."""
    row, code, tf, terms, norm = _term_counts(toks)
    order = np.argsort(code, kind="stable")
    ptr = np.searchsorted(code[order], np.arange(len(terms) + 1))
    return terms, ptr.astype(np.int64), row[order], tf[order], norm


# Memory bounds inside one task: at most this many (question, document)
# similarity cells and this many term-postings products per step.
_CELLS_PER_STEP = 2_000_000
_PRODUCTS_PER_STEP = 8_000_000
# A term whose (share of the step's documents) x (share of the questions)
# reaches this goes through one dense matrix product instead of the sparse
# postings expansion: a BLAS multiply-add is far cheaper than a scattered one,
# so the dense path wins once a term touches this share of all cells.
_DENSE_TERM_SHARE = 0.01
# Sketches: their columns, how many have one term only, and how many documents
# are scored without them while a question has no similarity to reach.
_COLUMNS = 512
_OWN_COLUMNS = 64
_FIRST_DOCS = 256


def _sparse_dot(d_of, term, tf, ptr, post_q, post_tf, n_docs: int, nq: int) -> np.ndarray:
    """Exact (nq, n_docs) dot products from (doc, term, tf) entries and the
    question postings, expanded in chunks of at most _PRODUCTS_PER_STEP."""
    dot = np.zeros(n_docs * nq)
    start = ptr[term]
    cnt = ptr[term + 1] - start
    ends = np.cumsum(cnt)
    lo = 0
    while lo < len(term):
        hi = int(np.searchsorted(ends, (ends[lo] - cnt[lo]) + _PRODUCTS_PER_STEP, side="right"))
        hi = max(hi, lo + 1)
        c = cnt[lo:hi]
        total = int(c.sum())
        if total:
            rep = np.repeat(np.arange(lo, hi), c)
            pos = start[rep] + (np.arange(total) - np.repeat(np.cumsum(c) - c, c))
            dot += np.bincount(d_of[rep] * nq + post_q[pos], weights=tf[rep] * post_tf[pos],
                               minlength=n_docs * nq)
        lo = hi
    return dot.reshape(n_docs, nq).T


def _dense_terms(term: np.ndarray, n_docs: int, ptr: np.ndarray, nq: int) -> np.ndarray:
    """Frequent terms of this step (e.g. function words), most frequent
    first, at most as many as keep both dense blocks within _CELLS_PER_STEP."""
    in_docs = np.bincount(term, minlength=len(ptr) - 1)  # (doc, term) entries are unique
    share = (in_docs / max(n_docs, 1)) * (np.diff(ptr) / max(nq, 1))
    cand = np.nonzero(share >= _DENSE_TERM_SHARE)[0]
    cap = _CELLS_PER_STEP // max(nq, n_docs, 1)
    return cand[np.argsort(-share[cand], kind="stable")][:cap]


def _dot(d_of, term, tf, ptr, post_q, post_tf, n_docs: int, nq: int) -> np.ndarray:
    """Exact (nq, n_docs) dot products: frequent terms as one dense product
    (integer-valued doubles, so sums are exact), the rest sparse."""
    dense = _dense_terms(term, n_docs, ptr, nq)
    if len(dense) == 0:
        return _sparse_dot(d_of, term, tf, ptr, post_q, post_tf, n_docs, nq)
    col = np.full(len(ptr) - 1, -1, dtype=np.int64)
    col[dense] = np.arange(len(dense))
    c = col[term]
    m = c >= 0
    doc_block = np.zeros((len(dense), n_docs))
    doc_block[c[m], d_of[m]] = tf[m]
    lens = ptr[dense + 1] - ptr[dense]
    pos = np.repeat(ptr[dense] - np.cumsum(lens) + lens, lens) + np.arange(int(lens.sum()))
    q_block = np.zeros((nq, len(dense)))
    q_block[post_q[pos], np.repeat(np.arange(len(dense)), lens)] = post_tf[pos]
    dot = q_block @ doc_block
    if not m.all():
        dot += _sparse_dot(d_of[~m], term[~m], tf[~m], ptr, post_q, post_tf, n_docs, nq)
    return dot


def _sketches(row: np.ndarray, column: np.ndarray, tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """A short vector per text: the length of its terms in each column, by
    Cauchy's inequality the product of two is at least the texts' cosine."""
    square = np.bincount(row * _COLUMNS + column, weights=tf * tf, minlength=len(norm) * _COLUMNS)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.nan_to_num(np.sqrt(square).reshape(-1, _COLUMNS) / norm[:, None]).astype(np.float32)


def _token_scorer(queries: list, top: _TopK):
    """Scores blocks of documents against one block of questions, exactly.

    Terms are dealt to ``_COLUMNS`` columns, the questions' most frequent ones
    alone in theirs.  The product of two texts' sketches bounds their cosine;
    only pairs whose bound reaches the question's ``k``-th similarity so far
    are multiplied term by term, those with the highest bounds first."""
    vocab, ptr, post_q, post_tf, qnorm = queries
    nq, n_terms, index = len(qnorm), max(len(vocab), 1), pd.Index(vocab)
    uses = np.diff(ptr)
    place = np.empty(len(vocab), np.int64)
    place[np.argsort(-uses, kind="stable")] = np.arange(len(vocab))
    column = np.where(place < _OWN_COLUMNS, place, _OWN_COLUMNS + place % (_COLUMNS - _OWN_COLUMNS))
    q_term = np.repeat(np.arange(len(vocab)), uses)
    q_sketch = _sketches(post_q, column[q_term], post_tf, qnorm)
    q_key = post_q * n_terms + q_term
    order = np.argsort(q_key)
    q_key, q_tf = q_key[order], post_tf[order]

    def products(row, doc, term, tf, starts):
        """Exact dot products of pairs of a question and a document."""
        dot = np.zeros(len(row))
        cnt = starts[doc + 1] - starts[doc]
        ends = np.cumsum(cnt)
        lo = 0
        while lo < len(row):
            hi = max(int(np.searchsorted(ends, ends[lo] - cnt[lo] + _PRODUCTS_PER_STEP, side="right")), lo + 1)
            c = cnt[lo:hi]
            pair = np.repeat(np.arange(hi - lo), c)
            pos = np.arange(int(c.sum())) + np.repeat(starts[doc[lo:hi]] - np.cumsum(c) + c, c)
            key = row[lo:hi][pair] * n_terms + term[pos]
            at = np.minimum(np.searchsorted(q_key, key), len(q_key) - 1)
            hit = q_key[at] == key
            dot[lo:hi] = np.bincount(pair[hit], weights=q_tf[at[hit]] * tf[pos[hit]], minlength=hi - lo)
            lo = hi
        return dot

    def least():
        """Bounds a pair has to reach, a little low for their rounding."""
        return np.where(np.isfinite(top.thr), top.thr * (1 - 1e-4), 1e-30).astype(np.float32)

    def score(docs: list, ids: list[np.ndarray]) -> None:
        d_of, code, tf, terms, dnorm = docs
        if not len(vocab) or not len(terms):
            return
        term = index.get_indexer(terms)[code]
        shared = term >= 0
        d_of, tf, term = d_of[shared], tf[shared], term[shared]
        starts = np.searchsorted(d_of, np.arange(len(dnorm) + 1))  # entries are in order of documents

        def verify(row, doc):
            dot = products(row, doc, term, tf, starts)
            some = dot > 0
            row, doc = row[some], doc[some]
            sim = dot[some] / (qnorm[row] * dnorm[doc])
            some = sim >= top.thr[row]
            top.add(row[some], sim[some], [c[doc[some]] for c in ids])

        lo = 0
        if not np.isfinite(top.thr).all():  # nothing to compare with yet: a few whole
            lo = min(len(dnorm), _FIRST_DOCS)
            at = slice(0, starts[lo])
            dot = _dot(d_of[at], term[at], tf[at], ptr, post_q, post_tf, lo, nq)
            with np.errstate(divide="ignore", invalid="ignore"):
                sims = dot / (qnorm[:, None] * dnorm[None, :lo])
            sims[dot == 0] = -np.inf
            top.offer(sims, [c[:lo] for c in ids])
        step = max(1, _CELLS_PER_STEP // max(nq, 1))  # bounds the (nq x B) block
        for lo in range(lo, len(dnorm), step):
            norm = dnorm[lo:lo + step]
            at = slice(starts[lo], starts[lo + len(norm)])
            bound = q_sketch @ _sketches(d_of[at] - lo, column[term[at]], tf[at], norm).T
            at = np.flatnonzero(bound >= least()[:, None])
            row, doc, bound = at // len(norm), at % len(norm), bound.ravel()[at]
            order = np.lexsort([-bound, row])
            row, doc, bound = row[order], doc[order] + lo, bound[order]
            best = np.arange(len(row)) - np.searchsorted(row, row, side="left") < 2 * top.k
            verify(row[best], doc[best])
            rest = ~best & (bound >= least()[row])
            verify(row[rest], doc[rest])

    return score


def lexical_topk(docs: DataFrame, queries: DataFrame, k: int, doc_ids: list[str],
                 query_ids: list[str], doc_text: str = "text", query_text: str = "text") -> DataFrame:
    """R7 over the lexical encoder (R8): ``(query ids, rank, doc ids, similarity)``.

    cosine = sum(tf_q * tf_d) / (|q| |d|) over shared tokens, exact.  Only
    documents sharing a token with the question can be returned.  Each pair of
    blocks is bounded by one product of short vectors; only pairs of texts that
    may be among the best are multiplied term by term (``_token_scorer``).
    """
    q = queries.select(*query_ids, tokens(F.col(query_text)).alias("_toks"))
    slim = docs.select(*doc_ids, tokens(F.col(doc_text)).alias("_toks"))
    return blocked_topk(slim, doc_ids, q, query_ids, ["_toks"], k, _term_counts, _postings, _token_scorer,
                        DOC_ROWS, QUERY_ROWS)


def metadata_filter(docs: DataFrame, **where: str) -> DataFrame:
    """Keep documents whose ``metadata`` map has every given entry."""
    out = docs
    for key, val in where.items():
        out = out.filter(F.col("metadata")[key] == F.lit(val))
    return out


# --- question answering -------------------------------------------------------

def answer_questions(questions: DataFrame, docs: DataFrame, k: int = 2, qid: str = "qid",
                     question: str = "question", doc_id: str = "id", doc_text: str = "text") -> DataFrame:
    """R15 (+R10-R12): batch QA over a question table, all in one plan.

    Every question row gets a row: ``context`` (top-k texts, best first),
    ``answer`` (context-only answer) and ``prompt``.  Each distinct question
    text is scored once, so repeated questions -- and even repeated ids --
    get the same context and cost no extra search.  Document ids are unique;
    only the winners' texts are joined back by them.
    """
    key = F.sha2(F.coalesce(F.col(question), F.lit("")), 256)
    asked = questions.select(qid, question, key.alias("_text"))
    distinct = asked.groupBy("_text").agg(F.first(question).alias("_question"))
    named = docs.select(F.col(doc_id).alias("_doc"), F.col(doc_text).alias("_dtext"))
    hits = lexical_topk(named, distinct, k, ["_doc"], ["_text"], "_dtext", "_question")
    ctx = T.contexts(hits.join(named, "_doc"), qid="_text", rank="rank", text="_dtext")
    out = asked.join(ctx, "_text", "left")
    return out.select(
        qid, question,
        F.coalesce(F.col("context"), F.lit("")).alias("context"),
        T.context_answer(F.col("context")).alias("answer"),
        T.prompt(F.col(question), F.col("context")).alias("prompt"),
    )


YEAR_PATTERN = r"((?:19|20)\d{2})"


def structured_facts(yearly: DataFrame, segments: DataFrame, top: DataFrame) -> DataFrame:
    """Lines ``(kind, year, no, line)`` of the three result tables."""
    figures = lambda: T.figures(F.col("assets"), F.col("npl"))
    year = F.col("year").cast("string")
    line = T.summary_line(F.col("year"), F.col("mfo_count"), F.col("total_assets"), F.col("avg_npl_pct"))
    market = yearly.select(F.lit("yearly").alias("kind"), "year", F.lit(0).alias("no"), line.alias("line"))
    parts = segments.withColumnsRenamed({"total_assets": "assets", "avg_npl_pct": "npl"}).select(
        F.lit("segment"), "year", F.when(F.col("segment") == "leaders", 0).otherwise(1),
        F.concat(year, F.lit(" "), F.col("segment"), F.lit(": "), F.col("mfo_count").cast("string"),
                 F.lit(" firms, "), figures()))
    ranks = top.withColumnsRenamed({"npl_pct": "npl"}).select(
        F.lit("ranking"), "year", "rank",
        F.concat(year, F.lit(" no. "), F.col("rank").cast("string"), F.lit(": "), F.col("mfo_name"), F.lit(", "), figures()))
    return market.union(parts).union(ranks)


def route_questions(questions: DataFrame, facts: DataFrame, qid: str = "qid", question: str = "question") -> DataFrame:
    """``(qid, kind, year)`` of the facts each question asks for.

    The kinds are the tables its words ask for (``routing``), the yearly table
    if they ask for none; the years are those the question names, or, for a
    ranking or segment question without one, the latest year there is.  A
    question that names no table has no row, nor has one whose years have no
    data: those are left to search.
    """
    named = F.array_distinct(F.regexp_extract_all(F.col(question), F.lit(YEAR_PATTERN), 1))
    q = questions.select(qid, asked_tables(F.coalesce(tokens(F.col(question)), F.array().cast("array<string>"))).alias("_kinds"),
                         named.alias("_years"))
    kinds = F.when(F.size("_kinds") == 0, F.array(F.lit("yearly"))).otherwise(F.col("_kinds"))
    q = q.select(qid, F.explode(kinds).alias("kind"), "_years")
    known = facts.select("kind", "year").distinct()
    latest = known.groupBy("kind").agg(F.max("year").alias("year"))
    by_year = q.select(qid, "kind", F.explode(F.col("_years").cast("array<int>")).alias("year")).join(known, ["kind", "year"])
    no_year = q.filter((F.size("_years") == 0) & (F.col("kind") != "yearly")).select(qid, "kind").join(latest, "kind")
    return by_year.select(qid, "kind", "year").unionByName(no_year.select(qid, "kind", "year"))


def hybrid_answers(questions: DataFrame, yearly: DataFrame, segments: DataFrame, top: DataFrame,
                   sources: DataFrame, docs: DataFrame, k: int = 2,
                   qid: str = "qid", question: str = "question") -> DataFrame:
    """R13 + R14: structured facts and search results in one context.

    Output: ``qid, question, route, context, answer, n_sources``: the route
    (``yearly``, ``segment``, ``ranking``, several joined by ``+``, or
    ``semantic`` for questions without structured facts), the facts of the
    asked years in order followed by the ``k`` nearest texts, and the number of source files behind the
    facts (listed by ``answer_sources``).  Ids must be unique.
    """
    facts = structured_facts(yearly, segments, top)
    routed = route_questions(questions, facts, qid, question)
    lines = F.array_sort(F.collect_list(F.struct("year", "kind", "no", "line")))  # a few lines per year asked
    structured = routed.join(facts, ["kind", "year"]).groupBy(qid).agg(
        F.array_join(F.array_sort(F.collect_set("kind")), "+").alias("_kind"),
        F.array_join(F.transform(lines, lambda x: x["line"]), T.CONTEXT_SEPARATOR).alias("_facts"))
    files = answer_sources(routed, sources, qid).groupBy(qid).agg(F.count(F.lit(1)).alias("_files"))
    found = answer_questions(questions, docs, k, qid, question).select(qid, question, F.col("context").alias("_near"))
    both = found.join(structured, qid, "left").join(files, qid, "left")
    near = F.when(F.col("_near") != "", F.col("_near"))
    context = F.concat_ws(T.CONTEXT_SEPARATOR, "_facts", near)
    return both.select(
        qid, question, F.coalesce(F.col("_kind"), F.lit("semantic")).alias("route"), context.alias("context"),
        T.context_answer(context).alias("answer"), F.coalesce(F.col("_files"), F.lit(0)).alias("n_sources"))


def answer_sources(routed: DataFrame, sources: DataFrame, qid: str = "qid") -> DataFrame:
    """The files behind each question's structured facts, one row per
    file, from ``sources(year, file, n_records)``."""
    return routed.select(qid, "year").distinct().join(sources, "year").groupBy(qid, "file").agg(
        F.sum("n_records").alias("n_records"))
