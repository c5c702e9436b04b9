"""Operator 12: whitening of embeddings by a bidiagonal qd solver.

1. Every entry ``c`` of a vector becomes the integer ``floor(64 c)``; the *fit
   list* has each distinct integer vector once (an aggregate by vector, so
   copies collapse in the map tasks), written to the shared folder.
2. ``n`` and the sums ``S`` are exact integers, added up on Spark.
3. Blockwise QR: each task folds its centred rows ``(n x - S) / n`` (exact up to
   the division) into one triangular factor, block by block; the factors are
   folded again in groups of ``FAN`` tasks until at most ``FAN`` are left, and
   those make one ``d x d`` factor R on the driver.
4. Householder reflections make R bidiagonal, dqds finds its singular values
   (``e`` is their square over n), and twisted factorisations give the right
   singular vectors of the bidiagonal, which the reflections turn into the
   covariance's eigenvectors.  Vectors of nearly equal values are made
   orthogonal to each other.
5. Each row is projected on the components; a further pass over the fit list
   sums up the whitened rows' covariance.

Defined results: a vector that is null, empty, or holds null or non-finite
entries is dropped; so are vectors whose length is not the table's (the most
frequent one, ties: the longest).  Entries beyond +-2^40 after scaling count as
+-2^40.  ``deviation`` is null where it does not fit a long.  Components whose
eigenvalue is zero to rounding (constant or dependent dimensions, fewer
vectors than dimensions) have no whitened value and are left out; one distinct
vector, or an empty table, gives no rows.  A null id is kept; repeated rows
give a row each.  Extra input columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from periodix.llm.common import prepare, shared_folder, table

SCALE = 64
COMPONENTS = 16
FAN = 32                # triangular factors folded into one
BLOCK = 1024            # rows of a QR block
FARTHEST = 1 << 40      # largest scaled entry
ROWS = 4096             # rows of one output batch
EPS = np.finfo(float).eps
CLOSE = 1e-3            # relative distance of eigenvalues whose vectors are made orthogonal


# --- the solver, on one small matrix ------------------------------------------

def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal and superdiagonal of ``U' r V`` and the reflectors of V."""
    b = np.array(r, float)
    d = b.shape[1]
    right = []
    for k in range(d):
        v = _reflector(b[k:, k])
        b[k:] -= np.outer(2 * v, v @ b[k:])
        if k < d - 2:
            v = _reflector(b[k, k + 1:])
            b[:, k + 1:] -= np.outer(b[:, k + 1:] @ (2 * v), v)
            right.append(v)
    return np.diag(b).copy(), np.diag(b, 1).copy(), right


def _reflector(x: np.ndarray) -> np.ndarray:
    """Unit v (or zero) so that x - 2 v (v'x) is a multiple of the first axis."""
    v = x.copy()
    size = np.linalg.norm(v)
    if not size or not np.any(v[1:]):
        return np.zeros(len(v))
    v[0] += math.copysign(size, v[0])
    return v / np.linalg.norm(v)


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squares of the singular values of an upper bidiagonal, falling, to high
    relative accuracy: qd transforms with shifts that stay below the smallest."""
    q, e = (diagonal ** 2).tolist(), (above ** 2).tolist()
    top = max(q + e, default=0.0)
    if not top:
        return np.zeros(len(q))
    q, e = [x / top for x in q], [x / top for x in e]
    out, parts = [], [(q, e, 0.0)]
    while parts:
        q, e, shift = parts.pop()
        guess, turns = 0.0, 0
        while q:
            turns += 1
            if turns > 1000 * (len(q) + 1):
                raise ArithmeticError("the qd iteration did not converge")
            n = len(q)
            if n == 1:
                out.append(shift + q[0])
                break
            cut = next((k for k in range(n - 1) if e[k] <= EPS * EPS * (shift + q[k])), None)
            if cut is not None and cut < n - 2:
                parts.append((q[:cut + 1], e[:cut], shift))
                q, e, guess = q[cut + 1:], e[cut + 1:], 0.0
                continue
            if e[-1] <= EPS * EPS * (shift + q[-1]) or e[-1] < 1e-290:
                out.append(shift + q.pop())
                e.pop()
                guess = 0.0
                continue
            for tau in (guess, guess / 2, 0.0):
                step = _qd_step(q, e, tau)
                if step:
                    break
            new_q, new_e, ds = step
            shift += tau
            q, e = new_q, new_e
            # the d are the reciprocals of the diagonal of an inverse: the
            # smallest bounds the smallest value from above, their harmonic
            # sum bounds it from below
            least = min(ds)
            below = 1 / sum(1 / x for x in ds) if least > 0 else 0.0
            guess = max(below * (1 - 4 * n * EPS), least * (1 - 1e-3) if ds[-1] == least and e[-1] < 1e-2 * least else 0.0)
    return np.sort(np.array(out))[::-1] * top


def _qd_step(q: list[float], e: list[float], tau: float):
    """One differential qd transform with shift ``tau``, or None if it is too large."""
    d = q[0] - tau
    new_q, new_e, ds = [], [], [d]
    for k, x in enumerate(e):
        if d < 0:
            return None
        s = d + x
        t = q[k + 1] / s if s else 0.0
        new_q.append(s)
        new_e.append(x * t)
        d = (d * t if s else q[k + 1]) - tau
        ds.append(d)
    if d < 0:
        return None
    new_q.append(d)
    return new_q, new_e, ds


def twisted_vector(diagonal: np.ndarray, above: np.ndarray, value: float) -> np.ndarray:
    """Unit eigenvector of B'B for the eigenvalue nearest ``value``, B an
    unreduced bidiagonal: both factorisations of B'B - value, joined where
    their meeting element is smallest."""
    n = len(diagonal)
    dd, ll = diagonal ** 2, above / diagonal[:-1]
    tiny = EPS * EPS * (float(np.max(dd)) + value) + 1e-300
    low, s = np.zeros(n - 1), np.zeros(n)
    s[0] = -value
    for k in range(n - 1):
        plus = s[k] + dd[k] or tiny
        low[k] = dd[k] * ll[k] / plus
        s[k + 1] = low[k] * ll[k] * s[k] - value
    up, p = np.zeros(n - 1), np.zeros(n)
    p[-1] = dd[-1] - value
    for k in range(n - 2, -1, -1):
        minus = dd[k] * ll[k] ** 2 + p[k + 1] or tiny
        up[k] = ll[k] * dd[k] / minus
        p[k] = p[k + 1] * dd[k] / minus - value
    meet = np.abs(s + p + value)
    at = int(np.argmin(np.where(np.isfinite(meet), meet, np.inf)))
    z = np.zeros(n)
    z[at] = 1
    for k in range(at - 1, -1, -1):
        z[k] = -low[k] * z[k + 1]
    for k in range(at, n - 1):
        z[k + 1] = -up[k] * z[k]
    z[~np.isfinite(z)] = 0
    return z / np.linalg.norm(z)


def _blocks(diagonal: np.ndarray, above: np.ndarray) -> list[tuple[int, int]]:
    """Ranges between superdiagonal entries that vanish to rounding."""
    size = max(np.max(np.abs(diagonal)), np.max(np.abs(above), initial=0))
    cuts = np.flatnonzero(np.abs(above) <= EPS * size) + 1
    edges = [0, *cuts.tolist(), len(diagonal)]
    return list(zip(edges, edges[1:]))


def eigen(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The largest eigenvalues of ``r'r`` that are not zero to rounding (at
    most ``most``), their unit eigenvectors as columns, and the sum of all."""
    d = r.shape[1]
    diagonal, above, right = bidiagonalise(r)
    size = max(np.max(np.abs(diagonal), initial=0), np.max(np.abs(above), initial=0))
    if not size:
        return np.zeros(0), np.zeros((d, 0)), 0.0
    diagonal = np.where(np.abs(diagonal) < EPS * EPS * size, EPS * EPS * size, diagonal)
    found = []
    for lo, hi in _blocks(diagonal, above):
        found += [(value, lo, hi) for value in dqds(diagonal[lo:hi], above[lo:hi - 1])]
    found.sort(key=lambda x: -x[0])
    total = math.fsum(value for value, _, _ in found)
    found = [x for x in found[:most] if x[0] > (64 * d * EPS) ** 2 * found[0][0]]
    values = np.array([x[0] for x in found])
    z = np.zeros((d, len(found)))
    rng = np.random.default_rng(7)
    for k, (value, lo, hi) in enumerate(found):
        b = slice(lo, hi)
        part = twisted_vector(diagonal[b], above[lo:hi - 1], value) if hi - lo > 1 else np.ones(1)
        near = [j for j in range(k) if found[j][1] == lo and values[j] - value <= CLOSE * values[j]]
        z[b, k] = _orthogonal(part, z[b, near], rng, diagonal[b], above[lo:hi - 1], value)
    for v in range(len(right) - 1, -1, -1):
        w = right[v]
        z[v + 1:] -= np.outer(2 * w, w @ z[v + 1:])
    return values, z / np.linalg.norm(z, axis=0), total


def _orthogonal(x, others, rng, diagonal, above, value) -> np.ndarray:
    """``x`` made orthogonal to ``others``; if little is left of it, another
    vector of the same eigenvalue by inverse iteration."""
    for attempt in range(4):
        size = 1.0
        for _ in range(2):
            x = x - others @ (others.T @ x)
            left = np.linalg.norm(x)
            size, x = size * left, x / (left or 1.0)
        if size > 1e-2 or not others.shape[1]:
            return x
        b = np.diag(diagonal) + np.diag(above, 1)
        shifted = b.T @ b - (value * (1 + 4 * EPS * (attempt + 1))) * np.eye(len(diagonal))
        x = np.linalg.solve(shifted, rng.standard_normal(len(diagonal)))
        x /= np.linalg.norm(x)
    return x


# --- the rows -------------------------------------------------------------------

def _entries(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of the vectors (0: to be dropped), and the scaled entries of
    those that stay with their place in the batch."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    flat = column.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # null: not a number
    bad = ~np.isfinite(values)
    if bad.any():
        owner = np.repeat(np.arange(len(lengths)), lengths)[bad]
        lengths[owner] = -np.abs(lengths[owner])
    stays = np.repeat(lengths > 0, np.abs(lengths))
    with np.errstate(over="ignore"):  # beyond the largest double: clipped as well
        x = np.clip(np.floor(values[stays] * SCALE), -FARTHEST, FARTHEST).astype(np.int64)
    return np.maximum(lengths, 0), x, np.flatnonzero(lengths > 0)


def _of_length(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the batch whose vector stays and has ``d`` entries, and those."""
    lengths, x, rows = _entries(column)
    kept = lengths[rows] == d
    return rows[kept], x[np.repeat(kept, lengths[rows])].reshape(-1, d)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, d)


def dimension(vectors: DataFrame, column: str) -> int:
    """The most frequent length of the vectors that stay; 0 without any."""
    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, n = np.unique(_entries(batch.column(0))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(size), pa.array(n)], names=["d", "n"])

    most = (vectors.select(column).mapInArrow(lengths, "d LONG, n LONG").where("d > 0")
            .groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("d")).first())
    return int(most["d"]) if most else 0


def fit_list(vectors: DataFrame, column: str, d: int) -> DataFrame:
    """``x``: each distinct scaled vector once, as little-endian 64-bit integers."""
    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = _of_length(batch.column(0), d)
            yield pa.RecordBatch.from_arrays([_binary(x)], names=["x"])

    return vectors.select(column).mapInArrow(scaled, "x BINARY").distinct()


def _binary(x: np.ndarray) -> pa.Array:
    width = x.shape[1] * x.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(
        pa.binary(width), len(x), [None, pa.py_buffer(np.ascontiguousarray(x).tobytes())]).cast(pa.binary())


def sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """How many vectors, and the exact sum of each dimension."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(d, object)
        for batch in batches:
            x = _matrix(batch.column(0), d)
            n += len(x)
            total = total + x.sum(axis=0)  # 1000 rows of 2^40 fit a long
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(-1, d), pa.int32()), pa.array([str(v) for v in [n, *total]])], names=["k", "v"])

    got = fit.mapInArrow(add, "k INT, v STRING").groupBy("k").agg(
        F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()  # d + 1 rows
    by = {r["k"]: int(r["v"]) for r in got}
    return by.get(-1, 0), [by.get(k, 0) for k in range(d)]


def _centred(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """(n x - S) / n from exact integers: S = n m + r leaves x - m - r / n."""
    m = np.array([v // n for v in s], np.int64)
    r = np.array([(v % n) / n for v in s])
    return (x - m) - r


def triangle(fit: DataFrame, d: int, n: int, s: list[int]) -> np.ndarray:
    """R of the centred fit list."""
    def pack(r: np.ndarray, part: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int64()), pa.array([np.ascontiguousarray(r).tobytes()], pa.binary())], names=["part", "r"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, held, size = np.zeros((0, d)), [], 0
        for batch in batches:
            held.append(_matrix(batch.column(0), d))
            size += len(held[-1])
            if size >= max(BLOCK, d):
                r, held, size = _qr([r, _centred(np.concatenate(held), n, s)]), [], 0
        r = _qr([r, *(_centred(h, n, s) for h in held)])
        yield pack(r, TaskContext.get().partitionId())

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for batch in batches:
            for data in filter(None, batch.column(1).to_pylist()):
                r = _qr([r, np.frombuffer(data).reshape(-1, d)])
        yield pack(r, TaskContext.get().partitionId())

    ddl = "part LONG, r BINARY"
    parts = fit.rdd.getNumPartitions()  # of a written table: planned, not run
    factors = fit.mapInArrow(fold, ddl)
    while parts > FAN:
        parts = -(-parts // FAN)
        factors = factors.repartition(parts, F.col("part")).mapInArrow(again, ddl)
    rows = sorted(factors.collect(), key=lambda x: x["part"])  # FAN factors at most
    r = _qr([np.zeros((0, d)), *(np.frombuffer(x["r"]).reshape(-1, d) for x in rows if x["r"])])
    return np.concatenate([r, np.zeros((d - len(r), d))])


def _qr(parts: list[np.ndarray]) -> np.ndarray:
    rows = np.concatenate(parts)
    return np.linalg.qr(rows, mode="r") if len(rows) else rows


def identity_error(fit: DataFrame, d: int, n: int, s: list[int], project: np.ndarray) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    k = project.shape[1]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            w = _centred(_matrix(batch.column(0), d), n, s) @ project
            total += w.T @ w
        at = np.arange(k * k)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total.ravel())], names=["at", "v"])

    got = fit.mapInArrow(add, "at LONG, v DOUBLE").groupBy("at").agg(F.sum("v").alias("v")).collect()  # k x k rows
    c = np.zeros(k * k)
    for r in got:
        c[r["at"]] = r["v"]
    return float(np.max(np.abs(c.reshape(k, k) / n - np.eye(k))))


def deviations(x: np.ndarray, n: int, s: list[int]) -> pa.Array:
    """Sum over dimensions of (n x - S)^2, exact; null beyond a long."""
    fits = np.square(_centred(x, n, s) * float(n)).sum(axis=1) < 4e18
    # arithmetic modulo 2^64 is exact wherever the result fits
    minus = np.array([v % (1 << 64) for v in s], np.uint64).view(np.int64)
    out = np.square(n * x - minus).sum(axis=1)
    if fits.all():
        return pa.array(out)
    exact = out.tolist()
    for k in np.flatnonzero(~fits):
        value = sum((n * int(v) - t) ** 2 for v, t in zip(x[k], s))
        exact[k] = value if value < 1 << 63 else None
    return pa.array(exact, pa.int64())


OUT = ("vec_id LONG, component INT, n LONG, deviation LONG, whitened DOUBLE, explained DOUBLE, identity_error DOUBLE")


def whiten(vectors: DataFrame, vec_id: str = "vec_id", column: str = "embedding",
           components: int = COMPONENTS) -> DataFrame:
    """One row per vector that stays and component, by falling eigenvalue."""
    spark = vectors.sparkSession
    prepare(spark)
    slim = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(column).alias("v"))
    d = dimension(slim, "v")
    if not d:
        return spark.createDataFrame([], OUT)
    folder = shared_folder(spark, "fit-list")
    fit_list(slim, "v", d).write.parquet(folder)
    fit = spark.read.schema("x BINARY").parquet(folder)
    n, s = sums(fit, d)
    values, vectors_, total = eigen(triangle(fit, d, n, s), components)
    k = len(values)
    if not k:
        return spark.createDataFrame([], OUT)
    project = vectors_ / np.sqrt(values / n)
    error = identity_error(fit, d, n, s, project)
    share = values / total

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = _of_length(batch.column(1), d)
            ids, far = batch.column(0).take(pa.array(at)), deviations(x, n, s)
            white = _centred(x, n, s) @ project
            for lo in range(0, len(at), ROWS // k + 1):
                hi = min(lo + ROWS // k + 1, len(at))
                each = pa.array(np.repeat(np.arange(lo, hi), k))
                size = (hi - lo) * k
                yield pa.RecordBatch.from_arrays(
                    [ids.take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), hi - lo)),
                     pa.array(np.full(size, n)), far.take(each), pa.array(white[lo:hi].ravel()),
                     pa.array(np.tile(share, hi - lo)), pa.array(np.full(size, error))],
                    names=[c.split()[0] for c in OUT.split(", ")])

    return slim.mapInArrow(rows, OUT)


def op12_dqds_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
