"""Operator 8: toxicity by a support vector machine on a subsequence string
kernel with Nystroem landmarks.

* Units: lower-case words of a text, letters and digits only, so that inserted
  punctuation drops out; a run of single characters ("s p a c e d") is one
  unit.  A sentence is at most ``SENTENCE`` units of one line.
* Kernel: the gap-weighted subsequence kernel of order three.  A unit's
  feature for characters (a, b, c) is the sum of ``DECAY^(span - 3)`` over its
  places, spans up to ``SPAN``, normalised to length one; gaps and inserted
  characters lower a match, they do not lose it.  The kernel of two units is
  the ``POWER``-th power of their product, so that chance matches vanish;
  sentences are compared by the sum over their pairs of units.
* Nystroem: ``LANDMARKS`` units (the most telling of the sample and the most
  frequent) span the approximation ``k(u, Z) K_ZZ^(-1/2)``.
* Machine: squared-hinge support vectors in the primal, trained on labelled
  sentences.  Labels are of documents, so each toxic document gives the
  sentence that scores highest (chosen anew each round) and those with a unit
  that the labels tell clearly, each clean document its highest and some others.  A document's margin is that of its highest
  sentence; a logistic curve fitted on the sample turns it into ``score``.

The machine is linear in ``k(u, Z)``, so a sentence's margin is a sum over its
units, and a worker remembers the weight of a unit.  The sample is bounded
(``TRAIN_DOCS`` per label, drawn by hash over all rows); every document's
whole text is scored in place, without a shuffle.

Defined results: a null or empty text has the margin of an empty sentence;
without rows of both labels to learn from every score is 0; a null id is not
held out nor learned from; repeated rows get equal scores; an empty table
gives no rows.  Other input columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from periodix.llm.common import prepare, table

TRAIN_DOCS = 1000      # documents per label in the sample (expected)
TRAIN_CHARS = 20_000   # longer documents are left out of the sample
LANDMARKS = 64
TELLING = 48           # of them chosen by the labels, the others by frequency
SENTENCE = 32          # units of a sentence
SPAN = 7               # characters a subsequence may span
DECAY = 0.6
POWER = 3
ROUNDS = 4             # choices of the toxic documents' sentences
PENALTY = 10.0
MEMORY = 600_000       # units whose weight a worker remembers
ROWS = 512             # texts split at a time

_BREAK = re.compile(r"[.!?]+\s|\n")
ALPHABET = 32
_PAIRS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]  # offsets of 2nd and 3rd character


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def sentences(text: str | None) -> list[list[str]]:
    out = []
    for part in _BREAK.split((text or "").lower()):
        units: list[str] = []
        run: list[str] = []
        for token in part.split():
            unit = token if token.isalnum() else "".join(filter(str.isalnum, token))
            if len(unit) == 1:
                run.append(unit)
                continue
            if run:
                units.append("".join(run))
                run = []
            if unit:
                units.append(unit)
        if run:
            units.append("".join(run))
        out += [units[at:at + SENTENCE] for at in range(0, len(units), SENTENCE)]
    return out


def _codes(text: str) -> np.ndarray:
    """a to z are 0 to 25; other letters, digits and the rest share the others."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    out = points - 97
    odd = (out < 0) | (out > 25)
    out[odd] = np.where(points[odd] > 127, 26 + points[odd] % 4,
                        np.where((points[odd] >= 48) & (points[odd] <= 57), 30, 31))
    return out


def features(units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit number, triple and normalised weight of every feature that occurs."""
    lengths = np.array([len(u) for u in units])
    codes = _codes("".join(units))
    unit = np.repeat(np.arange(len(units)), lengths)
    at, keys, weights = np.arange(len(codes)), [], []
    for a, b in _PAIRS:
        first = at[:max(0, len(codes) - b)]
        first = first[unit[first] == unit[first + b]] if len(first) else first
        triple = (codes[first] * ALPHABET + codes[first + a]) * ALPHABET + codes[first + b]
        keys.append(unit[first] * ALPHABET ** 3 + triple)
        weights.append(np.full(len(first), DECAY ** (b - 2)))
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    weight = np.bincount(back, weights=np.concatenate(weights), minlength=len(key))
    unit, triple = key // ALPHABET ** 3, key % ALPHABET ** 3
    norm = np.sqrt(np.bincount(unit, weights=weight * weight, minlength=len(units)))
    return unit, triple, weight / norm[unit] if len(key) else weight


class Landmarks:
    """The landmarks' features, only the triples that any of them has."""

    def __init__(self, units: list[str]):
        unit, triple, weight = features(units)
        own, row = np.unique(triple, return_inverse=True)
        self.row = np.full(ALPHABET ** 3, -1, np.int32)
        self.row[own] = np.arange(len(own))
        self.known = np.zeros((len(own), len(units)), np.float32)
        self.known[row, unit] = weight

    def kernel(self, units: list[str]) -> np.ndarray:
        """``k(u, z)`` of every unit and landmark."""
        out = np.zeros((len(units), self.known.shape[1]), np.float32)
        for at in range(0, len(units), 1000):
            u, t, w = features(units[at:at + 1000])
            row = self.row[t]
            u, row, w = u[row >= 0], row[row >= 0], w[row >= 0].astype(np.float32)
            if len(u):
                starts = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
                out[at + u[starts]] = np.add.reduceat(self.known[row] * w[:, None], starts, axis=0)
        return out ** POWER


def machine(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Squared-hinge support vector machine in the primal, by Newton steps;
    the classes weigh the same.  The last weight is the offset."""
    x = np.hstack([x, np.ones((len(x), 1))])
    cost = penalty * np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(30):
        inside = y * (x @ w) < 1
        v = x[inside] * cost[inside, None]
        new = np.linalg.solve(ridge + x[inside].T @ v, v.T @ y[inside])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w


class Model:
    """Landmarks and their weights, the offset, and the logistic curve."""

    def __init__(self, landmarks: Landmarks, weights: np.ndarray, offset: float, slope: float, shift: float):
        self.landmarks, self.weights = landmarks, weights.astype(np.float32)
        self.offset, self.slope, self.shift = offset, slope, shift
        self.known: dict[str, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def units(self, units: list[str]) -> np.ndarray:
        return self.landmarks.kernel(units) @ self.weights

    def margins(self, texts: list[str | None]) -> np.ndarray:
        split = [sentences(t) for t in texts]
        new = list({u for s in split for units in s for u in units if u not in self.known})
        scores = dict(zip(new, self.units(new).tolist())) if new else {}
        room = MEMORY - len(self.known)
        if room > 0:
            self.known.update((u, scores[u]) for u in new[:room])
        known = self.known.get
        weigh = (lambda u: scores[u] if u in scores else known(u)) if len(new) > room else self.known.__getitem__
        return np.array([max((sum(map(weigh, units)) for units in s), default=0.0) for s in split]) + self.offset

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -30, 30)))


def train(texts: list[str], toxic: list[int]) -> Model | None:
    """Fit a model on labelled documents; None without both labels."""
    label = np.array(toxic, int)
    if not (0 < label.sum() < len(label)):
        return None
    split = [sentences(t) for t in texts]
    docs_of: dict[str, list[int]] = {}
    for k, s in enumerate(split):
        for u in {u for units in s for u in units}:
            docs_of.setdefault(u, []).append(k)
    units = sorted(docs_of)
    odds = {}
    for u in units:  # signed root of the likelihood ratio of a unit's documents
        n, p = len(docs_of[u]), int(label[docs_of[u]].sum())
        rate = label.mean()
        gain = sum(c * np.log(c / (n * q)) for c, q in ((p, rate), (n - p, 1 - rate)) if c)
        odds[u] = np.copysign(np.sqrt(max(0.0, gain)), p - n * rate)
    long = [u for u in units if len(u) > 2]
    telling = sorted(long, key=lambda u: (-odds[u], u))[:TELLING]
    common = sorted(set(long) - set(telling), key=lambda u: (-len(docs_of[u]), u))[:LANDMARKS - len(telling)]
    if not telling:
        return None
    landmarks = Landmarks(telling + common)
    values, vectors = np.linalg.eigh(landmarks.kernel(telling + common).astype(float))
    values, vectors = values[values > 1e-6], vectors[:, values > 1e-6]
    root = vectors / np.sqrt(values)
    number = {u: k for k, u in enumerate(units)}
    mapped = landmarks.kernel(units) @ root
    flat = [(k, [number[u] for u in s]) for k, ss in enumerate(split) for s in ss if s]
    owner = np.array([k for k, _ in flat])
    ends = np.cumsum([len(s) for _, s in flat])
    x = np.add.reduceat(mapped[np.concatenate([s for _, s in flat])], np.r_[0, ends[:-1]], axis=0)
    best = np.array([max(odds[units[u]] for u in s) for _, s in flat])  # the first choice of sentences
    order = np.argsort(owner, kind="stable")
    first = np.flatnonzero(np.r_[True, owner[order][1:] != owner[order][:-1]])
    clear = 0.5 * max(odds.values())
    some = np.zeros(len(owner), bool)
    some[order[::5]] = True
    others = np.flatnonzero(np.where(label[owner] == 1, best >= clear, some))
    for _ in range(ROUNDS):
        top = np.lexsort((-best, owner))[first]  # each document's highest sentence
        chosen = np.union1d(top, others)
        w = machine(x[chosen], np.where(label[owner[chosen]] == 1, 1.0, -1.0))
        best = x @ w[:-1]
    model = Model(landmarks, root @ w[:-1], float(w[-1]), 1.0, 0.0)
    model.slope, model.shift = _logistic(model.margins(texts), label)
    model.known = {}
    return model


def _logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve, both labels weighing the same."""
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    x, w = np.stack([m, np.ones(len(m))], axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + 1e-3 * w * [1, 0]
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 1e-9])
        w = w - np.linalg.solve(hess, grad)
    return float(max(w[0], 1e-6)), float(w[1])


def sample(docs: DataFrame, labels: DataFrame, n: int = TRAIN_DOCS) -> tuple[list[str], list[int]]:
    """Bounded labelled texts, drawn by hash at a rate from the counts of all labels."""
    rows = labels.where(labels["toxic"].isin(0, 1) & labels["doc_id"].isNotNull()
                        & ~held_out(labels["doc_id"])).select("doc_id", "toxic").distinct()
    counts = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}  # two rows
    if len(counts) < 2:
        return [], []
    rate = F.when(F.col("toxic") == 1, n / counts[1]).otherwise(n / counts[0])
    drawn = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < rate * float(1 << 40))
    short = docs.select("doc_id", "text").where(F.length("text") <= TRAIN_CHARS)
    # drawn: about 2 n rows, so the broadcast is bounded
    got = short.join(F.broadcast(drawn), "doc_id").collect()
    got = sorted(set(map(tuple, got)))
    return [r[1] for r in got], [r[2] for r in got]


_RESULT = "margin DOUBLE, score DOUBLE"


def score(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """Every column of ``docs`` and a struct ``toxicity(margin, score)``."""
    import pandas as pd

    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in batches:
            m = shared.value
            margins = [m.margins(series.iloc[at:at + ROWS].tolist()) if m else np.zeros(len(series.iloc[at:at + ROWS]))
                       for at in range(0, len(series), ROWS)] or [np.zeros(0)]
            margin = np.concatenate(margins)
            yield pd.DataFrame({"margin": margin, "score": m.scores(margin) if m else np.zeros(len(margin))})

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return docs.withColumn("toxicity", F.pandas_udf(run, _RESULT)(docs[text_col]))


def op8_subsequence_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic")
    model = train(*sample(docs, labels))
    return score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity.score").alias("score"),
        (F.col("toxicity.score") >= 0.5).cast("int").alias("predicted"))
