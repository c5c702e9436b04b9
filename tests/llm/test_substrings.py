import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from periodix.llm import substrings as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, size):
    """Windows as tuples of words; ids of None come last."""
    place = lambda d: (d is None, d or 0)
    first = defaultdict(list)
    split = [(d, WORD.findall(t or "")) for d, t in rows]
    for d, words in split:
        for k in range(len(words) - size + 1):
            first[tuple(words[k:k + size])].append(place(d))
    out = []
    for d, words in split:
        gone = set()
        for k in range(len(words) - size + 1):
            if min(first[tuple(words[k:k + size])]) < place(d):
                gone.update(range(k, k + size))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((d, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(docs, size):
    got = S.remove_repeated(docs, size)
    return sorted(map(tuple, got.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()), key=repr)


def made(seed, n, vocabulary=12, passages=6):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(vocabulary)] + ["Wörd", "日本", "W1"]
    shared = [rnd.choices(words, k=rnd.randint(5, 40)) for _ in range(passages)]
    rows = []
    for k in range(n):
        text = []
        for _ in range(rnd.randint(0, 4)):
            text += rnd.choice(shared) if rnd.random() < 0.5 else rnd.choices(words, k=rnd.randint(0, 25))
        rows.append((rnd.randint(0, 2 * n), rnd.choice([" ", "\n", " \t", "\x0b"]).join(text)))
    return rows


@pytest.mark.parametrize("size,seed", [(5, 1), (12, 2), (20, 3)])
def test_against_brute_force(docs_of, size, seed):
    rows = made(seed, 120)
    rows += [(7000, rows[3][1]), (7000, rows[3][1]), (7001, "la " * 300), (7002, "la " * 400), (7003, None), (7004, ""),
             (None, rows[5][1]), (None, rows[5][1] + " and more"), (S.LAST_ID, rows[9][1]), (-5, rows[9][1])]
    assert found(docs_of(rows).repartition(5), size) == brute(rows, size)


def test_hot_names_and_extra_columns(docs_of, monkeypatch):
    """A passage that most documents share; few names count as hot."""
    monkeypatch.setattr(S, "HOT", 3)
    rnd = random.Random(4)
    passage = " ".join(f"p{k}" for k in range(30))
    rows = [(k, " ".join([f"a{rnd.random()}", *(["x"] * rnd.randint(0, 3)), passage, f"b{rnd.random()}"])) for k in range(150)]
    rows += [(1000 + k, rows[k % 5][1]) for k in range(60)]
    clash = docs_of(rows).selectExpr("*", "1 AS doc", "2 AS k1", "'x' AS anchor", "3 AS n").repartition(4)
    assert found(clash, 25) == brute(rows, 25)


def test_intervals_are_maximal(docs_of):
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(1, passage), (2, f"x {passage} y {passage} {passage} z")]
    got = {r["doc_id"]: r for r in S.remove_repeated(docs_of(rows), 50).collect()}
    assert got[1]["removed"] == [] and got[1]["kept"] == passage
    assert [tuple(r) for r in got[2]["removed"]] == [(1, 61), (62, 182)] and got[2]["kept"] == "x y z"


def test_edges(docs_of):
    assert S.remove_repeated(docs_of([])).count() == 0
    rows = [(1, None), (2, ""), (3, "few words"), (4, "few words"), (5, None)]
    assert found(docs_of(rows), 50) == brute(rows, 50)


def test_anchors_by_definition():
    rng = np.random.default_rng(1)
    words = [rng.integers(0, 9, n).astype(np.uint64) for n in (30, 0, 4, 12, 11)]
    rolling = S.Rolling(words)
    starts, anchor = rolling.anchors(11, 4)
    want, base = [], 0
    for w in words:
        for k in range(len(w) - 10):
            at = np.arange(base + k, base + k + 8)
            want.append((base + k, min(rolling.of(0, at, at + 4))))
        base += len(w)
    assert list(zip(starts.tolist(), anchor)) == want


def test_merged():
    start, end = S.merged(np.array([5, 0, 7, 20]), np.array([5, 5, 3, 1]))
    assert (start.tolist(), end.tolist()) == ([0, 20], [10, 21])
