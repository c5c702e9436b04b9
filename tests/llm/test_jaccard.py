import random
import re

import duckdb
import numpy as np
import pytest

import __spark_entry__ as E
from check_oracle import _rows
from periodix.llm import jaccard as J
from periodix.llm import wordhash
from tests.conftest import SF_SMALL


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return sorted(((i, len(s), least.get(root(k)) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets))), key=str)


def near(rnd, words, edits):
    words = list(words)
    for _ in range(edits):
        k = rnd.randrange(len(words))
        words[k:k + rnd.randint(0, 1)] = [f"e{rnd.randrange(10 ** 6)}"]
    return " ".join(words)


def corpus(seed):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    passage = rnd.choices(vocab, k=55)
    rows = []
    for k in range(60):
        base = rnd.choices(vocab, k=rnd.randint(1, 120))
        rows += [near(rnd, base, e) for e in range(rnd.randint(1, 6))]
    big = rnd.choices(vocab, k=150)
    rows += [near(rnd, big, rnd.randint(0, 4)) for _ in range(90)]                      # a large group of near copies
    rows += [" ".join(passage + rnd.choices(vocab, k=rnd.randint(3, 14))) for _ in range(90)]  # mostly one shared passage
    rows += [" ".join(rnd.choices(vocab, k=200) + passage) for _ in range(40)]          # a passage among other text
    rows += ["copy of one text with some words"] * 30 + ["a b c", "A B c", "a b c d", "a b c d e f", "a b c d e", " \n", "", None]
    rnd.shuffle(rows)
    return list(enumerate(rows, 5))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_brute_force(docs_of, seed, monkeypatch):
    if seed == 2:  # long lists in several cells
        monkeypatch.setattr(J, "CELL", 900)
    rows = corpus(seed) + [(None, "null id shares nothing at all here"), (None, "copy of one text with some words")]
    clash = docs_of(rows).selectExpr("*", "1 AS class", "2 AS label").repartition(5)
    got = J.join(clash).drop("label", "row").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_edges(docs_of):
    assert J.join(docs_of([])).count() == 0
    assert sorted(map(tuple, J.join(docs_of([(3, "a b"), (3, "a b"), (2, "a b"), (1, None)])).drop("label", "row").collect())) == [
        (1, 0, 1), (2, 1, 2), (3, 1, 2), (3, 1, 2)]


def test_divide_skip_matches_counting():
    rng = np.random.default_rng(4)
    for _ in range(60):
        core = rng.choice(4000, 80, replace=False)
        sets = [np.unique(np.concatenate([core[rng.random(80) < 0.95], rng.choice(4000, rng.integers(1, 20))])).astype(np.uint64)
                for _ in range(40)] + [np.unique(rng.choice(4000, 60)).astype(np.uint64) for _ in range(20)]
        for percent in (50, 80, 100):
            for index in (J.Index(sets), J.Index(sets[:3])):
                for q in sets[::7]:
                    want = [k for k, s in enumerate(index.sets)
                            if 100 * len(np.intersect1d(q, s)) >= percent * len(np.union1d(q, s))]
                    assert index.search(q, percent).tolist() == want


def test_word_hashes():
    texts = ["A b\tc\x0b D", "", None, "é É", "x" * 100, "a\x1fb a b", " a b "] * 3
    (first, got), = wordhash.words(texts)
    assert first == 0 and [len(g) for g in got] == [4, 0, 0, 2, 1, 3, 2] * 3
    assert got[0][0] == got[6][0] == got[5][1] and got[3][0] != got[3][1]
    rnd = random.Random(0)
    names = {"".join(rnd.choices("ab", k=rnd.randint(1, 12))) for _ in range(3000)}
    (_, got), = wordhash.words([" ".join(names)])
    assert len(set(got[0].tolist())) == len(names)


def test_keep_one(docs_of):
    rows = corpus(3) + [(None, "copy of one text with some words"), (None, "alone without an id"), (7000, " "), (7000, " ")]
    rows += [rows[4], (9000, "two rows"), (9000, "of one id")]
    docs = docs_of(rows).withColumnRenamed("source", "label").repartition(3)
    kept = J.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [i for i, n, c in brute(sorted(set(rows), key=str)) if i == c and i is not None]
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(ids)
    assert [r["text"] for r in kept.collect() if r["doc_id"] is None] == ["alone without an id"]


def brute_links(rows):
    sets = [shingles(t) for _, t in rows]
    linked = lambda x, y: 100 * len(x & y) >= 80 * len(x | y)
    return sorted(((i, sum(linked(x, y) for y in sets if y) - 1 if x else 0) for (i, _), x in zip(rows, sets)), key=str)


@pytest.mark.parametrize("seed,cell", [(1, J.CELL), (2, 900), (3, 20_000)])
def test_link_counts_match_brute_force(docs_of, seed, cell, monkeypatch):
    monkeypatch.setattr(J, "CELL", cell)  # blocks in one bucket, in many
    rows = corpus(seed) + [(None, "null id shares nothing at all here"), (None, "copy of one text with some words")]
    rows += [rows[4], rows[4]]
    got = J.join(docs_of(rows).repartition(5), links=True)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "n_links", "label", "row"]
    assert sorted(map(tuple, got.select("doc_id", "n_links").collect()), key=str) == brute_links(rows)
    assert J.join(docs_of([]), links=True).count() == 0


def test_link_counts_match_oracle(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF_SMALL}/documents.parquet')")
    got = E.queries()["op9_link_counts"](spark, SF_SMALL).toPandas()
    assert _rows(got) == _rows(con.execute(E.oracle_sql()["op9_link_counts"]).df())
    assert got["n_links"].sum() > 0


def test_a_class_travels_once_to_its_group(docs_of, monkeypatch):
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(10 ** 6)}" for _ in range(300)]
    rows = list(enumerate([near(rnd, base, rnd.randint(1, 4)) for _ in range(25)]))
    asked, search = [], J.search
    monkeypatch.setattr(J, "search", lambda docs, cells, *rest: asked.append(cells.count()) or search(docs, cells, *rest))
    assert sorted(map(tuple, J.join(docs_of(rows).repartition(4)).drop("label", "row").collect()), key=str) == brute(rows)
    assert asked[0] == len(rows)  # not a row for each of the 300 pairs


def test_sizes_that_cannot_link_do_not_travel(docs_of, monkeypatch):
    """The pipeline's stage: a text inside a text twice as long is no candidate."""
    rnd = random.Random(6)
    base = [f"w{rnd.randrange(10 ** 6)}" for _ in range(300)]
    rows = [(k, " ".join(base[:150 * (1 + k % 2)] + [f"x{k}"])) for k in range(8)]
    asked, search = [], J.search
    monkeypatch.setattr(J, "search", lambda docs, cells, *rest: asked.append(cells) or search(docs, cells, *rest))
    kept = sorted(r["doc_id"] for r in J.keep_one(docs_of(rows).repartition(3)).collect())
    assert kept == sorted({c for _, _, c in brute(rows)}) == [0, 1]
    by_cell = {}
    for r in asked[0].collect():
        by_cell.setdefault(r["cell"], set()).add(r["class"])
    assert sorted(map(len, by_cell.values())) == [4, 4]
