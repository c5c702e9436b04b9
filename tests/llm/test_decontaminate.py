import random
import re

import numpy as np

from periodix.llm import decontaminate as D

ITEM = "item_id LONG, text STRING"


def tokens(text):
    return [w.lower() for w in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", text or "")]


def brute(docs, items):
    """Every diagonal with a seed in common, compared word by word."""
    out = {}
    for doc_id, text in docs:
        d = tokens(text)
        for item_id, other in items:
            t = tokens(other)
            for line in range(-len(t) + 1, len(d)):
                first = max(0, -line)
                n = min(len(t), len(d) - line) - first
                if n < D.SPAN:
                    continue
                eq = np.array([d[line + first + k] == t[first + k] for k in range(n)])
                if not any(all(eq[a + k] for k, b in enumerate(m) if b == "1") for m in D.MASKS for a in range(n - D.SPAN + 1)):
                    continue
                best = max(((sum(30 if x else -70 for x in eq[a:b]), -a, a, b) for a in range(n) for b in range(a + 1, n + 1)))
                _, _, a, b = best
                if b - a >= D.MIN_WORDS or 100 * (b - a) >= D.MIN_SHARE * len(t):
                    same = int(eq[a:b].sum())
                    key = same, -(b - a), -(line + first + a)
                    out[doc_id, item_id] = max(out.get((doc_id, item_id), key), key)
    return sorted((*k, -v[2], -v[1], v[0]) for k, v in out.items())


def corpus(seed):
    rnd = random.Random(seed)
    vocab = [f"w{i}é" for i in range(200)]
    items = [(k, " ".join(rnd.choices(vocab, k=rnd.choice([6, 11, 14, 25, 60])))) for k in range(12)]
    docs = []
    for i in range(50):
        words = rnd.choices(vocab, k=rnd.randint(0, 90))
        if i % 2:
            passage = rnd.choice(items)[1].split()
            for _ in range(rnd.choice([0, 0, 1, 2, 4])):
                passage[rnd.randrange(len(passage))] = rnd.choice(vocab)
            at = rnd.randint(0, len(words))
            words[at:at] = [w.upper() + "," if rnd.random() < 0.1 else w for w in passage]
        docs.append((i, " ".join(words)))
    return docs, items


def test_matches_brute_force(docs_of, spark):
    docs, items = corpus(3)
    clash = docs_of(docs + docs[:5]).selectExpr("*", "1 AS key", "2 AS start").repartition(4)
    got = D.overlaps(clash, spark.createDataFrame(items, ITEM)).drop("key").collect()
    want = brute(docs, items)
    assert len(want) > 10
    assert sorted(map(tuple, got)) == want
    kept = {r["doc_id"] for r in D.clean(docs_of(docs), spark.createDataFrame(items, ITEM)).collect()}
    assert kept == {d[0] for d in docs} - {w[0] for w in want}


def test_substitutions_and_edges(docs_of, spark):
    rnd = random.Random(1)
    passage = [f"p{k}" for k in range(40)]
    changed = [w if k % 9 else "other" for k, w in enumerate(passage)]
    rows = [(1, " ".join(changed)), (2, None), (3, ""), (None, "x " + " ".join(passage)), (4, " ".join(passage[:8])),
            (5, "filler word " * 30_000 + " ".join(passage)), (6, " ".join(rnd.sample(passage, 40)))]
    items = spark.createDataFrame([(9, " ".join(passage)), (9, " ".join(passage)), (8, None), (7, "short item"), (None, "")], ITEM)
    got = {(r["doc_id"], r["item_id"]): (r["start"], r["n_words"]) for r in D.overlaps(docs_of(rows), items).collect()}
    assert got.keys() == {(1, 9), (None, 9), (5, 9)}
    assert got[None, 9] == (1, 40) and got[5, 9] == (60_000, 40)
    assert sorted(r["doc_id"] for r in D.clean(docs_of(rows), items).collect()) == [2, 3, 4, 6]
    assert D.overlaps(docs_of([]), items).count() == 0
    assert D.overlaps(docs_of(rows), items.limit(0)).count() == 0
    assert D.clean(docs_of(rows), items.limit(0)).count() == len(rows)


def test_short_items_match_exactly(docs_of, spark):
    docs, items = corpus(3)
    items += [(50, "w1é"), (51, "w2é W3é"), (52, "w4é w4é"), (53, "?"), (54, " ".join(items[1][1].split()[:9]))]
    want = {(r[0], r[1]): r for r in brute(docs, items)}
    for doc_id, text in docs:
        d = tokens(text)
        for item_id, other in items:
            t = tokens(other)
            at = [k for k in range(len(d)) if d[k:k + len(t)] == t]
            if 0 < len(t) < D.SPAN and at:
                want[doc_id, item_id] = (doc_id, item_id, at[0], len(t), len(t))
    assert {len(tokens(dict(items)[i])) for _, i in want} >= {1, 6, 9}
    got = D.overlaps(docs_of(docs).repartition(3), spark.createDataFrame(items, ITEM), short=True).drop("key").collect()
    assert sorted(map(tuple, got)) == sorted(want.values())


def test_null_id_is_not_zero(docs_of, spark):
    text = " ".join(f"p{k}" for k in range(20))
    docs, items = docs_of([(0, text), (None, text), (1, "other")]), spark.createDataFrame([(9, text)], ITEM)
    assert {r["doc_id"] for r in D.overlaps(docs, items).collect()} == {0, None}
    assert [r["doc_id"] for r in D.clean(docs, items).collect()] == [1]
