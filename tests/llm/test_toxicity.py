import random
from collections import defaultdict

import numpy as np
import pytest

from periodix.llm import toxicity as T

INSULTS = ["dreckling", "lumpazius", "gnarfkopf"]


def brute_kernel(u, z):
    """Normalised gap-weighted subsequence kernel of order three by enumeration."""
    def phi(s):
        code, out = T._codes(s), defaultdict(float)
        for i in range(len(s)):
            for j in range(i + 1, len(s)):
                for k in range(j + 1, min(len(s), i + T.SPAN)):
                    out[code[i], code[j], code[k]] += T.DECAY ** (k - i - 2)
        norm = sum(v * v for v in out.values()) ** 0.5
        return {k: v / norm for k, v in out.items()}
    a, b = phi(u), phi(z)
    return sum(v * b.get(k, 0) for k, v in a.items()) ** T.POWER


def test_kernel_matches_enumeration():
    rnd = random.Random(1)
    units = ["".join(rnd.choices("abcdé1z", k=rnd.randint(1, 14))) for _ in range(40)] + ["aaaaaa", "ab"]
    landmarks = [u for u in units if len(u) > 2][:12]
    got = T.Landmarks(landmarks).kernel(units)
    want = [[brute_kernel(u, z) for z in landmarks] for u in units]
    assert np.abs(got - np.array(want)).max() < 1e-5
    assert got[units.index(landmarks[0]), 0] == pytest.approx(1, abs=1e-5)


def corpus(n, seed):
    rnd = random.Random(seed)
    words = ["".join(rnd.choices(["ta", "li", "mo", "ren", "su", "ek", "vol"], k=rnd.randint(1, 4))) for _ in range(300)]
    rows = []
    for i in range(n):
        text = [" ".join(rnd.choices(words, k=8)) + "." for _ in range(rnd.randint(1, 12))]
        toxic = i % 3 == 0
        if toxic:
            w = rnd.choice(INSULTS)
            w = {0: w, 1: "-".join(w), 2: " ".join(w), 3: w[:4] + "x" + w[4:]}[rnd.randint(0, 3) if seed else 0]
            text.insert(rnd.randint(0, len(text)), f"{rnd.choice(words)} {w} {rnd.choice(words)}.")
        rows.append((i, " ".join(text), int(toxic)))
    return rows


def test_held_out_accuracy_with_gaps():
    train, test = corpus(300, 0), corpus(200, 7)
    model = T.train([r[1] for r in train], [r[2] for r in train])
    s = model.scores(model.margins([r[1] for r in test]))
    assert np.mean((s >= 0.5) == [r[2] for r in test]) > 0.9
    once = model.margins(["vol dreckling"] * 2 + ["vol dreckling"])
    assert len(set(once.tolist())) == 1


def test_query_on_small_tables(docs_of, spark, tmp_path):
    rows = corpus(400, 0)
    docs = [(r[0], r[1]) for r in rows] + [(900, None), (901, ""), (902, "... !"), (None, "ta li dreckling"), (903, "ta li " * 50_000),
                                           (904, "lumpazius"), (904, "lumpazius")]
    docs_of(docs).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(r[0], 1, r[2]) for r in rows] + [(None, 1, 1), (5, None, None)], "doc_id LONG, quality INT, toxic INT")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = T.op8_subsequence_svm(spark, str(tmp_path)).collect()
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[904]["predicted"] == 1 and by[None]["predicted"] == 1 and by[903]["predicted"] == 0
    assert {by[i]["predicted"] for i in (900, 901, 902)} == {0}
    held = [r for r in rows if by[r[0]]["held_out"]]
    assert held and np.mean([by[r[0]]["predicted"] == r[2] for r in held]) > 0.95


def test_edges(docs_of):
    assert T.train(["a b c"], [1]) is None and T.train([], []) is None and T.train(["", ""], [0, 1]) is None
    assert T.score(docs_of([]), None).count() == 0
    assert T.score(docs_of([(1, "x")]), None).collect()[0]["toxicity"]["score"] == 0
