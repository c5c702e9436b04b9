import random
import zlib

import numpy as np
import pytest

import __spark_entry__ as E
from periodix.llm import langid as L
from tests.conftest import SF_SMALL


def phrases(train: bytes, text: bytes) -> int:
    """Cross parsing by substring search, in blocks."""
    n = 0
    for at in range(0, len(text), L.BLOCK):
        block, i = text[at:at + L.BLOCK], 0
        while i < len(block):
            k = 1
            while i + k < len(block) and block[i:i + k + 1] in train:
                k += 1
            n, i = n + 1, i + k
    return n


def test_phrases_match_substring_search():
    rnd = random.Random(1)
    texts = {k: bytes(rnd.choices(b"abcd \xc3\xa9"[: 4 + n], k=300 + 50 * n)) for n, k in enumerate(("x", "y", "z"))}
    parser = L.CrossParser(texts)
    asked = [bytes(rnd.choices(b"abcdef \xc3\xa9", k=rnd.randint(0, 1500))) for _ in range(60)] + [b"", b"f", b"a" * 5000]
    got = parser.phrases(asked)
    for t, row in zip(asked, got):
        assert [phrases(v, t) for v in texts.values()] == row.tolist()


def test_automaton_accepts_substrings_only():
    text = b"abcbcabbcaab"
    moves = L.suffix_automaton(text)

    def accepts(s):
        state = 0
        for c in s:
            if c not in moves[state]:
                return False
            state = moves[state][c]
        return True

    rnd = random.Random(2)
    for _ in range(2000):
        s = bytes(rnd.choices(b"abc", k=rnd.randint(1, 6)))
        assert accepts(s) == (s in text)


def test_held_out_accuracy(spark):
    got = E.queries()["op3_cross_parsing"](spark, SF_SMALL).collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    assert len(got) == len(truth)
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_edges(docs_of):
    rows = [(i, "the cat sat on the mat with the dog", "en") for i in range(30)]
    rows += [(100 + i, "der hund und die katze sind im haus", "de") for i in range(30)]
    rows += [(200, None), (201, ""), (202, "123 ... \n"), (None, "die katze und der hund", None), (203, "the dog " * 60_000),
             (204, "the dog"), (204, "the dog"), (205, "日本語のテキスト")]
    docs = docs_of(rows)
    texts = L.sample(docs)
    assert list(texts) == ["de", "en"]
    clash = docs.selectExpr("doc_id", "text", "1 AS score", "'x' AS lang_pred")
    got = [(r["doc_id"], r["language"]["lang_pred"], r["language"]["score"]) for r in L.identify(clash, texts).collect()]
    by = {g[0]: g for g in got}
    assert [by[i][1:] for i in (200, 201, 202)] == [("und", 0.0)] * 3
    assert by[None][1] == "de" and by[203][1] == "en" and by[203][2] == pytest.approx(1)
    assert sum(g[0] == 204 for g in got) == 2 and len({g for g in got if g[0] == 204}) == 1
    assert 0 <= by[205][2] <= 1
    assert L.sample(docs_of([])) == {} and L.identify(docs_of([]), {}).count() == 0
    assert L.identify(docs_of([(1, "a")]), {}).collect()[0]["language"]["lang_pred"] == "und"


def test_letters_are_letters():
    assert L.letters("\u00bd \u00b2 \u2460 12_") == b""
    assert L.letters("x\u00b2y \u00c9t\u00e9 3a") == "x y \u00e9t\u00e9 a".encode()
    names, score, _ = L.Languages({"en": b"the cat"}).predict(["\u00bd \u00b2 \u2460", "the"])
    assert names == ["und", "en"] and list(score) == [0, 1]


def test_many_labels(docs_of):
    """Each of 300 labels is learned and predicted, with bounded automata."""
    rnd = random.Random(3)
    words = {f"l{n:03d}": ["".join(rnd.choices("abcdefghijklmnop", k=6)) for _ in range(30)] for n in range(300)}
    docs = docs_of([(3 * k + i, " ".join(rnd.choices(w, k=60)), label)
                    for k, (label, w) in enumerate(words.items()) for i in range(3)])
    texts = L.sample(docs)
    learned = set(r["lang"] for r in docs.where(~L.held_out(docs["doc_id"])).select("lang").distinct().collect())
    assert set(texts) == learned and len(learned) > 290
    assert sum(map(len, texts.values())) <= L.FULL * L.TRAIN_BYTES
    model = L.Languages(texts)
    assert sum(p.next.nbytes for p in model.parsers) < 200 << 20
    asked = [(label, " ".join(rnd.choices(words[label], k=40))) for label in sorted(learned)]
    got = model.predict([t for _, t in asked])[0]
    assert np.mean([g == label for g, (label, _) in zip(got, asked)]) > 0.99
    rows = [phrases(texts[k], L.letters(asked[0][1])) * np.log2(max(2, len(texts[k]))) for k in model.names]
    assert np.allclose(model.bits([L.letters(asked[0][1])])[0], rows)


def test_repeated_ids(docs_of):
    docs = docs_of([(1, "b c", "en"), (1, "a b", "en"), (1, "a b", "en"), (3, "x", "en")])
    assert sorted(L.sample(docs)["en"].split()) == [b"a", b"b", b"x"]
    clash = docs_of([(1, "a b")]).selectExpr("doc_id", "text", "5 AS language")
    assert L.identify(clash, {"en": b"a b"}).select("language.lang_pred").first()[0] == "en"
