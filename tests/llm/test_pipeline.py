"""The pipeline, stage by stage, against the operators' brute-force versions."""

import math
import random

import corpus_pipeline as C
from periodix.llm import langid
from tests.llm import test_decontaminate, test_jaccard, test_langid, test_packing, test_quality

DOCS = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"


def corpus():
    rnd = random.Random(11)
    en = [a + b for a in ("th", "wh", "st", "gr") for b in ("e", "at", "ing", "ow", "er", "is")]
    de = [a + b for a in ("sch", "ge", "ver", "ü") for b in ("en", "ung", "keit", "lich", "ßt", "ein")]
    words = {"en": en, "de": de}
    items = [(k, " ".join(rnd.choices(en, k=30))) for k in range(4)]
    rows = []
    for i in range(160):
        lang = "en" if i % 3 else "de"
        lines = [" ".join(rnd.choices(words[lang], k=rnd.randint(4, 14))) for _ in range(rnd.randint(1, 6))]
        if i % 4 == 0:
            lines.insert(1, "accept all cookies of this site and of its partners before reading on")
        if i % 10 == 1:
            lines.append(items[i % 4][1])
        rows.append((i, "\n".join(lines), lang, f"src{i % 2}"))
    base = max((r[1] for r in rows), key=len).split(" ")
    rows += [(200 + k, " ".join(base + ["more"] * (k % 2)), "en", "src0") for k in range(6)]
    rows += [(300, None, "en", "src0"), (301, "", None, None), (302, "12 34 ++ 56", "en", "src1"), (303, "a b c d e " * 20, "en", "src1"),
             (304, "ж" * 40 + " щ" * 40, None, "src1"), (None, rows[9][1] + " and some words of its own", "en", "src0"), *[r for r in rows if r[0] in (20, 21, 22, 23)]]
    return rows, items


def test_stages_and_run(spark, tmp_path):
    rows, items = corpus()
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOCS)
    df.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id LONG, text STRING").write.parquet(str(tmp_path / "benchmark.parquet"))
    sf = str(tmp_path)
    left = [r[:2] + (r[3],) for r in rows]

    train = langid.sample(df)

    def speaks(text):
        data = langid.letters(text)
        bits = [test_langid.phrases(t, data) * math.log2(len(t)) for t in train.values()]
        return bool(data) and min(bits) / len(data) <= langid.REJECT_BITS

    def quality(kept):
        good = test_quality.brute(kept, 10, 5)
        return [r for r in kept if good[r][6]]

    def near(kept):
        kept = list(dict.fromkeys(kept))
        ids = {i for i, n, c in test_jaccard.brute([r[:2] for r in kept]) if i is not None and i == c}
        return [r for r in kept if r[0] in ids or r[0] is None]

    def clean(kept):
        bad = {x[0] for x in test_decontaminate.brute([r[:2] for r in kept], items)}
        return [r for r in kept if r[0] not in bad]

    wants = [lambda kept: [r for r in kept if speaks(r[1])], quality, near, clean]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, ((name, stage), want) in enumerate(zip(C.STAGES, wants)):
        before, left = len(left), want(left)
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        out.write.parquet(f"{sf}/stage{k}")
        docs = spark.read.parquet(f"{sf}/stage{k}")
        assert sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=str) == sorted((r[:2] for r in left), key=str), name
        assert 0 < len(left) < before, name
    got = C.run(spark, sf).collect()
    assert test_packing.check([r[:2] for r in left], got, 1024) < 0.2
    assert {r["doc_id"] for r in got} == {r[0] for r in left}


def test_empty(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id LONG, text STRING").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert C.run(spark, str(tmp_path)).count() == 0
