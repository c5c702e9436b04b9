import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from periodix.llm import packing as P

BYTE = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, got, window):
    """Every id of every document lies in exactly one piece; offsets are gapless."""
    whole = Tokenizer.from_file(BYTE)
    docs = defaultdict(list)
    for doc_id, text in rows:
        docs[doc_id].append(whole.encode(text or "", add_special_tokens=False).ids + [0])
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc_id, (ids, *more) in docs.items():
        at = 0
        for start, n, crc, total in sorted(by_doc.pop(doc_id))[::1 + len(more)]:
            assert start == at and total == len(ids) and n > 0
            assert crc == zlib.crc32(np.array(ids[at:at + n], "<u4").tobytes())
            at += n
        assert at == len(ids)
    assert not by_doc
    for spans in by_seq.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= window
    assert sorted(by_seq) == list(range(len(by_seq)))
    return 1 - sum(r["length"] for r in got) / (window * len(by_seq)) if by_seq else 0


def test_packs_whole_documents(docs_of):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choices(["alpha", "bé", "\n", "12", "x  y"], k=rnd.randint(0, 120)))) for i in range(400)]
    rows += [(1000 + i, "copy of one text " * 20) for i in range(150)] + [(2000, None), (2001, "word " * 3000), (None, "null id")]
    clash = docs_of(rows).selectExpr("*", "1 AS length", "2 AS start", "3 AS _rank").repartition(4)
    assert check(rows, P.pack(clash, BYTE, window=128).collect(), 128) < 0.03


def test_edges(docs_of):
    assert P.pack(docs_of([]), BYTE).count() == 0
    rows = [(1, "same"), (1, "same"), (2, "")]
    got = P.pack(docs_of(rows), BYTE, window=16).collect()
    assert sorted((r["doc_id"], r["length"]) for r in got) == [(1, 2), (1, 2), (2, 1)]


def test_plan_uses_histogram_exactly():
    rng = np.random.default_rng(0)
    hot = np.minimum(1023, 1 + rng.lognormal(6, 0.8, 20_000).astype(int) % 1023)
    hot[:7000] = 700
    for lengths in (hot, hot[:50], np.array([1024, 1024, 600, 600, 600]), np.array([1])):
        hist = np.bincount(lengths, minlength=1025)
        strategies, cuts = P.plan_with_cuts(hist)
        used = np.zeros(1025, np.int64)
        for s, r in strategies:
            assert sum(s) <= 1024 and r > 0
            np.add.at(used, list(s), r)
        want = hist - cuts
        want[512] += cuts.sum()
        want[:512] += cuts[512:1024]
        assert (used == want).all()
    strategies, _ = P.plan_with_cuts(np.bincount(hot, minlength=1025))
    assert 1 - hot.sum() / 1024 / sum(r for _, r in strategies) < 0.03


def test_least_squares_against_active_pairs():
    """On a histogram that combinations can match exactly the residual vanishes."""
    combos = P.combinations(64)
    assert (combos.sum(axis=1) == 64).all() and len({tuple(c) for c in combos}) == len(combos)
    x = np.zeros(len(combos))
    x[[3, 50, 99]] = [40, 7, 12]
    hist = np.zeros(65)
    for c, n in zip(combos, x):
        for k in c[c > 0]:
            hist[k] += n
    got = P.nnls(combos, hist, 2000)
    assert (got >= 0).all()
    fit = np.zeros(65)
    for c, n in zip(combos, got):
        for k in c[c > 0]:
            fit[k] += n
    assert np.abs(fit - hist).max() < 0.1


def test_plan_needs_no_further_workers(docs_of, capsys):
    """The tables of the plan are no Python rows: those are read by workers
    beside the ones that encode."""
    P.pack(docs_of([(i, "word " * i) for i in range(40)]), BYTE, window=32).explain()
    shown = capsys.readouterr().out
    assert shown.count("LocalTableScan [length#") == 2 and "ExistingRDD[length#" not in shown
