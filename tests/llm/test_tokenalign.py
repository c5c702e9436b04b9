import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from periodix.llm import tokenalign as T

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = ["", " ", "\n", "a  b", "a \n b", "\n\nx\n\n\ny ", "tab\there", "It's we'll \x1c odd\x1fspace", "nb\xa0sp \x85 x",
       "<|endoftext|> and <s> </s> <unk>", "日本語 テキスト 。", "é é ﬁ Ⅷ", "a\0b c", "x" * 3000, "emoji 🙂🙂 ok",
       "  lead", "trail  ", "▁low", "one ▁ two", "<0x41> lone", "\nstart", " one", "\r\n crlf\r\n", "ab " * 700, "﻿bom"]


def brute(texts):
    """Whole-text encoding, groups by common ends, links by equal ends."""
    a_tok, b_tok = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a_tok.encode_special_tokens = True
    shown = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or c >= 174]
    back = {chr(c): c for c in shown} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in shown)}
    a_names = {k: v for v, k in a_tok.get_vocab().items()}

    def b_bytes(k):
        piece = b_tok.id_to_piece(k)
        return bytes([int(piece[3:5], 16)]) if b_tok.is_byte(k) else piece.replace("▁", " ").encode()

    rows, counts = [], Counter()
    for text in texts:
        a = a_tok.encode(" " + (text or ""), add_special_tokens=False).ids
        b = b_tok.encode(text or "")
        a_parts, b_parts = [bytes(back[c] for c in a_names[k]) for k in a], [b_bytes(k) for k in b]
        if not text or not b"".join(a_parts) == b"".join(b_parts) == (" " + text).encode():
            rows.append((0, 0, 0, [], ""))
            continue
        ends_a, ends_b = (list(np.cumsum([len(x) for x in p])) for p in (a_parts, b_parts))
        groups, links, i, j = [], [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            left = [k for k, e in zip(a[i:], ends_a[i:]) if e <= end]
            right = [k for k, e in zip(b[j:], ends_b[j:]) if e <= end]
            groups.append(",".join(map(str, left)) + "|" + ",".join(map(str, right)))
            i, j = i + len(left), j + len(right)
            links += [(a[x], b[y]) for x in range(len(a)) if ends_a[x] == end for y in range(len(b)) if ends_b[y] == end]
        counts.update(links)
        rows.append((len(a), len(b), len(groups), links, ";".join(groups)))
    top = {}
    for (_, k), n in counts.items():
        top[k] = max(top.get(k, 0), n)
    return [(x, y, g, len(links), sum(counts[p] == top[p[1]] for p in links), sum(counts[p] for p in links),
             hashlib.sha256(s.encode()).hexdigest() if s else "") for x, y, g, links, s in rows]


def made(n, seed=5):
    rnd = random.Random(seed)
    parts = [" ", "\n", "  ", "\t", "\n\n", "The", "er.", "é", "’s", "'s", "12", "\x1d", " ", "ß", "!?", "\0", "́", "</s>"]
    return ["".join(rnd.choices(parts, k=rnd.randint(1, 30))) for _ in range(n)]


def summary(docs):
    aligned = T.alignments(docs, A, B)
    return T.summaries(aligned, T.pair_counts(aligned), 32000)


@pytest.mark.parametrize("memory", [20, 100_000])
def test_units_equal_whole_text(memory):
    texts = ODD + [None] + made(600)
    known = T.UnitAligner(A, B, memory)
    for _ in range(2):
        got = [r for k in range(0, len(texts), 50) for r in known.rows(texts[k:k + 50])]
        for row, want in zip(got, brute(texts)):
            digest = hashlib.sha256(row[4].encode()).hexdigest() if row[4] else ""
            assert (*row[:4], digest) == (*want[:4], want[6])
    assert len(known.known) <= memory


def test_query_against_brute_force(docs_of):
    texts = ODD + [None, ODD[9], ODD[9]] + made(150, 8)
    rows = list(enumerate(texts))
    clash = docs_of(rows).selectExpr("*", "1 AS n_a", "'x' AS links", "2 AS pair").repartition(3)
    got = {r["doc_id"]: tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))
           for r in summary(clash).collect()}
    assert got == dict(enumerate(brute(texts)))


def test_edges(docs_of):
    assert summary(docs_of([])).count() == 0
    rows = [(None, "same text"), (3, "same text"), (3, "same text"), (4, None)]
    got = sorted(summary(docs_of(rows)).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    assert [r["doc_id"] for r in got] == [3, 3, 4, None]
    assert got[0]["count_sum"] == 3 * got[0]["n_links"] and got[2]["groups_sha256"] == "" and got[2]["n_a"] == 0


def test_overlaps_and_groups_by_definition():
    rng = np.random.default_rng(2)
    for _ in range(50):
        end = rng.integers(5, 40)
        a, b = (np.append(np.flatnonzero(rng.random(end - 1) < 0.4) + 1, end) for _ in range(2))
        spans = lambda e: list(zip([0, *e[:-1]], e))
        want = [(i, j) for i, (s, e) in enumerate(spans(a)) for j, (t, f) in enumerate(spans(b)) if s < f and t < e]
        assert list(zip(*(x.tolist() for x in T.overlaps(a, b)))) == want
        a_group, b_group = T.coalesce(a, b)
        cuts = sorted(set(a) & set(b))
        assert a_group.tolist() == np.searchsorted(cuts, a).tolist()
        assert b_group.tolist() == np.searchsorted(cuts, b).tolist()


def test_linked_pairs_are_within_the_bound():
    v = T.Vocabularies(A, B)
    assert 32_000 < T.pair_bound(A, B) < 2_000_000
    for text in made(100):
        ids = v.encode(" " + text)
        if ids:
            a, b = (np.cumsum([len(t[k]) for k in x]) for x, t in zip(ids, (v.a_bytes, v.b_bytes)))
            for i, j in zip(*T.overlaps(a, b)):
                if a[i] == b[j]:
                    x, y = v.a_bytes[ids[0][i]], v.b_bytes[ids[1][j]]
                    assert x.endswith(y) or y.endswith(x)
