import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from periodix.llm import units as U
from periodix.llm.encoder import UnitEncoder
from periodix.llm.tokenfiles import read_token_files, write_token_files

WORD, BYTE = (public_tokenizers.path(f"{n}.json") for n in ("word_bpe_49k", "byte_bpe_50k"))
ODD = ["", " ", "\n", "a  b", "a \n b", "\n\nx\n\n\ny ", "tab\there", "It's we'll \x1c odd\x1fspace", "nb\xa0sp \x85 x",
       "<|endoftext|> and <|startoftext|>", "日本語 テキスト 。", "é é ﬁ Ⅷ", "a\0b c", "x" * 3000, "emoji 🙂🙂 ok", "  lead", "trail  ",
       "a <|endoftext|> b", "<|endoftext|><|startoftext|>x", "no<|endoftext|>blank <|EndOfText|> <|endoftext |>", "İstanbul ΣΑΣ ǅ ﬀ Å é"]


@pytest.mark.parametrize("path,spaced", [(WORD, False), (BYTE, True)])
@pytest.mark.parametrize("chunk", [40, 1 << 21])
def test_units_equal_whole_text(monkeypatch, path, spaced, chunk):
    rnd = random.Random(5)
    parts = [" ", "\n", "  ", "\t", "\n\n", "The", "er.", "é", "’s", "'s", "12", "\x1d", " ", "ß", "!?", "\0", "́", "<|endoftext|>", "İ", "Σ", "Å"]
    texts = ODD + ["".join(rnd.choices(parts, k=rnd.randint(1, 30))) for _ in range(2000)]
    whole = Tokenizer.from_file(path)
    want = [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(U, "CHUNK", chunk)
    monkeypatch.setattr(U.pieces, "__defaults__", (chunk,))
    for memory in (10, 100_000):
        code = UnitEncoder(path, spaced, memory)
        for _ in range(2):
            assert [ids.tolist() for ids in code.encode(texts)] == want
        assert len(code.known) <= memory
        assert list(code.encode([])) == [] and [len(x) for x in code.encode([None, "", " "])][:2] == [0, 0]


def test_memory_of_a_worker():
    """Beside what it remembers, a worker takes little for the texts at hand."""
    rnd = random.Random(7)
    texts = [" ".join(rnd.choices(["alpha", "beta", "gamma,", "delta."], k=600)) for _ in range(1000)]
    code = UnitEncoder(BYTE, True)
    sum(map(len, code.encode(texts[:1])))
    tracemalloc.start()
    try:
        assert sum(map(len, code.encode(texts))) >= 600_000
        assert tracemalloc.get_traced_memory()[1] < 60e6
    finally:
        tracemalloc.stop()
    assert code.known.most * 40 <= 40e6


def test_memory_against_a_dictionary():
    rng = np.random.default_rng(3)
    known, want = U.Memory(np.dtype("<u2"), 300), {}
    for _ in range(30):
        units = rng.choice(1000, 40, replace=False)
        names = ((units // 2).astype(np.uint64), units.astype(np.uint64))  # pairs share their first hash
        at = known.find(names)
        for u, k in zip(units, at):
            assert (k >= 0) == (u in want)
            if k >= 0:
                assert known.values[known.starts[k]:][:known.sizes[k]].tolist() == want[u]
        new = [k for k in np.flatnonzero(at < 0) if not {units[k], units[k] ^ 1} & want.keys()]
        new = [k for k in new if units[k] ^ 1 not in units[new]]
        sizes = rng.integers(0, 4, len(new))
        values = rng.integers(0, 99, sizes.sum()).astype("<u2")
        known.add((names[0][new], names[1][new]), sizes, values)
        for k, size, end in list(zip(new, sizes, np.cumsum(sizes)))[:300 - len(want)]:
            want[units[k]] = values[end - size:end].tolist()
    assert len(known) == len(want) <= 300


def test_units_that_differ_in_one_hash_only(monkeypatch):
    monkeypatch.setattr(U.wordhash, "_BYTE", np.zeros(256, np.uint64))  # the first hash sees lengths only
    cut = U.Cut(["ab cd ab", "cd x"], False)
    units = cut.bytes_of()
    assert [units[k] for k in cut.which] == [b"ab", b"cd", b"ab", b"cd", b"x"] and cut.edges.tolist() == [0, 3, 5]


def expected(rows):
    whole, start, out = Tokenizer.from_file(WORD), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = whole.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_round_trip(docs_of, tmp_path):
    rows = [(i * 37 % 211, " ".join(["lorem", "ipsüm", "#2"] * (i % 50))) for i in range(211)]
    rows += [(900 + i, t) for i, t in enumerate(ODD)] + [(-5, None), (950, "long word " * 4000)]
    clash = docs_of(rows).selectExpr("*", "1 AS part", "'x' AS path", "2 AS start").repartition(5)
    manifest = write_token_files(clash, str(tmp_path), WORD, length=64, n_files=4)
    assert sorted(map(tuple, read_token_files(manifest).collect())) == sorted(expected(rows))
    for m in manifest.collect():
        with pa.memory_map(m["path"]) as f:
            t = pa.ipc.open_file(f)
            assert t.schema.field("ids").type == pa.list_(pa.uint16(), 64)
            masks = [b.column(1).values.to_numpy(zero_copy_only=False) for b in map(t.get_batch, range(t.num_record_batches))]
            assert sum(map(np.sum, masks)) == m["n_ids"]
            assert all(x.all() for x in masks[:-1])


def test_edges(docs_of, tmp_path):
    empty = write_token_files(docs_of([]), str(tmp_path / "none"), WORD)
    assert read_token_files(empty).count() == 0
    rows = [(None, "a b"), (3, "same"), (3, "same"), (3, None)]
    got = read_token_files(write_token_files(docs_of(rows), str(tmp_path / "ties"), WORD, length=4)).collect()
    assert sorted(r["start"] for r in got)[0] == 0 and sum(r["n_tokens"] for r in got) == 3 + 2 + 2 + 1
    assert sorted(r["doc_id"] is None for r in got) == [False, False, False, True]
