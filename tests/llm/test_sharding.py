import zlib

from periodix.llm.sharding import shard_by_bytes


def brute(rows, n):
    total = sum(len((t or "").encode()) + 16 for _, t in rows)
    out, end, slots = [], 0, {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        size = len(data) + 16
        shard = min(n - 1, (2 * end + size) * n // (2 * total))
        end += size
        out.append((doc_id, size, zlib.crc32(data), shard, slots.setdefault(shard, 0)))
        slots[shard] += 1
    return out


def test_matches_brute_force(docs_of):
    rows = [(i * 7 % 101, "é" * (i * i % 37)) for i in range(101)] + [(500, None), (501, ""), (502, "x" * 5000)]
    got = [tuple(r) for r in shard_by_bytes(docs_of(rows).repartition(7), 6).collect()]
    assert sorted(got) == sorted(brute(rows, 6))
    sizes = [sum(r[1] for r in got if r[3] == s) for s in range(6)]
    assert max(sizes) - min(sizes) <= 5016 + max(r[1] for r in got if r[1] < 5000)


def test_edges(docs_of, spark):
    assert shard_by_bytes(docs_of([]), 5).count() == 0
    got = shard_by_bytes(docs_of([(None, "a"), (1, "b"), (1, "b"), (1, "c")]), 2).collect()
    assert sorted(r["slot"] for r in got if r["shard"] == 0) == [0, 1]
    assert {r["doc_id"] for r in got if r["shard"] == 0} == {None, 1}
    clash = docs_of([(1, "a"), (2, "b")]).selectExpr("*", "1 AS size", "2 AS shard", "3 AS _part")
    assert sorted(r["slot"] for r in shard_by_bytes(clash, 1).collect()) == [0, 1]
