import hashlib
import struct

import pytest
import zstandard

from periodix.llm import warc as W

SCHEMA = "page_id LONG, url STRING, html STRING"


def brute(rows):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        k = first.get(h or "")
        again = len(data) >= 100 and k is not None and k != i
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", k if again else None))
    return out


def page(k):
    return f"<html><head><title>é {k}</title></head><body>" + f"<p>paragraph {k}</p>\r\n\r\nWARC/1.1 " * (k % 40 + 3) + "</body></html>"


def test_round_trip(spark, tmp_path):
    rows = [(i, f"http://h{i}.example/ a", page(i % 60)) for i in range(200)]
    rows += [(500, None, None), (501, "u", ""), (502, "u\r\nX: y", "short"), (499, "u", "short"), (None, "u", page(3)),
             (600, "u", "x" * 3_000_000)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS first", "'d' AS digest").repartition(5)
    manifest = W.write_archives(df, str(tmp_path))
    assert sorted(map(str, map(tuple, W.read_archives(manifest).collect()))) == sorted(map(str, brute(rows)))
    for m in manifest.collect():
        data = open(m["path"], "rb").read()
        magic, n = struct.unpack("<II", data[:8])
        assert magic == 0x184D2A5D and n > 0
        known, at, frames = zstandard.ZstdCompressionDict(data[8:8 + n]), 8 + n, 0
        while at < len(data):  # every record is a frame of its own
            one = zstandard.ZstdDecompressor(dict_data=known).decompressobj()
            assert one.decompress(data[at:]).startswith(b"WARC/1.1\r\n")
            at, frames = len(data) - len(one.unused_data), frames + 1
        assert frames == m["n_records"] + 1


def test_edges(spark, tmp_path):
    empty = W.write_archives(spark.createDataFrame([], SCHEMA), str(tmp_path / "a"))
    assert W.read_archives(empty).count() == 0
    rows = [(7, "u", page(9))] * 3 + [(8, None, page(9))]
    got = W.read_archives(W.write_archives(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "b"))).collect()
    assert sorted(r["record_type"] for r in got) == ["response", "response", "response", "revisit"]
    assert {r["refers_to"] for r in got} == {None, 7}
    one = spark.createDataFrame([(1, "u", "")], SCHEMA)
    assert W.read_archives(W.write_archives(one, str(tmp_path / "c"))).collect()[0]["payload_bytes"] == 0


def test_broken_archive_is_refused(spark, tmp_path):
    m = W.write_archives(spark.createDataFrame([(1, "u", page(1))], SCHEMA), str(tmp_path)).collect()[0]
    data = open(m["path"], "rb").read()
    (tmp_path / "cut").write_bytes(data[:-9])
    cut = spark.createDataFrame([(0, str(tmp_path / "cut"), 1)], W.MANIFEST)
    with pytest.raises(Exception, match="missing|ends within"):
        W.read_archives(cut).collect()
