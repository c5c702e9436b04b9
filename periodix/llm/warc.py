"""Operator 7: WARC archives of individually compressed records with an
embedded Zstandard dictionary.

A dictionary is trained on a bounded sample of the records (about
``SAMPLE_RECORDS`` of them, ``SAMPLE_BYTES`` of each).  Every task writes one
archive: a leading skippable frame (magic 0x184D2A5D) with the dictionary,
then one Zstandard frame per record, so any record can be read by itself and
a reader needs nothing but the file.  Equal payloads of at least
``MIN_REVISIT`` bytes are stored once, as the response of the page with the
smallest id; the others are revisit records that refer to it.  The digests are
aggregated first (map-side), so only one row per digest and task is shuffled
for a payload that many pages share.

Defined results: a null html is an empty payload; a page without an id is
written without that header, comes back null and is never the one others
refer to; rows repeated with one id and payload are the same page, so each is
a response if the id is the smallest; an empty table gives no archive.  Extra
input columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from periodix.llm.common import shared_folder, store, table

MIN_REVISIT = 100
SAMPLE_RECORDS = 1024    # expected size of the dictionary's sample
SAMPLE_BYTES = 1 << 16
DICT_BYTES = 112_640
SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"  # the table has no capture dates
MANIFEST = "part INT, path STRING, n_records LONG"
RECORDS = "page_id LONG, payload_bytes LONG, payload_digest STRING, record_type STRING, refers_to LONG"


def classify(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """``pages(page_id, url, html)`` -> ``page_id, url, payload, digest,
    first`` (``first``: the page that holds a shared payload, or null)."""
    rows = pages.select(
        pages["page_id"], pages["url"], F.encode(F.coalesce(pages["html"], F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    firsts = (rows.where(F.octet_length("payload") >= min_revisit).groupBy("digest")
              .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    return rows.join(firsts, "digest", "left")


def train(pages: DataFrame, records: int = SAMPLE_RECORDS) -> bytes:
    """A dictionary from a bounded sample of pages, chosen by hash; empty if
    there is nothing to learn from."""
    n = pages.count()
    if not n:
        return b""
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n))
    sample = pages.where(part < records).select(
        F.substring(F.encode(F.coalesce("html", F.lit("")), "UTF-8"), 1, SAMPLE_BYTES).alias("s"))
    samples = [_http(len(r["s"])) + bytes(r["s"]) for r in sample.collect()]  # about `records` rows
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too little text: the text itself serves
        return b"".join(samples)[:DICT_BYTES]


def _http(n: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()


def _record_id(page_id, digest: str) -> str:
    return uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}:{digest}").urn


def record(page_id, url, payload: bytes, digest: str, first) -> bytes:
    """One WARC/1.1 record: a response, or a revisit of page ``first``."""
    revisit = first is not None and first != page_id
    block = _http(len(payload)) + (b"" if revisit else payload)
    name = uuid.uuid4().urn if revisit or page_id is None else _record_id(page_id, digest)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: <{name}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(url.split()))
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_record_id(first, digest)}>",
                 f"WARC-Refers-To-Page-ID: {first}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response",
             f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT, level: int = 6) -> DataFrame:
    """Write ``pages(page_id, url, html)`` below ``folder``; return the
    manifest ``part, path, n_records`` of the files that count."""
    spark = pages.sparkSession
    file_system, path = store(folder)
    file_system.create_dir(path, recursive=True)
    dictionary = train(pages)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            if out is None:
                part = TaskContext.get().partitionId()
                uri = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.warc.zst"
                target, name = store(uri)
                out, n = target.open_output_stream(name, compression=None), 0
                known = zstandard.ZstdCompressionDict(dictionary)
                zip_ = zstandard.ZstdCompressor(level=level, dict_data=known if dictionary else None)
                out.write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
                info = b"software: periodix\r\n"
                out.write(zip_.compress(
                    f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <{uuid.uuid4().urn}>\r\nWARC-Date: {DATE}\r\n"
                    f"Content-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode()
                    + info + b"\r\n\r\n"))
            for r in batch.to_pylist():
                out.write(zip_.compress(record(r["page_id"], r["url"], r["payload"], r["digest"], r["first"])))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [uri], "n_records": [n]})

    rows = classify(pages, min_revisit).select("page_id", "url", "payload", "digest", "first")
    return spark.createDataFrame(rows.mapInArrow(write, MANIFEST).collect(), MANIFEST)  # one row per file


def records(uri: str) -> Iterator[tuple[dict, bytes]]:
    """Headers and block of every record of one archive, read as a stream."""
    file_system, path = store(uri)
    with file_system.open_input_stream(path, compression=None) as raw:
        magic, n = struct.unpack("<II", raw.read(8))
        if magic != SKIPPABLE:
            raise ValueError(f"{uri}: no leading dictionary frame")
        dictionary = raw.read(n)
        unzip = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if n else None)
        stream = unzip.stream_reader(raw, read_across_frames=True)
        held = b""

        def take(n: int) -> bytes:
            nonlocal held
            parts, have = [held], len(held)
            while have < n:
                more = stream.read(max(1 << 16, n - have))
                if not more:
                    raise ValueError(f"{uri}: ends within a record")
                parts.append(more)
                have += len(more)
            data = b"".join(parts)
            held = data[n:]
            return data[:n]

        while True:
            while (end := held.find(b"\r\n\r\n")) < 0:
                more = stream.read(1 << 16)
                if not more:
                    if held:
                        raise ValueError(f"{uri}: ends within a header")
                    return
                held += more
            version, *lines = take(end + 4)[:-4].decode().split("\r\n")
            if version != "WARC/1.1":
                raise ValueError(f"{uri}: not a record: {version[:40]}")
            head = dict(line.split(": ", 1) for line in lines)
            block = take(int(head["Content-Length"]))
            if take(4) != b"\r\n\r\n":
                raise ValueError(f"{uri}: a record's length is wrong")
            yield head, block


def read_archives(manifest: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of
    every record; a response's are taken from its payload and compared with
    its headers."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: None if x is None else int(x)
        for batch in batches:
            for uri, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out: list[tuple] = []
                for head, block in records(uri):
                    if head["WARC-Type"] == "warcinfo":
                        continue
                    http, payload = block.split(b"\r\n\r\n", 1)
                    n = int(http.rsplit(b"Content-Length: ", 1)[1])
                    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                    if head["WARC-Type"] == "response":
                        if n != len(payload) or digest != hashlib.sha256(payload).hexdigest():
                            raise ValueError(f"{uri}: {head['WARC-Record-ID']} differs from its headers")
                    out.append((number(head.get("WARC-Page-ID")), n, digest, head["WARC-Type"],
                                number(head.get("WARC-Refers-To-Page-ID"))))
                    if len(out) == 4096:
                        expected -= len(out)
                        yield _rows(out)
                        out = []
                if expected != len(out):
                    raise ValueError(f"{uri}: {expected - len(out)} records are missing")
                yield _rows(out)

    files = manifest.select("path", "n_records")
    return files.repartition(max(1, files.count())).mapInArrow(read, RECORDS)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in RECORDS.split(", ")))
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.string() if k == "STRING" else pa.int64()) for c, k in zip(columns, kinds)], names=names)


def op7_dictionary_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    return read_archives(write_archives(pages, shared_folder(spark, "warc")))


SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha256(h) AS payload_digest,
    CASE WHEN n >= {MIN_REVISIT} AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN n >= {MIN_REVISIT} AND first <> page_id THEN first END AS refers_to FROM f
"""
