"""Operator 11: removal of repeated substrings by Rabin-Karp window hashes.

A window is ``size`` consecutive words of one text.  A word is removed if a
window that covers it also starts, word for word, in a document with a smaller
id.  Windows are judged on the input.

Every window gets a rolling hash; Spark counts where equal ones start.  So that
not every window has to be shuffled, windows travel in bundles:

1. The *anchor* of a window is the smallest rolling hash of ten words inside
   it, so equal windows have equal anchors.  Neighbouring windows with one
   anchor form a *span*, named by its anchor and the rolling hash of its words
   (128 bits; so is a window, by its anchor and its own hash).
2. Spans are counted: where a span also is in a document with a smaller id,
   all its windows are, and all its words go.
3. A span that is in no smaller document can still share windows with other
   spans of its anchor.  Those spans -- each distinct one once, however many
   documents have it -- are opened: their windows are counted one by one.
   Windows whose anchor is in one document only cannot be repeated.
4. The ranges found in a document are merged into maximal intervals.

A name that very many rows have (a passage that a third of all documents
share) is looked up by broadcast: names with at least one in ``HOT`` of the
rows, so at most ``HOT`` of them; all other names by an ordinary join.

Defined results: a null text has no words; a null id counts as larger than any
other; rows with equal ids do not remove each other's words, and repeated rows
get equal results; a text with fewer than ``size`` words has no window; an
empty table gives no rows.  Extra input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from periodix.llm import wordhash
from periodix.llm.common import prepare, shared_folder, table

SIZE = 50        # words of a window
ANCHOR = 10      # words of an anchor
HOT = 2000       # names that are broadcast at most
LAST_ID = (1 << 63) - 1
KEY = ("doc", "k1", "k2")  # id (null: LAST_ID) and two hashes of the text

_SPANS = pa.schema([(c, pa.int64()) for c in ("anchor", "span", *KEY, "at", "n")])
_WINDOWS = pa.schema([(c, pa.int64()) for c in ("anchor", "win", "span", "doc", "off")])
_SECOND = np.uint64(0x5851F42D4C957F2D)


class Rolling:
    """Rolling hashes of word ranges of some texts, laid end to end."""

    def __init__(self, hashes: list[np.ndarray]):
        self.n_words = np.array([len(h) for h in hashes])
        words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        up, self.down = wordhash._power(len(words) + 1)
        self.sums = [self._sums(words * up[:len(words)]),
                     self._sums(wordhash.mix(words ^ _SECOND) * up[:len(words)])]

    @staticmethod
    def _sums(terms: np.ndarray) -> np.ndarray:
        out = np.zeros(len(terms) + 1, np.uint64)
        np.cumsum(terms, out=out[1:])
        return out

    def of(self, which: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash number ``which`` of the words from ``start`` to before ``end``."""
        sums = self.sums[which]
        return wordhash.mix((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def anchors(self, size: int, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and anchor of every window that lies in one text."""
        total = len(self.down) - 1
        if total < size:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.arange(total - length + 1)
        least, have, want = self.of(0, at, at + length), 1, size - length + 1
        while have < want:  # minimum over `have` neighbours, doubled
            step = min(have, want - have)
            least = np.minimum(least[:len(least) - step], least[step:])
            have += step
        text = np.repeat(np.arange(len(self.n_words)), self.n_words)
        starts = np.flatnonzero(text[:total - size + 1] == text[size - 1:])
        return starts, least[starts]


def _hashed(texts: list[str | None]) -> Iterator[tuple[int, Rolling]]:
    """Chunks of texts: number of the first one, and their rolling hashes."""
    chunk, held, first = [], 0, 0
    for k, text in enumerate(texts):
        chunk.append((text or "").encode("utf-8", "surrogatepass"))
        held += len(chunk[-1])
        if held >= wordhash.CHUNK:
            yield first, Rolling(wordhash._words(chunk, False))
            chunk, held, first = [], 0, k + 1
    if chunk:
        yield first, Rolling(wordhash._words(chunk, False))


def _int64(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _span_rows(size: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(k).to_numpy() for k in range(3)]
            for first, rolling in _hashed(batch.column(3).to_pylist()):
                starts, anchor = rolling.anchors(size, length)
                if not len(starts):
                    continue
                new = np.flatnonzero(np.r_[True, (np.diff(starts) != 1) | (anchor[1:] != anchor[:-1])])
                n = np.diff(np.append(new, len(starts)))
                begin, name = starts[new], anchor[new]
                offsets = np.r_[0, np.cumsum(rolling.n_words)]
                text = np.searchsorted(offsets, begin, side="right") - 1
                span = rolling.of(1, begin, begin + n + size - 1)
                yield pa.RecordBatch.from_arrays(
                    [_int64(name), _int64(span), *(_int64(k[first + text]) for k in keys),
                     _int64(begin - offsets[text]), _int64(n)], schema=_SPANS)

    return run


def _window_rows(size: int):
    """Windows of the listed spans ``(anchor, span, at, n)`` of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, listed = batch.column(0).to_numpy(), batch.column(2)
            edges = listed.offsets.to_numpy()
            fields = [listed.values.field(k).to_numpy() for k in range(4)]
            for first, rolling in _hashed(batch.column(1).to_pylist()):
                count = len(rolling.n_words)
                rows = slice(edges[first], edges[first + count])
                anchor, span, at, n = (f[rows] for f in fields)
                offsets = np.r_[0, np.cumsum(rolling.n_words)]
                text = np.repeat(np.arange(count), np.diff(edges[first:first + count + 1]))
                off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                begin = np.repeat(offsets[text] + at, n) + off
                yield pa.RecordBatch.from_arrays(
                    [_int64(np.repeat(anchor, n)), _int64(rolling.of(1, begin, begin + size)), _int64(np.repeat(span, n)),
                     _int64(np.repeat(docs[first + text], n)), _int64(off)], schema=_WINDOWS)

    return run


def _written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a table in the shared folder, so that it is computed once."""
    spark = df.sparkSession
    folder = shared_folder(spark, what)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def look_up(rows: DataFrame, names: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` joined with ``names`` on ``on``; a name's ``n`` says in how
    many of the rows it is.  ``rows`` is a written table, whose rows are
    counted from its footers."""
    least = max(2, rows.count() // HOT)
    hot = F.broadcast(names.where(F.col("n") >= least).withColumn("_hot", F.lit(True)))
    marked = rows.join(hot, on, "left")
    cold = marked.where(F.col("_hot").isNull()).select(rows.columns).join(names.where(F.col("n") < least), on)
    return marked.where("_hot").drop("_hot").unionByName(cold).drop("n")


def repeated_ranges(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``doc, k1, k2, ranges``: word ranges ``(at, n)`` of each text of
    ``docs(doc, k1, k2, text)`` that repeat a document with a smaller id; they
    may overlap."""
    length = min(ANCHOR, size)
    texts = docs.where(F.col("text").isNotNull())
    spans = _written(texts.select(*KEY, "text").mapInArrow(
        _span_rows(size, length), "anchor LONG, span LONG, doc LONG, k1 LONG, k2 LONG, at LONG, n LONG")
        .withColumnRenamed("n", "n_windows"), "spans")
    names = _written(spans.groupBy("anchor", "span").agg(
        F.min("doc").alias("first"), F.max("doc").alias("last"), F.count("*").alias("rows")), "span-names")

    # anchors in two documents or more; `_later`: some span of it came later than another
    anchors = names.groupBy("anchor").agg(
        F.min("first").alias("_first"), (F.max("first") > F.min("first")).alias("_later"),
        F.max("last").alias("_last"), F.count("*").alias("n")).where("_first < _last").drop("_last")
    related = look_up(names, anchors, ["anchor"]).where("first < last OR _later").select(
        "anchor", "span", "first", "_later", (F.col("first") > F.col("_first")).alias("_ask"), F.col("rows").alias("n"))
    found = _written(look_up(spans, related, ["anchor", "span"]).where("doc > first OR _later"), "found-spans")

    whole = found.where("doc > first").select(*KEY, "at", (F.col("n_windows") + (size - 1)).alias("n"))

    opened = found.where("doc = first AND _later").dropDuplicates(["anchor", "span"])
    listed = opened.groupBy(*KEY).agg(F.collect_list(F.struct("anchor", "span", "at", "n_windows")).alias("listed"))
    once = texts.select(*KEY, "text").dropDuplicates(list(KEY))
    windows = _written(once.join(listed, list(KEY)).select("doc", "text", "listed").mapInArrow(
        _window_rows(size), "anchor LONG, win LONG, span LONG, doc LONG, off LONG"), "windows")
    counted = windows.groupBy("anchor", "win").agg(
        F.min("doc").alias("first"), F.max("doc").alias("last"), F.count("*").alias("n")).where("first < last").drop("last")
    repeated = look_up(windows, counted, ["anchor", "win"]).where("doc > first").select("anchor", "span", "off")
    single = found.where("doc = first AND _ask").join(repeated, ["anchor", "span"]).select(
        *KEY, (F.col("at") + F.col("off")).alias("at"), F.lit(size).cast("long").alias("n"))

    # at most the windows of one text in a list
    return whole.unionByName(single).groupBy(*KEY).agg(F.collect_list(F.struct("at", "n")).alias("ranges"))


def merged(at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal intervals (start, end) of ranges that may overlap or touch."""
    order = np.argsort(at, kind="stable")
    start, end = at[order], np.maximum.accumulate((at + n)[order])
    new = np.flatnonzero(np.r_[True, start[1:] > end[:-1]])
    return start[new], end[np.append(new[1:], len(start)) - 1]


_KEPT = "doc_id LONG, n_words LONG, n_removed LONG, kept STRING, removed ARRAY<STRUCT<start: LONG, end: LONG>>"
_KEPT_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()),
    ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ranges = batch.column(2)
        edges, sizes = ranges.offsets.to_numpy(), ranges.value_lengths().fill_null(0).to_numpy()
        at, n = (ranges.values.field(k).to_numpy() for k in (0, 1))
        n_words, n_removed, kept, removed = [], [], [], []
        for k, text in enumerate(batch.column(1).to_pylist()):
            words = (text or "").encode().split()  # splits bytes at exactly the separators
            n_words.append(len(words))
            if not sizes[k]:
                n_removed.append(0)
                removed.append([])
                kept.append(b" ".join(words).decode())
                continue
            rows = slice(edges[k], edges[k] + sizes[k])
            start, end = (x.tolist() for x in merged(at[rows], n[rows]))
            left = [w for a, b in zip([0, *end], [*start, len(words)]) for w in words[a:b]]
            n_removed.append(len(words) - len(left))
            removed.append([{"start": a, "end": b} for a, b in zip(start, end)])
            kept.append(b" ".join(left).decode())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) if isinstance(c, list) else c
             for c, f in zip([batch.column(0), n_words, n_removed, kept, removed], _KEPT_ARROW)], schema=_KEPT_ARROW)


def remove_repeated(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``doc_id, n_words, n_removed, kept, removed`` of every row of
    ``docs(doc_id, text)``: the words kept, joined by a blank, and the maximal
    intervals of word numbers removed."""
    prepare(docs.sparkSession)
    text = docs["text"]
    keyed = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), text, F.coalesce(docs["doc_id"], F.lit(LAST_ID)).cast("long").alias("doc"),
        F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"))
    return (keyed.join(repeated_ranges(keyed, size), list(KEY), "left")
            .select("doc_id", "text", "ranges").mapInArrow(_cut, _KEPT))


def op11_rolling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = """
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM t),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM s),
f AS (SELECT h, min(doc_id) AS first FROM h GROUP BY h),
c AS (SELECT DISTINCT doc_id, i + unnest(range(0, 50)) AS p FROM h JOIN f USING (h) WHERE first < doc_id),
g AS (SELECT doc_id, list(p) AS gone FROM c GROUP BY doc_id),
k AS (SELECT t.doc_id, w, list_filter(range(1, len(w) + 1), lambda i: gone IS NULL OR NOT list_contains(gone, i)) AS kept
      FROM t LEFT JOIN g USING (doc_id))
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - len(kept))::BIGINT AS n_removed,
       sha256(array_to_string(list_transform(kept, lambda i: w[i]), ' ')) AS kept_sha256 FROM k
"""
