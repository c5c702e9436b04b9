"""Operator 5: token ids as Arrow files of equal-length sequences.

A range shuffle deals the documents out in ascending id order; each task
encodes its documents one after the other, appends the end id, and writes the
stream of ids to one Arrow IPC file whose record batches hold fixed-size
lists: ``ids`` (unsigned integers) and ``mask`` (true for an id, false for
padding, which only a file's last sequence has).  Every sequence has the same
length, so sequence ``k`` lies at a computed place and a reader maps it
without copying.  A second Arrow file beside it lists the documents (id,
start within the file, ids).  Tasks write under names of their own and report
them; the manifest names the files of the attempts that succeeded, so retried
or speculative tasks leave no trace in a result.

Defined results: a null text is empty and has the end id only; a null
document id sorts first; repeated rows are separate documents; an empty table
gives no files and no rows.  Extra input columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from periodix.llm.common import shared_folder, shuffle_partitions, store, table
from periodix.llm.encoder import encoder

LENGTH = 2048        # ids of a sequence
BATCH = 64           # sequences of a record batch
MANIFEST = "part INT, path STRING, n_docs LONG, n_ids LONG"
DIGEST = "doc_id LONG, start LONG, n_tokens LONG, ids_crc32 LONG"


INDEX_ROWS = 1 << 16  # documents of a record batch of the index
INDEX = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "n_ids")])


class SequenceWriter:
    """One task's two Arrow files; holds at most one record batch of each."""

    def __init__(self, uri: str, dtype: np.dtype, length: int, end_id: int):
        self.fs, self.path = store(uri)
        self.length, self.dtype = length, dtype
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema(
            [("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))],
            {"sequence_length": str(length), "end_id": str(end_id)})
        self.sink = self.fs.open_output_stream(self.path, compression=None)
        self.file = pa.ipc.new_file(self.sink, self.schema)
        self.index_sink = self.fs.open_output_stream(self.path + ".index", compression=None)
        self.index = pa.ipc.new_file(self.index_sink, INDEX)
        self.held: list[np.ndarray] = []
        self.n_held, self.n_ids, self.n_docs, self.docs = 0, 0, 0, []

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append((doc_id, self.n_ids, len(ids)))
        self.n_docs += 1
        if len(self.docs) == INDEX_ROWS:
            self._list()
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        if self.n_held >= BATCH * self.length:
            self._flush(self.n_held // self.length * self.length)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, self.dtype)
        ids, rest = ids[:n], ids[n:]
        self.held, self.n_held = ([rest] if len(rest) else []), len(rest)
        pad = -len(ids) % self.length
        mask = np.arange(len(ids) + pad) < len(ids)
        flat = np.concatenate([ids, np.zeros(pad, self.dtype)])
        for at in range(0, len(flat), BATCH * self.length):
            cut = slice(at, at + BATCH * self.length)
            self.file.write_batch(pa.record_batch(
                [pa.FixedSizeListArray.from_arrays(pa.array(flat[cut]), self.length),
                 pa.FixedSizeListArray.from_arrays(pa.array(mask[cut]), self.length)], schema=self.schema))

    def _list(self) -> None:
        """One record batch of the index."""
        columns = list(zip(*self.docs)) or [()] * len(INDEX)
        self.index.write_batch(pa.record_batch([pa.array(c, pa.int64()) for c in columns], schema=INDEX))
        self.docs = []

    def close(self) -> None:
        if self.n_held:
            self._flush(self.n_held)
        self._list()
        for x in (self.file, self.sink, self.index, self.index_sink):
            x.close()


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 2,
                      length: int = LENGTH, n_files: int | None = None) -> DataFrame:
    """Encode ``docs(doc_id, text)`` into files below ``folder``; return the
    manifest ``part, path, n_docs, n_ids`` (one row per file, in id order)."""
    spark = docs.sparkSession
    file_system, path = store(folder)
    file_system.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        code, out = encoder(tokenizer_path, spaced=False), None
        end = np.array([end_id], code.dtype)
        for batch in batches:
            if out is None:
                uri = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.arrow"
                out = SequenceWriter(uri, code.dtype, length, end_id)
            ids = batch.column(0).to_pylist()
            for doc_id, tokens in zip(ids, code.encode(batch.column(1).to_pylist())):
                out.add(doc_id, np.concatenate([tokens, end]))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "path": uri, "n_docs": out.n_docs,
                                               "n_ids": out.n_ids}], schema=_arrow(MANIFEST))

    slim = docs.select(docs["doc_id"], docs["text"], F.monotonically_increasing_id().alias("_row"))
    ranged = (slim.repartitionByRange(n_files or shuffle_partitions(spark), "doc_id", "_row")
              .sortWithinPartitions("doc_id", "_row").select("doc_id", "text"))
    rows = ranged.mapInArrow(write, MANIFEST).collect()  # one row per file
    return spark.createDataFrame(sorted(rows, key=lambda r: r["part"]), MANIFEST)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"INT": pa.int32(), "LONG": pa.int64(), "STRING": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def read_token_files(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files.

    ``start`` counts ids over all files; files are read batch by batch (a
    local file is memory-mapped, its sequences are not copied)."""
    spark = manifest.sparkSession
    rows = sorted(manifest.collect(), key=lambda r: r["part"])  # one row per file
    based, base = [], 0
    for r in rows:
        based.append((r["path"], base))
        base += r["n_ids"]
    if not based:
        return spark.createDataFrame([], DIGEST)
    files = spark.createDataFrame(based, "path STRING, base LONG").repartition(len(based))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _digests(row["path"], row["base"])

    return files.mapInArrow(read, DIGEST)


def _digests(uri: str, base: int) -> Iterator[pa.RecordBatch]:
    file_system, path = store(uri)
    local = isinstance(file_system, pafs.LocalFileSystem)
    opened = (lambda p: pa.memory_map(p)) if local else file_system.open_input_file
    with opened(path) as data, opened(path + ".index") as listed:
        sequences, index = pa.ipc.open_file(data), pa.ipc.open_file(listed)
        stream = _ids(sequences)
        have, used, at = np.zeros(0, np.uint16), 0, 0
        for k in range(index.num_record_batches):
            docs = index.get_batch(k)
            crcs = []
            for start, n in zip(docs.column(1).to_pylist(), docs.column(2).to_pylist()):
                if start != at:
                    raise ValueError(f"{uri}: documents overlap or leave a gap at {at}")
                crc, left = 0, n
                while left:
                    if used == len(have):
                        have, used = next(stream), 0
                    piece = have[used:used + left]
                    crc = zlib.crc32(piece.astype("<u4").tobytes(), crc)
                    used, left = used + len(piece), left - len(piece)
                at += n
                crcs.append(crc)
            yield pa.RecordBatch.from_arrays(
                [docs.column(0), pa.array(np.asarray(docs.column(1)) + base), docs.column(2),
                 pa.array(crcs, pa.int64())], schema=_arrow(DIGEST))
        if used != len(have) or next(stream, None) is not None:
            raise ValueError(f"{uri}: ids beyond its last document")


def _ids(sequences) -> Iterator[np.ndarray]:
    """The ids of each record batch without its padding."""
    for k in range(sequences.num_record_batches):
        batch = sequences.get_batch(k)
        ids = batch.column(0).values.to_numpy(zero_copy_only=True)
        real = batch.column(1).values.true_count
        if real:
            yield ids[:real]


def op5_arrow_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    manifest = write_token_files(docs, shared_folder(spark, "sequences"),
                                 public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(manifest)
