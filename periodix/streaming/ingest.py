"""Incremental ingest of newly arriving filings with Structured Streaming.

The reference loads a directory once.  When filings keep arriving (one
workbook per reporting date), the same S1-S4 decode and normalisation run
as a file-source stream: each micro-batch holds whole workbooks, so the
per-sheet logic of ``normalise_sheets`` sees complete sheets.  Output goes
to ``{out}/filings`` and ``{out}/parse_errors``, written per batch id with
overwrite semantics, so a batch replayed after a failure replaces its own
files instead of duplicating them.  Progress lives in ``checkpoint`` (a
shared folder on a cluster).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from periodix.operators.normalise import normalise_sheets
from periodix.sources.xlsx import RAW_SCHEMA, _decode_batches

BINARY_FILE_SCHEMA = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def workbook_stream(spark: SparkSession, directory: str, glob: str = "*.xlsx",
                    max_files_per_trigger: int = 64) -> DataFrame:
    """Streaming ``RAW_SCHEMA`` rows for workbooks as they land."""
    files = (
        spark.readStream.format("binaryFile")
        .schema(BINARY_FILE_SCHEMA)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .load(directory)
        .select("path", "content")
    )
    return files.mapInPandas(_decode_batches, RAW_SCHEMA)


def _writer(out_dir: str):
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # decode each workbook once for both outputs
        try:
            cells = batch.filter(F.col("error").isNull()).drop("error")
            decode_errors = batch.filter(F.col("error").isNotNull()).select("file", "sheet", "error")
            filings, sheet_errors = normalise_sheets(cells)
            filings.write.mode("overwrite").parquet(f"{out_dir}/filings/batch_id={batch_id}")
            (decode_errors.unionByName(sheet_errors)
             .write.mode("overwrite").parquet(f"{out_dir}/parse_errors/batch_id={batch_id}"))
        finally:
            batch.unpersist()

    return write_batch


def start_ingest(spark: SparkSession, directory: str, out_dir: str, checkpoint: str,
                 available_now: bool = True) -> StreamingQuery:
    """Start the ingest; ``available_now=True`` processes what is there and stops."""
    stream = workbook_stream(spark, directory)
    w = stream.writeStream.foreachBatch(_writer(out_dir)).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def read_ingested(spark: SparkSession, out_dir: str) -> DataFrame:
    """All filings ingested so far (the batch id is a partition column)."""
    return spark.read.parquet(f"{out_dir}/filings")
