"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import gc
import uuid

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from periodix.session import ensure_checkpoint_dir, ship_package

# Word separators of every contract in this subpackage: blank, tab, line
# feed, vertical tab, form feed, carriage return (all ASCII).
SEPARATORS = " \t\n\x0b\x0c\r"
SEPARATOR_CLASS = "[\\x20\\x09-\\x0D]"

# Rows of an Arrow batch handed to a Python worker.
BATCH_CONF, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One input table by any path Spark can read."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").select(*columns)


def prepare(spark: SparkSession) -> str:
    """Ship the package to executor Python workers; return the application's
    folder below the shared ``spark.checkpoint.dir``."""
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    if int(spark.conf.get(BATCH_CONF)) > BATCH_ROWS:  # whole texts: bound what a worker holds
        spark.conf.set(BATCH_CONF, str(BATCH_ROWS))
    return spark.sparkContext.getCheckpointDir() or ensure_checkpoint_dir(spark)


def shared_folder(spark: SparkSession, what: str) -> str:
    """A fresh folder name below the shared checkpoint folder."""
    return f"{prepare(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def store(uri: str):
    """File system and path of a folder or file name as Spark writes it."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder (never
    localCheckpoint: executors may be lost at any time)."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def drop_shuffles(spark: SparkSession) -> None:
    """Lets go of the shuffle files of results that are materialised by now:
    Spark deletes them when the driver's garbage is collected, which else may
    be long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def words_of(text):
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text column (null: none)."""
    parts = F.split(F.coalesce(text, F.lit("")), SEPARATOR_CLASS + "+")
    return F.array_remove(parts, "")


@contextlib.contextmanager
def no_collection():
    """Holds the cycle collector off while a worker makes very many small
    objects that form no cycles (walking them costs as much as making them)."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()
