"""A store of named results, written once and read many times.

``publish`` writes each result as Parquet, partitioned by ``year`` where it has
one, into a folder of a version of its own, and only then appends that version
to the store's log.  Readers take the newest version of the log, so they see all
of a version or the one before it; nothing is overwritten.  ``prune`` deletes
versions that are no longer the newest.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from periodix.sources.sinks import save_results

LOG = "at LONG, version STRING"


def publish(results: dict[str, DataFrame], root: str) -> str:
    """Writes ``results`` as the store's newest version; returns its name."""
    if not results:
        raise ValueError("no results to publish")
    spark = next(iter(results.values())).sparkSession
    version = uuid.uuid4().hex
    save_results(results, f"{root}/versions/{version}")
    publish_version(spark, root, version)
    return version


def publish_version(spark: SparkSession, root: str, version: str) -> None:
    """Makes a version that is written whole the newest: one row, one file,
    which is there or is not."""
    spark.createDataFrame([(time.time_ns(), version)], LOG).coalesce(1).write.mode("append").json(f"{root}/log")


def versions(spark: SparkSession, root: str) -> list[str]:
    """Names of the published versions, newest first (a row per publication)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/log")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return []
    log = spark.read.schema(LOG).json(f"{root}/log")
    return [r["version"] for r in log.orderBy(F.desc("at"), "version").collect()]


class Store:
    """The newest version of a store as of the call; a reader keeps the
    version it began with until it opens the store again."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        published = versions(spark, root)
        if not published:
            raise ValueError(f"nothing is published in {root}")
        self.version = published[0]
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        """A result by name; its files are listed once."""
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.root}/versions/{self.version}/{name}")
        return self._tables[name]

    def query(self, name: str, **filters) -> DataFrame:
        """A result with one equality filter per keyword; a filter on
        ``year`` leaves the other years' folders unread."""
        out = self.table(name)
        for column, value in filters.items():
            out = out.filter(F.col(column) == F.lit(value))
        return out


def prune(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Deletes the folders of all but the newest ``keep`` versions."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    gone = versions(spark, root)[keep:]
    for version in gone:
        folder = path(f"{root}/versions/{version}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return gone
