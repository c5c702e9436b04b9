"""Writing results.

All writers are distributed (one file per task, no ``coalesce(1)``) and use
overwrite mode, so a re-run after a failure replaces partial output.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def save_results(results: dict[str, DataFrame], out_dir: str, fmt: str = "parquet") -> dict[str, str]:
    """One dataset per named result, partitioned by ``year`` if present."""
    paths = {}
    for name, df in results.items():
        path = f"{out_dir.rstrip('/')}/{name}"
        w = df.write.mode("overwrite").format(fmt)
        if "year" in df.columns and fmt == "parquet":
            w = w.partitionBy("year")
        w.save(path)
        paths[name] = path
    return paths


def export_csv(df: DataFrame, path: str) -> None:
    """UTF-8 CSV with a header row, multi-part."""
    flat = df.select(*[
        F.to_json(F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct")
        else F.col(f.name)
        for f in df.schema.fields
    ])
    flat.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


COLLECTION = "id", "text", "embedding", "metadata"
BUCKETS = 16


def write_vector_collection(docs: DataFrame, path: str, buckets: int = BUCKETS) -> bool:
    """Replaces a collection of ``(id, text, embedding, metadata)``, sorted
    into buckets by id, so that joins on the id shuffle the other side only.

    The documents are written as a version of their own that readers see once
    it is whole; without any document nothing changes (False)."""
    from periodix.plans.store import publish_version

    spark = docs.sparkSession
    slim = docs.select(*COLLECTION)
    version = uuid.uuid4().hex
    folder, name = f"{path.rstrip('/')}/versions/{version}", f"collection_{version}"
    slim.repartition(buckets, "id").write.bucketBy(buckets, "id").sortBy("id").option("path", folder).saveAsTable(name)
    if spark.table(name).isEmpty():
        spark.sql(f"DROP TABLE {name}")
        return False
    publish_version(spark, path.rstrip("/"), version)
    return True


def read_vector_collection(spark: SparkSession, path: str, buckets: int = BUCKETS) -> DataFrame:
    """The newest version of a collection, by its buckets in any session."""
    from periodix.plans.store import versions

    version = next(iter(versions(spark, path.rstrip("/"))), None)
    if version is None:
        raise ValueError(f"no collection in {path}")
    folder, name = f"{path.rstrip('/')}/versions/{version}", f"collection_{version}"
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spark.read.parquet(folder).schema)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (id) SORTED BY (id) "
                  f"INTO {buckets} BUCKETS LOCATION '{folder}'")
    return spark.table(name)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Text files of questions, one per line -> ``(qid, question)``.

    Files are read in splits.  The id hashes the file and the byte at which the
    line begins (a byte order mark not counted), so it is stable across runs and
    split sizes and a repeated question has an id of its own: bytes of a file's
    earlier splits come from one small aggregate, those of earlier lines of the
    split from a window over the split's lines, which are bounded by its size.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_at"), "value", (F.octet_length("value") + 1).cast("long").alias("_bytes"))
    earlier = (Window.unboundedPreceding, -1)
    splits = lines.groupBy("_file", "_split").agg(F.sum("_bytes").alias("_size")).select(
        "_file", "_split", F.sum("_size").over(
            Window.partitionBy("_file").orderBy("_split").rowsBetween(*earlier)).alias("_before"))
    inside = F.sum("_bytes").over(Window.partitionBy("_file", "_split").orderBy("_at").rowsBetween(*earlier))
    placed = lines.withColumn("_inside", inside).join(splits, ["_file", "_split"])
    start = F.coalesce("_before", F.lit(0)) + F.coalesce("_inside", F.lit(0))
    return placed.select(
        F.sha2(F.concat_ws("\u0000", "_file", start.cast("string")), 256).alias("qid"),
        F.regexp_replace("value", "\r$", "").alias("question"),
    ).filter(F.trim("question") != "")


def write_answers(answers: DataFrame, path: str) -> None:
    """Answers as JSON lines."""
    answers.write.mode("overwrite").json(path)
