"""Parquet table reader for the driver's test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


# Footer schema per path: later reads pass it explicitly, which skips the
# schema-inference job Spark would otherwise run on every read.
_SCHEMAS: dict = {}


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Read ``{sf_dir}/{name}.parquet``; selecting columns here keeps the
    scan's ReadSchema pruned even before Catalyst sees the rest of the plan."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    schema = _SCHEMAS.get(path)
    if schema is None:
        schema = _SCHEMAS[path] = spark.read.parquet(path).schema
    df = spark.read.schema(schema).parquet(path)
    return df.select(*columns) if columns else df
