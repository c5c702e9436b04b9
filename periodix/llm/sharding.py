"""Operator 6: contiguous byte-balanced shards from global prefix sums.

Documents are put in ascending id order by a range shuffle of slim rows
(id, size, checksum -- never the text), each partition's byte total and row
count is one aggregate row, and a running sum over those rows (one per
partition) gives every partition its global offset.  Offset plus the running
sum inside the partition is the document's place on the global byte line,
which is cut at ``n_shards`` equal targets: a document belongs to the shard
that holds its midpoint, so shards are contiguous in id order and a shard's
size differs from the target by at most one document.

Defined results: a null text has no bytes; an empty table gives no rows; a
null id sorts first; repeated rows are separate documents, told apart by
their place in the input.  Extra input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from periodix.llm.common import cut_lineage, shuffle_partitions, table

ROW_BYTES = 16  # fixed bytes a document takes besides its text


def shard_by_bytes(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, size, text_crc32, shard, slot``."""
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    spark = docs.sparkSession
    text = F.coalesce(docs["text"], F.lit(""))
    slim = docs.select(
        docs["doc_id"], (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.monotonically_increasing_id().alias("_row"))
    order = ["doc_id", "_row"]
    # the range shuffle samples its input: cut the lineage so that totals and
    # rows below see one and the same partitioning, even after a lost executor
    ranged = cut_lineage(slim.repartitionByRange(shuffle_partitions(spark), *order)
                         .withColumn("_part", F.spark_partition_id()))

    totals = ranged.groupBy("_part").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_part", F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes_before"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        F.sum("_bytes").over(Window.partitionBy()).alias("_total"))

    local = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # offsets: one row per shuffle partition, so the broadcast is bounded
    placed = (ranged.withColumns({"_end": F.sum("size").over(local), "_no": F.count("*").over(local)})
              .join(F.broadcast(offsets), "_part")
              .withColumn("_row_no", F.col("_rows_before") + F.col("_no") - 1))
    # integer division: doubles are not exact on a line of 100 TB
    placed = placed.withColumn("shard", F.expr(
        f"cast(least({n_shards - 1}, ((2 * (_bytes_before + _end) - size) * {n_shards}) div (2 * _total)) as int)"))
    firsts = placed.groupBy("shard").agg(F.min("_row_no").alias("_first"))  # n_shards rows
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("_row_no") - F.col("_first")).alias("slot"))


def op6_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return shard_by_bytes(docs, 40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


SQL = """
WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, k: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
                   lambda x: ('0x' || x)::BIGINT) AS bytes FROM documents),
c AS (SELECT doc_id, size::BIGINT AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes),
    lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])), 4294967295::BIGINT) AS text_crc32 FROM d, tab),
p AS (SELECT *, sum(size) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS upto,
    sum(size) OVER () AS total FROM c),
s AS (SELECT *, least(39, ((2 * upto - size) * 40) // (2 * total)) AS sh FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, sh::INT AS shard,
    row_number() OVER (PARTITION BY sh ORDER BY doc_id) - 1 AS slot, NULL::INT AS grown_shard FROM s
"""
