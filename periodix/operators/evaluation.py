"""R16 + J5 + S9: evaluation records -- read, join, score, summarise.

Scoring rules by question type (all column expressions):

* ``numerical``  -- any number in the answer within ``tol`` of the expected
  number (decimal comma accepted), so "6.89" passes for 6.8877...;
* ``text``       -- the expected text occurs in the answer (case-insensitive);
* ``analytical`` -- the answer is non-empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from periodix.functions.columns import py_strip

EVAL_SCHEMA = (
    "total_tests BIGINT, timestamp STRING, "
    "tests ARRAY<STRUCT<question: STRING, answer: STRING, expected: STRING, type: STRING>>"
)
NUMBER_PATTERN = r"-?\d+(?:[.,]\d+)?"


DOCUMENT_TESTS = 1000  # records of one written document at most


def parse_evaluation(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Evaluation files -> ``(records, faulty)``.

    A file with at least one line that is a whole document is read line by line,
    in splits; any other file is one document over several lines.  ``faulty``
    has ``(file, text)`` of every line or file that is no document with tests.
    """
    schema, options = EVAL_SCHEMA + ", _corrupt STRING", {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}

    def parsed(whole: bool) -> DataFrame:
        text = spark.read.text(path, wholetext=whole).select(F.col("_metadata.file_path").alias("file"), "value")
        out = text.withColumn("doc", F.from_json("value", schema, options))
        good = F.col("doc.tests").isNotNull() & F.col("doc._corrupt").isNull()
        return out.withColumn("good", F.coalesce(good, F.lit(False)))

    lines = parsed(False).filter(F.trim("value") != "")
    by_line = lines.filter("good").select("file").distinct()
    docs = lines.join(by_line, "file").unionByName(parsed(True).join(by_line, "file", "left_anti"))
    records = docs.filter("good").select("doc.timestamp", F.explode("doc.tests").alias("t")).select("timestamp", "t.*")
    return records, docs.filter(~F.col("good")).select("file", F.col("value").alias("text"))


def read_evaluation(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation JSON file(s) -> one row per test record; what is no
    document is left out (``parse_evaluation`` has it)."""
    return parse_evaluation(spark, path)[0]


def write_evaluation(records: DataFrame, path: str) -> None:
    """JSON lines, one document per run (timestamp) and up to
    ``DOCUMENT_TESTS`` records: a longer run fills several documents, each made
    of neighbouring records of one task, so no run is gathered in one place."""
    part = F.floor(F.monotonically_increasing_id() / DOCUMENT_TESTS)
    runs = records.withColumn("_part", part).groupBy("timestamp", "_part").agg(
        F.count(F.lit(1)).alias("total_tests"),
        F.collect_list(F.struct("question", "answer", "expected", "type")).alias("tests"),
    )
    runs.select("total_tests", "timestamp", "tests").write.mode("overwrite").json(path)


def attach_expected(answers: DataFrame, expected: DataFrame, on: str = "qid") -> DataFrame:
    """Answers joined to expected values on the question's id (left
    join); ``expected`` has one row per id, so repeated question texts do not
    multiply answers."""
    return answers.join(expected, on, "left")


def score(records: DataFrame, tol: float = 0.01) -> DataFrame:
    """Add ``passed`` (BOOLEAN) to ``(question, answer, expected, type)``."""
    answer = F.coalesce(F.col("answer"), F.lit(""))
    expected_num = F.regexp_replace(F.col("expected"), ",", ".").try_cast("double")
    nums = F.transform(F.regexp_extract_all(answer, F.lit(NUMBER_PATTERN), 0),
                       lambda s: F.regexp_replace(s, ",", ".").try_cast("double"))
    numerical = F.exists(nums, lambda x: F.abs(x - expected_num) <= F.lit(tol))
    text = F.lower(answer).contains(F.lower(F.col("expected")))
    analytical = F.length(py_strip(answer)) > 0
    t = F.col("type")
    passed = (
        F.when(t == "numerical", numerical)
        .when(t == "text", text)
        .when(t == "analytical", analytical)
    )
    return records.withColumn("passed", F.coalesce(passed, F.lit(False)))


def accuracy(scored: DataFrame) -> DataFrame:
    """Per-type and overall accuracy (``type = 'all'`` row) in one scan."""
    out = scored.rollup("type").agg(
        F.count(F.lit(1)).alias("n_tests"),
        F.count_if("passed").alias("n_passed"),
        F.grouping("type").alias("_all"),
    )
    return out.select(
        F.when(F.col("_all") == 1, F.lit("all")).otherwise(F.col("type")).alias("type"),
        "n_tests", "n_passed",
        (F.col("n_passed") / F.col("n_tests")).alias("accuracy"),
    )
