"""The training-data pipeline: five operators of ``periodix.llm`` in a row.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run``
writes it as Parquet below the shared checkpoint folder and reads it back as
the next stage's documents, so a stage is computed once and a lost executor
costs no more than the stage at hand.  All stages but the last return the
columns of ``documents``:

1. language ID drops documents in no learned language;
2. quality rules drop documents that fail the base rules or are depleted by
   the line rule;
3. the n-gram Jaccard join keeps one document -- the one with the smallest id
   -- of each component (documents without words are components of their own);
4. benchmark decontamination drops documents that overlap a test item;
5. packing cuts what is left into sequences (one row per piece).

A null id is a document of its own: it is kept unless a stage's rule drops its
text or, in stage 3, its component has a named member.  Repeated rows are
equal sets, so one of them stays.  An empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from periodix.llm import decontaminate, jaccard, langid, packing, quality
from periodix.llm.common import shared_folder, table

DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = langid.identify(docs, langid.sample(docs))
    return found.where(langid.accepted(F.col("language"))).select(*DOCUMENTS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.line_verdicts(docs).where("quality.kept").select(*DOCUMENTS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs).select(*DOCUMENTS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark", "item_id", "text")).select(*DOCUMENTS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", language),
    ("quality", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", pack),
]

# language ID and packing use a tokenizer and trained automata
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", *DOCUMENTS)
    for name, stage in STAGES:
        folder = shared_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
