"""The corpus pipeline: documents of a known language, one of each group of
near-copies, none with a test item, mixed to the sources' target weights and
dealt into shards.

Every stage takes (spark, docs, sf_dir) and works on all rows it is given; its
result is written to the shared checkpoint folder and read again as the next
stage's documents. All stages but the last return the columns of documents;
the last adds shard, slot and grown_shard.

Defined results: nulls, empty texts, repeated rows, empty tables and further
columns are handled as the operators' own docstrings say; a document without
letters has no language and goes in the first stage, as one between two
languages does; with no labelled rows all documents pass it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyline.llm import decontaminate, language, mixing, sharding, simhash
from tallyline.llm.common import table, written

SHARDS = 16


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.identified_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.unique_documents(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.assign(docs, "doc_id", SHARDS)


STAGES = [
    ("language", known_language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminated),
    ("mix", mixed),
    ("shard", sharded),
]

# Language identification and SimHash have no SQL; tests compare run() with a
# brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
