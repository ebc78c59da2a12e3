"""A corpus pipeline: five stages, each of which takes whole documents and returns whole documents.

A row is named by its doc_id and its text, so nulls and repeated ids are judged like all others: each stage decides on rows,
and near-duplicates leave one row of each component, also of rows that are equal.  Null and empty texts fail the quality rules;
very long texts are read whole; an empty table stays empty.  Columns of any name pass through; one called shard_no or shard_slot
is replaced by the last stage's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.decontaminate import find_contamination
from tessera.llm.mixing import mix
from tessera.llm.quality_rules import quality_rules
from tessera.llm.sharding import shard
from tessera.llm.shared import aside, back, cut, table
from tessera.llm.simhash import one_of_each


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return back(quality_rules(aside(docs, "doc_id", "text", "lang"), table(spark, sf_dir, "labels")).where("kept"), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates one row: that with the smallest id."""
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any word in a benchmark window."""
    found = find_contamination(aside(docs, "doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return back(found.where("size(hit_spans) = 0"), docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them."""
    return back(mix(aside(docs, "doc_id", "source", "text")), docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the shard and the slot of each."""
    docs = docs.drop("shard_no", "shard_slot")
    return back(shard(aside(docs, "doc_id", "text")), docs, "shard_no", "shard_slot")


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: Hashes order the documents; SQL has no equal of them.  tests/llm tests each stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
