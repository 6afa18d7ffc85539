"""A training-data pipeline of five stages. Each takes (spark, docs, sf_dir); what it returns is written and read as the next one's docs.

All stages take rows with nulls in any column, equal rows (each is a row of its own), an empty table (which gives an empty one) and further
columns of any name. A very long text is one row of a task, whose work is in proportion to its length; none is cut.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import mixing, neardup, packing, quality, secretscan
from orrery.llm.common import n_words, shared_dir
from orrery.llm.queries import WEIGHTS, domain


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the perplexity bounds reject go; so do those without text. A document on a bound stays."""
    return quality.keep_good(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the least doc_id; documents without words are in no group and stay."""
    return neardup.keep_one(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans that look like secrets become a mark; no document goes, and a null text stays null."""
    return secretscan.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's budget takes them (at most 4 times); null languages and sources are leaves of their own."""
    return mixing.apply_mix(docs, domain(), WEIGHTS, 100, 4, 7)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 512 to 4096 words; a document without words has none."""
    return packing.pack(docs, n_words(F.col("text")), F.xxhash64("text"))


STAGES = [("quality rules", good), ("near-duplicates", one_of_each_group), ("secret scan", without_secrets), ("mixing", mixed), ("packing", packed)]

#: The stages train a model and pack greedily, which SQL can't express; tests/llm/test_operators.py holds each against its operator, and those against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{shared_dir(spark)}/orrery/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        df = stage(spark, docs, sf_dir)
        df.write.parquet(f"{root}/{k}")
        docs = spark.read.schema(df.schema).parquet(f"{root}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
