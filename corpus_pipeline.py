"""A corpus pipeline of five stages; part of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.

1. toxicity: a classifier chain is fitted on the labelled documents; documents at or above the threshold go.
2. exact_dedup: of equal texts the smallest id stays.
3. near_dedup: of each component of the n-gram Jaccard join the smallest id stays.
4. mixing: each source is brought to its target weight; a document stays as often as the mix takes it.
5. packing: the documents become pieces of token sequences.

Defined cases: null and empty texts are one text, of which the smallest id stays until mixing, which takes no words of it and so
leaves it out; without labels nothing is rejected; null, clashing and repeated ids are separate rows, told apart by
their texts, and of rows equal in id and text one stays; very long texts are read whole; columns of the input may
have any name and are kept by all stages but the last; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docgauge.llm.common import discard, read, scratch
from docgauge.llm.exact_dedup import keep_first
from docgauge.llm.mixing import take_mix
from docgauge.llm.near_join import one_of_each
from docgauge.llm.packing import pack
from docgauge.llm.toxicity import fit, without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, fit(docs, read(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_first(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return take_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: The fitted chain and the tokenizer are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents. A stage's output stays in the shared folder until the next one's is written."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
