"""A training corpus from `documents`: toxic ones go, then copies, then near copies; the rest is mixed and packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewire.llm import exact_dedup, mixing, near_texts, packing, toxicity
from tidewire.llm._store import Table, scratch


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model, fitted on a bounded sample of `labels`, does not reject (op2). Null and empty
    texts stay, repeated rows share a verdict, an empty table gives an empty one; so with the stages below."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.fit(*toxicity.sampled_features(docs, labels)))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the smallest doc_id, null last (op1). Null text equals empty text."""
    return exact_dedup.drop_exact_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, the smallest doc_id, null last (op10): five-word shingles,
    similarity 0.8 or more. Texts without words are one component."""
    return near_texts.drop_near_copies(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them (op7); one that it takes twice comes twice, those without words go."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the training sequences (op5); null text is one piece of one id."""
    return packing.best_fit(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_stage),
    ("simhash_dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: A trained model and a tokenizer are beyond SQL: tests/llm/test_pipeline.py holds run() against plain versions of all
#: stages, the other tests each stage by itself.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents. A stage's own tables go once its result is written, and that once
    the next stage's is."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch() as made:
            after = Table(spark, stage(spark, docs, sf_dir), name)
            made.remove(after)
        if before is not None:
            before.drop()
        docs, before = after.df, after
    return STAGES[-1][1](spark, docs, sf_dir)
