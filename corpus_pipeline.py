"""A corpus from documents to packed sequences: each stage works on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orrery.llm import neardup, packing, secrets, substrings, toxicity
from orrery.llm.common import cut, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the clause grammar, learned from the labels, scores at 0.5 or more go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), spark)
    return toxicity.without_toxic(docs, spark, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies, at a similarity of 0.8 or more, the document of the least doc_id stays."""
    return neardup.without_copies(docs, spark, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat one of a smaller doc_id are cut out of the texts."""
    return substrings.without_repeats(docs, spark)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by their kind."""
    return secrets.redact(docs, spark)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of at most 2048."""
    return packing.pack(docs, spark)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: SQL can't express learned grammars, signatures or packing; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), spark, f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
