"""The corpus pipeline: documents in, packed training sequences out.

Each stage calls one operator on all that the stage before kept; the result is written to the shared folder and read
again as the next stage's documents. Stages that filter leave the columns of documents as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dealspark.llm import decontaminate, neardup, packing, phrases, toxicity
from dealspark.llm.common import materialise, read_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted to be toxic go; null and empty texts stay."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, that of the smallest doc_id."""
    return neardup.keep_one(docs)


def passages_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that recur are taken out of the texts; documents of which nothing is left go."""
    return phrases.drop_passages(docs)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a test item go."""
    return decontaminate.drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.op8(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxic_out),
    ("near_duplicates", near_duplicates_out),
    ("passages", passages_out),
    ("decontamination", benchmark_out),
    ("packing", packed),
]

#: The stages are beyond SQL (a trained network, samples, automata, a least-squares plan); tests hold them against
#: brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
