"""The training-data pipeline over the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidecast.llm import decontaminate, minhash, packing, quality, toxicity
from tidecast.llm.common import table
from tidecast.llm.queries import tokenizer_path
from tidecast.session import discard, settle


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go."""
    return toxicity.remove_toxic(docs, table(spark, sf_dir, "labels"))


def good_only(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is above the limit of their language go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays: similarity of 0.8 or more over 5-word shingles.

    The links come from op1's fingerprints and masks first, from MinHash bands where those do not reach.
    """
    return minhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item go."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed training sequences, with their step groups."""
    return packing.step_groups(packing.pack(docs, tokenizer_path()))


STAGES = [
    ("toxicity", without_toxic),
    ("quality", good_only),
    ("near_dedup", one_of_each),
    ("decontamination", without_benchmark),
    ("packing", packed),
]
#: Hashes, fits and alignments cannot be written in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each on the written result of the one before."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        kept = settle(stage(spark, docs, sf_dir))
        discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
