"""From raw documents to packed training sequences: quality, near copies, repeated passages, mixture, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from passagemill.llm import jaccard, mixing, packing, quality, repeats
from passagemill.llm.common import read, stored
from passagemill.scale import spread


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.good_documents(spread(docs), read(spark, sf_dir, "labels", "doc_id", "quality"))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies: five-word shingles, a similarity of 0.8."""
    return jaccard.one_of_each(spread(docs))


def no_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document with a smaller id holds too."""
    return repeats.without_repeats(spread(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight asks."""
    return mixing.repeat_rows(spread(docs))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of up to 1,024 tokens, in the order in which they are stored."""
    return packing.packed(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_near_copies),
    ("suffix-array dedup", no_repeated_passages),
    ("mixing sources to target weights", mixture),
    ("packing", sequences),
]

# Tokenising, sets of shingles with components, and the discriminant's fit are beyond SQL. Tests compare
# operators on their own with plain code (quality only with labels and fixtures); none runs all stages against it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder, each stage's rows stored before the next reads them."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
