"""From raw documents to packed training sequences: five stages, each over all the one before it kept.

STAGES lists (name, function); a function takes (spark, docs, folder of the tables) and returns a DataFrame that is
written as Parquet and read again as the next one's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlmill.llm import line_crf, mixing, near_dedup, packing, queries, substring
from crawlmill.llm.common import prepare, stored, table


def _sized(docs: DataFrame) -> DataFrame:
    """``n_chars``, where there is one, follows the text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the line classifier calls good; it learns from the labels that are not held out."""
    prepare(spark)
    return line_crf.good_rows(docs, line_crf.train(docs, table(spark, folder, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of exact and near copies, that of the smallest id."""
    prepare(spark)
    return near_dedup.first_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Texts without the passages that a document of smaller id has."""
    prepare(spark)
    return _sized(substring.rewritten(docs))


def mixture(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Sources in their target weights: a row for each time a document is taken."""
    prepare(spark)
    return _sized(mixing.mixed_rows(docs))


def packed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token pieces with their places in sequences of 4096 tokens."""
    prepare(spark)
    return packing.pack(docs, queries.tokenizer(), max_tokens=4096, end_id=1)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixture", mixture),
    ("packing", packed),
]

# hashes, trained weights and a tokenizer decide the rows: no SQL form; tests/llm compares with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
