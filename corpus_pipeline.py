"""Corpus pipeline: reject poor documents, remove copies and near copies, pack what is left into training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the next one's docs.
All but the last return the columns of their input; the last returns a row per piece of a packed sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import exact_dedup, jaccard, packing, quality
from lodestone.llm.common import materialize
from lodestone.llm.queries import word_bpe
from lodestone.sources import read_table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; it learns from the labels outside the held-out fold.

    Each row is decided by its own text: null and empty texts are scored as such, repeated rows stay or go together, null ids take no label. With
    no labels all stay. An empty table stays empty; other columns, of any name, are carried along.
    """
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text (up to white space), the one with the smallest id, null ids last.

    A null text is an empty one, so one of all of these stays. Of rows repeated under the id, the least by their other columns stays. An empty table
    stays empty; other columns, of any name, are carried along.
    """
    return exact_dedup.keep_first(docs)


def dissimilar_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of five-word shingles tie together, the one with the smallest id, null ids last.

    Null, empty and blank texts have no shingles: all stay. Of repeated rows one stays; a different text under the same id is decided by itself. An
    empty table stays empty; other columns, of any name, are carried along.
    """
    return jaccard.keep_one(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of 4096 tokens.

    A null or empty text is its end token alone; repeated rows are packed row by row; null ids stay null; long texts are cut, none is dropped. An
    empty table gives no pieces; other columns aren't read.
    """
    return packing.pack_documents(docs, word_bpe())


STAGES = [
    ("quality classifier", good_documents),
    ("exact dedup", distinct_documents),
    ("n-gram Jaccard join", dissimilar_documents),
    ("packing", packed_sequences),
]

#: SQL can express neither the classifier nor the packing; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a directory."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
    return docs
