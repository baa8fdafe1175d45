"""A training-data pipeline over `documents`: toxic documents go, then repeated passages, then
near-duplicates, and what is left is packed into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` chains them. A runner that
wants to recover between stages writes each result as Parquet and reads it back as the next docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import line_dedup, near_copies, packing, toxicity
from corpusloom.llm.queries import tokenizer_file
from corpusloom.runtime import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the machine learns from the labelled ones among `docs`.

    Null and empty texts score as texts without terms; null ids and repeated rows are judged like any
    other; without labels of both kinds nothing goes; an empty table gives no rows; all columns stay.
    """
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 50 words or more that an earlier one has.

    Places are ordered by doc_id (null last), then position; a null text stays null, one that loses all its
    words becomes empty; rows alike in id and text are treated alike; an empty table gives no rows.
    """
    return line_dedup.drop_repeated_lines(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts with a 5-word Jaccard similarity of 0.8 or more, the one with the smallest doc_id.

    Texts without words (null ones too) are one group; of rows alike in id and text one stays; an id with
    several texts is judged by each; rows without an id are in no group and stay; an empty table gives no rows.
    """
    return near_copies.drop_near_copies(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in their sequences.

    Null and empty texts are one end token; null ids stay null; repeated rows are packed once each; an empty
    table gives no rows.
    """
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("simhash_near_dedup", dedup_near), ("packing", pack)]

#: Hashing, learning and tokenizing can't be written in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
