"""Training-data pipeline over `documents`: language ID, near-duplicates, decontamination, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Null and repeated doc_ids and repeated rows are allowed everywhere: each row is a document of its own. Extra columns of
any name are kept. An empty table stays empty. Very long texts go through every stage whole. Of linked rows with no least
doc_id the first in the order of (doc_id, text, the other columns) stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import decontamination, jaccard_join, language_id, sentence_pieces
from touchline.llm.common import few_rows, kept, named, passing, read, release, unused


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is found; those without letters (`und`) go."""
    return language_id.keep(docs, language_id.training_texts(docs))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of linked rows the one with the least doc_id.

    Rows without a doc_id, or with one that other rows have too, come after all others, in the order of (doc_id, text).
    """
    key = unused(docs, "row_id")
    all_ = named(docs, key)
    with passing(spark) as stays:
        found = jaccard_join.join(all_.select(F.col(key).alias("doc_id"), "text"))
        copies = stays(kept(found.where("doc_id <> component_id").select(F.col("doc_id").alias(key)), "copies"))
    release(spark)
    return all_.join(few_rows(copies), key, "left_anti").select(docs.columns)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go."""
    key = unused(docs, "row_id")
    all_ = named(docs, key)
    leaked = decontamination.leaks(all_.select(F.col(key).alias("doc_id"), "text"), read(spark, sf_dir, "benchmark"))
    return all_.join(few_rows(kept(leaked.select(F.col("doc_id").alias(key)).distinct(), "leaks")), key, "left_anti").select(docs.columns)


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds piece_ids, n_pieces, ids_crc32 and decodes (whether decoding gives the text back)."""
    return sentence_pieces.encode(docs, verify=True)


STAGES = [("language_id", by_language), ("jaccard_join", without_copies), ("decontamination", without_leaks), ("sentence_pieces", as_pieces)]

#: Suffix automata, components and pieces are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
