"""The corpus pipeline: toxicity, exact and near duplicates, mixing, pieces.

Each stage takes ``(spark, docs, sf_dir)``, works on all that its predecessor kept and returns the columns of
``documents``; the last returns each document's pieces. Null and empty texts, ties, repeated rows, empty
tables and further columns are treated as the operators' own texts say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixplan.llm import exact_dedup, mixing, near_copies, pieces, toxicity
from helixplan.llm.common import table
from helixplan.plans.runtime import Scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (five-word shingles, similarity 0.8 or more) stays, the one with the smallest id."""
    return near_copies.drop_near_copies(docs, words=5, least=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_documents(docs, mixing.cycle_weights())


def cut_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document; the copies that the mix takes are cut each by itself."""
    return pieces.encode_documents(docs, copies=True)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_exact_copies), ("simhash_dedup", drop_near_copies), ("mixing", mix_sources), ("pieces", cut_pieces)]

#: SQL has no counterpart of the first and the last stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result is a table in the shared folder that the next one reads."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.keep(docs)
    return docs
