"""Documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all documents that its predecessor kept and returns a DataFrame; all
but the last return the columns of documents. `run` writes each result as Parquet and reads it for the next.
"""

from pyspark.sql import DataFrame, SparkSession

from latentspark.llm import decontaminate, jaccard_join, langid
from latentspark.llm.common import drop, stored, table
from latentspark.llm.queries import pack_whole


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one with the smallest id."""
    return jaccard_join.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return pack_whole(docs)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing)]

#: Fitted classifiers, tokenizers and packing have no SQL form; tests hold the pipeline, and each stage's operator, against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
        drop(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
