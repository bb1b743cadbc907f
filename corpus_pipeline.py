"""From documents to packed sequences: toxicity, line dedup, near-duplicates, repeated passages, packing.

Each stage works on all that the one before kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readrouter.llm.common import drop_ids, stage, table
from readrouter.llm.lines import drop_boilerplate
from readrouter.llm.near_dedup import near_duplicates
from readrouter.llm.packing import best_fit
from readrouter.llm.suffix_dedup import remove_repeats
from readrouter.llm.toxicity import reject_toxic


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """n_chars after a change of the text."""
    return docs.select(*(F.length("text").cast("bigint").alias(c) if c == "n_chars" else F.col(c) for c in columns))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return reject_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of each source go."""
    return _counted(drop_boilerplate(docs), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the smallest id stays."""
    dropped = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return drop_ids(docs, stage(dropped, "dropped"), "doc_id").select(*docs.columns)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of passages that repeat go, in every place where they stand."""
    return _counted(remove_repeats(docs), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces in sequences."""
    return best_fit(docs)


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("near dedup", near_dedup), ("suffix dedup", suffix_dedup), ("packing", packing)]
#: No stage but line dedup can be said in SQL; tests hold the others against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
