"""A training corpus from raw documents, in five stages.

Every stage takes rows with null ids, null, empty and very long texts, repeated rows, an empty table, and columns of
any other names, which pass through all stages but the last; what becomes of such rows is stated by the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headloom.llm import exact_dedup, mixing, near_dedup, packing, quality
from headloom.llm.common import read_table, staged, tuned


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    tuned(spark)
    return quality.drop_low_quality(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    tuned(spark)
    return exact_dedup.drop_exact_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity 0.8 or more."""
    tuned(spark)
    return near_dedup.drop_near_duplicates(docs, shingle=5)


def _schedule(docs: DataFrame) -> DataFrame:
    return mixing.mix(docs).groupBy("doc_id").agg(F.min("position").alias("position"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the schedule that mixes the sources."""
    tuned(spark)
    order = _schedule(docs).select(F.col("doc_id").alias("at"), "position").alias("_schedule")
    put = docs.alias("_docs").join(order, F.col("_docs.doc_id").eqNullSafe(F.col("_schedule.at")), "left")
    return put.sort("_schedule.position").select("_docs.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of at most 4096 tokens, with their ids, in the order of the schedule. A table read
    again has lost its order, but the schedule depends on ids and sources alone and is the same here."""
    tuned(spark)
    order = staged(_schedule(docs), "order")
    return packing.pack(docs, known=150_000, order=order)  # workers serve the other stages too


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The classifier is fitted by iteration, which SQL can't express; tests hold the dedup stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
