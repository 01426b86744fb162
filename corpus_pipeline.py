"""Cleaning pipeline over ``documents``: each stage works on all that the one before kept.

Toxic documents go, boilerplate lines go from the texts, one document of each group of near copies
(five-word shingles that agree to 0.8) stays, documents that hold benchmark passages go, and the rest is sampled to the target mixture
(``copies`` says how often to take a document).
Defined cases (nulls, repeated rows, empty tables) are those of the operators' modules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoterra.llm import decontamination, line_dedup, mixing, simhash, toxicity
from chronoterra.llm.common import discard, quoted, scratch, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity_scores(docs, docs, table(spark, sf_dir, "labels"))
    return scored.filter("score < 0.5").select(*map(quoted, docs.columns))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_boilerplate(docs)
    if "n_chars" in docs.columns:  # follows the text
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*map(quoted, docs.columns))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixing_probabilities(docs).filter("sampled").select(*map(quoted, docs.columns), "topic", "n_tokens", "probability", "copies")


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: The learned first stage has no SQL form; tests/llm holds the stages after it against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, scratch(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
