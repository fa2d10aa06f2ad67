"""Training-data pipeline over ``documents``: quality rules, near duplicates, leaks, secrets, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; ``run`` writes each stage's result as
Parquet into the session's shared checkpoint folder and reads it again for the next one. All stages but the last return
the columns of their input, extra ones and those of clashing names included.

A document without words (null, empty or white text) fails the quality rules. A null id passes through; of near duplicates the
row of the least id stays (null first), then of the least text hash, then the first by its columns as JSON. Repeated rows count
as near duplicates. Very long texts are read whole. An empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from maskwright.llm import decontaminate, jaccard_join, packing, quality_rules, secret_scan
from maskwright.llm.support import materialize, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. The trees are trained on the stored documents and labels."""
    trees = quality_rules.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_rules.keep_good(docs, trees)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, Jaccard similarity of 0.8 or more."""
    return jaccard_join.keep_one(docs, 5, 80, 100)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item leaks."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked in place; lengths do not change."""
    return secret_scan.mask_secrets(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secret_scan", secret_stage),
    ("packing", packing_stage),
]

#: The trained trees and the tokenizer cannot be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
