"""A corpus pipeline of the corpus operators: quality, exact and near duplicates, contamination, packing.

Every stage takes (spark, docs, sf_dir) and returns what it keeps with the columns of documents; the last returns packed
pieces. Each stage's result is written and read again before the next.

Defined results: a null text is an empty one, scores 0.5 and is rejected by the first stage unless a lower threshold is
set there; of repeated rows one stays; a row without doc_id passes the near-duplicate stage as it is; columns beyond those of
documents are carried up to the packing stage, which drops them; empty tables give no rows, without labels nothing reaches
the threshold, and without benchmark items nothing is contaminated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stackweave.llm import decontamination, exact_dedup, near_dedup, packing, quality
from stackweave.llm.common import materialize, table
from stackweave.llm.queries import tokenizer_files


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that it rejects go."""
    scored = quality.score_quality(docs, table(spark, sf_dir, "labels"), keep_text=True)
    return scored.filter("predicted = 1").select(*docs.columns)


def keep_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: of equal texts the largest doc_id stays."""
    return exact_dedup.exact_dedup(docs).select(*docs.columns)


def keep_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: of each group of near-duplicates the smallest doc_id stays."""
    return near_dedup.near_dedup(docs).select(*docs.columns)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that hold a benchmark window go."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: what is left, in sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer_files())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("exact_dedup", keep_exact),
    ("near_dedup", keep_near),
    ("decontamination", keep_uncontaminated),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
