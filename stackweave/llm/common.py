"""Shared helpers: column names that don't clash, ASCII lowering, batch iteration; scratch tables come from the library."""

from __future__ import annotations

import string
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import discard, materialize, scratch_path

__all__ = ["ascii_lower", "discard", "fresh", "materialize", "others", "scratch_path", "slices", "table"]


def others(df: DataFrame, *names: str) -> list[str]:
    """The columns of ``df`` that don't have one of the names; like Spark's, names differ by more than their case."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. All-ASCII texts take the byte path of ``lower``; others are translated."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch, rows: int) -> Iterator:
    """Cuts an Arrow batch so that what Python holds at once stays bounded."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)
