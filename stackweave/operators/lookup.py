"""Lookup joins of tables by a first key or a fallback key, anti-joins, first places by state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup(left: DataFrame, right: DataFrame, key: str, first, fallback) -> DataFrame:
    """Joins by the key that ``first`` makes of a row, or, where the table has no such key, by ``fallback``; rows that neither
    finds are dropped. Repeated rows stay repeated; no row is grouped."""
    values = [c for c in right.columns if c != key]

    def keyed(tag: str) -> DataFrame:
        return right.select(F.col(key).alias(f"__{tag}_key"), *(F.col(c).alias(f"__{tag}_{c}") for c in values))

    once = left.withColumn("__first", first).withColumn("__second", fallback)
    once = once.join(keyed("a"), F.col("__first") == F.col("__a_key"), "left")
    second = F.when(F.col("__a_key").isNull(), F.col("__second"))
    both = once.join(keyed("b"), second == F.col("__b_key"), "left").filter("__a_key is not null or __b_key is not null")
    found = F.col("__a_key").isNotNull()
    return both.select(*left.columns, *(F.when(found, F.col(f"__a_{c}")).otherwise(F.col(f"__b_{c}")).alias(n) for c, n in (("key", key), *zip(values, values))))


def basename(path) -> Column:
    """The last part of a path without its last extension."""
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def by_basename(left: DataFrame, right: DataFrame, left_path: str, right_path: str) -> DataFrame:
    """Pairs of rows whose paths have the same basename; rows without a partner are dropped."""
    return left.withColumn("basename", basename(left_path)).join(right.withColumn("basename", basename(right_path)), "basename")


def unknown(left: DataFrame, known: DataFrame, key: str, known_key: str) -> DataFrame:
    """Rows whose key is not known yet."""
    return left.join(known.select(F.col(known_key).alias(key)).distinct(), key, "left_anti")


def first_of_state(jobs: DataFrame, state: str, priority: str, tie: str) -> DataFrame:
    """The row of the highest priority of each state; the smallest tie column of equal ones."""
    best = F.max(F.struct(F.col(priority), (-F.col(tie)).alias("neg"))).alias("b")
    return jobs.groupBy(state).agg(best).select(state, (-F.col("b.neg")).alias(tie), F.col(f"b.{priority}").alias(priority))
