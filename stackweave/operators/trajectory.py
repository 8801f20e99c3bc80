"""Ordered operators on trajectories: cumulative shifts, velocities, centroids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def cumulative(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """The negated running sum of relative shifts, as a translation."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("translation", -F.sum(value).over(w))


def velocity(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Mean of the two adjacent steps; one-sided at the ends."""
    w = Window.partitionBy(key).orderBy(*order)
    back = F.abs(F.col(value) - F.lag(value).over(w))
    ahead = F.abs(F.lead(value).over(w) - F.col(value))
    return df.withColumn("velocity", F.coalesce((back + ahead) / 2, back, ahead, F.lit(0.0)))


def centred(df: DataFrame, key: str, value: str) -> DataFrame:
    """Values less their group's mean. The means are aggregated first and join back, so a large group is no one task's."""
    means = df.groupBy(key).agg(F.avg(value).alias("__mean"))
    return df.join(means, key).withColumn("centred", F.col(value) - F.col("__mean")).drop("__mean")
