"""Histograms, cumulative distributions and limits as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def histogram(df: DataFrame, value: str, bins: int, by: list[str] | None = None) -> DataFrame:
    """Counts in so many equal bins between smallest and largest value, the top edge inclusive; empty bins are rows.

    The bounds are one row for each group and join back by broadcast only if the optimizer finds them small."""
    by = by or []
    bounds = df.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    joined = df.select(*by, value).join(bounds, by) if by else df.select(value).crossJoin(F.broadcast(bounds))  # one row
    width = (F.col("hi") - F.col("lo")) / bins
    bin_of = F.when(F.col(value) == F.col("hi"), bins - 1).otherwise(F.floor((F.col(value) - F.col("lo")) / F.nullif(width, F.lit(0.0)))).cast("int")
    counts = joined.groupBy(*by, F.least(bin_of, F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = bounds.select(*by, "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = every.join(counts, [*by, "bin"], "left")
    edge = F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins
    return out.select(*by, "bin", edge.alias("left_edge"), F.coalesce("n", F.lit(0)).alias("n"))


def step_histogram(df: DataFrame, value: str, step: float, by: list[str]) -> DataFrame:
    """Counts between the edges lo, lo + step, ... below the largest value; the last edge is inclusive, what lies beyond it
    isn't counted, and empty bins are rows."""
    bounds = df.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    bounds = bounds.withColumn("bins", (F.ceil((F.col("hi") - F.col("lo")) / step) - 1).cast("int")).filter("bins > 0")
    at = (F.col(value) - F.col("lo")) / step
    bin_of = F.when(F.col(value) == F.col("lo") + F.col("bins") * step, F.col("bins") - 1).otherwise(F.floor(at)).cast("int")
    counts = df.select(*by, value).join(bounds, by).groupBy(*by, bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = bounds.select(*by, "lo", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    return every.join(counts, [*by, "bin"], "left").select(*by, "bin", (F.col("lo") + F.col("bin") * step + step / 2).alias("centre"), F.coalesce("n", F.lit(0)).alias("n"))


def mean_curves(curves: DataFrame, x: str, y: str) -> DataFrame:
    """The mean of many curves at each place, and how many have it."""
    return curves.groupBy(x).agg(F.avg(y).alias("mean"), F.count(y).alias("n"))


def cdf(hist: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Running share of a histogram's counts; a window over its bins, not over rows."""
    by = by or []
    running = F.sum("n").over(Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(Window.partitionBy(*by))
    return hist.select("*", (running / total).alias("cdf"))


def limits(hist: DataFrame, low: float, high: float, by: list[str] | None = None) -> DataFrame:
    """The left edges of the first bins whose running share passes low and high."""
    by = by or []
    c = cdf(hist, by)
    first = lambda p, name: F.min(F.when(F.col("cdf") > p, F.col("left_edge"))).alias(name)
    return c.groupBy(*by).agg(first(low, "lo_limit"), first(high, "hi_limit"))


def sigma_limits(df: DataFrame, value: str, k: float, by: list[str]) -> DataFrame:
    """mean -+ k population standard deviations."""
    m, s = F.avg(value), F.stddev_pop(value)
    return df.groupBy(*by).agg((m - k * s).alias("lo_limit"), (m + k * s).alias("hi_limit"))


def weighted_mean_std(df: DataFrame, value: str, weight: str, by: list[str], least: float = 1e-6) -> DataFrame:
    """Weighted mean and deviation; weights below ``least`` count as it."""
    w = F.greatest(F.col(weight), F.lit(least))
    m = F.sum(w * F.col(value)) / F.sum(w)
    return df.groupBy(*by).agg(m.alias("w_mean"), F.sqrt(F.greatest(F.sum(w * F.col(value) ** 2) / F.sum(w) - m * m, F.lit(0.0))).alias("w_std"))


def line_fit(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Least-squares line of y over x and their correlation, in one pass."""
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(y, x).alias("r_value"))


def parabola_fit(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Least-squares c0 + c1 x + c2 x^2 from power sums, aggregated in one pass and solved by determinants.

    Rows with a null in x or y don't count; with fewer than three different x the coefficients are null."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    powers = [F.lit(1.0), a, a * a, a * a * a, a * a * a * a]
    sums = [*(F.sum(p).alias(f"s{k}") for k, p in enumerate(powers)), *(F.sum(powers[k] * b).alias(f"t{k}") for k in range(3))]
    s = df.filter(a.isNotNull() & b.isNotNull()).groupBy(*by).agg(*sums, F.count_distinct(a).alias("different"))
    s0, s1, s2, s3, s4, t0, t1, t2 = (F.col(c) for c in ("s0", "s1", "s2", "s3", "s4", "t0", "t1", "t2"))
    det = F.when(F.col("different") > 2, s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2))
    c0 = t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - t2 * s3) + s2 * (t1 * s3 - t2 * s2)
    c1 = s0 * (t1 * s4 - t2 * s3) - t0 * (s1 * s4 - s2 * s3) + s2 * (s1 * t2 - s2 * t1)
    c2 = s0 * (s2 * t2 - s3 * t1) - s1 * (s1 * t2 - s2 * t1) + t0 * (s1 * s3 - s2 * s2)
    return s.select(*by, (c0 / det).alias("c0"), (c1 / det).alias("c1"), (c2 / det).alias("c2"))


def sample_rows(df: DataFrame, key: str, k: int) -> DataFrame:
    """k rows in the order of their keys' digests: the same sample at any partitioning."""
    return df.orderBy(F.md5(F.col(key).cast("string")), key).limit(k)
