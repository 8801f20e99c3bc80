"""Bounded fits of short curves by absolute errors from many starts, and what rests on them: weights of pairs from the
distribution of their significance, cut-offs of hot and dead pixels from the distribution of a stack's sum.

Curves are histograms' running shares, so they are as long as a histogram. The starts of every group are dealt to a few
tasks, each of which holds one curve at a time, as two arrays; the best of a group's starts is kept.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Curve = Callable[[np.ndarray, np.ndarray], np.ndarray]

STEPS = 200
HANDS = 16  # tasks that a curve's starts are dealt to, each with a copy of the curve
erf = np.vectorize(math.erf, otypes=[float])


def falling_logistic(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """1 - 1 / (1 + exp(-k (t - x))) ** nu, of (t, k, nu): from 0 far below t to 1 far above it."""
    return 1.0 - 1.0 / (1.0 + np.exp(np.clip(-p[1] * (p[0] - x), -500, 500))) ** p[2]


def normal_share(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The normal distribution's running share, of (mean, deviation)."""
    return 0.5 * (1.0 + erf((x - p[0]) / (p[1] * math.sqrt(2.0))))


def descend(curve: Curve, x: np.ndarray, y: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, float]:
    """From one start to a near minimum of the absolute errors' sum within bounds: damped steps whose errors are weighted by
    their inverse size, with slopes by differences."""
    width = np.where(high > low, high - low, 1.0)
    p = np.clip(start, low, high)
    value = curve(x, p)
    error = y - value
    cost, damping = np.abs(error).sum(), 1e-2
    for _ in range(STEPS):
        slopes = np.empty((len(x), len(p)))
        for k in range(len(p)):
            h = 1e-6 * width[k] * (1 if p[k] + 1e-6 * width[k] <= high[k] else -1)
            moved = p.copy()
            moved[k] += h
            slopes[:, k] = (curve(x, moved) - value) / h * width[k]
        w = 1.0 / np.maximum(np.abs(error), 1e-6)
        normal = slopes.T @ (slopes * w[:, None])
        step = np.linalg.lstsq(normal + damping * np.diag(np.diag(normal) + 1e-12), slopes.T @ (w * error), rcond=None)[0]
        tried = np.clip(p + step * width, low, high)
        there = curve(x, tried)
        new = y - there
        if np.abs(new).sum() < cost * (1 - 1e-12):
            gain = cost - np.abs(new).sum()
            p, value, error, cost, damping = tried, there, new, np.abs(new).sum(), max(damping / 5, 1e-9)
            if gain < 1e-10 * max(cost, 1e-12):
                break
        else:
            damping *= 5
            if damping > 1e9:
                break
    return p, float(cost)


def multi_start(curves: DataFrame, curve: Curve, bounds: DataFrame, starts: int) -> DataFrame:
    """curves(stack_id, x, y) and bounds(stack_id, low, high: arrays) -> stack_id, p, cost, starts: the best of ``starts`` fits
    a parameter, on a grid within the bounds. A stack without points or bounds has no row."""
    kind = curves.schema["stack_id"].dataType.simpleString()
    points = curves.groupBy("stack_id").agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("points"))  # a histogram's length
    ready = points.join(bounds, "stack_id")
    sizes = F.expr(f"cast(pow({starts}, size(low)) as int)")
    hand = F.explode(F.sequence(F.lit(0), F.least(sizes, F.lit(HANDS)) - 1))
    each = ready.select("stack_id", F.col("points.x").alias("x"), F.col("points.y").alias("y"), "low", "high", sizes.alias("sizes"), hand.alias("hand"))

    def run(table: pa.Table) -> pa.Table:
        """The starts of a hand on one curve."""
        flat = lambda c: table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
        x, y, low, high = (flat(c) for c in ("x", "y", "low", "high"))
        found = []
        for start in range(table.column("hand")[0].as_py(), table.column("sizes")[0].as_py(), HANDS):
            place = np.array([start // starts**k % starts for k in range(len(low))])
            found.append((start, *descend(curve, x, y, low + (high - low) * (place + 0.5) / starts, low, high)))
        key = table.column("stack_id").take(pa.array([0] * len(found)))
        return pa.table({"stack_id": key, "start": pa.array([f[0] for f in found], pa.int32()), "p": pa.array([f[1].tolist() for f in found], pa.list_(pa.float64())), "cost": pa.array([f[2] for f in found], pa.float64())})

    # a number of partitions that is given isn't lowered: the curves are small, the fits take long
    dealt = each.repartition(int(curves.sparkSession.conf.get("spark.sql.shuffle.partitions")), "stack_id", "hand")
    fits = dealt.groupBy("stack_id", "hand").applyInArrow(run, f"stack_id {kind}, start int, p array<double>, cost double")
    best = fits.groupBy("stack_id").agg(F.min(F.struct("cost", "start", "p")).alias("b"), F.count("*").cast("int").alias("starts"))
    return best.select("stack_id", F.col("b.p").alias("p"), F.col("b.cost").alias("cost"), "starts")


def running_shares(values: DataFrame, ranges: DataFrame, edge: float) -> DataFrame:
    """values(stack_id, v) and ranges(stack_id, lo, hi, bins) -> stack_id, x, y: the share of values up to the end of each equal
    bin, at the bin's left edge and ``edge`` of its width. Values outside the range count at its ends."""
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    at = F.least(F.greatest(F.floor((F.col("v") - F.col("lo")) / F.nullif(width, F.lit(0.0))), F.lit(0)), F.col("bins") - 1)
    counts = values.join(ranges, "stack_id").groupBy("stack_id", F.coalesce(at, F.lit(0)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every = ranges.select("stack_id", "lo", width.alias("width"), F.explode(F.sequence(F.lit(0), (F.col("bins") - 1).cast("int"))).alias("bin"))
    held = every.join(counts, ["stack_id", "bin"], "left").fillna(0, "n")
    w = Window.partitionBy("stack_id")
    share = F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(w)  # of bins, not of values
    return held.select("stack_id", (F.col("lo") + (F.col("bin") + edge) * F.col("width")).alias("x"), share.alias("y"))


def significance_curves(pairs: DataFrame, significance: str = "peaksig", starts: int = 4) -> DataFrame:
    """stack_id, p (threshold, steepness, nu), cost: the logistic curve nearest to the running share of a stack's positive
    significances, in a seventh as many bins as there are pairs. Stacks of fewer than 14 such pairs have no row."""
    values = pairs.select("stack_id", F.col(significance).cast("double").alias("v")).filter("v > 0 and not isnan(v)")
    ranges = values.groupBy("stack_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.floor(F.count("*") / 7).cast("int").alias("bins")).filter("bins >= 2 and hi > lo")
    limits = ranges.select("stack_id", F.array("lo", F.lit(0.1), F.lit(0.05)).alias("low"), F.array("hi", F.lit(20.0), F.lit(5.0)).alias("high"))
    return multi_start(running_shares(values, ranges, 0.0), falling_logistic, limits, starts)


def logistic_weight(value: Column, p: Column) -> Column:
    z = F.exp(F.least(F.greatest(-F.get(p, F.lit(1)) * (F.get(p, F.lit(0)) - value), F.lit(-500.0)), F.lit(500.0)))
    return 1.0 - 1.0 / F.pow(1.0 + z, F.get(p, F.lit(2)))


def weighted_pairs(pairs: DataFrame, mode: str, significance: str = "peaksig", **options) -> DataFrame:
    """Pairs with ``weight``: their significance as it stands (corr), 1 (unweighted), from 0 to 1 between the stack's least and
    largest (norm), by the logistic curve of given ``p`` (logistic) or of the stack's own distribution (autologistic; where none
    can be fitted, as it stands). A null significance has a null weight."""
    value = F.col(significance).cast("double")
    if mode == "corr":
        return pairs.withColumn("weight", value)
    if mode == "unweighted":
        return pairs.withColumn("weight", F.lit(1.0))
    if mode == "norm":
        ends = pairs.groupBy("stack_id").agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
        weight = (value - F.col("__lo")) / F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0))
        return pairs.join(ends, "stack_id").withColumn("weight", weight).drop("__lo", "__hi")
    if mode == "logistic":
        return pairs.withColumn("weight", logistic_weight(value, F.array(*(F.lit(float(v)) for v in options["p"]))))
    if mode == "autologistic":
        curves = significance_curves(pairs, significance, **options).select("stack_id", F.col("p").alias("__p"))
        return pairs.join(curves, "stack_id", "left").withColumn("weight", F.coalesce(logistic_weight(value, F.col("__p")), value)).drop("__p")
    raise ValueError(f"no way to weigh pairs is called {mode}")


def pixel_cutoffs(sums: DataFrame, bins: int = 512, reach: float = 10.0, off: float = 0.5, default: tuple[float, float] = (-4.0, 3.25), starts: int = 3) -> DataFrame:
    """sums(stack_id, v), a stack's pixels summed over frames -> stack_id, mean, deviation, lower, upper: the normal distribution nearest to that of
    the pixels by absolute errors of running shares, and how many of its deviations off dead and hot pixels begin.

    In either tail the deviations that the shares stand for fall behind those of the pixels' values; where they do by more
    than ``off``, a line through the difference is followed back to where it is 0, and that is the cut-off. A tail with fewer than two such
    bins, or whose line leads nowhere in it, gets the default. A stack of equal pixels has no row."""
    values = sums.select("stack_id", F.col("v").cast("double").alias("v")).dropna()
    middle = values.groupBy("stack_id").agg(F.percentile_approx("v", [0.25, 0.5, 0.75], 10000).alias("q"))
    wide = (F.col("q")[2] - F.col("q")[0]) / 1.349
    ranges = middle.select("stack_id", (F.col("q")[1] - reach * wide).alias("lo"), (F.col("q")[1] + reach * wide).alias("hi"), F.lit(bins).alias("bins"), F.col("q")[1].alias("at"), wide.alias("wide")).filter("wide > 0")
    limits = ranges.select("stack_id", F.array(F.col("at") - 0.5 * F.col("wide"), 0.7 * F.col("wide")).alias("low"), F.array(F.col("at") + 0.5 * F.col("wide"), 1.3 * F.col("wide")).alias("high"))
    shares = running_shares(values, ranges.select("stack_id", "lo", "hi", "bins"), 1.0)
    fits = multi_start(shares, normal_share, limits, starts)
    gathered = shares.groupBy("stack_id").agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("points")).join(fits, "stack_id")  # ``bins`` points each
    kind = sums.schema["stack_id"].dataType.simpleString()
    inverse = NormalDist().inv_cdf

    def cut(z: np.ndarray, difference: np.ndarray, usual: float) -> float:
        if len(z) < 2 or np.ptp(z) == 0:
            return usual
        slope, base = np.polyfit(z, difference, 1)
        zero = -base / slope if slope else np.nan
        return float(zero) if np.isfinite(zero) and zero * usual > 0 and abs(zero) <= reach else usual

    def run(batches):
        for batch in batches:
            rows = []
            for stack, points, p in zip(batch["stack_id"], batch["points"], batch["p"]):
                x, y = (np.array([q[c] for q in points], dtype=float) for c in ("x", "y"))
                inner = (y > 0) & (y < 1)
                z = (x[inner] - p[0]) / p[1]
                difference = z - np.array([inverse(v) for v in y[inner]])
                low, high = np.cumsum(difference > -off) == 0, np.cumsum((difference < off)[::-1])[::-1] == 0
                rows.append((stack, float(p[0]), float(p[1]), cut(z[low], difference[low], default[0]), cut(z[high], difference[high], default[1])))
            yield pd.DataFrame(rows, columns=["stack_id", "mean", "deviation", "lower", "upper"])

    return gathered.select("stack_id", "points", "p").mapInPandas(run, f"stack_id {kind}, mean double, deviation double, lower double, upper double")


def outliers(sums: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """The pixels of sums(stack_id, y, x, v) beyond their stack's cut-offs, with ``z``."""
    z = (F.col("v") - F.col("mean")) / F.col("deviation")
    met = sums.join(cutoffs, "stack_id").withColumn("z", z)
    return met.filter((F.col("z") < F.col("lower")) | (F.col("z") > F.col("upper"))).select("stack_id", "y", "x", "v", "z")
