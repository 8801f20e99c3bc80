"""Alignment of frames: each against the rest of its stack, masked correlation of pairs, weights, ring correlation, dose."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .blocks import images, ring_correlation, stack_sums, tiled_ring_correlation  # noqa: F401  (ring correlation and sums belong to alignment)

#: Critical dose over spatial frequency q, V * (A * q**B + C): fixed values of the published dose weighting.
DOSE_A, DOSE_B, DOSE_C = 0.24499, -1.6649, 2.8141
#: The best dose over the critical one: a fixed value of the same.
BEST_DOSE = 2.51284


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def against_rest(frames: DataFrame) -> DataFrame:
    """Zero-shift correlation of each frame with the sum of the others of its stack."""
    joined = frames.join(stack_sums(frames), "stack_id")
    rest = joined.withColumn("rest", F.zip_with("total", "px", lambda t, v: t - v.cast("double")))
    px, other = F.col("px"), F.col("rest")
    return rest.select("stack_id", "frame", (dot(px, other) / F.sqrt(dot(px, px) * dot(other, other))).alias("corr"))


def edge_errors(edges: DataFrame, error: str, weight: str) -> DataFrame:
    """Weighted mean error of the edges that touch a frame, from either end."""
    ends = edges.select("stack_id", F.explode(F.array("i", "j")).alias("frame"), F.col(error).alias("e"), F.col(weight).alias("w"))
    return ends.groupBy("stack_id", "frame").agg((F.sum(F.col("w") * F.col("e")) / F.sum("w")).alias("error"), F.count(F.lit(1)).alias("n"))


def logistic(x: Column, middle: float, steepness: float, nu: float = 1.0) -> Column:
    """The generalised logistic curve from 0 to 1."""
    return 1.0 / (1.0 + nu * F.exp(-steepness * (x - middle))) ** (1.0 / nu)


def masked_shifts(pairs: DataFrame, mask: np.ndarray, furthest: int) -> DataFrame:
    """Shift (dy, dx) of frame j onto frame i with the highest masked normalized correlation, within ``furthest`` pixels.

    At each shift the correlation is over the pixels that both masks show; it comes from six padded transforms a pair.
    Places where less than a quarter of the mask overlaps, or without variance, count as 0. Ties: the first in row order."""
    ny, nx = mask.shape
    size = (2 * ny, 2 * nx)
    shifts = np.arange(-furthest, furthest + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.fft.rfft2(mask.astype(np.float64), size)
        back = lambda z: np.fft.irfft2(z, size)[..., shifts[:, None], shifts[None, :]]
        overlap = np.maximum(np.rint(back(m * np.conj(m))), 1.0)
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                a, b = (images(batch.column(c), ny, nx) * mask for c in ("px_i", "px_j"))
                fa, fb, fa2, fb2 = (np.fft.rfft2(z, size) for z in (a, b, a * a, b * b))
                sa, sb = back(fa * np.conj(m)), back(m * np.conj(fb))
                va = back(fa2 * np.conj(m)) - sa * sa / overlap
                vb = back(m * np.conj(fb2)) - sb * sb / overlap
                spread = np.sqrt(np.maximum(va, 0) * np.maximum(vb, 0))
                good = (spread > 1e-12) & (overlap >= mask.sum() / 4)
                c = np.where(good, (back(fa * np.conj(fb)) - sa * sb / overlap) / np.where(good, spread, 1.0), 0.0).reshape(len(a), -1)
                best = c.argmax(axis=1)
                cols = [pa.array(shifts[best // len(shifts)].astype(np.int32)), pa.array(shifts[best % len(shifts)].astype(np.int32)), pa.array(c.max(axis=1))]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("stack_id", "i", "j")), *cols], names=["stack_id", "i", "j", "dy", "dx", "corr"])

    kind = pairs.schema["stack_id"].dataType.simpleString()
    return pairs.select("stack_id", "i", "j", "px_i", "px_j").mapInArrow(run, f"stack_id {kind}, i int, j int, dy int, dx int, corr double")


def accumulated_dose(frames: DataFrame, dose: str, missing: float = 0.0) -> DataFrame:
    """frames(stack_id, frame, dose) with the dose before and after each: the running sum, on top of what was missed before
    the first frame."""
    w = Window.partitionBy("stack_id").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    after = F.sum(dose).over(w) + missing
    return frames.withColumns({"dose_before": after - F.col(dose), "dose_after": after})


def pair_record(pairs: DataFrame) -> DataFrame:
    """What is kept of each pair: mean, variance and largest value of the product of its frames, their correlation at no
    shift, and the means and deviations of both."""
    n = F.size("px_i").cast("double")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double"))
    product = F.zip_with("px_i", "px_j", lambda p, q: p.cast("double") * q.cast("double"))
    kept = pairs.select("stack_id", "i", "j", n.alias("n"), product.alias("c"), *(f(F.col(f"px_{k}")).alias(f"{m}_{k}") for k in ("i", "j") for m, f in (("s", total), ("q", lambda a: dot(a, a)))))
    mean, square = total(F.col("c")) / F.col("n"), dot(F.col("c"), F.col("c")) / F.col("n")
    of = lambda k: (F.col(f"s_{k}") / F.col("n"), F.sqrt(F.greatest(F.col(f"q_{k}") / F.col("n") - (F.col(f"s_{k}") / F.col("n")) ** 2, F.lit(0.0))))
    (mean_i, sd_i), (mean_j, sd_j) = of("i"), of("j")
    corr = total(F.col("c")) / F.nullif(F.sqrt(F.col("q_i") * F.col("q_j")), F.lit(0.0))
    return kept.select("stack_id", "i", "j", mean.alias("mean_c"), (square - mean * mean).alias("var_c"), F.array_max("c").alias("max_c"), corr.alias("origin_c"), mean_i.alias("mean_i"), sd_i.alias("sd_i"), mean_j.alias("mean_j"), sd_j.alias("sd_j"))


def filter_radius(cutoff: float, pixelsize: float, ny: int, nx: int) -> tuple[float, float]:
    """Fourier radius (rows, columns) at which a filter of such a cut-off spacing falls to 1/e."""
    return pixelsize * ny / cutoff, pixelsize * nx / cutoff


def lattice_limit(gamma: Column, a: Column, b: Column) -> Column:
    """The smaller squared spacing of a lattice with sides a and b and the angle gamma between them (radians)."""
    return F.least(a * a, b * b) * F.sin(gamma) ** 2


def local_ring_correlation(halves: DataFrame, box: int, ny: int, nx: int) -> DataFrame:
    """``tiled_ring_correlation`` over the one tile at the centre of the image."""
    return tiled_ring_correlation(halves, box, box, ny, nx, corner=(ny // 2 - box // 2, nx // 2 - box // 2))


def dose_weight(frame: Column, q: Column, dose_per_frame: float, voltage_factor: float = 1.0) -> Column:
    """Weight of a frequency q > 0 (1/Angstrom) in a frame (from 0) after the dose up to its end; 1 at q = 0."""
    return F.when(q > 0, F.exp(-0.5 * (frame + 1) * dose_per_frame / critical_dose(q, voltage_factor))).otherwise(1.0)


def critical_dose(q: Column, voltage_factor: float = 1.0) -> Column:
    return voltage_factor * (DOSE_A * F.pow(q, F.lit(DOSE_B)) + DOSE_C)


def best_dose_limit(before: Column, after: Column, step: float, n: int, voltage_factor: float = 1.0) -> Column:
    """The highest of the frequencies step, 2 step, ... below n steps whose best dose is nearer to the dose after a frame
    than to the dose before it, beyond which the frame adds noise only; 0 if none is."""
    grid = F.transform(F.sequence(F.lit(1), F.lit(n - 1)), lambda k: k * F.lit(step))
    useful = F.filter(grid, lambda q: BEST_DOSE * critical_dose(q, voltage_factor) > (before + after) / 2)
    return F.coalesce(F.array_max(useful), F.lit(0.0))


def dose_rolloff(q: Column, limit: Column, order: int = 32) -> Column:
    """How much of frequency q passes a limit; frequency 0 passes whole."""
    return F.when(q == 0, 1.0).when(limit == 0, 0.0).otherwise(F.exp(-F.pow(q / limit, F.lit(float(order)))))
