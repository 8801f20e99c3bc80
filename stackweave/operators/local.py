"""Operators within one frame, on its array of pixels: no pixel leaves its row, so nothing shuffles.

Frames are frames(stack_id, frame, px) with px in row order; ny and nx are parameters.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def at(px: Column, y: Column, x: Column, nx: int) -> Column:
    """The pixel at whole (y, x), which must lie in the frame."""
    return F.get(px, (y * nx + x).cast("int")).cast("double")


def clamped(c: Column, n: int) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(float(n - 1)))


def nearest(px: Column, y: Column, x: Column, ny: int, nx: int) -> Column:
    """The pixel below (y, x); places outside the frame count as its edge."""
    return at(px, F.floor(clamped(y, ny)), F.floor(clamped(x, nx)), nx)


def bilinear(px: Column, y: Column, x: Column, ny: int, nx: int) -> Column:
    """The four pixels around (y, x) by nearness; places outside the frame count as its edge."""
    y, x = clamped(y, ny), clamped(x, nx)
    y0, x0 = F.floor(y), F.floor(x)
    y1, x1 = F.least(y0 + 1, F.lit(ny - 1)), F.least(x0 + 1, F.lit(nx - 1))
    wy, wx = y - y0, x - x0
    top = at(px, y0, x0, nx) * (1 - wx) + at(px, y0, x1, nx) * wx
    low = at(px, y1, x0, nx) * (1 - wx) + at(px, y1, x1, nx) * wx
    return top * (1 - wy) + low * wy


def resample(frames: DataFrame, dy: float, dx: float, ny: int, nx: int) -> DataFrame:
    """Every frame moved by a part of a pixel, by bilinear samples."""
    px = F.col("px")
    moved = F.transform(F.sequence(F.lit(0), F.lit(ny * nx - 1)), lambda i: bilinear(px, F.floor(i / nx) + dy, i % nx + dx, ny, nx))
    return frames.withColumn("px", moved)


def polar(frames: DataFrame, angles: int, radii: int, ny: int, nx: int, log: bool = False) -> DataFrame:
    """Frames on a grid of angles (rows) and radii around the centre; radii grow evenly, or evenly in their logarithm."""
    px, most = F.col("px"), min(ny, nx) / 2

    def sample(i: Column) -> Column:
        turn = F.floor(i / radii) * (2 * math.pi / angles)
        k = i % radii
        radius = F.exp(k * (math.log(most) / radii)) if log else k * (most / radii)
        return bilinear(px, ny / 2 + radius * F.sin(turn), nx / 2 + radius * F.cos(turn), ny, nx)

    return frames.withColumn("px", F.transform(F.sequence(F.lit(0), F.lit(angles * radii - 1)), sample))


def convolve(frames: DataFrame, kernel: list[list[float]], ny: int, nx: int) -> DataFrame:
    """Sums of each pixel's neighbours by a small odd-sized kernel, centred; outside the frame is zero."""
    px, hy, hx = F.col("px"), len(kernel) // 2, len(kernel[0]) // 2

    def one(i: Column) -> Column:
        y, x = F.floor(i / nx), i % nx
        total = F.lit(0.0)
        for dy, line in enumerate(kernel):
            for dx, w in enumerate(line):
                if w:
                    v, u = y + (dy - hy), x + (dx - hx)
                    inside = v.between(0, ny - 1) & u.between(0, nx - 1)
                    total = total + F.when(inside, at(px, v, u, nx) * w).otherwise(0.0)
        return total

    return frames.withColumn("px", F.transform(F.sequence(F.lit(0), F.lit(ny * nx - 1)), one))


def normalised(frames: DataFrame) -> DataFrame:
    """Each frame from 0 to 1; a flat frame is all null."""
    low, high = F.array_min("px").cast("double"), F.array_max("px").cast("double")
    return frames.withColumn("px", F.transform("px", lambda v: (v - low) / F.nullif(high - low, F.lit(0.0))))


def window_weight(kind: str, y: Column, x: Column, ny: int, nx: int, radius: float = 0.5) -> Column:
    """Apodisation weights: hamming_square, gauss (deviation: radius x half the side) and butter (order 4, cut at radius x half the side)."""
    cy, cx = (ny - 1) / 2, (nx - 1) / 2
    if kind == "hamming_square":
        one = lambda c, n: 0.54 - 0.46 * F.cos(2.0 * math.pi * c / (n - 1))
        return one(y, ny) * one(x, nx)
    r2 = ((y - cy) / (radius * ny / 2)) ** 2 + ((x - cx) / (radius * nx / 2)) ** 2
    if kind == "gauss":
        return F.exp(-0.5 * r2)
    if kind == "butter":
        return 1.0 / (1.0 + r2**4)
    raise ValueError(f"no window {kind!r}")


def apodization(kind: str, y: Column, x: Column, ny: int, nx: int, order: int = 1) -> Column:
    """Windows around the middle pixel of even sides, 1 there; r is 1 at half a side. Round: hann and hamming (0 beyond r = 1),
    gauss, gauss_trunc (0 beyond r = 2), butter (of an order). Square, as products over both axes: hann_square,
    hamming_square, butter_square."""
    v, u = (y - ny // 2) / (ny / 2), (x - nx // 2) / (nx / 2)
    r2 = v * v + u * u
    cosine = lambda r, a: a + (1 - a) * F.cos(math.pi * r)
    whole_order = lambda r: F.sqrt(1.0 / (1.0 + F.abs(r) ** order))
    made = {
        "hann": lambda: F.when(r2 <= 1, cosine(F.sqrt(r2), 0.5)).otherwise(0.0),
        "hamming": lambda: F.when(r2 <= 1, cosine(F.sqrt(r2), 0.54)).otherwise(0.0),
        "hann_square": lambda: cosine(v, 0.5) * cosine(u, 0.5),
        "hamming_square": lambda: cosine(v, 0.54) * cosine(u, 0.54),
        "gauss": lambda: F.exp(-r2),
        "gauss_trunc": lambda: F.when(r2 <= 4, F.exp(-r2)).otherwise(0.0),
        "butter": lambda: F.sqrt(1.0 / (1.0 + r2**order)),
        "butter_square": lambda: whole_order(v) * whole_order(u),
    }
    if kind not in made:
        raise ValueError(f"no window {kind!r}")
    return made[kind]()


def resample_nearest(frames: DataFrame, dy: float, dx: float, ny: int, nx: int) -> DataFrame:
    """Every frame moved by a part of a pixel, by the pixel below each place."""
    px = F.col("px")
    moved = F.transform(F.sequence(F.lit(0), F.lit(ny * nx - 1)), lambda i: nearest(px, F.floor(i / nx) + dy, i % nx + dx, ny, nx))
    return frames.withColumn("px", moved)


def edge_mask(y: Column, x: Column, ny: int, nx: int, top: int, bottom: int, left: int, right: int) -> Column:
    """True inside the given edges."""
    return y.between(top, ny - 1 - bottom) & x.between(left, nx - 1 - right)
