"""Smoothing splines of trajectories: the smoothest curve whose squared residuals add up to a given sum.

The curve is the natural quintic spline that makes the sum of squared residuals plus a weight times the integral of its
squared third derivative least. Its third derivative is a combination of quadratic B-splines on the places; that leaves
normal equations with seven diagonals. They are solved as a block-tridiagonal system by cyclic reduction, on whole arrays in
time linear in the places. The weight is found by bisection, as the residual sum grows with it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .solve import separators

#: Points and weights that integrate products of two quadratics exactly.
GAUSS = np.polynomial.legendre.leggauss(3)
SPAN = (-40.0, 60.0)  # of the logarithm of the weight
HALVINGS = 80


def quadratic_splines(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Values (3 x intervals x points) at points of each interval k, ``at``[k], of the quadratic B-splines of integral 1 that
    begin at x[k - 2], x[k - 1], x[k]; 0 for those that don't lie within the places."""
    n = len(x)
    out = np.zeros((3, *at.shape))
    for row in range(3):
        begin = np.arange(n - 1) + row - 2
        k = np.flatnonzero((begin >= 0) & (begin + 3 < n))
        if not len(k):
            continue
        p = [x[begin[k] + m][:, None] for m in range(4)]
        u = at[k]
        basis = [np.where(2 - row == m, 1.0 / (p[m + 1] - p[m]), 0.0) for m in range(3)]
        for order in (2, 3):
            basis = [order / (order - 1) * ((u - p[m]) * basis[m] + (p[m + order] - u) * basis[m + 1]) / (p[m + order] - p[m]) for m in range(4 - order)]
        out[row, k] = basis[0]
    return out


def diagonals(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The B-splines' products as upper diagonals (4 x m), those of the third divided differences (4 x m), and the
    differences' own factors (m x 4)."""
    n, m = len(x), len(x) - 3
    half = np.diff(x)[:, None] / 2
    values = quadratic_splines(x, (x[:-1] + x[1:])[:, None] / 2 + half * GAUSS[0])
    gram, square = np.zeros((4, m)), np.zeros((4, m))
    for a in range(3):
        for b in range(a, 3):
            part = (half * GAUSS[1] * values[a] * values[b]).sum(axis=1)
            i = np.arange(n - 1) - 2 + a
            held = (i >= 0) & (i + b - a < m)
            gram[b - a, i[held]] += part[held]  # an interval each
    factors = np.stack([1 / np.prod([x[a : a + m] - x[b : b + m] for b in range(4) if b != a], axis=0) for a in range(4)], axis=1)
    for d in range(min(4, m)):
        square[d, : m - d] = (factors[: m - d, d:] * factors[d:, : 4 - d]).sum(axis=1)
    return gram, square, factors


def solve_banded(bands: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solves a symmetric positive system of upper diagonals (4 x m) by blocks of three."""
    m = bands.shape[1]
    blocks = -(-m // 3)
    wide = np.zeros((4, 3 * blocks))
    wide[0], wide[:, :m] = 1.0, bands  # unknowns beyond the last one stand apart
    of = wide.reshape(4, blocks, 3)
    d, e = np.zeros((blocks, 3, 3)), np.zeros((blocks, 3, 3))
    for a in range(3):
        for b in range(3):
            d[:, a, b] = of[abs(b - a), :, min(a, b)]
            if b <= a:
                e[:, a, b] = of[3 + b - a, :, a]
    padded = np.zeros(3 * blocks)
    padded[:m] = right
    return separators(d, e[:-1], padded.reshape(blocks, 3)).ravel()[:m]


def smoothed(x: np.ndarray, y: np.ndarray, residual: float) -> np.ndarray:
    """The curve at the places; where no smoothing weight reaches the residual sum, the best parabola."""
    if len(x) < 4 or residual <= 0:
        return y.astype(float)
    line = np.polyval(np.polyfit(x - x.mean(), y, 2), x - x.mean())
    if ((y - line) ** 2).sum() <= residual:
        return line
    gram, square, factors = diagonals(x)
    start = (factors * np.stack([y[k : k + len(factors)] for k in range(4)], axis=1)).sum(axis=1)

    def curve(log_weight: float) -> np.ndarray:
        weight = 36 * np.exp(log_weight)
        u = solve_banded(gram + weight * square, start)
        pull = np.zeros(len(x))
        for k in range(4):
            pull[k : k + len(u)] += factors[:, k] * u
        return y - weight * pull

    low, high = SPAN
    for _ in range(HALVINGS):
        middle = (low + high) / 2
        if ((y - curve(middle)) ** 2).sum() > residual:
            high = middle
        else:
            low = middle
    return curve((low + high) / 2)


def smooth_trajectories(trajectory: DataFrame, residual: float, columns: tuple[str, ...] = ("ty", "tx")) -> DataFrame:
    """trajectory(stack_id, frame, columns...) with each column smoothed over the frames of its stack to a sum of squared
    residuals of ``residual``. A stack of fewer than four different frames, or a sum of 0, stays as it is; nulls stay null and
    don't count; of several rows of a frame the mean is smoothed, and each gets it. A stack's shifts, some numbers a
    frame, are one task's."""
    kinds = {f.name: f.dataType.simpleString() for f in trajectory.schema.fields}

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("frame")
        for c in columns:
            held = rows[rows[c].notna()].groupby("frame")[c].mean()
            if len(held):
                fitted = smoothed(held.index.to_numpy(dtype=float), held.to_numpy(dtype=float), residual)
                rows[c] = rows["frame"].map(dict(zip(held.index, fitted))).where(rows[c].notna())
        return rows

    names = ["stack_id", "frame", *columns]
    shape = ", ".join(f"{c} {'double' if c in columns else kinds[c]}" for c in names)
    return trajectory.filter("frame is not null").select(*names).groupBy("stack_id").applyInPandas(run, shape)
