"""Curve fits by groups. Rows never gather: every step of a fit is one grouped sum over them, and what meets in Python is a
row a group, its few sums.

Rows with a null in x or y don't count. A group that can't be fitted (too few different x, no finite start) has null
parameters; a null group key is a group like others."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import discard, materialize


@dataclass
class Model:
    """``at`` takes x and the parameters and gives the value and its slope by each parameter; ``start`` gives the first
    parameters as aggregates of the columns x and y."""

    at: Callable[[Column, list[Column]], tuple[Column, list[Column]]]
    start: Callable[[], list[Column]]


def _gauss(x, p):
    u = (x - p[1]) / p[2]
    e = F.exp(-u * u)
    return p[0] * e, [e, 2 * p[0] * e * u / p[2], 2 * p[0] * e * u * u / p[2]]


def _exponential(x, p):
    e = F.exp(p[1] * x)
    return p[0] * e, [e, p[0] * x * e]


def _power(x, p):
    e = F.pow(x, p[1])
    return p[0] * e, [e, F.when(x > 0, p[0] * e * F.ln(x)).otherwise(0.0)]


def _plus_constant(model, k):
    def at(x, p):
        value, slopes = model(x, p)
        return value + p[k], [*slopes, F.lit(1.0)]

    return at


def _power_and_line(x, p):
    value, slopes = _power(x, p)
    return value + p[2] * x + p[3], [*slopes, x, F.lit(1.0)]


def _logistic(x, p):
    middle, steepness, nu = p
    z = F.exp(F.least(F.greatest(steepness * (x - middle), F.lit(-50.0)), F.lit(50.0)))
    q = 1 / (1 + z)
    slope = nu * F.pow(q, nu + 1) * z
    return 1 - F.pow(q, nu), [-slope * steepness, slope * (x - middle), -F.pow(q, nu) * F.ln(q)]


def _gauss_plane(x, p):
    """x is a struct of y and x; parameters are height, centre y and x, widths y and x, and offset."""
    v, u = (x["y"] - p[1]) / p[3], (x["x"] - p[2]) / p[4]
    e = F.exp(-0.5 * (v * v + u * u))
    h = p[0] * e
    return h + p[5], [e, h * v / p[3], h * u / p[4], h * v * v / p[3], h * u * u / p[4], F.lit(1.0)]


def _fixed(*values: float) -> Callable[[], list[Column]]:
    return lambda: [F.lit(float(v)) for v in values]


def _range(c: str) -> Column:
    return F.max(c) - F.min(c)


MODELS = {
    "gauss1": Model(_gauss, lambda: [F.max("y"), F.max_by("x", "y"), 25 * _range("x") / F.greatest(F.count("x") - 1, F.lit(1))]),
    "abs1": Model(lambda x, p: (p[0] * F.abs(x), [F.abs(x)]), lambda: [_range("y") / F.nullif(_range("x"), F.lit(0.0))]),
    "exp": Model(_exponential, _fixed(1, -1)),
    "expc": Model(_plus_constant(_exponential, 2), _fixed(1, -1, 1)),
    "power1": Model(_power, _fixed(1, -2)),
    "power2": Model(_plus_constant(_power, 2), _fixed(1, -2, 1)),
    "powerpoly1": Model(_power_and_line, _fixed(1, -2, 0, 1)),
    "logistic": Model(_logistic, lambda: [F.avg("x"), F.lit(5.0), F.lit(1.0)]),
    "gauss_plane": Model(_gauss_plane, lambda: [_range("y"), F.avg("x.y"), F.avg("x.x"), _range("x.y") / 2, _range("x.x") / 2, F.min("y")]),
}


def _beside(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """Rows with the columns of their group; a null key finds the null group."""
    if not by:
        return rows.crossJoin(F.broadcast(groups))  # one row
    other = groups.withColumnsRenamed({c: f"__{c}" for c in by})
    matched = [rows[c].eqNullSafe(other[f"__{c}"]) for c in by]
    return rows.join(other, matched).drop(*(f"__{c}" for c in by))


def _of_rows(groups: DataFrame, solve: Callable[[dict], dict], made: str) -> DataFrame:
    """Each row, one a group, with the columns that ``solve`` makes of it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame([r | solve(r) for r in batch.to_dict("records")])

    had = {f.name: f.dataType.simpleString() for f in groups.schema.fields} | dict(c.split(" ") for c in made.split(", "))
    return groups.mapInPandas(run, ", ".join(f"`{name}` {kind}" for name, kind in had.items()))


def polynomial_fit(df: DataFrame, x: str, y: str, by: list[str], degree: int) -> DataFrame:
    """by..., coefs: least-squares coefficients from the constant up, from sums of powers in two passes.

    Powers are of x scaled to -1..1 within its group, so high degrees stay well conditioned."""
    rows = df.select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna(subset=["x", "y"])
    bounds = rows.groupBy(*by).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    u = F.coalesce((2 * F.col("x") - F.col("lo") - F.col("hi")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)), F.lit(0.0))
    powers = [F.lit(1.0)]
    for _ in range(2 * degree):
        powers.append(powers[-1] * F.col("u"))
    scaled = _beside(rows, bounds, by).withColumn("u", u)
    sums = scaled.groupBy(*by, "lo", "hi").agg(F.array(*(F.sum(p) for p in powers)).alias("s"), F.array(*(F.sum(p * F.col("y")) for p in powers[: degree + 1])).alias("t"))

    def solve(r: dict) -> dict:
        place = np.arange(degree + 1)
        normal = np.asarray(r["s"])[place[:, None] + place[None, :]]
        if np.linalg.matrix_rank(normal, tol=1e-10 * normal[0, 0]) <= degree:
            return {"coefs": None}
        c = np.linalg.solve(normal, np.asarray(r["t"]))
        line = np.polynomial.Polynomial([-(r["lo"] + r["hi"]) / (r["hi"] - r["lo"]), 2 / (r["hi"] - r["lo"])]) if degree else np.polynomial.Polynomial([0.0])
        found = np.polynomial.Polynomial(c)(line).coef
        return {"coefs": np.pad(found, (0, degree + 1 - len(found))).tolist()}

    return _of_rows(sums, solve, "coefs array<double>").select(*by, "coefs")


def polynomial(coefs: Column, x: Column) -> Column:
    return F.aggregate(F.reverse(coefs), F.lit(0.0), lambda s, c: s * x + c)


def curve_fit(df: DataFrame, x: str, y: str, by: list[str], model: str | Model, start: Callable[[], list[Column]] | None = None, absolute: bool = False, most_steps: int = 60) -> DataFrame:
    """by..., p, cost: the parameters of a model that make the sum of squared errors small, or of absolute ones.

    Damped least squares; absolute errors by weights renewed at each step. A step is one grouped sum; the fit ends when no
    group moves any more, or after so many steps with the best found so far."""
    m = MODELS[model] if isinstance(model, str) else model
    kind = df.schema[x].dataType.simpleString()
    at = F.col(x) if kind.startswith("struct") else F.col(x).cast("double")
    rows = materialize(df.select(*by, at.alias("x"), F.col(y).cast("double").alias("y")).dropna(subset=["x", "y"]), "curve")
    empty = F.array().cast("array<double>")
    state = rows.groupBy(*by).agg(F.array(*(c.cast("double") for c in (start or m.start)())).alias("tried"))
    n = len((start or m.start)())
    state = state.select(*by, "tried", F.lit(None).cast("array<double>").alias("p"), F.lit(None).cast("double").alias("cost"), F.lit(1e-3).alias("damping"), empty.alias("normal"), empty.alias("gradient"), F.lit(True).alias("moving"))
    state = materialize(state, "fit")

    def solve(r: dict) -> dict:
        best, cost, damping, normal, gradient = (r[c] for c in ("p", "cost", "damping", "normal", "gradient"))
        tried, fresh = np.asarray(r["tried"], dtype=float), r["new_cost"]
        moving = r["moving"]
        if moving and fresh is not None and np.isfinite(fresh) and np.isfinite(r["sums"]).all() and (best is None or fresh < cost):
            moved = np.inf if best is None else np.max(np.abs(tried - np.asarray(best)) / (1e-12 + np.abs(tried)))
            moving = bool(moved > 1e-10)
            best, cost, damping = tried, fresh, max(damping / 10, 1e-12)
            normal, gradient = r["sums"][: n * n], r["sums"][n * n :]
        elif moving:
            damping = damping * 10
            moving = best is not None and damping < 1e12
        if moving:
            square = np.asarray(normal, dtype=float).reshape(n, n)
            step = np.linalg.lstsq(square + np.diag(damping * np.diag(square) + 1e-300), np.asarray(gradient, dtype=float), rcond=None)[0]
            tried = np.asarray(best, dtype=float) + step
        as_list = lambda v: None if v is None else [float(q) for q in v]
        return {"p": as_list(best), "cost": cost, "damping": damping, "normal": as_list(normal), "gradient": as_list(gradient), "tried": as_list(tried), "moving": moving}

    for _ in range(most_steps):
        p = [F.get("tried", k) for k in range(n)]
        value, slopes = m.at(F.col("x"), p)
        error = F.col("y") - value
        weight = 1 / F.greatest(F.abs(error), F.lit(1e-9)) if absolute else F.lit(1.0)
        joined = _beside(rows, state.select(*by, "tried"), by)
        seen = joined.select(*by, error.alias("e"), weight.alias("w"), *(s.alias(f"g{k}") for k, s in enumerate(slopes)))
        g = [F.col(f"g{k}") for k in range(n)]
        products = [F.sum(F.col("w") * a * b) for a in g for b in g] + [F.sum(F.col("w") * a * F.col("e")) for a in g]
        cost = F.sum(F.abs("e")) if absolute else F.sum(F.col("e") * F.col("e"))
        sums = seen.groupBy(*by).agg(F.array(*products).alias("sums"), cost.alias("new_cost"))
        stepped = materialize(_of_rows(_beside(state, sums, by), solve, "p array<double>").drop("sums", "new_cost"), "fit")
        discard(state)
        state = stepped
        if state.filter("moving").isEmpty():
            break
    return state.select(*by, "p", "cost")


def fitted(df: DataFrame, fits: DataFrame, x: str, by: list[str], model: str | Model) -> DataFrame:
    """The rows with ``fit``, the model's value at their x."""
    m = MODELS[model] if isinstance(model, str) else model
    n = len(m.start())
    value, _ = m.at(F.col(x), [F.get("p", k) for k in range(n)])
    return _beside(df, fits.select(*by, "p"), by).withColumn("fit", value).drop("p")


def background(pixels: DataFrame, decimate: int) -> DataFrame:
    """stack_id, y, x, background of pixels(stack_id, y, x, v): a Gaussian on an offset, fitted to the means of blocks of
    so many pixels a side by absolute errors; 0 where none can be fitted."""
    block = [F.floor(F.col(c) / decimate).alias(c) for c in ("y", "x")]
    means = pixels.groupBy("stack_id", *block).agg(F.avg("v").alias("v"))
    centre = lambda c: (F.col(c) * decimate + (decimate - 1) / 2).cast("double").alias(c)
    fits = curve_fit(means.select("stack_id", F.struct(centre("y"), centre("x")).alias("at"), "v"), "at", "v", ["stack_id"], "gauss_plane", absolute=True)
    placed = pixels.select("stack_id", "y", "x", F.struct(F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x")).alias("at"))
    return fitted(placed, fits, "at", ["stack_id"], "gauss_plane").select("stack_id", "y", "x", F.coalesce("fit", F.lit(0.0)).alias("background"))
