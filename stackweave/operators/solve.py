"""From the shifts of frame pairs to one shift a frame, and the errors of the pairs.

The weighted sum of |t[j] - t[i] - shift| is made small by rounds of reweighted least squares. The normal equations of a
stack are banded, as wide as its widest pair: blocks of ``width`` frames form a block-tridiagonal system, which is halved
level by level (cyclic reduction), so a solve takes time linear in the frames. Frames of long stacks are cut into segments;
the first block of a segment separates it from the one before. A segment's task eliminates the blocks between its separators
and hands on a small system of the separators, which are solved alike; the way back gives the frames between. This is
elimination in another order, so segments don't change the answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import discard, materialize

SEGMENT_PAIRS = 327_680  # frames times width of a segment
ROUNDS = 40
LEAST = 1e-4  # residuals below this weigh alike
TIE = 1e-7  # of the mean weight: what holds frames together that are spanned by pairs but not joined by them


def normal(n: int, width: int, i: np.ndarray, j: np.ndarray, shift: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normal equations of pairs at most ``width`` apart over n frames, by blocks of so many frames: the blocks on the
    diagonal, those beside it, and the right side. What a last block has beyond n stays out of the sums."""
    m = -(-n // width)
    total = lambda at, v, size: np.bincount(at, v, size).astype(float)  # noqa: E731  (counts of nothing are integers)
    block, own = np.divmod(i, width)
    other = j - block * width  # from the begin of i's block: width and more lies in the next one
    near = other < width
    cell = (block * width + own) * width + other
    upper = total(cell[near], -w[near], m * width * width).reshape(m, width, width)
    d = upper + upper.transpose(0, 2, 1)
    k = np.arange(width)
    d[:, k, k] = total(np.concatenate([i, j]), np.concatenate([w, w]), m * width).reshape(m, width)
    beside = total(cell[~near] - width, -w[~near], m * width * width).reshape(m, width, width)[: m - 1]
    right = total(np.concatenate([j, i]), np.concatenate([w * shift, -w * shift]), m * width)
    return d, beside, right.reshape(m, width)


def tied(n: int, tie: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Weak pairs of neighbours without a shift."""
    k = np.arange(n - 1)
    return k, k + 1, np.zeros(n - 1), np.full(n - 1, tie)


def reweighted(weight: np.ndarray, t: np.ndarray, i: np.ndarray, j: np.ndarray, shift: np.ndarray) -> np.ndarray:
    return weight / np.maximum(np.abs(t[j] - t[i] - shift), LEAST)


def system(n: int, width: int, pairs: tuple[np.ndarray, ...], ties: int, mean: float, first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normal equations of pairs (i, j, shift, w) and of the ties of the first ``ties`` frames. The first frame of a stack
    stays, and so does what a last block has beyond n."""
    d, beside, right = (p + q for p, q in zip(normal(n, width, *pairs), normal(n, width, *tied(ties, TIE * mean))))
    if first:
        d[0, 0, 0] += mean
    beyond = np.arange(n - (len(d) - 1) * width, width)
    d[-1, beyond, beyond] = mean
    return d, beside, right


def whole(n: int, i: np.ndarray, j: np.ndarray, shift: np.ndarray, weight: np.ndarray, rounds: int) -> np.ndarray:
    """All rounds of a stack that is one segment."""
    mean = weight.mean()
    loose = np.flatnonzero(np.cumsum(np.bincount(i, minlength=n) - np.bincount(j, minlength=n))[: n - 1] == 0)  # steps that no pair spans: 0
    i, j, shift, weight = (np.concatenate(p) for p in ((i, loose), (j, loose + 1), (shift, np.zeros(len(loose))), (weight, np.full(len(loose), mean))))
    width = int((j - i).max())
    w = weight
    for _ in range(rounds):
        t = separators(*system(n, width, (i, j, shift, w), n, mean, True)).ravel()[:n]
        t -= t[0]
        w = reweighted(weight, t, i, j, shift)
    return t


def separators(diagonal: np.ndarray, beside: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solves a block-tridiagonal symmetric system of m blocks by cyclic reduction: every other block goes, until one is left.
    ``beside``[k] couples block k with block k + 1; ``right`` has a row or a matrix a block."""
    d, right = np.asarray(diagonal, float), np.asarray(right, float)
    if right.ndim == 2:
        return separators(d, beside, right[:, :, None])[:, :, 0]
    m, p = d.shape[:2]
    if m == 1:
        return np.linalg.solve(d, right)
    e = np.asarray(beside, float).reshape(m - 1, p, p)
    left = e[0::2]  # couples the block before with one that goes
    onward = e[1::2]  # couples one that goes with the block after
    has = len(onward)
    sides = np.zeros((len(left), p, 2 * p + right.shape[2]))
    sides[:, :, :p], sides[:has, :, p : 2 * p], sides[:, :, 2 * p :] = left.transpose(0, 2, 1), onward, right[1::2]
    x = np.linalg.solve(d[1::2], sides)
    even, r = d[0::2].copy(), right[0::2].copy()
    before = left @ x
    even[: len(left)] -= before[:, :, :p]
    r[: len(left)] -= before[:, :, 2 * p :]
    after = onward.transpose(0, 2, 1) @ x[:has, :, p:]
    even[1:] -= after[:, :, :p]
    r[1:] -= after[:, :, p:]
    out = np.empty_like(right)
    out[0::2] = kept = separators(even, -before[:has, :, p : 2 * p], r)
    out[1::2] = x[:, :, 2 * p :] - x[:, :, :p] @ kept[: len(left)]
    out[1::2][:has] -= x[:has, :, p : 2 * p] @ kept[1:]
    return out


def eliminate(d: np.ndarray, e: np.ndarray, right: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """What is left for the first block and, but for the last segment, the last one when the blocks between are solved for."""
    p, end = d.shape[1], len(d) if last else len(d) - 1
    size = p if last else 2 * p
    a, b = np.zeros((size, size)), np.zeros(size)
    a[:p, :p], b[:p] = d[0], right[0]
    if not last:
        a[p:, p:], b[p:] = d[-1], right[-1]
    if end == 1:  # nothing between
        if not last:
            a[:p, p:], a[p:, :p] = e[0], e[0].T
        return a, b
    sides = np.zeros((end - 1, p, size + 1))
    sides[0, :, :p], sides[:, :, -1] = e[0].T, right[1:end]
    if not last:
        sides[-1, :, p:size] = e[-1]
    gone = separators(d[1:end], e[1 : end - 1], sides)
    a[:p] -= e[0] @ gone[0, :, :-1]
    b[:p] -= e[0] @ gone[0, :, -1]
    if not last:
        a[p:] -= e[-1].T @ gone[-1, :, :-1]
        b[p:] -= e[-1].T @ gone[-1, :, -1]
    return a, b


def segment_length(segment: int | None) -> Column:
    """Frames of a segment: whole blocks of the column ``width``, two at least."""
    usual = F.lit(segment) if segment else F.floor(F.lit(SEGMENT_PAIRS) / F.col("width"))
    blocks = F.greatest(F.ceil(usual / F.col("width")), F.lit(2))
    return (blocks * F.col("width")).cast("bigint")


def solve_long(good: DataFrame, stacks: DataFrame, segment: int | None, rounds: int, kind: str) -> DataFrame:
    """The rounds of stacks of several segments. ``state`` has a row a segment and axis: its pairs and present shifts, packed,
    and what is left of its equations for its separators. A round reads and writes each segment once, where it lies; what moves
    is the systems of the separators and, broadcast, their solution: 2 * width + 1 numbers a segment."""
    shape = f"stack_id {kind}, axis int, part bigint, parts bigint, begin bigint, width int, n int, mean double, i binary, j binary, shift binary, weight binary, t binary, a array<double>, b array<double>"
    columns = [c.split()[0] for c in shape.split(", ")]

    def of_segment(r: dict, t: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A segment's equations, by its shifts t, over its own frames and the separator of the next."""
        n = r["n"] + (r["width"] if r["part"] < r["parts"] - 1 else 0)
        i, j = (np.frombuffer(r[c], "<i4").astype(np.int64) for c in ("i", "j"))
        shift, weight = (np.frombuffer(r[c], "<f8") for c in ("shift", "weight"))
        w = weight if t is None else reweighted(weight, t, i, j, shift)
        # ties of a segment reach the first frame of the next
        return system(n, r["width"], (i, j, shift, w), min(n, r["n"] + 1), r["mean"], r["part"] == 0)

    def row(r: dict, t: np.ndarray | None, more: bool) -> pd.DataFrame:
        a, b = eliminate(*of_segment(r, t), r["part"] == r["parts"] - 1) if more else (np.zeros(0), np.zeros(0))
        held = {**r, "t": None if t is None else t.astype("<f8").tobytes(), "a": a.ravel(), "b": b}
        return pd.DataFrame({c: [held[c]] for c in columns})

    def deal(key: tuple, pairs: pd.DataFrame) -> pd.DataFrame:
        part = int(key[1])
        width, last, mean, long_, parts = (pairs[c].iloc[0].item() for c in ("width", "last", "mean", "long", "parts"))
        begin = part * long_
        end = last + 1 if part == parts - 1 else begin + long_
        p = pairs[pairs["i"].notna()].sort_values(["i", "j", "dy", "dx", "w"])
        packed = {c: (p[c] - begin).to_numpy(dtype="<i4").tobytes() for c in ("i", "j")} | {"weight": p["w"].to_numpy(dtype="<f8").tobytes()}
        base = {"stack_id": key[0], "part": part, "parts": parts, "begin": begin, "width": width, "n": end - begin, "mean": mean, **packed}
        return pd.concat([row({**base, "shift": p[c].to_numpy(dtype="<f8").tobytes(), "axis": k}, None, True) for k, c in enumerate(("dy", "dx"))])

    def join(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """One row a segment: width * width numbers each."""
        rows = rows.sort_values("part")
        width, m = int(rows["width"].iloc[0]), len(rows)
        d, e, right = np.zeros((m, width, width)), np.zeros((m - 1, width, width)), np.zeros((m, width))
        for k, r in enumerate(rows.itertuples()):
            a, b = np.array(r.a).reshape(len(r.b), -1), np.array(r.b)
            d[k] += a[:width, :width]
            right[k] += b[:width]
            if k + 1 < m:
                e[k] = a[:width, width:]
                d[k + 1] += a[width:, width:]
                right[k + 1] += b[width:]
        x = separators(d, e, right)
        first = x[0, 0]
        return pd.DataFrame({"stack_id": [key[0]] * m, "axis": key[1], "part": rows["part"].to_numpy(), "own": list(x - first), "following": [*(x[1:] - first), np.zeros(0)], "first": first})

    def advance(more: bool):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for r in frame.to_dict("records"):
                    d, e, right = of_segment(r, None if r["t"] is None else np.frombuffer(r["t"], "<f8"))
                    last = r["part"] == r["parts"] - 1
                    end = len(d) if last else len(d) - 1
                    x = np.empty(right.shape)
                    x[0] = r["own"] + r["first"]
                    if not last:
                        x[-1] = r["following"] + r["first"]
                    if end > 1:
                        inner = right[1:end].copy()
                        inner[0] -= e[0].T @ x[0]
                        if not last:
                            inner[-1] -= e[-1] @ x[-1]
                        x[1:end] = separators(d[1:end], e[1 : end - 1], inner)
                    yield row(r, x.ravel()[: r["n"] + (0 if last else r["width"])] - r["first"], more)

        return run

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                yield pd.DataFrame({"stack_id": [r.stack_id] * r.n, "axis": r.axis, "frame": r.begin + np.arange(r.n), "v": np.frombuffer(r.t, "<f8")[: r.n]})

    cut = stacks.withColumn("long", segment_length(segment)).withColumn("parts", F.greatest(F.lit(1), F.expr("(last + 1) div long")))  # the last one takes what is left over
    dealt = good.join(cut, "stack_id").withColumn("part", F.least(F.floor(F.col("i") / F.col("long")), F.col("parts") - 1))
    every = cut.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
    dealt = dealt.unionByName(every, allowMissingColumns=True)
    # a file a segment, so that a round's tasks can share them out evenly
    state = materialize(dealt.groupBy("stack_id", "part").applyInPandas(deal, shape), "segments", maxRecordsPerFile=1)
    for k in range(rounds):
        small = state.select("stack_id", "axis", "part", "width", "a", "b")
        found = small.groupBy("stack_id", "axis").applyInPandas(join, f"stack_id {kind}, axis int, part bigint, own array<double>, following array<double>, first double")
        moved = state.join(F.broadcast(found), ["stack_id", "axis", "part"]).mapInPandas(advance(k + 1 < rounds), shape)
        new = materialize(moved, "segments", maxRecordsPerFile=1)
        discard(state)
        state = new
    each = state.select("stack_id", "axis", "begin", "n", "t").mapInPandas(unpack, f"stack_id {kind}, axis int, frame int, v double")
    return each.groupBy("stack_id", "frame").agg(F.max(F.when(F.col("axis") == 0, F.col("v"))).alias("ty"), F.max(F.when(F.col("axis") == 1, F.col("v"))).alias("tx"))


def solve_shifts(edges: DataFrame, weight: str | None = None, segment: int | None = None, rounds: int = ROUNDS) -> DataFrame:
    """edges(stack_id, i, j, dy, dx), i < j -> stack_id, frame, ty, tx: what moves a frame onto the first of its stack.

    Stacks of fewer than two segments (with pairs up to 5 apart, 65,536 frames each) go through all rounds in one task, longer
    ones by a few jobs a round; both give the same shifts. Pairs with a null or without positive weight are dropped. There is
    a row for every frame up to the last that a pair has; where no pair leads from one frame to the next, the step is 0. A pair
    as wide as its stack makes one segment."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    used = edges.select("stack_id", "i", "j", F.col("dy").cast("double").alias("dy"), F.col("dx").cast("double").alias("dx"), w.alias("w"))
    good = used.filter("stack_id is not null and i >= 0 and i < j and w > 0 and dy is not null and dx is not null")
    kind = edges.schema["stack_id"].dataType.simpleString()
    good = materialize(good, "pairs")  # read several times
    stacks = materialize(good.groupBy("stack_id").agg(F.max("j").alias("last"), F.max(F.col("j") - F.col("i")).cast("int").alias("width"), F.avg("w").alias("mean")), "stacks")
    is_long = F.col("last") + 1 >= 2 * segment_length(segment)

    def run(key: tuple, pairs: pd.DataFrame) -> pd.DataFrame:
        p = pairs.sort_values(["i", "j", "dy", "dx", "w"])
        i, j = (p[c].to_numpy().astype(np.int64) for c in ("i", "j"))
        n = int(j.max()) + 1
        ty, tx = (whole(n, i, j, p[c].to_numpy(), p["w"].to_numpy(), rounds) for c in ("dy", "dx"))
        return pd.DataFrame({"stack_id": [key[0]] * n, "frame": np.arange(n), "ty": ty, "tx": tx})

    longer = stacks.filter(is_long)
    some_long = bool(longer.limit(1).count())
    of_short = good.join(longer.select("stack_id"), "stack_id", "left_anti") if some_long else good
    short = of_short.groupBy("stack_id").applyInPandas(run, f"stack_id {kind}, frame int, ty double, tx double")
    if not some_long:
        return short
    of_long = good.join(longer.select("stack_id"), "stack_id", "left_semi")
    # a step that no pair spans gets a pair of its own, without a shift
    spanned = of_long.select("stack_id", F.explode(F.sequence(F.col("i").cast("bigint"), F.col("j").cast("bigint") - 1)).alias("i")).distinct()
    steps = longer.select("stack_id", "mean", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last").cast("bigint") - 1)).alias("i"))
    loose = steps.join(spanned, ["stack_id", "i"], "left_anti").select("stack_id", "i", (F.col("i") + 1).alias("j"), F.lit(0.0).alias("dy"), F.lit(0.0).alias("dx"), F.col("mean").alias("w"))
    return short.unionByName(solve_long(of_long.unionByName(loose), longer, segment, rounds, kind))


def pair_errors(edges: DataFrame, shifts: DataFrame) -> DataFrame:
    """The edges with ``error``: how far the solved shifts are from a pair's own."""
    at = lambda end: shifts.select("stack_id", F.col("frame").alias(end), F.col("ty").alias(f"ty_{end}"), F.col("tx").alias(f"tx_{end}"))
    both = edges.join(at("i"), ["stack_id", "i"]).join(at("j"), ["stack_id", "j"])
    error = F.hypot(F.col("ty_j") - F.col("ty_i") - F.col("dy"), F.col("tx_j") - F.col("tx_i") - F.col("dx"))
    return both.select(*edges.columns, error.alias("error"))


def solve_rejecting(edges: DataFrame, weight: str | None = None, times: int = 2, factor: float = 3.0, floor: float = 0.5, **options) -> tuple[DataFrame, DataFrame]:
    """Shifts, and the pairs kept with their errors: after each solve a stack's pairs whose error is beyond ``factor`` times the
    root mean square of its errors, and beyond ``floor``, go, but for pairs of neighbours, without which a step might be left
    with none."""
    kept = edges
    for left in range(times, -1, -1):
        shifts = materialize(solve_shifts(kept, weight, **options), "shifts")
        errors = pair_errors(kept, shifts)
        if not left:
            return shifts, errors
        limits = errors.groupBy("stack_id").agg(F.greatest(F.sqrt(F.avg(F.col("error") ** 2)) * factor, F.lit(floor)).alias("__limit"))
        kept = materialize(errors.join(limits, "stack_id").filter((F.col("error") <= F.col("__limit")) | (F.col("j") - F.col("i") == 1)).select(*edges.columns), "kept-pairs")
