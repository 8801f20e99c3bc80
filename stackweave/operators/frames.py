"""Stacks of frames: one row for each frame with its pixels as an array, or one row for each pixel.

frames(stack_id, frame, px), pixels(stack_id, frame, y, x, v); ny and nx are parameters. Whole-pixel geometry is index
algebra on pixels, so it stays a projection or a filter and never shuffles.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def as_frames(table: DataFrame, stack: str, order: str, px: str) -> DataFrame:
    """Numbers the rows of each stack by ``order``; rows that tie in it follow each other by a hash of their pixels, and rows
    without either are left out.

    Pixels are dealt once, by stack and order, where ties are numbered; what meets by stack is a count for each value of
    ``order``, so no stack is one task."""
    rows = table.select(F.col(stack).alias("stack_id"), F.col(order).alias("at"), F.col(px).alias("px")).filter("stack_id is not null and at is not null")
    tie = F.row_number().over(Window.partitionBy("stack_id", "at").orderBy(F.xxhash64("px")))
    before = F.sum("n").over(Window.partitionBy("stack_id").orderBy("at")) - F.col("n")
    counts = rows.groupBy("stack_id", "at").agg(F.count("*").alias("n")).select("stack_id", "at", before.alias("before"))
    return rows.withColumn("tie", tie).join(counts, ["stack_id", "at"]).select("stack_id", (F.col("before") + F.col("tie") - 1).cast("int").alias("frame"), "px")


def as_pixels(frames: DataFrame, nx: int) -> DataFrame:
    each = frames.select("stack_id", "frame", F.posexplode("px").alias("pos", "v"))
    return each.select("stack_id", "frame", F.expr(f"pos div {nx}").cast("int").alias("y"), (F.col("pos") % nx).alias("x"), F.col("v").cast("double").alias("v"))


def project(pixels: DataFrame) -> DataFrame:
    """Sum, maximum and variance over frames, and the sums of even and odd frames, in one pass."""
    even = F.col("frame") % 2 == 0
    return pixels.groupBy("stack_id", "y", "x").agg(F.sum("v").alias("total"), F.max("v").alias("most"), F.var_pop("v").alias("variance"), F.sum(F.when(even, F.col("v")).otherwise(0.0)).alias("even"), F.sum(F.when(~even, F.col("v")).otherwise(0.0)).alias("odd"))


def roll(pixels: DataFrame, dy: Column | int, dx: Column | int, ny: int, nx: int) -> DataFrame:
    """Shift with wrap-around."""
    return pixels.withColumns({"y": F.pmod(F.col("y") + dy, F.lit(ny)).cast("int"), "x": F.pmod(F.col("x") + dx, F.lit(nx)).cast("int")})


def shift_crop(pixels: DataFrame, dy: int, dx: int, ny: int, nx: int) -> DataFrame:
    """Shift without wrap-around; what leaves the frame is dropped (absent pixels are zero)."""
    moved = pixels.withColumns({"y": F.col("y") + dy, "x": F.col("x") + dx})
    return moved.filter(F.col("y").between(0, ny - 1) & F.col("x").between(0, nx - 1))


def rot90(pixels: DataFrame, nx: int) -> DataFrame:
    """A quarter turn, counter-clockwise."""
    return pixels.withColumns({"y": nx - 1 - F.col("x"), "x": F.col("y")})


def flip(pixels: DataFrame, ny: int, nx: int, vertical: bool) -> DataFrame:
    return pixels.withColumns({"y": ny - 1 - F.col("y")} if vertical else {"x": nx - 1 - F.col("x")})


def fftshift(pixels: DataFrame, ny: int, nx: int) -> DataFrame:
    return roll(pixels, ny // 2, nx // 2, ny, nx)


def block_sum(pixels: DataFrame, k: int) -> DataFrame:
    """Sums of k x k blocks."""
    block = lambda c: F.expr(f"{c} div {k}").cast("int").alias(c)
    return pixels.groupBy("stack_id", "frame", block("y"), block("x")).agg(F.sum("v").alias("v"))


def hann_weight(y: Column, x: Column, ny: int, nx: int) -> Column:
    one = lambda c, n: 0.5 * (1.0 - F.cos(2.0 * math.pi * c / (n - 1)))
    return one(y, ny) * one(x, nx)


def radial_mean(pixels: DataFrame, ny: int, nx: int) -> DataFrame:
    """Mean over circles around the centre; a pixel counts for the two whole radii beside its own, by nearness."""
    r = F.sqrt((F.col("y") - ny // 2) ** 2 + (F.col("x") - nx // 2) ** 2)
    low = F.floor(r)
    shares = F.array(F.struct(low.alias("radius"), (1.0 - (r - low)).alias("w")), F.struct((low + 1).alias("radius"), (r - low).alias("w")))
    split = pixels.select("stack_id", "frame", "v", F.explode(shares).alias("s")).filter("s.w > 0")
    return split.groupBy("stack_id", "frame", F.col("s.radius").alias("radius")).agg((F.sum(F.col("v") * F.col("s.w")) / F.sum("s.w")).alias("mean"))


def peak(pixels: DataFrame) -> DataFrame:
    """Place of the largest pixel of each frame, the first in row order of equal ones."""
    best = F.max(F.struct("v", (-F.col("y")).alias("ny"), (-F.col("x")).alias("nx")))
    return pixels.groupBy("stack_id", "frame").agg(best.alias("b")).select("stack_id", "frame", (-F.col("b.ny")).alias("y"), (-F.col("b.nx")).alias("x"), F.col("b.v").alias("v"))


def transpose(pixels: DataFrame) -> DataFrame:
    return pixels.withColumns({"y": F.col("x"), "x": F.col("y")})


def crop(pixels: DataFrame, ny: int, nx: int) -> DataFrame:
    return pixels.filter((F.col("y") < ny) & (F.col("x") < nx))


def crop_limits(trajectory: DataFrame) -> DataFrame:
    """stack_id, top, left, bottom, right: how many edge rows and columns some frame of trajectory(stack_id, ty, tx) leaves empty."""
    edge = lambda c: (F.greatest(F.ceil(F.max(c)), F.lit(0)).cast("int"), F.greatest(-F.floor(F.min(c)), F.lit(0)).cast("int"))
    (top, bottom), (left, right) = edge("ty"), edge("tx")
    return trajectory.groupBy("stack_id").agg(top.alias("top"), left.alias("left"), bottom.alias("bottom"), right.alias("right"))


def crop_to_limits(pixels: DataFrame, limits: DataFrame, ny: int, nx: int) -> DataFrame:
    """The pixels that every frame of their stack has, numbered from the crop's corner."""
    met = pixels.join(limits, "stack_id").filter((F.col("y") >= F.col("top")) & (F.col("y") < ny - F.col("bottom")) & (F.col("x") >= F.col("left")) & (F.col("x") < nx - F.col("right")))
    return met.withColumns({"y": F.col("y") - F.col("top"), "x": F.col("x") - F.col("left")}).drop("top", "left", "bottom", "right")


def tiles(pixels: DataFrame, box: int, step: int, ny: int, nx: int, margin: int = 0) -> DataFrame:
    """Pixels of every box x box tile that holds them, with tile_y, tile_x and their place in the tile. Tiles begin at the
    margin and every ``step`` from there, as long as they fit."""
    many = lambda n: (n - 2 * margin - box) // step + 1

    def holding(c: str, n: int) -> Column:
        first = F.greatest(F.ceil((F.col(c) - margin - box + 1) / step), F.lit(0)).cast("int")
        last = F.least(F.floor((F.col(c) - margin) / step), F.lit(many(n) - 1)).cast("int")
        return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    each = pixels.withColumn("tile_y", F.explode(holding("y", ny))).withColumn("tile_x", F.explode(holding("x", nx)))
    return each.withColumns({"y": F.col("y") - F.col("tile_y") * step - margin, "x": F.col("x") - F.col("tile_x") * step - margin})


def ravel(edges: DataFrame, n: int) -> DataFrame:
    """edges(stack_id, i, j) with their place in an n x n matrix, row by row."""
    return edges.withColumn("pos", F.col("i").cast("bigint") * n + F.col("j"))


def unravel(edges: DataFrame, n: int, ahead: bool = False) -> DataFrame:
    """Back from ``pos`` to i and j below n. With ``ahead``, to pairs i < j that are at most n + 1 apart: those keep places
    of their own in any number of frames, also beyond n."""
    if ahead:
        i, step = F.expr(f"(pos - 1) div {n + 1}"), F.expr(f"(pos - 1) % {n + 1} + 1")
        return edges.withColumns({"i": i.cast("int"), "j": (i + step).cast("int")})
    return edges.withColumns({"i": F.expr(f"cast(pos div {n} as int)"), "j": (F.col("pos") % n).cast("int")})


def place_normalised(pixels: DataFrame) -> DataFrame:
    """Each pixel less its place's mean over the frames of the stack, over its deviation there; null where it has none. The
    moments are aggregated first and join back."""
    moments = pixels.groupBy("stack_id", "y", "x").agg(F.avg("v").alias("__mean"), F.stddev_pop("v").alias("__sd"))
    return pixels.join(moments, ["stack_id", "y", "x"]).withColumn("v", (F.col("v") - F.col("__mean")) / F.nullif("__sd", F.lit(0.0))).drop("__mean", "__sd")


def times_row(pixels: DataFrame, row: DataFrame) -> DataFrame:
    """Broadcasting of a lower rank: every pixel times the factor row(x, f) of its column; frames without pixels there lose none."""
    return pixels.join(row, "x").withColumn("v", F.col("v") * F.col("f")).drop("f")


def frame_pairs(frames: DataFrame, width: int, start: int = 0) -> DataFrame:
    """Pairs i < j of a stack with start < j - i <= start + width: each frame meets its own few partners by an equi-join."""
    left = frames.select("stack_id", F.col("frame").alias("i"), F.col("px").alias("px_i"), F.explode(F.sequence(F.col("frame") + start + 1, F.col("frame") + start + width)).alias("j"))
    right = frames.select("stack_id", F.col("frame").alias("j"), F.col("px").alias("px_j"))
    return left.join(right, ["stack_id", "j"]).select("stack_id", "i", "j", "px_i", "px_j")


def given_pairs(frames: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (stack_id, i, j) of a table, with their frames' pixels."""
    end = lambda c: frames.select("stack_id", F.col("frame").alias(c), F.col("px").alias(f"px_{c}"))
    return pairs.select("stack_id", "i", "j").join(end("i"), ["stack_id", "i"]).join(end("j"), ["stack_id", "j"]).select("stack_id", "i", "j", "px_i", "px_j")


def first_pairs(frames: DataFrame) -> DataFrame:
    """Each later frame with the first of its stack."""
    ids = frames.select("stack_id", F.col("frame").alias("j")).filter("j > 0")
    return given_pairs(frames, ids.select("stack_id", F.lit(0).alias("i"), "j"))


def correlations(pairs: DataFrame) -> DataFrame:
    """Zero-shift normalized correlation of each pair, on the arrays."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    corr = dot("px_i", "px_j") / F.sqrt(dot("px_i", "px_i") * dot("px_j", "px_j"))
    return pairs.select("stack_id", "i", "j", corr.alias("corr"))


def auto_band(pairs: DataFrame, threshold: float) -> DataFrame:
    """Of each i, upwards in j, the pairs up to the first whose correlation is not above the threshold; that one stays."""
    w = Window.partitionBy("stack_id", "i").orderBy("j").rowsBetween(Window.unboundedPreceding, -1)
    failed = F.max((F.col("corr") <= threshold).cast("int")).over(w)
    return pairs.withColumn("failed", F.coalesce(failed, F.lit(0))).filter("failed = 0").drop("failed")
