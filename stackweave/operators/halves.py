"""Even and odd frames of a stack aligned apart from each other, so that their sums share no noise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize
from . import align, fourier, frames, solve


def aligned_sum(part: DataFrame, ny: int, nx: int, width: int, sub: int = 1) -> DataFrame:
    """stack_id, px: the sum of the frames of a stack, each moved onto its first by the shifts that its pairs agree on. It is
    written, a row a stack, as it is read more than once."""
    shifts = solve.solve_shifts(fourier.pair_shifts(frames.frame_pairs(part, width), ny, nx, sub), "peaksig")
    moved = fourier.phase_shift(part.join(shifts, ["stack_id", "frame"], "left"), ny, nx)
    return materialize(align.stack_sums(moved).select("stack_id", F.col("total").alias("px")), "aligned-sums")


def independent_halves(stacks: DataFrame, ny: int, nx: int, width: int, sub: int = 1) -> DataFrame:
    """stack_id, half, px: the aligned sums of the even (0) and odd (1) frames, the odd one moved onto the even one. Stacks
    of one frame are left out."""
    numbered = stacks.select("stack_id", (F.col("frame") % 2).alias("half"), F.expr("cast(frame div 2 as int)").alias("frame"), "px")
    even, odd = (aligned_sum(numbered.filter(F.col("half") == h).drop("half"), ny, nx, width, sub) for h in (0, 1))
    pairs = even.select("stack_id", F.lit(0).alias("i"), F.col("px").alias("px_i")).join(odd.select("stack_id", F.lit(1).alias("j"), F.col("px").alias("px_j")), "stack_id")
    onto = fourier.pair_shifts(pairs, ny, nx, sub).select("stack_id", F.col("dy").alias("ty"), F.col("dx").alias("tx"))
    moved = fourier.phase_shift(odd.join(onto, "stack_id").withColumn("frame", F.lit(1)), ny, nx)
    kept = even.join(onto.select("stack_id"), "stack_id").select("stack_id", F.lit(0).alias("half"), "px")
    return kept.unionByName(moved.select("stack_id", F.col("frame").alias("half"), "px"))
