"""Corrections of detector faults and cuts of particles: hot pixels, the gain's orientation, boxes of frames."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import images, stack_sums


def outlier_weights(frames: DataFrame, deviations: float, steepness: float) -> DataFrame:
    """stack_id, bad: for each place a weight from 0 to 1, by a logistic curve on either side of the mean of the stack's sum;
    0 everywhere where all places are alike. What a task holds of a stack is as long as a frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad = []
            for total in batch.column("total"):
                v = total.values.to_numpy(zero_copy_only=False)
                spread = v.std()
                z = np.abs(v - v.mean()) / (spread if spread > 0 else 1.0)
                bad.append(1.0 / (1.0 + np.exp(np.minimum(-steepness * (z - deviations), 700.0))) if spread > 0 else np.zeros(len(v)))
            yield pa.RecordBatch.from_arrays([batch.column("stack_id"), pa.array(bad, pa.list_(pa.float64()))], names=["stack_id", "bad"])

    return stack_sums(frames).mapInArrow(run, f"stack_id {frames.schema['stack_id'].dataType.simpleString()}, bad array<double>")


def hot_pixels(frames: DataFrame, weights: DataFrame, ny: int, nx: int) -> DataFrame:
    """Frames whose pixels give way, as far as their weight says, to the mean of the good ones among their eight
    neighbours; without good ones they stay."""
    ring = [(dy, dx) for dy in (0, 1, 2) for dx in (0, 1, 2) if (dy, dx) != (1, 1)]

    def around(z: np.ndarray) -> np.ndarray:
        padded = np.pad(z, ((0, 0), (1, 1), (1, 1)))
        return sum(padded[:, dy : dy + ny, dx : dx + nx] for dy, dx in ring)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            px, bad = (images(batch.column(c), ny, nx) for c in ("px", "bad"))
            light, among = around(px * (1.0 - bad)), around(1.0 - bad)
            mended = px * (1.0 - bad) + bad * np.where(among > 0, light / np.where(among > 0, among, 1.0), px)
            yield pa.RecordBatch.from_arrays([batch.column("stack_id"), batch.column("frame"), pa.array(list(mended.reshape(len(px), -1)), pa.list_(pa.float64()))], names=["stack_id", "frame", "px"])

    keys = ", ".join(f"{c} {frames.schema[c].dataType.simpleString()}" for c in ("stack_id", "frame"))
    return frames.join(weights, "stack_id").select("stack_id", "frame", "px", "bad").mapInArrow(run, f"{keys}, px array<double>")


def gain_orientations(sums: DataFrame, gain: DataFrame, n: int) -> DataFrame:
    """Deviation of sums(stack_id, y, x, v) times gain(y, x, g), both n x n, for each way to turn or flip the gain.

    Each pixel asks for six places of the gain, so the join is by place. ``best`` marks the least deviation, the first
    name of equal ones."""
    y, x, far = F.col("y"), F.col("x"), n - 1
    ways = {"flip_x": (y, far - x), "flip_y": (far - y, x), "none": (y, x), "rot180": (far - y, far - x), "rot270": (far - x, y), "rot90": (x, far - y)}
    asked = sums.select("stack_id", "v", F.explode(F.array(*(F.struct(F.lit(k).alias("way"), a.cast("int").alias("y"), b.cast("int").alias("x")) for k, (a, b) in ways.items()))).alias("w"))
    met = asked.select("stack_id", "v", F.col("w.way").alias("way"), F.col("w.y").alias("y"), F.col("w.x").alias("x")).join(gain, ["y", "x"])
    spread = met.groupBy("stack_id", "way").agg(F.stddev_pop(F.col("v") * F.col("g")).alias("deviation"))
    least = spread.groupBy("stack_id").agg(F.min(F.struct("deviation", "way")).alias("least"))
    return spread.join(least, "stack_id").select("stack_id", "way", "deviation", (F.col("way") == F.col("least.way")).alias("best"))


BAND_BYTES = 8_000_000  # of a frame's rows that a row of the join holds, besides the overlap


def noise(stack: str, frame: int, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Normal deviates that depend on the place alone, so that repeated tasks and overlapping boxes agree."""
    seed = zlib.crc32(f"{stack}:{frame}".encode())

    def mixed(salt: int) -> np.ndarray:
        z = (y.astype(np.uint64) << np.uint64(32) | x.astype(np.uint64)) + np.uint64((seed << 2 | salt) & (2**64 - 1)) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0**53

    return np.sqrt(-2 * np.log(1 - mixed(1))) * np.cos(2 * np.pi * mixed(2))


def resampled(boxes: np.ndarray, size: int) -> np.ndarray:
    """Squares (n, k, k) at size x size pixels over the same field, by cutting or padding their spectra."""
    k = boxes.shape[1]
    if k == size:
        return boxes
    low = min(k, size)
    z = np.fft.fftshift(np.fft.fft2(boxes), axes=(1, 2))
    out = np.zeros((len(boxes), size, size), dtype=complex)
    a, b = k // 2 - low // 2, size // 2 - low // 2
    out[:, b : b + low, b : b + low] = z[:, a : a + low, a : a + low]
    return np.fft.ifft2(np.fft.ifftshift(out, axes=(1, 2))).real * (size / k) ** 2


def cut_boxes(boxes: DataFrame, frames: DataFrame, size: int, ny: int, nx: int, clip: float, invert: bool = False, *, fill: str = "mean", out_size: int | None = None, band: int | None = None) -> DataFrame:
    """Squares of frames at boxes(stack_id, frame, top, left), normalised to mean 0 and deviation 1.

    Boxes that leave the frame are dropped; repeated ones come back as often. Values more than ``clip`` deviations off the
    box's mean become that mean (``fill`` = mean) or normal noise of the box's mean and deviation that depends on the place
    alone (gauss). Then the box is resampled to ``out_size`` pixels a side where that is given, and normalised; a flat box is
    all null.

    A frame is cut once into bands of rows that overlap by a box. The boxes of a band are gathered first, each place once, so a band
    meets them in one row and its pixels move once, however many boxes it has."""
    if fill not in ("mean", "gauss"):
        raise ValueError(f"fill is mean or gauss, not {fill}")
    step = band or max(1, BAND_BYTES // (8 * nx))
    inside = boxes.filter(F.col("top").between(0, ny - size) & F.col("left").between(0, nx - size))
    once = inside.groupBy("stack_id", "frame", F.col("top").cast("int").alias("top"), F.col("left").cast("int").alias("left")).agg(F.count("*").alias("times"))
    wanted = once.groupBy("stack_id", "frame", F.expr(f"top div {step}").cast("int").alias("band")).agg(F.collect_list(F.struct("top", "left", "times")).alias("boxes"))
    kinds = {c: frames.schema[c].dataType.simpleString() for c in ("stack_id", "frame")}

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                px = batch.column(2)[k].values
                for b, first in enumerate(range(0, ny - size + 1, step)):
                    part = px.slice(first * nx, (min(first + step + size - 1, ny) - first) * nx)
                    row = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part.cast(pa.float64()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), pa.array([b], pa.int32()), row], names=["stack_id", "frame", "band", "px"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                px = batch.column(4)[k].values.to_numpy(zero_copy_only=False).reshape(-1, nx)
                first = batch.column(2)[k].as_py() * step
                stack, frame = batch.column(0)[k], batch.column(1)[k]
                held = batch.column(3)[k].values
                every = [held.field(c).to_numpy(zero_copy_only=False) for c in ("top", "left", "times")]
                for some in range(0, len(held), 256):
                    top, left, times = (v[some : some + 256] for v in every)
                    rows, cols = top[:, None] - first + np.arange(size), left[:, None] + np.arange(size)
                    cut = px[rows[:, :, None], cols[:, None, :]]
                    mean, sd = cut.mean(axis=(1, 2), keepdims=True), cut.std(axis=(1, 2), keepdims=True)
                    good = mean
                    if fill == "gauss":
                        y, x = np.broadcast_arrays((rows + first)[:, :, None], cols[:, None, :])
                        good = mean + sd * noise(str(stack), frame.as_py(), y, x)
                    cut = np.where(np.abs(cut - mean) > clip * sd, good, cut)
                    cut = resampled(cut, out_size or size)
                    mean, sd = cut.mean(axis=(1, 2), keepdims=True), cut.std(axis=(1, 2), keepdims=True)
                    done = ((-1.0 if invert else 1.0) * (cut - mean) / np.where(sd > 0, sd, 1.0)).reshape(len(cut), -1)
                    again = np.repeat(np.arange(len(cut)), times)
                    for at in (again[m : m + 256] for m in range(0, len(again), 256)):
                        flat = np.repeat(sd[at, 0, 0] <= 0, done.shape[1])
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * done.shape[1]), pa.array(done[at].ravel(), mask=flat))
                        keys = [pa.array([v.as_py()] * len(at), v.type) for v in (stack, frame)]
                        yield pa.RecordBatch.from_arrays([*keys, pa.array(top[at].astype(np.int32)), pa.array(left[at].astype(np.int32)), lists], names=["stack_id", "frame", "top", "left", "px"])

    used = frames.join(inside.select("stack_id", "frame").distinct(), ["stack_id", "frame"], "left_semi")
    cut = used.select("stack_id", "frame", "px").mapInArrow(bands, f"stack_id {kinds['stack_id']}, frame {kinds['frame']}, band int, px array<double>")
    met = wanted.join(cut, ["stack_id", "frame", "band"]).select("stack_id", "frame", "band", "boxes", "px")
    return met.mapInArrow(run, f"stack_id {kinds['stack_id']}, frame {kinds['frame']}, top int, left int, px array<double>")
