"""Image stacks in MRC files: read by ranges of frames, written one file a frame.

A file is a header of 1024 bytes (and an extended one of a length that it names), then frames of rows of pixels. Reading
is dealt by ranges of frames: a task seeks to its own and reads no others, so a file of any size never meets in one task.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER = 1024
# The number types of a header's mode.
MODES = {0: "i1", 1: "i2", 2: "f4", 6: "u2"}
RANGE_BYTES = 64_000_000  # of frames that a task reads at once
COLUMNS = "path string, frame int, ny int, nx int, pixelsize double, px array<float>"


@dataclass
class Header:
    nx: int
    ny: int
    nz: int
    dtype: np.dtype
    pixelsize: float
    start: int

    @property
    def frame_bytes(self) -> int:
        return self.nx * self.ny * self.dtype.itemsize


def parse_header(raw: bytes, path: str = "") -> Header:
    """The fields of a header in either byte order; the pixel size is the cell's x length over its x samples, 0 without."""
    if len(raw) < HEADER:
        raise ValueError(f"{path}: shorter than a header")
    for order in "<>":
        nx, ny, nz, mode = struct.unpack_from(order + "4i", raw, 0)
        if mode in MODES and min(nx, ny, nz) > 0 and max(nx, ny) < 1 << 24:
            mx, cell, extended = struct.unpack_from(order + "i", raw, 28)[0], struct.unpack_from(order + "f", raw, 40)[0], struct.unpack_from(order + "i", raw, 92)[0]
            return Header(nx, ny, nz, np.dtype(order + MODES[mode]), cell / mx if mx > 0 else 0.0, HEADER + max(extended, 0))
    raise ValueError(f"{path}: no MRC header of a known mode")


def header_bytes(ny: int, nx: int, nz: int, pixelsize: float) -> bytes:
    raw = bytearray(HEADER)
    struct.pack_into("<4i", raw, 0, nx, ny, nz, 2)
    struct.pack_into("<3i3f", raw, 28, nx, ny, nz, nx * pixelsize, ny * pixelsize, nz * pixelsize)
    struct.pack_into("<3f3i", raw, 52, 90.0, 90.0, 90.0, 1, 2, 3)
    raw[208:212], raw[212:214] = b"MAP ", bytes([0x44, 0x44])
    return bytes(raw)


def opened(path: str):
    fs, local = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return fs.open_input_file(local)


def read_mrc(spark: SparkSession, path: str | list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, frame, ny, nx, pixelsize, px (row by row) of all frames of the files.

    Spark lists the files; tasks read the headers, then ranges of frames of about so many bytes. A file that isn't MRC, or
    is shorter than its header says, is an error that names it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, length in zip(*(batch.column(k).to_pylist() for k in range(2))):
                with opened(name) as f:
                    h = parse_header(f.read(HEADER), name)
                if length < h.start + h.nz * h.frame_bytes:
                    raise ValueError(f"{name}: {length} bytes, fewer than its header says")
                step = max(range_bytes // h.frame_bytes, 1)
                firsts = list(range(0, h.nz, step))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(firsts)), pa.array(firsts, pa.int32()), pa.array([min(step, h.nz - a) for a in firsts], pa.int32())], names=["path", "first", "n"])

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first, n in zip(*(batch.column(k).to_pylist() for k in range(3))):
                with opened(name) as f:
                    h = parse_header(f.read(HEADER), name)
                    f.seek(h.start + first * h.frame_bytes)
                    for k in range(first, first + n):
                        px = np.frombuffer(f.read(h.frame_bytes), h.dtype).astype(np.float32)
                        one = pa.ListArray.from_arrays(pa.array([0, len(px)], pa.int32()), pa.array(px))
                        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([k], pa.int32()), pa.array([h.ny], pa.int32()), pa.array([h.nx], pa.int32()), pa.array([h.pixelsize]), one], names=["path", "frame", "ny", "nx", "pixelsize", "px"])

    dealt = files.mapInArrow(ranges, "path string, first int, n int")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "path", "first").mapInArrow(frames, COLUMNS)


def write_mrc(frames: DataFrame, folder: str, ny: int, nx: int, pixelsize: float = 0.0) -> DataFrame:
    """Writes each frame of frames(stack_id, frame, px) to folder/stack/frame.mrc; one row for each with its path.

    A file is written under a name of its own and then moved into place, so a repeated task leaves the same files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        for batch in batches:
            paths = []
            for stack, frame, px in zip(*(batch.column(k).to_pylist() for k in range(3))):
                fs.create_dir(f"{root}/{stack}", recursive=True)
                path, part = f"{root}/{stack}/{frame:06d}.mrc", f"{root}/{stack}/.{uuid.uuid4().hex}"
                with fs.open_output_stream(part, compression=None) as out:
                    out.write(header_bytes(ny, nx, 1, pixelsize) + np.asarray(px, dtype="<f4").tobytes())
                fs.move(part, path)
                paths.append(path)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(paths, pa.string())], names=["stack_id", "frame", "path"])

    ready = frames.select(F.col("stack_id").cast("string").alias("stack_id"), F.col("frame").cast("int").alias("frame"), "px")
    return ready.mapInArrow(run, "stack_id string, frame int, path string")


def apply_gain(frames: DataFrame, gain: DataFrame, scalar: float = 1.0) -> DataFrame:
    """frames(..., px) times the one row of gain(px), over a scalar: the gain is as long as one frame and is broadcast."""
    by = gain.select(F.col("px").alias("__gain"))
    joined = frames.crossJoin(F.broadcast(by.limit(1)))  # one row
    return joined.withColumn("px", F.zip_with("px", "__gain", lambda v, g: v.cast("double") * g.cast("double") / scalar)).drop("__gain")
