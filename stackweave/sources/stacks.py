"""Image stacks as a Spark data source: MRC, TIFF, DM3, DM4 and HDF5 files by their extension, one row for each frame.

``read_stacks`` gives the frames of all files under a path. The driver lists files; it reads the headers of
those alone that are longer than ``rangeBytes``, and cuts these into ranges of frames. Shorter files share partitions.
Filters on path and frame are pushed down: other files aren't opened, other frames aren't read. Without pixels
(option ``pixels`` = false) only headers are read.

Metadata that a format or file lacks is null; pixels become floats. A file that isn't what its extension says, or is shorter
than its header says, is an error that names it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from . import hdf5
from .mrc import HEADER, parse_header

RANGE_BYTES = 64_000_000
BATCH_PIXELS = 1 << 20  # that go on together, or one frame
META = "path string, frame int, ny int, nx int, pixelsize double, voltage double, c3 double, detector_pixel double"
PIXELS = "px array<float>"


@dataclass
class Stack:
    """What a file's header says; ``read`` takes the open file and a frame's number."""

    ny: int
    nx: int
    count: int
    frame_bytes: int
    read: Callable[[object, int], np.ndarray]
    meta: dict[str, float] = field(default_factory=dict)


def at(f, start: int, n: int) -> bytes:
    f.seek(start)
    raw = f.read(n)
    if len(raw) < n:
        raise ValueError(f"{n} bytes at {start} are beyond the file's end")
    return raw


# --- MRC -----------------------------------------------------------------------------------------------------------


def open_mrc(f, length: int) -> Stack:
    h = parse_header(f.read(HEADER))
    if length < h.start + h.nz * h.frame_bytes:
        raise ValueError(f"{length} bytes, fewer than the header says")
    return Stack(h.ny, h.nx, h.nz, h.frame_bytes, lambda f, k: np.frombuffer(at(f, h.start + k * h.frame_bytes, h.frame_bytes), h.dtype), {"pixelsize": h.pixelsize or None})


# --- TIFF ----------------------------------------------------------------------------------------------------------

# Fixed values of the format: field types and their bytes, tags.
FIELD = {1: "B", 3: "H", 4: "I", 16: "Q"}
WIDTH, LENGTH, BITS, COMPRESSION, STRIPS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILES, TILE_BYTES, FORMAT = 256, 257, 258, 259, 273, 277, 278, 279, 317, 322, 323, 324, 325, 339
DEFLATE = (8, 32946)


def directories(f) -> tuple[str, list[dict[int, tuple[int, ...]]]]:
    """The byte order and the tags of every page, along the chain of directories; classic files and those of 64-bit offsets."""
    raw = at(f, 0, 8)
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or (kind := struct.unpack(order + "H", raw[2:4])[0]) not in (42, 43):
        raise ValueError("no TIFF header")
    wide = kind == 43
    offset, many, entry = ("Q", "Q", 20) if wide else ("I", "H", 12)
    size = struct.calcsize(order + offset)
    place = struct.unpack(order + offset, at(f, 8, 8) if wide else raw[4:])[0]
    pages, met = [], set()
    while place:
        if place in met:
            raise ValueError("the chain of directories is a ring")
        met.add(place)
        head = struct.calcsize(order + many)
        n = struct.unpack(order + many, at(f, place, head))[0]
        raw = at(f, place + head, n * entry + size)
        tags = {}
        for k in range(n):
            one = raw[k * entry : (k + 1) * entry]
            tag, kind_ = struct.unpack(order + "HH", one[:4])
            if kind_ not in FIELD:
                continue
            count = struct.unpack(order + offset, one[4 : 4 + size])[0]
            held = count * struct.calcsize(FIELD[kind_])
            value = one[4 + size : 4 + size + held] if held <= size else at(f, struct.unpack(order + offset, one[4 + size :])[0], held)
            tags[tag] = struct.unpack(f"{order}{count}{FIELD[kind_]}", value)
        pages.append(tags)
        place = struct.unpack(order + offset, raw[n * entry :])[0]
    return order, pages


def tiff_dtype(order: str, tags: dict[int, tuple[int, ...]]) -> np.dtype:
    bits, form = tags.get(BITS, (1,))[0], tags.get(FORMAT, (1,))[0]
    kind = {1: "u", 2: "i", 3: "f"}.get(form)
    if kind is None or bits not in (8, 16, 32, 64) or (kind == "f" and bits < 16) or tags.get(SAMPLES, (1,))[0] != 1:
        raise ValueError(f"pixels of {bits} bits in form {form} aren't read")
    return np.dtype(f"{order}{kind}{bits // 8}")


def tiff_page(f, order: str, tags: dict[int, tuple[int, ...]]) -> np.ndarray:
    """A page from its strips or tiles, which are read one after the other."""
    ny, nx, dtype = tags[LENGTH][0], tags[WIDTH][0], tiff_dtype(order, tags)
    packing, predictor = tags.get(COMPRESSION, (1,))[0], tags.get(PREDICTOR, (1,))[0]
    if packing not in (1, *DEFLATE) or predictor not in (1, 2) or (predictor == 2 and dtype.kind == "f"):
        raise ValueError(f"compression {packing} with predictor {predictor} isn't read")
    tiled = TILES in tags
    by, bx = (tags[TILE_LENGTH][0], tags[TILE_WIDTH][0]) if tiled else (min(tags.get(ROWS_PER_STRIP, (ny,))[0], ny), nx)
    across = -(-nx // bx)
    out = np.zeros((ny, nx), dtype)
    for k, (start, n) in enumerate(zip(tags[TILES if tiled else STRIPS], tags[TILE_BYTES if tiled else STRIP_BYTES])):
        y, x = k // across * by, k % across * bx
        rows = by if tiled else min(by, ny - y)
        raw = at(f, start, n)
        block = np.frombuffer(zlib.decompress(raw) if packing in DEFLATE else raw, dtype)[: rows * bx].reshape(rows, bx)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=dtype.newbyteorder("="))
        out[y : y + rows, x : x + bx] = block[: ny - y, : nx - x]
    return out.ravel()


def open_tiff(f, length: int) -> Stack:
    order, pages = directories(f)
    if not pages:
        raise ValueError("no pages")
    shape = (pages[0][LENGTH][0], pages[0][WIDTH][0])
    same = [p for p in pages if (p[LENGTH][0], p[WIDTH][0]) == shape]  # others are thumbnails
    size = shape[0] * shape[1] * tiff_dtype(order, pages[0]).itemsize
    return Stack(*shape, len(same), size, lambda f, k: tiff_page(f, order, same[k]))


# --- DM3, DM4 ------------------------------------------------------------------------------------------------------

# Fixed values of the format: number types of tags, by their codes.
NUMBERS = {2: "i2", 3: "i4", 4: "u2", 5: "u4", 6: "f4", 7: "f8", 8: "i1", 9: "i1", 10: "i1", 11: "i8", 12: "u8"}
STRUCT, STRING, ARRAY = 15, 18, 20
GROUP, DATA = 20, 21
SHORT_VALUE = 4096  # longer arrays are noted by their place alone


@dataclass
class Block:
    """An array of a tag that stays in the file."""

    start: int
    dtype: np.dtype
    count: int


def dm_tags(f) -> dict[tuple[str, ...], object]:
    """All tags by their path; unnamed ones are numbered. Values are numbers, texts, tuples or Blocks."""
    version = struct.unpack(">I", at(f, 0, 4))[0]
    if version not in (3, 4):
        raise ValueError("no DM3 or DM4 header")
    word, step = (">q", 8) if version == 4 else (">i", 4)
    little = struct.unpack(">I", at(f, 4 + step, 4))[0] == 1
    order = "<" if little else ">"
    place = 8 + step
    out: dict[tuple[str, ...], object] = {}

    def take(n: int) -> bytes:
        nonlocal place
        raw = at(f, place, n)
        place += n
        return raw

    def whole() -> int:
        return struct.unpack(word, take(step))[0]

    def fields(info: list[int]) -> list[np.dtype]:
        return [np.dtype(order + NUMBERS[kind]) for kind in info[4::2][: info[2]]]

    def value(info: list[int]) -> object:
        nonlocal place
        kind = info[0]
        if kind in NUMBERS:
            return np.frombuffer(take(np.dtype(NUMBERS[kind]).itemsize), order + NUMBERS[kind])[0].item()
        if kind == STRUCT:
            return tuple(np.frombuffer(take(t.itemsize), t)[0].item() for t in fields(info))
        if kind == STRING:
            return take(info[1]).decode("utf-16-le" if little else "utf-16-be", "replace")
        if kind != ARRAY:
            raise ValueError(f"a tag of type {kind}")
        count = info[-1]
        if info[1] == STRUCT:
            dtype = np.dtype([(str(k), t) for k, t in enumerate(fields(info[1:]))])
        else:
            dtype = np.dtype(order + NUMBERS[info[1]])
        held = dtype.itemsize * count
        if held > SHORT_VALUE or dtype.names:
            block = Block(place, dtype, count)
            place += held
            return block
        raw = take(held)
        return raw.decode("utf-16-le" if little else "utf-16-be", "replace") if info[1] == 4 else tuple(np.frombuffer(raw, dtype).tolist())

    def group(path: tuple[str, ...]) -> None:
        nonlocal place
        take(2)
        unnamed = 0
        for _ in range(whole()):
            kind, n = struct.unpack(">BH", take(3))
            name = take(n).decode("latin-1")
            if not name:
                name, unnamed = str(unnamed), unnamed + 1
            end = place + step + whole() if version == 4 else None
            if kind == GROUP:
                group((*path, name))
            elif kind == DATA:
                take(4)
                out[(*path, name)] = value([whole() for _ in range(whole())])
            else:
                raise ValueError(f"a tag of kind {kind}")
            place = end or place

    group(())
    return out


def open_dm(f, length: int) -> Stack:
    """The second image of the file, as the first one is a thumbnail; the first where it is the only one."""
    tags = dm_tags(f)
    images = sorted({int(p[1]) for p in tags if p[0] == "ImageList" and p[2:] == ("ImageData", "Data")})
    if not images:
        raise ValueError("no image")
    root = ("ImageList", str(images[min(1, len(images) - 1)]))
    data = tags[(*root, "ImageData", "Data")]
    dims = [int(tags[(*root, "ImageData", "Dimensions", str(k))]) for k in range(3) if (*root, "ImageData", "Dimensions", str(k)) in tags]
    nx, ny, nz = (*dims, 1, 1)[:3]
    if isinstance(data, tuple):  # short enough to have been read
        held = np.array(data)
        read = lambda f, k: held[k * ny * nx : (k + 1) * ny * nx]
        dtype, count = held.dtype, len(held)
    else:
        dtype, count = data.dtype, data.count
        read = lambda f, k: np.frombuffer(at(f, data.start + k * ny * nx * dtype.itemsize, ny * nx * dtype.itemsize), dtype)
    if count < nx * ny * nz or dtype.names:
        raise ValueError("pixels don't fit the dimensions")
    scope = (*root, "ImageTags", "Microscope Info")
    scale, unit = (tags.get((*root, "ImageData", "Calibrations", "Dimension", "0", k)) for k in ("Scale", "Units"))
    detector = tags.get((*root, "ImageTags", "Acquisition", "Device", "CCD", "Pixel Size (um)"))
    voltage, c3 = tags.get((*scope, "Voltage")), tags.get((*scope, "Cs(mm)"))
    meta = {"pixelsize": scale if unit else None, "voltage": voltage / 1000.0 if voltage else None, "c3": c3 or None, "detector_pixel": detector[0] if isinstance(detector, tuple) else detector}
    return Stack(ny, nx, nz, ny * nx * dtype.itemsize, read, meta)


def open_hdf5(f, length: int) -> Stack:
    images, meta = hdf5.open_images(f)
    count, ny, nx = images.shape
    return Stack(ny, nx, count, ny * nx * images.dtype.itemsize, images.frame, meta)


FORMATS = {"h5": open_hdf5, "hdf5": open_hdf5, "mrc": open_mrc, "mrcs": open_mrc, "tif": open_tiff, "tiff": open_tiff, "dm3": open_dm, "dm4": open_dm}


# --- the data source -----------------------------------------------------------------------------------------------


def extension(path: str) -> str:
    return path.rsplit("/", 1)[-1].rpartition(".")[2].lower()


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


@dataclass
class Piece(InputPartition):
    """Files (path, length, first frame, frame after the last or None for all)."""

    files: tuple[tuple[str, int, int, int | None], ...]


class StackReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.pixels = options.get("pixels", "true").lower() != "false"
        self.first, self.end = 0, None  # frames wanted
        self.frames: set[int] | None = None
        self.paths: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name, wanted = getattr(f, "attribute", (None,)), getattr(f, "value", None)
            if isinstance(f, In) and name in (("frame",), ("path",)):
                self.narrow(name[0], set(wanted))
            elif isinstance(f, EqualTo) and name in (("frame",), ("path",)):
                self.narrow(name[0], {wanted})
            elif isinstance(f, GreaterThan) and name == ("frame",):
                self.first = max(self.first, wanted + 1)
            elif isinstance(f, GreaterThanOrEqual) and name == ("frame",):
                self.first = max(self.first, wanted)
            elif isinstance(f, LessThan) and name == ("frame",):
                self.end = wanted if self.end is None else min(self.end, wanted)
            elif isinstance(f, LessThanOrEqual) and name == ("frame",):
                self.end = wanted + 1 if self.end is None else min(self.end, wanted + 1)
            else:
                yield f

    def narrow(self, name: str, values: set) -> None:
        attr = "frames" if name == "frame" else "paths"
        held = getattr(self, attr)
        setattr(self, attr, values if held is None else held & values)

    def wanted(self, first: int, end: int) -> list[int]:
        low, high = max(first, self.first), end if self.end is None else min(end, self.end)
        return [k for k in range(low, high) if self.frames is None or k in self.frames]

    def open(self, path: str, length: int) -> tuple[object, Stack]:
        fs, local = filesystem(path)
        f = fs.open_input_file(local)
        try:
            return f, FORMATS[extension(path)](f, length)
        except (ValueError, KeyError, struct.error) as e:
            raise ValueError(f"{path}: {e}") from e

    def partitions(self) -> list[Piece]:
        fs, root = filesystem(self.path)
        info = fs.get_file_info(root)
        found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(root, recursive=True))
        scheme = self.path.split("://")[0] + "://" if "://" in self.path else "file://"
        files = sorted((f"{scheme}{x.path}", x.size) for x in found if x.is_file and extension(x.path) in FORMATS and not x.base_name.startswith((".", "_")))
        files = [x for x in files if self.paths is None or x[0] in self.paths]

        def ranges(item: tuple[str, int]) -> list[Piece]:
            path, length = item
            f, s = self.open(path, length)
            f.close()
            step = max(1, self.range_bytes // s.frame_bytes)
            return [Piece(((path, length, k, min(k + step, s.count)),)) for k in range(0, s.count, step) if self.wanted(k, min(k + step, s.count))]

        with ThreadPoolExecutor(16) as pool:
            out = [p for pieces in pool.map(ranges, [x for x in files if x[1] > self.range_bytes]) for p in pieces]
        held: list[tuple[str, int, int, int | None]] = []
        size = 0
        for path, length in (x for x in files if x[1] <= self.range_bytes):
            if held and size + length > self.range_bytes:
                out.append(Piece(tuple(held)))
                held, size = [], 0
            held.append((path, length, 0, None))
            size += length
        return [*out, Piece(tuple(held))] if held or not out else out

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, t) for n, t in zip(META.replace(",", "").split()[::2], [pa.string(), pa.int32(), pa.int32(), pa.int32(), *[pa.float64()] * 4])])
        if self.pixels:
            schema = schema.append(pa.field("px", pa.list_(pa.float32())))
        rows: list[list] = []
        pixels: list[np.ndarray] = []

        def batch() -> pa.RecordBatch:
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(schema.types[:8])]
            if self.pixels:
                ends = np.cumsum([0, *map(len, pixels)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(pixels))))
            rows.clear()
            pixels.clear()
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for path, length, first, end in partition.files:
            f, s = self.open(path, length)
            with f:
                for k in self.wanted(first, s.count if end is None else end):
                    rows.append([path, k, s.ny, s.nx, *(s.meta.get(n) for n in ("pixelsize", "voltage", "c3", "detector_pixel"))])
                    if self.pixels:
                        pixels.append(s.read(f, k).astype(np.float32))
                    if len(rows) * s.ny * s.nx * self.pixels >= BATCH_PIXELS or len(rows) >= 1024:
                        yield batch()
        if rows:
            yield batch()


class StackSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "image_stack"

    def schema(self) -> str:
        return META if self.options.get("pixels", "true").lower() == "false" else f"{META}, {PIXELS}"

    def reader(self, schema) -> StackReader:
        return StackReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StackSource)


def read_stacks(spark: SparkSession, path: str, **options: str | int | bool) -> DataFrame:
    """The frames of all stacks under a path.

    The filter that all frames pass makes Spark plan every query anew: without any filter it would take over the files and
    frames that an earlier query on the same DataFrame was narrowed to."""
    register(spark)
    return spark.read.format("image_stack").options(**{k: str(v).lower() for k, v in options.items()}).load(path).filter("frame >= 0")


def as_sequence(frames: DataFrame) -> DataFrame:
    """Files that differ by a number before their extension as one stack: stack_id is the path without it, frame counts up by
    the number's value (007 and 7 are equal; the path decides then), and by the frames within a file."""
    from pyspark.sql.window import Window

    name = r"^(.*?)(\d*)\.([^./]*)$"
    stack = F.concat(F.regexp_extract("path", name, 1), F.lit("."), F.regexp_extract("path", name, 3))
    number = F.coalesce(F.regexp_extract("path", name, 2).try_cast("decimal(38,0)"), F.lit(0))
    ids = frames.select("path", "frame", stack.alias("stack_id"), number.alias("n"))
    row = F.row_number().over(Window.partitionBy("stack_id").orderBy("n", "path", "frame")) - 1
    ids = ids.select("path", F.col("frame").alias("within"), "stack_id", row.alias("at"))  # ids alone meet in a task
    met = frames.withColumnRenamed("frame", "within").join(ids, ["path", "within"])
    return met.withColumnRenamed("at", "frame").drop("within")


# --- writing -------------------------------------------------------------------------------------------------------


def mrc_parts(px: Iterator[np.ndarray], ny: int, nx: int, count: int, pixelsize: float) -> Iterator[bytes]:
    from .mrc import header_bytes

    yield header_bytes(ny, nx, count, pixelsize)
    for one in px:
        yield one.astype("<f4").tobytes()


def tiff_parts(px: Iterator[np.ndarray], ny: int, nx: int, count: int, pixelsize: float) -> Iterator[bytes]:
    """A page of one strip for each frame, each directory after its pixels; 64-bit offsets."""
    yield struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16 + ny * nx * 4)
    start = 16
    for k, one in enumerate(px):
        tags = [(WIDTH, 4, nx), (LENGTH, 4, ny), (BITS, 3, 32), (COMPRESSION, 3, 1), (STRIPS, 16, start), (SAMPLES, 3, 1), (ROWS_PER_STRIP, 4, ny), (STRIP_BYTES, 16, ny * nx * 4), (FORMAT, 3, 3)]
        size = 8 + 20 * len(tags) + 8
        after = start + ny * nx * 4 + size
        yield one.astype("<f4").tobytes()
        yield struct.pack("<Q", len(tags)) + b"".join(struct.pack("<HHQQ", tag, kind, 1, v) for tag, kind, v in tags) + struct.pack("<Q", after + ny * nx * 4 if k + 1 < count else 0)
        start = after


WRITERS = {"mrc": mrc_parts, "mrcs": mrc_parts, "tif": tiff_parts, "tiff": tiff_parts}


def write_stacks(frames: DataFrame, folder: str, ny: int, nx: int, form: str = "mrc", pixelsize: float = 0.0) -> DataFrame:
    """Writes each stack of frames(stack_id, frame, px) to one file in the folder, frames in order; a row for each file.

    A task holds one frame at a time. A file gets its name when it is whole, so a repeated task leaves the same files."""
    import uuid

    counts = frames.groupBy("stack_id").agg(F.count("*").alias("many"))
    dealt = frames.join(counts, "stack_id").select(F.col("stack_id").cast("string").alias("stack_id"), F.col("frame").cast("int").alias("frame"), F.col("many").cast("int").alias("many"), "px")
    dealt = dealt.repartition("stack_id").sortWithinPartitions("stack_id", "frame")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        rows = ((batch.column(0)[k].as_py(), batch.column(2)[k].as_py(), batch.column(3)[k].values.to_numpy(zero_copy_only=False)) for batch in batches for k in range(batch.num_rows))
        for stack, many, first in rows:
            rest = iter([first])
            pixels = (next(rest) if k == 0 else next(rows)[2] for k in range(many))
            path, part = f"{root}/{stack}.{form}", f"{root}/.{uuid.uuid4().hex}"
            with fs.open_output_stream(part, compression=None) as out:
                for raw in WRITERS[form](pixels, ny, nx, many, pixelsize):
                    out.write(raw)
            fs.move(part, path)
            yield pa.RecordBatch.from_arrays([pa.array([stack]), pa.array([many], pa.int32()), pa.array([path])], names=["stack_id", "frames", "path"])

    return dealt.mapInArrow(run, "stack_id string, frames int, path string")
