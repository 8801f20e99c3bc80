"""Sums over the frames of a stack and over the pixels of a frame, on arrays in Arrow batches: no pixel is a row.

frames(stack_id, frame, px). Each task folds the frames that it reads into one state a stack, cut into bands of pixels; the
states of a band meet in a shuffle and fold one after another, so a task holds one band and one batch there, however many
frames or tasks a stack has. A frame that met no other of its stack in its task travels as it is.

Null pixels count as not there, null or empty frames likewise; shorter frames of a stack lack the last pixels. Empty tables
give empty results."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pixels of a band.
BAND = 16_384
#: Bytes of states that a task holds before it hands them on.
HELD = 128 << 20
#: Pixels of frames that are widened at once, one frame at least.
AT_ONCE = 1 << 22


class Fold(NamedTuple):
    """A state is one array of a frame's length for each name; ``begin`` makes it from frames (k, length) with their shown
    pixels and whether each frame is even, ``join`` makes one of two, and ``blank`` is what a state has where it saw none."""

    names: tuple[str, ...]
    blank: tuple[float, ...]
    begin: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
    join: Callable[[np.ndarray, np.ndarray], np.ndarray]


def _sums(x: np.ndarray, shown: np.ndarray, even: np.ndarray) -> np.ndarray:
    return x.sum(axis=0)[None]


def _moments(x: np.ndarray, shown: np.ndarray, even: np.ndarray) -> np.ndarray:
    n, total = shown.sum(axis=0), x.sum(axis=0)
    off = np.where(shown, x - total / np.maximum(n, 1), 0.0)
    return np.stack([n, total, np.where(shown, x, -np.inf).max(axis=0), (off * off).sum(axis=0), x[even].sum(axis=0), x[~even].sum(axis=0)])


def _joined_moments(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = a[0] + b[0]
    apart = b[1] / np.maximum(b[0], 1) - a[1] / np.maximum(a[0], 1)
    both = a + b
    both[2] = np.maximum(a[2], b[2])
    both[3] += apart * apart * a[0] * b[0] / np.maximum(n, 1)
    return both


SUMS = Fold(("total",), (0.0,), _sums, np.add)
MOMENTS = Fold(("n", "total", "most", "m2", "even", "odd"), (0.0, 0.0, -np.inf, 0.0, 0.0, 0.0), _moments, _joined_moments)


def _fixed(key):
    """A key that can be compared and hashed; structs become tuples."""
    return tuple(_fixed(v) for v in key.values()) if isinstance(key, dict) else key


def _lists(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """Each list as doubles, 0 where null, with what is shown; None for a null list."""
    flat = column.flatten()  # leaves null lists out
    shown = flat.is_valid().to_numpy(zero_copy_only=False)
    values = flat.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    valid = column.is_valid().to_pylist()
    return [(values[e - n : e], shown[e - n : e]) if ok else None for e, n, ok in zip(ends, lengths, valid)]


def images(column: pa.Array, ny: int, nx: int) -> np.ndarray:
    """Lists of ny * nx pixels as doubles (n, ny, nx), NaN where a pixel is null. The values are taken as one array, as a Python
    object for each takes ten times as long as a small frame's transform."""
    if column.null_count or not np.all(column.value_lengths().to_numpy(zero_copy_only=False) == ny * nx):
        raise ValueError(f"a frame is null or not of {ny} x {nx} pixels")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, ny, nx)


def _longer(state: np.ndarray, fold: Fold, length: int) -> np.ndarray:
    missing = length - state.shape[1]
    return np.concatenate([state, np.repeat(np.array(fold.blank)[:, None], missing, axis=1)], axis=1) if missing else state


def _meet(fold: Fold, a: np.ndarray | None, b: np.ndarray) -> np.ndarray:
    if a is None:
        return b
    length = max(a.shape[1], b.shape[1])
    return fold.join(_longer(a, fold, length), _longer(b, fold, length))


def _alone(fold: Fold, x: np.ndarray, shown: np.ndarray, even: bool) -> np.ndarray:
    return fold.begin(x[None], shown[None], np.array([even]))


class _Rows:
    """Rows of bands on their way to the shuffle."""

    def __init__(self, fold: Fold, kind: pa.DataType):
        self.fold, self.kind = fold, kind
        self.rows: list[tuple] = []
        self.pixels = 0

    def add(self, key, even: bool | None, parts: tuple, length: int) -> None:
        for band, at in enumerate(range(0, length, BAND)):
            self.rows.append((key, band, even, *(None if p is None else p[at : at + BAND] for p in parts)))
        self.pixels += length

    def batches(self, least: int = 0) -> Iterator[pa.RecordBatch]:
        if self.rows and self.pixels >= least:
            step = 64 if self.pixels > AT_ONCE else len(self.rows)
            for at in range(0, len(self.rows), step):
                yield self.batch(self.rows[at : at + step])
            self.rows, self.pixels = [], 0

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        keys, bands, even, *arrays = zip(*rows)
        made = [pa.array(a, pa.list_(pa.float64())) for a in arrays]
        return pa.RecordBatch.from_arrays([pa.array(keys, self.kind), pa.array(bands, pa.int32()), pa.array(even, pa.bool_()), *made], names=["stack_id", "band", "lone", "px", *self.fold.names])


def _null_where(x: np.ndarray, shown: np.ndarray) -> np.ndarray | list:
    return x if shown.all() else np.where(shown, x.astype(object), None).tolist()


def partial_states(batches: Iterator[pa.RecordBatch], fold: Fold) -> Iterator[pa.RecordBatch]:
    """Rows of bands of the states of the frames of batches(stack_id, frame, px), handed on beyond ``HELD`` bytes."""
    lone: dict = {}
    states: dict = {}
    names: dict = {}
    held, rows = 0, None

    def hand_on() -> Iterator[pa.RecordBatch]:
        for k, (x, shown, even) in lone.items():
            rows.add(names[k], even, (_null_where(x, shown), *(None for _ in fold.names)), len(x))
            yield from rows.batches(AT_ONCE)
        for k, state in states.items():
            rows.add(names[k], None, (None, *state), state.shape[1])
            yield from rows.batches(AT_ONCE)
        yield from rows.batches()
        lone.clear()
        states.clear()

    for batch in batches:
        rows = rows or _Rows(fold, batch.schema.field("stack_id").type)
        names = {k: names[k] for d in (lone, states) for k in d}
        alike: dict = {}
        for key, frame, one in zip(batch.column("stack_id").to_pylist(), batch.column("frame").to_pylist(), _lists(batch.column("px"))):
            if one is not None and len(one[0]):
                k = _fixed(key)
                names[k] = key
                alike.setdefault((k, len(one[0])), []).append((*one, frame is not None and frame % 2 == 0))
        for (k, length), shots in alike.items():
            if len(shots) == 1 and k not in lone and k not in states:
                (x, shown, even), = shots
                lone[k] = (x.copy(), shown.copy(), even)
                held += 9 * length
            else:
                if k in lone:
                    first = lone.pop(k)
                    states[k] = _alone(fold, *first)
                    held += 8 * states[k].size - 9 * len(first[0])
                step = max(1, AT_ONCE // 8 // length)
                for at in range(0, len(shots), step):
                    x, shown, even = (np.array(v) for v in zip(*shots[at : at + step]))
                    before = states[k].size if k in states else 0
                    states[k] = _meet(fold, states.get(k), fold.begin(x, shown, even))
                    held += 8 * (states[k].size - before)
            if held > HELD:
                yield from hand_on()
                held = 0
    if rows:
        yield from hand_on()


def joined_states(batches: Iterator[pa.RecordBatch], fold: Fold) -> Iterator[pa.RecordBatch]:
    """One row for each (stack_id, band) of rows that come sorted by these."""
    at, key, state, rows = None, None, None, None

    def done() -> None:
        rows.rows.append((key, at[1], None, None, *state))
        rows.pixels += state.shape[1]

    for batch in batches:
        rows = rows or _Rows(fold, batch.schema.field("stack_id").type)
        lists = [_lists(batch.column(c)) for c in ("px", *fold.names)]
        for k, band, even, px, *parts in zip(batch.column("stack_id").to_pylist(), batch.column("band").to_pylist(), batch.column("lone").to_pylist(), *lists):
            here = (_fixed(k), band)
            if here != at:
                if at is not None:
                    done()
                    yield from rows.batches(AT_ONCE // len(fold.names))
                at, key, state = here, k, None
            state = _meet(fold, state, _alone(fold, *px, even) if px is not None else np.stack([p[0] for p in parts]))
    if at is not None:
        done()
        yield from rows.batches()


def banded(frames: DataFrame, fold: Fold) -> DataFrame:
    """stack_id, band, and an array for each name of the fold: pixel p of a frame is the p % BAND-th of band p div BAND."""
    schema = f"stack_id {frames.schema['stack_id'].dataType.simpleString()}, band int, lone boolean, px array<double>, " + ", ".join(f"{c} array<double>" for c in fold.names)
    parts = frames.select("stack_id", F.col("frame").cast("long").alias("frame"), F.col("px").cast("array<double>").alias("px")).mapInArrow(lambda b: partial_states(b, fold), schema)
    dealt = parts.repartition("stack_id", "band").sortWithinPartitions("stack_id", "band")
    return dealt.mapInArrow(lambda b: joined_states(b, fold), schema).drop("lone", "px")


def stack_sums(frames: DataFrame) -> DataFrame:
    """stack_id, total: the sum of a stack's frames, one array of a frame's length; pixels that no frame shows are 0."""
    parts = banded(frames, SUMS).groupBy("stack_id").agg(F.array_sort(F.collect_list(F.struct("band", "total"))).alias("parts"))  # a frame's length
    return parts.select("stack_id", F.flatten(F.transform("parts", lambda p: p["total"])).alias("total"))


def projections(frames: DataFrame, nx: int) -> DataFrame:
    """stack_id, y, x, total, mean, most, variance, even, odd over the frames of a stack, a row for each place that one shows."""
    parts = banded(frames, MOMENTS)
    each = parts.select("stack_id", "band", F.posexplode(F.arrays_zip(*MOMENTS.names)).alias("pos", "s")).select("stack_id", (F.col("band").cast("bigint") * BAND + F.col("pos")).alias("pos"), "s.*").filter("n > 0")
    return each.select("stack_id", F.expr(f"cast(pos div {nx} as int)").alias("y"), F.expr(f"cast(pos % {nx} as int)").alias("x"), "total", (F.col("total") / F.col("n")).alias("mean"), "most", (F.col("m2") / F.col("n")).alias("variance"), "even", "odd")


class Circles(NamedTuple):
    """The shares of pixels in whole radii around the centre, ordered by radius."""

    radii: np.ndarray
    begins: np.ndarray
    places: np.ndarray
    shares: np.ndarray

    def means(self, x: np.ndarray, shown: np.ndarray) -> np.ndarray:
        """Of frames (k, pixels) the mean at each radius, NaN where it has no pixel."""
        weight = shown[:, self.places] * self.shares
        over = np.add.reduceat(weight, self.begins, axis=1)
        weight *= x[:, self.places]
        return np.where(over > 0, np.add.reduceat(weight, self.begins, axis=1) / np.where(over > 0, over, 1.0), np.nan)


def circles(ny: int, nx: int) -> Circles:
    y, x = np.mgrid[0:ny, 0:nx]
    r = np.sqrt((y - ny // 2) ** 2.0 + (x - nx // 2) ** 2.0).ravel()
    low = np.floor(r)
    radius, share = np.concatenate([low, low + 1]).astype(np.int64), np.concatenate([1.0 - (r - low), r - low])
    order = np.argsort(radius, kind="stable")
    order = order[share[order] > 0]
    radii, begins = np.unique(radius[order], return_index=True)
    return Circles(radii, begins, order % (ny * nx), share[order])


def _long_rows(ids: list[pa.Array], radii: np.ndarray, means: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """A row for each of ids and radius; NaN becomes null."""
    n = len(means)
    spread = [a.take(pa.array(np.repeat(np.arange(n), len(radii)))) for a in ids]
    flat = means.ravel()
    return pa.RecordBatch.from_arrays([*spread, pa.array(np.tile(radii, n).astype(np.int64)), pa.array(flat, mask=np.isnan(flat))], names=names)


def _whole(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Frames (k, size) and what they show; null frames show nothing, frames of another length are an error."""
    x, shown = np.zeros((len(column), size)), np.zeros((len(column), size), dtype=bool)
    for k, one in enumerate(_lists(column)):
        if one is not None:
            if len(one[0]) != size:
                raise ValueError(f"a frame has {len(one[0])} pixels, not {size}")
            x[k], shown[k] = one
    return x, shown


def radial_means(frames: DataFrame, ny: int, nx: int) -> DataFrame:
    """stack_id, frame, radius, mean over circles around the centre; a pixel counts for the two whole radii beside its own, by
    nearness. Frames stay in their task: nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        around, step = circles(ny, nx), max(1, AT_ONCE // (ny * nx))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                yield _long_rows([batch.column("stack_id"), batch.column("frame")], around.radii, around.means(*_whole(batch.column("px"), ny * nx)), ["stack_id", "frame", "radius", "mean"])

    keys = ", ".join(f"{c} {frames.schema[c].dataType.simpleString()}" for c in ("stack_id", "frame"))
    return frames.filter("px is not null").select("stack_id", "frame", "px").mapInArrow(run, f"{keys}, radius bigint, mean double")


def _of_halves(halves: DataFrame, size: int, radii: np.ndarray, curve: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """stack_id, k, frc of halves(stack_id, half 0/1, px): ``curve`` of the two; without one of them it is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (_whole(batch.column(c), size)[0] for c in ("px0", "px1"))
            lacking = np.array([batch.column("px0").is_null().to_pylist(), batch.column("px1").is_null().to_pylist()], dtype=bool).any(axis=0)
            curves = [np.full(len(radii), np.nan) if missing else curve(p, q) for p, q, missing in zip(a, b, lacking)]
            if curves:
                yield _long_rows([batch.column("stack_id")], radii, np.array(curves), ["stack_id", "k", "frc"])

    both = halves.groupBy("stack_id").agg(*(F.max(F.when(F.col("half") == h, F.col("px"))).alias(f"px{h}") for h in (0, 1)))  # two rows of a stack
    return both.mapInArrow(run, f"stack_id {halves.schema['stack_id'].dataType.simpleString()}, k bigint, frc double")


def ring_correlation(halves: DataFrame, ny: int, nx: int) -> DataFrame:
    """stack_id, k, frc: Fourier ring correlation of halves(stack_id, half 0/1, px), a ring's sums over its frequencies by
    rounded radius; null where a half has no power and for stacks of one half."""
    ky, kx = np.minimum(np.arange(ny), ny - np.arange(ny)), np.minimum(np.arange(nx), nx - np.arange(nx))
    radius = np.rint(np.hypot(ky[:, None], kx[None, :])).astype(np.int64).ravel()
    radii = np.unique(radius)

    def curve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        za, zb = (np.fft.fft2(p.reshape(ny, nx)).ravel() for p in (a, b))
        ring = lambda v: np.bincount(radius, v)[radii]
        power = np.sqrt(ring(np.abs(za) ** 2) * ring(np.abs(zb) ** 2))
        return np.where(power > 0, ring((za * np.conj(zb)).real) / np.where(power > 0, power, 1.0), np.nan)

    return _of_halves(halves, ny * nx, radii, curve)


def tiled_ring_correlation(halves: DataFrame, box: int, step: int, ny: int, nx: int, margin: int = 0, corner: tuple[int, int] | None = None) -> DataFrame:
    """Ring correlation of halves(stack_id, half 0/1, px) over tiles under a round window: at every frequency the mean over
    tiles of how far the halves' phases agree, over its value at frequency 0, then its mean by radius around the centre.

    Frequencies without power in a tile don't count there. Null where the agreement at frequency 0 is 0 and for stacks of one
    half. ``corner`` asks for the one tile there. Tiles are transformed a row of tiles at a time."""
    tops, lefts = ([c] if corner else list(range(margin, n - margin - box + 1, step)) for c, n in zip(corner or (0, 0), (ny, nx)))
    around = circles(box, box)
    y, x = np.mgrid[0:box, 0:box]
    r = np.hypot((y - box // 2) / (box / 2), (x - box // 2) / (box / 2))
    window = np.where(r <= 1, 0.5 * (1 + np.cos(np.pi * r)), 0.0)

    def curve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        agree, times = np.zeros((box, box)), np.zeros((box, box))
        for top in tops:
            za, zb = (np.fft.fft2(np.stack([p.reshape(ny, nx)[top : top + box, left : left + box] for left in lefts]) * window) for p in (a, b))
            power = np.abs(za) * np.abs(zb)
            agree += np.where(power > 0, (za * np.conj(zb)).real / np.where(power > 0, power, 1.0), 0.0).sum(axis=0)
            times += (power > 0).sum(axis=0)
        mean = np.where(times > 0, agree / np.maximum(times, 1), 0.0)
        if abs(mean[0, 0]) <= 1e-9:
            return np.full(len(around.radii), np.nan)
        turned = lambda z: np.roll(z, (box // 2, box // 2), axis=(0, 1)).reshape(1, -1)
        return around.means(turned(mean) / mean[0, 0], turned(times > 0))[0]

    if not tops or not lefts:
        return _of_halves(halves.limit(0), ny * nx, around.radii, curve)
    return _of_halves(halves, ny * nx, around.radii, curve)
