"""Frame-wise Fourier operators: Arrow batches of frames, numpy inside a task. No frame meets another frame here."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import images, projections


def slices(batch: pa.RecordBatch, ny: int, nx: int) -> Iterator[pa.RecordBatch]:
    """What is transformed at once: 64 rows, or more of small frames."""
    step = max(64, 16_384 // (ny * nx))
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


def _apply(frames: DataFrame, ny: int, nx: int, function, columns: str) -> DataFrame:
    """``function`` takes frames (n, ny, nx) and returns arrays (n, anything) by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            px = images(batch.column(batch.num_columns - 1), ny, nx)
            made = function(px)
            cols = [pa.array(list(v.reshape(len(px), -1)), pa.list_(pa.float64())) for v in made.values()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *cols], names=[*batch.schema.names[:-1], *made])

    keys = [f"{f.name} {f.dataType.simpleString()}" for f in frames.schema.fields if f.name != "px"]
    return frames.select(*[c for c in frames.columns if c != "px"], "px").mapInArrow(run, ", ".join([*keys, columns]))


def spectra(frames: DataFrame, ny: int, nx: int) -> DataFrame:
    """Real and imaginary parts of each frame's transform."""

    def transform(px: np.ndarray) -> dict[str, np.ndarray]:
        z = np.fft.fft2(px)
        return {"re": z.real, "im": z.imag}

    return _apply(frames, ny, nx, transform, "re array<double>, im array<double>")


def incoherent_magnitude(frames: DataFrame, ny: int, nx: int) -> DataFrame:
    """Mean magnitude over the frames of a stack, by frequency; magnitudes are summed as arrays."""
    each = _apply(frames, ny, nx, lambda px: {"m": np.abs(np.fft.fft2(px))}, "m array<double>").withColumnRenamed("m", "px")
    return projections(each, nx).select("stack_id", F.col("y").alias("ky"), F.col("x").alias("kx"), F.col("mean").alias("magnitude"))


def pair_shifts(pairs: DataFrame, ny: int, nx: int, sub: int = 1, low_pass: float = 0.0) -> DataFrame:
    """Shift of frame j against frame i at the peak of their circular cross-correlation, by pair rows.

    ``low_pass`` is the deviation, in pixels, of a Gaussian over the correlation. With ``sub`` above 1 shifts are multiples
    of 1 / sub pixel: the spectrum of the 16 x 16 pixels around the peak is padded with zeros to so many times its size."""
    ky, kx = np.fft.fftfreq(ny)[:, None], np.fft.fftfreq(nx)[None, :]
    smooth = np.exp(-2 * (np.pi * low_pass) ** 2 * (ky**2 + kx**2))
    by, bx = min(16, ny), min(16, nx)

    def finer(c: np.ndarray, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows, cols = (y[:, None] + np.arange(-(by // 2), by - by // 2)) % ny, (x[:, None] + np.arange(-(bx // 2), bx - bx // 2)) % nx
        z = np.fft.fftshift(np.fft.fft2(c[np.arange(len(c))[:, None, None], rows[:, :, None], cols[:, None, :]]), axes=(1, 2))
        wide = np.zeros((len(c), by * sub, bx * sub), dtype=complex)
        top, left = by * sub // 2 - by // 2, bx * sub // 2 - bx // 2
        wide[:, top : top + by, left : left + bx] = z
        fine = np.fft.ifft2(np.fft.ifftshift(wide, axes=(1, 2))).real
        # the peak lies within a pixel of the largest one, not at the rims that the cut makes
        ry, rx = (np.arange(n * sub) for n in (by, bx))
        near = (np.abs(ry - by // 2 * sub) <= sub)[:, None] & (np.abs(rx - bx // 2 * sub) <= sub)[None, :]
        at = np.where(near, fine, -np.inf).reshape(len(c), -1).argmax(axis=1)
        return at // (bx * sub) / sub - by // 2, at % (bx * sub) / sub - bx // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, ny, nx):
                a, b = (images(batch.column(k), ny, nx) for k in ("px_i", "px_j"))
                a, b = (z - z.mean(axis=(1, 2), keepdims=True) for z in (a, b))
                square = np.fft.ifft2(np.fft.fft2(a) * np.conj(np.fft.fft2(b)) * smooth).real
                c = square.reshape(len(a), -1)
                at = c.argmax(axis=1)
                y, x = at // nx, at % nx
                dy, dx = (y + ny // 2) % ny - ny // 2, (x + nx // 2) % nx - nx // 2
                if sub > 1:
                    dy, dx = (whole_px + part for whole_px, part in zip((dy, dx), finer(square, y, x)))
                significance = (c.max(axis=1) - c.mean(axis=1)) / np.maximum(c.std(axis=1), 1e-12)
                keys = [batch.column(k) for k in ("stack_id", "i", "j")]
                yield pa.RecordBatch.from_arrays([*keys, *(pa.array(d.astype(np.int32) if sub == 1 else d.astype(np.float64)) for d in (dy, dx)), pa.array(significance)], names=["stack_id", "i", "j", "dy", "dx", "peaksig"])

    kind, number = pairs.schema["stack_id"].dataType.simpleString(), "int" if sub == 1 else "double"
    return pairs.select("stack_id", "i", "j", "px_i", "px_j").mapInArrow(run, f"stack_id {kind}, i int, j int, dy {number}, dx {number}, peaksig double")


SHARPEST = (np.sqrt(5) - 1) / 2  # the golden section


def _contrast(spectrum: np.ndarray, sigma: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Correlations under a Gaussian of each one's own deviation, and (largest - mean) / deviation of their pixels."""
    c = np.fft.ifft2(spectrum * np.exp(-2 * (np.pi * sigma[:, None, None]) ** 2 * k2)).real
    flat = c.reshape(len(c), -1)
    return c, (flat.max(axis=1) - flat.mean(axis=1)) / np.maximum(flat.std(axis=1), 1e-300)


def best_low_pass(spectrum: np.ndarray, k2: np.ndarray, most: float, tolerance: float, start: int) -> np.ndarray:
    """For each correlation the deviation from 0 to ``most`` with the largest contrast, all of a batch at once.

    A coarse row of deviations brackets the largest, which golden sections narrow down."""
    grid = np.linspace(0.0, most, start)
    at = np.argmax([_contrast(spectrum, np.full(len(spectrum), g), k2)[1] for g in grid], axis=0)
    low, high = grid[np.maximum(at - 1, 0)], grid[np.minimum(at + 1, start - 1)]
    a, b = high - SHARPEST * (high - low), low + SHARPEST * (high - low)
    fa, fb = _contrast(spectrum, a, k2)[1], _contrast(spectrum, b, k2)[1]
    while (high - low).max() > tolerance:
        left = fa >= fb  # the largest is below b
        low, high = np.where(left, low, a), np.where(left, b, high)
        new = np.where(left, high - SHARPEST * (high - low), low + SHARPEST * (high - low))
        f_new = _contrast(spectrum, new, k2)[1]
        a, b, fa, fb = np.where(left, new, b), np.where(left, a, new), np.where(left, f_new, fb), np.where(left, fa, f_new)
    return (low + high) / 2


def sharpest_shifts(pairs: DataFrame, ny: int, nx: int, most: float = 7.0, tolerance: float = 0.01, start: int = 15) -> DataFrame:
    """Whole-pixel shifts of pairs, each under the Gaussian low-pass that makes its own peak stand out most: dy, dx, the
    deviation ``sigma`` of that Gaussian in pixels (within ``tolerance``, at most ``most``) and the peak's significance."""
    k2 = np.fft.fftfreq(ny)[:, None] ** 2 + np.fft.fftfreq(nx)[None, :] ** 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, ny, nx):
                a, b = (images(batch.column(k), ny, nx) for k in ("px_i", "px_j"))
                a, b = (z - z.mean(axis=(1, 2), keepdims=True) for z in (a, b))
                spectrum = np.fft.fft2(a) * np.conj(np.fft.fft2(b))
                sigma = best_low_pass(spectrum, k2, most, tolerance, start)
                c, significance = _contrast(spectrum, sigma, k2)
                at = c.reshape(len(c), -1).argmax(axis=1)
                dy, dx = (at // nx + ny // 2) % ny - ny // 2, (at % nx + nx // 2) % nx - nx // 2
                cols = [pa.array(dy.astype(np.int32)), pa.array(dx.astype(np.int32)), pa.array(sigma), pa.array(significance)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("stack_id", "i", "j")), *cols], names=["stack_id", "i", "j", "dy", "dx", "sigma", "peaksig"])

    kind = pairs.schema["stack_id"].dataType.simpleString()
    return pairs.select("stack_id", "i", "j", "px_i", "px_j").mapInArrow(run, f"stack_id {kind}, i int, j int, dy int, dx int, sigma double, peaksig double")


def followed_shifts(pairs: DataFrame, ny: int, nx: int, furthest: float) -> DataFrame:
    """Whole-pixel shifts of pairs, searched around the last one: of the pairs of a frame i, upwards in j, the first looks
    within ``furthest`` pixels of no shift, every next one within as much of the shift found before it. The centre moves
    around the edges as correlations do.

    The correlations of all pairs are made first, each in any task. Those of one i then pass one task in order, one at a
    time; a row there is one correlation."""
    ry, rx = np.fft.fftfreq(ny, 1 / ny).round()[:, None], np.fft.fftfreq(nx, 1 / nx).round()[None, :]
    disk = np.hypot(ry, rx) <= furthest

    def correlate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, ny, nx):
                a, b = (images(batch.column(k), ny, nx) for k in ("px_i", "px_j"))
                a, b = (z - z.mean(axis=(1, 2), keepdims=True) for z in (a, b))
                c = np.fft.ifft2(np.fft.fft2(a) * np.conj(np.fft.fft2(b))).real.reshape(len(a), -1)
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("stack_id", "i", "j")), pa.array(list(c), pa.list_(pa.float64()))], names=["stack_id", "i", "j", "c"])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, centre = None, (0, 0)
        for batch in batches:
            found = []
            for k in range(batch.num_rows):
                key = (batch.column(0)[k].as_py(), batch.column(1)[k].as_py())
                if key != of:
                    of, centre = key, (0, 0)
                c = np.asarray(batch.column(3)[k].values).reshape(ny, nx)
                seen = np.roll(disk, centre, axis=(0, 1))
                y, x = np.unravel_index(np.argmax(np.where(seen, c, -np.inf)), c.shape)
                centre = int((y + ny // 2) % ny - ny // 2), int((x + nx // 2) % nx - nx // 2)
                found.append((*centre, float((c[y, x] - c[seen].mean()) / max(c[seen].std(), 1e-12))))
            cols = [pa.array([v[m] for v in found], kind) for m, kind in enumerate((pa.int32(), pa.int32(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *cols], names=["stack_id", "i", "j", "dy", "dx", "peaksig"])

    kind = pairs.schema["stack_id"].dataType.simpleString()
    maps = pairs.select("stack_id", "i", "j", "px_i", "px_j").mapInArrow(correlate, f"stack_id {kind}, i int, j int, c array<double>")
    dealt = maps.repartition("stack_id", "i").sortWithinPartitions("stack_id", "i", "j")
    return dealt.mapInArrow(follow, f"stack_id {kind}, i int, j int, dy int, dx int, peaksig double")


def pad(frames: DataFrame, ny: int, nx: int, to_ny: int, to_nx: int) -> DataFrame:
    """Frames with zeros below and to the right."""
    return _apply(frames, ny, nx, lambda px: {"px": np.pad(px, ((0, 0), (0, to_ny - ny), (0, to_nx - nx)))}, "px array<double>")


def fourier_crop(frames: DataFrame, ny: int, nx: int, to_ny: int, to_nx: int) -> DataFrame:
    """Frames of fewer pixels from their low frequencies alone; sides are even, means stay."""

    def cropped(px: np.ndarray) -> dict[str, np.ndarray]:
        z = np.fft.fft2(px)
        keep = lambda n, m: np.r_[0 : m // 2, n - m // 2 : n]
        z = z[:, keep(ny, to_ny)][:, :, keep(nx, to_nx)]
        return {"px": np.fft.ifft2(z).real * (to_ny * to_nx / (ny * nx))}

    return _apply(frames, ny, nx, cropped, "px array<double>")


def gaussian(frames: DataFrame, ny: int, nx: int, deviation: float) -> DataFrame:
    """A Gaussian over each frame, cut at four deviations; edges are mirrored."""
    half = int(4 * deviation + 0.5)
    w = np.exp(-0.5 * (np.arange(-half, half + 1) / deviation) ** 2)
    w /= w.sum()

    def along(px: np.ndarray, axis: int) -> np.ndarray:
        wide = np.pad(px, [(half, half) if a == axis else (0, 0) for a in range(3)], mode="symmetric")
        return sum(w[k] * np.take(wide, np.arange(k, k + px.shape[axis]), axis=axis) for k in range(2 * half + 1))

    return _apply(frames, ny, nx, lambda px: {"px": along(along(px, 1), 2)}, "px array<double>")


#: Weights of the kernel that halves or doubles an image: fixed values.
MAGIC = (0.25, 0.75, 0.75, 0.25)


def magic_halved(frames: DataFrame, ny: int, nx: int) -> DataFrame:
    """Frames of half the sides: each new pixel is the weighted mean of the 4 x 4 around its 2 x 2; edges are mirrored."""

    def along(px: np.ndarray, axis: int) -> np.ndarray:
        wide = np.pad(px, [(1, 1) if a == axis else (0, 0) for a in range(3)], mode="symmetric")
        n = px.shape[axis] // 2
        return sum(w / 2 * np.take(wide, np.arange(n) * 2 + k, axis=axis) for k, w in enumerate(MAGIC))

    return _apply(frames, ny, nx, lambda px: {"px": along(along(px, 1), 2)}, "px array<double>")


def magic_doubled(frames: DataFrame, ny: int, nx: int) -> DataFrame:
    """Frames of twice the sides: a new pixel is three parts of the pixel that it lies in and one of the next; edges are mirrored."""

    def along(px: np.ndarray, axis: int) -> np.ndarray:
        wide = np.pad(px, [(1, 1) if a == axis else (0, 0) for a in range(3)], mode="symmetric")
        n = px.shape[axis]
        near, before, after = (np.take(wide, np.arange(n) + k, axis=axis) for k in (1, 0, 2))
        both = np.stack([0.75 * near + 0.25 * before, 0.75 * near + 0.25 * after], axis=axis + 1)
        return both.reshape([2 * n if a == axis else s for a, s in enumerate(px.shape)])

    return _apply(frames, ny, nx, lambda px: {"px": along(along(px, 1), 2)}, "px array<double>")


def fft_sizes(most: int) -> list[int]:
    """Even sizes up to ``most`` without other prime factors than 2, 3, 5 and 7, sorted."""
    found = {1}
    for prime in (2, 3, 5, 7):
        todo = list(found)
        while todo:
            todo = [n * prime for n in todo if n * prime <= most]
            found.update(todo)
    return sorted(n for n in found if n % 2 == 0)


def next_fft_size(n: Column, most: int) -> Column:
    """The smallest such size that isn't below n; null beyond the largest."""
    return F.array_min(F.filter(F.lit(fft_sizes(most)), lambda size: size >= n))


def _moved(frames: DataFrame, ny: int, nx: int, move) -> DataFrame:
    """``move`` takes frames (n, ny, nx) and their shifts ty and tx (n, 1, 1); a null shift counts as 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            px = images(batch.column("px"), ny, nx)
            ty, tx = (batch.column(c).to_numpy(zero_copy_only=False)[:, None, None] for c in ("ty", "tx"))
            made = pa.array(list(move(px, ty, tx).reshape(len(px), -1)), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("stack_id"), batch.column("frame"), made], names=["stack_id", "frame", "px"])

    shift = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("ty", "tx")]
    keys = ", ".join(f"{c} {frames.schema[c].dataType.simpleString()}" for c in ("stack_id", "frame"))
    return frames.select("stack_id", "frame", *shift, "px").mapInArrow(run, f"{keys}, px array<double>")


def phase_shift(frames: DataFrame, ny: int, nx: int) -> DataFrame:
    """frames(stack_id, frame, ty, tx, px) moved by (ty, tx) pixels, wrapped around, by a phase ramp on their transform."""
    ky, kx = np.fft.fftfreq(ny)[:, None], np.fft.fftfreq(nx)[None, :]
    return _moved(frames, ny, nx, lambda px, ty, tx: np.fft.ifft2(np.fft.fft2(px) * np.exp(-2j * np.pi * (ky * ty + kx * tx))).real)


def lanczos_shift(frames: DataFrame, ny: int, nx: int, taps: int = 3, lobes: int | None = None) -> DataFrame:
    """frames(stack_id, frame, ty, tx, px) moved by less than a pixel with a separable Lanczos kernel of so many taps
    (odd) that sum to 1. The window's first zero is at half the taps, and the kernel has ``lobes`` zeros up to there,
    (taps + 1) / 2 unless given. Beyond its edges a frame is mirrored."""
    half, lobes = taps // 2, lobes or (taps + 1) // 2

    def along(px: np.ndarray, shift: np.ndarray, axis: int) -> np.ndarray:
        u = (np.arange(-half, half + 1) - shift) * 2.0 / taps  # (n, 1, taps)
        w = np.sinc(lobes * u) * np.sinc(u)
        w /= w.sum(axis=2, keepdims=True)
        n = px.shape[axis]
        wide = np.pad(px, [(half, half) if a == axis else (0, 0) for a in range(3)], mode="symmetric")
        return sum(w[:, :, k + half, None] * np.take(wide, np.arange(half - k, half - k + n), axis=axis) for k in range(-half, half + 1))

    return _moved(frames, ny, nx, lambda px, ty, tx: along(along(px, ty, 1), tx, 2))
