"""Block operators against numpy, and against the same sums over pixel rows."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stackweave.operators import align, blocks, frames

SCHEMA = "stack_id string, frame int, px array<float>"


def table(spark, rows, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts, "frame")


@pytest.mark.parametrize("parts", [1, 5])
def test_projections_equal_those_of_pixel_rows(spark, parts):
    rng = np.random.default_rng(1)
    rows = [(s, k, rng.normal(size=30).astype(np.float32).tolist()) for s, n in (("a", 9), ("b", 1), ("c", 2)) for k in range(n)]
    rows += [("d", 0, [1.0, None, 3.0, None]), ("d", 1, [2.0, 5.0, None, None]), ("d", 2, [4.0]), ("d", 3, None), ("e", 0, []), (None, 0, [1.0, 2.0]), (None, 1, [3.0, 2.0])]
    df = table(spark, rows, parts)
    columns = ["stack_id", "y", "x", "total", "most", "variance", "even", "odd"]
    key = lambda r: (r.stack_id or "", r.y, r.x)
    got = sorted(blocks.projections(df, 6).select(columns).collect(), key=key)
    want = sorted(frames.project(frames.as_pixels(df, 6)).filter("total is not null").select(columns).collect(), key=key)
    assert [key(r) for r in got] == [key(r) for r in want] and len(got) == 95
    for a, b in zip(got, want):
        assert a[3:5] == pytest.approx(b[3:5]) and a.variance == pytest.approx(b.variance, abs=1e-9) and a.even + a.odd == pytest.approx(a.total)
        assert a.even == pytest.approx(b.even or 0.0, abs=1e-6)


def test_states_that_leave_early_and_many_bands_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(2)
    data = {s: rng.normal(size=(7, 50)) for s in ("a", "b", "c")}
    batches = [pa.RecordBatch.from_pylist([{"stack_id": {"s": s, "half": 0}, "frame": k, "px": data[s][k].tolist()} for s in data], pa.schema([("stack_id", pa.struct([("s", pa.string()), ("half", pa.int32())])), ("frame", pa.int64()), ("px", pa.list_(pa.float64()))])) for k in range(7)]
    for band, held in ((7, 0), (7, 3000), (50, 1 << 20)):
        monkeypatch.setattr(blocks, "BAND", band)
        monkeypatch.setattr(blocks, "HELD", held)
        parts = list(blocks.partial_states(iter(batches), blocks.MOMENTS))
        rows = pa.Table.from_batches(parts).to_pylist()
        rows.sort(key=lambda r: (r["stack_id"]["s"], r["band"]))
        again = [pa.RecordBatch.from_pylist(rows[k : k + 4], parts[0].schema) for k in range(0, len(rows), 4)]
        done = pa.Table.from_batches(list(blocks.joined_states(iter(again), blocks.MOMENTS))).to_pylist()
        for s, x in data.items():
            mine = sorted((r for r in done if r["stack_id"]["s"] == s), key=lambda r: r["band"])
            assert [r["band"] for r in mine] == list(range(-(-50 // band)))
            of = lambda c: np.concatenate([r[c] for r in mine])
            assert of("total") == pytest.approx(x.sum(axis=0)) and of("most") == pytest.approx(x.max(axis=0))
            assert of("m2") / of("n") == pytest.approx(x.var(axis=0)) and of("even") == pytest.approx(x[::2].sum(axis=0))


def test_a_task_holds_a_state_and_a_batch(monkeypatch):
    monkeypatch.setattr(blocks, "HELD", 8 << 20)
    n, size = 40, 512 * 512
    made = (pa.RecordBatch.from_arrays([pa.array([k % 10]), pa.array([k]), pa.FixedSizeListArray.from_arrays(pa.array(np.full(size, float(k))), size).cast(pa.list_(pa.float64()))], names=["stack_id", "frame", "px"]) for k in range(n))
    tracemalloc.start()
    total = 0.0
    for b in blocks.partial_states(made, blocks.SUMS):
        total += sum(np.nansum(b.column(c).flatten().to_numpy(zero_copy_only=False)) for c in ("px", "total"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == sum(range(n)) * size
    assert peak < 48 << 20  # all frames are 80 MB


def test_frames_of_two_thousand_pixels_a_side(spark):
    n = 2048
    pixel = F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), lambda i: ((i * 7 + F.col("id") * 13) % 101).cast("float"))
    df = spark.range(8, numPartitions=4).select(F.lit("a").alias("stack_id"), F.col("id").cast("int").alias("frame"), pixel.alias("px"))
    each = (np.arange(n * n)[None] * 7 + np.arange(8)[:, None] * 13) % 101
    total = blocks.stack_sums(df).select(F.size("total").alias("n"), F.aggregate("total", F.lit(0.0), lambda s, v: s + v).alias("s"), F.slice("total", n * n - 4, 5).alias("last")).first()
    assert total.n == n * n and total.s == each.sum() and total.last == each.sum(axis=0)[-5:].tolist()
    got = {(r.frame, r.radius): r.mean for r in blocks.radial_means(df.filter("frame < 2"), n, n).filter("radius in (0, 100)").collect()}
    y, x = np.mgrid[0:n, 0:n]
    w = np.maximum(0.0, 1.0 - np.abs(np.hypot(y - n // 2, x - n // 2) - 100)).ravel()
    assert got[1, 100] == pytest.approx((each[1] * w).sum() / w.sum())
    assert got[0, 0] == each[0].reshape(n, n)[n // 2, n // 2]


def test_radial_means_equal_those_of_pixel_rows(spark):
    rng = np.random.default_rng(3)
    df = table(spark, [("a", k, rng.normal(size=35).tolist()) for k in range(4)] + [(None, 0, [1.0] * 35), ("b", 0, None)])
    key = lambda r: (r.stack_id or "", r.frame, r.radius)
    got, want = (sorted(f.collect(), key=key) for f in (blocks.radial_means(df, 5, 7), frames.radial_mean(frames.as_pixels(df, 7), 5, 7)))
    assert [key(r) for r in got] == [key(r) for r in want]
    assert [r.mean for r in got] == pytest.approx([r.mean for r in want])
    holes = table(spark, [("a", 0, [None] * 34 + [2.0])])
    assert {r.mean for r in blocks.radial_means(holes, 5, 7).collect()} == {None, 2.0}
    with pytest.raises(Exception, match="a frame has 3 pixels, not 35"):
        blocks.radial_means(table(spark, [("a", 0, [1.0, 2.0, 3.0])]), 5, 7).collect()


def plain_rings(a, b, box, tops, lefts):
    tiles = []
    for top in tops:
        for left in lefts:
            w = np.array([[max(0.0, 0.5 * (1 + np.cos(np.pi * np.hypot((y - box // 2) / (box / 2), (x - box // 2) / (box / 2))))) if np.hypot((y - box // 2) / (box / 2), (x - box // 2) / (box / 2)) <= 1 else 0.0 for x in range(box)] for y in range(box)])
            za, zb = (np.fft.fft2(p[top : top + box, left : left + box] * w) for p in (a, b))
            tiles.append(np.cos(np.angle(za) - np.angle(zb)))
    mean = np.fft.fftshift(np.mean(tiles, axis=0))
    mean /= mean[box // 2, box // 2]
    out = {}
    for y in range(box):
        for x in range(box):
            r = np.hypot(y - box // 2, x - box // 2)
            for k, share in ((int(r), 1 - (r - int(r))), (int(r) + 1, r - int(r))):
                if share > 0:
                    out.setdefault(k, []).append((share, mean[y, x]))
    return {k: sum(s * v for s, v in at) / sum(s for s, _ in at) for k, at in out.items()}


def test_ring_correlations(spark):
    rng = np.random.default_rng(4)
    still = rng.normal(size=(20, 18)) + 1
    a, b = (still + 0.5 * rng.normal(size=still.shape) for _ in range(2))
    rows = [("a", 0, a.ravel().tolist()), ("a", 1, b.ravel().tolist()), ("same", 0, a.ravel().tolist()), ("same", 1, a.ravel().tolist()), ("one", 0, a.ravel().tolist()), ("flat", 0, [0.0] * 360), ("flat", 1, [0.0] * 360)]
    halves = spark.createDataFrame(rows, "stack_id string, half int, px array<double>")
    by = lambda df: {s: {r.k: r.frc for r in got} for s in ("a", "same", "one", "flat") for got in [[r for r in df if r.stack_id == s]]}
    tiled = by(align.tiled_ring_correlation(halves, 8, 4, 20, 18, 2).collect())
    want = plain_rings(a, b, 8, [2, 6, 10], [2, 6])
    assert set(tiled["a"]) == set(want) and all(tiled["a"][k] == pytest.approx(want[k]) for k in want)
    centre = by(align.local_ring_correlation(halves, 8, 20, 18).collect())
    want = plain_rings(a, b, 8, [6], [5])
    assert all(centre["a"][k] == pytest.approx(want[k]) for k in want)
    whole = by(align.ring_correlation(halves, 20, 18).collect())
    for got in (tiled, centre, whole):
        assert list(got["same"].values()) == pytest.approx([1.0] * len(got["same"])) and set(got["one"].values()) == set(got["flat"].values()) == {None}
    za, zb = np.fft.fft2(a), np.fft.fft2(b)
    r = np.rint(np.hypot(np.abs(np.fft.fftfreq(20, 1 / 20))[:, None], np.abs(np.fft.fftfreq(18, 1 / 18))[None, :]))
    for k in (0, 3, 9):
        at = r == k
        assert whole["a"][k] == pytest.approx((za * zb.conj()).real[at].sum() / np.sqrt((np.abs(za[at]) ** 2).sum() * (np.abs(zb[at]) ** 2).sum()))


def test_empty_tables(spark):
    none, halves = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "stack_id string, half int, px array<double>")
    for df in (blocks.stack_sums(none), blocks.projections(none, 4), blocks.radial_means(none, 4, 4), align.ring_correlation(halves, 4, 4), align.tiled_ring_correlation(halves, 2, 1, 4, 4), align.tiled_ring_correlation(halves, 8, 1, 4, 4)):
        assert df.isEmpty()
