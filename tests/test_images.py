"""Image files, logs, drift stacks and a stream."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackweave.operators import align, fourier, frames, lookup, solve, stats
from stackweave.sources import mrc, tables
from stackweave.streaming import quiet


def test_mrc_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    images = rng.normal(size=(5, 6, 4)).astype(np.float32)
    rows = [("s", k, [float(v) for v in z.ravel()]) for k, z in enumerate(images)]
    written = mrc.write_mrc(spark.createDataFrame(rows, "stack_id string, frame int, px array<float>"), str(tmp_path / "out"), 6, 4, 1.5).collect()
    assert len(written) == 5
    got = mrc.read_mrc(spark, str(tmp_path / "out")).orderBy("path").collect()
    assert [(r.ny, r.nx, r.pixelsize, r.frame) for r in got] == [(6, 4, 1.5, 0)] * 5
    assert all(np.array_equal(np.float32(r.px), z.ravel()) for r, z in zip(got, images))


def test_mrc_stacks_of_other_kinds(spark, tmp_path):
    data = np.arange(7 * 3 * 2, dtype=np.int16).reshape(7, 3, 2) - 20
    for order in "<>":
        raw = bytearray(1024)
        struct.pack_into(order + "4i", raw, 0, 2, 3, 7, 1)
        struct.pack_into(order + "i", raw, 92, 80)
        (tmp_path / f"{'little' if order == '<' else 'big'}.mrcs").write_bytes(bytes(raw) + b"\0" * 80 + data.astype(order + "i2").tobytes())
    got = mrc.read_mrc(spark, str(tmp_path), range_bytes=24).collect()  # two frames at once
    for name in ("little", "big"):
        mine = sorted((r for r in got if name in r.path), key=lambda r: r.frame)
        assert [r.frame for r in mine] == list(range(7)) and {r.pixelsize for r in mine} == {0.0}
        assert np.array_equal(np.array([r.px for r in mine]).reshape(7, 3, 2), data)
    gain = spark.createDataFrame([([2.0] * 6,)], "px array<double>")
    assert {tuple(r.px) for r in mrc.apply_gain(mrc.read_mrc(spark, str(tmp_path)).filter("frame = 0"), gain, 4.0).collect()} == {tuple(data[0].ravel() / 2.0)}
    (tmp_path / "short.mrc").write_bytes(bytes(raw)[:1024])
    with pytest.raises(Exception, match="short.mrc"):
        mrc.read_mrc(spark, str(tmp_path / "short.mrc")).collect()


def test_drift_of_a_noisy_stack_is_found_to_a_part_of_a_pixel(spark):
    """Ten frames of 256 x 272 pixels: one Gaussian spot under noise that drifts by parts of pixels."""
    rng = np.random.default_rng(44)
    drift = np.cumsum(rng.normal(0, 2, (10, 2)), axis=0)
    drift -= drift[0]
    y, x = np.mgrid[0:256, 0:272]
    images = [5 * np.exp(-(((y - 128 - d[0]) / 10) ** 2) - ((x - 136 - d[1]) / 12) ** 2) + rng.normal(0, 0.1, (256, 272)) for d in drift]
    stack = spark.createDataFrame([("a", k, z.ravel().tolist()) for k, z in enumerate(images)], "stack_id string, frame int, px array<double>")
    pairs = fourier.pair_shifts(frames.frame_pairs(stack, 5), 256, 272, sub=8, low_pass=3.0)
    solved = {r.frame: (r.ty, r.tx) for r in solve.solve_shifts(pairs, "peaksig").collect()}
    found = -np.array([solved[k] for k in range(10)])  # what moves a frame back
    assert min(np.abs(found - drift).mean(), np.abs(found + drift).mean()) < 0.25


def test_frames_are_numbered_without_ties(spark):
    table = spark.createDataFrame([(s, 10 - k, [float(k)]) for s in range(3) for k in range(5)], "label int, vec_id int, px array<double>")
    got = sorted((r.stack_id, r.frame, r.px[0]) for r in frames.as_frames(table, "label", "vec_id", "px").collect())
    assert got == [(s, f, float(4 - f)) for s in range(3) for f in range(5)]


def test_lookup_keeps_repeated_rows(spark):
    left = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (9, "c"), (None, "d")], "k int, name string")
    right = spark.createDataFrame([(1, "one"), (8, "eight"), (2, None)], "found int, value string")
    got = sorted(map(str, lookup.lookup(left, right, "found", F.col("k"), F.col("k") - 1).collect()))
    assert got == sorted(["Row(k=1, name='a', found=1, value='one')"] * 2 + ["Row(k=2, name='b', found=2, value=None)", "Row(k=9, name='c', found=8, value='eight')"])


def test_logs_of_several_programs(spark, tmp_path):
    (tmp_path / "drift.log").write_text("Frame 9 shift: 9.0 9.0\nSum Frame #000 - #001\nFrame (000) : 1.50 -2.0\nFrame (001) : +3.50 4.0\nEnd 7.0 7.0\n")
    got = tables.read_drift_logs(spark, str(tmp_path / "drift.log")).orderBy("frame").collect()
    assert [(r.ty, r.tx) for r in got] == [(3.0, 1.0), (-3.0, -1.0)]
    cycle = ["LAST CYCLE", "", "Defocus_U Defocus_V Angle CCC", " 22086.5 21182.8 26.7 0.055 Final Values", "", "Resolution limit estimated by EPA: RES_LIMIT 3.9", "Estimated Bfactor: BFACTOR 77.5", "", "VALIDATION_SCORE", "bands dU dV dA dC score", "20-8A 1.0 2.0 3.0 0.1 VALIDATION: 5", "15-6A 4.0 x 6.0 0.2 VALIDATION: 4", ""]
    (tmp_path / "gctf.log").write_text("\n".join(["first cycle", *cycle]))
    (tmp_path / "none.log").write_text("nothing\n")
    r = tables.read_validated_ctf_logs(spark, [str(tmp_path / "gctf.log"), str(tmp_path / "none.log")]).collect()
    assert len(r) == 1 and (r[0].defocus_u, r[0].angle, r[0].fom, r[0].final_resolution, r[0].bfactor) == (22086.5, 26.7, 0.055, 3.9, 77.5)
    assert [(v.band, v["values"], v.score) for v in r[0].validation] == [("20-8A", [1.0, 2.0, 3.0, 0.1], 5.0), ("15-6A", [4.0, None, 6.0, 0.2], 4.0)]
    (tmp_path / "shifts.txt").write_text("# x y\n 1.0  2.0\nword 3\n\n4 5 6\n")
    assert [r["values"] for r in tables.read_shift_tables(spark, str(tmp_path / "shifts.txt")).orderBy("line").collect()] == [[1.0, 2.0], [4.0, 5.0, 6.0]]


def test_particles_meet_their_defocus(spark, tmp_path):
    record = spark.createDataFrame([("/d/mic1.log", 1.0, 2.0, 3.0, 0.5, 2.7, 300.0, 0.07, 1e5, 5.0), ("mic3.log", 9.0, 9.0, 9.0, 0.1, 2.7, 300.0, 0.07, 1e5, 5.0)], "micrograph string, defocus_u double, defocus_v double, angle double, fom double, spherical_aberration double, voltage double, amplitude_contrast double, magnification double, detector_pixel_size double")
    particles = spark.createDataFrame([("a/mic1.mrc", 1), ("b/mic1_filt.mrc", 2), ("mic2.mrc", 3), ("a/mic1.mrc", 1)], "micrograph_name string, n int")
    got = sorted((r.n, r.defocus_u) for r in tables.merged_particles(particles, record).collect())
    assert got == [(1, 1.0), (1, 1.0), (2, 1.0)]
    tables.ctf_lines(record).coalesce(1).write.text(str(tmp_path / "ctf"))
    assert sorted(r.defocus_u for r in tables.read_ctf_logs(spark, str(tmp_path / "ctf")).collect()) == [1.0, 9.0]


def test_quiet_files_on_a_stream(spark, tmp_path):
    """Sessions are emitted once the watermark has passed them; a late observation changes nothing."""
    def put(name, rows):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{name}.json").write_text("\n".join(json.dumps({"path": p, "at": t}) for p, t in rows))

    def drain():
        source = spark.readStream.schema("path string, at timestamp").json(str(tmp_path / "in"))
        out = quiet.quiet_sessions(source, "path", "at", "5 seconds", late="2 seconds")
        run = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination(120)
        return sorted((r.path, r.n, (r.stable_at - r.began).total_seconds()) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    put("one", [("a", "2026-01-01T00:00:00"), ("a", "2026-01-01T00:00:04"), ("b", "2026-01-01T00:00:02"), ("b", "2026-01-01T00:00:03")])
    assert drain() == []
    put("two", [("c", "2026-01-01T00:01:00")])
    drain()
    put("three", [("c", "2026-01-01T00:02:00"), ("a", "2026-01-01T00:00:01")])  # the second is too late
    assert drain()[:2] == [("a", 2, 9.0), ("b", 2, 6.0)]


def test_tiles_and_windows_match_numpy(spark):
    rng = np.random.default_rng(3)
    images = rng.normal(size=(2, 16, 16)) + 3
    halves = spark.createDataFrame([("a", k, z.ravel().tolist()) for k, z in enumerate(images)], "stack_id string, half int, px array<double>")
    got = {r.k: r.frc for r in align.tiled_ring_correlation(halves, 8, 4, 16, 16).collect()}
    y, x = np.mgrid[-4:4, -4:4] / 4.0
    r = np.hypot(y, x)
    w = np.where(r <= 1, 0.5 * (1 + np.cos(np.pi * r)), 0)
    mean = np.zeros((8, 8))
    for ty in range(3):
        for tx in range(3):
            e, o = (np.fft.fft2(z[4 * ty : 4 * ty + 8, 4 * tx : 4 * tx + 8] * w) for z in images)
            mean += (e * o.conj()).real / (np.abs(e) * np.abs(o))
    mean = np.fft.fftshift(mean / mean[0, 0])
    radius = np.hypot(*(np.mgrid[0:8, 0:8] - 4))
    low = np.floor(radius).astype(int)
    v, n = np.zeros(9), np.zeros(9)
    for share, at in ((1 - radius + low, low), (radius - low, low + 1)):
        np.add.at(v, at, share * mean)
        np.add.at(n, at, share)
    for k, value in got.items():
        assert value == pytest.approx(v[k] / n[k], abs=1e-9)
    assert stats.step_histogram(spark.createDataFrame([("a", 1.0)], "g string, v double"), "v", 1.0, ["g"]).count() == 0


def test_frames_are_numbered_whatever_ties(spark):
    from stackweave.operators import frames

    rows = [("a", 1, [1.0]), ("a", 1, [2.0]), ("a", 1, [2.0]), ("a", 2, [3.0]), ("b", 5, [4.0]), ("b", None, [5.0]), (None, 1, [6.0])]
    got = frames.as_frames(spark.createDataFrame(rows, "s string, o int, px array<double>"), "s", "o", "px").collect()
    assert sorted((r.stack_id, r.frame) for r in got) == [("a", 0), ("a", 1), ("a", 2), ("a", 3), ("b", 0)]
    assert sorted(r.px[0] for r in got) == [1.0, 2.0, 2.0, 3.0, 4.0] and next(r.px for r in got if r.frame == 3) == [3.0]


def test_tiles_reach_the_last_rows(spark):
    from stackweave.operators import frames

    pixels = spark.createDataFrame([("s", 0, y, x, float(y * 8 + x)) for y in range(8) for x in range(8)], "stack_id string, frame int, y int, x int, v double")
    cut = frames.tiles(pixels, 4, 2, 8, 8).collect()
    assert {(r.tile_y, r.tile_x) for r in cut} == {(a, b) for a in range(3) for b in range(3)} and len(cut) == 9 * 16
    assert {r.v for r in cut} == {float(k) for k in range(64)}
