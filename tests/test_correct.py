import numpy as np
import pytest
from pyspark.sql import functions as F

from stackweave.operators import detector, fourier, solve


def frames_of(spark, images):
    return spark.createDataFrame([("a", k, [float(v) for v in z.ravel()]) for k, z in enumerate(images)], "stack_id string, frame int, px array<double>")


def test_solved_shifts_follow_the_planted_drift_past_wrong_pairs(spark):
    rng = np.random.default_rng(5)
    t = np.cumsum(rng.normal(0, 2, (40, 2)), axis=0)
    t -= t[0]
    rows = [("a", i, j, *(float(x) for x in t[j] - t[i]), 1.0) for i in range(40) for j in range(i + 1, min(i + 6, 40))]
    wrong = {k: ("a", *rows[k][1:3], 30.0, -30.0, 1.0) for k in range(7, len(rows), 23)}
    rows = [wrong.get(k, r) for k, r in enumerate(rows)] + [("a", 3, 4, None, 1.0, 1.0), ("a", 3, 4, 50.0, 50.0, 0.0)]
    edges = spark.createDataFrame(rows, "stack_id string, i int, j int, dy double, dx double, w double")
    for segment in (256, 16):
        got = {r.frame: (r.ty, r.tx) for r in solve.solve_shifts(edges, "w", segment).collect()}
        assert sorted(got) == list(range(40))
        assert np.abs(np.array([got[k] for k in range(40)]) - t).max() < 0.01
    errors = solve.pair_errors(edges.filter("w > 0 and dy is not null"), solve.solve_shifts(edges, "w"))
    assert errors.filter("error > 1").count() == len(wrong)
    assert solve.solve_shifts(edges.limit(0)).count() == 0


def test_segments_give_the_shifts_of_the_whole(spark):
    rng = np.random.default_rng(6)
    t = np.cumsum(rng.normal(0.5, 2, (60, 2)), axis=0)
    blank = {30, 31, 32, 33, 34, 48}  # around one boundary of 16 frames, and at another
    rows = [("a", i, j, *(float(x) for x in t[j] - t[i] + rng.normal(0, 0.1, 2)), 0.0 if {i, j} & blank else 1.0) for i in range(60) for j in range(i + 1, min(i + 4, 60))]
    edges = spark.createDataFrame(rows, "stack_id string, i int, j int, dy double, dx double, w double")
    whole, parts = ({r.frame: (r.ty, r.tx) for r in solve.solve_shifts(edges, "w", s).collect()} for s in (256, 16))
    assert sorted(whole) == sorted(parts) == list(range(60))
    assert np.abs(np.array([whole[k] for k in range(60)]) - np.array([parts[k] for k in range(60)])).max() < 0.2


def test_moves(spark):
    rng = np.random.default_rng(1)
    images = rng.normal(size=(2, 8, 8))
    df = frames_of(spark, images).withColumns({"ty": F.lit(2.0), "tx": F.when(F.col("frame") == 0, -1.0)})
    got = {r.frame: np.array(r.px).reshape(8, 8) for r in fourier.phase_shift(df, 8, 8).collect()}
    assert np.allclose(got[0], np.roll(images[0], (2, -1), (0, 1))) and np.allclose(got[1], np.roll(images[1], 2, 0))
    still = df.withColumns({"ty": F.lit(0.0), "tx": F.lit(None).cast("double")})
    flat = frames_of(spark, np.full((1, 8, 8), 3.0)).withColumns({"ty": F.lit(0.3), "tx": F.lit(-0.2)})
    assert np.allclose(fourier.lanczos_shift(flat, 8, 8, taps=5, lobes=3).first().px, 3.0)
    assert {r.frame: len(r.px) for r in fourier.lanczos_shift(still, 8, 8).collect()} == {0: 64, 1: 64}


def test_hot_pixel_goes(spark):
    images = np.random.default_rng(2).poisson(10, (4, 8, 8)).astype(float)
    images[:, 3, 5] += 500
    frames = frames_of(spark, images)
    pixels = frames.select("stack_id", "frame", F.posexplode("px").alias("pos", "v")).select("stack_id", "frame", F.expr("pos div 8").alias("y"), (F.col("pos") % 8).alias("x"), "v")
    out = np.array([r.px for r in detector.hot_pixels(frames, detector.outlier_weights(frames, 4.0, 20.0), 8, 8).orderBy("frame").collect()]).reshape(4, 8, 8)
    assert out[:, 3, 5].max() < 25 and np.allclose(np.delete(out.reshape(4, -1), 29, 1), np.delete(images.reshape(4, -1), 29, 1))


def test_gain_orientation_is_found(spark):
    gain = np.random.default_rng(3).uniform(0.5, 2, (4, 4))
    for way, turn in (("rot90", np.rot90(gain)), ("rot270", np.rot90(gain, 3)), ("rot180", np.rot90(gain, 2)), ("flip_x", gain[:, ::-1]), ("flip_y", gain[::-1]), ("none", gain)):
        sums = spark.createDataFrame([("a", y, x, float(1 / turn[y, x])) for y in range(4) for x in range(4)], "stack_id string, y int, x int, v double")
        table = spark.createDataFrame([(y, x, float(gain[y, x])) for y in range(4) for x in range(4)], "y int, x int, g double")
        best = [r for r in detector.gain_orientations(sums, table, 4).collect() if r.best]
        assert [r.deviation for r in best] == [pytest.approx(0, abs=1e-12)] and best[0].way == way


def test_boxes_are_cut_inside_frames(spark):
    images = np.arange(128.0).reshape(2, 8, 8)
    images[1] = 7.0
    boxes = spark.createDataFrame([("a", 0, 1, 2), ("a", 0, 5, 0), ("a", 1, 0, 0), ("a", 9, 0, 0), ("a", 0, None, 1)], "stack_id string, frame int, top int, left int")
    got = {r.frame: r for r in detector.cut_boxes(boxes, frames_of(spark, images), 4, 8, 8, 9.0).collect()}
    part = images[0, 1:5, 2:6].ravel()
    assert sorted(got) == [0, 1] and np.allclose(got[0].px, (part - part.mean()) / part.std())
    assert got[1].px == [None] * 16
