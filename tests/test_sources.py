from pyspark.sql import functions as F

from stackweave.operators import align, local
from stackweave.sources import tables


def test_star_files_of_different_columns(spark, tmp_path):
    head = tables.star_header(["rlnX", "rlnY"])
    (tmp_path / "a.star").write_text(head + "\n1.5\t2\n3\t4\n\n")
    (tmp_path / "b.star").write_text("data_\nloop_\n_rlnY\n  7   8\n")
    (tmp_path / "empty.star").write_text("")
    got = tables.read_star(spark, str(tmp_path)).select(F.col("fields.rlnX").alias("x"), F.col("fields.rlnY").alias("y"))
    assert sorted((r.x or "", r.y) for r in got.collect()) == [("", "7"), ("1.5", "2"), ("3", "4")]
    back = tables.star_lines(got.filter("x = '3'").withColumn("z", F.lit(None).cast("string")), ["x", "z", "y"])
    assert [r.value for r in back.collect()] == ["3\t\t4"]


def test_boxes(spark, tmp_path):
    (tmp_path / "m.box").write_text("1 2 10 10\n-1 0 10 10 0.5\nnot a box\n95 0 10 10 0.7\n")
    boxes = tables.read_boxes(spark, str(tmp_path))
    assert boxes.count() == 3
    assert [(r.centre_x, r.centre_y, r.fom) for r in tables.inside(boxes, 100, 100).collect()] == [(6.0, 7.0, None)]


def test_logs(spark, tmp_path):
    (tmp_path / "ctf.log").write_text("head\nCS HT AmpCnst\n12000.5 11800.25 45.0 0.17 Final Values\n")
    (tmp_path / "bad.log").write_text("nothing here\n")
    got = tables.read_ctf_logs(spark, [str(tmp_path / "ctf.log"), str(tmp_path / "bad.log")]).collect()
    assert [(r.defocus_u, r.defocus_v, r.angle, r.fom) for r in got] == [(12000.5, 11800.25, 45.0, 0.17)]
    (tmp_path / "drift.log").write_text("Frame 0 shift: 1.0 2.0\nnoise\nFrame 1 shift: 3.0 -2.0\n")
    drift = tables.read_drift_logs(spark, str(tmp_path / "drift.log")).orderBy("frame").collect()
    assert [(r.frame, r.ty, r.tx) for r in drift] == [(0, -2.0, 1.0), (1, 2.0, -1.0)]


def test_flat_and_identical_frames(spark):
    import numpy as np

    px = [float(k % 7) for k in range(64)]
    frames = spark.createDataFrame([(0, 0, [1.0] * 64), (0, 1, px)], "stack_id int, frame int, px array<double>")
    flat = {r.frame: r.px for r in local.normalised(frames).collect()}
    assert set(flat[0]) == {None} and min(flat[1]) == 0.0 and max(flat[1]) == 1.0
    still = {r.frame: r.px for r in local.resample(frames, 0.0, 0.0, 8, 8).collect()}
    assert still[1] == px
    pairs = spark.createDataFrame([(0, 0, 1, px, px), (0, 0, 2, [1.0] * 64, px)], "stack_id int, i int, j int, px_i array<double>, px_j array<double>")
    got = {r.j: (r.dy, r.dx, round(r.corr, 6)) for r in align.masked_shifts(pairs, np.ones((8, 8)), 0).collect()}
    assert got == {1: (0, 0, 1.0), 2: (0, 0, 0.0)}
    halves = spark.createDataFrame([(0, 0, px), (0, 1, px)], "stack_id int, half int, px array<double>")
    assert all(r.frc is None or abs(r.frc - 1) < 1e-9 for r in align.ring_correlation(halves, 8, 8).collect())
