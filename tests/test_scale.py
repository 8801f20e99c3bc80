"""Long stacks: places of pairs beyond the columns, solves, splines and curves of many frames."""

import time

import numpy as np
import pyarrow as pa
import pytest

from stackweave.operators import blocks, fourier, frames, global_fits, halves, smooth, solve


def test_pairs_of_stacks_longer_than_the_columns_come_back(spark):
    n = 16
    rows = [("s", i, j) for i in range(50) for j in range(i + 1, min(i + n + 2, 50))]
    edges = spark.createDataFrame(rows, "stack_id string, i int, j int")
    got = frames.unravel(frames.ravel(edges, n).select("stack_id", "pos"), n, ahead=True).collect()
    assert sorted((r.stack_id, r.i, r.j) for r in got) == rows
    assert all(r.pos == r.i * n + r.j for r in got)
    few = edges.filter(f"j < {n}")
    assert sorted(map(tuple, frames.unravel(frames.ravel(few, n), n).collect())) == sorted(map(tuple, frames.ravel(few, n).collect()))


def dense_rounds(n, i, j, shift, weight, rounds):
    """The solver's rounds on full matrices; every step is spanned by a pair."""
    w, mean = weight, weight.mean()
    for _ in range(rounds):
        a, b = np.zeros((n, n)), np.zeros(n)
        for p, q, s, v in (*zip(i, j, shift, w), *((k, k + 1, 0.0, solve.TIE * mean) for k in range(n - 1))):
            a[[p, q], [p, q]] += v
            a[[p, q], [q, p]] -= v
            b[[q, p]] += [v * s, -v * s]
        a[0, 0] += mean
        t = np.linalg.solve(a, b)
        t -= t[0]
        w = solve.reweighted(weight, t, i, j, shift)
    return t


def test_blocks_of_frames_give_the_dense_solution():
    rng = np.random.default_rng(1)
    for n, width in ((2, 1), (5, 4), (47, 5), (120, 7)):
        ends = np.array([(i, j) for i in range(n) for j in range(i + 1, min(i + width + 1, n)) if j == i + 1 or rng.random() < 0.8])
        i, j = np.repeat(ends, 2, axis=0).T  # a pair may come twice
        shift, weight = rng.normal(0, 5, len(i)), rng.uniform(0.5, 2, len(i))
        assert np.allclose(solve.whole(n, i, j, shift, weight, 5), dense_rounds(n, i, j, shift, weight, 5), atol=1e-7)


def test_a_long_stack_is_solved_in_linear_time_without_jobs_a_round(spark):
    n, width = 20_000, 5
    rng = np.random.default_rng(2)
    t = np.cumsum(rng.integers(-3, 4, (n, 2)), axis=0)
    t -= t[0]
    i = np.repeat(np.arange(n), width)
    j = i + np.tile(np.arange(1, width + 1), n)
    i, j = i[j < n], j[j < n]
    d = (t[j] - t[i]).astype(float)
    wrong = (rng.random(len(i)) < 0.05) & (j - i > 1)
    d[wrong] += 30
    edges = spark.createDataFrame(list(zip(["s"] * len(i), i.tolist(), j.tolist(), d[:, 0].tolist(), d[:, 1].tolist())), "stack_id string, i int, j int, dy double, dx double")
    spark.sparkContext.setJobGroup("long-stack", "")
    got = solve.solve_shifts(edges).collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("long-stack"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    found = np.zeros((n, 2))
    for r in got:
        found[r.frame] = r.ty, r.tx
    assert len(got) == n and np.abs(found - t).max() < 0.05 and 0 < jobs < 20


def test_halves_of_a_long_stack_take_few_jobs(spark):
    rng = np.random.default_rng(3)
    still = rng.normal(size=(8, 8))
    rows = [("s", k, np.roll(still, (k // 2 % 3, 0), axis=(0, 1)).ravel().tolist()) for k in range(1100)]
    df = spark.createDataFrame(rows, "stack_id string, frame int, px array<double>")
    spark.sparkContext.setJobGroup("long-halves", "")
    got = {r.half: np.array(r.px) for r in halves.independent_halves(df, 8, 8, 2).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("long-halves"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert set(got) == {0, 1} and np.allclose(got[0], got[1], atol=1e-6) and np.allclose(got[0], 550 * still.ravel(), atol=1)
    assert 0 < jobs < 60


def test_banded_systems_equal_dense_ones_and_long_trajectories_take_seconds():
    rng = np.random.default_rng(4)
    for m in (1, 2, 3, 4, 7, 50):
        low = np.tril(np.triu(rng.normal(size=(m, m)), -3)) + 4 * np.eye(m)
        full, right = low @ low.T, rng.normal(size=m)
        bands = np.array([np.pad(np.diag(full, d), (0, m - max(m - d, 0))) if d < m else np.zeros(m) for d in range(4)])
        assert np.allclose(smooth.solve_banded(bands, right), np.linalg.solve(full, right))
    x = np.arange(30_000.0)
    y = np.sin(x / 300) + rng.normal(0, 0.1, len(x))
    began = time.time()
    got = smooth.smoothed(x, y, 250.0)
    assert time.time() - began < 30 and np.isclose(((y - got) ** 2).sum(), 250.0, rtol=1e-6)
    assert np.abs(got - np.sin(x / 300))[100:-100].mean() < np.abs(y - np.sin(x / 300)).mean() / 2


def lean_line(x, p):
    with open("/proc/self/statm") as f:
        held = int(f.read().split()[1]) * 4096
    if held > 500e6:
        raise MemoryError(f"{held} bytes for one line")
    return p[0] + p[1] * x


def test_long_curves_are_held_one_at_a_time_as_arrays(spark):
    curves = spark.range(600_000).selectExpr("'s' as stack_id", "id / 6e5 as x", "1 + 2 * (id / 6e5) as y")
    bounds = spark.createDataFrame([("s", [0.0, 0.0], [3.0, 3.0])], "stack_id string, low array<double>, high array<double>")
    got = global_fits.multi_start(curves, lean_line, bounds, 3).collect()
    assert [r.starts for r in got] == [9] and np.allclose(got[0].p, [1, 2], atol=1e-3)


def test_rejection_in_a_long_stack_takes_few_jobs(spark):
    n, wrong = 1300, {(100, 103), (700, 704), (1200, 1202)}
    rows = [("s", i, j, float(j - i) + 30 * ((i, j) in wrong), 0.0) for i in range(n) for j in range(i + 1, min(i + 6, n))]
    edges = spark.createDataFrame(rows, "stack_id string, i int, j int, dy double, dx double")
    spark.sparkContext.setJobGroup("long-rejection", "")
    kept = solve.solve_rejecting(edges, times=1, factor=1.5)[1].collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("long-rejection"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {(r.i, r.j) for r in kept} == {r[1:3] for r in rows} - wrong and 0 < jobs < 60


def test_shifts_of_many_small_pairs_take_little_more_than_their_transforms(spark):
    n = 200_000
    px = lambda end, salt: f"transform(sequence(0, 63), k -> cast(hash(id, k, {salt}) % 1000 as float)) as px_{end}"
    pairs = spark.range(0, n, 1, 8).selectExpr("'s' as stack_id", "cast(id as int) as i", "cast(id as int) + 1 as j", px("i", 1), px("j", 2)).cache()
    fourier.pair_shifts(pairs, 8, 8).write.format("noop").mode("overwrite").save()  # fills the cache, starts the workers
    few = pairs.limit(1000).collect()
    a, b = (np.array([r[c] for r in few]).reshape(-1, 8, 8) for c in ("px_i", "px_j"))
    a, b = (z - z.mean(axis=(1, 2), keepdims=True) for z in (a, b))
    began = time.time()
    for _ in range(n // 1000):
        c = np.fft.ifft2(np.fft.fft2(a) * np.conj(np.fft.fft2(b))).real.reshape(1000, -1)
    plain, began = time.time() - began, time.time()
    found = fourier.pair_shifts(pairs, 8, 8)
    found.write.format("noop").mode("overwrite").save()
    took = time.time() - began
    got = {r.i: (r.dy, r.dx) for r in found.filter(f"i in ({', '.join(str(r.i) for r in few)})").collect()}
    pairs.unpersist()
    best = c.argmax(axis=1)
    want = np.column_stack([(best // 8 + 4) % 8 - 4, (best % 8 + 4) % 8 - 4])
    assert [got[r.i] for r in few] == [tuple(w) for w in want.tolist()]
    assert took < 3 * plain, (took, plain)


def test_images_keep_null_pixels_and_refuse_other_lengths():
    lists = pa.array([[9.0] * 4, [1.0, None, 3.0, 4.0], [5.0, 6.0, 7.0, 8.0], [9.0] * 4], pa.list_(pa.float32())).slice(1, 2)
    got = blocks.images(lists, 2, 2)
    assert got.dtype == np.float64 and np.array_equal(got, [[[1, np.nan], [3, 4]], [[5, 6], [7, 8]]], equal_nan=True)
    for odd in ([[1.0] * 4, None], [[1.0] * 3, [1.0] * 5]):
        with pytest.raises(ValueError):
            blocks.images(pa.array(odd, pa.list_(pa.float64())), 2, 2)


def test_a_round_of_a_stack_of_segments_takes_few_jobs(spark):
    n = 400
    rows = [("s", i, j, float(j - i), 0.0) for i in range(n) for j in range(i + 1, min(i + 4, n))]
    edges = spark.createDataFrame(rows, "stack_id string, i int, j int, dy double, dx double").cache()
    edges.count()

    def stages(rounds):
        group = f"segments-{rounds}"
        spark.sparkContext.setJobGroup(group, "")
        got = solve.solve_shifts(edges, segment=60, rounds=rounds).collect()
        tracker = spark.sparkContext.statusTracker()
        found = sum(len(tracker.getJobInfo(k).stageIds) for k in tracker.getJobIdsForGroup(group))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert len(got) == n and all(abs(r.ty - r.frame) < 0.01 and abs(r.tx) < 0.01 for r in got)
        return found

    few, many = stages(3), stages(7)
    edges.unpersist()
    assert 0 < (many - few) / 4 < 7, (few, many)
