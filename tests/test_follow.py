"""Splines against a dense solve, followed and sharpest shifts against plain loops, the solver against one whole system,
many boxes of large frames."""

import time

import numpy as np
import pytest

from stackweave.operators import detector, fourier, smooth, solve


def dense_spline(x, y, residual):
    """The same curve from full matrices: a fine bisection over the weight."""
    gram, _, factors = smooth.diagonals(x)
    m = len(x) - 3
    g, q = np.zeros((m, m)), np.zeros((len(x), m))
    for d in range(min(3, m)):
        g += np.diag(gram[d, : m - d], d) + (np.diag(gram[d, : m - d], -d) if d else 0)
    for j in range(m):
        q[j : j + 4, j] = factors[j]
    penalty = 36 * q @ np.linalg.solve(g, q.T)
    values, axes = np.linalg.eigh(penalty)
    seen = axes.T @ y
    low, high = -40.0, 60.0
    for _ in range(200):
        mid = (low + high) / 2
        w = np.exp(mid)
        if (((w * values / (1 + w * values)) * seen) ** 2).sum() > residual:
            high = mid
        else:
            low = mid
    return axes @ (seen / (1 + np.exp(low) * values)), penalty


@pytest.mark.parametrize("n", [4, 5, 7, 30])
def test_spline_equals_dense_solve(n):
    rng = np.random.default_rng(n)
    x = np.cumsum(rng.integers(1, 4, n)).astype(float)
    y = np.sin(x / 4) + rng.normal(0, 0.3, n)
    line = np.polyval(np.polyfit(x, y, 2), x)
    for share in (0.05, 0.3, 0.9):
        residual = share * ((y - line) ** 2).sum()
        want, _ = dense_spline(x, y, residual)
        got = smooth.smoothed(x, y, residual)
        assert np.allclose(got, want, atol=1e-6) and np.isclose(((y - got) ** 2).sum(), residual, rtol=1e-6)
    assert np.allclose(smooth.smoothed(x, y, 1e9), line)
    assert (smooth.smoothed(x, y, 0.0) == y).all()


def test_penalty_is_the_integral_of_the_squared_third_derivative():
    x = np.array([0.0, 1.0, 2.0, 4.0, 5.0, 7.0, 8.0])
    cubic = 0.5 * x**3 - x  # any cubic through all places is its own smoothest curve inside; its third derivative is 3
    _, penalty = dense_spline(x, cubic, 0.1)
    assert cubic @ penalty @ cubic <= 9 * 8 + 1e-6
    assert np.allclose(penalty @ (x**2 - x), 0, atol=1e-8)  # parabolas cost nothing


def test_trajectories_with_gaps_nulls_and_ties(spark):
    rows = [(s, k, float(k * k) + (k % 2) * 0.4, None if k == 3 else 1.0) for s in ("a", None) for k in range(12) if k != 5] + [("a", 0, 0.0, 1.0), ("b", 1, 2.0, 3.0), ("c", None, 1.0, 1.0)]
    got = smooth.smooth_trajectories(spark.createDataFrame(rows, "stack_id string, frame int, ty double, tx double"), 0.2).collect()
    assert len(got) == len(rows) - 1  # the row without a frame
    one = sorted((r.frame, r.ty) for r in got if r.stack_id == "a")
    assert one[0][1] == one[1][1] and all(abs(b - a * a) < 0.6 for a, b in one)
    assert [r.tx for r in got if r.frame == 3] == [None, None] and [(r.ty, r.tx) for r in got if r.stack_id == "b"] == [(2.0, 3.0)]
    assert smooth.smooth_trajectories(spark.createDataFrame([], "stack_id string, frame int, ty double, tx double"), 0.2).count() == 0


def moving(n, ny, nx, rng, step=(1, 0.5)):
    base = rng.normal(size=(ny, nx))
    return [np.roll(base, (int(k * step[0]), int(k * step[1])), axis=(0, 1)) + rng.normal(0, 0.2, (ny, nx)) for k in range(n)]


def pairs_of(spark, px, width):
    rows = [("s", i, j, px[i].ravel().tolist(), px[j].ravel().tolist()) for i in range(len(px)) for j in range(i + 1, min(i + width + 1, len(px)))]
    return spark.createDataFrame(rows, "stack_id string, i int, j int, px_i array<double>, px_j array<double>").repartition(5)


def test_followed_shifts_equal_a_plain_loop(spark):
    ny, nx, furthest = 16, 12, 2.5
    px = moving(14, ny, nx, np.random.default_rng(1))
    got = {(r.i, r.j): (r.dy, r.dx) for r in fourier.followed_shifts(pairs_of(spark, px, 9), ny, nx, furthest).collect()}
    want = {}
    for i in range(14):
        centre = (0, 0)
        for j in range(i + 1, min(i + 10, 14)):
            a, b = px[i] - px[i].mean(), px[j] - px[j].mean()
            best = None
            for y in range(ny):
                for x in range(nx):
                    oy, ox = (y - centre[0] + ny // 2) % ny - ny // 2, (x - centre[1] + nx // 2) % nx - nx // 2
                    if oy * oy + ox * ox <= furthest**2:
                        c = (a * np.roll(b, (y, x), axis=(0, 1))).sum()
                        if best is None or c > best[0] + 1e-9:
                            best = (c, y, x)
            centre = ((best[1] + ny // 2) % ny - ny // 2, (best[2] + nx // 2) % nx - nx // 2)
            want[i, j] = centre
    assert got == want
    assert got[0, 5] == (-5, -2)  # further than one search reaches


def test_sharpest_shifts_reach_the_optimum_of_a_fine_grid(spark):
    ny = nx = 16
    px = moving(6, ny, nx, np.random.default_rng(2))
    got = {(r.i, r.j): r for r in fourier.sharpest_shifts(pairs_of(spark, px, 3), ny, nx, 4.0).collect()}
    k2 = np.fft.fftfreq(ny)[:, None] ** 2 + np.fft.fftfreq(nx)[None, :] ** 2
    for (i, j), r in got.items():
        a, b = px[i] - px[i].mean(), px[j] - px[j].mean()
        z = np.fft.fft2(a) * np.conj(np.fft.fft2(b))
        most = max(((c.max() - c.mean()) / c.std(), s) for s in np.linspace(0, 4, 801) for c in [np.fft.ifft2(z * np.exp(-2 * (np.pi * s) ** 2 * k2)).real])
        assert r.peaksig >= most[0] * (1 - 1e-4) and 0 <= r.sigma <= 4


def planted(n, width, rng, wrong=0.1):
    t = np.cumsum(rng.normal(0, 1, (n, 2)), axis=0)
    t -= t[0]
    rows = []
    for i in range(n):
        for j in range(i + 1, min(i + width + 1, n)):
            d = t[j] - t[i] + rng.normal(0, 0.05, 2) + (rng.normal(0, 20, 2) if rng.random() < wrong else 0)
            rows.append(("s", i, j, float(d[0]), float(d[1]), float(rng.uniform(0.5, 2))))
    return t, rows


def test_segments_do_not_change_the_shifts_of_a_long_stack(spark):
    rng = np.random.default_rng(4)
    t, rows = planted(2000, 4, rng)
    rows = [r for r in rows if not r[1] < 700 <= r[2]]  # nothing leads over here
    edges = spark.createDataFrame(rows, "stack_id string, i int, j int, dy double, dx double, w double").repartition(6)
    got = {r.frame: (r.ty, r.tx) for r in solve.solve_shifts(edges, "w", segment=128, rounds=6).collect()}
    i, j = (np.array([r[k] for r in rows]) for k in (1, 2))
    shift, w = (np.array([[r[3], r[4]] for r in rows]), np.array([r[5] for r in rows]))
    want = np.column_stack([solve.whole(2000, i, j, shift[:, k], w, 6) for k in (0, 1)])
    assert np.abs(np.array([got[k] for k in range(2000)]) - want).max() < 1e-6
    assert abs(want[700] - want[699]).max() < 1e-4


def test_cyclic_reduction_equals_one_solve():
    rng = np.random.default_rng(5)
    for m in (1, 2, 3, 6, 9):
        full = rng.normal(size=(3 * m, 3 * m))
        full = full @ full.T + 3 * m * np.eye(3 * m)
        for a in range(m):
            for b in range(m):
                if abs(a - b) > 1:
                    full[3 * a : 3 * a + 3, 3 * b : 3 * b + 3] = 0
        full += 50 * np.eye(3 * m)
        right = rng.normal(size=3 * m)
        cut = lambda a, b: full[3 * a : 3 * a + 3, 3 * b : 3 * b + 3]
        got = solve.separators([cut(k, k) for k in range(m)], [cut(k, k + 1) for k in range(m - 1)], [right[3 * k : 3 * k + 3] for k in range(m)])
        assert np.allclose(np.concatenate(got), np.linalg.solve(full, right))


def test_rejection_drops_the_wrong_pairs(spark):
    t, rows = planted(40, 5, np.random.default_rng(6), 0.0)
    wrong = {(3, 6), (10, 14), (20, 22)}
    rows = [(s, i, j, dy + 30 * ((i, j) in wrong), dx, w) for s, i, j, dy, dx, w in rows]
    edges = spark.createDataFrame(rows, "stack_id string, i int, j int, dy double, dx double, w double")
    shifts, kept = solve.solve_rejecting(edges, "w", floor=1.0)
    assert {(r.i, r.j) for r in kept.collect()} == {r[1:3] for r in rows} - wrong
    assert max(np.hypot(r.ty - t[r.frame, 0], r.tx - t[r.frame, 1]) for r in shifts.collect()) < 0.25


def test_many_boxes_of_a_large_frame_cost_little_more_than_one(spark):
    n, size = 2048, 32
    rng = np.random.default_rng(7)
    px = rng.normal(size=n * n).astype("f4")
    frames = spark.createDataFrame([("s", 0, px.tolist())], "stack_id string, frame int, px array<float>").cache()
    frames.count()
    places = [(int(y), int(x)) for y, x in rng.integers(0, n - size + 1, (1000, 2))]
    boxes = spark.createDataFrame([("s", 0, y, x) for y, x in places], "stack_id string, frame int, top int, left int")

    def took(some):
        began = time.time()
        rows = detector.cut_boxes(some, frames, size, n, n, 3.0).collect()
        return time.time() - began, rows

    took(boxes.limit(1))
    one, _ = took(boxes.limit(1))
    many, rows = took(boxes)
    assert many < 3 * one + 1
    assert sorted((r.top, r.left) for r in rows) == sorted(places)
    for r in rows[::97]:
        cut = px.reshape(n, n)[r.top : r.top + size, r.left : r.left + size].astype(float)
        cut = np.where(np.abs(cut - cut.mean()) > 3 * cut.std(), cut.mean(), cut)
        assert np.allclose(r.px, ((cut - cut.mean()) / cut.std()).ravel(), atol=1e-9)


def test_boxes_on_bands_repeated_filled_and_resampled(spark):
    rng = np.random.default_rng(8)
    px = rng.normal(size=(20, 24))
    px[5, 5] = 40.0
    frames = spark.createDataFrame([("s", 0, px.ravel().tolist()), ("t", 0, [1.0] * 480)], "stack_id string, frame int, px array<double>")
    every = [("s", 0, y, x) for y in range(0, 13) for x in range(0, 17, 3)] + [("s", 0, 2, 2)] * 3 + [("s", 0, -1, 0), ("s", 0, 13, 0), ("t", 0, 1, 1), ("u", 0, 1, 1)]
    boxes = spark.createDataFrame(every, "stack_id string, frame int, top int, left int")
    key = lambda r: (r.stack_id, r.top, r.left)
    whole, banded = ({key(r): r.px for r in detector.cut_boxes(boxes, frames, 8, 20, 24, 3.0, band=b, fill="gauss").collect()} for b in (None, 3))
    assert whole.keys() == banded.keys() and all(whole[k] == banded[k] for k in whole)
    assert len(detector.cut_boxes(boxes, frames, 8, 20, 24, 3.0).collect()) == len(every) - 3
    assert whole["t", 1, 1] == [None] * 64 and abs(max(whole["s", 2, 3], key=abs)) < 5  # the hot pixel went
    half = detector.cut_boxes(boxes.limit(1), frames, 8, 20, 24, 99.0, out_size=4).first().px
    twice = detector.cut_boxes(boxes.limit(1), frames, 8, 20, 24, 99.0, out_size=16).first().px
    assert len(half) == 16 and len(twice) == 256 and abs(np.mean(half)) < 1e-9 and abs(np.std(twice) - 1) < 1e-9
    wave = np.cos(2 * np.pi * np.arange(16) / 16)[None, :] * np.ones((16, 1))
    assert np.allclose(detector.resampled(wave[None], 8)[0], np.cos(2 * np.pi * np.arange(8) / 8)[None, :] * np.ones((8, 1)))
