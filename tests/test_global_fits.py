"""Fits from bad starts, weights of pairs and cut-offs of pixels on planted data."""

import numpy as np

from stackweave.operators import global_fits


def test_planted_logistic_is_found_from_bad_starts(spark):
    x = np.linspace(0, 12, 60)
    true = {"a": (5.0, 2.0, 1.0), "b": (3.0, 8.0, 0.5), "c": (9.0, 0.7, 3.0)}
    rng = np.random.default_rng(1)
    rows = []
    for s, p in true.items():
        y = global_fits.falling_logistic(x, np.array(p))
        y[rng.integers(0, 60, 4)] += 0.3  # absolute errors bear with these
        rows += [(s, float(u), float(v)) for u, v in zip(x, y)]
    curves = spark.createDataFrame(rows, "stack_id string, x double, y double").repartition(4)
    bounds = spark.createDataFrame([(s, [0.0, 0.1, 0.05], [12.0, 20.0, 5.0]) for s in true], "stack_id string, low array<double>, high array<double>")
    got = {r.stack_id: r for r in global_fits.multi_start(curves, global_fits.falling_logistic, bounds, 3).collect()}
    for s, p in true.items():
        assert got[s].starts == 27
        assert np.abs(global_fits.falling_logistic(x, np.array(got[s].p)) - global_fits.falling_logistic(x, np.array(p))).max() < 0.01


def test_weights_of_pairs(spark):
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.normal(4, 0.5, 200), rng.normal(9, 1, 200)])
    rows = [("a", k, k + 1, float(v)) for k, v in enumerate(values)] + [("b", 0, 1, 3.0), ("b", 1, 2, None), ("c", 0, 1, 2.0), ("c", 1, 2, 2.0)]
    pairs = spark.createDataFrame(rows, "stack_id string, i int, j int, peaksig double")
    auto = {(r.stack_id, r.i): r.weight for r in global_fits.weighted_pairs(pairs, "autologistic").collect()}
    order = np.argsort(values)
    weights = np.array([auto["a", k] for k in range(400)])
    assert (np.diff(weights[order]) >= -1e-12).all() and weights[order[0]] < 0.25 and weights[order[-1]] > 0.9
    assert auto["b", 0] == 3.0 and auto["b", 1] is None and len(auto) == len(rows)
    fixed = {(r.stack_id, r.i): r.weight for r in global_fits.weighted_pairs(pairs, "logistic", p=(3.0, 5.0, 1.0)).collect()}
    assert abs(fixed["b", 0] - 0.5) < 1e-12 and fixed["a", int(order[-1])] > 0.999
    norm = {(r.stack_id, r.i): r.weight for r in global_fits.weighted_pairs(pairs, "norm").collect()}
    assert norm["a", int(order[0])] == 0.0 and norm["a", int(order[-1])] == 1.0 and norm["c", 0] is None
    assert {r.weight for r in global_fits.weighted_pairs(pairs, "unweighted").collect()} == {1.0}
    assert global_fits.weighted_pairs(pairs.limit(0), "autologistic").count() == 0


def test_hot_and_dead_pixels_at_a_share_of_one_in_ten_thousand(spark):
    rng = np.random.default_rng(3)
    n = 300
    rows, planted = [], {}
    for s, (mean, sd) in {"a": (400.0, 20.0), "b": (0.0, 1.0)}.items():
        v = rng.normal(mean, sd, (n, n))
        bad = {tuple(map(int, at)): sign for sign in (-1, 1) for at in rng.integers(0, n, (9, 2))}
        for (y, x), sign in bad.items():
            v[y, x] = mean + sign * sd * rng.uniform(7, 60)
        planted[s] = set(bad)
        rows += [(s, y, x, float(v[y, x])) for y in range(n) for x in range(n)]
    sums = spark.createDataFrame(rows, "stack_id string, y int, x int, v double")
    cuts = global_fits.pixel_cutoffs(sums)
    for r in cuts.collect():
        assert 2.5 < r.upper < 7 and -7 < r.lower < -2.5
        assert abs(r.deviation - {"a": 20.0, "b": 1.0}[r.stack_id]) < 0.02 * r.deviation
    found = {s: set() for s in planted}
    for r in global_fits.outliers(sums, cuts).collect():
        found[r.stack_id].add((r.y, r.x))
    for s in planted:
        assert planted[s] <= found[s] and len(found[s]) < 60 + len(planted[s])
    assert global_fits.pixel_cutoffs(sums.withColumn("v", sums.y * 0.0)).count() == 0
