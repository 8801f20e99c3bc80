import numpy as np
import pytest
from pyspark.sql import functions as F

from stackweave.operators import fits, halves

X = np.linspace(0.5, 5, 40)
CURVES = {
    "gauss1": (lambda p: p[0] * np.exp(-(((X - p[1]) / p[2]) ** 2)), [3.0, 2.0, 0.8]),
    "expc": (lambda p: p[0] * np.exp(p[1] * X) + p[2], [2.0, -0.7, 0.5]),
    "power2": (lambda p: p[0] * X ** p[1] + p[2], [1.5, -1.2, 0.3]),
    "powerpoly1": (lambda p: p[0] * X ** p[1] + p[2] * X + p[3], [1.5, -1.2, 0.2, 0.3]),
    "logistic": (lambda p: 1 - 1 / (1 + np.exp(p[1] * (X - p[0]))) ** p[2], [2.5, 3.0, 1.4]),
}


@pytest.mark.parametrize("model", sorted(CURVES))
def test_planted_curves_come_back_and_odd_groups_do_no_harm(spark, model):
    curve, p = CURVES[model]
    rows = [("a", float(x), float(y)) for x, y in zip(X, curve(p))] + [(None, x, 2 * y) for x, y in zip(X.tolist(), curve(p).tolist())]
    rows += [("a", None, 1.0), ("a", 1.0, None), ("gone", None, None)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    got = {r.k: r for r in fits.curve_fit(df, "x", "y", ["k"], model).collect()}
    assert set(got) == {"a", None}
    assert got["a"].p == pytest.approx(p, rel=1e-4)
    if model == "gauss1":
        assert got[None].p == pytest.approx([6.0, 2.0, 0.8], rel=1e-4)


def test_absolute_errors_pass_over_wild_rows(spark):
    y = 3 * np.abs(X)
    y[::9] += 50
    df = spark.createDataFrame(list(zip(X.tolist(), y.tolist())), "x double, y double")
    assert fits.curve_fit(df, "x", "y", [], "abs1", absolute=True).first().p == pytest.approx([3.0], rel=1e-4)


def test_polynomials_equal_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(1000, 1010, 200)
    y = rng.normal(size=200)
    rows = [("a", u, v) for u, v in zip(x.tolist(), y.tolist())] + [("one", 1.0, 1.0), ("one", 1.0, 2.0), (None, 0.0, 1.0), (None, 1.0, 3.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    for degree in (1, 5):
        got = {r.k: r.coefs for r in fits.polynomial_fit(df, "x", "y", ["k"], degree).collect()}
        assert got["one"] is None
        want = np.polynomial.Polynomial.fit(x, y, degree)
        at = spark.createDataFrame([(float(v),) for v in x[:20]], "x double").select("x", fits.polynomial(F.lit(got["a"]), F.col("x")).alias("f")).collect()
        if degree == 1:
            assert [r.f for r in at] == pytest.approx(want(x[:20]).tolist(), abs=1e-6)
            assert got[None] == pytest.approx([1.0, 2.0])
        else:
            assert got[None] is None
            scaled = fits.polynomial_fit(df.withColumn("x", F.col("x") - 1005), "x", "y", ["k"], degree).filter("k = 'a'").first().coefs
            assert np.polynomial.polynomial.polyval(x - 1005, scaled) == pytest.approx(want(x), abs=1e-8)


def test_background(spark):
    y, x = np.mgrid[0:32, 0:32]
    plane = 5 * np.exp(-0.5 * (((y - 14) / 9) ** 2 + ((x - 18) / 12) ** 2)) + 2
    rows = [(1, int(a), int(b), float(v)) for a, b, v in zip(y.ravel(), x.ravel(), plane.ravel())]
    df = spark.createDataFrame(rows, "stack_id int, y int, x int, v double")
    worst = fits.background(df, 2).join(df, ["stack_id", "y", "x"]).agg(F.max(F.abs(F.col("v") - F.col("background")))).first()[0]
    assert worst < 0.1


def test_independent_halves_of_a_drifting_stack_agree(spark):
    rng = np.random.default_rng(5)
    still = rng.normal(size=(16, 16))
    rows = [(1, k, np.roll(still, (k % 4, -(k % 3)), axis=(0, 1)).ravel().tolist()) for k in range(8)] + [(2, 0, still.ravel().tolist())]
    df = spark.createDataFrame(rows, "stack_id int, frame int, px array<double>")
    got = {(r.stack_id, r.half): np.array(r.px) for r in halves.independent_halves(df, 16, 16, 3).collect()}
    assert set(got) == {(1, 0), (1, 1)}
    assert got[1, 0] == pytest.approx(4 * still.ravel(), abs=1e-6)
    assert got[1, 1] == pytest.approx(got[1, 0], abs=1e-6)
