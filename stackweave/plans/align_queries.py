"""The registered queries of frame-local and alignment operators, and their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from stackweave.operators import align, frames, local, stats

from .queries import FRAMES_SQL, NX, NY, PAIRS_SQL, C, pixels, query, r, stack


def long(df):
    """One row for each pixel, rounded."""
    return frames.as_pixels(df, NX).withColumn("v", r(C("v"), 5))


@query("ag08_edge_errors", f"""with {PAIRS_SQL}, e as (select stack_id, i as frame, corr from c union all select stack_id, j, corr from c)
select stack_id, frame, round(sum(greatest(corr, 1e-6) * (1 - corr)) / sum(greatest(corr, 1e-6)), 4) + 0.0 as error, count(*) as n from e group by all""")
def ag08_edge_errors(t):
    edges = frames.correlations(frames.frame_pairs(stack(t), 5)).select("stack_id", "i", "j", (1 - C("corr")).alias("e"), F.greatest("corr", F.lit(1e-6)).alias("w"))
    return align.edge_errors(edges, "e", "w").withColumn("error", r(C("error")))


@query("ag20_normalise", f"with {FRAMES_SQL} select stack_id, frame, y, x, round((v - min(v) over w) / (max(v) over w - min(v) over w), 5) + 0.0 as v from p window w as (partition by stack_id, frame)")
def ag20_normalise(t):
    return long(local.normalised(stack(t)))


@query("ag24_fit", """select l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 3) as intercept, round(corr(l_extendedprice, l_quantity), 6) as r_value from lineitem group by all""")
def ag24_fit(t):
    out = stats.line_fit(t("lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return out.select("l_returnflag", r(C("slope")).alias("slope"), r(C("intercept"), 3).alias("intercept"), r(C("r_value"), 6).alias("r_value"))


@query("sp26_parabola", """with s as (select l_returnflag, count(*) as n, sum(x) as s1, sum(x * x) as s2, sum(x * x * x) as s3, sum(x * x * x * x) as s4, sum(y) as t0, sum(x * y) as t1, sum(x * x * y) as t2
 from (select l_returnflag, l_quantity - 25 as x, l_tax * 100 as y from lineitem) group by all),
d as (select *, n * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2) as det from s)
select l_returnflag, round((t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - t2 * s3) + s2 * (t1 * s3 - t2 * s2)) / det, 5) + 0.0 as c0,
 round((n * (t1 * s4 - t2 * s3) - t0 * (s1 * s4 - s2 * s3) + s2 * (s1 * t2 - s2 * t1)) / det, 6) + 0.0 as c1,
 round((n * (s2 * t2 - s3 * t1) - s1 * (s1 * t2 - s2 * t1) + t0 * (s1 * s3 - s2 * s2)) / det, 7) + 0.0 as c2 from d""")
def sp26_parabola(t):
    out = stats.parabola_fit(t("lineitem").select("l_returnflag", (C("l_quantity") - 25).alias("x"), (C("l_tax") * 100).alias("y")), "x", "y", ["l_returnflag"])
    return out.select("l_returnflag", r(C("c0"), 5).alias("c0"), r(C("c1"), 6).alias("c1"), r(C("c2"), 7).alias("c2"))


@query("jn05_against_rest", f"""with {FRAMES_SQL}, s as (select stack_id, y, x, sum(v) as total from p group by all), q as (select stack_id, frame, v, total - v as o from p join s using (stack_id, y, x))
select stack_id, frame, round(sum(v * o) / sqrt(sum(v * v) * sum(o * o)), 4) + 0.0 as corr from q group by all""")
def jn05_against_rest(t):
    return align.against_rest(stack(t)).withColumn("corr", r(C("corr")))


@query("wn06_convolve", f"""with {FRAMES_SQL}, k as (select dy, dx, (2 - abs(dy)) * (2 - abs(dx)) / 16.0 as w from (select unnest(range(-1, 2)) as dy), (select unnest(range(-1, 2)) as dx))
select a.stack_id, a.frame, a.y, a.x, round(sum(b.v * w), 5) + 0.0 as v from p a, k, p b where b.stack_id = a.stack_id and b.frame = a.frame and b.y = a.y + dy and b.x = a.x + dx group by all""")
def wn06_convolve(t):
    kernel = [[(2 - abs(dy)) * (2 - abs(dx)) / 16 for dx in (-1, 0, 1)] for dy in (-1, 0, 1)]
    return long(local.convolve(stack(t), kernel, NY, NX))


def sampled(y: str, x: str, n: int, ny: int) -> str:
    """SQL of bilinear samples at the expressions y and x of k, n of each frame."""
    one = lambda a, b: f"px[cast({a} * 8 + {b} as integer) + 1]"
    return f"""with {FRAMES_SQL}, g as (select stack_id, frame, cast(px as double[]) as px, k, least(greatest({y}, 0), 7) as yy, least(greatest({x}, 0), 7) as xx from f, (select unnest(range({n})) as k)),
h as (select *, floor(yy) as y0, floor(xx) as x0, least(floor(yy) + 1, 7) as y1, least(floor(xx) + 1, 7) as x1, yy - floor(yy) as wy, xx - floor(xx) as wx from g)
select stack_id, frame, k // {ny} as y, k % {ny} as x, round(({one("y0", "x0")} * (1 - wx) + {one("y0", "x1")} * wx) * (1 - wy) + ({one("y1", "x0")} * (1 - wx) + {one("y1", "x1")} * wx) * wy, 5) + 0.0 as v from h"""


@query("ar11_bilinear", sampled("k // 8 + 0.375", "k % 8 - 1.25", 64, 8))
def ar11_bilinear(t):
    return long(local.resample(stack(t), 0.375, -1.25, NY, NX))


@query("ar10_polar", sampled("4 + (k % 8) * 0.5 * sin((k // 8) * 2 * pi() / 12)", "4 + (k % 8) * 0.5 * cos((k // 8) * 2 * pi() / 12)", 96, 8))
def ar10_polar(t):
    return long(local.polar(stack(t), 12, 8, NY, NX))


@query("ar16_windows", f"""with {FRAMES_SQL}, w as (select stack_id, frame, v, ((y - 3.5) / 2) ** 2 + ((x - 3.5) / 2) ** 2 as r2, (0.54 - 0.46 * cos(2 * pi() * y / 7)) * (0.54 - 0.46 * cos(2 * pi() * x / 7)) as hm, y between 1 and 5 and x between 2 and 6 as inside from p)
select stack_id, frame, round(sum(v * hm), 4) + 0.0 as hamming, round(sum(v * exp(-0.5 * r2)), 4) + 0.0 as gauss, round(sum(v / (1 + r2 ** 4)), 4) + 0.0 as butter, round(sum(case when inside then v else 0 end), 4) + 0.0 as masked from w group by all""")
def ar16_windows(t):
    w = lambda kind: r(F.sum(C("v") * local.window_weight(kind, C("y"), C("x"), NY, NX)))
    masked = F.when(local.edge_mask(C("y"), C("x"), NY, NX, 1, 2, 2, 1), C("v")).otherwise(0.0)
    return pixels(t).groupBy("stack_id", "frame").agg(w("hamming_square").alias("hamming"), w("gauss").alias("gauss"), w("butter").alias("butter"), r(F.sum(masked)).alias("masked"))


@query("sp04_masked_shift", f"""with {FRAMES_SQL}, s as (select unnest(range(-2, 3)) as d), m as (select a.stack_id, a.frame as i, b.frame as j, sy.d as dy, sx.d as dx, corr(a.v, b.v) as corr
 from p a join p b on a.stack_id = b.stack_id and b.frame - a.frame between 1 and 2, s sy, s sx where a.y = b.y + sy.d and a.x = b.x + sx.d group by all)
select stack_id, i, j, dy, dx, round(corr, 4) + 0.0 as corr from m qualify row_number() over (partition by stack_id, i, j order by corr desc, dy, dx) = 1""")
def sp04_masked_shift(t):
    return align.masked_shifts(frames.frame_pairs(stack(t), 2), np.ones((NY, NX)), 2).withColumn("corr", r(C("corr")))


@query("sp10_weights", f"with {PAIRS_SQL} select stack_id, i, j, round(1 / (1 + exp(-8 * (corr - 0.1))), 5) as w from c")
def sp10_weights(t):
    edges = frames.correlations(frames.frame_pairs(stack(t), 5))
    return edges.select("stack_id", "i", "j", r(align.logistic(C("corr"), 0.1, 8.0), 5).alias("w"))


@query("sp16_ring_correlation", f"""with {FRAMES_SQL}, s as (select stack_id, frame % 2 as half, y, x, sum(v) as v from p group by all), k as (select ky, kx from (select unnest(range(8)) as ky), (select unnest(range(8)) as kx)),
z as (select stack_id, half, ky, kx, sum(v * cos(2 * pi() * (ky * y + kx * x) / 8)) as re, -sum(v * sin(2 * pi() * (ky * y + kx * x) / 8)) as im from s, k group by all)
select a.stack_id, cast(round(sqrt(least(a.ky, 8 - a.ky) ** 2 + least(a.kx, 8 - a.kx) ** 2)) as integer) as k, round(sum(a.re * b.re + a.im * b.im) / sqrt(sum(a.re ** 2 + a.im ** 2) * sum(b.re ** 2 + b.im ** 2)), 4) + 0.0 as frc
from z a join z b on a.stack_id = b.stack_id and a.ky = b.ky and a.kx = b.kx and a.half = 0 and b.half = 1 group by all""")
def sp16_ring_correlation(t):
    f = stack(t)
    halves = align.stack_sums(f.withColumn("stack_id", F.struct("stack_id", (C("frame") % 2).alias("half"))))
    ready = halves.select(C("stack_id.stack_id").alias("stack_id"), C("stack_id.half").alias("half"), C("total").alias("px"))
    return align.ring_correlation(ready, NY, NX).withColumn("frc", r(C("frc")))


@query("sp20_dose", f"""with {FRAMES_SQL}, q as (select stack_id, frame, v, sqrt(least(y, 8 - y) ** 2 + least(x, 8 - x) ** 2) / 16 as q from p)
select stack_id, frame, round(sum(v * case when q > 0 then exp(-0.5 * (frame + 1) * 1.5 / (0.24499 * q ** -1.6649 + 2.8141)) else 1 end), 4) + 0.0 as s from q group by all""")
def sp20_dose(t):
    fold = lambda c, n: F.least(C(c), n - C(c))
    q = F.hypot(fold("y", NY), fold("x", NX)) / 16
    return pixels(t).groupBy("stack_id", "frame").agg(r(F.sum(C("v") * align.dose_weight(C("frame"), q, 1.5))).alias("s"))


@query("se03_frames_used", f"with {PAIRS_SQL} select stack_id, i as frame from c where corr > 0.2 union select stack_id, j from c where corr > 0.2")
def se03_frames_used(t):
    kept = frames.correlations(frames.frame_pairs(stack(t), 5)).filter("corr > 0.2")
    return kept.select("stack_id", F.explode(F.array("i", "j")).alias("frame")).distinct()


@query("so07_sample", "select o_orderkey, o_totalprice from orders order by md5(cast(o_orderkey as varchar)), o_orderkey limit 100")
def so07_sample(t):
    return stats.sample_rows(t("orders"), "o_orderkey", 100).select("o_orderkey", "o_totalprice")


@query("fn_polar_form", "select l_orderkey, l_linenumber, round(atan2(l_discount, l_quantity), 6) as phase, round(log10(1 + sqrt(l_quantity ** 2 + l_discount ** 2)), 5) as log_modulus from lineitem")
def fn_polar_form(t):
    re, im = C("l_quantity"), C("l_discount")
    return t("lineitem").select("l_orderkey", "l_linenumber", r(F.atan2(im, re), 6).alias("phase"), r(F.log10(1 + F.hypot(re, im)), 5).alias("log_modulus"))
