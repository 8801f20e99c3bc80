"""The registered queries of curve fits, best dose, local ring correlation and independent halves, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from stackweave.operators import align, fits, halves, stats

from .more_queries import TILES_SQL
from .queries import FRAMES_SQL, HIST_SQL, NX, NY, ORACLE_SQL, C, pixels, query, r, stack


@query("sp26_poly3", """with d as (select l_returnflag, l_quantity as x, l_tax * 100 as y from lineitem),
e as (select *, x - avg(x) over w as p1 from d window w as (partition by l_returnflag)),
f as (select *, (x - sum(x * p1 * p1) over w / sum(p1 * p1) over w) * p1 - sum(p1 * p1) over w / count(*) over w as p2 from e window w as (partition by l_returnflag)),
g as (select *, (x - sum(x * p2 * p2) over w / sum(p2 * p2) over w) * p2 - sum(p2 * p2) over w / sum(p1 * p1) over w * p1 as p3 from f window w as (partition by l_returnflag)),
h as (select l_returnflag, x, avg(y) over w + sum(y * p1) over w / sum(p1 * p1) over w * p1 + sum(y * p2) over w / sum(p2 * p2) over w * p2 + sum(y * p3) over w / sum(p3 * p3) over w * p3 as fit from g window w as (partition by l_returnflag))
select l_returnflag, x as l_quantity, round(max(fit), 4) + 0.0 as fit from h group by all""")
def sp26_poly3(t):
    rows = t("lineitem").select("l_returnflag", "l_quantity", (C("l_tax") * 100).alias("y"))
    coefs = fits.polynomial_fit(rows, "l_quantity", "y", ["l_returnflag"], 3)
    places = rows.select("l_returnflag", "l_quantity").distinct().join(coefs, "l_returnflag")
    return places.select("l_returnflag", "l_quantity", r(fits.polynomial(C("coefs"), C("l_quantity"))).alias("fit"))


@query("sp26_abs", "select c_mktsegment, round(sum(abs(c_acctbal) * c_custkey) / sum(c_acctbal ** 2), 5) + 0.0 as a from customer group by all")
def sp26_abs(t):
    return fits.curve_fit(t("customer"), "c_acctbal", "c_custkey", ["c_mktsegment"], "abs1").select("c_mktsegment", r(F.get("p", 0), 5).alias("a"))


@query("sp26_exp", f"""with recursive {HIST_SQL}, z as materialized (select event_type, bin / 8.0 as x, 1 - cdf as y from c),
s as (select event_type, 0 as k, 1.0::double as a, -1.0::double as c from (select distinct event_type from z) union all
 select event_type, k + 1, a + (g1 * s22 - g2 * s12) / (s11 * s22 - s12 * s12), c + (g2 * s11 - g1 * s12) / (s11 * s22 - s12 * s12) from
 (select event_type, k, a, c, sum(exp(2 * c * x)) as s11, sum(a * x * exp(2 * c * x)) as s12, sum(a * a * x * x * exp(2 * c * x)) as s22, sum(exp(c * x) * (y - a * exp(c * x))) as g1, sum(a * x * exp(c * x) * (y - a * exp(c * x))) as g2 from s join z using (event_type) where k < 30 group by event_type, k, a, c))
select event_type, round(a, 4) + 0.0 as a, round(c, 4) + 0.0 as c from s where k = 30""")
def sp26_exp(t):
    curves = stats.cdf(stats.histogram(t("events"), "value", 32, ["event_type"]), ["event_type"])
    points = curves.select("event_type", (C("bin") / 8).alias("x"), (1 - C("cdf")).alias("y"))
    return fits.curve_fit(points, "x", "y", ["event_type"], "exp").select("event_type", r(F.get("p", 0)).alias("a"), r(F.get("p", 1)).alias("c"))


@query("sp20_best_dose", f"""with {FRAMES_SQL}, q as (select stack_id, frame, y, x, v, sqrt(least(y, 8 - y) ** 2 + least(x, 8 - x) ** 2) / 16 as q, 1.5 * frame + 0.75 as mid from p),
l as (select *, case when 2.51284 * (0.24499 * (3 / 16.0) ** -1.6649 + 2.8141) > mid then 3 / 16.0 when 2.51284 * (0.24499 * (2 / 16.0) ** -1.6649 + 2.8141) > mid then 2 / 16.0 when 2.51284 * (0.24499 * (1 / 16.0) ** -1.6649 + 2.8141) > mid then 1 / 16.0 else 0.0 end as top from q),
w as (select *, case when q = 0 then 1.0 when top = 0 then 0.0 else exp(-((q / top) ** 32)) * exp(-0.5 * (frame + 1) * 1.5 / (0.24499 * q ** -1.6649 + 2.8141)) end as w from l)
select stack_id, y, x, round(sum(v * w) / (sum(w) + 1), 4) + 0.0 as s from w group by all""")
def sp20_best_dose(t):
    fold = lambda c, n: F.least(C(c), n - C(c))
    q, frame = F.hypot(fold("y", NY), fold("x", NX)) / 16, C("frame")
    w = align.dose_weight(frame, q, 1.5) * align.dose_rolloff(q, align.best_dose_limit(frame * 1.5, (frame + 1) * 1.5, 1 / 16, 4))
    weighted = pixels(t).select("stack_id", "y", "x", "v", w.alias("w"))
    return weighted.groupBy("stack_id", "y", "x").agg(r(F.sum(C("v") * C("w")) / (F.sum("w") + 1)).alias("s"))


def _halves(t):
    sums = align.stack_sums(stack(t).withColumn("stack_id", F.struct("stack_id", (C("frame") % 2).alias("half"))))
    return sums.select(C("stack_id.stack_id").alias("stack_id"), C("stack_id.half").alias("half"), C("total").alias("px"))


CENTRE_SQL = FRAMES_SQL + """,
q as (select stack_id, frame, 0 as tile_y, 0 as tile_x, cast(y - 2 as integer) as y, cast(x - 2 as integer) as x, v from p where y between 2 and 5 and x between 2 and 5)"""


@query("sp19_local_frc", ORACLE_SQL["sp16_tiled_frc"].replace(TILES_SQL, CENTRE_SQL))
def sp19_local_frc(t):
    return align.local_ring_correlation(_halves(t), 4, NY, NX).withColumn("frc", r(C("frc"), 3))


@query("sp18_even_odd_frc")
def sp18_even_odd_frc(t):
    return align.tiled_ring_correlation(halves.independent_halves(stack(t), NY, NX, 5), 4, 2, NY, NX).withColumn("frc", r(C("frc"), 3))
