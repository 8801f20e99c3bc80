"""The registered queries of solved shifts, sub-pixel moves, detector corrections and cut boxes, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from stackweave.operators import detector, fourier, frames, solve

from .align_queries import long
from .queries import FRAMES_SQL, NX, NY, C, pixels, query, r, stack


@query("sp08_solve_shifts")
def sp08_solve_shifts(t):
    out = solve.solve_shifts(fourier.pair_shifts(frames.frame_pairs(stack(t), 5), NY, NX), "peaksig")
    return out.select("stack_id", "frame", r(C("ty"), 2).alias("ty"), r(C("tx"), 2).alias("tx"))


@query("sp13_phase_shift", f"""with {FRAMES_SQL}, k as (select ky, kx, case when ky < 4 then ky else ky - 8 end as sy, case when kx < 4 then kx else kx - 8 end as sx from (select unnest(range(8)) as ky), (select unnest(range(8)) as kx)),
z as (select stack_id, frame, ky, kx, any_value(sy) as sy, any_value(sx) as sx, sum(v * cos(2 * pi() * (ky * y + kx * x) / 8)) as re, -sum(v * sin(2 * pi() * (ky * y + kx * x) / 8)) as im from p, k group by stack_id, frame, ky, kx),
w as (select *, sy * (frame % 5 * 0.25 - 0.5) + sx * (frame % 3 * 0.3) as ramp from z)
select stack_id, frame, y, x, round(sum(re * cos(2 * pi() * (ky * y + kx * x - ramp) / 8) - im * sin(2 * pi() * (ky * y + kx * x - ramp) / 8)) / 64, 5) + 0.0 as v
from w, (select unnest(range(8)) as y), (select unnest(range(8)) as x) group by all""")
def sp13_phase_shift(t):
    moved = stack(t).withColumns({"ty": C("frame") % 5 * 0.25 - 0.5, "tx": C("frame") % 3 * 0.3})
    return long(fourier.phase_shift(moved, NY, NX))


def _sinc(x: str) -> str:
    return f"case when abs({x}) < 1e-9 then 1.0 else sin(pi() * ({x})) / (pi() * ({x})) end"


def _taps(shift: str) -> str:
    raw = [f"({_sinc(f'2 * ({k} - {shift}) * 2 / 3.0')}) * ({_sinc(f'({k} - {shift}) * 2 / 3.0')})" for k in (-1, 0, 1)]
    return "[" + ", ".join(raw) + "]"


@query("sp14_lanczos", f"""with {FRAMES_SQL}, s as (select stack_id, frame, frame % 5 * 0.2 - 0.4 as dy, 0.25 as dx from f), w as (select stack_id, frame, {_taps("dy")} as wy, {_taps("dx")} as wx from s),
g as (select p.stack_id, p.frame, p.y, p.x, ty, tx, wy[ty + 2] / list_sum(wy) * wx[tx + 2] / list_sum(wx) as k, least(greatest(p.y - ty, 0), 7) as v, least(greatest(p.x - tx, 0), 7) as u
 from p join w using (stack_id, frame), (select unnest([-1, 0, 1]) as ty), (select unnest([-1, 0, 1]) as tx))
select g.stack_id, g.frame, g.y, g.x, round(sum(k * q.v), 5) + 0.0 as v from g join p q on q.stack_id = g.stack_id and q.frame = g.frame and q.y = g.v and q.x = g.u group by all""")
def sp14_lanczos(t):
    return long(fourier.lanczos_shift(stack(t).withColumns({"ty": C("frame") % 5 * 0.2 - 0.4, "tx": F.lit(0.25)}), NY, NX))


@query("sp21_hot_pixels", f"""with {FRAMES_SQL}, s as (select stack_id, y, x, sum(v) as v from p group by all), m as (select stack_id, avg(v) as a, stddev_pop(v) as d from s group by all),
b as (select stack_id, y, x, 1 / (1 + exp(-8.0 * (abs((v - a) / d) - 2.0))) as bad from s join m using (stack_id)), q as (select * from p join b using (stack_id, y, x)),
n as (select a.stack_id, a.frame, a.y, a.x, a.v, a.bad, sum(c.v * (1 - c.bad)) / sum(1 - c.bad) as near from q a join q c on a.stack_id = c.stack_id and a.frame = c.frame and abs(a.y - c.y) <= 1 and abs(a.x - c.x) <= 1 and (a.y <> c.y or a.x <> c.x) group by all)
select stack_id, frame, y, x, round(v * (1 - bad) + bad * near, 5) + 0.0 as v from n""")
def sp21_hot_pixels(t):
    return long(detector.hot_pixels(stack(t), detector.outlier_weights(stack(t), 2.0, 8.0), NY, NX))


@query("sp27_gain_orientation", f"""with {FRAMES_SQL}, s as (select stack_id, y, x, sum(v) as v from p group by all), g as (select y, x, 1 + avg(abs(v)) as g from p group by all),
o as (select stack_id, v, unnest([{{'way': 'flip_x', 'y': y, 'x': 7 - x}}, {{'way': 'flip_y', 'y': 7 - y, 'x': x}}, {{'way': 'none', 'y': y, 'x': x}}, {{'way': 'rot180', 'y': 7 - y, 'x': 7 - x}}, {{'way': 'rot270', 'y': 7 - x, 'x': y}}, {{'way': 'rot90', 'y': x, 'x': 7 - y}}]) as w from s),
d as (select stack_id, w.way as way, stddev_pop(o.v * g.g) as deviation from o join g on g.y = w.y and g.x = w.x group by all)
select stack_id, way, round(deviation, 5) as deviation, row_number() over (partition by stack_id order by deviation, way) = 1 as best from d""")
def sp27_gain_orientation(t):
    p = pixels(t)
    gain = p.groupBy("y", "x").agg((1 + F.avg(F.abs("v"))).alias("g"))
    out = detector.gain_orientations(p.groupBy("stack_id", "y", "x").agg(F.sum("v").alias("v")), gain, NX)
    return out.withColumn("deviation", r(C("deviation"), 5))


@query("sp28_particles", f"""with {FRAMES_SQL}, k as (select stack_id, frame, y - 2 as top, x - 2 as left_ from p qualify row_number() over (partition by stack_id, frame order by v desc, y, x) = 1),
c as (select p.stack_id, p.frame, top, left_, p.y - top as y, p.x - left_ as x, p.v from k join p on p.stack_id = k.stack_id and p.frame = k.frame and p.y between top and top + 3 and p.x between left_ and left_ + 3 where top between 0 and 4 and left_ between 0 and 4),
m as (select stack_id, frame, avg(v) as a, stddev_pop(v) as d from c group by all), e as (select stack_id, frame, top, left_, y, x, case when abs(v - a) > 2.5 * d then a else v end as v from c join m using (stack_id, frame)),
n as (select stack_id, frame, avg(v) as a, stddev_pop(v) as d from e group by all)
select stack_id, frame, top, left_ as "left", y, x, round(-(v - a) / d, 4) + 0.0 as v from e join n using (stack_id, frame)""")
def sp28_particles(t):
    boxes = frames.peak(pixels(t)).select("stack_id", "frame", (C("y") - 2).alias("top"), (C("x") - 2).alias("left"))
    cut = detector.cut_boxes(boxes, stack(t), 4, NY, NX, 2.5, invert=True)
    each = cut.select("stack_id", "frame", "top", "left", F.posexplode("px").alias("pos", "v"))
    return each.select("stack_id", "frame", "top", "left", F.expr("pos div 4").cast("int").alias("y"), (C("pos") % 4).alias("x"), r(C("v")).alias("v"))
