"""The registered queries of stack files, followed and sharpest shifts, splines and many boxes, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from stackweave.operators import detector, fourier, frames, global_fits, smooth, solve
from stackweave.scratch import materialize, scratch_path
from stackweave.sources import stacks
from stackweave.streaming import stable

from .queries import FRAMES_SQL, NX, NY, C, query, r, stack


@query("io01_stack_files", f"""with {FRAMES_SQL}, s as (select stack_id, frame, count(*) as n, min(v) as least, max(v) as most, round(sum(v), 4) + 0.0 as total from p group by all)
select stack_id || '.' || form as file, frame, n, least, most, total from s, (select unnest(['mrc', 'tif']) as form) where frame between 3 and 17""")
def io01_stack_files(t):
    """Every stack as an MRC and as a TIFF file, of which the frames from 3 to 17 are read back."""
    own = stack(t).select(C("stack_id").cast("string").alias("stack_id"), "frame", "px")
    spark = own.sparkSession
    folder = scratch_path(spark, "stack-files")
    for form in ("mrc", "tif"):
        stacks.write_stacks(own, f"{folder}/{form}", NY, NX, form).write.format("noop").mode("overwrite").save()
    got = stacks.read_stacks(spark, folder).filter("frame between 3 and 17")
    each = got.select(F.regexp_extract("path", "([^/]*)$", 1).alias("file"), "frame", F.explode(C("px").cast("array<double>")).alias("v"))
    return each.groupBy("file", "frame").agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), r(F.sum("v")).alias("total"))


@query("wn07_followed_shifts", f"""with recursive {FRAMES_SQL}, z as (select *, v - avg(v) over (partition by stack_id, frame) as w from p),
s as (select unnest(range(8)) as y), k as (select a.y as ky, b.y as kx, (a.y + 4) % 8 - 4 as dy, (b.y + 4) % 8 - 4 as dx from s a, s b),
c as (select a.stack_id, a.frame as i, b.frame as j, ky, kx, any_value(dy) as dy, any_value(dx) as dx, sum(a.w * b.w) as v from z b join k on true join z a on a.stack_id = b.stack_id and a.frame between b.frame - 5 and b.frame - 1 and a.y = (b.y + ky) % 8 and a.x = (b.x + kx) % 8 group by all),
r as (select stack_id, i, j, dy, dx from c where j = i + 1 and dy * dy + dx * dx <= 4 qualify row_number() over (partition by stack_id, i order by v desc, ky, kx) = 1
 union all select c.stack_id, c.i, c.j, c.dy, c.dx from r join c on c.stack_id = r.stack_id and c.i = r.i and c.j = r.j + 1
 where ((c.dy - r.dy + 20) % 8 - 4) ** 2 + ((c.dx - r.dx + 20) % 8 - 4) ** 2 <= 4 qualify row_number() over (partition by c.stack_id, c.i order by c.v desc, c.ky, c.kx) = 1)
select stack_id, cast(i as integer) as i, cast(j as integer) as j, cast(dy as integer) as dy, cast(dx as integer) as dx from r""")
def wn07_followed_shifts(t):
    return fourier.followed_shifts(frames.frame_pairs(stack(t), 5), NY, NX, 2.0).drop("peaksig")


@query("sp07_sharpest_shifts")
def sp07_sharpest_shifts(t):
    out = fourier.sharpest_shifts(frames.frame_pairs(stack(t), 5), NY, NX)
    return out.withColumns({"sigma": r(C("sigma"), 2), "peaksig": r(C("peaksig"), 2)})


@query("wn05_smooth_trajectory")
def wn05_smooth_trajectory(t):
    path = stack(t).select("stack_id", "frame", C("px")[0].cast("double").alias("ty"), C("px")[1].cast("double").alias("tx"))
    out = smooth.smooth_trajectories(path, 0.25)
    return out.select("stack_id", "frame", r(C("ty")).alias("ty"), r(C("tx")).alias("tx"))


@query("sp09_rejected_pairs")
def sp09_rejected_pairs(t):
    pairs = materialize(fourier.pair_shifts(frames.frame_pairs(stack(t), 5), NY, NX), "pair-shifts")
    _, errors = solve.solve_rejecting(pairs, "peaksig", times=1, factor=1.5)
    return errors.select("stack_id", "i", "j", r(C("error"), 2).alias("error"))


@query("jn06_boxes", f"""with {FRAMES_SQL}, k as (select unnest([-1, 0, 2, 3, 4, 5]) as top), b as (select stack_id, frame, a.top, c.top as left_ from f, k a, k c where (frame + a.top) % 2 = 0),
c as (select p.stack_id, p.frame, top, left_, p.y - top as y, p.x - left_ as x, p.v from b join p on p.stack_id = b.stack_id and p.frame = b.frame and p.y between top and top + 3 and p.x between left_ and left_ + 3 where top between 0 and 4 and left_ between 0 and 4),
m as (select stack_id, frame, top, left_, avg(v) as a, stddev_pop(v) as d from c group by all), e as (select stack_id, frame, top, left_, y, x, case when abs(v - a) > 2.0 * d then a else v end as v from c join m using (stack_id, frame, top, left_)),
n as (select stack_id, frame, top, left_, avg(v) as a, stddev_pop(v) as d from e group by all)
select stack_id, frame, top, left_ as "left", round(max((v - a) / d), 4) + 0.0 as most, round(sum((y * 4 + x) * (v - a) / d), 3) + 0.0 as moment from e join n using (stack_id, frame, top, left_) group by all""")
def jn06_boxes(t):
    """Many boxes a frame, some beyond its edges."""
    place = F.explode(F.array(*map(F.lit, (-1, 0, 2, 3, 4, 5))))
    own = stack(t)
    boxes = own.select("stack_id", "frame", place.alias("top")).select("*", place.alias("left")).filter("(frame + top) % 2 = 0")
    each = detector.cut_boxes(boxes, own, 4, NY, NX, 2.0).select("stack_id", "frame", "top", "left", F.posexplode("px").alias("pos", "v"))
    return each.groupBy("stack_id", "frame", "top", "left").agg(r(F.max("v")).alias("most"), r(F.sum(C("pos") * C("v")), 3).alias("moment"))


@query("st02_stable_runs", """with o as (select cast(user_id as varchar) as path, date_trunc('hour', ts) as mtime, cast(floor(value / 60) * 1000000 as bigint) as size, ts as seen from events),
n as (select *, mtime is distinct from lag(mtime) over w or size is distinct from lag(size) over w or row_number() over w = 1 as new from o window w as (partition by path order by seen, mtime, size)),
s as (select *, lead(seen) over (partition by path order by seen, mtime, size) as next from n where new)
select path, mtime, size, seen + interval 20 minute as stable_at from s where size >= 1048576 and (next is null or next >= seen + interval 20 minute)""")
def st02_stable_runs(t):
    size = (F.floor(C("value") / 60) * 1000000).cast("long")
    seen = t("events").select(C("user_id").cast("string").alias("path"), F.date_trunc("hour", "ts").alias("mtime"), size.alias("size"), C("ts").alias("seen"))
    return stable.stable_runs(seen, 1200.0)


@query("sp11_autologistic_weights")
def sp11_autologistic_weights(t):
    pairs = materialize(fourier.pair_shifts(frames.frame_pairs(stack(t), 5), NY, NX), "pair-shifts")
    out = global_fits.weighted_pairs(pairs, "autologistic")
    return out.select("stack_id", "i", "j", r(C("weight"), 3).alias("weight"))


@query("sp10_norm_weights", f"""with {FRAMES_SQL}, e as (select a.stack_id, a.frame as i, b.frame as j, sum(a.v * b.v) / sqrt(sum(a.v * a.v) * sum(b.v * b.v)) as corr from p a join p b on a.stack_id = b.stack_id and a.y = b.y and a.x = b.x and b.frame between a.frame + 1 and a.frame + 5 group by all)
select stack_id, cast(i as integer) as i, cast(j as integer) as j, round((corr - min(corr) over w) / (max(corr) over w - min(corr) over w), 5) + 0.0 as weight from e window w as (partition by stack_id)""")
def sp10_norm_weights(t):
    pairs = frames.correlations(frames.frame_pairs(stack(t), 5))
    return global_fits.weighted_pairs(pairs, "norm", "corr").select("stack_id", "i", "j", r(C("weight"), 5).alias("weight"))
