"""The registered queries of operator kinds, pair modes, geometry, windows and tiled correlation, and their SQL."""

from __future__ import annotations



from pyspark.sql import functions as F

from stackweave.functions import numeric as num
from stackweave.operators import align, fourier, frames, local, lookup, stats
from stackweave.sources import tables

from .align_queries import long
from .queries import FRAMES_SQL, HIST_SQL, NX, NY, PAIRS_SQL, C, pixels, query, r, stack


@query("ex07_operators", """select c_custkey, -c_acctbal as neg, ~c_nationkey as inverted, c_custkey << (c_nationkey % 8) as shifted_left, c_custkey >> (c_nationkey % 8) as shifted_right, cast(c_nationkey as bigint) * c_nationkey * c_nationkey as cubed,
 round(sqrt(abs(c_acctbal)), 4) as root, case when c_nationkey = 0 then null else round(c_acctbal / c_nationkey, 9) + 0.0 end as quotient, cast(trunc(c_acctbal) as bigint) as cut, c_nationkey <> 3 and c_acctbal >= 100 as at_least, c_nationkey = 3 or c_acctbal <> 100 as unequal,
 c_nationkey <> 3 and c_acctbal < 100 as less, cast(1 as double) as ones from customer""")
def ex07_operators(t):
    a, k = C("c_acctbal"), C("c_nationkey")
    odd = F.when(k == 3, num.nan()).otherwise(a)  # NaN for one nation
    q = num.true_div(a, k)
    made = {"neg": -a, "inverted": F.bitwise_not(k), "shifted_left": num.shift_left(C("c_custkey"), k % 8), "shifted_right": num.shift_right(C("c_custkey"), k % 8), "cubed": num.int_pow(k.cast("bigint"), 3), "root": r(F.pow(F.abs(a), F.lit(0.5))), "quotient": F.when(F.abs(q) != num.inf(), r(q, 9)), "cut": num.whole(a), "at_least": num.float_at_least(odd, F.lit(100.0)), "unequal": num.float_not_equal(odd, F.lit(100.0)), "less": num.float_greater(F.lit(100.0), odd), "ones": F.lit(1).cast("double")}
    return t("customer").select("c_custkey", *(c.alias(n) for n, c in made.items()))


@query("fn28_complex", """with z as (select l_orderkey, l_linenumber, l_discount * 5 as a, l_tax * 5 - 0.2 as b, 0.5 + l_tax as c, l_discount + 0.1 as d, cast(l_quantity as float) as q from lineitem),
m as (select *, ln(sqrt(a * a + b * b)) as lr, atan2(b, a) as th from z where a <> 0 or b <> 0)
select l_orderkey, l_linenumber, q as re32, round(a + c, 5) + 0.0 as add_re, round(b - d, 5) + 0.0 as sub_im, round(-b, 5) + 0.0 as conj_im, a = c and b = d as same, a <> c or b <> d as other, round(exp(a) * cos(b) - 1, 5) + 0.0 as expm1_re, round(atan2(b, 1 + a), 5) + 0.0 as log1p_im,
 round(exp(c * lr - d * th) * cos(c * th + d * lr), 4) + 0.0 as pow_re, round(exp(c * lr - d * th) * sin(c * th + d * lr), 4) + 0.0 as pow_im, round(sin(a) * cosh(b), 5) + 0.0 as sin_re, round(-sin(a) * sinh(b), 5) + 0.0 as cos_im, round(sin(2 * a) / (cos(2 * a) + cosh(2 * b)), 4) + 0.0 as tan_re,
 round(sinh(a) * cos(b), 5) + 0.0 as sinh_re, round(sinh(a) * sin(b), 5) + 0.0 as cosh_im, round(sin(2 * b) / (cosh(2 * a) + cos(2 * b)), 4) + 0.0 as tanh_im from m""")
def fn28_complex(t):
    z, w = num.complex_of(C("l_discount") * 5, C("l_tax") * 5 - 0.2), num.complex_of(0.5 + C("l_tax"), C("l_discount") + 0.1)
    power = num.complex_pow(z, w)
    made = {"add_re": num.complex_add(z, w)["re"], "sub_im": num.complex_sub(z, w)["im"], "conj_im": num.complex_conj(z)["im"], "expm1_re": num.complex_expm1(z)["re"], "log1p_im": num.complex_log1p(z)["im"], "sin_re": num.complex_sin(z)["re"], "cos_im": num.complex_cos(z)["im"], "sinh_re": num.complex_sinh(z)["re"], "cosh_im": num.complex_cosh(z)["im"]}
    coarse = {"pow_re": power["re"], "pow_im": power["im"], "tan_re": num.complex_tan(z)["re"], "tanh_im": num.complex_tanh(z)["im"]}
    rows = t("lineitem").filter((z["re"] != 0) | (z["im"] != 0))
    return rows.select("l_orderkey", "l_linenumber", num.complex_real(num.complex_of(C("l_quantity"), F.lit(0.0))).alias("re32"), num.complex_equal(z, w).alias("same"), num.complex_not_equal(z, w).alias("other"), *(r(c, 5).alias(n) for n, c in made.items()), *(r(c, 4).alias(n) for n, c in coarse.items()))


@query("ag11_steps", """with b as (select event_type, min(value) as lo, cast(ceil((max(value) - min(value)) / 5.0) - 1 as integer) as bins from events group by all),
n as (select event_type, case when value = lo + bins * 5.0 then bins - 1 else cast(floor((value - lo) / 5.0) as integer) end as bin, count(*) as n from events join b using (event_type) group by all)
select event_type, bin, round(lo + bin * 5.0 + 2.5, 6) as centre, coalesce(n, 0) as n from (select event_type, lo, cast(unnest(range(bins)) as integer) as bin from b) left join n using (event_type, bin)""")
def ag11_steps(t):
    return stats.step_histogram(t("events"), "value", 5.0, ["event_type"]).withColumn("centre", r(C("centre"), 6))


@query("ag15_mean_curve", f"with {HIST_SQL} select bin, round(avg(cdf), 6) as mean, count(*) as n from c group by bin")
def ag15_mean_curve(t):
    curves = stats.cdf(stats.histogram(t("events"), "value", 32, ["event_type"]), ["event_type"])
    return stats.mean_curves(curves, "bin", "cdf").withColumn("mean", r(C("mean"), 6))


@query("ag17_count_where", "select event_type, count(*) filter (value > 200) as hot, count(*) filter (value < 1) as dead from events group by all")
def ag17_count_where(t):
    return t("events").groupBy("event_type").agg(F.count_if(C("value") > 200).alias("hot"), F.count_if(C("value") < 1).alias("dead"))


@query("ag19_pair_record", f"""with {FRAMES_SQL}, q as (select a.stack_id, a.frame as i, b.frame as j, a.v as v, b.v as w from p a join p b on a.stack_id = b.stack_id and a.y = b.y and a.x = b.x and b.frame - a.frame between 1 and 2)
select stack_id, i, j, round(avg(v * w), 5) + 0.0 as mean_c, round(var_pop(v * w), 4) + 0.0 as var_c, round(max(v * w), 5) + 0.0 as max_c, round(sum(v * w) / sqrt(sum(v * v) * sum(w * w)), 5) + 0.0 as origin_c, round(avg(v), 5) + 0.0 as mean_i, round(stddev_pop(v), 5) as sd_i, round(avg(w), 5) + 0.0 as mean_j, round(stddev_pop(w), 5) as sd_j from q group by all""")
def ag19_pair_record(t):
    out = align.pair_record(frames.frame_pairs(stack(t), 2))
    return out.select("stack_id", "i", "j", *(r(C(c), 4 if c == "var_c" else 5).alias(c) for c in out.columns[3:]))


@query("ag21_place_normalised", f"with {FRAMES_SQL} select stack_id, frame, y, x, round((v - avg(v) over w) / stddev_pop(v) over w, 4) + 0.0 as v from p window w as (partition by stack_id, y, x)")
def ag21_place_normalised(t):
    return frames.place_normalised(pixels(t)).withColumn("v", r(C("v")))


@query("jn01_broadcast", f"with {FRAMES_SQL}, f as (select x, 1 + avg(abs(v)) as f from p group by x) select stack_id, frame, round(sum(2.5 * v * f), 4) + 0.0 as s from p join f using (x) group by all".replace("f as (select x, 1", "g as (select x, 1").replace("p join f using", "p join g using"))
def jn01_broadcast(t):
    p = pixels(t)
    row = p.groupBy("x").agg((1 + F.avg(F.abs("v"))).alias("f"))
    return frames.times_row(p, row).groupBy("stack_id", "frame").agg(r(F.sum(2.5 * C("v"))).alias("s"))


def pair_sql(on: str) -> str:
    dot = "list_dot_product(cast({0}.px as double[]), cast({1}.px as double[]))".format
    return f"with {FRAMES_SQL} select a.stack_id, a.frame as i, b.frame as j, round({dot('a', 'b')} / sqrt({dot('a', 'a')} * {dot('b', 'b')}), 4) + 0.0 as corr from f a join f b on a.stack_id = b.stack_id and {on}"


@query("jn03_first", pair_sql("a.frame = 0 and b.frame > 0"))
def jn03_first(t):
    return frames.correlations(frames.first_pairs(stack(t))).withColumn("corr", r(C("corr")))


@query("jn03_given", pair_sql("a.frame % 2 = 0 and b.frame = a.frame + 3"))
def jn03_given(t):
    f = stack(t)
    pairs = f.filter("frame % 2 = 0").select("stack_id", C("frame").alias("i"), (C("frame") + 3).alias("j"))
    return frames.correlations(frames.given_pairs(f, pairs)).withColumn("corr", r(C("corr")))


@query("wn08_lag", pair_sql("b.frame = a.frame + 6"))
def wn08_lag(t):
    return frames.correlations(frames.frame_pairs(stack(t), 1, start=5)).withColumn("corr", r(C("corr")))


@query("jn08_basename", r"""with b as (select page_id, regexp_extract(url, '([^/]*?)(?:\.[^./]*)?$', 1) as basename from pages)
select a.page_id, c.page_id as box_id, a.basename from b a join b c using (basename) where c.page_id % 3 = 0""")
def jn08_basename(t):
    left = t("pages").select("page_id", "url")
    boxes = left.filter("page_id % 3 = 0").select(C("page_id").alias("box_id"), F.concat(F.lit("boxes/"), lookup.basename(C("url")), F.lit(".box")).alias("path"))
    return lookup.by_basename(left, boxes, "url", "path").select("page_id", "box_id", "basename")


@query("jn11_mesh", "select n_nationkey, y, x from (select n_nationkey, n_regionkey, cast(unnest(range(n_regionkey + 2)) as integer) as y from nation), (select cast(unnest(range(3)) as integer) as x)")
def jn11_mesh(t):
    side = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    return t("nation").withColumn("y", side(C("n_regionkey") + 2)).withColumn("x", side(F.lit(3))).select("n_nationkey", "y", "x")


@query("wn02_dose", f"with {FRAMES_SQL}, d as (select stack_id, frame, 1 + frame % 3 * 0.5 as dose from f), s as (select *, 2 + sum(dose) over (partition by stack_id order by frame) as after from d) select stack_id, frame, round(after - dose, 4) as dose_before, round(after, 4) as dose_after from s")
def wn02_dose(t):
    f = stack(t).select("stack_id", "frame", (1 + C("frame") % 3 * 0.5).alias("dose"))
    return align.accumulated_dose(f, "dose", 2.0).select("stack_id", "frame", r(C("dose_before")).alias("dose_before"), r(C("dose_after")).alias("dose_after"))


@query("wn09_sections", r"""with l as (select doc_id, string_split(text, chr(10)) as ls from documents where text is not null), e as (select doc_id, cast(unnest(range(len(ls))) as integer) as line, unnest(ls) as value from l),
h as (select doc_id, line, last_value(case when contains(value, '.') then null else line end ignore nulls) over (partition by doc_id order by line) as head from e) select doc_id, head, count(*) as n from h where head is not null group by all""")
def wn09_sections(t):
    lines = tables.line_windows(t("documents").select("doc_id", "text"), "doc_id", "text", ~C("value").contains("."))
    return lines.groupBy("doc_id", "head").agg(F.count(F.lit(1)).alias("n"))


@query("so01_numeric_order", "select c_custkey, cast(regexp_extract(c_name, '([0-9]+)$', 1) as bigint) as number from customer order by number desc limit 100")
def so01_numeric_order(t):
    return t("customer").select("c_custkey", F.regexp_extract("c_name", "([0-9]+)$", 1).cast("bigint").alias("number")).orderBy(F.desc("number")).limit(100)


@query("so05_fft_size", """with c as (select distinct cast(2 ** a * 3 ** b * 5 ** c * 7 ** d as bigint) as size from (select unnest(range(1, 13)) as a), (select unnest(range(0, 8)) as b), (select unnest(range(0, 6)) as c), (select unnest(range(0, 5)) as d)),
n as (select distinct cast(p_size as bigint) * 37 as n from part) select p_partkey, cast(size as integer) as size from part join (select n, min(size) as size from n, c where size >= n group by n) on n = p_size * 37""")
def so05_fft_size(t):
    return t("part").select("p_partkey", fourier.next_fft_size(C("p_size") * 37, 4096).cast("int").alias("size"))


@query("so09_frames", f"with {FRAMES_SQL} select stack_id, y, x, round(sum(v), 4) + 0.0 as total from p where frame between 2 and 5 group by all")
def so09_frames(t):
    return pixels(t).filter(C("frame").between(2, 5)).groupBy("stack_id", "y", "x").agg(r(F.sum("v")).alias("total"))


@query("ar01_pad", f"with {FRAMES_SQL} select stack_id, frame, cast(yy as integer) as y, cast(xx as integer) as x, coalesce(round(v, 5), 0.0) + 0.0 as v from f, (select unnest(range(12)) as yy), (select unnest(range(10)) as xx) left join p on p.stack_id = f.stack_id and p.frame = f.frame and p.y = yy and p.x = xx".replace("select stack_id, frame, cast", "select f.stack_id, f.frame, cast"))
def ar01_pad(t):
    return frames.as_pixels(fourier.pad(stack(t), NY, NX, 12, 10), 10).withColumn("v", r(C("v"), 5))


@query("ar02_crop", f"with {FRAMES_SQL} select stack_id, frame, y, x, round(v, 5) + 0.0 as v from p where y < 5 and x < 6")
def ar02_crop(t):
    return frames.crop(pixels(t), 5, 6).withColumn("v", r(C("v"), 5))


@query("ar03_fourier_crop", f"""with {FRAMES_SQL}, k as (select ky, kx from (select unnest([-2, -1, 0, 1]) as ky), (select unnest([-2, -1, 0, 1]) as kx)),
z as (select stack_id, frame, ky, kx, sum(v * cos(2 * pi() * (ky * y + kx * x) / 8)) as re, -sum(v * sin(2 * pi() * (ky * y + kx * x) / 8)) as im from p, k group by all)
select stack_id, frame, cast(y as integer) as y, cast(x as integer) as x, round(sum(re * cos(2 * pi() * (ky * y + kx * x) / 4) - im * sin(2 * pi() * (ky * y + kx * x) / 4)) / 64, 5) + 0.0 as v from z, (select unnest(range(4)) as y), (select unnest(range(4)) as x) group by all""")
def ar03_fourier_crop(t):
    return frames.as_pixels(fourier.fourier_crop(stack(t), NY, NX, 4, 4), 4).withColumn("v", r(C("v"), 5))


LIMITS_SQL = FRAMES_SQL + """, t as (select stack_id, frame, stack_id % 3 - frame % 4 * 0.6 as ty, frame % 5 * 0.5 - 0.75 as tx from f),
l as (select stack_id, greatest(ceil(max(ty)), 0) as top, greatest(ceil(max(tx)), 0) as lft, greatest(-floor(min(ty)), 0) as bottom, greatest(-floor(min(tx)), 0) as rgt from t group by stack_id)"""


@query("ar06_crop_limits", f"with {LIMITS_SQL} select p.stack_id, frame, cast(y - top as integer) as y, cast(x - lft as integer) as x, round(v, 5) + 0.0 as v from p join l on p.stack_id = l.stack_id where y >= top and y < 8 - bottom and x >= lft and x < 8 - rgt")
def ar06_crop_limits(t):
    f = stack(t)
    limits = frames.crop_limits(f.select("stack_id", (C("stack_id") % 3 - C("frame") % 4 * 0.6).alias("ty"), (C("frame") % 5 * 0.5 - 0.75).alias("tx")))
    return frames.crop_to_limits(frames.as_pixels(f, NX), limits, NY, NX).withColumn("v", r(C("v"), 5))


@query("ar09_ravel", f"with {PAIRS_SQL} select stack_id, cast(i as bigint) * 512 + j as pos, i, j from c")
def ar09_ravel(t):
    edges = frames.ravel(frames.frame_pairs(stack(t), 5).select("stack_id", "i", "j"), 512)
    return frames.unravel(edges.select("stack_id", "pos"), 512, ahead=True)


@query("ar12_nearest", f"""with {FRAMES_SQL}, g as (select *, cast(floor(least(greatest(y + 0.6, 0), 7)) as integer) as v_, cast(floor(least(greatest(x - 1.3, 0), 7)) as integer) as u_ from p)
select g.stack_id, g.frame, g.y, g.x, round(q.v, 5) + 0.0 as v from g join p q on q.stack_id = g.stack_id and q.frame = g.frame and q.y = v_ and q.x = u_""")
def ar12_nearest(t):
    return long(local.resample_nearest(stack(t), 0.6, -1.3, NY, NX))


@query("ar13_magic_halved", f"""with {FRAMES_SQL}, k as (select ky, kx, ([0.25, 0.75, 0.75, 0.25])[ky + 1] * ([0.25, 0.75, 0.75, 0.25])[kx + 1] / 4 as w from (select unnest(range(4)) as ky), (select unnest(range(4)) as kx)),
o as (select y, x from (select unnest(range(4)) as y), (select unnest(range(4)) as x))
select p.stack_id, p.frame, cast(o.y as integer) as y, cast(o.x as integer) as x, round(sum(w * v), 5) + 0.0 as v from o, k join p on p.y = least(greatest(2 * o.y + ky - 1, 0), 7) and p.x = least(greatest(2 * o.x + kx - 1, 0), 7) group by all""")
def ar13_magic_halved(t):
    return frames.as_pixels(fourier.magic_halved(stack(t), NY, NX), 4).withColumn("v", r(C("v"), 5))


@query("ar13_magic_doubled", f"""with {FRAMES_SQL}, o as (select y, x from (select unnest(range(16)) as y), (select unnest(range(16)) as x)), n as (select y, x, unnest([0, 1]) as a from o), m as (select y, x, a, unnest([0, 1]) as b from n),
g as (select y, x, case when a = 0 then y // 2 else least(greatest(y // 2 + case when y % 2 = 0 then -1 else 1 end, 0), 7) end as v_, case when b = 0 then x // 2 else least(greatest(x // 2 + case when x % 2 = 0 then -1 else 1 end, 0), 7) end as u_, (case when a = 0 then 0.75 else 0.25 end) * (case when b = 0 then 0.75 else 0.25 end) as w from m)
select p.stack_id, p.frame, cast(g.y as integer) as y, cast(g.x as integer) as x, round(sum(w * v), 5) + 0.0 as v from g join p on p.y = v_ and p.x = u_ group by all""")
def ar13_magic_doubled(t):
    return frames.as_pixels(fourier.magic_doubled(stack(t), NY, NX), 16).withColumn("v", r(C("v"), 5))


@query("ar16_apodization", f"""with {FRAMES_SQL}, w as (select stack_id, frame, v, (y - 4) / 4.0 as b, (x - 4) / 4.0 as a, ((y - 4) / 4.0) ** 2 + ((x - 4) / 4.0) ** 2 as r2 from p)
select stack_id, frame, round(sum(case when r2 <= 1 then v * (0.5 + 0.5 * cos(pi() * sqrt(r2))) else 0 end), 4) + 0.0 as hann, round(sum(case when r2 <= 1 then v * (0.54 + 0.46 * cos(pi() * sqrt(r2))) else 0 end), 4) + 0.0 as hamming,
 round(sum(v * (0.5 + 0.5 * cos(pi() * a)) * (0.5 + 0.5 * cos(pi() * b))), 4) + 0.0 as hann_square, round(sum(v * (0.54 + 0.46 * cos(pi() * a)) * (0.54 + 0.46 * cos(pi() * b))), 4) + 0.0 as hamming_square, round(sum(v * exp(-r2)), 4) + 0.0 as gauss,
 round(sum(case when r2 <= 4 then v * exp(-r2) else 0 end), 4) + 0.0 as gauss_trunc, round(sum(v * sqrt(1 / (1 + r2 ** 4))), 4) + 0.0 as butter, round(sum(v * sqrt(1 / (1 + abs(a) ** 4)) * sqrt(1 / (1 + abs(b) ** 4))), 4) + 0.0 as butter_square from w group by all""")
def ar16_apodization(t):
    kinds = ["hann", "hamming", "hann_square", "hamming_square", "gauss", "gauss_trunc", "butter", "butter_square"]
    return pixels(t).groupBy("stack_id", "frame").agg(*(r(F.sum(C("v") * local.apodization(k, C("y"), C("x"), NY, NX, 4))).alias(k) for k in kinds))


@query("ar17_transpose", f"with {FRAMES_SQL} select stack_id, frame, x as y, y as x, round(v, 5) + 0.0 as v from p")
def ar17_transpose(t):
    return frames.transpose(pixels(t)).withColumn("v", r(C("v"), 5))


TILES_SQL = FRAMES_SQL + """, o as (select ty, tx from (select unnest(range(3)) as ty), (select unnest(range(3)) as tx)),
q as (select stack_id, frame, cast(ty as integer) as tile_y, cast(tx as integer) as tile_x, cast(y - 2 * ty as integer) as y, cast(x - 2 * tx as integer) as x, v from p, o where y between 2 * ty and 2 * ty + 3 and x between 2 * tx and 2 * tx + 3)"""


@query("ar18_tiles", f"with {TILES_SQL} select stack_id, frame, tile_y, tile_x, y, x, round(v, 5) + 0.0 as v from q")
def ar18_tiles(t):
    return frames.tiles(pixels(t), 4, 2, NY, NX).withColumn("v", r(C("v"), 5))


@query("sp16_tiled_frc", f"""with {TILES_SQL}, h as (select stack_id, frame % 2 as half, tile_y, tile_x, y, x, sum(v * case when sqrt(((y - 2) / 2.0) ** 2 + ((x - 2) / 2.0) ** 2) <= 1 then 0.5 * (1 + cos(pi() * sqrt(((y - 2) / 2.0) ** 2 + ((x - 2) / 2.0) ** 2))) else 0 end) as v from q group by all),
k as (select ky, kx from (select unnest(range(4)) as ky), (select unnest(range(4)) as kx)), z as (select stack_id, half, tile_y, tile_x, ky, kx, sum(v * cos(2 * pi() * (ky * y + kx * x) / 4)) as re, -sum(v * sin(2 * pi() * (ky * y + kx * x) / 4)) as im from h, k group by all),
m as (select a.stack_id, a.ky, a.kx, avg((a.re * b.re + a.im * b.im) / (sqrt(a.re ** 2 + a.im ** 2) * sqrt(b.re ** 2 + b.im ** 2))) as v from z a join z b on a.stack_id = b.stack_id and a.tile_y = b.tile_y and a.tile_x = b.tile_x and a.ky = b.ky and a.kx = b.kx and a.half = 0 and b.half = 1 group by all),
d as (select stack_id, v as dc from m where ky = 0 and kx = 0), i as (select stack_id, sqrt(((ky + 2) % 4 - 2) ** 2 + ((kx + 2) % 4 - 2) ** 2) as r, case when abs(dc) > 1e-9 then v / dc end as v from m join d using (stack_id)),
s as (select stack_id, v, cast(floor(r) as bigint) as radius, 1 - (r - floor(r)) as w from i union all select stack_id, v, cast(floor(r) as bigint) + 1, r - floor(r) from i)
select stack_id, radius as k, round(sum(v * w) / sum(w), 3) + 0.0 as frc from s where w > 0 group by all""")
def sp16_tiled_frc(t):
    f = stack(t)
    halves = align.stack_sums(f.withColumn("stack_id", F.struct("stack_id", (C("frame") % 2).alias("half"))))
    ready = halves.select(C("stack_id.stack_id").alias("stack_id"), C("stack_id.half").alias("half"), C("total").alias("px"))
    return align.tiled_ring_correlation(ready, 4, 2, NY, NX).withColumn("frc", r(C("frc"), 3))


def _gauss(d: str, deviation: float) -> str:
    return f"exp(-0.5 * ({d} / {deviation}) ** 2)"


@query("sp24_low_pass", f"""with {FRAMES_SQL}, k as (select dy, dx, {_gauss('dy', 0.6)} * {_gauss('dx', 0.6)} as w from (select unnest(range(-2, 3)) as dy), (select unnest(range(-2, 3)) as dx)), n as (select sum(w) as s from k),
g as (select o.y, o.x, w / s as w, case when o.y + dy < 0 then -1 - o.y - dy when o.y + dy > 7 then 15 - o.y - dy else o.y + dy end as v_, case when o.x + dx < 0 then -1 - o.x - dx when o.x + dx > 7 then 15 - o.x - dx else o.x + dx end as u_
 from (select y, x from (select unnest(range(8)) as y), (select unnest(range(8)) as x)) o, k, n)
select p.stack_id, p.frame, cast(g.y as integer) as y, cast(g.x as integer) as x, round(sum(w * v), 5) + 0.0 as v from g join p on p.y = v_ and p.x = u_ group by all""")
def sp24_low_pass(t):
    return long(fourier.gaussian(stack(t), NY, NX, 0.6))


@query("sp31_limits", "select p_partkey, round(least(p_size ** 2, 625.0) * sin(0.5 + p_size / 50.0) ** 2, 4) as lattice, round(p_retailprice * 8 / 3.5, 4) as radius from part")
def sp31_limits(t):
    radius = align.filter_radius(3.5, 1.0, NY, NX)[0]
    return t("part").select("p_partkey", r(align.lattice_limit(0.5 + C("p_size") / 50.0, C("p_size").cast("double"), F.lit(25.0))).alias("lattice"), r(C("p_retailprice") * radius).alias("radius"))


