"""The registered queries of the array, table and stack operators over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackweave.functions import numeric as num
from stackweave.operators import blocks, fourier, frames, lookup, stats, trajectory
from stackweave.streaming import quiet

NY = NX = 8
C = F.col
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

FRAMES_SQL = """f as (select label as stack_id, row_number() over (partition by label order by vec_id) - 1 as frame, embedding as px from embeddings),
p as (select stack_id, frame, i // 8 as y, i % 8 as x, cast(px[i + 1] as double) as v from f, (select unnest(range(64)) as i))"""


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = lambda spark, sf_dir: function(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
        if sql:
            ORACLE_SQL[name] = sql
        return function

    return add


def r(c, digits: int = 4):
    """Rounded alike in both engines, without -0.0."""
    return F.round(c, digits) + F.lit(0.0)


def stack(t) -> DataFrame:
    return frames.as_frames(t("embeddings"), "label", "vec_id", "embedding")


def pixels(t) -> DataFrame:
    return frames.as_pixels(stack(t), NX)


@query("ex01_project", """
select l_returnflag, l_linestatus, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) + 0.0 as charge, count(*) as n
from lineitem where l_quantity > 24 and l_discount < 0.07 group by all""")
def ex01_project(t):
    price = C("l_extendedprice") * (1 - C("l_discount")) * (1 + C("l_tax"))
    kept = t("lineitem").filter(num.float_greater(C("l_quantity"), F.lit(24.0)) & num.float_greater(F.lit(0.07), C("l_discount")))
    return kept.groupBy("l_returnflag", "l_linestatus").agg(r(F.sum(price), 2).alias("charge"), F.count(F.lit(1)).alias("n"))


@query("ex06_polynomial", "select l_orderkey, l_linenumber, round(((0.25 * l_quantity + 0.75) * l_quantity - 1.5) * l_quantity - 2, 4) + 0.0 as p from lineitem")
def ex06_polynomial(t):
    a = C("l_quantity")
    return t("lineitem").select("l_orderkey", "l_linenumber", r(((0.25 * a + 0.75) * a - 1.5) * a - 2).alias("p"))


@query("ex11_where", "select l_orderkey, l_linenumber, case when l_discount > 0.05 then l_extendedprice * l_discount else 0.0 end + 0.0 as w from lineitem")
def ex11_where(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", (F.when(C("l_discount") > 0.05, C("l_extendedprice") * C("l_discount")).otherwise(0.0) + 0.0).alias("w"))


@query("fn_math", """
select p_partkey, round(sqrt(x), 4) as sqrt_x, round(sin(x), 4) + 0.0 as sin_x, round(cos(x), 4) + 0.0 as cos_x, round(tan(u), 4) + 0.0 as tan_u, round(asin(u), 4) as asin_u, round(acos(u), 4) as acos_u, round(atan(x), 4) as atan_x,
 round(sinh(u), 4) as sinh_u, round(cosh(u), 4) as cosh_u, round(tanh(u), 4) as tanh_u, round(asinh(x), 4) as asinh_x, round(acosh(1 + x), 4) as acosh_x, round(atanh(u / 2), 4) as atanh_u, round(atan2(u, x), 4) as atan2_ux,
 round(ln(x), 4) as log_x, round(ln(1 + u), 4) as log1p_u, round(log10(x), 4) as log10_x, round(exp(u), 4) as exp_u, round(exp(u) - 1, 4) as expm1_u, abs(p_size - 25.0) as abs_s
from (select p_partkey, p_size, p_retailprice as x, p_size / 51.0 as u from part)""")
def fn_math(t):
    x, u = C("p_retailprice"), C("p_size") / 51.0
    f = {"sqrt_x": F.sqrt(x), "sin_x": F.sin(x), "cos_x": F.cos(x), "tan_u": F.tan(u), "asin_u": F.asin(u), "acos_u": F.acos(u), "atan_x": F.atan(x), "sinh_u": F.sinh(u), "cosh_u": F.cosh(u), "tanh_u": F.tanh(u), "asinh_x": F.asinh(x), "acosh_x": F.acosh(1 + x), "atanh_u": F.atanh(u / 2), "atan2_ux": F.atan2(u, x), "log_x": num.log(x), "log1p_u": num.log1p(u), "log10_x": num.log10(x), "exp_u": F.exp(u), "expm1_u": F.expm1(u)}
    return t("part").select("p_partkey", *(r(c).alias(n) for n, c in f.items()), F.abs(C("p_size").cast("double") - 25.0).alias("abs_s"))


@query("fn_mod", """
select c_custkey, round(c_acctbal - 7.5 * floor(c_acctbal / 7.5), 4) + 0.0 as floor_mod, round(c_acctbal - 7.5 * trunc(c_acctbal / 7.5), 4) + 0.0 as trunc_mod,
 case when c_custkey % 3 = 0 then 0 else c_custkey // greatest(c_custkey % 3, 1) end as int_quotient, case when c_custkey % 3 = 0 then 0 else c_custkey % greatest(c_custkey % 3, 1) end as int_rest from customer""")
def fn_mod(t):
    a, b, k = C("c_acctbal"), F.lit(7.5), C("c_custkey") % 3
    return t("customer").select("c_custkey", r(num.floor_mod(a, b)).alias("floor_mod"), r(num.fmod(a, b)).alias("trunc_mod"), num.int_div(C("c_custkey"), k).alias("int_quotient"), num.int_mod(C("c_custkey"), k).alias("int_rest"))


@query("fn_complex", """
select l_orderkey, l_linenumber, round(a * c - b * d, 6) + 0.0 as mul_re, round(a * d + b * c, 6) + 0.0 as mul_im, round((a * c + b * d) / (c * c + d * d), 5) + 0.0 as div_re, round(sqrt(a * a + b * b), 4) as modulus
from (select l_orderkey, l_linenumber, l_quantity as a, l_discount as b, 1 + l_tax as c, l_discount - l_tax as d from lineitem)""")
def fn_complex(t):
    z, w = num.complex_of(C("l_quantity"), C("l_discount")), num.complex_of(1 + C("l_tax"), C("l_discount") - C("l_tax"))
    p = num.complex_mul(z, w)
    return t("lineitem").select("l_orderkey", "l_linenumber", r(p["re"], 6).alias("mul_re"), r(p["im"], 6).alias("mul_im"), r(num.complex_div(z, w)["re"], 5).alias("div_re"), r(num.complex_abs(z)["re"]).alias("modulus"))


@query("ex_bool_string", "select doc_id, contains(text, 'the') and not contains(text, '|') as plain, lang > 'de' as later from documents")
def ex_bool_string(t):
    return t("documents").select("doc_id", (F.contains("text", F.lit("the")) & ~F.contains("text", F.lit("|"))).alias("plain"), (C("lang") > "de").alias("later"))


@query("ag01_sum_axis", f"with {FRAMES_SQL} select stack_id, frame, y, round(sum(v), 4) + 0.0 as s from p group by all")
def ag01_sum_axis(t):
    return pixels(t).groupBy("stack_id", "frame", "y").agg(r(F.sum("v")).alias("s"))


@query("ag02_prod_axis", f"with {FRAMES_SQL} select stack_id, frame, x, round(product(1 + v / 10), 4) + 0.0 as m from p group by all")
def ag02_prod_axis(t):
    return pixels(t).groupBy("stack_id", "frame", "x").agg(r(F.product(1 + C("v") / 10)).alias("m"))


@query("ag03_project_frames", f"""with {FRAMES_SQL} select stack_id, y, x, round(sum(v), 4) + 0.0 as total, round(max(v), 4) + 0.0 as most, round(var_pop(v), 4) + 0.0 as variance,
 round(sum(case when frame % 2 = 0 then v else 0 end), 4) + 0.0 as even, round(sum(case when frame % 2 = 1 then v else 0 end), 4) + 0.0 as odd from p group by all""")
def ag03_project_frames(t):
    return blocks.projections(stack(t), NX).select("stack_id", "y", "x", *(r(C(c)).alias(c) for c in ("total", "most", "variance", "even", "odd")))


@query("ag07_weighted", "select l_suppkey, round(sum(w * e) / sum(w), 4) as w_mean, round(sqrt(greatest(sum(w * e * e) / sum(w) - (sum(w * e) / sum(w)) ** 2, 0)), 4) as w_std from (select l_suppkey, l_quantity as e, greatest(l_discount, 1e-6) as w from lineitem) group by all")
def ag07_weighted(t):
    out = stats.weighted_mean_std(t("lineitem"), "l_quantity", "l_discount", ["l_suppkey"])
    return out.select("l_suppkey", r(C("w_mean")).alias("w_mean"), r(C("w_std")).alias("w_std"))


@query("ag09_peak", f"with {FRAMES_SQL} select stack_id, frame, y, x, round(v, 5) + 0.0 as v from p qualify row_number() over (partition by stack_id, frame order by v desc, y, x) = 1")
def ag09_peak(t):
    return frames.peak(pixels(t)).withColumn("v", r(C("v"), 5))


HIST_SQL = """b as (select event_type, min(value) as lo, max(value) as hi from events group by all),
n as (select event_type, least(case when value = hi then 31 else cast(floor((value - lo) / ((hi - lo) / 32)) as integer) end, 31) as bin, count(*) as n from events join b using (event_type) group by all),
h as (select event_type, bin, lo + bin * (hi - lo) / 32 as left_edge, coalesce(n, 0) as n from (select event_type, lo, hi, cast(unnest(range(32)) as integer) as bin from b) left join n using (event_type, bin)),
c as (select *, sum(n) over (partition by event_type order by bin) / sum(n) over (partition by event_type) as cdf from h)"""


@query("ag10_histogram", f"with {HIST_SQL} select event_type, bin, round(left_edge, 9) + 0.0 as left_edge, n from h")
def ag10_histogram(t):
    return stats.histogram(t("events"), "value", 32, ["event_type"]).withColumn("left_edge", r(C("left_edge"), 9))


@query("ag12_limits", f"with {HIST_SQL} select event_type, round(min(left_edge) filter (cdf > 0.05), 9) + 0.0 as lo_limit, round(min(left_edge) filter (cdf > 0.95), 9) + 0.0 as hi_limit from c group by all")
def ag12_limits(t):
    out = stats.limits(stats.histogram(t("events"), "value", 32, ["event_type"]), 0.05, 0.95, ["event_type"])
    return out.select("event_type", r(C("lo_limit"), 9).alias("lo_limit"), r(C("hi_limit"), 9).alias("hi_limit"))


@query("wn03_cdf", f"with {HIST_SQL} select event_type, bin, round(cdf, 6) as cdf from c")
def wn03_cdf(t):
    return stats.cdf(stats.histogram(t("events"), "value", 32, ["event_type"]), ["event_type"]).select("event_type", "bin", r(C("cdf"), 6).alias("cdf"))


@query("ag13_sigma", "select event_type, round(avg(value) - 2 * stddev_pop(value), 4) as lo_limit, round(avg(value) + 2 * stddev_pop(value), 4) as hi_limit from events group by all")
def ag13_sigma(t):
    out = stats.sigma_limits(t("events"), "value", 2, ["event_type"])
    return out.select("event_type", r(C("lo_limit")).alias("lo_limit"), r(C("hi_limit")).alias("hi_limit"))


@query("ag14_radial", f"""with {FRAMES_SQL}, q as (select *, sqrt((y - 4) ** 2 + (x - 4) ** 2) as r from p),
s as (select stack_id, frame, v, cast(floor(r) as bigint) as radius, 1 - (r - floor(r)) as w from q union all select stack_id, frame, v, cast(floor(r) as bigint) + 1, r - floor(r) from q)
select stack_id, frame, radius, round(sum(v * w) / sum(w), 4) + 0.0 as mean from s where w > 0 group by all""")
def ag14_radial(t):
    return blocks.radial_means(stack(t), NY, NX).withColumn("mean", r(C("mean")))


@query("ag18_centroid", "select event_id, round(value - avg(value) over (partition by user_id), 7) + 0.0 as centred from events")
def ag18_centroid(t):
    return trajectory.centred(t("events"), "user_id", "value").select("event_id", r(C("centred"), 7).alias("centred"))


@query("wn01_cumsum", "select event_id, round(-sum(value) over (partition by user_id order by ts, event_id), 4) + 0.0 as translation from events")
def wn01_cumsum(t):
    return trajectory.cumulative(t("events"), "user_id", ["ts", "event_id"], "value").select("event_id", r(C("translation")).alias("translation"))


@query("wn04_velocity", """select event_id, round(coalesce((b + a) / 2, b, a, 0), 4) as velocity from (select event_id, abs(value - lag(value) over w) as b, abs(lead(value) over w - value) as a from events window w as (partition by user_id order by ts, event_id))""")
def wn04_velocity(t):
    return trajectory.velocity(t("events"), "user_id", ["ts", "event_id"], "value").select("event_id", r(C("velocity")).alias("velocity"))


PAIRS_SQL = FRAMES_SQL + """, c as (select a.stack_id, a.frame as i, b.frame as j, list_dot_product(cast(a.px as double[]), cast(b.px as double[])) / sqrt(list_dot_product(cast(a.px as double[]), cast(a.px as double[])) * list_dot_product(cast(b.px as double[]), cast(b.px as double[]))) as corr
 from f a join f b on a.stack_id = b.stack_id and b.frame - a.frame between 1 and 5)"""


@query("jn03_band", f"with {PAIRS_SQL} select stack_id, i, j, round(corr, 4) + 0.0 as corr from c")
def jn03_band(t):
    return frames.correlations(frames.frame_pairs(stack(t), 5)).withColumn("corr", r(C("corr")))


@query("jn04_auto", f"with {PAIRS_SQL} select stack_id, i, j from (select *, coalesce(max(cast(corr <= -0.1 as integer)) over (partition by stack_id, i order by j rows between unbounded preceding and 1 preceding), 0) as failed from c) where failed = 0")
def jn04_auto(t):
    return frames.auto_band(frames.correlations(frames.frame_pairs(stack(t), 5)), -0.1).select("stack_id", "i", "j")


@query("jn07_lookup", """select doc_id, lang, coalesce(a.doc_id_used, b.doc_id_used) as found_id, coalesce(a.quality, b.quality) as quality from (select doc_id, lang from documents) d
 left join (select doc_id as doc_id_used, quality from labels) a on a.doc_id_used = d.doc_id left join (select doc_id as doc_id_used, quality from labels) b on b.doc_id_used = d.doc_id - 1 where coalesce(a.quality, b.quality) is not null""")
def jn07_lookup(t):
    right = t("labels").select(C("doc_id").alias("found_id"), "quality")
    return lookup.lookup(t("documents").select("doc_id", "lang"), right, "found_id", C("doc_id"), C("doc_id") - 1)


@query("jn10_unknown", "select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders)")
def jn10_unknown(t):
    return lookup.unknown(t("customer").select("c_custkey", "c_name"), t("orders"), "c_custkey", "o_custkey")


@query("so03_first_of_state", "select o_orderstatus, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_orderstatus order by o_totalprice desc, o_orderkey) = 1")
def so03_first_of_state(t):
    return lookup.first_of_state(t("orders"), "o_orderstatus", "o_totalprice", "o_orderkey")


@query("se01_union", "select n_name as name, 'nation' as kind from nation where n_name not like '%RU%' union all select r_name, 'region' from region")
def se01_union(t):
    a = t("nation").filter(~C("n_name").contains("RU")).select(C("n_name").alias("name"), F.lit("nation").alias("kind"))
    return a.unionByName(t("region").select(C("r_name").alias("name"), F.lit("region").alias("kind")))


def moved(name: str, y: str, x: str, where: str = "true") -> str:
    return f"with {FRAMES_SQL} select stack_id, frame, {y} as y, {x} as x, round(v, 5) + 0.0 as v from p where {where}"


@query("ar04_roll", moved("roll", "(y + 3) % 8", "(x + 6) % 8"))
def ar04_roll(t):
    return frames.roll(pixels(t), 3, -2, NY, NX).withColumn("v", r(C("v"), 5))


@query("ar05_shift_crop", moved("shift", "y + 2", "x - 1", "y + 2 < 8 and x >= 1"))
def ar05_shift_crop(t):
    return frames.shift_crop(pixels(t), 2, -1, NY, NX).withColumn("v", r(C("v"), 5))


@query("ar07_rot90", moved("rot", "7 - x", "y"))
def ar07_rot90(t):
    return frames.rot90(pixels(t), NX).withColumn("v", r(C("v"), 5))


@query("ar08_fftshift", moved("fftshift", "(y + 4) % 8", "(x + 4) % 8"))
def ar08_fftshift(t):
    return frames.fftshift(pixels(t), NY, NX).withColumn("v", r(C("v"), 5))


@query("ar14_block_sum", f"with {FRAMES_SQL} select stack_id, frame, y // 2 as y, x // 2 as x, round(sum(v), 4) + 0.0 as v from p group by all")
def ar14_block_sum(t):
    return frames.block_sum(pixels(t), 2).withColumn("v", r(C("v")))


@query("ar16_hann", f"with {FRAMES_SQL} select stack_id, frame, round(sum(v * 0.25 * (1 - cos(2 * pi() * y / 7)) * (1 - cos(2 * pi() * x / 7))), 4) + 0.0 as s from p group by all")
def ar16_hann(t):
    w = frames.hann_weight(C("y"), C("x"), NY, NX)
    return pixels(t).groupBy("stack_id", "frame").agg(r(F.sum(C("v") * w)).alias("s"))


@query("sp15_incoherent", f"""with {FRAMES_SQL}, k as (select a.ky, b.kx from (select unnest(range(8)) as ky) a, (select unnest(range(8)) as kx) b),
z as (select stack_id, frame, ky, kx, sum(v * cos(2 * pi() * (ky * y + kx * x) / 8)) as re, sum(v * sin(2 * pi() * (ky * y + kx * x) / 8)) as im from p, k group by all)
select stack_id, ky, kx, round(avg(sqrt(re * re + im * im)), 4) as magnitude from z group by all""")
def sp15_incoherent(t):
    return fourier.incoherent_magnitude(stack(t), NY, NX).withColumn("magnitude", r(C("magnitude")))


@query("sp05_pair_shifts", f"""with {FRAMES_SQL}, m as (select stack_id, frame, y, x, v - avg(v) over (partition by stack_id, frame) as v from p), d as (select sy, sx from (select unnest(range(-4, 4)) as sy), (select unnest(range(-4, 4)) as sx)),
c as (select a.stack_id, a.frame as i, b.frame as j, sy, sx, sum(a.v * b.v) as c from m a join m b on a.stack_id = b.stack_id and b.frame - a.frame between 1 and 3, d where a.y = (b.y + sy + 8) % 8 and a.x = (b.x + sx + 8) % 8 group by all),
s as (select stack_id, i, j, (max(c) - avg(c)) / stddev_pop(c) as peaksig, arg_max(sy, c) as dy, arg_max(sx, c) as dx from c group by all)
select stack_id, i, j, cast(dy as integer) as dy, cast(dx as integer) as dx, round(peaksig, 4) as peaksig from s""")
def sp05_pair_shifts(t):
    return fourier.pair_shifts(frames.frame_pairs(stack(t), 3), NY, NX).withColumn("peaksig", r(C("peaksig")))


@query("st02_quiet", """with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as new from events),
s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from g)
select user_id, min(ts) as began, max(ts) + interval 30 minute as stable_at, count(*) as n from s group by user_id, k""")
def st02_quiet(t):
    return quiet.quiet_sessions(t("events"), "user_id", "ts", "30 minutes")
