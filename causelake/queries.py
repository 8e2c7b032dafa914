"""Driver queries of the causal engine on the star-schema tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causelake.functions import transforms as tf
from causelake.graphs.dag import Admg, Dag
from causelake.operators import estimate as est
from causelake.operators import reduce as red
from causelake.operators import series as ser
from causelake.plans import expr
from causelake.plans import identify as idf

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 4, **other: int) -> DataFrame:
    """Doubles rounded (without negative zero) so that the order of sums does not show."""
    return df.select(*[(F.round(c, other.get(c, digits)) + F.lit(0.0)).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


def orders_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: treatment (high priority), outcome (price), covariates of the customer."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return joined.select(
        "o_orderkey", "o_custkey", F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("double").alias("t"), F.col("o_totalprice").alias("y"),
        F.col("c_mktsegment").alias("seg"), F.col("n_regionkey").alias("region"), F.col("c_acctbal").alias("acct"),
        (F.col("o_orderstatus") == "F").cast("int").alias("yb"), (F.col("n_regionkey") <= 1).cast("double").alias("z"),
    )


BASE = """base as (
  select o_orderkey, o_custkey, case when o_orderpriority in ('1-URGENT', '2-HIGH') then 1.0 else 0.0 end::double as t, o_totalprice as y,
         c_mktsegment as seg, n_regionkey as region, c_acctbal as acct,
         case when o_orderstatus = 'F' then 1 else 0 end as yb, case when n_regionkey <= 1 then 1.0 else 0.0 end::double as z
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)"""
MOMENTS = """s as (
  select count(*)::double as n, var_pop(t) as vt, var_pop(acct) as vz, var_pop(y) as vy, covar_pop(t, y) as ty, covar_pop(t, acct) as tz,
         covar_pop(acct, y) as zy, avg(t) as mt, avg(acct) as mz, avg(y) as my from base),
b as (select *, (ty * vz - tz * zy) / (vt * vz - tz * tz) as b1, (zy * vt - tz * ty) / (vt * vz - tz * tz) as b2 from s)"""
RESIDUALS = """e as (
  select o_custkey, base.y - my - b1 * (base.t - mt) - b2 * (acct - mz) as u, (base.t - mt) - tz / vz * (acct - mz) as x, n
  from base cross join b)"""


@query(f"""with {BASE}, {MOMENTS}
select round(b1, 4) as effect, round(sqrt(n * (vy - b1 * ty - b2 * zy) / (n - 3) * vz / (n * (vt * vz - tz * tz))), 4) as se, n::bigint as n from b""")
def linear_adjustment_ate(spark, sf_dir):
    g = Dag(["acct", "t", "y"], [("acct", "t"), ("acct", "y"), ("t", "y")])
    z = idf.backdoor(g, "t", "y").adjustment
    return rounded(est.linear_adjustment(orders_frame(spark, sf_dir), "t", "y", z))


@query(f"""with {BASE}, {MOMENTS}, {RESIDUALS}
select round((select b1 from b), 4) as effect, round(sqrt(max(n) / (max(n) - 3) * sum(x * x * u * u)) / sum(x * x), 4) as se, count(*) as n from e""")
def linear_adjustment_hc1(spark, sf_dir):
    return rounded(est.linear_adjustment(orders_frame(spark, sf_dir), "t", "y", ["acct"], se="HC1"))


@query(f"""with {BASE}, {MOMENTS}, {RESIDUALS}, g as (select o_custkey, sum(x * u) as s from e group by 1),
m as (select sum(s * s) as meat, count(*)::double as k from g), x as (select sum(x * x) as xx, max(n) as n from e)
select round((select b1 from b), 4) as effect, round(sqrt(k / (k - 1) * (n - 1) / (n - 3) * meat) / xx, 4) as se, n::bigint as n from m cross join x""")
def linear_adjustment_cluster(spark, sf_dir):
    return rounded(est.linear_adjustment(orders_frame(spark, sf_dir), "t", "y", ["acct"], se="cluster", clusters=["o_custkey"]))


CELLS = f"""{BASE}, cells as (
  select seg, region, greatest(0.01, least(0.99, avg(t))) as e, avg(case when t > 0.5 then y end) as m1, avg(case when t <= 0.5 then y end) as m0
  from base group by 1, 2), w as (select base.*, e, m1, m0 from base join cells using (seg, region))"""


def _scored(spark, sf_dir):
    return est.arm_means(est.saturated_propensity(orders_frame(spark, sf_dir), "t", ["seg", "region"]), "t", "y", ["seg", "region"])


def _ipw_sql(w1: str, w0: str) -> str:
    return f"""with {CELLS} select round(sum(case when t > 0.5 then {w1} * y end) / sum(case when t > 0.5 then {w1} end)
  - sum(case when t <= 0.5 then {w0} * y end) / sum(case when t <= 0.5 then {w0} end), 4) as effect, count(*) as n from w"""


@query(_ipw_sql("1 / e", "1 / (1 - e)"))
def ipw_ate(spark, sf_dir):
    return rounded(est.ipw(_scored(spark, sf_dir), "t", "y"))


@query(_ipw_sql("1", "e / (1 - e)"))
def ipw_att(spark, sf_dir):
    return rounded(est.ipw(_scored(spark, sf_dir), "t", "y", target="att"))


@query(_ipw_sql("(1 - e) / e", "1"))
def ipw_atc(spark, sf_dir):
    return rounded(est.ipw(_scored(spark, sf_dir), "t", "y", target="atc"))


def _aipw_sql(score: str, share: str) -> str:
    return f"""with {CELLS}, f as (select {score} as s, {share} as h from w), m as (select avg(s) / avg(h) as m from f)
select round(max(m), 4) as effect, round(stddev_samp(s - m * h) / sqrt(count(*)) / avg(h), 4) as se_plain, count(*) as n from f cross join m"""


@query(_aipw_sql("m1 - m0 + t * (y - m1) / e - (1 - t) * (y - m0) / (1 - e)", "1.0::double"))
def aipw_ate(spark, sf_dir):
    return rounded(est.aipw(_scored(spark, sf_dir), "t", "y"))


@query(_aipw_sql("t * (y - m0) - (1 - t) * e / (1 - e) * (y - m0)", "t"))
def aipw_att(spark, sf_dir):
    return rounded(est.aipw(_scored(spark, sf_dir), "t", "y", target="att"))


@query(_aipw_sql("t * (1 - e) / e * (y - m1) - (1 - t) * (y - m1)", "1 - t"))
def aipw_atc(spark, sf_dir):
    return rounded(est.aipw(_scored(spark, sf_dir), "t", "y", target="atc"))


@query(f"""with {BASE}, r as (select *, ((row_number() over (order by acct, o_orderkey) - 1) * 5 // count(*) over ()) as stratum from base),
g as (select stratum, sum(t) as n1, sum(1 - t) as n0, avg(case when t > 0.5 then y end) as y1, avg(case when t <= 0.5 then y end) as y0,
  var_samp(case when t > 0.5 then y end) as v1, var_samp(case when t <= 0.5 then y end) as v0 from r group by 1), t as (select sum(n1 + n0) as w from g)
select round(sum((n1 + n0) / w * (y1 - y0)), 4) as effect, round(sqrt(sum(((n1 + n0) / w) ** 2 * (v1 / n1 + v0 / n0))), 4) as se, max(w)::bigint as n from g cross join t""")
def stratification_ate(spark, sf_dir):
    return rounded(est.stratified_effect(est.stratify(orders_frame(spark, sf_dir), "acct", 5, ["o_orderkey"]), "t", "y"))


@query(f"""with {CELLS}, g as (select w.*, unnest([0.01, 0.05, 0.1, 0.4])::double as threshold from w),
c as (select threshold, e, t, greatest(threshold, least(1 - threshold, e)) as p from g),
v as (select *, case when t > 0.5 then 1 / p else 1 / (1 - p) end as w from c)
select threshold, round(min(e), 6) as low, round(max(e), 6) as high, round(sum(w) ** 2 / sum(w * w), 4) as ess, sum(case when w > 10 then 1 else 0 end)::bigint as extreme,
  round(avg(case when e between threshold and 1 - threshold then 0.0 else 1.0 end), 6) as excluded from v group by 1""")
def overlap_report(spark, sf_dir):
    return rounded(est.overlap_report(_scored(spark, sf_dir), "t", thresholds=(0.01, 0.05, 0.1, 0.4)), 6, ess=4)


@query(f"""with {BASE}, s as (select count(*)::double as n, covar_pop(z, y) as zy, covar_pop(z, t) as zt, var_pop(z) as vz, var_pop(t) as vt, var_pop(y) as vy, covar_pop(t, y) as ty from base)
select round(zy / zt, 2) as effect, round(sqrt((vy - 2 * zy / zt * ty + (zy / zt) ** 2 * vt) * n / (n - 2) * vz / n) / abs(zt), 2) as se, round((zt / vz) ** 2 / ((vt - zt * zt / vz) * n / (n - 2) / (n * vz)), 4) as first_stage_f, n::bigint as n from s""")
def wald_iv(spark, sf_dir):
    return rounded(est.wald_iv(orders_frame(spark, sf_dir), "z", "t", "y", weak=0.0), effect=2, se=2)


@query(f"""with {BASE}, s as (select count(*)::double as n, covar_pop(acct, y) as zy, covar_pop(acct, t) as zt, var_pop(acct) as vz, var_pop(t) as vt, var_pop(y) as vy, covar_pop(t, y) as ty from base)
select round(zy / zt, 2) as effect, round(sqrt((vy - 2 * zy / zt * ty + (zy / zt) ** 2 * vt) * n / (n - 2) * vz / n) / abs(zt), 2) as se,
  round((zt / vz) ** 2 / ((vt - zt * zt / vz) * n / (n - 2) / (n * vz)), 4) as first_stage_f, n::bigint as n from s""")
def two_stage_least_squares(spark, sf_dir):
    return rounded(est.two_stage(orders_frame(spark, sf_dir), ["acct"], "t", "y"), 2, first_stage_f=4)


def _with_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").cast("double").alias("m"))
    return orders_frame(spark, sf_dir).join(lines, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")


LINES = f"{BASE}, lm as (select base.*, k::double as m from base join (select l_orderkey, count(*) as k from lineitem group by 1) on o_orderkey = l_orderkey)"


@query(f"""with {LINES}, s as (select covar_pop(t, m) as tm, var_pop(t) as vt, var_pop(m) as vm, covar_pop(m, y) as my, covar_pop(t, y) as ty, avg(t) as mt0, avg(m) as mm0, avg(y) as my0 from lm),
k as (select *, tm / vt as a, (my * vt - tm * ty) / (vm * vt - tm * tm) as b, (ty * vm - tm * my) / (vm * vt - tm * tm) as c from s),
r as (select a, b, vt, vm - a * tm as vr, t - mt0 as dt, (m - mm0) - a * (t - mt0) as rm, (y - my0) - b * (m - mm0) - c * (t - mt0) as ry from lm cross join k)
select round(max(a * b), 4) as effect, round(sqrt(sum((b * dt * rm / vt + a * rm * ry / vr) ** 2)) / count(*), 4) as se, count(*) as n from r""")
def frontdoor_two_stage(spark, sf_dir):
    g = Admg(["t", "m", "y"], [("t", "m"), ("m", "y")], [("t", "y")])
    return rounded(est.frontdoor_effect(_with_lines(spark, sf_dir), "t", idf.frontdoor(g, "t", "y").mediators, "y"))


@query("""with r as (select l_quantity - 25 as r, l_extendedprice as y from lineitem where abs(l_quantity - 25) <= 10),
s as (select r >= 0 as side, regr_intercept(y, r) as i, count(*) as n, avg(r) as m, var_pop(r) as v, count(*) * (var_pop(y) - covar_pop(r, y) ** 2 / var_pop(r)) as rss from r group by 1)
select round(sum(case when side then i else -i end), 4) as effect, round(sqrt(sum(rss) / (sum(n) - 4) * sum(1 / n + m * m / (n * v))), 4) as se, sum(n)::bigint as n from s""")
def sharp_rd(spark, sf_dir):
    return rounded(est.sharp_rd(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", 25, 10))


@query(f"""with {BASE}, m as (select avg(acct) as w from base), f as (
  select regr_slope(y, acct) filter (where t > 0.5) as s1, regr_intercept(y, acct) filter (where t > 0.5) as i1,
         regr_slope(y, acct) filter (where t <= 0.5) as s0, regr_intercept(y, acct) filter (where t <= 0.5) as i0, count(*) as n from base),
a as (select t, count(*) as n, avg(acct) as m, var_pop(acct) as v, count(*) * (var_pop(y) - covar_pop(acct, y) ** 2 / var_pop(acct)) as rss from base group by 1),
e as (select sqrt(sum(rss) / (sum(n) - 4) * sum(1 / n + (w - m) ** 2 / (n * v))) as se from a cross join m group by w)
select round(i1 - i0 + (s1 - s0) * w, 4) as effect, round(se, 4) as se, round(w, 4) as modifier_mean, n from f cross join m cross join e""")
def conditional_effect(spark, sf_dir):
    return rounded(est.conditional_effect(orders_frame(spark, sf_dir), "t", "y", "acct"))


@query(f"""with {BASE}, a as (select seg, avg(case when t > 0.5 then yb end) as y1, avg(case when t <= 0.5 then yb end) as y0, count(*)::double as k from base group by 1)
select round(sum(k * (y1 - y0)) / sum(k), 6) as value from a""")
def functional_backdoor(spark, sf_dir):
    g = Dag(["seg", "t", "yb"], [("seg", "t"), ("seg", "yb"), ("t", "yb")])
    e = idf.identify_do(g, ["yb"], ["t"])
    return rounded(expr.contrast(e, orders_frame(spark, sf_dir), "yb", "t", 1.0, 0.0), 6)


@query(f"""with {LINES}, pt as (select t as s, count(*)::double / (select count(*) from lm) as p from lm group by 1),
ym as (select m, t as s, avg(yb) as e from lm group by 1, 2), inner_sum as (select m, sum(p * e) as v, sum(p) as w from ym join pt using (s) group by 1),
mt as (select t, m, count(*)::double / sum(count(*)) over (partition by t) as p from lm group by 1, 2),
d as (select t, sum(p * v) / sum(p * w) as v from mt join inner_sum using (m) group by 1)
select round(max(case when t > 0.5 then v end) - max(case when t <= 0.5 then v end), 6) as value from d""")
def functional_frontdoor(spark, sf_dir):
    g = Admg(["t", "m", "yb"], [("t", "m"), ("m", "yb")], [("t", "yb")])
    return rounded(expr.contrast(idf.identify_do(g, ["yb"], ["t"]), _with_lines(spark, sf_dir), "yb", "t", 1.0, 0.0), 6)


@query(f"""with {BASE}, c as (select seg, t, yb, count(*) as n from base group by 1, 2, 3)
select seg, t, yb, round(n::double / sum(n) over (partition by seg, t), 8) as p from c""")
def conditional_table(spark, sf_dir):
    return rounded(red.cpt(orders_frame(spark, sf_dir), ["yb"], ["seg", "t"]), 8)


# --- events: grids, lags, tests over order


@query("""with e as (select event_type, epoch_us(ts) as us, event_id, value from events),
s as (select event_type, min(us) as t0, max(us) as t1 from e group by 1), b as (select event_type, unnest(range(0, (t1 - t0) // 3600000000 + 1)) as bin from s),
h as (select event_type, (us - t0) // 3600000000 as bin, arg_max(value, us * 100000000::hugeint + event_id) as value from e join s using (event_type) group by 1, 2)
select event_type, bin::bigint as bin, value from b left join h using (event_type, bin)""")
def event_grid(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id", "value")
    return ser.event_grid(e, "us", "value", 3_600_000_000, "event_id", ["event_type"])


LAGGED = """l as (select user_id, event_id, value as y, lag(value, 1) over w as x1, lag(value, 2) over w as x2 from events window w as (partition by user_id order by event_id)),
k as (select * from l where x1 is not null and x2 is not null)"""


@query(f"""with {LAGGED}, s as (select count(*) as n, var_pop(y) as vy, var_pop(x1) as va, var_pop(x2) as vb, covar_pop(x1, x2) as ab, covar_pop(x1, y) as ay, covar_pop(x2, y) as byy from k),
b as (select *, (ay * vb - ab * byy) / (va * vb - ab * ab) as b1, (byy * va - ab * ay) / (va * vb - ab * ab) as b2 from s)
select round(b1, 6) as effect, round(sqrt((vy - b1 * ay - b2 * byy) / (n - 3) / (va - ab * ab / vb)), 6) as se, n from b""")
def temporal_adjustment(spark, sf_dir):
    return rounded(ser.temporal_adjustment(table(spark, sf_dir, "events"), "value", "value", "event_id", 1, [("value", 2)], ["user_id"]), 6)


@query(f"""with {LAGGED} select count(*) as rows_kept, round(sum(x1), 2) as sum_lag1, round(sum(x2), 2) as sum_lag2, round(sum(y * x1), 0) as cross_lag1 from k""")
def lagged_frame(spark, sf_dir):
    f = red.lag_frame(table(spark, sf_dir, "events"), ["value"], [1, 2], "event_id", ["user_id"]).where("value__lag1 is not null and value__lag2 is not null")
    s = f.agg(F.count("*").alias("rows_kept"), F.sum("value__lag1").alias("sum_lag1"), F.sum("value__lag2").alias("sum_lag2"), F.sum(F.col("value") * F.col("value__lag1")).alias("cross_lag1"))
    return rounded(s, 2, cross_lag1=0)


@query(f"""with {LAGGED}, s as (select avg(x1) as ma, avg(x2) as mb, avg(y) as my, var_pop(x1) as va, var_pop(x2) as vb, covar_pop(x1, x2) as ab, covar_pop(x1, y) as ay, covar_pop(x2, y) as byy from k),
b as (select *, (ay * vb - ab * byy) / (va * vb - ab * ab) as b1, (byy * va - ab * ay) / (va * vb - ab * ab) as b2 from s)
select d::double as dose, h::bigint as horizon, round(my - b1 * ma - b2 * mb + d * case when h = 1 then b1 else b2 end, 4) as mean
from b cross join (select unnest([0.0, 1.0, 10.0]) as d) cross join (select unnest([1, 2]) as h)""")
def temporal_response(spark, sf_dir):
    return rounded(ser.temporal_response(table(spark, sf_dir, "events"), "value", "value", "event_id", [1, 2], [0.0, 1.0, 10.0], [1, 2], ["user_id"]))


@query("""with m as (select min(l_extendedprice) as lo, max(l_extendedprice) as hi from lineitem)
select greatest(0, least(9, floor((l_extendedprice - lo) / greatest(hi - lo, 1e-12) * 10)))::int as code, count(*) as n from lineitem cross join m group by 1""")
def equal_width_bins(spark, sf_dir):
    return tf.equal_width_bin(table(spark, sf_dir, "lineitem"), "l_extendedprice", 10, "code").groupBy("code").agg(F.count("*").alias("n"))


@query("""with v as (select value as a, lead(value, 1) over w as b, lead(value, 2) over w as c from events window w as (partition by user_id order by event_id)),
p as (select list_sort([{'v': a, 'i': 0}, {'v': b, 'i': 1}, {'v': c, 'i': 2}]) as s from v where c is not null),
q as (select s[1].i as i, s[2].i as j, s[3].i as k from p)
select ((case when j < i then 1 else 0 end + case when k < i then 1 else 0 end) * 2 + case when k < j then 1 else 0 end)::int as pattern, count(*) as n from q group by 1""")
def ordinal_patterns(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(tf.ordinal_pattern("value", 3, 1, ["event_id"], ["user_id"]).alias("pattern"))
    return e.where("pattern is not null").groupBy("pattern").agg(F.count("*").alias("n"))


@query("""select user_id, round(sum(a), 1) as total from (select user_id, avg(value) over (partition by user_id order by event_id rows between 2 preceding and 2 following) as a from events) group by 1""")
def moving_averages(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("a", tf.moving_average("value", 5, ["event_id"], ["user_id"]))
    return rounded(e.groupBy("user_id").agg(F.sum("a").alias("total")), 1)


@query("""select l_returnflag, l_linestatus, round(sum((l_quantity - m) / s), 3) as total, round(max((l_quantity - m) / s), 6) as top
from lineitem cross join (select avg(l_quantity) as m, stddev_pop(l_quantity) as s from lineitem) group by 1, 2""")
def standardised(spark, sf_dir):
    x = tf.standardise(table(spark, sf_dir, "lineitem"), ["l_quantity"])
    return rounded(x.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("total"), F.max("l_quantity").alias("top")), 3, top=6)


@query("""select l_returnflag, count(*) as n, sum(case when l_returnflag = 'N' then 1.0 when l_returnflag = 'A' then -1.0 else 0.0 end)::double as h1,
  sum(case when l_returnflag = 'R' then 2.0 when l_returnflag in ('A', 'N') then -1.0 else 0.0 end)::double as h2 from lineitem group by 1""")
def helmert_contrast(spark, sf_dir):
    c = tf.contrast_columns("l_returnflag", ["A", "N", "R"], "helmert")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), *[F.sum(e).alias(f"h{i}") for i, e in enumerate(c.values(), 1)])


@query("""select round(max(abs(c)), 3) as statistic, arg_max(o, abs(round(c, 9)))::bigint as at from (
  select event_id as o, sum(value - m) over (order by event_id) as c from events cross join (select avg(value) as m from events))""")
def cusum_scan(spark, sf_dir):
    return rounded(ser.cusum(table(spark, sf_dir, "events"), "value", "event_id"), 3)


@query("""select round(count(*) * ln(var_pop(value)) - count(*) filter (where not a) * ln(var_pop(value) filter (where not a)) - count(*) filter (where a) * ln(var_pop(value) filter (where a)), 4) as lr,
  count(*) filter (where not a) as n0, count(*) filter (where a) as n1 from (select value, ts >= timestamp '2024-01-16' as a from events)""")
def known_split(spark, sf_dir):
    return rounded(ser.known_split(table(spark, sf_dir, "events"), "value", F.col("ts").cast("timestamp") >= F.lit("2024-01-16").cast("timestamp")))


@query("""with l as (select value as v, sum(case when event_type = 'click' then 1.0 else 0.0 end) as a, sum(case when event_type = 'click' then 0.0 else 1.0 end) as b from events group by 1),
r as (select *, coalesce(sum(b) over (order by v rows between unbounded preceding and 1 preceding), 0) as below, a + b as t from l),
s as (select sum(a * (below + b / 2)) as u, sum(a) as n1, sum(b) as n0, sum(t ** 3 - t) as ties from r)
select round(u / (n1 * n0), 6) as auc, round((u - n1 * n0 / 2) / sqrt(n1 * n0 / 12 * (n1 + n0 + 1 - ties / ((n1 + n0) * (n1 + n0 - 1)))), 4) as z from s""")
def mann_whitney(spark, sf_dir):
    return rounded(ser.mann_whitney(table(spark, sf_dir, "events"), "value", F.col("event_type") == "click"), 4, auc=6)


@query(f"""with {BASE}, s as (select avg(y) filter (where t > 0.5) - avg(y) filter (where t <= 0.5) as d,
  sqrt(var_samp(y) filter (where t > 0.5) / count(*) filter (where t > 0.5) + var_samp(y) filter (where t <= 0.5) / count(*) filter (where t <= 0.5)) as se from base)
select round(d, 4) as difference, round(abs(d) / se, 6) as statistic from s""")
def mean_difference(spark, sf_dir):
    return rounded(ser.mean_difference(orders_frame(spark, sf_dir), "y", F.col("t") > 0.5).drop("p"), 4, statistic=6)


P_TABLE = "p as (select p_partkey, ((p_partkey * 7919) % 100003 + 1) / 100004.0::double as p from part)"


def _p_values(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", (((F.col("p_partkey") * 7919) % 100003 + 1) / F.lit(100004.0)).alias("p"))


def _adjust_sql(value: str, over: str) -> str:
    return f"""with {P_TABLE}, r as (select *, row_number() over (order by p) as r, count(*) over () as n from p)
select p_partkey, round(least(1.0, {value.format(w=over)}), 9) as adjusted from r"""


@query(_adjust_sql("min(p * n / r) over {w}", "(order by r desc)"))
def fdr_bh(spark, sf_dir):
    return rounded(ser.adjust_p(_p_values(spark, sf_dir), method="bh").select("p_partkey", "adjusted"), 9)


@query(_adjust_sql("min(p * n / r * list_sum([1.0::double / i for i in range(1, n + 1)])) over {w}", "(order by r desc)"))
def fdr_by(spark, sf_dir):
    return rounded(ser.adjust_p(_p_values(spark, sf_dir), method="by").select("p_partkey", "adjusted"), 9)


@query(_adjust_sql("max(p * (n - r + 1)) over {w}", "(order by r)"))
def fwer_holm(spark, sf_dir):
    return rounded(ser.adjust_p(_p_values(spark, sf_dir), method="holm").select("p_partkey", "adjusted"), 9)


@query(_adjust_sql("p * n", ""))
def fwer_bonferroni(spark, sf_dir):
    return rounded(ser.adjust_p(_p_values(spark, sf_dir), method="bonferroni").select("p_partkey", "adjusted"), 9)


@query("""select event_id, round(case when n = 20 and vx > 0 then c / vx end, 5) as slope from (
  select event_id, count(*) over w as n, var_pop(event_id) over w as vx, covar_pop(event_id, value) over w as c from events
  window w as (partition by user_id order by event_id rows between 19 preceding and current row))""")
def rolling_regression(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("x", F.col("event_id").cast("double"))
    return rounded(ser.rolling_regression(e, "x", "value", "event_id", 20, ["user_id"]).select("event_id", "slope"), 5)


@query("""select fold, train, count(*) as n from (select f as fold, d < 10 + f * 3 as train, d, f from (select date_diff('day', date '2024-01-01', ts::date) as d from events)
  cross join (select unnest(range(0, 5)) as f) where d < 10 + f * 3 + 4) group by 1, 2""".replace("f as fold", "f::int as fold"))
def rolling_origin_folds(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("d"))
    return ser.rolling_origin(e, "d", 10, 3, 4, 5).groupBy("fold", "train").agg(F.count("*").alias("n"))


# --- reductions


@query("""select round(sum(l_quantity) ** 2 / sum(l_quantity * l_quantity), 4) as ess from lineitem""")
def kish_ess(spark, sf_dir):
    return rounded(red.kish_ess(table(spark, sf_dir, "lineitem"), "l_quantity"))


@query("""with w as (select s_suppkey % 64 as mask, exp(s_acctbal / 1000 - (select max(s_acctbal / 1000) from supplier)) as e from supplier),
n as (select mask, e / sum(e) over () as w from w)
select b::int as edge, round(sum(w * ((mask >> b) & 1)), 8) as probability from n cross join (select unnest(range(0, 6)) as b) group by 1""")
def edge_marginals(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 64).alias("mask"), (F.col("s_acctbal") / 1000).alias("lw"))
    return rounded(red.edge_marginals(red.normalise_log_weights(s, "lw"), 6), 8)


@query("""select 'c_acctbal' as quantity, round(avg(c_acctbal), 4) as mean, round(stddev_samp(c_acctbal), 4) as sd,
  round(quantile_cont(c_acctbal, 0.025), 2) as low, round(quantile_cont(c_acctbal, 0.975), 2) as high from customer""")
def posterior_summary(spark, sf_dir):
    return rounded(red.posterior_summary(table(spark, sf_dir, "customer"), ["c_acctbal"]), low=2, high=2)


@query("""with c as (select l_linestatus as s, l_returnflag as x, l_quantity::int as y, count(*)::double as n from lineitem group by 1, 2, 3),
m as (select *, sum(n) over (partition by s, x) as nx, sum(n) over (partition by s, y) as ny, sum(n) over (partition by s) as ns from c),
d as (select s, (count(distinct x) - 1) * (count(distinct y) - 1) as df from c group by 1)
select round((select 2 * sum(n * ln(n * ns / (nx * ny))) from m), 4) as statistic, greatest(1, sum(df))::bigint as dof from d""")
def g_squared(spark, sf_dir):
    from causelake.operators.ci import g_squared as g2

    li = table(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity").cast("int"))
    return rounded(g2(li, "l_returnflag", "q", ["l_linestatus"]).drop("p"))


@query(f"""with s as (select corr(l_extendedprice, l_discount) as xy, corr(l_extendedprice, l_quantity) as xz, corr(l_discount, l_quantity) as yz, count(*) as n from lineitem)
select round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 8) as r, n from s""")
def partial_correlation(spark, sf_dir):
    from causelake.operators.ci import partial_correlations

    r = partial_correlations(table(spark, sf_dir, "lineitem"), [("l_extendedprice", "l_discount", ("l_quantity",))])
    return rounded(r.select("r", "n"), 8)


@query(f"""with {BASE}, a as (select * from base where t > 0.5), d as (select acct, min(o_orderkey) as k, arg_min(y, o_orderkey) as dy from base where t <= 0.5 group by 1),
m as (select a.o_orderkey, a.y, arg_min(dy, {{'d': abs(a.acct - d.acct), 'k': d.k}}) as dy from a cross join d group by 1, 2)
select round(avg(y - dy), 4) as effect, count(*) as n from m""")
def nearest_neighbour_match(spark, sf_dir):
    return rounded(est.match_effect(est.nearest_match(orders_frame(spark, sf_dir), "t", "y", "acct", "o_orderkey")))


@query("""with r as (select l_orderkey * 10 + l_linenumber as key, l_quantity::double as t, l_returnflag = 'R' as d from lineitem),
u as (select t as u, count(*) as gone, sum(case when d then 0 else 1 end) as c from r group by 1),
k as (select *, sum(gone) over (order by u desc) as risk from u),
g as (select u, coalesce(exp(sum(ln(1 - c / risk::double)) over (order by u rows between unbounded preceding and 1 preceding)), 1.0) as g from (select * from k where c < risk)),
w as (select case when d then 1.0 / g else 0.0 end as w from r join g on t = u)
select count(*) as n, round(sum(w), 2) as total, round(max(w), 6) as top from w""")
def censoring_weights(spark, sf_dir):
    # the last time has no one left after it; rows censored there have weight zero in any case
    li = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), F.col("l_quantity").alias("time"), (F.col("l_returnflag") == "R").alias("event"))
    return rounded(est.km_ipcw(li, "time", "event", "key").agg(F.count("*").alias("n"), F.sum("weight").alias("total"), F.max("weight").alias("top")), 2, top=6)


TRIAL = f"""{BASE}, s as (select seg, avg(case when region <= 2 then 1.0 else 0.0 end) as s, avg(t) filter (where region <= 2) as e,
  avg(y) filter (where region <= 2 and t > 0.5) as m1, avg(y) filter (where region <= 2 and t <= 0.5) as m0 from base group by 1),
w as (select *, region <= 2 as i, (1 - s) / s * case when t > 0.5 then 1 / e else 1 / (1 - e) end as w, case when t > 0.5 then 1.0 else -1.0 end as g from base join s using (seg))"""


@query(f"""with {TRIAL} select round(sum(case when i then g * w * y end) / sum(case when i then 0 else 1 end), 4) as ipw,
  round(sum(case when i then g * w * (y - case when t > 0.5 then m1 else m0 end) else m1 - m0 end) / sum(case when i then 0 else 1 end), 4) as aipw,
  round(sum(case when i and t > 0.5 then w end) ** 2 / sum(case when i and t > 0.5 then w * w end), 4) as ess_treated,
  round(sum(case when i and t <= 0.5 then w end) ** 2 / sum(case when i and t <= 0.5 then w * w end), 4) as ess_control, sum(case when i then 0 else 1 end)::bigint as n_target from w""")
def trial_transport(spark, sf_dir):
    o = orders_frame(spark, sf_dir).withColumn("trial", F.col("region") <= 2)
    inside = lambda c: F.when(F.col("trial") & c, F.col("y"))
    s = o.groupBy("seg").agg(F.avg(F.col("trial").cast("double")).alias("s"), F.avg(F.when(F.col("trial"), F.col("t"))).alias("e"), F.avg(inside(F.col("t") > 0.5)).alias("m1"), F.avg(inside(F.col("t") <= 0.5)).alias("m0"))
    return rounded(est.trial_transport(o.join(s, "seg"), "y", "t", "trial", "s", "e", "m1", "m0"))


@query("""with d as (select lang, source, quality from documents left join labels using (doc_id)),
p as (select lang, avg(case when quality is null then 0.0 else 1.0 end) as p, avg(quality) as m from d group by 1)
select lang, round(avg(case when quality is not null then m + (quality - m) / p else m end), 6) as mean, count(*) as n from d join p using (lang) group by 1""")
def selected_outcome(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("seen", F.col("quality").isNotNull())
    p = d.groupBy("lang").agg(F.avg(F.col("seen").cast("double")).alias("p"), F.avg("quality").alias("m"))
    o = est.selected_outcome(d.select("lang", "quality", "seen").join(p, "lang"), "quality", "seen", "p", "m")
    return rounded(o.groupBy("lang").agg(F.avg("pseudo").alias("mean"), F.count("*").alias("n")), 6)


EDGES = "e as (select s_suppkey as src, (s_suppkey * 3 + k * 7) % (select count(*) from supplier) + 1 as dst, k::double as w from supplier cross join (select unnest([1, 2, 3]) as k))"


def _network(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    units = s.select(F.col("s_suppkey").alias("unit"), (F.col("s_suppkey") % 2 == 0).alias("assigned"), F.col("s_acctbal").alias("y"))
    total = s.agg(F.count("*").alias("c"))
    edges = s.join(F.broadcast(total)).withColumn("k", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    return units, edges.select(F.col("s_suppkey").alias("src"), ((F.col("s_suppkey") * 3 + F.col("k") * 7) % F.col("c") + 1).alias("dst"), F.col("k").cast("double").alias("w"))


@query(f"""with {EDGES}, x as (select dst, sum(case when src % 2 = 0 then w else 0 end) as weighted from e group by 1)
select s_suppkey as unit, coalesce(weighted, 0)::double as exposure from supplier left join x on s_suppkey = dst""")
def neighbour_exposure(spark, sf_dir):
    return est.neighbour_exposure(*_network(spark, sf_dir), mapping="weighted").select("unit", "exposure")


@query(f"""with {EDGES}, x as (select dst, sum(case when src % 2 = 0 then 1.0 else 0.0 end) as hits from e group by 1),
u as (select s_acctbal as y, s_suppkey % 2 = 0 as a, coalesce(hits, 0) >= 2 as h from supplier left join x on s_suppkey = dst)
select round(avg(case when a and h then y / 0.25 else 0 end) - avg(case when not a and not h then y / 0.25 else 0 end), 4) as ht,
  round(sum(case when a and h then y end) / count(*) filter (where a and h) - sum(case when not a and not h then y end) / count(*) filter (where not a and not h), 4) as hajek,
  round(2 * (avg(case when a and h then 0.75 * y * y / 0.0625 else 0 end) + avg(case when not a and not h then 0.75 * y * y / 0.0625 else 0 end)), 2) as variance, count(*) as n from u""")
def exposure_contrast(spark, sf_dir):
    x = est.neighbour_exposure(*_network(spark, sf_dir))
    on, off = F.col("assigned") & (F.col("exposure") >= 2), ~F.col("assigned") & (F.col("exposure") < 2)
    return rounded(est.exposure_contrast(x, "y", on, F.lit(0.25), off, F.lit(0.25)), variance=2)


LCG = """(((((o_orderkey + 1) * 48271 + (b + 1 + 1) * 69621) % 2147483647) * 39373 + 1) % 2147483647 * 48271 % 2147483647 + 0.5::double) / 2147483647.0::double"""


@query(f"""with {BASE}, u as (select t, y, b, {LCG} as u from base cross join (select unnest(range(0, 20)) as b)),
w as (select *, -ln(u) as w from u)
select b::int as replicate, round(sum(case when t > 0.5 then w * y end) / sum(case when t > 0.5 then w end) - sum(case when t <= 0.5 then w * y end) / sum(case when t <= 0.5 then w end), 3) as effect from w group by 1""")
def bayesian_bootstrap(spark, sf_dir):
    return rounded(est.bootstrap_means(orders_frame(spark, sf_dir), "t", "y", "o_orderkey", 20, scheme="bayesian"), 3)


@query(f"""with {BASE}, s as (select avg(y) filter (where t > 0.5) - avg(y) filter (where t <= 0.5) as d, stddev_samp(y) as sd from base), r as (select exp(0.91 * abs(d / sd)) as rr from s)
select round(rr + sqrt(rr * (rr - 1)), 6) as e_value from r""")
def e_value(spark, sf_dir):
    o = orders_frame(spark, sf_dir)
    s = o.agg(F.avg(F.when(F.col("t") > 0.5, F.col("y"))) - F.avg(F.when(F.col("t") <= 0.5, F.col("y"))), F.stddev_samp("y")).first()
    return spark.createDataFrame([(round(est.e_value(s[0], s[1]), 6),)], "e_value double")


BP = """p as (select z::int as z, avg(case when t <= 0.5 and yb = 0 then 1.0 else 0.0 end) as p00, avg(case when t <= 0.5 and yb = 1 then 1.0 else 0.0 end) as p10,
  avg(case when t > 0.5 and yb = 0 then 1.0 else 0.0 end) as p01, avg(case when t > 0.5 and yb = 1 then 1.0 else 0.0 end) as p11 from base group by 1),
q as (select a.p00 as a00, a.p10 as a10, a.p01 as a01, a.p11 as a11, b.p00 as b00, b.p10 as b10, b.p01 as b01, b.p11 as b11 from p a, p b where a.z = 0 and b.z = 1)"""


@query(f"""with {BASE}, {BP} select
  round(greatest(b11 + a00 - 1, a11 + b00 - 1, a11 - b11 - b10 - a01 - a10, b11 - a11 - a10 - b01 - b10, -b01 - b10, -a01 - a10, b00 - b01 - b10 - a01 - a00, a00 - a01 - a10 - b01 - b00), 6) as low,
  round(least(1 - b01 - a10, 1 - a01 - b10, -a01 + b01 + b00 + a11 + a00, -b01 + b11 + b00 + a01 + a00, b11 + b00, a11 + a00, -b10 + b11 + b00 + a11 + a10, -a10 + a11 + a00 + b11 + b10), 6) as high from q""")
def binary_iv_bounds(spark, sf_dir):
    o = orders_frame(spark, sf_dir)
    cells = o.groupBy(F.col("z").cast("int").alias("z"), F.col("t").cast("int").alias("d"), "yb").agg(F.count("*").alias("n")).collect()
    size = {z: sum(r["n"] for r in cells if r["z"] == z) for z in (0, 1)}
    p = {(z, d, y): 0.0 for z in (0, 1) for d in (0, 1) for y in (0, 1)} | {(r["z"], r["d"], r["yb"]): r["n"] / size[r["z"]] for r in cells}
    low, high = idf.binary_iv_bounds(p)
    return spark.createDataFrame([(round(low, 6) + 0.0, round(high, 6) + 0.0)], "low double, high double")


@query()
def ipw_logistic(spark, sf_dir):
    return rounded(est.ipw_se(est.propensity(orders_frame(spark, sf_dir), "t", ["acct", "region"]), "t", "y", ["acct", "region"]))


@query()
def glm_gcomputation(spark, sf_dir):
    return rounded(est.glm_adjustment(orders_frame(spark, sf_dir), "t", "yb", ["acct"]), 6)


@query()
def response_curve(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("key", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    po = est.pseudo_outcome(li, "l_discount", "l_extendedprice", ["l_quantity", "l_tax"], "key")
    return est.local_polynomial(po, "l_discount", "pseudo", [0.02, 0.04, 0.06, 0.08], bandwidth=0.02)


@query(f"""with {BASE}, m as (select stddev_samp(acct) as sa, stddev_samp(region) as sr from base), a as (select * from base where t > 0.5),
d as (select acct, region, min(o_orderkey) as k, arg_min(y, o_orderkey) as dy from base where t <= 0.5 group by 1, 2),
p as (select a.o_orderkey, a.y, arg_min(dy, {{'d': round(((a.acct - d.acct) / sa) ** 2 + ((a.region - d.region) / sr) ** 2, 15), 'k': d.k}}) as dy from a cross join d cross join m group by 1, 2)
select round(avg(y - dy), 4) as effect, count(*) as n from p""")
def distance_match(spark, sf_dir):
    return rounded(est.match_effect(est.distance_match(orders_frame(spark, sf_dir), "t", "y", ["acct", "region"], "o_orderkey")))


@query()
def kalman_smoother(spark, sf_dir):
    return ser.kalman(table(spark, sf_dir, "events"), "user_id", "event_id", "value", 0.9, 1.0, 4.0)


@query()
def phase_surrogates(spark, sf_dir):
    return ser.phase_surrogate(table(spark, sf_dir, "events"), "user_id", "event_id", "value", 7)


def _projected(v: str) -> str:
    """Coefficients of a column on quantity and tax, by the two-regressor formula."""
    return f"({v}q * xx - {v}x * qx) / (qq * xx - qx * qx) as {v}1, ({v}x * qq - {v}q * qx) / (qq * xx - qx * qx) as {v}2"


@query(f"""with r as (select l_discount as t, l_extendedprice as y, l_quantity as q, l_tax as x from lineitem),
s as (select avg(t) as mt, avg(y) as my, avg(q) as mq, avg(x) as mx, var_pop(q) as qq, var_pop(x) as xx, covar_pop(q, x) as qx, covar_pop(t, q) as tq, covar_pop(t, x) as tx, covar_pop(y, q) as yq, covar_pop(y, x) as yx from r),
c as (select *, {_projected('t')}, {_projected('y')} from s),
e as (select (t - mt) - t1 * (q - mq) - t2 * (x - mx) as u, (y - my) - y1 * (q - mq) - y2 * (x - mx) as v from r cross join c), b as (select covar_pop(u, v) / var_pop(u) as b, var_pop(u) as s2 from e),
k as (select b + u / s2 * (v - b * u) as score from e cross join b)
select round(avg(score), 3) as effect, round(stddev_samp(score) / sqrt(count(*)), 3) as se, count(*) as n from k""")
def average_derivative(spark, sf_dir):
    return rounded(est.average_derivative(table(spark, sf_dir, "lineitem"), "l_discount", "l_extendedprice", ["l_quantity", "l_tax"]), 3)


# --- structural models, attribution, posteriors, decisions, discovery


def _chain(spark, sf_dir):
    """quantity -> price <- discount, quantity -> discount: a linear model of lineitem."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("q"), (F.col("l_discount") * 100).alias("d"), (F.col("l_extendedprice") / 1000).alias("p"), "l_returnflag", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"))
    return li, Dag(["q", "d", "p"], [("q", "d"), ("q", "p"), ("d", "p")])


CHAIN = """li as (select l_quantity as q, l_discount * 100 as d, l_extendedprice / 1000 as p, l_returnflag, l_orderkey * 10 + l_linenumber as key from lineitem),
m as (select avg(q) as mq, avg(d) as md, avg(p) as mp, var_pop(q) as vq, var_pop(d) as vd, var_pop(p) as vp, covar_pop(q, d) as qd, covar_pop(q, p) as qp, covar_pop(d, p) as dp from li),
b as (select *, qd / vq as bqd, (qp * vd - qd * dp) / (vq * vd - qd * qd) as bqp, (dp * vq - qd * qp) / (vq * vd - qd * qd) as bdp from m)"""


@query(f"""with {CHAIN} select 'd' as parent, round(bdp * bdp * vd, 6) as strength from b union all select 'q', round(bqp * bqp * vq, 6) from b""")
def arrow_strength(spark, sf_dir):
    from causelake.operators.attribution import arrow_strength as strength
    from causelake.operators.scm import Model

    li, g = _chain(spark, sf_dir)
    return rounded(spark.createDataFrame(sorted(strength(Model.fit(li, g), "p").items()), "parent string, strength double"), 6)


@query(f"""with {CHAIN} select l_returnflag, round(avg(p + (bqp + bqd * bdp) * (30 - q)), 6) as mean_at_30, round(sum(p + (bqp + bqd * bdp) * (30 - q) - p), 2) as change
from li cross join b group by 1""")
def counterfactual_means(spark, sf_dir):
    from causelake.operators.scm import Model

    li, g = _chain(spark, sf_dir)
    cf = Model.fit(li, g).counterfactual(li, [{"q": 30.0}])
    return rounded(cf.groupBy("l_returnflag").agg(F.avg("cf_p").alias("mean_at_30"), F.sum(F.col("cf_p") - F.col("p")).alias("change")), 6, change=2)


@query(f"""with {CHAIN} select 'q -> d -> p' as path, round(bqd * bdp, 8) as contribution from b union all select 'q -> p', round(bqp, 8) from b""")
def path_decomposition(spark, sf_dir):
    from causelake.operators.attribution import path_contributions
    from causelake.operators.scm import Model

    li, g = _chain(spark, sf_dir)
    return rounded(path_contributions(Model.fit(li, g), "q", "p", spark), 8)


def _by_flag(a: str, f: str) -> str:
    return f"""{a} as (select avg(q) as mq, avg(p) - regr_slope(p, q) * avg(q) as i, regr_slope(p, q) as s from li where l_returnflag = '{f}')"""


@query(f"""with {CHAIN}, {_by_flag('x', 'A')}, {_by_flag('y', 'R')}, v as (select x.i + x.s * x.mq as v0, y.i + y.s * x.mq as vp, x.i + x.s * y.mq as vq, y.i + y.s * y.mq as v1 from x, y)
select 'p' as mechanism, round(((vp - v0) + (v1 - vq)) / 2, 6) as contribution from v union all select 'q', round(((vq - v0) + (v1 - vp)) / 2, 6) from v""")
def distribution_change(spark, sf_dir):
    from causelake.operators.attribution import distribution_change as change
    from causelake.operators.scm import Model

    li, _ = _chain(spark, sf_dir)
    g = Dag(["q", "p"], [("q", "p")])
    models = [Model.fit(li.where(F.col("l_returnflag") == f), g) for f in ("A", "R")]
    return rounded(spark.createDataFrame(sorted(change(*models, "p").items()), "mechanism string, contribution double"), 6)


@query("""with m as (select quantile_cont(value, 0.5) as m from events), d as (select quantile_cont(abs(value - m), 0.5) as mad from events cross join m)
select event_type, round(max(abs(value - m) / (1.4826 * mad)), 6) as top, sum(case when abs(value - m) / (1.4826 * mad) > 3 then 1 else 0 end)::bigint as odd from events cross join m cross join d group by 1""")
def anomaly_scores(spark, sf_dir):
    from causelake.operators.attribution import anomaly_scores as scores

    s = scores(table(spark, sf_dir, "events"), "value")
    return rounded(s.groupBy("event_type").agg(F.max("z").alias("top"), F.sum((F.col("z") > 3).cast("long")).alias("odd")), 6)


@query(f"""with {BASE}, s as (select avg(y) filter (where region <= 1) as m1, avg(y) filter (where region > 1) as m0, var_samp(y) filter (where region <= 1) as v1, var_samp(y) filter (where region > 1) as v0,
  count(*) filter (where region <= 1) as n1, count(*) filter (where region > 1) as n0, var_pop(y) as v, count(*) as n from base)
select 'y' as "column", round(m1 - m0, 4) as difference, round(abs(m1 - m0) / sqrt(v1 / n1 + v0 / n0), 6) as welch, round(n * ln(v) - n1 * ln(v1 * (n1 - 1) / n1) - n0 * ln(v0 * (n0 - 1) / n0), 4) as lr from s""")
def mechanism_change(spark, sf_dir):
    from causelake.operators.attribution import mechanism_change as change

    o = orders_frame(spark, sf_dir).withColumn("new", F.col("region") <= 1)
    return rounded(change(o, "new", ["y"]).select("column", "difference", "welch", "lr"), 4, welch=6)


@query("""with s as (select count(*) as n, sum(value) as sy from events) select round((sy / 100.0) / (1e-6 + n / 100.0), 6) as mean, round(1 / (1e-6 + n / 100.0), 9) as variance from s""")
def conjugate_mean(spark, sf_dir):
    from causelake.operators.bayes import conjugate

    p = conjugate(red.gram(table(spark, sf_dir, "events"), ["value"]), "value", ["1"], sigma2=100.0)
    return spark.createDataFrame([(round(float(p.mean[0]), 6), round(float(p.cov[0, 0]), 9))], "mean double, variance double")


@query("""with a as (select * from (values ('hold', 0.0), ('grow', 0.1), ('bet', 0.5)) as t(action, stake)), u as (select s_suppkey as draw, action, stake * s_acctbal - 400 * stake * stake * 10 as u from supplier cross join a),
b as (select *, max(u) over (partition by draw) as best from u) select action, round(avg(u), 4) as utility, round(avg(best - u), 4) as regret from b group by 1""")
def decision_utilities(spark, sf_dir):
    from causelake.operators.validate import decide

    actions = spark.createDataFrame([("hold", 0.0), ("grow", 0.1), ("bet", 0.5)], "action string, stake double")
    draws = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("draw"), "s_acctbal")
    return rounded(decide(actions, draws, F.col("stake") * F.col("s_acctbal") - 4000 * F.col("stake") * F.col("stake")).select("action", "utility", "regret"))


@query("""with g as (select s_nationkey as k, (s_suppkey % 7 + 1)::double as w, case when s_suppkey % 3 = 0 then null else s_acctbal end as e from supplier)
select round(sum(w * e) / sum(case when e is not null then w end), 4) as identified_mean, min(e) as low, max(e) as high, round(sum(case when e is not null then w end) / sum(w), 8) as identified_mass,
  round(1 - sum(case when e is not null then w end) / sum(w), 8) as unidentified_mass from g""")
def effect_envelope(spark, sf_dir):
    from causelake.operators.bayes import effect_envelope as envelope

    g = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 7 + 1).cast("double").alias("weight"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_acctbal")).alias("effect"))
    return rounded(envelope(g), 8, identified_mean=4)


@query(f"with {BASE} select 't' as treatment, 'y' as outcome, round(regr_slope(y, t), 4) as effect from base union all select 'z', 'y', round(regr_slope(y, z), 4) from base")
def batch_queries(spark, sf_dir):
    from causelake.api import AverageEffect, many

    g = Dag(["t", "z", "y"], [("t", "y"), ("z", "y")])
    return rounded(many(orders_frame(spark, sf_dir), g, [AverageEffect("t", "y"), AverageEffect("z", "y")]).select("treatment", "outcome", "effect"))


@query(f"""with {BASE}, s as (select regr_slope(y, acct) as b, regr_intercept(y, acct) as a from base)
select 'x' as model, round(b, 8) as slope, round(a, 4) as intercept from s""")
def incremental_ols(spark, sf_dir):
    """Gram rows of batches summed: equal to one batch fit."""
    from functools import reduce

    from causelake.streaming.state import from_rows, gram_rows

    o = orders_frame(spark, sf_dir)
    rows = reduce(DataFrame.unionByName, [gram_rows(o.where(F.pmod("o_orderkey", F.lit(3)) == k), ["acct", "y"]) for k in range(3)])
    fit = red.solve(from_rows(rows, ["acct", "y"]), "y", ["1", "acct"])
    return spark.createDataFrame([("x", round(fit["acct"], 8), round(fit["1"], 4))], "model string, slope double, intercept double")


def _columns(spark, sf_dir):
    """Four dependent columns: quantity -> load -> cost <- tax."""
    li = table(spark, sf_dir, "lineitem")
    load = 2 * F.col("l_quantity") + 300 * F.col("l_discount")
    return li.select(F.col("l_quantity").alias("quantity"), load.alias("load"), (load + 400 * F.col("l_tax") + F.col("l_extendedprice") / 10_000).alias("cost"), F.col("l_tax").alias("tax"))


@query()
def pc_skeleton(spark, sf_dir):
    from causelake.operators.ci import Covariance
    from causelake.operators.discovery import pc

    x = _columns(spark, sf_dir)
    return spark.createDataFrame(pc(x.columns, Covariance.of(x, x.columns).test, 0.01).edges(), "a string, edge string, b string")


@query()
def ges_search(spark, sf_dir):
    from causelake.operators.discovery import GaussianScore, ges

    x = _columns(spark, sf_dir)
    return spark.createDataFrame(ges(GaussianScore(red.gram(x, x.columns))).edges(), "a string, edge string, b string")


@query()
def pcmci_events(spark, sf_dir):
    from causelake.operators.discovery import pcmci

    e = table(spark, sf_dir, "events").withColumn("other", F.lag("value", 1).over(Window.partitionBy("user_id").orderBy("event_id"))).where("other is not null")
    links, _ = pcmci(e, ["value", "other"], 2, "event_id", ["user_id"])
    return spark.createDataFrame([(x.cause, x.lag, x.effect, x.statistic, x.p) for x in links], "cause string, lag long, effect string, statistic double, p double")


@query()
def graph_posterior(spark, sf_dir):
    from causelake.operators.discovery import GaussianScore, exact_posterior

    x = _columns(spark, sf_dir)
    return spark.createDataFrame(exact_posterior(GaussianScore(red.gram(x, x.columns))), "mask long, weight double")


@query()
def validation_suite(spark, sf_dir):
    from causelake.operators.validate import suite

    return suite(orders_frame(spark, sf_dir), "t", "y", ["acct"], "o_orderkey", 20)


@query(f"""with {BASE}, {MOMENTS}, e as (select b1, sqrt(n * (vy - b1 * ty - b2 * zy) / (n - 3) * vz / (n * (vt * vz - tz * tz))) as se, n - 3 as dof from b),
g as (select unnest([0.01, 0.05, 0.1, 0.2])::double as r), k as (select b1, se, dof, x.r as rt, y.r as ry, se * sqrt(dof * y.r * x.r / (1 - x.r)) as bias, abs(b1 / se) / sqrt(dof) as f from e cross join g as x cross join g as y)
select rt as r2_treatment, ry as r2_outcome, round(b1 - sign(b1) * bias, 4) as adjusted, round(bias, 4) as bias, round(0.5 * (sqrt(pow(f, 4) + 4 * f * f) - f * f), 8) as robustness_value from k""")
def sensitivity_grid(spark, sf_dir):
    from causelake.operators.validate import partial_r2_grid

    return rounded(partial_r2_grid(orders_frame(spark, sf_dir), "t", "y", ["acct"]), 4, robustness_value=8)


@query()
def hmc_posterior(spark, sf_dir):
    from causelake.operators.bayes import hmc_gaussian, mcmc_diagnostics

    d = hmc_gaussian(spark, red.gram(orders_frame(spark, sf_dir), ["t", "y"]), "y", ["1", "t"], 1e10, steps=200, warmup=100)
    return mcmc_diagnostics(d, ["1", "t"])


@query()
def interventional_sample(spark, sf_dir):
    from causelake.operators.scm import Model

    li, g = _chain(spark, sf_dir)
    return Model.fit(li, g).sample(spark, 10_000, {"q": 30.0}, 1).agg(F.avg("p").alias("mean"), F.count("*").alias("n"))


@query()
def particle_filters(spark, sf_dir):
    from causelake.streaming.state import particle_filter

    return particle_filter(table(spark, sf_dir, "events"), "user_id", "event_id", "value", 0.9, 1.0, 5.0)


@query(f"""with {BASE}, c as (select seg, region, avg(t) as p from base group by 1, 2), w as (select y, p from base join c using (seg, region) where t = 1.0)
select round(sum(y / p) / sum(1 / p), 4) as mean, count(*) as n from w""")
def do_weighting(spark, sf_dir):
    from causelake.operators.response import do_weighting as weighted

    return rounded(weighted(orders_frame(spark, sf_dir), "t", "y", ["seg", "region"], 1.0))


@query("""with g as (select l_quantity as t, unnest([5.0, 25.0, 60.0])::double as dose from lineitem), w as (select *, exp(-0.5 * ((t - dose) / 2.0) ** 2) as w from g)
select dose, round(sum(w) ** 2 / sum(w * w), 2) as ess, dose between min(t) and max(t) as inside,
  case when not (dose between min(t) and max(t)) then 'out of range' when sum(w) ** 2 / sum(w * w) < 30 then 'weak' else 'strong' end as support from w group by 1""")
def support_report(spark, sf_dir):
    from causelake.operators.response import support_report as report

    return rounded(report(table(spark, sf_dir, "lineitem"), "l_quantity", [5.0, 25.0, 60.0], 2.0), 2)


@query("""with g as (select l_tax as d, l_quantity as q, l_extendedprice as p from lineitem),
s as (select corr(q, p) as qp, corr(q, d) as qd, corr(p, d) as pd from g)
select round(sqrt((qd * qd + pd * pd - 2 * qd * pd * qp) / (1 - qp * qp)), 6) as correlation from s""")
def canonical_correlation(spark, sf_dir):
    from causelake.operators.response import multivariate_parcorr

    return rounded(multivariate_parcorr(table(spark, sf_dir, "lineitem"), ["l_tax"], ["l_quantity", "l_extendedprice"]).select("correlation"), 6)


@query()
def gam_derivative(spark, sf_dir):
    from causelake.operators.response import gam_derivative as derivative

    return derivative(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", ["l_tax"], [10.0, 25.0, 40.0])


@query()
def intervention_response(spark, sf_dir):
    from causelake.operators.response import intervention_response as response

    li = table(spark, sf_dir, "lineitem").withColumn("key", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    policies = {"set": ("set", 0.05), "shift": ("shift", 0.01), "mixture": ("stochastic", [(0.02, 0.5), (0.08, 0.5)])}
    return response(li, "l_discount", "l_extendedprice", ["l_quantity"], policies, "key")


@query()
def multinomial_segments(spark, sf_dir):
    from causelake.operators.response import multinomial_logit

    o = orders_frame(spark, sf_dir).withColumn("scaled", F.col("acct") / 1000)
    levels = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    fit = multinomial_logit(o, "seg", ["1", "scaled"], levels)
    return spark.createDataFrame([(k, v["1"], v["scaled"]) for k, v in fit.items()], "level string, intercept double, slope double")


@query()
def mean_discrepancy(spark, sf_dir):
    from causelake.operators.response import mmd

    return mmd(orders_frame(spark, sf_dir).withColumn("g", F.col("t") > 0.5), ["y"], "g", "o_orderkey", 49)
