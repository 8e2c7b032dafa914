"""Driver queries of structural models, priors and retention, each with an independent SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from causelake import api
from causelake.functions import transforms as tf
from causelake.graphs.dag import Dag
from causelake.operators import estimate as est
from causelake.operators import models, priors
from causelake.operators import series as ser
from causelake.operators import validate as val
from causelake.operators.reduce import gram
from causelake.operators.scm import Model
from causelake.plans import expr
from causelake.plans import identify as idf
from causelake.queries import BASE, CHAIN, _chain, orders_frame, query, rounded, table
from causelake.schema import sample, with_mask
from causelake.streaming.state import Retention

FORK = Dag(["q", "d", "p"], [("q", "d"), ("q", "p")])


@query(f"""with {CHAIN}, n as (select count(*)::double as n from li),
r as (select 'q' as node, 'constant' as family, vq as v, 0 as k, 0 as w from m union all select 'd', 'constant', vd, 0, 1 from m union all select 'd', 'linear', vd - qd * qd / vq, 1, 2 from m
union all select 'p', 'constant', vp, 0, 3 from m union all select 'p', 'linear', vp - bqp * qp - bdp * dp, 2, 4 from b),
s as (select node, family, -0.5 * n * (1 + ln(2 * pi()) + ln(v)) - 0.5 * (k + 1) * ln(n) as score from r cross join n)
select node, family, round(score, 4) as score, score = max(score) over (partition by node) as selected from s""")
def mechanism_assignment(spark, sf_dir):
    li, g = _chain(spark, sf_dir)
    return rounded(models.assign(li, g)[1], 4)


@query("""with s as (select o_orderpriority as a, o_orderstatus as b, count(*)::double as n from orders group by 1, 2), t as (select sum(n) as n, count(distinct b) as levels, count(distinct a) as strata from s),
alone as (select sum(n * ln(n / total)) as l from (select b, sum(n) as n, sum(sum(n)) over () as total from s group by b)), own as (select sum(n * ln(n / total)) as l from (select n, sum(n) over (partition by a) as total from s)),
top as (select sum(n * ln(n / total)) as l, count(*) as levels from (select a, sum(n) as n, sum(sum(n)) over () as total from s group by a)),
f as (select 'a' as node, 'discrete_root' as family, top.l - 0.5 * (top.levels - 1) * ln(t.n) as score from top, t union all select 'b', 'discrete_root', alone.l - 0.5 * (levels - 1) * ln(n) from alone, t
union all select 'b', 'discrete', own.l - 0.5 * strata * (levels - 1) * ln(n) from own, t)
select node, family, round(score, 4) as score, score = max(score) over (partition by node) as selected from f""")
def discrete_assignment(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("a"), F.col("o_orderstatus").alias("b"))
    return rounded(models.assign(o, Dag(["a", "b"], [("a", "b")]), ["a", "b"])[1], 4)


@query(f"""with {CHAIN}, f as (select *, qd / vq as fd, qp / vq as fp, vd - qd * qd / vq as sd2, vp - qp * qp / vq as sp2 from m),
a as (select avg((abs(q - mq) + abs(d - md - fd * (q - mq)) + abs(p - mp - fp * (q - mq))) / 3) as a from li cross join f)
select round((-0.5 * (ln(2 * pi() * vq) + 1) - 0.5 * (ln(2 * pi() * sd2) + 1) - 0.5 * (ln(2 * pi() * sp2) + 1)) / 3, 8) as loglik,
round((-0.5 * (ln(2 * pi() * vq) + 1) - 0.5 * (ln(2 * pi() * sd2) + (vd + fd * fd * vq) / sd2) - 0.5 * (ln(2 * pi() * sp2) + (vp + fp * fp * vq) / sp2)) / 3, 8) as permutation_loglik, round(a, 8) as mean_abs_residual from f cross join a""")
def model_evaluation(spark, sf_dir):
    """A model without the arrow from discount to price; the p-values are held against simulation by a test."""
    li, _ = _chain(spark, sf_dir)
    return rounded(models.evaluate(Model.fit(li, FORK), li).select("loglik", "permutation_loglik", "mean_abs_residual"), 8)


@query(f"""with {CHAIN}, c as (select *, vd - qd * qd / vq as sd2, vp - bqp * qp - bdp * dp as sp2, md + bqd * (30 - mq) as ed from b),
e as (select *, mp + bqp * (30 - mq) + bdp * (ed - md) as ep, bdp * bdp * sd2 + sp2 as v from c)
select round(ed + bdp * sd2 / v * (40 - ep), 8) as mean, round(sd2 - bdp * bdp * sd2 * sd2 / v, 8) as variance from e""")
def conditional_intervention(spark, sf_dir):
    """The discount when quantity is set to 30, among lines whose price then is 40 thousand."""
    li, g = _chain(spark, sf_dir)
    return rounded(spark.createDataFrame([models.conditional_moments(Model.fit(li, g), "d", {"p": 40.0}, {"q": 30.0})], "mean double, variance double"), 8)


@query(f"""with {CHAIN},
x as (select avg(q) as mq, avg(p) as mp, regr_slope(p, q) as s from li where l_returnflag = 'A'),
y as (select *, (qp * vd - qd * dp) / (vq * vd - qd * qd) as bq, (dp * vq - qd * qp) / (vq * vd - qd * qd) as bd, qd / vq as g from (
  select avg(q) as mq, avg(d) as md, avg(p) as mp, var_pop(q) as vq, var_pop(d) as vd, covar_pop(q, d) as qd, covar_pop(q, p) as qp, covar_pop(d, p) as dp from li where l_returnflag = 'R')),
z as (select avg(d) as md from li where l_returnflag = 'A'),
v as (select x.mp as v0, y.mp + y.bq * (x.mq - y.mq) + y.bd * (z.md - y.md) as vp, y.mp + y.bq * (x.mq - y.mq) + y.bd * y.g * (x.mq - y.mq) as v1 from x, y, z)
select 'p' as node, round(((vp - v0) + (v1 - v0)) / 2, 8) as contribution from v union all select 'd', round((v1 - vp) / 2, 8) from v""")
def structure_change(spark, sf_dir):
    """From quantity -> price among lines of flag A to the full chain among those of flag R."""
    li, g = _chain(spark, sf_dir)
    old = Dag(["q", "d", "p"], [("q", "p")])
    found = models.structure_change(li.where("l_returnflag = 'A'"), li.where("l_returnflag = 'R'"), old, g, "p")
    return rounded(spark.createDataFrame(sorted(found.items()), "node string, contribution double"), 8)


@query(f"""with {CHAIN} select 'q' as feature, round(abs(10 * bqp + 5 * bqd * bdp), 8) as score from b union all select 'd', round(abs(10 * bdp - 5 * bqd * bdp), 8) from b""")
def feature_relevance(spark, sf_dir):
    """Of quantity and discount for the price, each ten above its mean."""
    li, g = _chain(spark, sf_dir)
    found = models.feature_relevance(Model.fit(li, g), "p", ["q", "d"], 10.0)
    return rounded(spark.createDataFrame(sorted(found.items()), "feature string, score double"), 8)


@query("""select o_orderpriority as component, round(abs(sum(o_custkey * (o_totalprice - 150000)) / sum(o_custkey)), 4) as score,
round(sqrt(sum(o_custkey * (o_totalprice - 150000) * (o_totalprice - 150000)) / sum(o_custkey) - pow(sum(o_custkey * (o_totalprice - 150000)) / sum(o_custkey), 2)), 4) as spread from orders group by 1""")
def contribution_ranks(spark, sf_dir):
    """Weighted draws of contributions (orders, by customer number) summarised by component."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("component"), (F.col("o_totalprice") - 150000).alias("contribution"), F.col("o_custkey").cast("double").alias("w"))
    return rounded(models.posterior_ranks(o, weight="w"), 4)


@query("""with m as (select count(*)::double as n, avg(l_quantity) as mx, avg(l_extendedprice) as my, var_pop(l_quantity) as v, covar_pop(l_quantity, l_extendedprice) as c from lineitem),
k as (select 1e9 as s2), p as (select scale, n / s2 + 1 / (scale * scale) as a, n * mx / s2 as b, n * (v + mx * mx) / s2 + 1 / (scale * scale) as d, n * my / s2 as e, n * (c + mx * my) / s2 as f from m, k, (select unnest([1.0, 10.0, 100.0, 1000.0])::double as scale)),
q as (select scale, (a * f - b * e) / (a * d - b * b) as mean, sqrt(a / (a * d - b * b)) as sd from p), r as (select (max(mean) - min(mean)) / max(abs(mean)) as r from q)
select scale, round(mean, 6) as mean, round(sd, 6) as sd, round(r, 8) as relative_range, r <= 0.5 as stable from q cross join r""")
def prior_scales(spark, sf_dir):
    """The slope of price on quantity under priors of growing scale."""
    g = gram(table(spark, sf_dir, "lineitem"), {"x": "l_quantity", "y": "l_extendedprice"})
    return rounded(priors.prior_sensitivity(spark, g, "y", ["1", "x"], "x", 1e9, (1.0, 10.0, 100.0, 1000.0)), 6, relative_range=8)


@query("""with u as (select s_acctbal as e, (s_nationkey % 4)::double as w from supplier), m as (select sum(w * e) / sum(w) as mean, sum(w * e * e) / sum(w) - pow(sum(w * e) / sum(w), 2) as v, sum(w) * sum(w) / sum(w * w) as ess from u)
select round(mean, 6) as mean, round(v, 2) as variance, round(ess, 8) as effective_size, round((mean / v * 0.5 + 100 / 1e6) / (0.5 / v + 1 / 1e6), 6) as composed_mean, round(1 / (0.5 / v + 1 / 1e6), 2) as composed_variance from m""")
def transported_prior(spark, sf_dir):
    """A discounted prior of another population, its moments reweighted to the target's, composed with a baseline."""
    u = table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("e"), (F.col("s_nationkey") % 4).alias("w"))
    moments = priors.transported_moments(u, "e", "w")
    source = priors.Source("study", priors.Prior.weak(["t"], 3.0), "north", 0.5)
    ((carried, _, _),) = priors.transport([source], "south", "invariant_effect_modifiers", moments)
    p = priors.compose([carried], priors.Prior(("t",), (100.0,), (1e6,)))
    row = (*moments, p.mean[0], p.variance[0])
    return rounded(spark.createDataFrame([row], "mean double, variance double, effective_size double, composed_mean double, composed_variance double"), 6, variance=2, composed_variance=2, effective_size=8)


@query("""with c as (select s_suppkey as artifact, case when s_nationkey % 2 = 0 then 'price' else 'speed' end as treatment, case when s_nationkey % 3 = 0 then 'sales' else 'returns' end as outcome, 'ate' as estimand, s_acctbal as similarity from supplier)
select artifact, round(similarity, 2) as similarity, row_number() over (order by similarity desc, artifact) as place from c where treatment = 'price' and outcome = 'sales'""")
def prior_catalogue(spark, sf_dir):
    """Usable sources of a catalogue, most similar first."""
    from pyspark.sql import Window

    s = table(spark, sf_dir, "supplier")
    even, third = F.col("s_nationkey") % 2 == 0, F.col("s_nationkey") % 3 == 0
    c = s.select(F.col("s_suppkey").alias("artifact"), F.when(even, "price").otherwise("speed").alias("treatment"), F.when(third, "sales").otherwise("returns").alias("outcome"), F.lit("ate").alias("estimand"), F.lit(None).cast("string").alias("units"))
    ranked = priors.rank_sources(priors.compatible(c, "price", "sales"), s.select(F.col("s_suppkey").alias("artifact"), F.col("s_acctbal").alias("similarity")))
    # the catalogue is one row a study, so its places may be numbered in one task
    return ranked.select("artifact", F.round("similarity", 2).alias("similarity"), F.row_number().over(Window.orderBy(F.col("similarity").desc(), "artifact")).cast("long").alias("place"))


@query("""select user_id, count(*) as kept, min(event_id) as first_event, max(event_id) as last_event, round(sum(value), 4) as total from (
select *, row_number() over (partition by user_id order by event_id desc) as r from events) where r <= 5 group by 1""")
def retained_window(spark, sf_dir):
    """The latest five events of each user, as a window retention policy keeps them."""
    e = Retention("window", 5).keep(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "event_id", ["user_id"])
    return rounded(e.groupBy("user_id").agg(F.count("*").alias("kept"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"), F.sum("value").alias("total")), 4)


@query("""with s as (select s_suppkey, case when s_suppkey % 3 = 0 then 0.0 else 1.0 end::double as y from supplier)
select s_suppkey, y, round(ln(0.5), 6) as value_at_zero, round((2 * y - 1) * sqrt(2 / pi()), 5) as score_at_zero, round(2 / pi(), 5) as curvature_at_zero from s""")
def probit_terms(spark, sf_dir):
    """Likelihood terms of a probit at a predictor of 0, whose values are known: ln 1/2, +-sqrt(2 / pi), 2 / pi."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, 0.0).otherwise(1.0).alias("y"))
    t = tf.likelihood_terms("probit", F.col("y"), F.lit(0.0))
    return s.select("s_suppkey", "y", F.round(t["value"], 6).alias("value_at_zero"), F.round(t["score"], 5).alias("score_at_zero"), F.round(t["curvature"], 5).alias("curvature_at_zero"))


# --- matching, holdouts, policies, schedules


@query(f"""with {BASE}, a as (select * from base where t > 0.5), d as (select acct, min(o_orderkey) as k, arg_min(y, o_orderkey) as dy from base where t <= 0.5 group by 1),
m as (select a.o_orderkey, a.y, arg_min({{'k': d.k, 'y': dy}}, {{'d': abs(a.acct - d.acct), 'k': d.k}}) as b from a cross join d group by 1, 2),
p as (select b.k as k, y - b.y as gap from m), u as (select k, count(*)::double as n from p group by 1),
c as (select o_orderkey as k, y, acct - lag(acct) over w as down, lag(y) over w as py, lead(acct) over w - acct as up, lead(y) over w as ny from base where t <= 0.5 window w as (order by acct, o_orderkey)),
x as (select coalesce(sum(n * (n - 1) * 0.5 * pow(y - case when down is not null and (up is null or down <= up) then py else ny end, 2)), 0) as x from u join c using (k))
select round(avg(gap), 4) as effect, round(sqrt(count(*) * var_pop(gap) + max(x)) / count(*), 4) as se, count(*) as n from p cross join x""")
def matched_effect_error(spark, sf_dir):
    """Matches on the account balance, with the error that counts how often a donor serves."""
    o = orders_frame(spark, sf_dir)
    return rounded(est.matched_error(est.nearest_match(o, "t", "y", "acct", "o_orderkey"), o, "t", "y", "acct", "o_orderkey"))


@query("""with e as (select l_returnflag as f, l_quantity as x, l_extendedprice as y from lineitem), g as (select distinct f from e),
b as (select g.f, regr_slope(y, x) as s, regr_intercept(y, x) as i from g join e on e.f <> g.f group by 1)
select e.f as environment, count(*) as n, round(sqrt(avg(pow(y - i - s * x, 2))), 4) as rmse from e join b on e.f = b.f group by 1""")
def environment_holdout(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    return rounded(ser.holdout_errors(li, "y", ["x"], "l_returnflag"))


@query("""select case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'discovery' else 'estimation' end as part, count(*) as n from orders where o_orderpriority in ('1-URGENT', '2-HIGH', '3-MEDIUM') group by 1""")
def regime_holdout(spark, sf_dir):
    return ser.group_holdout(table(spark, sf_dir, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"], 2).groupBy("part").agg(F.count("*").alias("n"))


@query("""with e as (select case when s_suppkey % 4 = 0 then null else s_acctbal end as v, s_nationkey < 15 as m from supplier)
select 'honor' as mask, count(*) as n, round(sum(v), 2) as total from e where m and v is not null union all select 'ignore', count(*), round(sum(v), 2) from e where v is not null""")
def sample_policies(spark, sf_dir):
    s = with_mask(table(spark, sf_dir, "supplier").select(F.when(F.col("s_suppkey") % 4 != 0, F.col("s_acctbal")).alias("v"), "s_nationkey"), F.col("s_nationkey") < 15)
    parts = [sample(s, ["v"], mask=m).agg(F.lit(m).alias("mask"), F.count("*").alias("n"), F.round(F.sum("v"), 2).alias("total")) for m in ("honor", "ignore")]
    return parts[0].unionByName(parts[1])


@query("""with e as (select 0.02 + 0.96 * (s_nationkey / 24.0) as e from supplier), r as (select avg(case when e between 0.1 and 0.9 then 1.0 else 0.0 end) as kept from e)
select 'overlap.rule' as validator, case when kept >= 0.5 then 'pass' else 'fail' end as verdict, round(kept::double, 8) as statistic, 0.5::double as reference from r""")
def overlap_rule(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select((F.lit(0.02) + 0.96 * (F.col("s_nationkey") / 24.0)).alias("e"), (F.col("s_suppkey") % 2).cast("double").alias("t"))
    return rounded(val.overlap_rule(s, "t").drop("detail"), 8)


SCHEDULE = Dag(["a", "l", "b", "y"], [("a", "l"), ("a", "y"), ("l", "b"), ("l", "y"), ("b", "y")])


@query("""with e as (select l_orderkey % 2 as a, l_linenumber % 3 as l, l_suppkey % 2 as b, floor(l_quantity / 10)::bigint as y from lineitem),
m as (select a, l, b, avg(y) as m from e group by 1, 2, 3), p as (select a, l, count(*)::double / sum(count(*)) over (partition by a) as p from e group by 1, 2)
select round(sum(case when a = 1 then p * m else -p * m end), 8) as value from p join m using (a, l) where a = b""")
def schedule_contrast(spark, sf_dir):
    """Two treatments set one after the other, with a variable between that the first moves and the second follows."""
    li = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 2).alias("a"), (F.col("l_linenumber") % 3).alias("l"), (F.col("l_suppkey") % 2).alias("b"), F.floor(F.col("l_quantity") / 10).alias("y"))
    e = idf.identify_schedule(SCHEDULE, "y", ["a", "b"])
    return rounded(expr.schedule_contrast(e.functional, li, "y", {"a": 1, "b": 1}, {"a": 0, "b": 0}), 8)


@query("""with e as (select user_id, event_id, value as y, lag(value) over w as x from events window w as (partition by user_id order by event_id)), d as (select * from e where event_id % 5 <> 0 and x is not null and y is not null),
b as (select regr_slope(y, x) as s, regr_intercept(y, x) as i, avg(x) as mx, var_pop(x) as v, count(*) as n from d),
r as (select user_id, event_id, (y - i - s * x) * (x - mx) as q from d cross join b),
k as (select sum(q * q) as own from r), h as (select l, sum(r.q * o.q) as c from r join (select unnest([1, 2]) as l) on true join r o on o.user_id = r.user_id and o.event_id = r.event_id - l group by 1)
select round(max(s), 8) as effect, round(sqrt(max(own) + 2 * sum((1 - l / 3.0) * c)) / max(n * v), 8) as se from b cross join k cross join h""")
def panel_error(spark, sf_dir):
    """A panel with gaps: lags in the error go by the time label."""
    from pyspark.sql import Window

    from causelake.operators.reduce import sandwich, solve

    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("value").alias("y"))
    e = e.withColumn("x", F.lag("y").over(Window.partitionBy("user_id").orderBy("event_id"))).where("event_id % 5 <> 0 and x is not null and y is not null")
    fit = solve(gram(e, ["x", "y"]), "y", ["1", "x"])
    cov = sandwich(e, fit, "y", "panel_hac", ["user_id"], "event_id", 2)
    return rounded(spark.createDataFrame([(fit["x"], float(cov[1, 1]) ** 0.5)], "effect double, se double"), 8)


# --- queries by class


@query(f"""with {CHAIN}, n as (select mp + bqp * (30 - mq) as m, bqp, bdp, bqd, qp / vq as slope, dp / vd as dslope, mq, md from b)
select 'elasticity' as query, round(slope * 30 / (mp + slope * (30 - m.mq)), 8) as value from n, m union all select 'semi', round(slope / (mp + slope * (30 - m.mq)), 8) from n, m
union all select 'point', round(slope, 8) from n union all select 'direction', round(0.6 * bqp + 0.8 * bdp, 8) from n
union all select 'jacobian p q', round(slope, 8) from n union all select 'jacobian p d', round(bdp, 8) from n union all select 'jacobian d q', round(bqd, 8) from n
union all select 'mediated', round(10 * bqd * bdp, 8) from n union all select 'direct', round(10 * bqp, 8) from n""")
def derivative_queries(spark, sf_dir):
    """Point slopes, elasticities, a direction, a Jacobian and a mediation query over the chain, linear in the doses."""
    li, g = _chain(spark, sf_dir)
    ask = lambda q: api.answer(li, g, q)
    value = lambda name, q, c="effect": ask(q).select(F.lit(name).alias("query"), F.col(c).alias("value"))
    parts = [
        value("elasticity", api.Elasticity("q", "p", 30.0, 1)), value("semi", api.SemiElasticity("q", "p", 30.0, 1)), value("point", api.PointDerivative("q", "p", 30.0, 1)),
        value("direction", api.DirectionalDerivative("p", (("q", 0.6, 30.0), ("d", 0.8, 5.0)), 1), "derivative"), value("mediated", api.MediationEffect("q", "p", ("d",), 30.0, 20.0), "mediated"),
        value("direct", api.MediationEffect("q", "p", ("d",), 30.0, 20.0), "direct"),
        ask(api.ResponseJacobian(("q", "d"), ("p",), degree=1)).select(F.concat_ws(" ", F.lit("jacobian"), "outcome", "treatment").alias("query"), F.col("derivative").alias("value")),
        ask(api.ResponseJacobian(("q",), ("d",), degree=1)).select(F.concat_ws(" ", F.lit("jacobian"), "outcome", "treatment").alias("query"), F.col("derivative").alias("value")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return rounded(out, 8)


@query("""with e as (select user_id, value as y, lag(value, 1) over w as x1, lag(value, 2) over w as x2 from events window w as (partition by user_id order by event_id)), d as (select * from e where y is not null and x1 is not null and x2 is not null),
s as (select var_pop(x1) as va, var_pop(x2) as vb, covar_pop(x1, x2) as ab, covar_pop(x1, y) as ay, covar_pop(x2, y) as byy from d)
select round(3 * ((ay * vb - ab * byy) + (byy * va - ab * ay)) / (va * vb - ab * ab), 8) as effect, 2::bigint as steps from s""")
def sustained_effect(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("value").alias("x"), F.col("value").alias("y"))
    return rounded(api.answer(e, None, api.SustainedEffect("x", "y", (1, 2), "event_id", ("user_id",), 3.0)), 8)
