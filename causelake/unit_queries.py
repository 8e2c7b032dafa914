"""Driver queries of single operators that the larger queries do not show, each with an independent SQL twin."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from causelake.functions import special
from causelake.functions import transforms as tf
from causelake.graphs.dag import Admg, Dag, Mixed, unfold
from causelake.operators import bayes, ci
from causelake.operators import estimate as est
from causelake.operators import reduce as red
from causelake.operators import response as rs
from causelake.operators import series as ser
from causelake.operators import validate as val
from causelake.plans import identify as idf
from causelake.queries import BASE, CELLS, CHAIN, LAGGED, MOMENTS, RESIDUALS, _chain, _scored, orders_frame, query, rounded, table
from causelake.sources import frames, graphs

# --- graphs and identification: facts derived by hand, held as SQL values

FRONT = Admg(["t", "m", "y"], [("t", "m"), ("m", "y")], [("t", "y")])
ROOM = Dag(["a", "b", "t", "m", "y", "c"], [("a", "t"), ("a", "b"), ("b", "y"), ("t", "m"), ("m", "y"), ("t", "c"), ("y", "c")])


def _joined(items) -> str:
    return ",".join(sorted(items))


def _facts(spark, facts):
    return spark.createDataFrame([(k, str(v)) for k, v in facts.items()], "fact string, value string")


def _values(**facts: str) -> str:
    rows = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in facts.items())
    return f"select * from (values {rows}) as t(fact, value)"


@query(_values(
    ancestors_of_m="a,m,t", descendants_of_t="c,m,t,y", blanket_of_t="a,c,m,y", roots_first="a", paths_t_to_y="t>m>y", t_y_given_a="False", t_y_given_a_m="True", t_b_given_a="True", t_b_given_a_c="False",
    districts="m|t,y", hidden_cause="t<->y", front_separated="False", class_members="3", class_marks="a---b,b---c", collider_marks="a-->c,b-->c", unfolded="x@0>y@1,x@1>y@2,y@0>y@1,y@1>y@2",
))
def graph_facts(spark, sf_dir):
    """Reachability, separation, districts, projection, equivalence classes and unfolding of small graphs."""
    hidden = Dag(["u", "t", "y"], [("u", "t"), ("u", "y")]).latent_projection(["t", "y"])
    chain, collider = Mixed.from_dag(Dag(["a", "b", "c"], [("a", "b"), ("b", "c")])), Mixed.from_dag(Dag(["a", "b", "c"], [("a", "c"), ("b", "c")]))
    marks = lambda g: _joined("".join(e) for e in g.edges())
    return _facts(spark, {
        "ancestors_of_m": _joined(ROOM.ancestors(["m"])), "descendants_of_t": _joined(ROOM.descendants(["t"])), "blanket_of_t": _joined(ROOM.markov_blanket("t")), "roots_first": ROOM.order()[0],
        "paths_t_to_y": "|".join(">".join(x) for x in ROOM.directed_paths("t", "y")[0]), "t_y_given_a": ROOM.separated(["t"], ["y"], ["a"]), "t_y_given_a_m": ROOM.separated(["t"], ["y"], ["a", "m"]),
        "t_b_given_a": ROOM.separated(["t"], ["b"], ["a"]), "t_b_given_a_c": ROOM.separated(["t"], ["b"], ["a", "c"]), "districts": "|".join(sorted(map(_joined, FRONT.districts()))),
        "hidden_cause": _joined("<->".join(sorted(e)) for e in hidden.bidirected), "front_separated": FRONT.separated(["t"], ["y"], ["m"]), "class_members": len(list(chain.dags())), "class_marks": marks(chain),
        "collider_marks": marks(collider), "unfolded": _joined(f"{a}>{b}" for a, b in unfold([("x", 1, "y"), ("y", 1, "y")], 3).edges if a[:1] in "xy"),
    })


@query(_values(
    backdoor="a", efficient="b", minimal_sets="a|b", frontdoor="m", instrument="z", id_hedge="refused", transport="transportable", temporal="x__lag2", mediation="x1m>m1y|x2y", reviewed="a>b",
))
def identification_facts(spark, sf_dir):
    """Back-door, efficient, front-door, instrument, transport and temporal identification of small graphs."""
    from causelake.errors import CausalError

    iv = Admg(["z", "t", "y"], [("z", "t"), ("t", "y")], [("t", "y")])
    bow = Admg(["t", "y"], [("t", "y")], [("t", "y")])
    try:
        idf.identify_do(bow, ["y"], ["t"])
        hedge = "identified"
    except CausalError:
        hedge = "refused"
    try:
        idf.transport_certificate(Dag(["z", "t", "y"], [("z", "y"), ("t", "y")]), "t", "y", ["z"])
        transport = "transportable"
    except CausalError:
        transport = "refused"
    sets = [",".join(sorted(z)) for z in idf.backdoor_sets(ROOM, "t", "y")[0]]
    template = [("x", 1, "m"), ("m", 1, "y"), ("x", 2, "y")]
    paths = ["".join(">".join(f"{a}{k}{b}" for a, k, b in path)) for path in idf.temporal_mediation(template, "x", "y", 2)]
    review = idf.Review(Mixed.from_dag(Dag(["a", "b"], [("a", "b")])))
    review.orient("a", "b")
    return _facts(spark, {
        "backdoor": _joined(idf.backdoor(ROOM, "t", "y").adjustment), "efficient": _joined(idf.efficient_backdoor(ROOM, "t", "y").adjustment), "minimal_sets": "|".join(sorted(sets)),
        "frontdoor": _joined(idf.frontdoor(FRONT, "t", "y").mediators), "instrument": _joined(idf.instrument(iv, "t", "y").instruments), "id_hedge": hedge, "transport": transport,
        "temporal": _joined(idf.temporal_backdoor([("x", 1, "x"), ("x", 1, "y")], "x", "y", 1).adjustment), "mediation": "|".join(sorted(paths)), "reviewed": _joined(">".join(e) for e in review.accept().edges),
    })


@query(_values(dot="m>y,t>m;t<->y", json="m>y,t>m;t<->y", gml="m>y,t>m;t<->y", node_link="m>y,t>m;t<->y", adjacency="a>b,a>t,b>y,m>y,t>c,t>m,y>c", edge_frame="m>y,t>m;t<->y"))
def graph_formats(spark, sf_dir):
    """A graph written and read back in each format."""
    said = lambda g: ";".join(x for x in (_joined(">".join(e) for e in g.edges), _joined("<->".join(sorted(e)) for e in g.bidirected)) if x)
    g = FRONT
    return _facts(spark, {
        "dot": said(graphs.from_dot(graphs.to_dot(g))), "json": said(graphs.from_json(graphs.to_json(g))), "gml": said(graphs.from_gml(graphs.to_gml(g))), "node_link": said(graphs.from_node_link(graphs.to_node_link(g))),
        "adjacency": said(graphs.from_adjacency(graphs.to_adjacency(ROOM))), "edge_frame": said(graphs.from_edge_frame(graphs.edge_frame(spark, g))),
    })


# --- special functions against quadrature

SIMPSON = "sum(case when i = 0 or i = 4000 then 1 when i % 2 = 1 then 4 else 2 end * ({f})) * {w} / 4000 / 3"
STEPS = "(select unnest(range(0, 4001)) as i)"


@query(f"""with g as (select unnest([-2.5, -1.0, 0.3, 1.96, 4.0])::double as x),
c as (select x, 0.5 + {SIMPSON.format(f='exp(-0.5 * (x * i / 4000) ** 2) / sqrt(2 * pi())', w='x')} as v from g cross join {STEPS} group by 1),
h as (select unnest([0.5, 2.0, 7.5])::double as x), b as (select x, {SIMPSON.format(f='(x / (1 + x) * i / 4000) ** 2 * (1 - x / (1 + x) * i / 4000) ** 3 * 60', w='(x / (1 + x))')} as v from h cross join {STEPS} group by 1),
k as (select x, 1 - {SIMPSON.format(f='(x * i / 4000) * exp(-x * i / 4000 / 2) / 4', w='x')} as v from h cross join {STEPS} group by 1)
select 'normal cdf' as name, x, round(v, 9) as value from c union all select 'normal sf', x, round(1 - v, 9) from c
union all select 'normal pdf', x, round(exp(-0.5 * x * x) / sqrt(2 * pi()), 9) from g union all select 'beta cdf', x, round(v, 9) from b union all select 'chi2 sf', x, round(v, 9) from k""")
def special_functions(spark, sf_dir):
    rows = []
    for x in (-2.5, -1.0, 0.3, 1.96, 4.0):
        rows += [("normal cdf", x, special.norm_cdf(x)), ("normal sf", x, special.norm_sf(x)), ("normal pdf", x, special.norm_pdf(x))]
    for x in (0.5, 2.0, 7.5):
        rows += [("beta cdf", x, special.beta_cdf(x / (1 + x), 3, 4)), ("chi2 sf", x, special.chi2_sf(x, 4))]
    return rounded(spark.createDataFrame(rows, "name string, x double, value double"), 9)


@query("""select l_orderkey % 3 as g, round(sum(exp(-0.5 * ((l_quantity - 25) / 8.0) ** 2) / (8.0 * sqrt(2 * pi()))), 6) as density,
  round(sum(yb * e - ln(1 + exp(e))), 4) as logit_value, round(sum(yb - 1 / (1 + exp(-e))), 4) as logit_score, round(sum(l_linenumber * e - exp(e)), 4) as poisson_value,
  round(sum(exp(e)), 4) as poisson_curvature, round(sum(-0.5 * (l_discount - e) ** 2), 4) as gaussian_value
from (select *, case when l_returnflag = 'R' then 1.0 else 0.0 end as yb, l_quantity / 25.0 - 1 as e from lineitem) group by 1""")
def likelihood_sums(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("yb", (F.col("l_returnflag") == "R").cast("double")).withColumn("e", F.col("l_quantity") / 25.0 - 1)
    e = F.col("e")
    logit, poisson, gaussian = (tf.likelihood_terms(f, F.col(c), e) for f, c in (("logit", "yb"), ("poisson", "l_linenumber"), ("gaussian", "l_discount")))
    return rounded(li.groupBy((F.col("l_orderkey") % 3).alias("g")).agg(
        F.sum(tf.gaussian_density(F.col("l_quantity"), 25.0, 8.0)).alias("density"), F.sum(logit["value"]).alias("logit_value"), F.sum(logit["score"]).alias("logit_score"),
        F.sum(poisson["value"]).alias("poisson_value"), F.sum(poisson["curvature"]).alias("poisson_curvature"), F.sum(gaussian["value"]).alias("gaussian_value"),
    ), 4, density=6)


@query("""select q, greatest(0.0, 1 - abs(q - 1) / 24.0) as b0, greatest(0.0, 1 - abs(q - 25) / (case when q < 25 then 24.0 else 25.0 end)) as b1, greatest(0.0, 1 - abs(q - 50) / 25.0) as b2
from (select distinct l_quantity::double as q from lineitem)""")
def linear_spline(spark, sf_dir):
    """A B-spline basis of degree one: hats over the knots 1, 25, 50."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("q")).distinct()
    basis = tf.bspline_columns(F.col("q"), [1.0, 1.0, 25.0, 50.0, 50.0], 1)
    return rounded(li.select("q", *[b.alias(f"b{i}") for i, b in enumerate(basis)]), 12)


@query("""select l_linestatus, round(avg(0.05::double), 6) as set_mean, round(avg(l_discount + 0.01), 6) as shift_mean, round(avg(-3.0 * l_discount), 6) as log_treatment,
  round(avg(-3.0 / l_quantity), 6) as log_outcome, round(avg(-3.0 * l_discount / l_quantity), 6) as log_log from lineitem group by 1""")
def intervention_levels(spark, sf_dir):
    t, y = F.col("l_discount"), F.col("l_quantity")
    scale = lambda k: F.avg(tf.derivative_scale(k, F.lit(-3.0), t, y)).alias(k)
    return rounded(table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(
        F.avg(tf.intervened("l_discount", "set", 0.05)).alias("set_mean"), F.avg(tf.intervened("l_discount", "shift", 0.01)).alias("shift_mean"), scale("log_treatment"), scale("log_outcome"), scale("log_log"),
    ), 6)


@query("""select count(*) as n, round(sum(embedding[1]), 4) as s0, round(sum(embedding[2]), 4) as s1, round(sum(embedding[3]), 4) as s2 from embeddings""")
def expanded_vectors(spark, sf_dir):
    e = tf.expand_vector(table(spark, sf_dir, "embeddings"), "embedding", 3)
    return rounded(e.agg(F.count("*").alias("n"), *[F.sum(f"embedding_{i}").alias(f"s{i}") for i in range(3)]), 4)


# --- populations, masks, weights, splits


@query(f"""with {BASE} select 'all' as population, round(avg(y), 4) as mean, count(*)::bigint as n from base union all select 'masked', round(avg(y), 4), count(*) from base where region <> 2
union all select 'predicate', round(avg(y), 4), count(*) from base where acct > 5000 union all select 'environment', round(avg(y), 4), count(*) from base where t > 0.5
union all select 'weighted', round(sum(y * greatest(acct, 0)) / sum(greatest(acct, 0)), 4), count(*) from base union all select 'rows', round(avg(y), 4), count(*) from base where o_orderkey in (select o_orderkey from orders where o_orderkey % 7 = 0)""")
def populations(spark, sf_dir):
    """Means over target populations, an analysis mask and clipped row weights."""
    from causelake import schema

    o = orders_frame(spark, sf_dir)
    mean = lambda df, k: df.agg(F.lit(k).alias("population"), F.avg("y").alias("mean"), F.count("*").alias("n"))
    both = frames.environments({"high": o.where("t > 0.5"), "low": o.where("t <= 0.5")})
    weighted = schema.with_weight(o, F.col("acct"))
    masked = schema.with_mask(o, F.col("region") != 2)
    parts = [
        mean(o, "all"), mean(masked.where(schema.valid(masked, ["y"])), "masked"), mean(schema.population(o, "predicate", where=F.col("acct") > 5000), "predicate"),
        mean(schema.population(both, "environment", value="high"), "environment"),
        weighted.agg(F.lit("weighted").alias("population"), (F.sum(F.col("y") * F.col(schema.WEIGHT)) / F.sum(schema.WEIGHT)).alias("mean"), F.count("*").alias("n")),
        mean(schema.population(o, "rows", key="o_orderkey", ids=table(spark, sf_dir, "orders").where("o_orderkey % 7 = 0").select("o_orderkey")), "rows"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return rounded(out)


@query(f"""with {BASE}, c as (select seg, avg(t) as e, count(*) as n from base group by 1), d as (select seg, region, avg(t) as e, count(*) as n from base group by 1, 2)
select 'seg' as adjustment, round(sum(case when least(e, 1 - e) < 0.3 then n else 0 end) / sum(n)::double, 8) as violating, round(min(least(e, 1 - e)), 8) as least_share from c
union all select 'seg,region', round(sum(case when least(e, 1 - e) < 0.3 then n else 0 end) / sum(n)::double, 8), round(min(least(e, 1 - e)), 8) from d""")
def positivity_ranking(spark, sf_dir):
    return rounded(est.rank_by_positivity(orders_frame(spark, sf_dir), "t", [["seg"], ["seg", "region"]], 0.3), 8)


# --- estimators and their errors


@query(f"""with {BASE}, {MOMENTS}, {RESIDUALS}
select 'HC0' as kind, round(sqrt(sum(x * x * u * u)) / sum(x * x), 4) as se from e""")
def sandwich_hc0(spark, sf_dir):
    o = orders_frame(spark, sf_dir)
    fit = red.solve(red.gram(o, ["t", "acct", "y"]), "y", ["1", "t", "acct"])
    i = fit.names.index("t")
    return rounded(spark.createDataFrame([("HC0", math.sqrt(red.sandwich(o, fit, "y", "HC0")[i, i]))], "kind string, se double"))


@query(f"""with {BASE}, s as (select avg(t) as mt, avg(y) as my, count(*)::double as n, var_pop(t) as vt, regr_slope(y, t) as b from base),
e as (select (t - mt) as x, (y - my) - b * (t - mt) as u, 1 / n + (t - mt) ** 2 / (n * vt) as h from base cross join s)
select 'HC2' as kind, round(sqrt(sum(x * x * u * u / (1 - h))) / sum(x * x), 4) as se from e union all select 'HC3', round(sqrt(sum(x * x * u * u / (1 - h) ** 2)) / sum(x * x), 4) from e""")
def sandwich_leverage(spark, sf_dir):
    o = orders_frame(spark, sf_dir)
    fit = red.solve(red.gram(o, ["t", "y"]), "y", ["1", "t"])
    return rounded(spark.createDataFrame([(k, math.sqrt(red.sandwich(o, fit, "y", k)[1, 1])) for k in ("HC2", "HC3")], "kind string, se double"))


@query(f"""with {BASE}, s as (select avg(t) as mt, avg(y) as my, regr_slope(y, t) as b from base), e as (select o_custkey as a, region as r, (t - mt) * ((y - my) - b * (t - mt)) as s, (t - mt) ** 2 as xx from base cross join s),
m as (select (select count(*)::double from e) as n, (select sum(xx) from e) as xx), ga as (select sum(s) as s from e group by a), gr as (select sum(s) as s from e group by r), gb as (select sum(s) as s from e group by a, r),
p as (select (select count(*) / (count(*) - 1.0) * sum(s * s) from ga) + (select count(*) / (count(*) - 1.0) * sum(s * s) from gr) - (select count(*) / (count(*) - 1.0) * sum(s * s) from gb) as meat)
select round(sqrt(meat * (n - 1) / (n - 2)) / xx, 4) as se from p cross join m""")
def two_way_clusters(spark, sf_dir):
    o = orders_frame(spark, sf_dir)
    fit = red.solve(red.gram(o, ["t", "y"]), "y", ["1", "t"])
    return rounded(spark.createDataFrame([(math.sqrt(red.sandwich(o, fit, "y", "cluster", ["o_custkey", "region"])[1, 1]),)], "se double"))


@query("""with s as (select avg(x) as mx, avg(y) as my, regr_slope(y, x) as b, count(*) as n from (select event_id::double as x, value as y from events)),
e as (select event_id, (event_id - mx) as x, (value - my) - b * (event_id - mx) as u from events cross join s),
l as (select x * u as s, lag(x * u, 1) over w as s1, lag(x * u, 2) over w as s2, x * x as xx from e window w as (order by event_id))
select round(sqrt(sum(s * s) + 2 * (2 / 3.0 * sum(s * s1) + 1 / 3.0 * sum(s * s2))) / sum(xx), 9) as se from l""")
def newey_west(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_id").cast("double").alias("x"), F.col("value").alias("y"))
    fit = red.solve(red.gram(e, ["x", "y"]), "y", ["1", "x"])
    return rounded(spark.createDataFrame([(math.sqrt(red.sandwich(e, fit, "y", "newey_west", time="event_id", max_lag=2)[1, 1]),)], "se double"), 9)


@query(f"""with {BASE}, s as (select corr(acct, y) as r, stddev_pop(y) as sy, stddev_pop(acct) as sx, avg(y) as my, avg(acct) as mx, covar_pop(acct, y) as c from base)
select round(case when c / sx > 0 then greatest(abs(c / sx) - 500, 0) else -greatest(abs(c / sx) - 500, 0) end / sx, 8) as lasso, round(c / (sx * sx) / 1.5, 8) as ridge from s""")
def shrunken_slopes(spark, sf_dir):
    """Lasso (penalty 500 on the standardised slope) and ridge (half a unit on the correlation scale) of one regressor."""
    g = red.gram(orders_frame(spark, sf_dir), ["acct", "y"])
    return rounded(spark.createDataFrame([(red.lasso(g, "y", ["1", "acct"], 500.0)["acct"], red.solve(g, "y", ["1", "acct"], 0.5)["acct"])], "lasso double, ridge double"), 8)


@query("""with x as (select 1704067200.0 + ((l_orderkey * 37) % 86400) as t, l_quantity as y from lineitem)
select round(regr_slope(y, t), 9) as slope, round(regr_intercept(y, t - 1704067200.0), 6) as at_midnight from x""")
def large_means(spark, sf_dir):
    """A regressor of epoch seconds over one day: its mean is twenty thousand times its spread."""
    x = table(spark, sf_dir, "lineitem").select((F.lit(1704067200.0) + (F.col("l_orderkey") * 37) % 86400).alias("t"), F.col("l_quantity").alias("y"))
    fit = red.solve(red.gram(x, ["t", "y"]), "y", ["1", "t"])
    return spark.createDataFrame([(round(fit["t"], 9), round(fit["1"] + fit["t"] * 1704067200.0, 6))], "slope double, at_midnight double")


@query(f"""with {CELLS} select round(avg(t / e - (1 - t) / (1 - e)), 6) as mean, round(avg((t / e - (1 - t) / (1 - e)) ** 2), 6) as second_moment, round(max(abs(t / e - (1 - t) / (1 - e))), 6) as largest from w""")
def riesz_representer(spark, sf_dir):
    return rounded(val.riesz_sensitivity(_scored(spark, sf_dir), "t"), 6)


@query(f"""with {BASE}, {MOMENTS}, f as (select b1, sqrt(n * (vy - b1 * ty - b2 * zy) / (n - 3) * vz / (n * (vt * vz - tz * tz))) as se, n - 3 as dof from b),
g as (select unnest([0.01, 0.05, 0.1, 0.2])::double as a), r as (select g.a, h.a as c, b1, se, dof, se * sqrt(dof * h.a * g.a / (1 - g.a)) as bias, abs(b1 / se) / sqrt(dof) as f from f cross join g cross join (select a from g) h)
select a as r2_treatment, c as r2_outcome, round(b1 - sign(b1) * bias, 4) as adjusted, round(bias, 4) as bias, round(0.5 * (sqrt(f ** 4 + 4 * f * f) - f * f), 8) as robustness_value from r""")
def partial_r2_bounds(spark, sf_dir):
    return rounded(val.partial_r2_grid(orders_frame(spark, sf_dir), "t", "y", ["acct"]), 4, robustness_value=8, r2_treatment=8, r2_outcome=8)


@query(f"""with {BASE}, {MOMENTS}, o as (select regr_slope(y, t) as b0 from base) select round(abs(b0 - b1) / abs(b1), 6) as statistic, round(b1, 4) as reference from b cross join o""")
def leave_one_out(spark, sf_dir):
    r = val.leave_one_out(orders_frame(spark, sf_dir), "t", "y", ["acct"])
    names = r.columns
    return rounded(r.select(F.col(names[2]).alias("statistic"), F.col(names[3]).alias("reference")), 4, statistic=6)


@query("""with s as (select l_discount as t, l_quantity as z, l_extendedprice as y, l_linenumber <= 3 as i from lineitem),
m as (select avg(t) as mt, avg(t * t) as mt2, avg(z) as mz from s where not i), f as (select avg(z) as z, avg(t) as t from s)
select dose, round(avg(dose + z), 6) as mean from (select unnest([0.02, 0.06])::double as dose) cross join s where not i group by 1""")
def transported_means(spark, sf_dir):
    """A response fitted in the trial rows (here exactly dose + covariate) carried to the target's covariates."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_discount").alias("t"), F.col("l_quantity").cast("double").alias("z"), (F.col("l_discount") + F.col("l_quantity")).alias("y"), (F.col("l_linenumber") <= 3).alias("i"))
    return rounded(rs.transported_response(li, "t", "y", ["z"], "i", [0.02, 0.06]), 6)


@query("""with m as (select l_returnflag as f, l_quantity::int as x, l_linenumber as y, l_linestatus as z from lineitem), c as (select z, x, y, count(*)::double as n from m group by 1, 2, 3),
w as (select *, sum(n) over (partition by z, x) as nx, sum(n) over (partition by z, y) as ny, sum(n) over (partition by z) as ns, sum(n) over () as total from c)
select round(sum(n / total * ln(n * ns / (nx * ny))), 8) as cmi, round(2 * sum(n * ln(n * ns / (nx * ny))), 4) as statistic from w""")
def symbolic_information(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("int").alias("x"), F.col("l_linenumber").alias("y"), F.col("l_linestatus").alias("z"))
    return rounded(ci.symbolic_cmi(li, "x", "y", ["z"]).select("cmi", "statistic"), 8, statistic=4)


@query("""with s as (select corr(l_extendedprice, l_quantity) as r, corr(l_extendedprice, l_tax) as a, corr(l_quantity, l_tax) as b from lineitem)
select 'parcorr' as name, round((r - a * b) / sqrt((1 - a * a) * (1 - b * b)), 8) as statistic from s union all select 'regression', round((r - a * b) / sqrt((1 - a * a) * (1 - b * b)), 8) from s""")
def tests_by_name(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    columns = ["l_extendedprice", "l_quantity", "l_tax"]
    rows = [(k, ci.named_test(li, k, columns)("l_extendedprice", "l_quantity", ["l_tax"])[0]) for k in ("parcorr", "regression")]
    return rounded(spark.createDataFrame(rows, "name string, statistic double"), 8)


@query("""with l as (select value as v, count(*) as k from events group by 1), r as (select v, sum(k) over (order by v) - (k - 1) / 2.0 as a from l), n as (select count(*) + 1.0 as n from events),
u as (select v, a / n as u from r cross join n), t as (select *, sqrt(-2 * ln(least(u, 1 - u))) as t from u),
q as (select *, t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t ** 3) as q from t)
select event_type, round(sum(case when u < 0.5 then -q else q end), 4) as total, round(max(case when u < 0.5 then -q else q end), 6) as top from events join q on value = v group by 1""")
def normal_scores(spark, sf_dir):
    e = ci.robust_scores(table(spark, sf_dir, "events"), ["value"])
    return rounded(e.groupBy("event_type").agg(F.sum("value__score").alias("total"), F.max("value__score").alias("top")), 4, top=6)


# --- lagged models

SERIES = """s as (select user_id, event_id, value as x, lag(value, 1) over w * 0.4 + (event_id * 7919 % 101) as m from events window w as (partition by user_id order by event_id)),
p as (select user_id, event_id, x, m, lag(m, 1) over w * 0.5 + lag(x, 2) over w * 0.2 + (event_id * 104729 % 53) as y from s window w as (partition by user_id order by event_id)),
f as (select *, lag(x, 1) over w as x1, lag(x, 2) over w as x2, lag(m, 1) over w as m1 from p window w as (partition by user_id order by event_id))"""
TEMPLATE = [("x", 1, "m"), ("m", 1, "y"), ("x", 2, "y")]


def _series(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("value").alias("x"))
    e = e.withColumn("m", F.lag("x", 1).over(w) * 0.4 + F.col("event_id") * 7919 % 101)
    return e.withColumn("y", F.lag("m", 1).over(w) * 0.5 + F.lag("x", 2).over(w) * 0.2 + F.col("event_id") * 104729 % 53)


@query(f"""with {SERIES}, a as (select regr_slope(m, x1) as a from f where m is not null and x1 is not null),
k as (select var_pop(m1) as vm, var_pop(x2) as vx, covar_pop(m1, x2) as mx, covar_pop(m1, y) as my, covar_pop(x2, y) as xy from f where y is not null and m1 is not null and x2 is not null),
b as (select (my * vx - mx * xy) / (vm * vx - mx * mx) as b, (xy * vm - mx * my) / (vm * vx - mx * mx) as c from k)
select round(a * b + c, 8) as total, round(c, 8) as direct, round(a * b, 8) as mediated, 2::bigint as paths from a cross join b""")
def temporal_mediation(spark, sf_dir):
    return rounded(ser.temporal_mediation_effect(_series(spark, sf_dir), TEMPLATE, "x", "y", 2, "event_id", ["user_id"]), 8)


@query(f"""with {LAGGED}, s as (select avg(x1) as ma, avg(x2) as mb, avg(y) as my, var_pop(x1) as va, var_pop(x2) as vb, covar_pop(x1, x2) as ab, covar_pop(x1, y) as ay, covar_pop(x2, y) as byy from k),
b as (select *, (ay * vb - ab * byy) / (va * vb - ab * ab) as b1, (byy * va - ab * ay) / (va * vb - ab * ab) as b2 from s)
select count(*) as n, round(avg(my + b1 * (20 - ma) + b2 * (x2 - mb)), 6) as mean from l cross join b where x2 is not null""")
def temporal_prediction(spark, sf_dir):
    p = ser.temporal_predict(table(spark, sf_dir, "events"), "value", [("value", 1), ("value", 2)], "event_id", ["user_id"], {("value", 1): 20.0})
    return rounded(p.where("prediction is not null").agg(F.count("*").alias("n"), F.avg("prediction").alias("mean")), 6)


# --- structural models and attribution


@query(f"""with {CHAIN} select l_returnflag, round(sum(bqp * 10), 4) as direct, round(max(abs(bqp * 10)), 8) as each from li cross join b group by 1""")
def natural_direct_effect(spark, sf_dir):
    """Quantity from 20 to 30 with the discount as it would be at 20."""
    from causelake.operators.scm import Model

    li, g = _chain(spark, sf_dir)
    n = Model.fit(li, g).nested(li, "q", "p", ["d"], 30.0, 20.0)
    return rounded(n.groupBy("l_returnflag").agg(F.sum("direct_effect").alias("direct"), F.max(F.abs("direct_effect")).alias("each")), 4, each=8)


@query(f"""with {CHAIN} select round(bqp * 10, 8) as population_direct, round((bqp + bqd * bdp) * 10, 8) as total from b""")
def population_contrasts(spark, sf_dir):
    from causelake.operators.scm import Model

    li, g = _chain(spark, sf_dir)
    model = Model.fit(li, g)
    shares = model.path_shares("q", "p")
    return rounded(spark.createDataFrame([(10 * shares["q", "p"], 10 * model.total_effect("q", "p"))], "population_direct double, total double"), 8)


@query("""with s as (select s_suppkey, s_acctbal as v from supplier) select s_suppkey, step::int as step, round(case when step = 0 then v when step < 2 then 1 + 0.5 * v when step = 2 then 7.0 when step = 3 then 4.5 else 3.25 end, 9) as value
from s cross join (select unnest(range(0, 5)) as step)""")
def scheduled_trajectories(spark, sf_dir):
    """Four steps of v' = 1 + v / 2 with the second step set to 7."""
    from causelake.operators.scm import trajectory

    return rounded(trajectory(table(spark, sf_dir, "supplier"), "s_suppkey", 4, 0.5, 1.0, {2: 7.0}, "s_acctbal"), 9)


@query("""select s_nationkey as component, round(sum(s_acctbal), 2) as contribution from supplier group by 1 order by abs(round(sum(s_acctbal), 2)) desc, 1 limit 3""")
def leading_causes(spark, sf_dir):
    from causelake.operators.attribution import root_causes

    c = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("component")).agg(F.round(F.sum("s_acctbal"), 2).alias("contribution"))
    return root_causes(c, 3)


# --- posteriors and designs


@query("""select s_nationkey % 5 as g, case when max(s_acctbal - 4000) <= min(s_acctbal + 9000) then max(s_acctbal - 4000) end as low, case when max(s_acctbal - 4000) <= min(s_acctbal + 9000) then min(s_acctbal + 9000) end as high from supplier group by 1""")
def shared_intervals(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 5).alias("g"), (F.col("s_acctbal") - 4000).alias("low"), (F.col("s_acctbal") + 9000).alias("high"))
    return bayes.intersect_intervals(s, ["g"])


@query("""with p as (select avg(s_acctbal) as m, var_samp(s_acctbal) as v from supplier), k as (select 0.3 * 0.7 / 0.01 - 1 as k)
select 'beta' as prior, round(0.3 * k, 8) as first, round(0.7 * k, 8) as second from k union all select 'gamma', round(m * m / v, 8), round(m / v, 8) from p
union all select 'power', round(m, 8), round(v / 0.5, 4) from p union all select 'mixture', round(0.25 * m + 0.75 * 0, 8), round(0.25 * (v + (m - 0.25 * m) ** 2) + 0.75 * (1 + (0.25 * m) ** 2), 4) from p""")
def prior_moments(spark, sf_dir):
    r = table(spark, sf_dir, "supplier").agg(F.avg("s_acctbal").alias("m"), F.var_samp("s_acctbal").alias("v")).first()
    power, mixture = bayes.power_prior(r["m"], r["v"], 0.5), bayes.mixture_prior([(0.25, r["m"], r["v"]), (0.75, 0.0, 1.0)])
    rows = [("beta", *(round(v, 8) for v in bayes.beta_moments(0.3, 0.01))), ("gamma", *(round(v, 8) for v in bayes.gamma_moments(r["m"], r["v"]))), ("power", round(power[0], 8), round(power[1], 4)), ("mixture", round(mixture[0], 8), round(mixture[1], 4))]
    return spark.createDataFrame(rows, "prior string, first double, second double")


@query("""with w as (select s_suppkey, s_acctbal + 1000.0 as a from supplier), n as (select a / sum(a) over () as p from w) select round(-sum(case when p > 0 then p * ln(p) else 0 end), 8) as entropy from n""")
def posterior_entropy(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select((F.col("s_acctbal") + 1000.0).alias("a"))
    total = s.agg(F.sum("a").alias("z"))
    return rounded(val.graph_entropy(s.join(F.broadcast(total)).select((F.col("a") / F.col("z")).alias("weight"))), 8)

